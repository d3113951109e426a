"""Searches give their tasks' best rows on, never a row for every query and text."""

import math
import random
from collections import Counter

import pytest

from brindle.operators import retrieval
from brindle.plans import registry

K = 3


@pytest.fixture
def ranked_rows(monkeypatch):
    """The numbers of rows that reach the ranking, in small blocks of queries and rows."""
    monkeypatch.setattr(retrieval, "QUERIES", 15)
    seen, ranked = [], retrieval.ranked
    monkeypatch.setattr(retrieval, "ranked", lambda scores, k: seen.append(scores.count()) or ranked(scores, k))
    return seen


def best(scores: dict) -> list:
    return [c for _, c in sorted((-s, c) for c, s in scores.items())[:K]]


def test_bm25_hands_on_the_best_rows_of_a_task_alone(spark, ranked_rows):
    rnd = random.Random(3)
    text = lambda: " ".join(["common", *rnd.choices([f"w{i}" for i in range(30)], k=rnd.randint(1, 9)), "the"])
    docs = {i: text() for i in range(300)} | {1000 + i: "common w1" for i in range(9)} | {2000: "", 2001: "the of"}  # ties, and texts without a term
    asked = {i: text() + " w1 w1" for i in range(40)} | {77: "unheard", 78: "the of"}
    corpus = spark.createDataFrame(list(docs.items()), "cid bigint, text string").repartition(6)
    queries = spark.createDataFrame(list(asked.items()), "qid bigint, text string")
    got = {}
    for r in retrieval.bm25(queries, corpus, K).collect():
        got.setdefault(r.qid, {})[r["rank"]] = (r.cid, r.score)
    terms = {i: Counter(w for w in t.split() if w not in retrieval.STOP_WORDS) for i, t in docs.items()}
    df, avg = Counter(w for t in terms.values() for w in t), sum(sum(t.values()) for t in terms.values()) / len(docs)
    want = {}
    for q, a in asked.items():
        own = Counter(w for w in a.split() if w not in retrieval.STOP_WORDS)
        weight = lambda w, t: math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * t[w] * 2.5 / (t[w] + 1.5 * (0.25 + 0.75 * sum(t.values()) / avg))
        scores = {i: round(sum(n * weight(w, t) for w, n in own.items() if w in t), 9) for i, t in terms.items() if own.keys() & t.keys()}
        if scores:
            want[q] = {i + 1: (c, pytest.approx(scores[c], abs=2e-9)) for i, c in enumerate(best(scores))}
    assert got == want and set(want) == set(range(40))
    assert ranked_rows[0] <= 40 * K * spark.sparkContext.defaultParallelism  # of 12,360 pairs with a common term
    assert retrieval.bm25(queries.limit(0), corpus, K).count() == retrieval.bm25(queries, corpus.limit(0), K).count() == 0


def test_dense_hands_on_the_best_rows_of_a_task_alone(spark, ranked_rows):
    rnd = random.Random(4)
    vectors = {f"id{i}": [float(rnd.randint(-2, 2)) for _ in range(4)] for i in range(400)}  # many ties
    corpus = spark.createDataFrame(list(vectors.items()), "cid string, v array<double>").repartition(6)
    queries = spark.createDataFrame([(i, vectors[f"id{i}"]) for i in range(40)], "qid int, v array<double>")
    got = {}
    for r in retrieval.dense(queries, corpus, K, block=32).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.cid)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    assert got == {i: best({c: dot(vectors[f"id{i}"], v) for c, v in vectors.items()}) for i in range(40)}
    assert ranked_rows[0] <= 40 * K * spark.sparkContext.defaultParallelism  # 13 blocks of the corpus gave 1,560 before


@pytest.mark.parametrize("first", [1, 40, 20_000])
def test_own_ranks_are_those_of_the_whole_ranking(spark, monkeypatch, first):
    monkeypatch.setattr(retrieval, "FIRST", first)
    monkeypatch.setattr(retrieval, "QUERIES", 60)
    rnd = random.Random(5)
    text = lambda: " ".join(["common", *rnd.choices([f"w{i}" for i in range(25)], k=rnd.randint(1, 9)), "the"])
    docs = {i: text() for i in range(200)} | {1000 + i: f"common w1{'!' * i}" for i in range(14)} | {2000: "", 2001: "the of", 2002: "alone"}  # ties, and texts without a term
    asked = [(i, " ".join(rnd.choices(docs[i].split(), k=4)), docs[i]) for i in range(180)]
    asked += [(300 + i, "w1 common w1", docs[1000 + i]) for i in range(14)] + [(400, "unheard", docs[3]), (401, "the", "the of"), (402, "w2", ""), (403, "alone w1", "alone")]
    corpus = spark.createDataFrame(list(docs.items()), "cid bigint, text string").repartition(5).groupBy("text").agg({"cid": "min"}).toDF("text", "cid")
    queries = spark.createDataFrame(asked, "qid bigint, text string, own string").repartition(3)
    own = queries.join(corpus.withColumnRenamed("text", "own"), "own").select("qid", "cid")
    want = {r.qid: r["rank"] for r in retrieval.bm25(queries, corpus, K).join(own, ["qid", "cid"]).collect()}
    assert {r.qid: r.r for r in retrieval.own_ranks(queries, corpus, K).collect()} == want
    assert 20 < len(want) < 180 and set(want.values()) == {1, 2, 3}
    assert retrieval.own_ranks(queries.limit(0), corpus, K).count() == retrieval.own_ranks(queries, corpus.limit(0), K).count() == 0


def test_ir_metrics_ask_with_every_row(spark, tmp_path):
    rows = [(i, f"name{i} w{i % 3}", f"text {i // 2} of name{i // 2 * 2} w{i % 5}") for i in range(1, 40)] + [(41, None, "text"), (42, "name", None)]
    spark.createDataFrame(rows, "pair_id bigint, anchor string, positive string").write.parquet(f"{tmp_path}/raw_pairs.parquet")
    got = registry.queries()["ir_metrics"](spark, str(tmp_path)).first()
    assert got.n == 39 and 0 < got.mrr < 1  # 1 before: the ids divisible by 20
