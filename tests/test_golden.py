"""Small cases with expected values worked out by hand, and brute-force versions of what SQL cannot say."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.functions import geometry as geo
from brindle.functions import jsonx, spans as sp
from brindle.functions import text as tx
from brindle.functions import vectors
from brindle.operators import chunking, metrics, pairs, retrieval, spanops

SPANS = "array<struct<start:int,end:int,label:string>>"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_humanize_label(spark):
    want = {"first_name": "first name", "driverLicenseNumber": "driver license number", "PascalCase": "pascal case", "kebab-case-label": "kebab case label", "GIVENNAME": "givenname", "__": "__"}
    df = spark.createDataFrame([(k,) for k in want], "l string")
    assert {r[0]: r[1] for r in df.select("l", tx.humanize_label(F.col("l"))).collect()} == want


@pytest.mark.parametrize("v,bins,want", [(0.0, 1000, 0), (1.0, 1000, 999), (0.5, 1001, 500), (-0.3, 1000, 0), (1.7, 1000, 999)])
def test_quantize(spark, v, bins, want):
    assert value(spark, geo.quantize(F.lit(v), bins)) == want


def test_boxes_as_text(spark):
    box = F.array(*[F.lit(x) for x in (0.1, 0.2, 0.8, 0.9)])
    assert value(spark, geo.serialize(F.lit("Mask"), box)) == "Mask<box> 100, 200, 799, 899 </box>"
    assert value(spark, geo.serialize(F.lit("Mask"), geo.centre(F.array(*[F.lit(x) for x in (0.0, 0.0, 1.0, 1.0)])))) == "Mask<box> 500, 500 </box>"
    parsed = value(spark, geo.parse(F.lit("- red box <box>10,20,30,40</box> junk <box> 1, 2, 3 </box> ok<box>5,6</box>")))
    assert [(o.label, len(o.coords)) for o in parsed] == [("red box", 4), ("ok", 2)]


@pytest.mark.parametrize("a,b,want", [((0, 0, 2, 2), (1, 0, 3, 2), 1 / 3), ((0, 0, 1, 1), (0, 0, 1, 1), 1.0), ((0, 0, 1, 1), (2, 2, 3, 3), 0.0), ((0, 0, 0, 0), (0, 0, 0, 0), 0.0)])
def test_iou(spark, a, b, want):
    arr = lambda t: F.array(*[F.lit(float(x)) for x in t])
    assert value(spark, geo.iou(arr(a), arr(b))) == pytest.approx(want)


def test_pixels_and_points(spark):
    arr = lambda *t: F.array(*[F.lit(float(x)) for x in t])
    assert value(spark, geo.denormalize(arr(0.1, 0.2, 0.5, 0.6), F.lit(100.0), F.lit(200.0))) == pytest.approx([10, 40, 50, 120])
    assert value(spark, geo.xyxy(arr(10, 20, 30, 40))) == [10, 20, 40, 60]
    assert value(spark, geo.xywh(geo.xyxy(arr(10, 20, 30, 40)))) == [10, 20, 30, 40]
    assert value(spark, geo.point_score(arr(0.5, 0.5), arr(0.52, 0.5))) == pytest.approx(0.6)
    assert value(spark, geo.point_score(arr(0.5, 0.5), arr(0.7, 0.5))) == 0.0


def test_span_contract(spark):
    rows = [("abc", [(2, 2, "X")]), ("abc", [(0, 100, "X")]), ("abc", [(-1, 2, "X")]), ("abc", [(0, 1, "")]), ("abc", None), (None, [(0, 1, "X")]), ("abc", [(0, 3, "X")])]
    df = spark.createDataFrame(rows, f"text string, spans {SPANS}")
    got = [[e.error for e in r[0]] for r in df.select(sp.violations(F.col("spans"), F.col("text"))).collect()]
    assert got == [["end > start"], ["end <= len(text)"], ["start >= 0"], ["label"], [], ["end <= len(text)"], []]


def bio(spark, text, spans):
    df = spark.createDataFrame([(text, spans)], f"text string, spans {SPANS}")
    df = df.withColumn("tokens", tx.tokens_with_offsets(F.col("text"))).withColumn("spans", sp.in_order(F.col("spans")))
    return df.select(sp.bio_tags(F.col("tokens"), F.col("spans"))).first()[0]


def test_bio_alignment(spark):
    assert bio(spark, "in New York now", [(3, 11, "CITY")]) == ["O", "B-CITY", "I-CITY", "O"]
    assert bio(spark, "Bob Rome", [(0, 3, "NAME"), (4, 8, "CITY")]) == ["B-NAME", "B-CITY"]
    assert bio(spark, "no spans", []) == ["O", "O"]


def test_offsets_count_code_points(spark):
    texts = ["é😀 ab_1", "", None, "  x "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(tx.tokens_with_offsets(F.col("t"))).collect()]
    assert [(o.tok, o.start, o.end) for o in got[0]] == [("é", 0, 1), ("ab_1", 3, 7)]
    assert got[1] == [] and got[2] is None and [(o.tok, o.start, o.end) for o in got[3]] == [("x", 2, 3)]


def test_windows_against_a_loop(spark):
    rnd = random.Random(0)
    cases = [(rnd.randrange(0, 60), size, overlap, rnd.randrange(0, 12)) for size, overlap in ((5, 2), (10, 0), (7, 6)) for _ in range(25)]
    for size, overlap in ((5, 2), (10, 0), (7, 6)):
        for least in {c[3] for c in cases if c[1] == size}:
            ns = [c[0] for c in cases if c[1] == size and c[3] == least]
            df = spark.createDataFrame([(n,) for n in ns], "n int")
            for r in df.select("n", tx.window_starts(F.col("n"), size, overlap, least).alias("k")).collect():
                want, at = [], 0
                while r.n > 0:
                    if at == 0 or min(size, r.n - at) >= least:
                        want.append(at // (size - overlap))
                    if at + size >= r.n:
                        break
                    at += size - overlap
                assert list(r.k) == want
    with pytest.raises(ValueError):
        tx.window_starts(F.lit(3), 4, 4)


def test_chunks_of_odd_documents(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", "", 2), ("c", " \n", 3), ("d", "one two three", 4), ("d", "one two three", 4)], "id string, text string, chunk_ix int")
    out = chunking.chunk_documents(df, "id", "text", 2, 1, 1).collect()
    assert sorted(r.text for r in out) == ["one two", "one two", "two three", "two three"]
    assert chunking.chunk_documents(df.limit(0), "id", "text").count() == 0
    with pytest.raises(Exception, match="must not be null"):
        chunking.chunk_documents(spark.createDataFrame([(None, "x")], "id string, text string"), "id", "text").collect()


def test_span_chunks_clip_and_rebase(spark):
    df = spark.createDataFrame([(1, "a b c d e", [(0, 1, "first_name"), (2, 5, "X"), (90, 95, "far")]), (2, None, None)], f"k int, text string, spans {SPANS}")
    got = sorted((r.chunk_ix, r.text, [(s.start, s.end, s.label) for s in r.spans]) for r in chunking.span_chunks(df, "k", "text", "spans", 2, 1).collect())
    assert got[0] == (0, "a b", [(0, 1, "first_name"), (2, 3, "X")]) and got[1] == (1, "b c", [(0, 3, "X")]) and len(got) == 4


def merge_loop(spans):
    out = []
    for s, e, label in sorted(spans, key=lambda x: (x[0], -x[1], x[2])):
        if out and out[-1][2] == label and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e), label)
        else:
            out.append((s, e, label))
    return out


def test_span_folds_against_loops(spark):
    rnd = random.Random(3)
    data = []
    for i in range(200):
        data.append((i, [(s := rnd.randrange(30), s + rnd.randrange(1, 8), rnd.choice("AB")) for _ in range(rnd.randrange(0, 7))]))
    df = spark.createDataFrame(data, f"k int, spans {SPANS}")
    for r in df.select("k", sp.merge_touching(F.col("spans")).alias("m"), sp.drop_overlaps(F.col("spans")).alias("d")).collect():
        own = data[r.k][1]
        assert [tuple(x) for x in r.m] == merge_loop(own)
        kept = []
        for s in sorted(own):
            if not kept or kept[-1][1] <= s[0]:
                kept.append(s)
        assert [tuple(x) for x in r.d] == kept


def test_claims_and_votes(spark):
    assert spanops.claim_values("Bob met Bob and  Ann ", [("Bob", "P"), ("Bob", "P"), (" Ann", "P"), ("Cid", "P")]) == [(0, 3, "P"), (8, 11, "P"), (16, 20, "P")]
    df = spark.createDataFrame([(1, "ab ab", [("ab", "X"), ("ab", "Y")]), (2, None, None), (3, "q", [])], "k int, t string, e array<struct<value string, label string>>")
    assert [tuple(r) for r in spanops.claim_spans(df, "k", "t", "e").orderBy("start_pos").collect()] == [(1, 0, 2, "X"), (1, 3, 5, "Y")]
    votes = spark.createDataFrame([(1, 0, "B-A", 0.9), (1, 1, "O", 0.5), (2, 0, "O", 0.4), (2, 1, "I-B", 0.8), (2, 2, "B-B", 0.6), (3, 0, "O", 1.0), (4, 0, "B-C", 0.2), (4, 1, "B-D", 0.4)], "w int, ix int, label string, score double")
    assert {r.w: (r.label, r.score) for r in spanops.vote_words(votes, ["w"]).collect()} == {1: ("A", 0.9), 2: ("B", 0.7), 3: ("O", 1.0), 4: ("C", 0.2)}
    assert spanops.partition_labels(["G", "S", "E", "P", "A"], ["P", "A"]) == (["G", "S", "E"], ["P", "A"])
    for bad in (["Z"], ["G", "S", "E", "P", "A"]):
        with pytest.raises(ValueError):
            spanops.partition_labels(["G", "S", "E", "P", "A"], bad)
    assert spanops.bio_vocabulary(["A"]) == ["O", "B-A", "I-A"]
    assert spanops.literal_spans("[{'start': 0, 'end': None}]") == [{"start": 0, "end": None}] and spanops.literal_spans("x(") == [] and spanops.literal_spans(None) == []


def test_tolerant_json(spark):
    texts = ['{"queries": [{"style": "a", "query": "q"}]}', 'Sure:\n```json\n{"queries": [{"style": "a", "query": "q"}]}\n```', '{"queries": [{"sty', "none", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [len(r[0]) if r[0] else None for r in df.select(jsonx.queries(F.col("t"))).collect()] == [1, 1, None, None, None]
    scores = spark.createDataFrame([(f'{{"score": {s}}}',) for s in ("4", "9", "4.0", '"4"', "true", "null")], "t string")
    assert [r[0] for r in scores.select(jsonx.judge_score(F.col("t"))).collect()] == [4, None, None, None, None, None]
    assert value(spark, jsonx.spans(F.lit("[{'start': 1, 'end': 2, 'label': None}]")))[0].start == 1
    assert value(spark, jsonx.spans(F.lit("not a list"))) == []


def test_span_scores(spark):
    keys = ["d", "s", "e", "l"]
    gold = spark.createDataFrame([(1, 0, 4, "A"), (1, 5, 8, "B"), (1, 5, 8, "B")], "d int, s int, e int, l string")
    pred = spark.createDataFrame([(1, 0, 4, "A"), (1, 9, 12, "C")], "d int, s int, e int, l string")
    r = metrics.with_prf(metrics.span_counts(pred, gold, keys)).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (1, 1, 1, 0.5, 0.5, 0.5)
    empty = metrics.with_prf(metrics.span_counts(pred.limit(0), gold.limit(0), keys)).first()
    assert (empty.tp, empty.fp, empty.fn, empty.f1) == (0, 0, 0, 0.0)
    assert value(spark, metrics.harmonic(F.lit(0.95), F.lit(0.0))) == 0.0 and value(spark, metrics.harmonic(F.lit(0.9), F.lit(0.9))) == pytest.approx(0.9)
    assert value(spark, metrics.f_beta(F.lit(0.5), F.lit(1.0), 2.0)) == pytest.approx(5 * 0.5 / (4 * 0.5 + 1))


def test_text_scores(spark):
    df = spark.createDataFrame([(1, "hello   world\n", "hello world"), (2, "a b", "c d"), (3, "", None), (4, "a a b", "a b b")], "k int, p string, g string")
    got = {r.k: (r.em, r.f1) for r in metrics.text_scores(df, "k", "p", "g").collect()}
    assert got == {1: (1, 1.0), 2: (0, 0.0), 3: (1, 0.0), 4: (0, round(2 / 3, 6))}


def test_greedy_pairs_against_a_loop(spark):
    rnd = random.Random(5)
    rows = [(g, p, q, round(rnd.random(), 1)) for g in range(40) for p in range(5) for q in range(5) if rnd.random() < 0.5]
    got = metrics.greedy_matches(spark.createDataFrame(rows, "g int, pred int, gold int, score double"), ["g"]).collect()
    for least in (0.0, 0.5, 0.8):  # the matches at a threshold are those of at least it
        for g in range(40):
            ps, gs = set(), set()
            for _, p, q in sorted((-s, p, q) for gg, p, q, s in rows if gg == g and s >= least):
                if p not in ps and q not in gs:
                    ps.add(p)
                    gs.add(q)
            assert {r.pred for r in got if r.g == g and r.score >= least} == ps


def test_matched_detections_against_a_loop(spark):
    rnd = random.Random(6)
    scores = {(g, p): round(rnd.random(), 1) for g in range(30) for p in range(6)}
    rows = [(g, p, scores[g, p], q, round(rnd.random(), 2)) for g in range(30) for p in range(6) for q in range(4) if rnd.random() < 0.6]
    levels = [0.3, 0.6]
    got = {(r.g, r.pred, r.iou) for r in metrics.matched_detections(spark.createDataFrame(rows, "g int, pred int, det_score double, gold int, iou double"), ["g"], levels).collect()}
    want = set()
    for least in levels:
        for g in range(30):
            taken = set()
            for p in sorted(range(6), key=lambda p: (-scores[g, p], p)):
                free = [(-i, q) for gg, pp, _, q, i in rows if gg == g and pp == p and i >= least and q not in taken]
                if free:
                    taken.add(min(free)[1])
                    want.add((g, p, least))
    assert got == want


def test_map_summary_of_one_label_and_of_none(spark):
    gold = spark.createDataFrame([("cat", 2)], "label string, n_gold long")
    det = spark.createDataFrame([(1, "cat", 0, 0.9), (1, "cat", 1, 0.8)], "image int, label string, pred int, det_score double")
    cand = spark.createDataFrame([(1, "cat", 0, 0, 0.97), (1, "cat", 1, 1, 0.62)], "image int, label string, pred int, gold int, iou double")
    hits = metrics.coco_hits(cand, det, "image", "label")
    out = {r.metric: r.value for r in metrics.map_summary(metrics.coco_average_precision(hits, gold, "label"), metrics.coco_average_recall(hits, gold, "label"), "label").collect()}
    assert out["map_50"] == 1.0 and out["map_75"] == pytest.approx(51 / 101, abs=1e-6) and out["map"] == out["map_cat"]
    assert out["mar_1"] == 0.5 and out["mar_100"] == pytest.approx((3 * 1.0 + 7 * 0.5) / 10)
    empty = metrics.map_summary(metrics.coco_average_precision(hits.limit(0), gold.limit(0), "label"), metrics.coco_average_recall(hits.limit(0), gold.limit(0), "label"), "label")
    assert {r.value for r in empty.collect()} == {-1.0}


def test_average_precision_against_a_loop(spark):
    rnd = random.Random(8)
    for total in (60, 5):
        rows = [("a", (i * 37 % 1000) / 1000.0, int(rnd.random() < 0.6)) for i in range(total)]
        n_gold = sum(h for *_, h in rows) + 7
        df = spark.createDataFrame(rows, "label string, det_score double, hit int")
        gold = spark.createDataFrame([("a", n_gold), ("b", 3)], "label string, n_gold bigint")
        got = {r.label: r.ap for r in metrics.average_precision(df, gold, ["label"]).collect()}
        tp, points = 0, []
        for i, (_, _, h) in enumerate(sorted(rows, key=lambda r: -r[1]), 1):
            tp += h
            points.append((tp / n_gold, tp / i))
        want = sum(max([p for r, p in points if r >= k / 100 - 1e-12], default=0.0) for k in range(101)) / 101
        assert got["a"] == pytest.approx(want, abs=1e-5) and got["b"] == 0.0


def test_dense_search_in_blocks(spark):
    rnd = random.Random(6)
    vs = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(99, None)]
    corpus = spark.createDataFrame(vs, "cid bigint, v array<float>").repartition(5)
    queries = corpus.filter("cid < 9").withColumnRenamed("cid", "qid")
    got = {}
    for r in retrieval.dense(queries, corpus, 4, block=4).collect():
        got.setdefault(r.qid, []).append((r.rank, r.cid))
    plain = [(i, v) for i, v in vs if v]
    for q in range(9):
        order = sorted(plain, key=lambda c: (-round(sum(float(a) * float(b) for a, b in zip(vs[q][1], c[1])), 6), c[0]))
        assert [c for _, c in sorted(got[q])] == [c for c, _ in order[:4]]
    assert retrieval.dense(queries.limit(0), corpus, 4).count() == 0


def test_pair_filter_order_and_scope(spark):
    rows = [(1, "what is the big red boat", "a long text about other things", 5), (2, "What is the big red boat ", "again other words here", 4), (3, "too short", "x y z", 5), (4, "copy these seven words from the text now", "copy these seven words from the text now please", 5), (5, None, "x", 5), (6, "a fine query of words", None, 5), (7, "another fine query of words", "some passage", None)]
    df = spark.createDataFrame(rows, "k int, q string, p string, s int")
    cfg = pairs.PairConfig()
    assert [r.k for r in pairs.filter_pairs(df, "k", "q", "p", cfg, "s").orderBy("k").collect()] == [1]
    both = pairs.PairConfig(dedup_scope="anchor_positive", judge=False)
    assert [r.k for r in pairs.filter_pairs(df, "k", "q", "p", both).orderBy("k").collect()] == [1, 2, 7]
    with pytest.raises(ValueError):
        pairs.filter_pairs(df, "k", "q", "p", cfg)
    with pytest.raises(ValueError):
        pairs.PairConfig(train=0.8)


def test_verbatim_runs_against_a_loop(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice("abcd") for _ in range(rnd.randrange(0, 9))), " ".join(rnd.choice("abcd") for _ in range(rnd.randrange(0, 20)))) for i in range(150)] + [(999, None, None)]
    df = spark.createDataFrame(rows, "k int, q string, p string")
    for r in pairs.verbatim_runs(df, "k", "q", "p").collect():
        _, q, p = next(x for x in rows if x[0] == r.k)
        q, p = (q or "").split(), (p or "").split()
        best = max([n for i in range(len(q)) for j in range(len(p)) for n in range(1, 21) if i + n <= len(q) and q[i : i + n] == p[j : j + n]], default=0)
        assert r.run == best


def test_vectors(spark):
    v = F.array(*[F.lit(float(x)) for x in (3, 4, 7)])
    assert value(spark, vectors.truncated(v, 2)) == pytest.approx([0.6, 0.8])
    assert value(spark, vectors.normalized(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert sum(value(spark, vectors.softmax(v))) == pytest.approx(1.0) and value(spark, vectors.argmax(v)) == 2
    assert value(spark, vectors.score_cap(F.lit(0.5), 0.4, 0.1)) == pytest.approx(0.3) and value(spark, vectors.score_cap(F.lit(0.5), None, 0.1)) == pytest.approx(0.4)
    assert value(spark, vectors.score_cap(F.lit(0.5))) is None


def test_label_alignment(spark):
    def run(spans, offsets, special=None, all_tokens=True, labels=None):
        df = spark.createDataFrame([(offsets, spans, special)], "t array<struct<start int, end int>>, s array<struct<start int, end int, label string>>, x array<int>")
        marks = sp.known_labels(F.col("s"), labels) if labels else F.col("s")
        return df.select(sp.bio_tags(F.col("t"), marks, F.col("x"), all_tokens)).first()[0]

    assert run([(5, 8, "NAME")], [(0, 4), (5, 7), (7, 8)], all_tokens=False) == ["O", "B-NAME", "-100"]
    assert run([(0, 5, "NAME"), (5, 10, "CITY")], [(0, 5), (5, 10)]) == ["B-NAME", "B-CITY"]
    assert run([(0, 4, "NAME")], [(0, 0), (0, 4), (0, 0)], [1, 0, 1]) == ["-100", "B-NAME", "-100"]
    assert run([(0, 4, "OTHER")], [(0, 4)], labels=["NAME"]) == ["O"]
    assert run([(5, 10, "CITY")], [(5, 5), (5, 10)]) == ["O", "B-CITY"]
    assert run([(5, 10, "CITY")], [(4, 7), (7, 10)]) == ["B-CITY", "I-CITY"]  # a token that begins at the space before
    assert run([(0, 9, "CITY")], [(0, 3), (0, 0), (3, 9)], [0, 1, 0]) == ["B-CITY", "-100", "B-CITY"]
    assert run(None, [(0, 3)]) == ["O"] and run([(0, 3, None)], [(0, 3)]) == ["O"]
    tags = F.array(*[F.lit(x) for x in ("O", "B-A", "-100", "B-Z")])
    assert value(spark, sp.tag_ids(tags, ["O", "B-A", "I-A"])) == [0, 1, -100, None]


def test_pair_score(spark):
    obj = lambda box, point: F.struct(F.lit(box).cast("array<double>").alias("box") if box is None else F.array(*map(F.lit, box)).alias("box"), (F.lit(None).cast("array<double>") if point is None else F.array(*map(F.lit, point))).alias("point"))
    box = [0.1, 0.1, 0.3, 0.3]
    assert value(spark, geo.pair_score(obj(box, None), obj(box, None), "box")) == 1.0
    assert value(spark, geo.pair_score(obj(None, [0.1, 0.3]), obj(box, None), "point")) == 1.0
    assert value(spark, geo.pair_score(obj(None, [0.5, 0.3]), obj(box, None), "point")) == 0.0
    assert value(spark, geo.pair_score(obj(None, [0.5, 0.5]), obj(None, [0.5, 0.525]), "point")) == pytest.approx(0.5)
    assert value(spark, geo.pair_score(obj(box, None), obj(None, [0.5, 0.5]), "point")) is None
