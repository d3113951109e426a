import random

from brindle.llm import groups
from pyspark.sql import functions as F

SCHEMA = "rec_id bigint, id string, text string, author string, entity string, key string, root string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "r") for r in rows], SCHEMA)


def leads(df):
    return {r.rec: r.lead for r in groups.related_groups(df).collect()}


def test_keys_and_chains(spark):
    rows = [
        (1, "FIL-01::2", None, "Émile Roth", "Acme One Ltd."),
        (2, "fil_01", "", None, None),
        (3, " ", "Registrant: ACME  One, Limited\nGoods came from Other Mills Ltd.", "n/a", None),
        (4, None, "Goods came from Acme One Ltd.", "-", " "),
        (5, "FIL-9", None, "ROTH, Émile", "Beta Two AG"),
        (6, "x", "Filed on behalf of Beta Two A.G..", "Staff", None),
        (7, "y", 'Gamma Three S.A. (the "Company") submits this report.', "Prof. Jo Lund", None),
        (8, "z", None, "By Jo  Lund", None),
        (9, "w", None, "Staff", None),
        (9, "w", None, "Staff", None),
        (10, "v", "Text. Filed on behalf of Beta Two AG", "Editor", "unknown"),
    ]
    assert leads(frame(spark, rows)) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1, 6: 1, 7: 7, 8: 7, 9: 9, 10: 1}
    assert leads(frame(spark, [])) == {}


def test_forest_against_union_find(spark):
    rnd = random.Random(5)
    edges = {(rnd.randrange(400), rnd.randrange(400)) for _ in range(350)} | {(i, i + 1) for i in range(500, 560)}
    edges = {(max(e), min(e)) for e in edges if e[0] != e[1]}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    df = spark.createDataFrame(list(edges), "a bigint, b bigint").withColumn("w", F.xxhash64("a", "b"))
    forest, roots = groups.spanning_forest(df)
    got = {r.node: r.root for r in roots.collect()}
    nodes = {x for e in edges for x in e}
    assert set(got) == nodes
    mine, want = {}, {}
    for x in nodes:
        mine.setdefault(got[x], set()).add(x)
        want.setdefault(find(x), set()).add(x)
    assert {frozenset(v) for v in mine.values()} == {frozenset(v) for v in want.values()}
    assert forest.distinct().count() == len(nodes) - len(want)


def test_deal_is_near_the_fractions_with_a_hot_group(spark):
    rnd = random.Random(1)
    sizes = [3000] + [rnd.choice([1, 1, 1, 2, 3, 5, 9, 17]) for _ in range(2500)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "lead bigint, n bigint")
    dealt = groups.deal(df).collect()
    assert len(dealt) == len(sizes) and len({r.lead for r in dealt}) == len(sizes)
    total = sum(sizes)
    share = {k: sum(r.n for r in dealt if r.split == k) / total for k in groups.FRACTIONS}
    assert all(abs(share[k] - f) < 0.003 for k, f in groups.FRACTIONS.items())
    assert groups.deal(df.limit(0)).count() == 0
