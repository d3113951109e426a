import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators import contracts, generate


def schema(*types):
    return T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate(types)])


S, L = T.StringType(), T.ArrayType(T.FloatType())


@pytest.mark.parametrize("types,want", [((S, S), "pair"), ((S, S, S), "triplet"), ((S, S, S, S), "multi_negative"), ((S, S, S, L), "distill")])
def test_shapes(types, want):
    assert contracts.infer_shape(schema(*types)) == want
    assert contracts.text_columns(schema(*types)) == [f"c{i}" for i, t in enumerate(types) if t is S]


@pytest.mark.parametrize("types", [(S,), (S, T.LongType()), (S, S, L), (L,)])
def test_no_shape(types):
    with pytest.raises(ValueError):
        contracts.infer_shape(schema(*types))


def test_splits(spark):
    df = spark.createDataFrame([("a", "p", "train"), ("b", "q", "dev")], "anchor string, positive string, split string")
    assert contracts.check_splits(df) == "pair"
    with pytest.raises(ValueError):
        contracts.check_splits(df.filter("split = 'dev'"))


def test_coco_contract(spark):
    t = "objects struct<bbox array<array<double>>, category_id array<bigint>, area array<double>, iscrowd array<int>>"
    rows = [([[10.0, 20.0, 30.0]], [0], [1.0], [0]), ([[1.0, 1.0, 0.0, 2.0]], [0], [1.0], [0]), ([[-1.0, 1.0, 1.0, 2.0]], [0], [1.0], [0]), ([[1.0, 1.0, 1.0, 2.0]], [-1], [1.0], [0]), ([[1.0, 1.0, 1.0, 2.0]], [0, 1], [1.0], [0]), ([], [], [], [])]
    got = [list(r[0]) for r in spark.createDataFrame([(r,) for r in rows], t).select(contracts.coco_violations(F.col("objects"))).collect()]
    assert "bbox has 4 numbers" in got[0] and got[1] == ["width and height > 0"] and got[2] == ["x and y >= 0"] and got[3] == ["category_id >= 0"] and got[4] == ["lengths differ"] and got[5] == []


def test_targets_and_objects(spark):
    df = spark.createDataFrame([("r", "o"), (None, "o"), (None, ""), (None, None)], "r string, o string")
    assert [r[0] for r in df.select(contracts.target(F.col("r"), F.col("o"))).collect()] == ["r", "o", "No objects detected.", "No objects detected."]
    b = spark.createDataFrame([([[1.0, 2.0, 3.0, 4.0]], [7])], "b array<array<double>>, c array<bigint>")
    o = b.select(contracts.coco_objects(F.col("b"), F.col("c"), F.lit(None).cast("array<double>"), F.lit(None).cast("array<int>")).alias("o")).first().o[0]
    assert (o.area, o.iscrowd, o.category_id) == (12.0, 0, 7)
    assert contracts.longest_first(spark.createDataFrame([("a",), ("abc",), (None,)], "t string").coalesce(1), "t").first().t == "abc"
    assert contracts.timed(lambda: df, 1)["min"] > 0


def test_generator_and_requests(spark):
    df = spark.createDataFrame([("one two three",)], "t string")
    r = df.select(generate.generation_request(F.col("t")), generate.judge_request(F.lit("q"), F.col("t")), generate.multi_hop_request(F.col("t")), generate.stub_queries(F.col("t")), generate.overlap_scorer(F.lit("one nine"), F.col("t"))).first()
    assert r[0].endswith("one two three") and "Query: q" in r[1] and r[3][0].query == "one two three" and r[4] == 0.5

    def upper(batches):
        for pdf in batches:
            pdf["t"] = pdf["t"].str.upper()
            yield pdf

    assert generate.run_generator(df, upper, "t string").first().t == "ONE TWO THREE"
