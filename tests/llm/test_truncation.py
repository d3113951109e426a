import random

from brindle.llm import truncation

SCHEMA = "resp_id bigint, source string, prompt string, text string, completion_tokens int, key string, rest string"
NOUNS = ["boat", "river", "letter", "garden", "window", "market"]
ADJ = ["green", "quiet", "narrow", "broken"]


def sentence(rnd):
    number = rnd.randrange(10 ** rnd.randint(1, 12))
    return f"In {number} the {rnd.choice(ADJ)} {rnd.choice(NOUNS)} near the {rnd.choice(ADJ)} {rnd.choice(NOUNS)} moved slowly towards the {rnd.choice(NOUNS)}."


def test_found_reasons_and_rates(spark):
    rnd = random.Random(2)
    rows, bad = [], set()
    for i in range(1500):
        text = " ".join(sentence(rnd) for _ in range(rnd.randint(1, 4)))
        if i % 2 and len(text) > 120:
            text = text[:120]
            if not text.rstrip().endswith("."):
                bad.add(i)
        rows.append((i, "cutter" if i % 2 else "clean", "Tell me.", text, len(text) // 4))
    extra = {
        5000: ("clean", "{\"a\": [\"x\", {\"b\": \"c\"}", True),
        5001: ("clean", "{\"a\": \"The quiet river moved.\"}", False),
        5002: ("clean", "The green boat near the narr", True),
        5003: ("clean", "The green boat moved towards the market", False),
        5004: ("clean", "The green boat moved towards the [truncated]", True),
        5005: ("clean", "Yes", False),
        5006: ("clean", "", False),
        5007: (None, None, False),
        5008: ("clean", "[no answer]", False),
        5009: (None, "The green boat near the quiet", True),
    }
    for k, (s, t, is_bad) in extra.items():
        rows.append((k, s, "p", t, None))
        if is_bad:
            bad.add(k)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = truncation.truncated(df, "resp_id").collect()
    assert {r.key for r in got} == bad
    limits = truncation.cut_lengths(truncation.prepared(df, "resp_id", "text", "source", None, None)).collect()
    assert {(r.source, r.unit, r.length) for r in limits} == {("cutter", "chars", 120), ("cutter", "bytes", 120)}
    rates = {r.source: r.n_cut for r in truncation.rates(df, truncation.truncated(df, "resp_id")).collect()}
    assert rates["cutter"] == sum(1 for b in bad if b < 5000) and rates[""] == 1
    assert truncation.truncated(df.limit(0), "resp_id").count() == 0


def test_json_shapes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("```json\n{\"a\": 1",), ("Here is the result:\n{\"a\": 1}",), ("{}",), ("plain {x} text",)], "t string")
    got = [tuple(r) for r in df.select(truncation.is_json(F.col("t")), truncation.unbalanced(F.col("t"))).collect()]
    assert got == [(True, True), (True, False), (True, False), (False, False)]
