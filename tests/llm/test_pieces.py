from brindle.llm import pieces
from pyspark.sql import functions as F

SCHEMA = "ann_id bigint, text string, spans array<struct<start int, end int, label string>>, piece_ix string"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, s, "clash") for i, (t, s) in enumerate(rows)], SCHEMA)
    out = {}
    for r in pieces.split_oversized(df, "ann_id", **kw).collect():
        out.setdefault(r.ann_id, []).append(r)
    return {k: sorted(v, key=lambda r: r.piece_ix) for k, v in out.items()}


def test_tiles_text_and_rebases(spark):
    long = ("One sentence about a boat. " * 40 + "\n\n") * 8
    nospace = "x" * 4100
    smile = "\U0001f600" * 3000
    comb = "é" * 2500
    rows = [(long, [(10, 20, "A"), (1790, 1815, "B"), (5, 5, "C"), (10**6, 10**6 + 3, "D")]), (nospace, None), (smile, []), (comb, []), ("short", [(0, 5, "A")]), ("", []), (None, None), ("a b " * 100_000, [])]
    got = run(spark, rows)
    for i, (text, spans) in enumerate(rows):
        if text is None:
            assert len(got[i]) == 1 and got[i][0].text is None
            continue
        at = 0
        for k, r in enumerate(got[i]):
            assert len(r.text) <= 2000 and text[r.piece_start : r.piece_end] == r.text
            assert r.n_pieces == len(got[i])
            if k:
                assert 100 <= at - r.piece_start <= 200
            else:
                assert r.piece_start == 0
            at = r.piece_end
            for s in r.spans or []:
                assert 0 <= s.start < s.end <= len(r.text)
        assert at == len(text)
    assert got[0][0].text.endswith((". ", ".", "\n"))
    for r in got[0][:-1]:
        assert r.text.rstrip().endswith(".")
    assert not any(p.text[0] == "́" for p in got[3])
    first = [(s.start, s.end, s.label) for s in got[0][0].spans]
    assert first[0] == (10, 20, "A")
    pieces_with_b = [(r.piece_start + s.start, r.piece_start + s.end) for r in got[0] for s in r.spans if s.label == "B"]
    assert min(a for a, _ in pieces_with_b) == 1790 and max(b for _, b in pieces_with_b) == 1815


def test_small_limits_and_empty_table(spark):
    got = run(spark, [("alpha beta gamma delta epsilon", None)], limit=12, overlap=4)
    assert all(len(r.text) <= 12 for r in got[0]) and got[0][-1].piece_end == 30
    assert run(spark, []) == {}
    df = spark.createDataFrame([(1, "x" * 10, None, "")], SCHEMA)
    assert pieces.split_oversized(df, "ann_id", oversized_only=True).count() == 0
    assert df.select(F.size(pieces.segments(F.col("text"), 3))).first()[0] == 4
