import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators import pairs, rows
from brindle.sources import meta, readers
from brindle.sources.resume import ResumeStore
from brindle.streaming import ingest

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())])


def write(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_jsonl_is_strict(spark, tmp_path):
    good = write(tmp_path / "a.jsonl", ['{"id": "1", "text": "x"}', "", '{"id": "2", "text": "y"}'])
    bad = write(tmp_path / "b.jsonl", ['{"id": "1", "text": "x"}', '{"id": '])
    assert readers.read_any(spark, good, SCHEMA).count() == 2
    with pytest.raises(Exception):
        readers.read_any(spark, bad, SCHEMA).collect()
    assert [r.line for r in readers.broken_lines(spark, bad, SCHEMA).collect()] == ['{"id": ']
    with pytest.raises(ValueError):
        readers.read_any(spark, good)


def test_formats_and_splits(spark, tmp_path):
    df = spark.createDataFrame([("1", "a, b"), ("2", None)], SCHEMA)
    df.write.parquet(str(tmp_path / "p.parquet"))
    df.write.option("header", "true").csv(str(tmp_path / "c.csv"))
    table = pa.table({"id": ["1", "2"], "text": ["a, b", None]})
    with pa.OSFile(str(tmp_path / "f.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
    with pa.OSFile(str(tmp_path / "s.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write_table(table)
    want = [("1", "a, b"), ("2", None)]
    for name in ("p.parquet", "c.csv", "f.arrow", "s.arrow"):
        assert sorted(map(tuple, readers.read_any(spark, str(tmp_path / name), SCHEMA).collect())) == want, name
    both = readers.LocalSource({"train": str(tmp_path / "p.parquet"), "dev": str(tmp_path / "c.csv")}, SCHEMA).load(spark)
    assert {(r.split, r.n) for r in both.groupBy("split").agg(F.count("*").alias("n")).collect()} == {("train", 2), ("dev", 2)}
    readers.write_splits(both, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("split = 'dev'").count() == 2
    text = write(tmp_path / "l.txt", ["  one ", "", " ", "two"])
    assert sorted(r.text for r in readers.read_any(spark, text).collect()) == ["one", "two"]
    with pytest.raises(KeyError):
        readers.load_sources(spark, {}, ["x"])


def test_documents(spark):
    df = spark.createDataFrame([(1, "x", "z"), (2, " ", "z"), (3, None, "z")], "k int, text string, id string")
    assert [tuple(r) for r in readers.documents(df, "k").collect()] == [("1", "x")]
    with pytest.raises(Exception, match="no id"):
        readers.documents(spark.createDataFrame([(None, "x")], "id string, text string")).collect()


def test_sidecar_and_config(tmp_path):
    assert meta.load_meta(str(tmp_path)) is None
    meta.save_meta(str(tmp_path), {"tokenizer": "a", "b": 1})
    assert json.loads((tmp_path / meta.NAME).read_text()) == {"b": 1, "tokenizer": "a"} and (tmp_path / meta.NAME).read_text().startswith('{\n  "b"')
    meta.assert_same(meta.load_meta(str(tmp_path)), "tokenizer", "a")
    meta.assert_same(None, "tokenizer", "z")
    with pytest.raises(ValueError):
        meta.assert_same(meta.load_meta(str(tmp_path)), "tokenizer", "z")
    with pytest.warns(UserWarning):
        assert meta.warn_if_longer(600, 512)
    cfg = meta.load_config(pairs.PairConfig, None, {"min_words": "4", "train": "0.8", "dev": 0.1, "test": "1e-1"})
    assert cfg.min_words == 4 and cfg.train == 0.8
    with pytest.raises(ValueError):
        meta.load_config(pairs.PairConfig, None, {"nope": 1})
    assert meta.parse_pairs(["a= b=c"]) == {"a": " b=c"}
    with pytest.raises(ValueError):
        meta.parse_pairs(["a"])
    assert meta.total_steps(100, 8, 3) == 39 and meta.total_steps(0, 8, 3) == 1


def test_resume_store(spark, tmp_path):
    path = str(tmp_path / "done")
    store = ResumeStore(spark, path, "k", T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.IntegerType())]))
    assert store.n_done() == 0
    rows_ = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    store.append(rows_)
    store.append(rows_.filter("k = 'a'"))
    (tmp_path / "done" / "part-broken.json").write_text('{"k": "c", "v"')
    assert store.n_done() == 2
    todo = spark.createDataFrame([("a",), ("z",)], "k string")
    assert [r.k for r in store.pending(todo).collect()] == ["z"]
    store.clear()
    assert store.n_done() == 0


def test_carving_is_exact_and_repeatable(spark):
    df = spark.createDataFrame([(i, "big" if i < 1000 else "small") for i in range(1050)] + [(2000 + i, None) for i in range(500)], "k int, g string")
    got = rows.carve(df, "k", ["g"], share=0.1, least=40)
    assert {(r.g, r.part): r.n for r in got.groupBy("g", "part").agg(F.count("*").alias("n")).collect()} == {("big", "train"): 900, ("big", "validation"): 100, ("small", "train"): 50, (None, "train"): 450, (None, "validation"): 50}
    first = {r.k for r in got.filter("part = 'validation'").collect()}
    assert first == {r.k for r in rows.carve(df.repartition(7), "k", ["g"], share=0.1, least=40).filter("part = 'validation'").collect()}


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        write(folder / f"{i}.json", [json.dumps({"id": f"{i}-{j}", "text": "one two three four five six"}) for j in range(4)])
    stream = ingest.stream_documents(spark, str(folder), SCHEMA, per_trigger=1)
    q = ingest.write_batches(stream, lambda b: ingest.chunk_stream(b, "id", "text"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    batch = ingest.chunk_stream(spark.read.schema(SCHEMA).json(str(folder)), "id", "text")
    assert sorted(r.chunk_id for r in out.collect()) == sorted(r.chunk_id for r in batch.collect()) and out.select("batch").distinct().count() == 3


def test_stream_counts_by_event_time(spark, tmp_path):
    folder = tmp_path / "ev"
    folder.mkdir()
    write(folder / "a.json", [json.dumps({"at": f"2024-01-01 00:{m:02d}:00", "k": "x"}) for m in (1, 2, 11)])
    schema = T.StructType([T.StructField("at", T.TimestampType()), T.StructField("k", T.StringType())])
    counts = ingest.counts_by_window(ingest.stream_documents(spark, str(folder), schema), "at", "k")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.sql("SELECT * FROM seen").collect()) == [1, 2]
