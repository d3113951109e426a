"""Reading documents and datasets under explicit schemas, and writing them."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Reader by file suffix.
FORMATS = {".jsonl": "json", ".json": "json", ".csv": "csv", ".parquet": "parquet", ".orc": "orc", ".arrow": "arrow", ".feather": "arrow", ".txt": "text"}
DOCUMENT = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())])


class Source(Protocol):
    """Anything that loads as one DataFrame with a ``split`` column."""

    def load(self, spark: SparkSession) -> DataFrame: ...


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Strict JSON lines: blank lines are skipped, a broken one fails the job and names the file."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def broken_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``(file, line)`` of lines that are no JSON of this schema: what to look at when the strict read fails."""
    with_bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    raw = spark.read.text(path).filter(F.col("value").rlike(r"\S")).select(F.col("_metadata.file_path").alias("file"), "value")
    parsed = raw.withColumn("p", F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.filter("p._bad IS NOT NULL").select("file", F.col("value").alias("line"))


def read_any(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str | None = None) -> DataFrame:
    """A file or folder by its suffix; text formats need a schema, as types are never guessed."""
    fmt = fmt or FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lower(), "parquet")
    if fmt == "arrow":
        return read_arrow(spark, path)
    if fmt == "text":
        return read_lines(spark, path)
    if fmt in ("json", "csv") and schema is None:
        raise ValueError(f"a schema is needed to read {fmt}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    options = {"json": {"mode": "FAILFAST"}, "csv": {"mode": "FAILFAST", "header": "true", "multiLine": "true", "escape": '"'}}.get(fmt, {})
    return reader.options(**options).format(fmt).load(path)


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files: the file list is spread over the tasks, which read whole files batch by batch."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    names = sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith((".arrow", ".feather"))) if os.path.isdir(path) else [path]
    if not names:
        raise FileNotFoundError(f"no Arrow files in {path}")

    def open_any(name: str):
        source = pa.memory_map(name)
        try:
            return pa.ipc.open_file(source)
        except pa.ArrowInvalid:
            return pa.ipc.open_stream(source)

    schema = open_any(names[0]).schema

    def load(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                reader = open_any(name)
                for i in range(getattr(reader, "num_record_batches", 0)):
                    yield reader.get_batch(i)
                if not hasattr(reader, "num_record_batches"):
                    yield from reader

    files = spark.createDataFrame([(n,) for n in names], "name string").repartition(len(names))
    return files.mapInArrow(load, from_arrow_schema(schema))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(text)``: the stripped lines of text files that are not blank."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("text"))
    return lines.filter("text != ''")


def read_splits(spark: SparkSession, files: dict[str, str], schema: T.StructType | None = None, fmt: str | None = None) -> DataFrame:
    """``{split: path}`` as one DataFrame with a ``split`` column."""
    if not files:
        raise ValueError("no files")
    parts = [read_any(spark, p, schema, fmt).withColumn("split", F.lit(s)) for s, p in files.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def documents(df: DataFrame, id_col: str = "id", text_col: str = "text", limit: int | None = None) -> DataFrame:
    """``(id string, text)`` of the rows whose text is not blank; a null id is an error."""
    key = F.col(id_col).cast("string")
    out = df.filter(F.col(text_col).rlike(r"\S")).select(F.when(key.isNull(), F.raise_error(F.lit("a document has no id"))).otherwise(key).alias("id"), F.col(text_col).alias("text"))
    return out.limit(limit) if limit is not None else out


class LocalSource:
    """Files of one format, one for each split."""

    def __init__(self, files: dict[str, str], schema: T.StructType | None = None, fmt: str | None = None):
        self.files, self.schema, self.fmt = files, schema, fmt

    def load(self, spark: SparkSession) -> DataFrame:
        return read_splits(spark, self.files, self.schema, self.fmt)


class StagedSource:
    """A source whose files a ``fetch`` callable brings to a folder first (a drive, a hub); none is built in."""

    def __init__(self, fetch: Callable[[], dict[str, str]], schema: T.StructType | None = None, fmt: str | None = None):
        self.fetch, self.schema, self.fmt = fetch, schema, fmt

    def load(self, spark: SparkSession) -> DataFrame:
        return LocalSource(self.fetch(), self.schema, self.fmt).load(spark)


def load_sources(spark: SparkSession, registry: dict[str, Source], names: list[str]) -> dict[str, DataFrame]:
    """Named sources of a registry; an unknown name is an error."""
    unknown = [n for n in names if n not in registry]
    if unknown:
        raise KeyError(f"unknown sources: {unknown}; there are {sorted(registry)}")
    return {n: registry[n].load(spark) for n in names}


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet, one folder for each split, so that a read of one split skips the others."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, null fields included."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
