"""Row-level operators: dedup, limits, carving and combining of splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key by an explicit order; a shuffle on the keys and one sort."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def head_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """At most ``n`` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def hash_order(key: Column, seed: int = 42) -> Column:
    """A repeatable shuffling key."""
    return F.sha2(F.concat(F.lit(f"{seed}::"), key.cast("string")), 256)


def carve(df: DataFrame, key: str, by: list[str], share: float = 0.05, least: int = 200, seed: int = 42) -> DataFrame:
    """A ``part`` column: validation for ``max(least, round(share * n))`` rows of each group in hash order.

    A group of at most twice that many rows stays train.  The rows are numbered
    within 256 hash ranges of a group and the ranges' sizes added up, so no
    group is sorted in one task.
    """
    h = hash_order(F.col(key), seed)
    marked = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 2))
    sizes = marked.groupBy(*by, "_b").agg(F.count("*").alias("_m"))
    whole = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_m").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_b").alias("_kb"), before.alias("_before"), F.sum("_m").over(whole).alias("_n"))
    on = reduce(lambda a, b: a & b, [marked[c].eqNullSafe(starts[f"_k{i}"]) for i, c in enumerate(by)], marked["_b"] == starts["_kb"])
    rn = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key))
    numbered = marked.join(F.broadcast(starts), on).withColumn("_rn", rn + F.col("_before"))
    n = F.greatest(F.lit(least), F.bround(F.col("_n") * share).cast("int"))
    part = F.when((F.col("_n") > 2 * n) & (F.col("_rn") <= n), "validation").otherwise("train")
    return numbered.withColumn("part", part).select(*df.columns, "part")


def canonical(df: DataFrame, text: str, spans: str | None, language: str | None, source: Column) -> DataFrame:
    """One schema for span corpora of any origin: ``source_text, spans, language, source``; no spans is empty."""
    empty = F.expr("CAST(array() AS array<struct<start:int,end:int,label:string>>)")
    return df.select(
        F.col(text).cast("string").alias("source_text"),
        (F.coalesce(F.col(spans), empty) if spans else empty).alias("spans"),
        (F.col(language).cast("string") if language else F.lit(None).cast("string")).alias("language"),
        source.alias("source"),
    )


def combine(parts: list[DataFrame]) -> DataFrame:
    """All sources under one schema."""
    if not parts:
        raise ValueError("no sources to combine")
    return reduce(DataFrame.unionByName, parts)


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the finished ones."""
    return df.join(done.select(key).distinct(), key, "left_anti")
