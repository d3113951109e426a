"""Span operators over tables: vocabulary, alignment, claiming, voting."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vocabulary(df: DataFrame, spans: str) -> DataFrame:
    """Distinct labels."""
    return df.select(F.explode(spans).alias("s")).select("s.label").filter("label IS NOT NULL").distinct()


def partition_labels(labels: list[str], holdout: list[str]) -> tuple[list[str], list[str]]:
    """``(train, holdout)`` in the order of ``labels``; unknown labels or an empty train part are errors."""
    unknown = [x for x in holdout if x not in labels]
    if unknown:
        raise ValueError(f"unknown labels held out: {unknown}")
    train = [x for x in labels if x not in holdout]
    if not train:
        raise ValueError("no label is left to train on")
    return train, [x for x in labels if x in holdout]


def bio_vocabulary(labels: list[str]) -> list[str]:
    """O, then B and I of each label."""
    return ["O", *(f"{p}-{x}" for x in labels for p in "BI")]


def decode_bio(tags: DataFrame, key: str, ix: str, tag: str, start: str, end: str) -> DataFrame:
    """``(key, start_pos, end_pos, label)`` of BIO rows: a B, or an I that does not go on, opens a span."""
    w = Window.partitionBy(key).orderBy(ix)
    label = F.nullif(F.regexp_replace(F.col(tag), "^[BI]-|^O$", ""), F.lit(""))
    t = tags.select(key, ix, F.col(tag).alias("_t"), label.alias("_l"), F.col(start).alias("_a"), F.col(end).alias("_b"))
    before = F.lag("_l").over(w)
    opens = F.col("_t").startswith("B-") | before.isNull() | (before != F.col("_l"))
    t = t.withColumn("_opens", F.when(F.col("_l").isNotNull(), opens.cast("int")).otherwise(0))
    t = t.withColumn("_g", F.sum("_opens").over(w)).filter("_l IS NOT NULL")
    return t.groupBy(key, "_g").agg(F.min("_a").alias("start_pos"), F.max("_b").alias("end_pos"), F.first("_l").alias("label")).drop("_g")


def literal_spans(raw: str | None) -> list[dict]:
    """A span list from JSON or a Python literal; what cannot be read is empty."""
    for read in (json.loads, ast.literal_eval):
        try:
            value = read(raw)
        except (ValueError, SyntaxError, TypeError):
            continue
        if isinstance(value, list):
            return [s for s in value if isinstance(s, dict)]
    return []


def claim(text: str, value: str, taken: list[tuple[int, int]]) -> tuple[int, int] | None:
    """First occurrence of a value that overlaps nothing taken; tried again without outer white space."""
    for v in dict.fromkeys((value, value.strip())):
        at = text.find(v) if v else -1
        while at >= 0:
            if all(at + len(v) <= a or at >= b for a, b in taken):
                return at, at + len(v)
            at = text.find(v, at + 1)
    return None


def claim_values(text: str, entities: list[tuple[str, str]]) -> list[tuple[int, int, str]]:
    """Spans of ``(value, label)`` in the order given, sorted by place."""
    taken: list[tuple[int, int]] = []
    out = []
    for value, label in entities:
        if hit := claim(text, value, taken):
            taken.append(hit)
            out.append((*hit, label))
    return sorted(out)


def claim_spans(df: DataFrame, key: str, text: str, entities: str) -> DataFrame:
    """``(key, start_pos, end_pos, label)`` for ``entities array<struct<value, label>>`` without offsets; repeats claim the next place."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *s) for k, t, es in zip(pdf["k"], pdf["t"], pdf["e"]) if t is not None and es is not None for s in claim_values(t, [(e["value"], e["label"]) for e in es if e["value"]])]
            out = pd.DataFrame(rows, columns=["k", "start_pos", "end_pos", "label"])
            yield out.astype({"label": object, "start_pos": "int32", "end_pos": "int32"})

    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(entities).alias("e"))
    return src.mapInPandas(run, f"k {key_type}, start_pos int, end_pos int, label string").withColumnRenamed("k", key)


def vote_words(votes: DataFrame, word: list[str]) -> DataFrame:
    """``(word, label, score)`` of sub-word rows ``(ix, label, score)``: majority, then the first that is not O, then O."""
    base = F.regexp_replace("label", "^[BI]-", "")
    by = votes.select(*word, "ix", base.alias("base"), "score")
    counted = by.groupBy(*word, "base").agg(F.count("*").alias("n"), F.min("ix").alias("first"), F.avg("score").alias("mean"))
    top = Window.partitionBy(*word)
    best = counted.withColumn("top", F.max("n").over(top)).filter("n = top").withColumn("tied", F.count("*").over(top))
    order = Window.partitionBy(*word).orderBy(F.when((F.col("tied") > 1) & (F.col("base") == "O"), 1).otherwise(0), "first")
    return best.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select(*word, F.col("base").alias("label"), F.round("mean", 6).alias("score"))
