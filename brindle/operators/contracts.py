"""Dataset contracts: shapes by schema alone, violations over all rows, targets of training rows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_label_column(field: T.StructField) -> bool:
    """A list of floating numbers is a list of scores."""
    return isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, (T.FloatType, T.DoubleType))


def text_columns(schema: T.StructType) -> list[str]:
    """All columns, without a list of scores at the end."""
    names = schema.fieldNames()
    return names[:-1] if names and is_label_column(schema.fields[-1]) else names


def require_strings(schema: T.StructType, columns: list[str]) -> None:
    """Raise unless all columns are strings."""
    for c in columns:
        if not isinstance(schema[c].dataType, T.StringType):
            raise ValueError(f"column {c} must hold strings, not {schema[c].dataType.simpleString()}")


def infer_shape(schema: T.StructType) -> str:
    """pair, triplet, multi_negative or distill, from the columns' number and types; no job runs."""
    texts = text_columns(schema)
    require_strings(schema, texts)
    if len(texts) < len(schema.fields):
        if len(texts) < 3:
            raise ValueError("scores need an anchor and at least two candidates")
        return "distill"
    shapes = {2: "pair", 3: "triplet"}
    if len(texts) < 2:
        raise ValueError("at least an anchor and a positive are needed")
    return shapes.get(len(texts), "multi_negative")


def check_splits(df: DataFrame, split: str = "split") -> str:
    """The shape of a dataset in one frame; a train split must be there."""
    if not df.filter(F.col(split) == "train").limit(1).count():
        raise ValueError("there is no train split")
    return infer_shape(T.StructType([f for f in df.schema.fields if f.name != split]))


def overlapping_spans(df: DataFrame, key: str, spans: str) -> DataFrame:
    """``(key, span_ix)`` of spans that begin before the one before them ends: all rows, not the first alone."""
    s = df.select(key, F.posexplode(F.arrays_zip(F.col(spans).alias("a"), F.slice(spans, 2, F.greatest(F.size(spans), F.lit(1))).alias("b"))).alias("ix", "z"))
    return s.filter(F.col("z.b").isNotNull() & (F.col("z.b.start") < F.col("z.a.end"))).select(key, (F.col("ix") + 1).alias("span_ix"))


def coco_violations(objects: Column) -> Column:
    """Rules that ``struct<bbox, category_id, area, iscrowd>`` of parallel arrays breaks."""
    n = F.size(objects["bbox"])
    err = lambda bad, name: F.when(F.coalesce(bad, F.lit(True)), F.lit(name))
    return F.array_compact(
        F.array(
            err((F.size(objects["category_id"]) != n) | (F.size(objects["area"]) != n) | (F.size(objects["iscrowd"]) != n), "lengths differ"),
            err(F.exists(objects["bbox"], lambda b: F.size(b) != 4), "bbox has 4 numbers"),
            err(F.exists(objects["bbox"], lambda b: (F.get(b, F.lit(2)) <= 0) | (F.get(b, F.lit(3)) <= 0)), "width and height > 0"),
            err(F.exists(objects["bbox"], lambda b: (F.get(b, F.lit(0)) < 0) | (F.get(b, F.lit(1)) < 0)), "x and y >= 0"),
            err(F.exists(objects["category_id"], lambda c: c < 0), "category_id >= 0"),
        )
    )


def coco_objects(bbox: Column, category: Column, area: Column, crowd: Column) -> Column:
    """One list of objects from parallel arrays; a missing area is width times height, a missing flag 0."""
    rows = F.arrays_zip(bbox.alias("bbox"), category.alias("category_id"), F.coalesce(area, F.transform(bbox, lambda b: b[2] * b[3])).alias("area"), F.coalesce(crowd, F.transform(bbox, lambda b: F.lit(0))).alias("iscrowd"))
    return F.coalesce(rows, F.expr("CAST(array() AS array<struct<bbox:array<double>,category_id:bigint,area:double,iscrowd:int>>)"))


def scored_above(detections: Column, threshold: float) -> Column:
    """Detections of at least the score; null is empty."""
    return F.coalesce(F.filter(detections, lambda d: d["score"] >= threshold), F.slice(detections, 1, 0))


def target(response: Column, serialized: Column, empty: str = "No objects detected.") -> Column:
    """What a model is to answer: a response goes before objects, no objects are said in words."""
    objects = F.when(F.coalesce(serialized, F.lit("")) == "", F.lit(empty)).otherwise(serialized)
    return F.coalesce(response, objects)


def json_field(text: Column, path: str) -> Column:
    """Part of a JSON text, as compact JSON text; key order stays."""
    return F.get_json_object(text, path)


def longest_first(df: DataFrame, text: str, partitions: int | None = None) -> DataFrame:
    """Rows of a partition by falling length, so that batches pad little; ids restore the order."""
    spread = df.repartition(partitions) if partitions else df
    return spread.sortWithinPartitions(F.desc(F.char_length(text)))


def timed(run: Callable[[], DataFrame], repeats: int = 3) -> dict[str, float]:
    """Mean and least seconds of writing a frame to nowhere, after one run that does not count."""
    took = []
    for _ in range(repeats + 1):
        began = time.perf_counter()
        run().write.mode("overwrite").format("noop").save()
        took.append(time.perf_counter() - began)
    return {"mean": sum(took[1:]) / repeats, "min": min(took[1:])}
