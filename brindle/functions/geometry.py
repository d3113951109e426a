"""Boxes and points: conversion, quantisation, text form, overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BINS = 1000
NOTHING = "No objects detected."


def xyxy(box: Column) -> Column:
    """``[x, y, w, h]`` as corners."""
    return F.array(box[0], box[1], box[0] + box[2], box[1] + box[3])


def xywh(box: Column) -> Column:
    """Corners as ``[x, y, w, h]``."""
    return F.array(box[0], box[1], box[2] - box[0], box[3] - box[1])


def _unit(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def unit_box(box: Column, width: Column, height: Column) -> Column:
    """Pixel ``[x, y, w, h]`` as corners in [0, 1]; null if nothing is left."""
    b = xyxy(box)
    out = F.array(_unit(b[0] / width), _unit(b[1] / height), _unit(b[2] / width), _unit(b[3] / height))
    return F.when((out[2] > out[0]) & (out[3] > out[1]), out)


def centre(box: Column) -> Column:
    """Centre point of corners."""
    return F.array((box[0] + box[2]) / 2, (box[1] + box[3]) / 2)


def quantize(v: Column, bins: int = BINS) -> Column:
    """[0, 1] to 0 .. bins - 1, half to even, clamped."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.bround(v * (bins - 1)).cast("int")))


def dequantize(t: Column, bins: int = BINS) -> Column:
    """Bin number to [0, 1], clamped."""
    return _unit(t / F.lit(float(bins - 1)))


def serialize(label: Column, coords: Column, bins: int = BINS) -> Column:
    """``label<box> a, b, c, d </box>``."""
    numbers = F.array_join(F.transform(coords, lambda v: quantize(v, bins).cast("string")), ", ")
    return F.concat(label, F.lit("<box> "), numbers, F.lit(" </box>"))


def parse(text: Column, bins: int = BINS) -> Column:
    """``array<struct<label, coords>>`` of generated text: four numbers are a box, two a point, others are skipped."""
    found = F.regexp_extract_all(text, F.lit(r"([^<>\n]*)<box>([^<]*)</box>"), F.lit(0))

    def one(m: Column) -> Column:
        label = F.regexp_replace(F.regexp_replace(F.regexp_extract(m, r"^([^<]*)<box>", 1), r"^[\s*-]+", ""), r"\s+$", "")
        numbers = F.regexp_extract_all(F.regexp_extract(m, r"<box>([^<]*)</box>", 1), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
        return F.struct(label.alias("label"), F.transform(numbers, lambda v: F.round(dequantize(v.cast("double"), bins), 6)).alias("coords"))

    return F.filter(F.transform(found, one), lambda o: F.size(o["coords"]).isin(2, 4))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of corners; 0 without overlap or area."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def point_in_box(p: Column, b: Column) -> Column:
    """Whether a point lies in a closed box."""
    return p[0].between(b[0], b[2]) & p[1].between(b[1], b[3])


def point_score(p: Column, q: Column, radius: float = 0.05) -> Column:
    """``1 - d / r`` within the radius, else 0."""
    d = F.sqrt((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2)
    return F.when(d <= radius, 1 - d / radius).otherwise(F.lit(0.0))


def pair_score(pred: Column, gold: Column, task: str, radius: float = 0.05) -> Column:
    """Agreement of two objects ``struct<box, point>`` (either may be null): IoU for ``box``; for ``point`` 1 inside the gold's box, else by distance.

    Null where they cannot be compared.
    """
    if task == "box":
        return F.when(pred["box"].isNotNull() & gold["box"].isNotNull(), iou(pred["box"], gold["box"]))
    inside = point_in_box(pred["point"], gold["box"]).cast("double")
    near = F.when(gold["point"].isNotNull(), point_score(pred["point"], gold["point"], radius))
    return F.when(pred["point"].isNotNull(), F.when(gold["box"].isNotNull(), inside).otherwise(near))


def coordinates(box: Column, point: Column, task: str) -> Column:
    """What a task serialises: the box, or the point, which falls back to the centre of the box."""
    return box if task == "box" else F.coalesce(point, centre(box))


def denormalize(coords: Column, width: Column, height: Column) -> Column:
    """Unit coordinates as pixels: even places by width, odd ones by height."""
    return F.transform(coords, lambda v, i: v * F.when(i % 2 == 0, width).otherwise(height))


def violations(box: Column, label: Column) -> Column:
    """Names of the rules that a unit box breaks."""
    err = lambda bad, name: F.when(F.coalesce(bad, F.lit(True)), F.lit(name))
    return F.array_compact(
        F.array(
            err(F.size(box) != 4, "box has 4 numbers"),
            err(F.exists(box, lambda v: (v < 0) | (v > 1)), "box within [0, 1]"),
            err((F.get(box, F.lit(2)) <= F.get(box, F.lit(0))) | (F.get(box, F.lit(3)) <= F.get(box, F.lit(1))), "box has extent"),
            err(F.coalesce(F.trim(label), F.lit("")) == "", "label"),
        )
    )
