"""Span lists: contracts, folds, clipping, alignment with tokens."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = "struct<start:int,end:int,label:string>"
EMPTY = f"CAST(array() AS array<{SPAN}>)"


def in_range(spans: Column, text: Column, labels: list[str] | None = None) -> Column:
    """Spans with ``0 <= start < end <= length`` and, if given, an allowed label; null is empty."""
    ok = F.filter(spans, lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.char_length(text)))
    if labels is not None:
        ok = F.filter(ok, lambda s: s["label"].isin(labels))
    return F.coalesce(ok, F.expr(EMPTY))


def violations(spans: Column, text: Column) -> Column:
    """Array of ``struct(span_ix, error)`` of every broken rule of every span."""

    def of(s: Column, i: Column) -> Column:
        err = lambda bad, name: F.when(F.coalesce(bad, F.lit(True)), F.struct(i.alias("span_ix"), F.lit(name).alias("error")))
        return F.array_compact(
            F.array(
                err(s["start"] < 0, "start >= 0"),
                err(s["end"] <= s["start"], "end > start"),
                err(s["end"] > F.char_length(text), "end <= len(text)"),
                err(F.coalesce(F.trim(s["label"]), F.lit("")) == "", "label"),
            )
        )

    return F.coalesce(F.flatten(F.transform(spans, of)), F.expr("CAST(array() AS array<struct<span_ix:int,error:string>>)"))


def in_order(spans: Column) -> Column:
    """Spans by start, then end, then label."""
    key = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))
    return F.array_sort(key)


def drop_overlaps(spans: Column) -> Column:
    """Of overlapping spans, in order of start, the earliest alone."""

    def step(kept: Column, s: Column) -> Column:
        free = (F.size(kept) == 0) | (F.element_at(kept, -1)["end"] <= s["start"])
        return F.when(free, F.concat(kept, F.array(s))).otherwise(kept)

    return F.aggregate(in_order(spans), F.expr(EMPTY), step)


def merge_touching(spans: Column) -> Column:
    """Spans merged into the one before them where labels are equal and they touch; only the last output counts."""
    by = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("far"), s["label"].alias("label")))

    def step(out: Column, s: Column) -> Column:
        last, end = F.element_at(out, -1), -s["far"]
        joins = (F.size(out) > 0) & (last["label"] == s["label"]) & (s["start"] <= last["end"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"), last["label"].alias("label"))
        new = F.struct(s["start"].alias("start"), end.alias("end"), s["label"].alias("label"))
        return F.when(joins, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(longer))).otherwise(F.concat(out, F.array(new)))

    return F.aggregate(F.array_sort(by), F.expr(EMPTY), step)


def clip(spans: Column, start: Column, end: Column) -> Column:
    """Spans overlapping ``[start, end)`` cut to it and counted from ``start``."""
    over = F.filter(spans, lambda s: (s["end"] > start) & (s["start"] < end))
    return F.transform(over, lambda s: F.struct((F.greatest(s["start"], start) - start).alias("start"), (F.least(s["end"], end) - start).alias("end"), s["label"].alias("label")))


def shift(spans: Column, by: Column) -> Column:
    """Spans moved by an offset."""
    return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["label"].alias("label")))


IGNORED = "-100"


@F.arrow_udf(T.ArrayType(T.StringType()))
def _aligned(starts: pa.Array, ends: pa.Array, specials: pa.Array, spans: pa.Array, everywhere: pa.Array) -> pa.Array:
    out = []
    for a, b, special, marks, all_tokens in zip(*(c.to_pylist() for c in (starts, ends, specials, spans, everywhere))):
        if a is None:
            out.append(None)
            continue
        marks = sorted((m for m in marks or () if m and m["label"] is not None and m["start"] is not None and m["end"] is not None), key=lambda m: m["start"])
        tags, before, first, behind = [], None, 0, 0
        for i, (start, end) in enumerate(zip(a, b)):
            if special and special[i]:
                tags.append(IGNORED)
                before = None
                continue
            first, behind = (0 if start < behind else first), start
            while first < len(marks) and marks[first]["end"] <= start:
                first += 1  # tokens come in order as a rule: what ends before this one ends before the next
            at = first
            while at < len(marks) and marks[at]["end"] <= start:
                at += 1
            over = at if at < len(marks) and marks[at]["start"] < end else None
            if over is None:
                tags.append("O")
            elif over != before:
                tags.append("B-" + marks[over]["label"])
            else:
                tags.append("I-" + marks[over]["label"] if all_tokens else IGNORED)
            before = over
        out.append(tags)
    return pa.array(out, pa.list_(pa.string()))


def bio_tags(tokens: Column, spans: Column, special: Column | None = None, all_tokens: bool = True) -> Column:
    """B-, I- or O for every token, by the first span in order of start that overlaps it.

    I only where the token before it has the same span; with ``all_tokens`` off
    such a token is ``-100`` instead, as is one that ``special`` (an array of 0
    and 1) names, and no span goes on behind that.  Spans without a label count
    as none; null tokens give null.
    """
    starts, ends = F.transform(tokens, lambda t: t["start"]), F.transform(tokens, lambda t: t["end"])
    return _aligned(starts, ends, special if special is not None else F.lit(None).cast("array<int>"), spans, F.lit(all_tokens))


def known_labels(spans: Column, labels: list[str]) -> Column:
    """Spans of the labels given; others are left out, so their tokens are O."""
    return F.filter(spans, lambda s: s["label"].isin(labels))


def tag_ids(tags: Column, vocabulary: list[str]) -> Column:
    """Places of tags in a vocabulary, -100 for what is ignored; an unknown tag is null."""
    ids = F.create_map(*[x for i, tag in enumerate(vocabulary) for x in (F.lit(tag), F.lit(i))], F.lit(IGNORED), F.lit(-100))
    return F.transform(tags, lambda t: F.try_element_at(ids, t))
