"""Tolerant reading of generated JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRICT = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


def outer_object(text: Column) -> Column:
    """From the first brace to the last one."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def _field(text: Column, schema: str, name: str) -> Column:
    whole = F.from_json(F.trim(text), schema, _STRICT)[name]
    return F.coalesce(whole, F.from_json(outer_object(text), schema, _STRICT)[name])


def queries(text: Column) -> Column:
    """``array<struct<style, query>>`` of a generation response, or null."""
    return _field(text, "queries array<struct<style:string,query:string>>", "queries")


def query(text: Column) -> Column:
    """The query of a multi-hop response; blank is a refusal and null."""
    q = F.trim(_field(text, "query string", "query"))
    return F.nullif(q, F.lit(""))


def judge_score(text: Column) -> Column:
    """A whole number from 1 to 5; anything else is null."""
    s = _field(text, "score int", "score")
    return F.when(s.between(1, 5), s)


def spans(raw: Column) -> Column:
    """Span list from JSON or a Python literal; what cannot be read is empty."""
    schema = "array<struct<start:int,end:int,label:string>>"
    usual = F.from_json(raw, schema)
    literal = F.from_json(F.regexp_replace(raw, r":\s*None\b", ": null"), schema)
    return F.coalesce(usual, literal, F.expr("CAST(array() AS array<struct<start:int,end:int,label:string>>)"))
