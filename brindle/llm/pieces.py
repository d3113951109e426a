"""Splitting oversized texts at natural boundaries (problem 1).

The text is tiled into segments by ONE regular expression with bounded
quantifiers.  Its alternatives are ordered by the strength of the boundary they
end at (end of text, paragraph, sentence, line, clause, word, grapheme, code
point) and each may consume up to ``limit - overlap`` code points, so the
strongest boundary in reach wins and a text without any boundary still comes
out in full pieces.  A piece is a segment with the tail of the segment before
it in front, so consecutive pieces share about ``overlap`` code points.
Everything is a Column expression: one scan, no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 2000
OVERLAP = 200


def segment_pattern(body: int, reach: float = 0.5) -> str:
    """The bounded-quantifier pattern; a boundary counts in the last ``1 - reach`` of ``body``."""
    low = max(1, int(body * reach))
    ends = [
        (r"\r?\n[ \t]{0,4}\r?\n", 8),  # paragraph
        (r"[.!?…。！？][\"'”’»)\]]{0,2}\s", 4),  # sentence
        (r"\n", 1),  # line
        (r"[,;:、]\s", 2),  # clause
        (r"\s", 1),  # word
    ]
    parts = [rf".{{1,{body}}}\z"]
    parts += [rf".{{{min(low, body - room)},{body - room}}}{end}" for end, room in ends if body - room >= 1]
    parts += [rf".{{{low},{body}}}(?<!‍)(?![\p{{M}}‍️])", rf".{{1,{body}}}"]
    return "(?s)" + "|".join(parts)


def segments(text: Column, body: int) -> Column:
    """Array of strings whose concatenation is ``text``; each has at most ``body`` code points."""
    return F.regexp_extract_all(text, F.lit(segment_pattern(body)), F.lit(0))


def lookback(segment: Column, overlap: int) -> Column:
    """The last ``overlap`` code points of ``segment``, from a word start on if one is near."""
    tail = F.substring(segment, -overlap, overlap)
    tail = F.when(F.char_length(segment) <= overlap, segment).otherwise(tail)
    slack = max(1, overlap // 5)
    aligned = F.regexp_extract(tail, rf"(?s)\A.{{0,{slack}}}?\s(?=\S)(.*)\z", 1)
    return F.when(F.char_length(aligned) > 0, aligned).otherwise(tail)


def piece_structs(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """Array of ``struct(start, end, text)``, offsets in code points, half-open."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.char_length(text).alias("end"), text.alias("text")))
    seg = segments(text, limit - overlap)

    def step(acc: Column, s: Column) -> Column:
        head = lookback(acc["prev"], overlap) if overlap else F.lit("")
        head = F.when(acc["at"] == 0, F.lit("")).otherwise(head)
        piece = F.struct(
            (acc["at"] - F.char_length(head)).alias("start"),
            (acc["at"] + F.char_length(s)).alias("end"),
            F.concat(head, s).alias("text"),
        )
        return F.struct(
            (acc["at"] + F.char_length(s)).alias("at"),
            s.alias("prev"),
            F.concat(acc["out"], F.array(piece)).alias("out"),
        )

    start = F.struct(
        F.lit(0).alias("at"),
        F.lit("").alias("prev"),
        F.expr("CAST(array() AS array<struct<start:int,end:int,text:string>>)").alias("out"),
    )
    long = F.aggregate(seg, start, step, lambda acc: acc["out"])
    return F.when(F.char_length(text) > limit, long).when(text.isNotNull(), whole)


def rebase_spans(spans: Column, start: Column, end: Column) -> Column:
    """Spans that overlap ``[start, end)``, clipped to it and counted from ``start``.

    Null stays null; spans without extent or wholly outside the piece drop out.
    """
    inside = F.filter(
        spans,
        lambda s: (s["start"] < s["end"]) & (s["start"] < end) & (s["end"] > start) & (s["end"] > 0),
    )
    return F.transform(
        inside,
        lambda s: F.struct(
            (F.greatest(s["start"], start) - start).cast("int").alias("start"),
            (F.least(s["end"], end) - start).cast("int").alias("end"),
            s["label"].alias("label"),
        ),
    )


def split_oversized(
    df: DataFrame,
    id_col: str,
    text_col: str = "text",
    spans_col: str | None = "spans",
    limit: int = LIMIT,
    overlap: int = OVERLAP,
    oversized_only: bool = False,
) -> DataFrame:
    """One row per piece: id, ``piece_ix, n_pieces, piece_start, piece_end, text`` and ``spans``.

    Defined results: a null text gives one row with null text and offsets; an
    empty or short text one piece equal to the text; repeated rows are each cut
    on their own; an empty table gives no rows; other columns of the input,
    whatever their names, neither matter nor come out.  ``oversized_only`` keeps
    the pieces of texts above ``limit`` alone.
    """
    src = df.select(
        F.col(id_col).alias("_id"),
        F.col(text_col).alias("_t"),
        *([F.col(spans_col).alias("_s")] if spans_col else []),
    )
    if oversized_only:
        src = src.filter(F.char_length("_t") > limit)
    out = src.withColumn("_p", piece_structs(F.col("_t"), limit, overlap))
    out = out.select(
        "_id",
        F.size("_p").alias("_n"),
        *(["_s"] if spans_col else []),
        F.posexplode_outer("_p").alias("_ix", "_piece"),
    )
    cols = [
        F.col("_id").alias(id_col),
        F.coalesce(F.col("_ix"), F.lit(0)).alias("piece_ix"),
        F.greatest(F.col("_n"), F.lit(1)).alias("n_pieces"),
        F.col("_piece.start").alias("piece_start"),
        F.col("_piece.end").alias("piece_end"),
        F.col("_piece.text").alias("text"),
    ]
    if spans_col:
        cols.append(
            F.when(F.col("_piece").isNull(), F.col("_s"))
            .otherwise(rebase_spans(F.col("_s"), F.col("_piece.start"), F.col("_piece.end")))
            .alias("spans")
        )
    return out.select(*cols)
