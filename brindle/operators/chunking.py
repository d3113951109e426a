"""Overlapping token windows, without and with span lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import spans as sp
from brindle.functions import text as tx

SIZE, OVERLAP, LEAST = 256, 32, 64
NER_SIZE, NER_OVERLAP = 384, 64


def chunk_documents(df: DataFrame, doc_id: str, text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """``(doc_id, chunk_ix, chunk_id, text, start_token, end_token)``; blank texts give no rows, a null id is an error.

    A window of ``size`` words begins every ``size - overlap`` words until the
    end is reached; one of fewer than ``least`` words is dropped unless it is
    the first.  Its text is the text itself from the window's first word to what
    follows its last one up to the next white space, so case and punctuation
    stay.  In-row: no shuffle.
    """
    key = F.col(doc_id).cast("string")
    checked = F.when(key.isNull(), F.raise_error(F.lit(f"{doc_id} must not be null"))).otherwise(key)
    tokens = df.select(checked.alias("doc_id"), F.col(text).alias("_x"), tx.tokens_with_offsets(F.col(text)).alias("_t"))
    n = F.size("_t")
    k = F.explode(tx.window_starts(n, size, overlap, least)).alias("chunk_ix")
    windows = tokens.filter(n > 0).select("doc_id", "_x", "_t", k)
    start = F.col("chunk_ix") * (size - overlap)
    end = F.least(start + size, n)
    begin, last = F.element_at("_t", (start + 1).cast("int"))["start"], F.element_at("_t", end.cast("int"))["end"]
    tail = F.regexp_extract(F.substring("_x", last + 1, F.lit(8)), r"^[^\s\p{L}\p{N}_]*", 0)
    return windows.select(
        "doc_id",
        "chunk_ix",
        F.concat_ws("::", "doc_id", F.col("chunk_ix").cast("string")).alias("chunk_id"),
        F.concat(F.substring("_x", begin + 1, last - begin), tail).alias("text"),
        start.alias("start_token"),
        end.alias("end_token"),
    )


def span_chunks(df: DataFrame, key: str, text: str, spans: str, size: int = NER_SIZE, overlap: int = NER_OVERLAP) -> DataFrame:
    """``(key, chunk_ix, start_pos, end_pos, text, spans)``: word windows of a text with its spans clipped and rebased.

    A text of at most ``size`` words is one chunk of the whole text; a longer
    one is cut from a window's first word to the end of its last.
    """
    src = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"), sp.in_order(sp.in_range(F.col(spans), F.col(text))).alias("_s"))
    src = src.filter(F.col("_t").isNotNull()).withColumn("_w", tx.tokens_with_offsets(F.col("_t")))
    n = F.size("_w")
    cut = src.filter(n > 0).select("_k", "_t", "_s", "_w", F.explode(tx.window_starts(n, size, overlap)).alias("chunk_ix"))
    first = F.col("chunk_ix") * (size - overlap)
    last = F.least(first + size, n)
    whole = n <= size
    begin = F.when(whole, F.lit(0)).otherwise(F.element_at("_w", (first + 1).cast("int"))["start"])
    end = F.when(whole, F.char_length("_t")).otherwise(F.element_at("_w", last.cast("int"))["end"])
    placed = cut.withColumn("start_pos", begin).withColumn("end_pos", end)
    return placed.select(
        F.col("_k").alias(key),
        "chunk_ix",
        "start_pos",
        "end_pos",
        F.substring("_t", F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos")).alias("text"),
        sp.clip(F.col("_s"), F.col("start_pos"), F.col("end_pos")).alias("spans"),
    )


def rebase(chunks: DataFrame, key: str, spans: str, start: str) -> DataFrame:
    """``(key, spans)``: chunk-local spans moved back into their text, gathered and merged."""
    moved = chunks.select(key, F.explode(sp.shift(F.col(spans), F.col(start))).alias("s"))
    return moved.groupBy(key).agg(sp.merge_touching(F.collect_set("s")).alias("spans"))


def truncate_tokens(text: Column, most: int = 128) -> Column:
    """The first ``most`` words."""
    return F.slice(tx.word_tokens(text), 1, most)
