"""Documents to training pairs, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import text as tx
from brindle.operators import chunking, generate, pairs


def pair_pipeline(docs: DataFrame, doc_id: str, text: str, cfg: pairs.PairConfig | None = None) -> DataFrame:
    """``(row_id, anchor, positive, doc_id, split)``: chunks, offline queries, heuristics, dedup and a split by document."""
    cfg = cfg or pairs.PairConfig(judge=False)
    chunks = chunking.chunk_documents(docs, doc_id, text)
    asked = chunks.select("doc_id", "chunk_id", F.col("text").alias("positive"), F.posexplode(generate.stub_queries(F.col("text"))).alias("ordinal", "q"))
    raw = asked.select(F.concat_ws("::", "chunk_id", "q.style", F.col("ordinal").cast("string")).alias("row_id"), F.col("q.query").alias("anchor"), "positive", "doc_id")
    kept = pairs.filter_pairs(raw, "row_id", "anchor", "positive", cfg)
    return kept.select("row_id", "anchor", "positive", "doc_id", tx.split_of(F.col("doc_id"), cfg.train, cfg.dev, cfg.seed).alias("split"))
