"""The pair pipeline: verbatim runs, heuristics, dedup, judging, multi-hop windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text as tx
from brindle.operators import rows


@dataclass(frozen=True)
class PairConfig:
    """Thresholds of the pair pipeline; split fractions must add up to 1."""

    min_words: int = 3
    max_words: int = 30
    max_verbatim: int = 6
    dedup: bool = True
    dedup_scope: str = "anchor"
    judge: bool = True
    min_score: int = 4
    multi_hop_k: int = 2
    multi_hop_share: float = 0.2
    multi_hop_stride: int = 1
    train: float = 0.9
    dev: float = 0.05
    test: float = 0.05
    seed: int = 42

    def __post_init__(self):
        if abs(self.train + self.dev + self.test - 1) > 1e-6:
            raise ValueError("train, dev and test must add up to 1")
        if self.dedup_scope not in ("anchor", "anchor_positive"):
            raise ValueError("dedup_scope is anchor or anchor_positive")


def verbatim_runs(df: DataFrame, key: str, query: str, passage: str) -> DataFrame:
    """``(key, run)``: the longest run of the query's words that the passage repeats; 0 without any, or where one is null."""
    return df.select(key, tx.longest_run(F.col(query), F.col(passage)).alias("run"))


def heuristic_keep(df: DataFrame, query: str, passage: str, cfg: PairConfig) -> DataFrame:
    """Rows whose query has an allowed number of words and copies no long run; cheap tests come first."""
    n = F.size(tx.word_tokens(F.col(query)))
    ready = df.filter(F.col(query).rlike(r"\S") & F.col(passage).rlike(r"\S") & n.between(cfg.min_words, cfg.max_words))
    return ready.filter(tx.longest_run(F.col(query), F.col(passage)) <= cfg.max_verbatim)


def dedup(df: DataFrame, anchor: str, order: Column, scope: list[str] | None = None) -> DataFrame:
    """The first row of each anchor, case and outer white space aside, by an explicit order."""
    keys = [F.lower(tx.strip(F.col(c))) for c in (scope or [anchor])]
    return rows.first_by(df, keys, [order])


def judged(df: DataFrame, stored: DataFrame, fresh: DataFrame, key: str, min_score: int) -> DataFrame:
    """Rows whose score, fresh before stored, is at least ``min_score``; no score drops the row."""
    f = fresh.groupBy(key).agg(F.max("score").alias("_f"))
    s = stored.groupBy(key).agg(F.max("score").alias("_s"))
    scored = df.join(f, key, "left").join(s, key, "left").withColumn("judge_score", F.coalesce("_f", "_s"))
    return scored.filter(F.col("judge_score") >= min_score).drop("_f", "_s")


def filter_pairs(df: DataFrame, key: str, query: str, passage: str, cfg: PairConfig, score: str | None = None) -> DataFrame:
    """Heuristics, then dedup, then judge."""
    if cfg.judge and score is None:
        raise ValueError("the judge is on but there is no score column")
    kept = heuristic_keep(df, query, passage, cfg)
    if cfg.dedup:
        kept = dedup(kept, query, F.col(key), [query, passage] if cfg.dedup_scope == "anchor_positive" else None)
    return kept.filter(F.col(score) >= cfg.min_score) if cfg.judge else kept


def multi_hop_windows(chunks: DataFrame, doc: str, ix: str, chunk_id: str, k: int = 2, stride: int = 1) -> DataFrame:
    """``(group_id, doc, chunk_ids)``: windows of ``k`` chunks that follow each other in a document."""
    w = Window.partitionBy(doc).orderBy(ix)
    ahead = w.rowsBetween(0, k - 1)
    rowed = chunks.select(doc, ix, F.row_number().over(w).alias("_rn"), F.collect_list(chunk_id).over(ahead).alias("chunk_ids"))
    full = rowed.filter((F.size("chunk_ids") == k) & ((F.col("_rn") - 1) % stride == 0))
    return full.select(F.concat_ws("::g", F.col(doc), (F.col("_rn") - 1).cast("string")).alias("group_id"), F.col(doc).alias("doc_id"), "chunk_ids")


def group_count(single: Column, share: float, k: int) -> Column:
    """Groups needed for ``share`` of all rows to be multi-hop, half to even."""
    return F.bround(F.lit(share / (1 - share)) * single / k).cast("bigint")


def sample_by_hash(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, the first in hash order: a repeatable uniform sample."""
    return df.orderBy(rows.hash_order(F.col(key), seed), key).limit(n)
