"""The pN_ queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import groups, leakage, overlap, pairs, personal, pieces, reading, tokenize, truncation
from brindle.plans.durable import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every annotated text as pieces with rebased spans."""
    return pieces.split_oversized(table(spark, d, "annotated"), "ann_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose text had to be cut: those of which the operator makes a second piece."""
    cut = pieces.split_oversized(table(spark, d, "annotated", "ann_id", "text", "spans"), "ann_id", oversized_only=True)
    return cut.filter((F.col("n_pieces") > 1) & (F.col("piece_ix") == 1)).select("ann_id")


RESPONSE_COLUMNS = ("resp_id", "stage", "prompt", "text", "completion_tokens", "error", "source")


def _answered(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "llm_responses", *RESPONSE_COLUMNS).filter(F.col("error").isNull())


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Responses that were cut before their end."""
    return truncation.truncated(_answered(spark, d), "resp_id").select(F.col("key").alias("resp_id"))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """The share of responses that each source cuts."""
    df = _answered(spark, d).filter(F.col("text").isNotNull())
    return truncation.rates(df, truncation.truncated(df, "resp_id"))


def p2_limits(spark: SparkSession, d: str) -> DataFrame:
    """The lengths at which each source cuts."""
    src = truncation.prepared(_answered(spark, d), "resp_id", "text", "source", None, "completion_tokens")
    return truncation.cut_lengths(src).select("source", "unit", "length", "n", "at_risk", F.round("log_p", 3).alias("log_p"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective pairs of both tables with their defect."""
    raw = table(spark, d, "raw_pairs").select(
        F.lit("raw_pairs").alias("tbl"), F.col("pair_id").alias("key"), F.col("anchor").alias("question"), F.col("positive").alias("answer"), F.lit(None).cast("int").alias("tokens"), "source"
    )
    said = _answered(spark, d).filter(F.col("stage") == "answer")
    said = said.select(F.lit("llm_responses").alias("tbl"), F.col("resp_id").alias("key"), F.col("prompt").alias("question"), F.col("text").alias("answer"), F.col("completion_tokens").alias("tokens"), "source")
    return pairs.defects(raw.unionByName(said)).select("tbl", F.col("key").alias("row_key"), "defect")


def _annotated_records(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "annotated", "ann_id", "split", "text")
    return df.select(F.col("ann_id").alias("key"), overlap.is_train(F.col("split")).alias("train"), F.array("text").alias("texts"))


def _pair_records(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "raw_pairs", "pair_id", "split", "anchor", "positive")
    return df.select(F.col("pair_id").alias("key"), overlap.is_train(F.col("split")).alias("train"), F.array("anchor", "positive").alias("texts"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records across the splits that are the same or almost the same."""
    a = overlap.cross_split(_annotated_records(spark, d)).select(F.lit("annotated").alias("tbl"), "id_a", "id_b")
    return a.unionByName(overlap.cross_split(_pair_records(spark, d)).select(F.lit("raw_pairs").alias("tbl"), "id_a", "id_b"))


def p4_leaks(spark: SparkSession, d: str) -> DataFrame:
    """How many held-out records of each split and source also stand in train."""
    a = overlap.leak_report(table(spark, d, "annotated", "ann_id", "split", "source"), overlap.cross_split(_annotated_records(spark, d)), "ann_id", "split", "source")
    b = overlap.leak_report(table(spark, d, "raw_pairs", "pair_id", "split", "source"), overlap.cross_split(_pair_records(spark, d)), "pair_id", "split", "source")
    return a.withColumn("tbl", F.lit("annotated")).unionByName(b.withColumn("tbl", F.lit("raw_pairs")))


FILING_COLUMNS = ("rec_id", "id", "text", "author", "entity")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every filing that is not the smallest of its group, with the smallest."""
    found = groups.related_groups(table(spark, d, "filings", *FILING_COLUMNS))
    return found.filter("lead < rec").select(F.col("lead").alias("lead_id"), F.col("rec").alias("rec_id"))


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of every filing; related filings share one."""
    dealt = groups.assign_splits(table(spark, d, "filings", *FILING_COLUMNS))
    return dealt.select(F.col("rec").alias("rec_id"), F.col("lead").alias("lead_id"), "split")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every mention of personal data in the annotated texts."""
    df = table(spark, d, "annotated", "ann_id", "text", "spans")
    return personal.find_personal(df, "ann_id", personal.fit_on(df, "ann_id"))


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every annotated text with placeholders in place of personal data."""
    df = table(spark, d, "annotated", "ann_id", "text", "spans")
    return personal.redacted(df, "ann_id", personal.fit_on(df, "ann_id"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokenize.encode_corpus(table(spark, d, "documents", "doc_id", "text"), "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold evaluation texts, with the items."""
    return leakage.find_leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Reading level of every document of prose."""
    return reading.reading_levels(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "level_ratings", "doc_id", "level"))


def queries() -> dict[str, Query]:
    """All queries of the subpackage by name."""
    return {
        "p1_found": p1_found,
        "p1_pieces": p1_pieces,
        "p2_found": p2_found,
        "p2_rates": p2_rates,
        "p2_limits": p2_limits,
        "p3_found": p3_found,
        "p4_found": p4_found,
        "p4_leaks": p4_leaks,
        "p5_found": p5_found,
        "p5_splits": p5_splits,
        "p6_found": p6_found,
        "p6_redacted": p6_redacted,
        "p7_ids": p7_ids,
        "p8_found": p8_found,
        "p9_found": p9_found,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express in reasonable time."""
    return {"p1_found": "SELECT ann_id FROM annotated WHERE length(text) > 2000"}
