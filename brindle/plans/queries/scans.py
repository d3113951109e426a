"""Scans, filters, limits and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as tx
from brindle.operators import rows
from brindle.plans.durable import table
from brindle.plans.registry import query


@query("preview", "SELECT count(*) AS n_rows, 8 AS n_columns FROM documents")
def preview(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents")
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


@query("filter_lang", "SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('en', 'de')")
def filter_lang(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "lang", "n_chars").filter(F.col("lang").isin("en", "de"))


@query("filter_domain", "SELECT pair_id, source, style FROM raw_pairs WHERE language = 'en' AND source IN ('edgar_like', 'policy_pairs')")
def filter_domain(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "raw_pairs", "pair_id", "source", "style", "language")
    return df.filter((F.col("language") == "en") & F.col("source").isin("edgar_like", "policy_pairs")).drop("language")


@query(
    "corpus_lines",
    r"""SELECT doc_id, ix, line FROM (
          SELECT doc_id, unnest(range(len(parts))) AS ix, unnest(list_transform(parts, lambda p: regexp_replace(p, '^[ \t\r]+|[ \t\r]+$', '', 'g'))) AS line
          FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))
        WHERE line <> ''""",
)
def corpus_lines(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents", "doc_id", "text")
    lines = df.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ix", "raw"))
    return lines.select("doc_id", F.col("ix").cast("bigint").alias("ix"), F.regexp_replace("raw", r"^[ \t\r]+|[ \t\r]+$", "").alias("line")).filter("line <> ''")


@query(
    "split_limit",
    """SELECT ann_id, split FROM (SELECT ann_id, CASE WHEN lower(trim(split)) IN ('dev', 'valid', 'val') THEN 'validation' ELSE lower(trim(split)) END AS split,
         row_number() OVER (PARTITION BY CASE WHEN lower(trim(split)) IN ('dev', 'valid', 'val') THEN 'validation' ELSE lower(trim(split)) END ORDER BY ann_id) AS rn FROM annotated) WHERE rn <= 100""",
)
def split_limit(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "annotated", "ann_id", "split").withColumn("split", tx.split_alias(F.col("split")))
    return rows.head_per(df, ["split"], [F.col("ann_id")], 100)


@query(
    "combine_sources",
    """SELECT source, language, count(*) AS n, sum(n_spans)::BIGINT AS n_spans FROM (
         SELECT coalesce(source, 'annotated') AS source, language, coalesce(len(spans), 0) AS n_spans FROM annotated
         UNION ALL SELECT 'documents', lang, 0 FROM documents) GROUP BY ALL""",
)
def combine_sources(spark: SparkSession, d: str) -> DataFrame:
    a = rows.canonical(table(spark, d, "annotated"), "text", "spans", "language", F.coalesce("source", F.lit("annotated")))
    b = rows.canonical(table(spark, d, "documents"), "text", None, "lang", F.lit("documents"))
    return rows.combine([a, b]).groupBy("source", "language").agg(F.count("*").alias("n"), F.sum(F.size("spans")).cast("bigint").alias("n_spans"))


@query(
    "carve_validation",
    """WITH t AS (SELECT pair_id, source, sha256('42::' || pair_id) AS h FROM raw_pairs WHERE split = 'train'),
         s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, pair_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM t)
       SELECT pair_id, source, CASE WHEN n > 2 * greatest(200, round_even(n * 0.05, 0)) AND rn <= greatest(200, round_even(n * 0.05, 0)) THEN 'validation' ELSE 'train' END AS part FROM s""",
)
def carve_validation(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "raw_pairs", "pair_id", "source", "split").filter("split = 'train'").drop("split")
    return rows.carve(df, "pair_id", ["source"])


@query(
    "hash_split",
    """SELECT doc_id, CASE WHEN u < 0.9::DOUBLE THEN 'train' WHEN u < 0.95::DOUBLE THEN 'dev' ELSE 'test' END AS split
       FROM (SELECT DISTINCT doc_id, ('0x' || substr(sha256('42::' || doc_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616::DOUBLE AS u FROM raw_pairs WHERE doc_id IS NOT NULL)""",
)
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "raw_pairs", "doc_id").filter("doc_id IS NOT NULL").distinct()
    return docs.withColumn("split", tx.split_of(F.col("doc_id")))


@query(
    "split_names",
    """SELECT CASE WHEN lower(trim(split)) IN ('dev', 'valid', 'val') THEN 'validation' ELSE lower(trim(split)) END AS split, count(*) AS n FROM annotated GROUP BY 1""",
)
def split_names(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "annotated", "split")
    return df.groupBy(tx.split_alias(F.col("split")).alias("split")).agg(F.count("*").alias("n"))


@query("stamp_source", "SELECT pair_id, anchor, 'raw_pairs' AS source FROM raw_pairs")
def stamp_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_pairs", "pair_id", "anchor").withColumn("source", F.lit("raw_pairs"))


@query(
    "fallback_ids",
    """SELECT coalesce(nullif(trim(id), ''), 'filing-' || rec_id) AS id, rec_id FROM filings WHERE trim(coalesce(text, '')) <> ''""",
)
def fallback_ids(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "filings", "rec_id", "id", "text").filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    return df.select(F.coalesce(F.nullif(F.trim("id"), F.lit("")), F.concat(F.lit("filing-"), F.col("rec_id").cast("string"))).alias("id"), "rec_id")


@query(
    "split_shapes",
    """SELECT split, count(*) AS n, count(anchor) AS n_anchor, count(positive) AS n_positive FROM raw_pairs GROUP BY split""",
)
def split_shapes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_pairs", "split", "anchor", "positive").groupBy("split").agg(F.count("*").alias("n"), F.count("anchor").alias("n_anchor"), F.count("positive").alias("n_positive"))
