"""Words, offsets, windows, labels and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as tx
from brindle.operators import chunking
from brindle.plans.durable import spread, table
from brindle.plans.registry import query

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
#: Fixed value: an alias table for label prompts.
ALIAS = {"GIVENNAME": "given name", "TAXNUM": "tax number", "PHONE": ""}
#: Fixed value: prompt prefixes by model name, first match wins.
PREFIXES = {"gen-large": "query: ", "gen": "passage: ", "judge": "score: "}


@query("word_tokens", f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {TOKENS} AS t FROM documents WHERE text IS NOT NULL)")
def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents", "doc_id", "text").filter("text IS NOT NULL").withColumn("t", tx.word_tokens(F.col("text")))
    return df.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


@query(
    "token_offsets",
    r"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w, regexp_split_to_array(text, '[\p{L}\p{N}_]+') AS g FROM documents WHERE text IS NOT NULL),
         u AS (SELECT doc_id, unnest(range(len(w))) AS ix, unnest(w) AS tok, unnest(g[1:len(w)]) AS gap FROM p)
       SELECT doc_id, ix, tok, (sum(length(gap) + length(tok)) OVER (PARTITION BY doc_id ORDER BY ix) - length(tok))::BIGINT AS start_pos,
              (sum(length(gap) + length(tok)) OVER (PARTITION BY doc_id ORDER BY ix))::BIGINT AS end_pos FROM u""",
)
def token_offsets(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents", "doc_id", "text")
    each = df.select("doc_id", F.posexplode(tx.tokens_with_offsets(F.col("text"))).alias("ix", "t"))
    return each.select("doc_id", F.col("ix").cast("bigint").alias("ix"), F.col("t.tok").alias("tok"), F.col("t.start").cast("bigint").alias("start_pos"), F.col("t.end").cast("bigint").alias("end_pos"))


CHUNKS = r"""
  t AS (SELECT doc_id::VARCHAR AS doc_id, text AS x, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS tok, regexp_split_to_array(text, '[\p{L}\p{N}_]+') AS gap FROM documents WHERE text IS NOT NULL),
  placed AS (SELECT doc_id, ix, sum(length(g) + length(o)) OVER (PARTITION BY doc_id ORDER BY ix) AS b, sum(length(g) + length(o)) OVER (PARTITION BY doc_id ORDER BY ix) - length(o) AS a
        FROM (SELECT doc_id, unnest(range(len(tok))) AS ix, unnest(tok) AS o, unnest(gap[1:len(tok)]) AS g FROM t)),
  k AS (SELECT doc_id, x, tok, unnest(range(greatest(0, ceil((len(tok) - 256) / 224.0))::BIGINT + 1)) AS chunk_ix FROM t WHERE len(tok) > 0),
  chunks AS (SELECT k.doc_id, chunk_ix, k.doc_id || '::' || chunk_ix AS chunk_id, substr(x, f.a::INT + 1, (l.b - f.a)::INT) || regexp_extract(substr(x, l.b::INT + 1, 8), '^[^\s\p{L}\p{N}_]*') AS text,
             chunk_ix * 224 AS start_token, least(chunk_ix * 224 + 256, len(tok)) AS end_token, list_transform(tok[chunk_ix * 224 + 1 : chunk_ix * 224 + 256], lambda v: lower(v)) AS words
             FROM k JOIN placed f ON f.doc_id = k.doc_id AND f.ix = chunk_ix * 224 JOIN placed l ON l.doc_id = k.doc_id AND l.ix = least(chunk_ix * 224 + 256, len(tok)) - 1
             WHERE chunk_ix = 0 OR least(256, len(tok) - chunk_ix * 224) >= 64)"""


@query("chunk_docs", f"WITH {CHUNKS} SELECT chunk_id, md5(text) AS text_md5, start_token, end_token FROM chunks")
def chunk_docs(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.chunk_documents(spread(table(spark, d, "documents", "doc_id", "text")), "doc_id", "text")
    return c.select("chunk_id", F.md5("text").alias("text_md5"), F.col("start_token").cast("bigint").alias("start_token"), F.col("end_token").cast("bigint").alias("end_token"))


@query("tokenize_truncate", f"SELECT doc_id, len(t[1:128]) AS n, md5(array_to_string(t[1:128], ' ')) AS tokens_md5 FROM (SELECT doc_id, {TOKENS} AS t FROM documents WHERE text IS NOT NULL)")
def tokenize_truncate(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents", "doc_id", "text").filter("text IS NOT NULL").withColumn("t", chunking.truncate_tokens(F.col("text")))
    return df.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


LABELS = "SELECT DISTINCT s.label AS label FROM (SELECT unnest(spans) AS s FROM annotated) WHERE s.label IS NOT NULL"
HUMAN = r"""CASE WHEN lower(trim(regexp_replace(regexp_replace(regexp_replace(label, '[_-]', ' ', 'g'), '([\p{Ll}\p{Nd}])(\p{Lu})', '\1 \2', 'g'), '\s+', ' ', 'g'))) = '' THEN label
  ELSE lower(trim(regexp_replace(regexp_replace(regexp_replace(label, '[_-]', ' ', 'g'), '([\p{Ll}\p{Nd}])(\p{Lu})', '\1 \2', 'g'), '\s+', ' ', 'g'))) END"""


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "annotated", "spans").select(F.explode("spans").alias("s")).select("s.label").filter("label IS NOT NULL").distinct()


@query("humanize_label", f"SELECT label, {HUMAN} AS human FROM ({LABELS})")
def humanize_label(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).withColumn("human", tx.humanize_label(F.col("label")))


@query(
    "label_prompt",
    f"SELECT label, coalesce(nullif(CASE label WHEN 'GIVENNAME' THEN 'given name' WHEN 'TAXNUM' THEN 'tax number' WHEN 'PHONE' THEN '' END, ''), {HUMAN}) AS prompt FROM ({LABELS})",
)
def label_prompt(spark: SparkSession, d: str) -> DataFrame:
    alias = spark.createDataFrame(list(ALIAS.items()), "label string, alias string")
    joined = _labels(spark, d).join(F.broadcast(alias), "label", "left")
    return joined.select("label", F.coalesce(F.nullif("alias", F.lit("")), tx.humanize_label(F.col("label"))).alias("prompt"))


@query("prompt_label", f"SELECT prompt, min(label) AS label FROM (SELECT label, {HUMAN} AS prompt FROM ({LABELS})) GROUP BY prompt")
def prompt_label(spark: SparkSession, d: str) -> DataFrame:
    human = _labels(spark, d).withColumn("prompt", tx.humanize_label(F.col("label")))
    return human.groupBy("prompt").agg(F.min_by("label", "label").alias("label"))


@query(
    "prompt_prefix",
    """SELECT resp_id, CASE WHEN m LIKE 'gen-large%' THEN 'query: ' WHEN m LIKE 'gen%' THEN 'passage: ' WHEN m LIKE 'judge%' THEN 'score: ' END AS prefix
       FROM (SELECT resp_id, metadata['model'] AS m FROM llm_responses WHERE metadata IS NOT NULL)""",
)
def prompt_prefix(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "llm_responses", "resp_id", "metadata").filter("metadata IS NOT NULL")
    return df.select("resp_id", tx.first_prefix(F.col("metadata")["model"], PREFIXES).alias("prefix"))


@query(
    "passage_format",
    r"""SELECT doc_id, md5(regexp_replace(CASE WHEN t <> '' THEN t || chr(10) ELSE '' END || b, '^\s+|\s+$', '', 'g')) AS passage_md5
        FROM (SELECT doc_id, regexp_replace(coalesce(source, ''), '^\s+|\s+$', '', 'g') AS t, regexp_replace(coalesce(lang, ''), '^\s+|\s+$', '', 'g') AS b FROM documents)""",
)
def passage_format(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents", "doc_id", "source", "lang")
    return df.select("doc_id", F.md5(tx.passage(F.col("source"), F.col("lang"))).alias("passage_md5"))


@query(
    "chat_messages",
    """SELECT resp_id, role, md5(content) AS content_md5 FROM (
         SELECT resp_id, 'system' AS role, stage AS content FROM llm_responses UNION ALL SELECT resp_id, 'user', prompt FROM llm_responses UNION ALL SELECT resp_id, 'assistant', text FROM llm_responses)
       WHERE content IS NOT NULL""",
)
def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "llm_responses", "resp_id", "stage", "prompt", "text")
    m = df.select("resp_id", F.explode(tx.chat_messages(F.col("stage"), F.col("prompt"), F.col("text"))).alias("m"))
    return m.select("resp_id", F.col("m.role").alias("role"), F.md5("m.content").alias("content_md5"))


@query("dataset_slug", "SELECT DISTINCT source, string_split('org/' || source, '/')[-1] AS slug FROM documents WHERE source IS NOT NULL")
def dataset_slug(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents", "source").filter("source IS NOT NULL").distinct()
    return df.select("source", F.element_at(F.split(F.concat(F.lit("org/"), F.col("source")), "/"), -1).alias("slug"))
