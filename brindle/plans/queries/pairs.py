"""Generation responses, heuristics, dedup, multi-hop windows and the whole pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import jsonx
from brindle.functions import text as tx
from brindle.operators import pairs, rows
from brindle.plans.durable import spread, table
from brindle.plans.pipeline import pair_pipeline
from brindle.plans.queries.text import CHUNKS
from brindle.plans.registry import query

JSON = "CASE WHEN json_valid(trim(text)) THEN trim(text) WHEN json_valid(regexp_extract(text, '(?s)\\{.*\\}')) THEN regexp_extract(text, '(?s)\\{.*\\}') END"
TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


def _stage(spark: SparkSession, d: str, stage: str) -> DataFrame:
    return table(spark, d, "llm_responses", "resp_id", "stage", "text", "error", "source").filter((F.col("stage") == stage) & F.col("error").isNull() & F.col("text").isNotNull())


@query(
    "query_rows",
    f"""WITH j AS (SELECT resp_id, {JSON} AS j FROM llm_responses WHERE stage = 'query_gen' AND error IS NULL AND text IS NOT NULL),
          q AS (SELECT resp_id, unnest(range(json_array_length(j, '$.queries')::BIGINT)) AS ix, j FROM j WHERE json_type(j, '$.queries') = 'ARRAY')
        SELECT resp_id, ix, json_extract_string(j, '$.queries[' || ix || '].style') AS style, json_extract_string(j, '$.queries[' || ix || '].query') AS query FROM q""",
)
def query_rows(spark: SparkSession, d: str) -> DataFrame:
    q = _stage(spark, d, "query_gen").select("resp_id", F.posexplode(jsonx.queries(F.col("text"))).alias("ix", "q"))
    return q.select("resp_id", F.col("ix").cast("bigint").alias("ix"), "q.style", "q.query")


@query(
    "parse_queries",
    f"""SELECT source, count(*) AS n, count(*) FILTER (WHERE json_type(j, '$.queries') = 'ARRAY') AS n_usable
        FROM (SELECT source, {JSON} AS j FROM llm_responses WHERE stage = 'query_gen' AND error IS NULL AND text IS NOT NULL) GROUP BY source""",
)
def parse_queries(spark: SparkSession, d: str) -> DataFrame:
    s = _stage(spark, d, "query_gen")
    return s.groupBy("source").agg(F.count("*").alias("n"), F.count_if(jsonx.queries(F.col("text")).isNotNull()).alias("n_usable"))


@query(
    "parse_judge",
    f"""SELECT resp_id, CASE WHEN json_type(j, '$.score') IN ('UBIGINT', 'BIGINT') AND (j->>'$.score')::BIGINT BETWEEN 1 AND 5 THEN (j->>'$.score')::INT END AS score
        FROM (SELECT resp_id, {JSON} AS j FROM llm_responses WHERE stage = 'judge' AND error IS NULL AND text IS NOT NULL)""",
)
def parse_judge(spark: SparkSession, d: str) -> DataFrame:
    return _stage(spark, d, "judge").select("resp_id", jsonx.judge_score(F.col("text")).alias("score"))


@query(
    "parse_multi_hop",
    f"""SELECT resp_id, nullif(trim(j->>'$.query'), '') AS query FROM (SELECT resp_id, {JSON} AS j FROM llm_responses WHERE stage = 'multi_hop' AND error IS NULL AND text IS NOT NULL)""",
)
def parse_multi_hop(spark: SparkSession, d: str) -> DataFrame:
    return _stage(spark, d, "multi_hop").select("resp_id", jsonx.query(F.col("text")).alias("query"))


@query(
    "response_status",
    f"""SELECT stage, CASE WHEN error IS NOT NULL THEN 'error' WHEN text IS NULL OR {JSON} IS NULL THEN 'unusable' ELSE 'ok' END AS status, count(*) AS n
        FROM llm_responses WHERE stage <> 'answer' GROUP BY 1, 2""",
)
def response_status(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "llm_responses", "stage", "text", "error").filter("stage != 'answer'")
    good = F.when(F.col("stage") == "query_gen", jsonx.queries(F.col("text")).isNotNull()).when(F.col("stage") == "judge", jsonx.judge_score(F.col("text")).isNotNull()).otherwise(jsonx.query(F.col("text")).isNotNull())
    status = F.when(F.col("error").isNotNull(), "error").when(F.coalesce(good, F.lit(False)), "ok").otherwise("unusable")
    return df.groupBy("stage", status.alias("status")).agg(F.count("*").alias("n"))


RUNS = f"""
  w AS (SELECT pair_id, {TOK.format("coalesce(anchor, '')")} AS q, {TOK.format("coalesce(positive, '')")} AS p FROM raw_pairs),
  qw AS (SELECT pair_id, unnest(q) AS w, unnest(range(len(q))) AS qi FROM w),
  pw AS (SELECT pair_id, unnest(p) AS w, unnest(range(len(p))) AS pi FROM w),
  h AS (SELECT qw.pair_id, qi - pi AS diag, qi FROM qw JOIN pw ON qw.pair_id = pw.pair_id AND qw.w = pw.w),
  i AS (SELECT pair_id, diag, qi - row_number() OVER (PARTITION BY pair_id, diag ORDER BY qi) AS island FROM h),
  r AS (SELECT pair_id, max(n) AS run FROM (SELECT pair_id, count(*) AS n FROM i GROUP BY pair_id, diag, island) GROUP BY pair_id),
  runs AS (SELECT w.pair_id, coalesce(run, 0) AS run, len(q) AS n_words FROM w LEFT JOIN r USING (pair_id)),
  kept AS (SELECT raw_pairs.*, run FROM raw_pairs JOIN runs USING (pair_id)
           WHERE regexp_matches(anchor, '\\S') AND regexp_matches(positive, '\\S') AND n_words BETWEEN 3 AND 30 AND run <= 6),
  uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(regexp_replace(anchor, '^\\s+|\\s+$', '', 'g')) ORDER BY pair_id) AS rn FROM kept) WHERE rn = 1)"""


def _raw(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "raw_pairs", "pair_id", "anchor", "positive", *more)


@query("verbatim_run", f"WITH {RUNS} SELECT pair_id, run FROM runs")
def verbatim_run(spark: SparkSession, d: str) -> DataFrame:
    return pairs.verbatim_runs(spread(_raw(spark, d)), "pair_id", "anchor", "positive")


@query("pair_heuristics", f"WITH {RUNS} SELECT pair_id FROM kept")
def pair_heuristics(spark: SparkSession, d: str) -> DataFrame:
    return pairs.heuristic_keep(spread(_raw(spark, d)), "anchor", "positive", pairs.PairConfig()).select("pair_id")


@query(
    "anchor_dedup",
    r"""SELECT pair_id FROM (SELECT pair_id, row_number() OVER (PARTITION BY lower(regexp_replace(anchor, '^\s+|\s+$', '', 'g')) ORDER BY pair_id) AS rn FROM raw_pairs WHERE anchor IS NOT NULL) WHERE rn = 1""",
)
def anchor_dedup(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "raw_pairs", "pair_id", "anchor").filter("anchor IS NOT NULL")
    return pairs.dedup(df, "anchor", F.col("pair_id")).select("pair_id")


@query(
    "judge_threshold",
    """WITH fresh AS (SELECT row_id, max(judge_score) AS f FROM raw_pairs WHERE source = 'edgar_like' AND judge_score IS NOT NULL GROUP BY row_id),
            stored AS (SELECT row_id, max(judge_score) AS s FROM raw_pairs WHERE judge_score IS NOT NULL GROUP BY row_id)
       SELECT pair_id, coalesce(f, s) AS judge_score FROM raw_pairs LEFT JOIN fresh USING (row_id) LEFT JOIN stored USING (row_id) WHERE coalesce(f, s) >= 4""",
)
def judge_threshold(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "raw_pairs", "pair_id", "row_id", "source", "judge_score")
    scores = df.filter("judge_score IS NOT NULL").select("row_id", "source", F.col("judge_score").alias("score"))
    fresh = scores.filter("source = 'edgar_like'")
    return pairs.judged(df.select("pair_id", "row_id"), scores, fresh, "row_id", 4).select("pair_id", "judge_score")


@query("resume_anti", "SELECT pair_id FROM raw_pairs WHERE row_id NOT IN (SELECT row_id FROM raw_pairs WHERE judge_score IS NOT NULL AND row_id IS NOT NULL)")
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "raw_pairs", "pair_id", "row_id", "judge_score").filter("row_id IS NOT NULL")
    return rows.not_done(df, df.filter("judge_score IS NOT NULL"), "row_id").select("pair_id")


HOPS = """c AS (SELECT DISTINCT doc_id, chunk_id, string_split(chunk_id, '::')[2]::INT AS ix FROM raw_pairs WHERE chunk_id IS NOT NULL),
  n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ix) - 1 AS rn, lead(chunk_id) OVER (PARTITION BY doc_id ORDER BY ix) AS nxt FROM c),
  hops AS (SELECT doc_id || '::g' || rn AS group_id, doc_id, chunk_id, nxt FROM n WHERE nxt IS NOT NULL)"""


def _hops(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "raw_pairs", "doc_id", "chunk_id").filter("chunk_id IS NOT NULL").distinct()
    return pairs.multi_hop_windows(c.withColumn("ix", F.element_at(F.split("chunk_id", "::"), 2).cast("int")), "doc_id", "ix", "chunk_id")


@query("multi_hop_windows", f"WITH {HOPS} SELECT group_id, chunk_id || '|' || nxt AS chunks FROM hops")
def multi_hop_windows(spark: SparkSession, d: str) -> DataFrame:
    return _hops(spark, d).select("group_id", F.array_join("chunk_ids", "|").alias("chunks"))


@query("multi_hop_rows", f"WITH {HOPS} SELECT group_id, unnest([chunk_id, nxt]) AS chunk_id FROM hops")
def multi_hop_rows(spark: SparkSession, d: str) -> DataFrame:
    return _hops(spark, d).select("group_id", F.explode("chunk_ids").alias("chunk_id"))


@query("multi_hop_sample", f"WITH {HOPS} SELECT group_id FROM hops ORDER BY sha256('42::' || group_id), group_id LIMIT 50")
def multi_hop_sample(spark: SparkSession, d: str) -> DataFrame:
    return pairs.sample_by_hash(_hops(spark, d).select("group_id"), "group_id", 50)


@query("multi_hop_count", "SELECT round_even(0.25::DOUBLE * count(*) / 2, 0)::BIGINT AS n_groups FROM raw_pairs WHERE group_id IS NULL")
def multi_hop_count(spark: SparkSession, d: str) -> DataFrame:
    single = table(spark, d, "raw_pairs", "group_id").filter("group_id IS NULL").agg(F.count("*").alias("n"))
    return single.select(pairs.group_count(F.col("n"), 0.2, 2).alias("n_groups"))


@query(
    "chunks_block",
    """SELECT doc_id, md5(string_agg('[' || rn || '] ' || chunk_id, chr(10) || chr(10) ORDER BY rn)) AS block_md5 FROM (
         SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY string_split(chunk_id, '::')[2]::INT) AS rn
         FROM (SELECT DISTINCT doc_id, chunk_id FROM raw_pairs WHERE chunk_id IS NOT NULL)) GROUP BY doc_id""",
)
def chunks_block(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "raw_pairs", "doc_id", "chunk_id").filter("chunk_id IS NOT NULL").distinct()
    ordered = F.array_sort(F.collect_list(F.struct(F.element_at(F.split("chunk_id", "::"), 2).cast("int").alias("ix"), "chunk_id")))
    return c.groupBy("doc_id").agg(ordered.alias("cs")).select("doc_id", F.md5(tx.numbered_block(F.transform("cs", lambda s: s["chunk_id"]))).alias("block_md5"))


@query("filter_pairs", f"WITH {RUNS} SELECT pair_id FROM uniq WHERE judge_score >= 4")
def filter_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.filter_pairs(spread(_raw(spark, d, "judge_score")), "pair_id", "anchor", "positive", pairs.PairConfig(), "judge_score").select("pair_id")


@query(
    "pipeline_stats",
    f"""WITH {RUNS} SELECT (SELECT count(*) FROM raw_pairs) AS n_raw, (SELECT count(DISTINCT doc_id) FROM raw_pairs) AS n_docs, (SELECT count(DISTINCT chunk_id) FROM raw_pairs) AS n_chunks,
        (SELECT count(*) FROM raw_pairs WHERE group_id IS NOT NULL) AS n_multi_hop, (SELECT count(*) FROM uniq WHERE judge_score >= 4) AS n_kept""",
)
def pipeline_stats(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "raw_pairs")
    n = df.agg(F.count("*").alias("n_raw"), F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("chunk_id").alias("n_chunks"), F.count("group_id").alias("n_multi_hop"))
    return n.crossJoin(filter_pairs(spark, d).agg(F.count("*").alias("n_kept")))  # one row each


STUB = """list_filter(list_transform(range(1, len(t[1:{n}]) + 1), lambda i: CASE WHEN (i - 1) % {m} = {r} THEN t[i] END), lambda x: x IS NOT NULL)"""


@query(
    "pair_pipeline",
    f"""WITH {CHUNKS},
      c AS (SELECT doc_id, chunk_id, text, words AS t FROM chunks),
      raw AS (SELECT chunk_id || '::natural_question::0' AS row_id, array_to_string(t[1:8], ' ') AS anchor, text AS positive, doc_id FROM c
        UNION ALL SELECT chunk_id || '::keyword_query::1', array_to_string({STUB.format(n=24, m=3, r=0)}, ' '), text, doc_id FROM c
        UNION ALL SELECT chunk_id || '::paraphrased_statement::2', array_to_string({STUB.format(n=16, m=2, r=1)}, ' '), text, doc_id FROM c),
      w AS (SELECT row_id, string_split(anchor, ' ') AS q, {TOK.format('positive')} AS p FROM raw WHERE anchor <> '' AND len(string_split(anchor, ' ')) BETWEEN 3 AND 30),
      qw AS (SELECT row_id, unnest(q) AS w, unnest(range(len(q))) AS qi FROM w),
      pw AS (SELECT row_id, unnest(p) AS w, unnest(range(len(p))) AS pi FROM w),
      h AS (SELECT qw.row_id, qi - pi AS diag, qi FROM qw JOIN pw ON qw.row_id = pw.row_id AND qw.w = pw.w),
      i AS (SELECT row_id, diag, qi - row_number() OVER (PARTITION BY row_id, diag ORDER BY qi) AS island FROM h),
      r AS (SELECT row_id, max(n) AS run FROM (SELECT row_id, count(*) AS n FROM i GROUP BY row_id, diag, island) GROUP BY row_id),
      kept AS (SELECT raw.* FROM raw JOIN w USING (row_id) LEFT JOIN r USING (row_id) WHERE coalesce(run, 0) <= 6),
      uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(anchor) ORDER BY row_id) AS rn FROM kept) WHERE rn = 1)
    SELECT row_id, anchor, md5(positive) AS positive_md5, CASE WHEN u < 0.9::DOUBLE THEN 'train' WHEN u < 0.95::DOUBLE THEN 'dev' ELSE 'test' END AS split
    FROM (SELECT *, ('0x' || substr(sha256('42::' || doc_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616::DOUBLE AS u FROM uniq)""",
)
def pair_pipeline_query(spark: SparkSession, d: str) -> DataFrame:
    out = pair_pipeline(spread(table(spark, d, "documents", "doc_id", "text")), "doc_id", "text")
    return out.select("row_id", "anchor", F.md5("positive").alias("positive_md5"), "split")


@query("topic_pairs", "SELECT a.n_name AS anchor, b.n_name AS positive FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def topic_pairs(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    b = n.select(F.col("n_name").alias("positive"), F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("k"))
    return n.join(b, (F.col("n_regionkey") == F.col("r")) & (F.col("n_nationkey") != F.col("k"))).select(F.col("n_name").alias("anchor"), "positive")
