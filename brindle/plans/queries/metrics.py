"""Metrics over the test tables; predictions are perturbed copies of the marked spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import vectors
from brindle.operators import generate, metrics, retrieval
from brindle.plans.durable import spread, table
from brindle.plans.queries import retrieval as rq
from brindle.plans.queries import spans as sq
from brindle.plans.registry import query

THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 19)]
KEYS = ["ann_id", "start_pos", "end_pos", "label"]
SETS = f"""gold AS (SELECT DISTINCT ann_id, a AS start_pos, b AS end_pos, label FROM ({sq.GOOD}) WHERE label IS NOT NULL),
  pred AS (SELECT DISTINCT ann_id, start_pos + CASE WHEN ann_id % 5 = 0 THEN 1 ELSE 0 END AS start_pos, end_pos, label, ((start_pos * 7 + ann_id) % 100) / 100.0::DOUBLE AS score FROM gold WHERE ann_id % 7 <> 0)"""
PRF = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS recall,
  round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / (tp + fn)::DOUBLE) ELSE 0 END, 6) AS f1"""
JOINED = "j AS (SELECT coalesce(g.label, p.label) AS label, g.ann_id IS NOT NULL AS g, p.ann_id IS NOT NULL AS p FROM gold g FULL JOIN pred p USING (ann_id, start_pos, end_pos, label))"
COUNTS = "count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE NOT g) AS fp, count(*) FILTER (WHERE NOT p) AS fn"


def _sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    gold = sq._rows(sq._good(spark, d)).filter("label IS NOT NULL").distinct()
    score = F.pmod(F.col("start_pos") * 7 + F.col("ann_id"), F.lit(100)) / 100.0
    pred = gold.filter("ann_id % 7 != 0").withColumn("score", score).withColumn("start_pos", F.col("start_pos") + F.when(F.col("ann_id") % 5 == 0, 1).otherwise(0))
    return gold, pred


@query("span_f1", f"WITH {SETS}, {JOINED}, c AS (SELECT {COUNTS} FROM j) SELECT *, {PRF} FROM c")
def span_f1(spark: SparkSession, d: str) -> DataFrame:
    gold, pred = _sets(spark, d)
    return metrics.with_prf(metrics.span_counts(pred, gold, KEYS))


@query("span_f1_by_label", f"WITH {SETS}, {JOINED}, c AS (SELECT label, {COUNTS} FROM j GROUP BY label) SELECT *, {PRF} FROM c")
def span_f1_by_label(spark: SparkSession, d: str) -> DataFrame:
    gold, pred = _sets(spark, d)
    return metrics.with_prf(metrics.span_counts(pred, gold, KEYS, ["label"]))


SWEEP = f"""{SETS}, th AS (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold),
  p AS (SELECT ann_id, start_pos, end_pos, label, max(score) AS score FROM pred GROUP BY ALL),
  c AS (SELECT threshold, count(*) FILTER (WHERE g.ann_id IS NOT NULL) AS tp, count(*) FILTER (WHERE p.ann_id IS NOT NULL AND g.ann_id IS NULL) AS fp FROM th LEFT JOIN p ON p.score >= threshold LEFT JOIN gold g USING (ann_id, start_pos, end_pos, label) GROUP BY threshold),
  s AS (SELECT threshold, tp, fp, (SELECT count(*) FROM gold) - tp AS fn FROM c), sweep AS (SELECT *, {PRF} FROM s)"""


@query("threshold_sweep", f"WITH {SWEEP} SELECT * FROM sweep")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    gold, pred = _sets(spark, d)
    return metrics.threshold_sweep(pred, gold, KEYS, THRESHOLDS)


@query("best_threshold", f"WITH {SWEEP} SELECT threshold, f1 FROM sweep ORDER BY f1 DESC, threshold DESC LIMIT 1")
def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return metrics.best_threshold(threshold_sweep(spark, d)).select("threshold", "f1")


@query(
    "generalist_f1",
    f"""WITH {SETS}, {JOINED}, c AS (SELECT label IN ('SOCIALNUM', 'TAXNUM') AS held, {COUNTS} FROM j GROUP BY 1), f AS (SELECT held, {PRF} FROM c),
        x AS (SELECT max(f1) FILTER (WHERE NOT held) AS closed_f1, max(f1) FILTER (WHERE held) AS zero_f1 FROM f)
        SELECT *, round(CASE WHEN closed_f1 + zero_f1 > 0 THEN 2 * closed_f1 * zero_f1 / (closed_f1 + zero_f1) ELSE 0 END, 6) AS generalist FROM x""",
)
def generalist_f1(spark: SparkSession, d: str) -> DataFrame:
    gold, pred = (x.withColumn("held", F.col("label").isin(sq.HOLDOUT)) for x in _sets(spark, d))
    f = metrics.with_prf(metrics.span_counts(pred, gold, [*KEYS, "held"], ["held"]))
    x = f.agg(F.max(F.when(~F.col("held"), F.col("f1"))).alias("closed_f1"), F.max(F.when(F.col("held"), F.col("f1"))).alias("zero_f1"))
    return x.withColumn("generalist", F.round(metrics.harmonic(F.col("closed_f1"), F.col("zero_f1")), 6))


RATED = """r AS (SELECT doc_id, rater, level FROM level_ratings WHERE level IS NOT NULL), g AS (SELECT doc_id, min(level) AS gold FROM r GROUP BY doc_id),
  x AS (SELECT rater, gold, level AS pred FROM r JOIN g USING (doc_id))"""


def _rated(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "level_ratings", "doc_id", "rater", "level").filter("level IS NOT NULL")
    return r.join(r.groupBy("doc_id").agg(F.min("level").alias("gold")), "doc_id").select("rater", "gold", F.col("level").alias("pred"))


@query(
    "clf_report",
    f"""WITH {RATED}, l AS (SELECT gold AS label FROM x UNION SELECT pred FROM x),
      c AS (SELECT label, (SELECT count(*) FROM x WHERE gold = label) AS support, (SELECT count(*) FROM x WHERE pred = label) AS said, (SELECT count(*) FROM x WHERE gold = label AND pred = label) AS tp FROM l)
      SELECT label, support, round(CASE WHEN said > 0 THEN tp / said::DOUBLE ELSE 0 END, 4) AS precision, round(CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END, 4) AS recall,
        round(CASE WHEN tp > 0 THEN 2 * (tp / said::DOUBLE) * (tp / support::DOUBLE) / (tp / said::DOUBLE + tp / support::DOUBLE) ELSE 0 END, 4) AS f1 FROM c""",
)
def clf_report(spark: SparkSession, d: str) -> DataFrame:
    return metrics.class_report(_rated(spark, d), "gold", "pred")


@query(
    "clf_metrics",
    f"""WITH {RATED}, c AS (SELECT label, (SELECT count(*) FROM x WHERE gold = label) AS support, (SELECT count(*) FROM x WHERE pred = label) AS said, (SELECT count(*) FROM x WHERE gold = label AND pred = label) AS tp FROM (SELECT DISTINCT gold AS label FROM x))
      SELECT sum(support)::BIGINT AS n, round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy,
        round(sum(support * CASE WHEN tp > 0 THEN 2 * (tp / said::DOUBLE) * (tp / support::DOUBLE) / (tp / said::DOUBLE + tp / support::DOUBLE) ELSE 0 END) / sum(support), 6) AS weighted_f1 FROM c""",
)
def clf_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.class_summary(_rated(spark, d), "gold", "pred")


@query(
    "metric_delta",
    f"""WITH {RATED}, a AS (SELECT gold::VARCHAR AS level, avg((gold = pred)::INT) AS v FROM x WHERE rater <= 'rater_3' GROUP BY 1), b AS (SELECT gold::VARCHAR AS level, avg((gold = pred)::INT) AS v FROM x WHERE rater > 'rater_3' GROUP BY 1)
      SELECT a.level, round(a.v, 6) AS base, round(b.v, 6) AS tuned, round(round(b.v, 6) - round(a.v, 6), 6) AS delta FROM a JOIN b USING (level)""",
)
def metric_delta(spark: SparkSession, d: str) -> DataFrame:
    x = _rated(spark, d).withColumn("level", F.col("gold").cast("string")).withColumn("ok", (F.col("gold") == F.col("pred")).cast("int"))
    of = lambda c: x.filter(c).groupBy("level").agg(F.round(F.avg("ok"), 6).alias("value"))
    return metrics.metric_delta(of("rater <= 'rater_3'"), of("rater > 'rater_3'"), "level")


@query(
    "text_em_f1",
    r"""WITH s AS (SELECT pair_id, trim(regexp_replace(coalesce(anchor, ''), '\s+', ' ', 'g')) AS p, trim(regexp_replace(coalesce(positive, ''), '\s+', ' ', 'g')) AS g FROM raw_pairs),
      w AS (SELECT pair_id, p, g, list_filter(string_split(p, ' '), lambda x: x <> '') AS pw, list_filter(string_split(g, ' '), lambda x: x <> '') AS gw FROM s),
      a AS (SELECT pair_id, w, count(*) AS n FROM (SELECT pair_id, unnest(pw) AS w FROM w) GROUP BY ALL), b AS (SELECT pair_id, w, count(*) AS n FROM (SELECT pair_id, unnest(gw) AS w FROM w) GROUP BY ALL),
      m AS (SELECT a.pair_id, sum(least(a.n, b.n))::DOUBLE AS same FROM a JOIN b USING (pair_id, w) GROUP BY a.pair_id)
    SELECT pair_id, (p = g)::INT AS em, round(CASE WHEN coalesce(same, 0) > 0 THEN 2 * (same / len(pw)) * (same / len(gw)) / (same / len(pw) + same / len(gw)) ELSE 0 END, 6) AS f1 FROM w LEFT JOIN m USING (pair_id)""",
)
def text_em_f1(spark: SparkSession, d: str) -> DataFrame:
    return metrics.text_scores(spread(table(spark, d, "raw_pairs", "pair_id", "anchor", "positive")), "pair_id", "anchor", "positive")


@query(
    "ir_metrics",
    f"""WITH {rq.BASE_ALL}, {rq._bm25_sql('hits', 10, 0.75)}, f AS (SELECT q.qid, min(rank)::DOUBLE AS r FROM q LEFT JOIN (SELECT hits.qid, rank FROM hits JOIN pos USING (qid, cid)) h USING (qid) GROUP BY q.qid)
      SELECT count(*) AS n, round(avg(coalesce(1 / r, 0)), 6) AS mrr, round(avg(coalesce(1 / log2(r + 1), 0)), 6) AS ndcg, round(avg((r IS NOT NULL)::INT), 6) AS accuracy,
        round(avg(CASE WHEN r IS NOT NULL THEN 0.1::DOUBLE ELSE 0 END), 6) AS precision, round(avg((r IS NOT NULL)::INT), 6) AS recall, round(avg(coalesce(1 / r, 0)), 6) AS map FROM f""",
)
def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Every row with an anchor and a positive is a query."""
    df = spread(table(spark, d, "raw_pairs", "pair_id", "anchor", "positive"))
    q = rq._asked(df)
    return metrics.rank_metrics(q, retrieval.own_ranks(q.withColumnRenamed("positive", "own"), retrieval.distinct_corpus(df, "positive", "pair_id"), 10))


@query(
    "triplet_accuracy",
    f"""SELECT count(*) AS n, round(avg((sp > sn)::INT), 6) AS accuracy FROM (SELECT {rq.OVER.format(a='a.anchor', b='a.positive')} AS sp, {rq.OVER.format(a='a.anchor', b='b.positive')} AS sn
        FROM raw_pairs a JOIN raw_pairs b ON b.pair_id = a.pair_id + 1 WHERE a.anchor IS NOT NULL AND a.positive IS NOT NULL AND b.positive IS NOT NULL)""",
)
def triplet_accuracy(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "raw_pairs", "pair_id", "anchor", "positive").dropna(subset=["positive"])
    other = df.select((F.col("pair_id") - 1).alias("pair_id"), F.col("positive").alias("negative"))
    t = df.filter("anchor IS NOT NULL").join(other, "pair_id")
    right = generate.overlap_scorer(F.col("anchor"), F.col("positive")) > generate.overlap_scorer(F.col("anchor"), F.col("negative"))
    return t.agg(F.count("*").alias("n"), F.round(F.avg(right.cast("int")), 6).alias("accuracy"))


@query(
    "softmax_topclass",
    """WITH e AS (SELECT vec_id, list_transform(embedding[1:4]::DOUBLE[], lambda x: exp(x - list_max(embedding[1:4]::DOUBLE[]))) AS e FROM embeddings)
       SELECT vec_id, (list_position(e, list_max(e)) - 1)::INT AS label, round(list_max(e) / list_sum(e), 6) AS score FROM e""",
)
def softmax_topclass(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", "embedding").withColumn("p", vectors.softmax(F.slice("embedding", 1, 4).cast("array<double>")))
    return e.select("vec_id", vectors.argmax(F.col("p")).alias("label"), F.round(F.array_max("p"), 6).alias("score"))
