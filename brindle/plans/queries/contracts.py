"""Contracts and conversions that have no table of their own among the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import spans as sp
from brindle.operators import contracts
from brindle.plans.durable import table
from brindle.plans.queries import spans as sq
from brindle.plans.registry import query


@query("json_field", "SELECT event_id, props->>'$.k' AS k FROM events")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id", "props").select("event_id", contracts.json_field(F.col("props"), "$.k").alias("k"))


@query("overlapping_spans", f"WITH {sq.ORDERED} SELECT ann_id, (i - 1)::INT AS span_ix FROM (SELECT *, lag(b) OVER (PARTITION BY ann_id ORDER BY i) AS p FROM o) WHERE a < p")
def overlapping_spans(spark: SparkSession, d: str) -> DataFrame:
    df = sq._good(spark, d).withColumn("spans", sp.in_order(F.col("spans")))
    return contracts.overlapping_spans(df, "ann_id", "spans")


@query(
    "coco_contract",
    """SELECT l_orderkey AS image, ix, unnest(list_filter([CASE WHEN w <= 0 THEN 'width and height > 0' END, CASE WHEN x < 0 THEN 'x and y >= 0' END], lambda e: e IS NOT NULL)) AS error
       FROM (SELECT l_orderkey, l_linenumber AS ix, l_quantity - 10 AS x, (l_extendedprice % 300) - 100 AS w FROM lineitem)""",
)
def coco_contract(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    box = F.array(F.col("l_quantity") - 10, F.lit(1.0), (F.col("l_extendedprice") % 300) - 100, F.lit(1.0))
    objects = F.struct(F.array(box).alias("bbox"), F.array(F.lit(1)).alias("category_id"), F.array(F.lit(1.0)).alias("area"), F.array(F.lit(0)).alias("iscrowd"))
    return li.select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("ix"), F.explode(contracts.coco_violations(objects)).alias("error"))


@query(
    "build_target",
    """SELECT resp_id, md5(coalesce(text, CASE WHEN coalesce(prompt, '') = '' THEN 'No objects detected.' ELSE prompt END)) AS target_md5 FROM llm_responses""",
)
def build_target(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "llm_responses", "resp_id", "text", "prompt")
    return df.select("resp_id", F.md5(contracts.target(F.col("text"), F.col("prompt"))).alias("target_md5"))


@query("score_filter", "SELECT event_id FROM events WHERE value >= 0.3")
def score_filter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "value").withColumn("dets", F.array(F.struct(F.col("value").alias("score"))))
    return e.withColumn("dets", contracts.scored_above(F.col("dets"), 0.3)).filter(F.size("dets") > 0).select("event_id")
