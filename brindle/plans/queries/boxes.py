"""Boxes made of line items (an image is an order, a label the return flag), their text forms and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import geometry as geo
from brindle.operators import metrics
from brindle.plans.durable import table
from brindle.plans.registry import query

W, H = 1000.0, 800.0
IOUS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]
RAW = "SELECT l_orderkey AS image, l_linenumber AS ix, l_returnflag AS label, l_suppkey, l_quantity * 18 AS x, l_discount * 6000 AS y, (l_extendedprice % 300) + 1 AS w, l_tax * 2000 + 10 AS h FROM lineitem"
UNIT = f"""SELECT image, ix, label, l_suppkey, greatest(0, least(1, x / 1000)) AS x1, greatest(0, least(1, y / 800)) AS y1, greatest(0, least(1, (x + w) / 1000)) AS x2, greatest(0, least(1, (y + h) / 800)) AS y2 FROM ({RAW})"""
BOX = f"box AS (SELECT * FROM ({UNIT}) WHERE x2 > x1 AND y2 > y1)"
QUANT = "greatest(0, least(999, round_even({} * 999, 0)))::INT"


def _raw(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey", "l_quantity", "l_discount", "l_extendedprice", "l_tax")
    box = F.array(F.col("l_quantity") * 18, F.col("l_discount") * 6000, (F.col("l_extendedprice") % 300) + 1, F.col("l_tax") * 2000 + 10)
    return li.select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("ix"), F.col("l_returnflag").alias("label"), "l_suppkey", box.alias("xywh"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).withColumn("box", geo.unit_box(F.col("xywh"), F.lit(W), F.lit(H))).filter("box IS NOT NULL").drop("xywh")


@query("box_normalize", f"WITH {BOX} SELECT image, ix, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy FROM box")
def box_normalize(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d).withColumn("c", geo.centre(F.col("box")))
    return b.select("image", "ix", *[F.round(F.col("box")[i], 6).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))], F.round(F.col("c")[0], 6).alias("cx"), F.round(F.col("c")[1], 6).alias("cy"))


@query(
    "validate_boxes",
    f"""SELECT image, ix, unnest(list_filter([CASE WHEN x / 500 < 0 OR x / 500 > 1 OR y / 400 < 0 OR y / 400 > 1 OR w / 500 > 1 OR h / 400 > 1 THEN 'box within [0, 1]' END,
          CASE WHEN w / 500 <= x / 500 OR h / 400 <= y / 400 THEN 'box has extent' END], lambda e: e IS NOT NULL)) AS error FROM ({RAW})""",
)
def validate_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = _raw(spark, d).withColumn("b", F.array(F.col("xywh")[0] / 500, F.col("xywh")[1] / 400, F.col("xywh")[2] / 500, F.col("xywh")[3] / 400))
    return b.select("image", "ix", F.explode(geo.violations(F.col("b"), F.col("label"))).alias("error"))


@query("quantize", f"WITH {BOX} SELECT image, ix, {QUANT.format('x1')} AS q1, {QUANT.format('x2')} AS q2, round({QUANT.format('x1')} / 999.0::DOUBLE, 6) AS back FROM box")
def quantize(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    q = geo.quantize(F.col("box")[0])
    return b.select("image", "ix", q.alias("q1"), geo.quantize(F.col("box")[2]).alias("q2"), F.round(geo.dequantize(q), 6).alias("back"))


TEXT = f"label || '<box> ' || {QUANT.format('x1')} || ', ' || {QUANT.format('y1')} || ', ' || {QUANT.format('x2')} || ', ' || {QUANT.format('y2')} || ' </box>'"


@query("box_serialize", f"WITH {BOX} SELECT image, string_agg({TEXT}, chr(10) ORDER BY ix, {TEXT}) AS target FROM box GROUP BY image")
def box_serialize(spark: SparkSession, d: str) -> DataFrame:
    return _targets(spark, d)


def _targets(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d).select("image", F.struct("ix", geo.serialize(F.col("label"), F.col("box")).alias("t")).alias("s"))
    return b.groupBy("image").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), "\n").alias("target"))


@query(
    "box_parse",
    f"""WITH {BOX} SELECT image, row_number() OVER (PARTITION BY image ORDER BY ix, {TEXT}) - 1 AS pos, label, round({QUANT.format('x1')} / 999.0::DOUBLE, 6) AS c1, round({QUANT.format('y2')} / 999.0::DOUBLE, 6) AS c4 FROM box""",
)
def box_parse(spark: SparkSession, d: str) -> DataFrame:
    p = _targets(spark, d).select("image", F.posexplode(geo.parse(F.col("target"))).alias("pos", "o"))
    return p.select("image", F.col("pos").cast("bigint").alias("pos"), "o.label", F.col("o.coords")[0].alias("c1"), F.col("o.coords")[3].alias("c4"))


IOU = """CASE WHEN ({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - i > 0 THEN i / (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - i) ELSE 0 END"""
INTER = "greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"


@query(
    "box_iou",
    f"""WITH {BOX} SELECT a.image, a.ix, round({IOU.format(a='a', b='b')}, 6) AS iou, (a.x1 + a.x2) / 2 BETWEEN b.x1 AND b.x2 AND (a.y1 + a.y2) / 2 BETWEEN b.y1 AND b.y2 AS inside
        FROM box a JOIN box b ON a.image = b.image AND b.ix = a.ix + 1, LATERAL (SELECT {INTER.format(a='a', b='b')} AS i)""",
)
def box_iou(spark: SparkSession, d: str) -> DataFrame:
    a = _boxes(spark, d)
    b = a.select("image", (F.col("ix") - 1).alias("ix"), F.col("box").alias("next"))
    j = a.join(b, ["image", "ix"])
    return j.select("image", "ix", F.round(geo.iou(F.col("box"), F.col("next")), 6).alias("iou"), geo.point_in_box(geo.centre(F.col("box")), F.col("next")).alias("inside"))


@query("coco_convert", f"SELECT image, ix, round(x + w, 6) AS x2, round(y + h, 6) AS y2, round(w, 6) AS w_back, round(w * h, 4) AS area FROM ({RAW})")
def coco_convert(spark: SparkSession, d: str) -> DataFrame:
    b = _raw(spark, d).withColumn("c", geo.xyxy(F.col("xywh"))).withColumn("back", geo.xywh(F.col("c")))
    return b.select("image", "ix", F.round(F.col("c")[2], 6).alias("x2"), F.round(F.col("c")[3], 6).alias("y2"), F.round(F.col("back")[2], 6).alias("w_back"), F.round(F.col("xywh")[2] * F.col("xywh")[3], 4).alias("area"))


@query("denormalize", f"WITH {BOX} SELECT image, ix, round(x1 * 640, 4) AS px, round(y1 * 480, 4) AS py FROM box")
def denormalize(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d).withColumn("p", geo.denormalize(F.col("box"), F.lit(640.0), F.lit(480.0)))
    return b.select("image", "ix", F.round(F.col("p")[0], 4).alias("px"), F.round(F.col("p")[1], 4).alias("py"))


SHIFT = "(l_suppkey % 7) * 0.006::DOUBLE"
#: Line numbers repeat within an order, so the boxes of an image are numbered anew before they are matched.
UNIQUE = f"""every AS (SELECT * FROM ({UNIT}) WHERE x2 > x1 AND y2 > y1),
  box AS (SELECT image, row_number() OVER (PARTITION BY image ORDER BY ix, l_suppkey, label, x1, y1, x2, y2) AS ix, label, l_suppkey, x1, y1, x2, y2 FROM every)"""
CAND = f"""{UNIQUE}, pred AS (SELECT image, ix, label, x1 + {SHIFT} AS x1, y1, x2 + {SHIFT} AS x2, y2 FROM box WHERE ix % 4 <> 0),
  cand AS (SELECT * FROM (SELECT p.image, p.ix AS pred, g.ix AS gold, round({IOU.format(a='p', b='g')}, 9) AS score FROM pred p JOIN box g ON p.image = g.image AND p.label = g.label, LATERAL (SELECT {INTER.format(a='p', b='g')} AS i)) WHERE score > 0)"""
MATCH = f"""{CAND}, th AS (SELECT unnest({{ths}})::DOUBLE AS iou),
  o AS (SELECT iou, image, pred, gold, row_number() OVER (PARTITION BY iou, image ORDER BY score DESC, pred, gold) AS k FROM cand JOIN th ON score >= iou),
  m AS (SELECT iou, image, k, [pred] AS ps, [gold] AS gs FROM o WHERE k = 1
    UNION ALL SELECT o.iou, o.image, o.k, CASE WHEN f THEN list_append(ps, pred) ELSE ps END, CASE WHEN f THEN list_append(gs, gold) ELSE gs END
    FROM m JOIN o ON o.iou = m.iou AND o.image = m.image AND o.k = m.k + 1, LATERAL (SELECT NOT list_contains(ps, pred) AND NOT list_contains(gs, gold) AS f)),
  n AS (SELECT iou, image, max(len(ps)) AS n FROM m GROUP BY iou, image)"""


def _predictions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    order = Window.partitionBy("image").orderBy("ix", "l_suppkey", "label", *[F.col("box")[i] for i in range(4)])
    gold = _boxes(spark, d).withColumn("ix", F.row_number().over(order))
    by = (F.col("l_suppkey") % 7) * 0.006
    moved = F.array(F.col("box")[0] + by, F.col("box")[1], F.col("box")[2] + by, F.col("box")[3])
    return gold.filter("ix % 4 != 0").withColumn("box", moved), gold


def _candidates(pred: DataFrame, gold: DataFrame) -> DataFrame:
    p = pred.select("image", "label", F.col("ix").alias("pred"), F.col("box").alias("pb"))
    g = gold.select("image", "label", F.col("ix").alias("gold"), F.col("box").alias("gb"))
    c = p.join(g, ["image", "label"]).withColumn("score", F.round(geo.iou(F.col("pb"), F.col("gb")), 9))
    return c.filter("score > 0").select("image", "label", "pred", "gold", "score")


@query("box_match", f"WITH RECURSIVE {MATCH.format(ths=[0.5])} SELECT image, n::INT AS n FROM n")
def box_match(spark: SparkSession, d: str) -> DataFrame:
    taken = metrics.greedy_matches(_candidates(*_predictions(spark, d)).filter("score >= 0.5"), ["image"])
    return taken.groupBy("image").agg(F.count("*").cast("int").alias("n"))


F1 = "round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / (tp + fn)::DOUBLE) ELSE 0 END, 6)"
MATCHED = f"""{MATCH.format(ths=IOUS)}, t AS (SELECT th.iou, coalesce(sum(n), 0)::BIGINT AS tp FROM th LEFT JOIN n USING (iou) GROUP BY th.iou),
        f AS (SELECT iou, tp, (SELECT count(*) FROM pred) - tp AS fp, (SELECT count(*) FROM box) - tp AS fn FROM t)"""


def _grounding(spark: SparkSession, d: str, by: list[str]) -> DataFrame:
    pred, gold = _predictions(spark, d)
    matches = metrics.greedy_matches(_candidates(pred, gold).filter(F.col("score") >= min(IOUS)), ["image", "label"])
    return metrics.with_prf(metrics.grounding_counts(matches, pred, gold, IOUS, by))


@query("grounding_f1", f"WITH RECURSIVE {MATCHED} SELECT iou, tp, fp, fn, {F1} AS f1 FROM f")
def grounding_f1(spark: SparkSession, d: str) -> DataFrame:
    return _grounding(spark, d, []).select("iou", "tp", "fp", "fn", "f1")


@query("f1_iou_avg", f"WITH RECURSIVE {MATCHED} SELECT round(avg(f1), 7) AS f1_iou_avg FROM (SELECT {F1} AS f1 FROM f)")
def f1_iou_avg(spark: SparkSession, d: str) -> DataFrame:
    return _grounding(spark, d, []).agg(F.round(F.avg("f1"), 7).alias("f1_iou_avg"))


@query(
    "grounding_by_label",
    f"""WITH RECURSIVE {CAND}, o AS (SELECT image, c.pred, gold, p.label, row_number() OVER (PARTITION BY image ORDER BY score DESC, c.pred, gold) AS k
          FROM cand c JOIN (SELECT image, ix, label FROM pred) p USING (image) WHERE p.ix = c.pred AND score >= 0.5),
      m AS (SELECT image, k, [pred] AS ps, [gold] AS gs, [label] AS ls FROM o WHERE k = 1
        UNION ALL SELECT o.image, o.k, CASE WHEN f THEN list_append(ps, pred) ELSE ps END, CASE WHEN f THEN list_append(gs, gold) ELSE gs END, CASE WHEN f THEN list_append(ls, label) ELSE ls END
        FROM m JOIN o ON o.image = m.image AND o.k = m.k + 1, LATERAL (SELECT NOT list_contains(ps, pred) AND NOT list_contains(gs, gold) AS f)),
      t AS (SELECT label, count(*) AS tp FROM (SELECT unnest(ls) AS label FROM (SELECT arg_max(ls, k) AS ls FROM m GROUP BY image)) GROUP BY label),
      f AS (SELECT label, coalesce(tp, 0) AS tp, np - coalesce(tp, 0) AS fp, ng - coalesce(tp, 0) AS fn FROM (SELECT label, count(*) AS ng FROM box GROUP BY label)
            LEFT JOIN (SELECT label, count(*) AS np FROM pred GROUP BY label) USING (label) LEFT JOIN t USING (label))
    SELECT label, tp, fp, fn, {F1} AS f1 FROM f""",
)
def grounding_by_label(spark: SparkSession, d: str) -> DataFrame:
    return _grounding(spark, d, ["label"]).filter("iou = 0.5").select("label", "tp", "fp", "fn", "f1")


@query(
    "point_match",
    f"""WITH {BOX}, c AS (SELECT image, ix, label, (x1 + x2) / 2 AS px, (y1 + y2) / 2 AS py, x1, y1, x2, y2 FROM box),
      s AS (SELECT a.image, a.ix, b.ix AS gold, CASE WHEN b.ix % 2 = 0 THEN CASE WHEN a.px BETWEEN b.x1 AND b.x2 AND a.py BETWEEN b.y1 AND b.y2 THEN 1.0::DOUBLE ELSE 0 END
          WHEN sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2) <= 0.05::DOUBLE THEN 1 - sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2) / 0.05::DOUBLE ELSE 0 END AS score
        FROM c a JOIN c b ON a.image = b.image AND a.label = b.label AND a.ix <> b.ix)
    SELECT image, ix, gold, round(score, 6) AS score FROM s WHERE score > 0""",
)
def point_match(spark: SparkSession, d: str) -> DataFrame:
    """Points against golds of which the even ones keep their box and the odd ones are points."""
    b = _boxes(spark, d).withColumn("point", geo.centre(F.col("box")))
    p = b.select("image", "label", "ix", F.struct(F.lit(None).cast("array<double>").alias("box"), "point").alias("p"))
    g = b.select("image", "label", F.col("ix").alias("gold"), F.struct(F.when(F.col("ix") % 2 == 0, F.col("box")).alias("box"), "point").alias("g"))
    s = p.join(g, ["image", "label"]).filter("ix != gold").withColumn("score", geo.pair_score(F.col("p"), F.col("g"), "point"))
    return s.filter("score > 0").select("image", "ix", "gold", F.round("score", 6).alias("score"))


COCO = f"""{CAND}, th AS (SELECT unnest({IOUS})::DOUBLE AS iou),
  det AS (SELECT image, label, ix AS pred, ((image * 31 + ix * 7) % 1000) / 1000.0::DOUBLE AS det_score FROM pred),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY image, label ORDER BY det_score DESC, pred) AS rank FROM det),
  o AS (SELECT th.iou, c.image, d.label, c.pred, gold, det_score, rank, row_number() OVER (PARTITION BY th.iou, c.image, d.label ORDER BY det_score DESC, c.pred, score DESC, gold) AS k
        FROM cand c JOIN ranked d ON d.image = c.image AND d.pred = c.pred JOIN th ON score >= th.iou WHERE rank <= 100),
  m AS (SELECT iou, image, label, k, [pred] AS ps, [gold] AS gs FROM o WHERE k = 1
    UNION ALL SELECT o.iou, o.image, o.label, o.k, CASE WHEN f THEN list_append(ps, pred) ELSE ps END, CASE WHEN f THEN list_append(gs, gold) ELSE gs END
    FROM m JOIN o ON o.iou = m.iou AND o.image = m.image AND o.label = m.label AND o.k = m.k + 1, LATERAL (SELECT NOT list_contains(ps, pred) AND NOT list_contains(gs, gold) AS f)),
  hit AS (SELECT h.iou, h.image, h.label, r.det_score, r.rank FROM (SELECT iou, image, label, unnest(ps) AS pred FROM (SELECT iou, image, label, arg_max(ps, k) AS ps FROM m GROUP BY ALL)) h JOIN ranked r ON r.image = h.image AND r.pred = h.pred),
  ng AS (SELECT label, count(*) AS n_gold FROM box GROUP BY label),
  said AS (SELECT label, det_score, count(*) AS n FROM ranked WHERE rank <= 100 GROUP BY ALL),
  hs AS (SELECT label, iou, det_score, count(*) AS hit FROM hit GROUP BY ALL),
  run AS (SELECT s.label, th.iou, sum(coalesce(hit, 0)) OVER w AS tp, sum(n) OVER w AS said FROM said s CROSS JOIN th LEFT JOIN hs ON hs.label = s.label AND hs.iou = th.iou AND hs.det_score = s.det_score
          WINDOW w AS (PARTITION BY s.label, th.iou ORDER BY s.det_score DESC)),
  top AS (SELECT label, iou, floor(tp * 100 / n_gold + 1e-9)::INT AS at, max(tp / said) AS p FROM run JOIN ng USING (label) GROUP BY ALL),
  env AS (SELECT g.label, th.iou, coalesce(max(p) OVER (PARTITION BY g.label, th.iou ORDER BY g.at DESC), 0) AS e FROM (SELECT label, unnest(range(101)) AS at FROM ng) g CROSS JOIN th LEFT JOIN top ON top.label = g.label AND top.iou = th.iou AND top.at = g.at),
  ap AS (SELECT label, iou, round(sum(e) / 101, 6) AS ap FROM env GROUP BY ALL),
  ar AS (SELECT label, k AS most, round((SELECT count(*) FROM hit WHERE hit.label = ng.label AND rank <= k) / (n_gold * 10.0), 6) AS ar FROM ng, (SELECT unnest([1, 10, 100]) AS k))"""


def _coco(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pred, gold = _predictions(spark, d)
    score = (F.pmod(F.col("image") * 31 + F.col("ix") * 7, F.lit(1000)) / 1000.0).alias("det_score")
    det = pred.select("image", "label", F.col("ix").alias("pred"), score)
    hits = metrics.coco_hits(_candidates(pred, gold).withColumnRenamed("score", "iou"), det, "image", "label")
    return hits, gold.groupBy("label").agg(F.count("*").alias("n_gold"))


@query("coco_map", f"WITH RECURSIVE {COCO} SELECT label, iou, ap FROM ap")
def coco_map(spark: SparkSession, d: str) -> DataFrame:
    """Average precision by label at the ten IoUs."""
    return metrics.coco_average_precision(*_coco(spark, d), "label")


@query(
    "map_summary",
    f"""WITH RECURSIVE {COCO} SELECT 'map' AS metric, round(avg(ap), 6) AS value FROM ap UNION ALL SELECT 'map_50', round(avg(ap), 6) FROM ap WHERE iou = 0.5::DOUBLE UNION ALL SELECT 'map_75', round(avg(ap), 6) FROM ap WHERE iou = 0.75::DOUBLE
        UNION ALL SELECT 'mar_' || most, round(avg(ar), 6) FROM ar GROUP BY most UNION ALL SELECT 'map_' || label, round(avg(ap), 6) FROM ap GROUP BY label""",
)
def map_summary(spark: SparkSession, d: str) -> DataFrame:
    hits, n_gold = _coco(spark, d)
    return metrics.map_summary(metrics.coco_average_precision(hits, n_gold, "label"), metrics.coco_average_recall(hits, n_gold, "label"), "label")
