"""Metrics as aggregations: spans, retrieval, classification, text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import text as tx


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, 0 for an empty denominator."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; each 0 where it has no denominator."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, harmonic(p, r)


def harmonic(a: Column, b: Column) -> Column:
    """Harmonic mean, 0 if both are 0."""
    return ratio(2 * a * b, a + b)


def f_beta(p: Column, r: Column, beta: float) -> Column:
    """F with recall weighted ``beta`` times."""
    return ratio((1 + beta * beta) * p * r, beta * beta * p + r)


def span_counts(pred: DataFrame, gold: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """``(by, tp, fp, fn)`` of exact matches; repeated triples count once."""
    p = pred.select(*keys).distinct().withColumn("_p", F.lit(1))
    g = gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    both = p.join(g, keys, "full_outer")
    counts = [F.count_if(F.col("_p").isNotNull() & F.col("_g").isNotNull()).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn")]
    return both.groupBy(*(by or [])).agg(*counts)


def with_prf(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 beside ``tp, fp, fn``, to six places."""
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


def threshold_sweep(pred: DataFrame, gold: DataFrame, keys: list[str], thresholds: list[float], score: str = "score") -> DataFrame:
    """``(threshold, tp, fp, fn, precision, recall, f1)``: predictions of at least each threshold.

    Predictions meet the gold once; each then counts at the thresholds up to its score.
    """
    p = pred.groupBy(*keys).agg(F.max(score).alias("_s"))
    g = gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    hit = p.join(g, keys, "left")
    levels = F.explode(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t <= F.col("_s")))
    at = hit.select(levels.alias("threshold"), F.col("_g")).groupBy("threshold").agg(F.count("_g").alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"))
    total = g.agg(F.count("*").alias("_n"))
    every = gold.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double").join(at, "threshold", "left").na.fill(0)
    return with_prf(every.crossJoin(F.broadcast(total)).select("threshold", "tp", "fp", (F.col("_n") - F.col("tp")).alias("fn")))  # one row of totals


def best_threshold(sweep: DataFrame, objective: str = "f1") -> DataFrame:
    """The row with the highest objective, the higher threshold among ties."""
    return sweep.orderBy(F.desc(objective), F.desc("threshold")).limit(1)


def class_report(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """``(label, support, precision, recall, f1)`` for each class, to four places."""
    c = df.groupBy(F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    tp = c.filter("g = p").select(F.col("g").alias("label"), F.col("n").alias("tp"))
    sup = c.groupBy(F.col("g").alias("label")).agg(F.sum("n").alias("support"))
    said = c.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("said"))
    j = sup.join(said, "label", "full_outer").join(tp, "label", "left").na.fill(0, ["support", "said", "tp"])
    p, r = ratio(F.col("tp"), F.col("said")), ratio(F.col("tp"), F.col("support"))
    return j.select("label", "support", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(harmonic(p, r), 4).alias("f1"))


def class_summary(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """``(n, accuracy, weighted_f1)``."""
    c = df.groupBy(F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    said = c.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("said"))
    by = c.groupBy(F.col("g").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    j = by.join(said, "label", "left").na.fill(0, ["said"])
    f1 = harmonic(ratio(F.col("tp"), F.col("said")), ratio(F.col("tp"), F.col("support")))
    total = F.sum("support")
    return j.agg(total.alias("n"), F.round(F.sum("tp") / total, 6).alias("accuracy"), F.round(F.sum(f1 * F.col("support")) / total, 6).alias("weighted_f1"))


def text_scores(df: DataFrame, key: str, pred: str, gold: str) -> DataFrame:
    """``(key, em, f1)``: equality up to white space, and F1 of the words as multisets; a null text is empty."""
    squash = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    src = df.select(F.col(key), squash(pred).alias("_p"), squash(gold).alias("_g"))
    n = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, " ")))
    same = src.withColumn("_same", tx.shared_words(F.col("_p"), F.col("_g")))
    f1 = harmonic(ratio(F.col("_same"), n("_p")), ratio(F.col("_same"), n("_g")))
    return same.select(key, (F.col("_p") == F.col("_g")).cast("int").alias("em"), F.round(f1, 6).alias("f1"))


def text_summary(scores: DataFrame) -> DataFrame:
    """``(n, exact_match, token_f1)`` of a corpus: means of the rows of ``text_scores``; 0 without rows."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return scores.agg(F.count("*").alias("n"), mean("em").alias("exact_match"), mean("f1").alias("token_f1"))


def retrieval_metrics(queries: DataFrame, hits: DataFrame, positives: DataFrame, k: int = 10) -> DataFrame:
    """MRR, NDCG, accuracy, precision, recall and MAP at ``k`` with one right answer a query; no hit counts as 0."""
    return rank_metrics(queries, hits.filter(F.col("rank") <= k).join(positives, ["qid", "cid"]).groupBy("qid").agg(F.min("rank").alias("r")), k)


def rank_metrics(queries: DataFrame, found: DataFrame, k: int = 10) -> DataFrame:
    """The same of ``(qid, r)``, the rank of the right answer of each query that has it among its first ``k``."""
    per = queries.select("qid").join(found, "qid", "left")
    r, hit = F.col("r"), F.col("r").isNotNull()
    mean = lambda c, name: F.round(F.avg(F.when(hit, c).otherwise(0.0)), 6).alias(name)
    return per.agg(
        F.count("*").alias("n"), mean(1 / r, "mrr"), mean(1 / F.log2(r + 1), "ndcg"), mean(F.lit(1.0), "accuracy"), mean(F.lit(1.0 / k), "precision"), mean(F.lit(1.0), "recall"), mean(1 / r, "map")
    )


def metric_delta(base: DataFrame, tuned: DataFrame, on: str) -> DataFrame:
    """``(on, base, tuned, delta)`` of two ``(on, value)`` frames."""
    j = base.select(on, F.col("value").alias("base")).join(tuned.select(on, F.col("value").alias("tuned")), on)
    return j.withColumn("delta", F.round(F.col("tuned") - F.col("base"), 6))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("pred", T.LongType()), T.StructField("gold", T.LongType()), T.StructField("score", T.DoubleType())])))
def _greedy(groups: pa.Array) -> pa.Array:
    out = []
    for group in groups.to_pylist():
        preds, golds, taken = set(), set(), []
        for c in sorted(group, key=lambda c: (-c["score"], c["pred"], c["gold"])):
            if c["pred"] not in preds and c["gold"] not in golds:
                preds.add(c["pred"])
                golds.add(c["gold"])
                taken.append(c)
        out.append(taken)
    return pa.array(out, pa.list_(pa.struct([("pred", pa.int64()), ("gold", pa.int64()), ("score", pa.float64())])))


def greedy_matches(candidates: DataFrame, group: list[str]) -> DataFrame:
    """``(group, pred, gold, score)``: one-to-one matches taken by falling ``score``, then ``pred``, then ``gold``.

    A group's candidates, those of one image, are gathered in one row.  What is
    matched at a threshold are the matches of at least it: a candidate below
    comes after all above and takes nothing from them, so one pass serves all
    thresholds.
    """
    each = F.struct(F.col("pred").cast("bigint").alias("pred"), F.col("gold").cast("bigint").alias("gold"), F.col("score").cast("double").alias("score"))
    taken = candidates.groupBy(*group).agg(F.collect_list(each).alias("_c")).select(*group, F.explode(_greedy("_c")).alias("m"))
    return taken.select(*group, "m.pred", "m.gold", "m.score")


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("pred", T.LongType()), T.StructField("level", T.IntegerType())])))
def _best_gold(groups: pa.Array, levels: pa.Array) -> pa.Array:
    out = []
    for group, thresholds in zip(groups.to_pylist(), levels.to_pylist()):
        ordered = sorted(group, key=lambda c: (-c["det_score"], c["pred"], -c["iou"], c["gold"]))
        hits = []
        for i, least in enumerate(thresholds):
            golds, last = set(), None
            for c in ordered:
                if c["iou"] >= least and c["pred"] != last and c["gold"] not in golds:
                    golds.add(c["gold"])
                    last = c["pred"]
                    hits.append({"pred": last, "level": i})
        out.append(hits)
    return pa.array(out, pa.list_(pa.struct([("pred", pa.int64()), ("level", pa.int32())])))


def matched_detections(candidates: DataFrame, group: list[str], levels: list[float]) -> DataFrame:
    """``(group, pred, iou)``: at each level of ``iou``, by falling detection score, each detection takes its best free gold.

    ``candidates`` has ``pred, det_score, gold, iou``; a group is one label of one image.
    """
    each = F.struct(F.col("pred").cast("bigint").alias("pred"), "det_score", F.col("gold").cast("bigint").alias("gold"), "iou")
    at = F.array(*[F.lit(x) for x in levels])
    hits = candidates.filter(F.col("iou") >= min(levels)).groupBy(*group).agg(F.collect_list(each).alias("_c")).select(*group, F.explode(_best_gold("_c", at)).alias("h"))
    return hits.select(*group, "h.pred", F.element_at(at, F.col("h.level") + 1).alias("iou"))


def average_precision(marked: DataFrame, n_gold: DataFrame, group: list[str], buckets: int = 512) -> DataFrame:
    """``(group, ap)`` by 101-point interpolation of ``(group, det_score in [0, 1], hit)``; -1 without gold.

    A column ``n`` says how many detections a row stands for.  Detections of one
    score count together, their order among themselves is no ranking.  Running
    counts add up from score buckets, so no class is ordered in one task.
    """
    n = F.sum("n") if "n" in marked.columns else F.count("*")
    m = marked.groupBy(*group, "det_score").agg(F.sum("hit").alias("hit"), n.alias("n"))
    m = m.withColumn("_b", F.least(F.floor(F.col("det_score") * buckets), F.lit(buckets - 1)))
    sums = m.groupBy(*group, "_b").agg(F.sum("hit").alias("_h"), F.sum("n").alias("_c"))
    above = Window.partitionBy(*group).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*group, "_b", F.coalesce(F.sum("_h").over(above), F.lit(0)).alias("_h0"), F.coalesce(F.sum("_c").over(above), F.lit(0)).alias("_c0"))
    inside = Window.partitionBy(*group, "_b").orderBy(F.desc("det_score"))
    run = m.join(base, [*group, "_b"]).withColumn("tp", F.col("_h0") + F.sum("hit").over(inside)).withColumn("said", F.col("_c0") + F.sum("n").over(inside))
    points = run.join(n_gold, group).withColumn("at", F.floor(F.col("tp") * 100 / F.col("n_gold") + 1e-9).cast("int"))
    top = points.groupBy(*group, "at").agg(F.max(F.col("tp") / F.col("said")).alias("p"))
    grid = n_gold.select(*group, F.explode(F.sequence(F.lit(0), F.lit(100))).alias("at")).join(top, [*group, "at"], "left")
    better = Window.partitionBy(*group).orderBy(F.desc("at"))
    envelope = grid.withColumn("e", F.coalesce(F.max("p").over(better.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    ap = envelope.groupBy(*group).agg(F.sum("e").alias("s")).join(n_gold, group)
    return ap.select(*group, F.when(F.col("n_gold") > 0, F.round(F.col("s") / 101, 6)).otherwise(F.lit(-1.0)).alias("ap"))


COCO_IOUS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
MOST_DETECTIONS = (1, 10, 100)


def coco_hits(candidates: DataFrame, detections: DataFrame, image: str, label: str, levels: tuple[float, ...] = COCO_IOUS, most: int = 100) -> DataFrame:
    """``(image, label, pred, det_score, rank, iou)``: a row for each level at which a detection is a hit, and one with null ``iou`` for itself.

    ``detections`` has ``image, label, pred, det_score``, ``candidates`` their
    ``gold`` and ``iou`` besides.  Only the ``most`` best detections of a label
    in an image count, as the metric has it.
    """
    by = Window.partitionBy(image, label).orderBy(F.desc("det_score"), "pred")
    ranked = detections.select(image, label, F.col("pred").cast("bigint").alias("pred"), "det_score").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most)
    meant = candidates.select(image, label, F.col("pred").cast("bigint").alias("pred"), "gold", "iou").join(ranked, [image, label, "pred"])
    hits = matched_detections(meant, [image, label], list(levels)).join(ranked, [image, label, "pred"])
    columns = [image, label, "pred", "det_score", "rank", "iou"]
    return hits.select(*columns).unionByName(ranked.withColumn("iou", F.lit(None).cast("double")).select(*columns))


def coco_average_precision(hits: DataFrame, n_gold: DataFrame, label: str, levels: tuple[float, ...] = COCO_IOUS) -> DataFrame:
    """``(label, iou, ap)`` of the rows of ``coco_hits``; ``n_gold`` has ``label, n_gold``."""
    counted = hits.groupBy(label, "det_score", "iou").agg(F.count("*").alias("c"))
    said = counted.filter("iou IS NULL").select(label, "det_score", F.col("c").alias("n"))
    every = F.explode(F.array(*[F.lit(x) for x in levels]))
    marked = said.withColumn("iou", every).join(counted.filter("iou IS NOT NULL").withColumnRenamed("c", "hit"), [label, "det_score", "iou"], "left").na.fill(0, ["hit"])
    return average_precision(marked, n_gold.withColumn("iou", every), [label, "iou"])


def coco_average_recall(hits: DataFrame, n_gold: DataFrame, label: str, levels: tuple[float, ...] = COCO_IOUS) -> DataFrame:
    """``(label, most, ar)``: recall with the best 1, 10 and 100 detections of an image, mean over the levels."""
    ks = F.explode(F.filter(F.array(*[F.lit(k) for k in MOST_DETECTIONS]), lambda k: k >= F.col("rank")))
    found = hits.filter("iou IS NOT NULL").select(label, ks.alias("most")).groupBy(label, "most").agg(F.count("*").alias("c"))
    every = n_gold.withColumn("most", F.explode(F.array(*[F.lit(k) for k in MOST_DETECTIONS]))).join(found, [label, "most"], "left").na.fill(0, ["c"])
    recall = F.round(F.col("c") / (F.col("n_gold") * len(levels)), 6)
    return every.select(label, "most", F.when(F.col("n_gold") > 0, recall).otherwise(F.lit(-1.0)).alias("ar"))


def map_summary(ap: DataFrame, ar: DataFrame, label: str) -> DataFrame:
    """``(metric, value)``: map, map_50, map_75, mar_1, mar_10, mar_100 and map_<label>; -1 where there is no data.

    One label alone gives the same rows as several do.
    """
    a, r = ap.filter("ap >= 0"), ar.filter("ar >= 0")
    value = lambda c: F.coalesce(F.round(F.avg(c), 6), F.lit(-1.0)).alias("value")
    rows = [a.agg(F.lit("map").alias("metric"), value("ap"))]
    rows += [a.filter(F.abs(F.col("iou") - t / 100) < 1e-9).agg(F.lit(f"map_{t}").alias("metric"), value("ap")) for t in (50, 75)]
    rows += [r.filter(F.col("most") == k).agg(F.lit(f"mar_{k}").alias("metric"), value("ar")) for k in MOST_DETECTIONS]
    out = a.groupBy(F.concat(F.lit("map_"), F.col(label)).alias("metric")).agg(value("ap"))
    for row in rows:
        out = out.unionByName(row)
    return out


def grounding_counts(matches: DataFrame, pred: DataFrame, gold: DataFrame, levels: list[float], by: list[str]) -> DataFrame:
    """``(iou, by, tp, fp, fn)`` at each level of the rows of ``greedy_matches``; predictions and golds are counted ``by`` as well."""
    reached = F.explode(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x <= F.col("score")))
    tp = matches.select(*by, reached.alias("iou")).groupBy(*by, "iou").agg(F.count("*").alias("tp"))
    sizes = pred.select(*by, F.lit(1).alias("p"), F.lit(0).alias("g")).unionAll(gold.select(*by, F.lit(0), F.lit(1))).groupBy(*by).agg(F.sum("p").alias("n_pred"), F.sum("g").alias("n_gold"))
    every = sizes.withColumn("iou", F.explode(F.array(*[F.lit(x) for x in levels]))).join(tp, [*by, "iou"], "left").na.fill(0, ["tp"])
    return every.select(*by, "iou", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gold") - F.col("tp")).alias("fn"))
