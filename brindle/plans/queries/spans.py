"""Contracts, folds, windows, BIO tags and vocabularies of span corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import jsonx
from brindle.functions import spans as sp
from brindle.functions import text as tx
from brindle.operators import chunking, spanops
from brindle.plans.durable import spread, table
from brindle.plans.registry import query

LABELS = ["EMAIL", "PHONE", "PERSON", "STREET"]
HOLDOUT = ["SOCIALNUM", "TAXNUM"]
FLAT = 'SELECT ann_id, text, s."start" AS a, s."end" AS b, s.label AS label FROM (SELECT ann_id, text, unnest(spans) AS s FROM annotated)'
GOOD = f"SELECT * FROM ({FLAT}) WHERE a >= 0 AND a < b AND b <= length(text)"
#: In-range spans in order, numbered; the base of the folds written as recursions.
ORDERED = f"o AS (SELECT ann_id, a, b, label, row_number() OVER (PARTITION BY ann_id ORDER BY a, b, label NULLS FIRST) AS i FROM ({GOOD}))"
DEDUP = f"""{ORDERED}, d AS (
   SELECT ann_id, i, a, b, label, b AS last, true AS keep FROM o WHERE i = 1
   UNION ALL SELECT o.ann_id, o.i, o.a, o.b, o.label, CASE WHEN d.last <= o.a THEN o.b ELSE d.last END, d.last <= o.a FROM d JOIN o ON o.ann_id = d.ann_id AND o.i = d.i + 1)"""


def _annotated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "annotated", "ann_id", "text", "spans")


def _good(spark: SparkSession, d: str) -> DataFrame:
    df = _annotated(spark, d).filter("text IS NOT NULL")
    return df.withColumn("spans", sp.in_range(F.col("spans"), F.col("text")))


def _rows(df: DataFrame, spans: str = "spans", key: str = "ann_id") -> DataFrame:
    return df.select(key, F.explode(spans).alias("s")).select(key, F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"), F.col("s.label").alias("label"))


@query("parse_spans", f"SELECT ann_id, a AS start_pos, b AS end_pos, label FROM ({FLAT})")
def parse_spans(spark: SparkSession, d: str) -> DataFrame:
    raw = _annotated(spark, d).select("ann_id", F.to_json("spans", {"ignoreNullFields": "false"}).alias("raw"))
    python_form = F.regexp_replace(F.replace("raw", F.lit('"'), F.lit("'")), ":null", ": None")
    return _rows(raw.select("ann_id", jsonx.spans(python_form).alias("spans")))


@query("span_filter", f"SELECT ann_id, a AS start_pos, b AS end_pos, label FROM ({GOOD}) WHERE label IN ('EMAIL', 'PHONE', 'PERSON', 'STREET')")
def span_filter(spark: SparkSession, d: str) -> DataFrame:
    df = _annotated(spark, d)
    return _rows(df.select("ann_id", sp.in_range(F.col("spans"), F.col("text"), LABELS).alias("spans")))


@query(
    "validate_spans",
    """SELECT ann_id, ix AS span_ix, error FROM (
         SELECT ann_id, ix, unnest(list_filter([CASE WHEN coalesce(s."start" < 0, true) THEN 'start >= 0' END, CASE WHEN coalesce(s."end" <= s."start", true) THEN 'end > start' END,
            CASE WHEN coalesce(s."end" > length(text), true) THEN 'end <= len(text)' END, CASE WHEN coalesce(trim(s.label), '') = '' THEN 'label' END], lambda e: e IS NOT NULL)) AS error
         FROM (SELECT ann_id, text, unnest(spans) AS s, unnest(range(len(spans)))::INT AS ix FROM annotated))""",
)
def validate_spans(spark: SparkSession, d: str) -> DataFrame:
    df = _annotated(spark, d).select("ann_id", F.explode(sp.violations(F.col("spans"), F.col("text"))).alias("e"))
    return df.select("ann_id", "e.span_ix", "e.error")


@query("span_dedup", f"WITH RECURSIVE {DEDUP} SELECT ann_id, a AS start_pos, b AS end_pos, label FROM d WHERE keep")
def span_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _rows(_good(spark, d).select("ann_id", sp.drop_overlaps(F.col("spans")).alias("spans")))


@query(
    "span_merge",
    f"""WITH RECURSIVE o AS (SELECT ann_id, a, b, coalesce(label, '') AS label, row_number() OVER (PARTITION BY ann_id ORDER BY a, b DESC, coalesce(label, '')) AS i
           FROM (SELECT ann_id, a, b + 40 AS b, CASE WHEN b - a > 12 THEN 'LONG' ELSE 'SHORT' END AS label FROM ({GOOD}))),
         m AS (SELECT ann_id, i, a, b, label, 1 AS g FROM o WHERE i = 1
           UNION ALL SELECT o.ann_id, o.i, CASE WHEN j THEN m.a ELSE o.a END, CASE WHEN j THEN greatest(m.b, o.b) ELSE o.b END, o.label, m.g + CASE WHEN j THEN 0 ELSE 1 END
           FROM m JOIN o ON o.ann_id = m.ann_id AND o.i = m.i + 1, LATERAL (SELECT m.label = o.label AND o.a <= m.b AS j))
       SELECT ann_id, min(a) AS start_pos, max(b) AS end_pos, min(label) AS label FROM m GROUP BY ann_id, g""",
)
def span_merge(spark: SparkSession, d: str) -> DataFrame:
    wide = F.transform(
        "spans", lambda s: F.struct(s["start"].alias("start"), (s["end"] + 40).alias("end"), F.when(s["end"] - s["start"] > 12, "LONG").otherwise("SHORT").alias("label"))
    )
    return _rows(_good(spark, d).select("ann_id", sp.merge_touching(wide).alias("spans")))


WORDS = r"""p AS (SELECT ann_id, text, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w, regexp_split_to_array(text, '[\p{L}\p{N}_]+') AS g FROM annotated WHERE text IS NOT NULL),
  u AS (SELECT ann_id, unnest(range(len(w))) AS ix, unnest(w) AS tok, unnest(g[1:len(w)]) AS gap FROM p),
  t AS (SELECT ann_id, ix, tok, (sum(length(gap) + length(tok)) OVER (PARTITION BY ann_id ORDER BY ix) - length(tok))::INT AS a, (sum(length(gap) + length(tok)) OVER (PARTITION BY ann_id ORDER BY ix))::INT AS b FROM u)"""
#: Spans that no label names are left out before words meet them.
LABELLED = f"o AS (SELECT ann_id, a, b, label, row_number() OVER (PARTITION BY ann_id ORDER BY a, b, label) AS i FROM ({GOOD}) WHERE label IS NOT NULL)"
BIO = f"""{WORDS}, {LABELLED},
  h AS (SELECT t.ann_id, t.ix, t.a, t.b, min(o.i) AS i FROM t LEFT JOIN o ON o.ann_id = t.ann_id AND o.b > t.a AND o.a < t.b GROUP BY t.ann_id, t.ix, t.a, t.b),
  bio AS (SELECT h.ann_id, ix, h.a, h.b, CASE WHEN h.i IS NULL OR o.label IS NULL THEN 'O' WHEN lag(h.i) OVER (PARTITION BY h.ann_id ORDER BY ix) = h.i THEN 'I-' || o.label ELSE 'B-' || o.label END AS tag
          FROM h LEFT JOIN o ON o.ann_id = h.ann_id AND o.i = h.i)"""


def _bio(spark: SparkSession, d: str, marked_only: bool = False) -> DataFrame:
    df = spread(_good(spark, d)).withColumn("spans", sp.in_order(F.col("spans"))).withColumn("tokens", tx.tokens_with_offsets(F.col("text")))
    rows = F.transform(F.arrays_zip(F.col("tokens").alias("t"), sp.bio_tags(F.col("tokens"), F.col("spans")).alias("tag")), lambda z, i: F.struct(i.cast("bigint").alias("ix"), z["t"]["start"].alias("start_pos"), z["t"]["end"].alias("end_pos"), z["tag"].alias("tag")))
    return df.select("ann_id", F.explode(F.filter(rows, lambda r: r["tag"] != "O") if marked_only else rows).alias("r")).select("ann_id", "r.*")


@query("bio_align", f"WITH {BIO} SELECT ann_id, ix, tag FROM bio WHERE tag <> 'O'")
def bio_align(spark: SparkSession, d: str) -> DataFrame:
    return _bio(spark, d, marked_only=True).select("ann_id", "ix", "tag")


@query(
    "bio_decode",
    f"""WITH {BIO}, l AS (SELECT *, CASE WHEN tag <> 'O' THEN substr(tag, 3) END AS label FROM bio),
      q AS (SELECT *, sum(CASE WHEN tag LIKE 'B-%' THEN 1 ELSE 0 END) OVER (PARTITION BY ann_id ORDER BY ix) AS k FROM l)
    SELECT ann_id, min(a) AS start_pos, max(b) AS end_pos, min(label) AS label FROM q WHERE nullif(label, '') IS NOT NULL GROUP BY ann_id, k""",
)
def bio_decode(spark: SparkSession, d: str) -> DataFrame:
    return spanops.decode_bio(_bio(spark, d), "ann_id", "ix", "tag", "start_pos", "end_pos")


CHUNKED = f"""{WORDS}, n AS (SELECT ann_id, count(*) AS n FROM t GROUP BY ann_id),
  k AS (SELECT ann_id, n, unnest(range(greatest(0, ceil((n - 384) / 320.0))::BIGINT + 1)) AS k FROM n),
  c AS (SELECT k.ann_id, k.k AS chunk_ix, CASE WHEN n <= 384 THEN 0 ELSE f.a END AS a, CASE WHEN n <= 384 THEN length(x.text)::INT ELSE l.b END AS b
        FROM k JOIN t f ON f.ann_id = k.ann_id AND f.ix = k * 320 JOIN t l ON l.ann_id = k.ann_id AND l.ix = least(k * 320 + 384, n) - 1 JOIN annotated x ON x.ann_id = k.ann_id)"""


@query("chunk_bounds", f"WITH {CHUNKED} SELECT c.ann_id, chunk_ix::INT AS chunk_ix, a AS start_pos, b AS end_pos, md5(substr(text, a + 1, b - a)) AS text_md5 FROM c JOIN annotated USING (ann_id)")
def chunk_bounds(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.span_chunks(_annotated(spark, d), "ann_id", "text", "spans")
    return c.select("ann_id", F.col("chunk_ix").cast("int").alias("chunk_ix"), "start_pos", "end_pos", F.md5("text").alias("text_md5"))


SPAN_CHUNKS = f"""{CHUNKED}, sc AS (SELECT c.ann_id, chunk_ix::INT AS chunk_ix, greatest(g.a, c.a) - c.a AS start_pos, least(g.b, c.b) - c.a AS end_pos, label, c.a AS base
  FROM c JOIN ({GOOD}) g ON g.ann_id = c.ann_id AND g.b > c.a AND g.a < c.b)"""


@query("span_chunks", f"WITH {SPAN_CHUNKS} SELECT ann_id, chunk_ix, start_pos, end_pos, label FROM sc")
def span_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.span_chunks(_annotated(spark, d), "ann_id", "text", "spans")
    e = c.select("ann_id", F.col("chunk_ix").cast("int").alias("chunk_ix"), F.explode("spans").alias("s"))
    return e.select("ann_id", "chunk_ix", F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"), F.col("s.label").alias("label"))


@query(
    "span_window",
    f"""WITH {WORDS}, {ORDERED} SELECT o.ann_id, o.a AS start_pos, o.b AS end_pos, min(ix)::INT AS first_token, max(ix)::INT AS last_token
        FROM (SELECT DISTINCT ann_id, a, b FROM o) o JOIN t ON t.ann_id = o.ann_id AND o.b > t.a AND o.a < t.b GROUP BY o.ann_id, o.a, o.b""",
)
def span_window(spark: SparkSession, d: str) -> DataFrame:
    df = _good(spark, d).withColumn("tokens", tx.tokens_with_offsets(F.col("text"))).withColumn("s", F.explode(F.array_distinct(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))))
    over = F.transform("tokens", lambda t, i: F.when((F.col("s.end") > t["start"]) & (F.col("s.start") < t["end"]), i))
    hit = df.select("ann_id", F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"), F.array_compact(over).alias("ix")).filter(F.size("ix") > 0)
    return hit.select("ann_id", "start_pos", "end_pos", F.array_min("ix").alias("first_token"), F.array_max("ix").alias("last_token"))


@query(
    "span_rebase",
    f"""WITH RECURSIVE {SPAN_CHUNKS}, x AS (SELECT DISTINCT ann_id, start_pos + base AS a, end_pos + base AS b, label FROM sc WHERE label IS NOT NULL),
         o2 AS (SELECT *, row_number() OVER (PARTITION BY ann_id ORDER BY a, b DESC, label) AS i FROM x),
         m AS (SELECT ann_id, i, a, b, label, 1 AS g FROM o2 WHERE i = 1
           UNION ALL SELECT o2.ann_id, o2.i, CASE WHEN j THEN m.a ELSE o2.a END, CASE WHEN j THEN greatest(m.b, o2.b) ELSE o2.b END, o2.label, m.g + CASE WHEN j THEN 0 ELSE 1 END
           FROM m JOIN o2 ON o2.ann_id = m.ann_id AND o2.i = m.i + 1, LATERAL (SELECT m.label = o2.label AND o2.a <= m.b AS j))
       SELECT ann_id, min(a) AS start_pos, max(b) AS end_pos, min(label) AS label FROM m GROUP BY ann_id, g""",
)
def span_rebase(spark: SparkSession, d: str) -> DataFrame:
    df = _annotated(spark, d).withColumn("spans", F.filter("spans", lambda s: s["label"].isNotNull()))
    return _rows(chunking.rebase(chunking.span_chunks(df, "ann_id", "text", "spans"), "ann_id", "spans", "start_pos"))


@query("label_vocab", f"SELECT DISTINCT label FROM ({FLAT}) WHERE label IS NOT NULL")
def label_vocab(spark: SparkSession, d: str) -> DataFrame:
    return spanops.vocabulary(_annotated(spark, d), "spans")


@query("holdout_partition", f"SELECT DISTINCT label, CASE WHEN label IN ('SOCIALNUM', 'TAXNUM') THEN 'holdout' ELSE 'train' END AS part FROM ({FLAT}) WHERE label IS NOT NULL")
def holdout_partition(spark: SparkSession, d: str) -> DataFrame:
    return spanops.vocabulary(_annotated(spark, d), "spans").withColumn("part", F.when(F.col("label").isin(HOLDOUT), "holdout").otherwise("train"))


@query("class_count", f"SELECT count(DISTINCT label) AS n_classes, count(*) FILTER (WHERE label = 'EMAIL') AS n_email FROM ({FLAT})")
def class_count(spark: SparkSession, d: str) -> DataFrame:
    s = _annotated(spark, d).select(F.explode("spans").alias("s"))
    return s.agg(F.countDistinct("s.label").alias("n_classes"), F.count_if(F.col("s.label") == "EMAIL").alias("n_email"))


@query("has_label", "SELECT ann_id, len(list_filter(spans, lambda s: s.label IN ('EMAIL', 'PHONE'))) > 0 AS has FROM annotated WHERE spans IS NOT NULL")
def has_label(spark: SparkSession, d: str) -> DataFrame:
    df = _annotated(spark, d).filter("spans IS NOT NULL")
    return df.select("ann_id", F.coalesce(F.exists("spans", lambda s: F.coalesce(s["label"].isin("EMAIL", "PHONE"), F.lit(False))), F.lit(False)).alias("has"))


@query("claim_span")
def claim_span(spark: SparkSession, d: str) -> DataFrame:
    """Spans found again from their values alone; no SQL, checked against a loop in the tests."""
    df = _good(spark, d)
    entities = F.transform(sp.in_order(F.col("spans")), lambda s: F.struct(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]).alias("value"), s["label"].alias("label")))
    return spanops.claim_spans(df.withColumn("entities", entities), "ann_id", "text", "entities")


@query(
    "word_vote",
    f"""WITH {BIO}, v AS (SELECT ann_id, ix // 3 AS word, ix, CASE WHEN tag = 'O' THEN 'O' ELSE substr(tag, 3) END AS base, ((ix * 37 + ann_id) % 100) / 100.0::DOUBLE AS score FROM bio),
      c AS (SELECT ann_id, word, base, count(*) AS n, min(ix) AS f, avg(score) AS mean FROM v GROUP BY ALL),
      b AS (SELECT *, max(n) OVER (PARTITION BY ann_id, word) AS top FROM c),
      e AS (SELECT *, count(*) OVER (PARTITION BY ann_id, word) AS tied FROM b WHERE n = top),
      r AS (SELECT *, row_number() OVER (PARTITION BY ann_id, word ORDER BY CASE WHEN tied > 1 AND base = 'O' THEN 1 ELSE 0 END, f) AS rn FROM e)
    SELECT ann_id, word, base AS label, round(mean, 6) AS score FROM r WHERE rn = 1 AND base <> 'O'""",
)
def word_vote(spark: SparkSession, d: str) -> DataFrame:
    b = _bio(spark, d)
    votes = b.select("ann_id", F.floor(F.col("ix") / 3).alias("word"), "ix", F.col("tag").alias("label"), (F.pmod(F.col("ix") * 37 + F.col("ann_id"), F.lit(100)) / 100.0).alias("score"))
    return spanops.vote_words(votes, ["ann_id", "word"]).filter("label != 'O'")
