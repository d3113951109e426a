"""Splits that keep related records together (problem 5).

Records relate through shared keys: author, issuing entity, source document.
Each key's records are tied to the smallest of them (one edge per record, never
all pairs), and components grow by Boruvka's contraction: every component takes
its lightest edge to another one, the chosen edges are contracted by pointer
jumping, and the edges left between different components go into the next
round.  Each round at least halves the number of components that still have an
edge, writes its part of the spanning forest and its contraction map to the
checkpoint folder and leaves no long lineage.  The roots are stratified by size
band and dealt systematically to the splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.plans.durable import cut

#: Words that stand for "no author" or "no entity", after normalisation.
FILLERS = (
    "", "n a", "na", "none", "null", "nil", "unknown", "anonymous", "anon", "editor", "editors", "staff", "admin",
    "author", "various", "tbd", "not available", "not applicable", "unbekannt", "anonym", "inconnu", "anonyme",
    "desconocido", "anonimo", "redaktion", "redaction", "redaccion", "misc", "other", "test", "no author", "issuer", "company",
)
#: Accented Latin letters and the letters they are compared as.
ACCENTED = "àáâãäåāăąçćčďèéêëēęěìíîïīłñńňòóôõöøōőřśšťùúûüūůűýÿźżž"
PLAIN = "aaaaaaaaacccdeeeeeeeiiiiilnnnoooooooorsstuuuuuuuyyzzz"
#: Spellings of a legal form and the form they are compared as.
LEGAL_FORMS = {"incorporated": "inc", "limited": "ltd", "corporation": "corp", "company": "co", "aktiengesellschaft": "ag"}
#: What a text says right before or right after its own issuer, in four languages.
ISSUER_BEFORE = (
    "Registrant *:", "Name of issuer *:", "Issuer *:", "Filed on behalf of", "Emittent *:", "Eingereicht für",
    "Emisor *:", "Presentado en nombre de", "[ÉE]metteur *:", "Déposé au nom de",
)
ISSUER_AFTER = r'\((?:the|la|die|le|el) ["“„«]'
FRACTIONS = {"train": 0.9, "dev": 0.05, "test": 0.05}


def fold(text: Column) -> Column:
    """Lower case without accents; anything but letters and digits is one space."""
    bare = F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"\p{M}", "")
    return F.trim(F.regexp_replace(F.replace(bare, F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]+", " "))


def _unless_filler(key: Column) -> Column:
    return F.when(key.isin(*FILLERS) | key.isNull(), None).otherwise(key)


def document_key(raw: Column) -> Column:
    """The source document of an id: without the piece number, case and separators."""
    base = F.regexp_replace(raw, r"::\d+\s*$", "")
    return _unless_filler(F.replace(fold(base), F.lit(" "), F.lit("")))


def author_key(raw: Column) -> Column:
    """Given name before surname, without byline, title and accents."""
    turned = F.regexp_replace(raw, r"^\s*([^,]+?)\s*,\s*([^,]+?)\s*$", "$2 $1")
    words = fold(turned)
    words = F.regexp_replace(words, r"^(?:(?:by|von|par|por) )?(?:(?:prof|dr|mr|mrs|ms|herr|frau|m|mme|sr|sra) )*", "")
    return _unless_filler(words)


def entity_key(raw: Column) -> Column:
    """Company name with one spelling of its legal form."""
    dotless = F.replace(raw, F.lit("."), F.lit(""))
    words = fold(dotless)
    for long, short in LEGAL_FORMS.items():
        words = F.regexp_replace(words, rf" {long}$", f" {short}")
    return _unless_filler(words)


def issuer_in_text(text: Column) -> Column:
    """The issuer a text names as its own, or null; other firms in it do not count."""
    before = "|".join(ISSUER_BEFORE)
    said = F.regexp_extract(text, rf"(?i)(?:^|[\n.?!]\s*|\s)(?:{before})[ \t]*([^\n]{{2,80}}?)[ \t]*(?:\n|\.?\s*$|\.[ \t]+(?=\p{{Lu}}))", 1)
    opens = F.regexp_extract(text, rf"^\s*([^\n(]{{2,80}}?)[ \t]*{ISSUER_AFTER}", 1)
    return F.coalesce(F.nullif(said, F.lit("")), F.nullif(opens, F.lit("")))


def record_keys(df: DataFrame, rec: str, id_col: str, author: str, entity: str, text: str) -> DataFrame:
    """``(rec, key)``: the keys of each record, distinct."""
    own = entity_key(F.col(entity))
    issuer = F.coalesce(own, entity_key(issuer_in_text(F.col(text))))
    keys = F.array_compact(
        F.array(
            F.concat(F.lit("d:"), document_key(F.col(id_col))),
            F.concat(F.lit("a:"), author_key(F.col(author))),
            F.concat(F.lit("e:"), issuer),
        )
    )
    return df.select(F.col(rec).alias("rec"), F.explode(keys).alias("key"))


def star_edges(keys: DataFrame) -> DataFrame:
    """One edge from each record to the smallest of its key; no key's records meet in one task."""
    least = keys.groupBy("key").agg(F.min("rec").alias("b"), F.max("rec").alias("top")).filter("b < top")
    ties = keys.join(least, "key").filter("rec > b").select(F.col("rec").alias("a"), "b").distinct()
    return ties.withColumn("w", F.xxhash64("a", "b"))


def _roots(choice: DataFrame) -> DataFrame:
    """Pointer jumping on ``(c, p)`` whose chains end in ``p = c``."""
    while True:
        up = choice.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        jumped = cut(choice.join(up, "p").select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
        choice = jumped.select("c", "p")
        if not jumped.filter("moved").limit(1).count():
            return choice


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(forest, roots)`` of edges ``(a, b, w)``: forest edges, and ``(node, root)``.

    Weights are made unique by the edge's ends, so the chosen edges form a
    forest; two components that choose the same edge are rooted at the smaller.
    """
    spark = edges.sparkSession
    live = cut(edges.select("a", "b", F.struct("w", F.col("a").alias("u"), F.col("b").alias("v")).alias("e")))
    node_type = edges.schema["a"].dataType.simpleString()
    forest = [spark.createDataFrame([], f"u {node_type}, v {node_type}")]
    maps: list[DataFrame] = []
    while live.limit(1).count():
        ends = live.select(F.col("a").alias("c"), F.struct("e", F.col("b").alias("to")).alias("s")).unionAll(live.select(F.col("b").alias("c"), F.struct("e", F.col("a").alias("to")).alias("s")))
        best = cut(ends.groupBy("c").agg(F.min("s").alias("s")).select("c", F.col("s.to").alias("p"), F.col("s.e").alias("e")))
        forest.append(best.select("e.u", "e.v").distinct())
        back = best.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        choice = best.join(back, "p").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
        root = _roots(choice)
        maps.append(root)
        ra, rb = root.select(F.col("c").alias("a"), F.col("p").alias("ra")), root.select(F.col("c").alias("b"), F.col("p").alias("rb"))
        moved = live.join(ra, "a").join(rb, "b").filter("ra != rb")
        lo, hi = F.least("ra", "rb"), F.greatest("ra", "rb")
        live = cut(moved.groupBy(lo.alias("a"), hi.alias("b")).agg(F.min("e").alias("e")))
    if not maps:
        return forest[0], spark.createDataFrame([], f"node {node_type}, root {node_type}")
    whole = maps[0].select(F.col("c").alias("node"), F.col("p").alias("root"))
    for later in maps[1:]:
        up = later.select(F.col("c").alias("root"), F.col("p").alias("top"))
        whole = whole.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return reduce(DataFrame.unionAll, forest), cut(whole)


def related_groups(
    df: DataFrame, rec: str = "rec_id", id_col: str = "id", author: str = "author", entity: str = "entity", text: str = "text"
) -> DataFrame:
    """``(rec, lead)``: every record with the smallest record of its group.

    Defined results: nulls, blanks and filler values relate nothing; a repeated
    ``rec`` is one record with the keys of all its rows; a record without keys
    is its own group; a null ``rec`` is left out; an empty table gives no rows.
    """
    src = df.filter(F.col(rec).isNotNull())
    edges = star_edges(record_keys(src, rec, id_col, author, entity, text).distinct())
    _, roots = spanning_forest(edges)
    lead = roots.groupBy("root").agg(F.min("node").alias("lead"))
    member = roots.join(lead, "root").select(F.col("node").alias("rec"), "lead")
    return src.select(F.col(rec).alias("rec")).distinct().join(member, "rec", "left").select("rec", F.coalesce("lead", "rec").alias("lead"))


def deal(groups: DataFrame, fractions: dict[str, float] | None = None, most_large: int = 2000, buckets: int = 256) -> DataFrame:
    """``(lead, n, split)`` from ``(lead, n)``: whole groups, split sizes near ``fractions``.

    The at most ``most_large`` groups above a share of ``1 / most_large`` of all
    records are placed one by one, largest first, where the most records are
    wanting.  The others are stratified by size band (powers of two), ordered
    by a hash, and dealt by where the running number of records falls on a
    wheel with the shares still wanting; groups of one record come last, so
    that they even out what whole groups left over.  The running number adds up
    from ``buckets`` sub-totals a band, so no band is ordered in one task.
    An empty table gives no rows.
    """
    fractions = fractions or FRACTIONS
    if abs(sum(fractions.values()) - 1) > 1e-6 or min(fractions.values()) < 0:
        raise ValueError("the fractions must be at least 0 and add up to 1")
    names = list(fractions)
    total = groups.agg(F.sum("n")).first()[0] or 0
    is_large = F.col("n") > F.lit(total / most_large)
    want = {k: fractions[k] * total for k in names}
    large = []
    for r in groups.filter(is_large).orderBy(F.desc("n"), "lead").collect():  # fewer than most_large
        fits = [k for k in names if want[k] >= r.n] or names
        k = max(fits, key=lambda x: (want[x] / (fractions[x] * total or 1), want[x]))
        want[k] -= r.n
        large.append((r.lead, r.n, k))
    spark = groups.sparkSession
    small = groups.filter(~is_large).select("lead", "n", F.floor(F.log2("n")).alias("band"), F.xxhash64("lead").alias("h"))
    small = small.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sub = small.groupBy("band", "bucket").agg(F.sum("n").alias("m"))
    in_band = Window.partitionBy("band")
    running = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sub.select("band", "bucket", F.coalesce(F.sum("m").over(running.partitionBy("band")), F.lit(0)).alias("before"), F.sum("m").over(in_band).alias("of"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("band", "bucket").orderBy("h", "lead").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cut(small.withColumn("inside", inside).join(F.broadcast(before), ["band", "bucket"]).select("lead", "n", "band", "of", (F.col("before") + F.col("inside")).alias("at")))

    def on_wheel(at: Column) -> Column:
        rest = sum(max(0.0, v) for v in want.values()) or 1.0
        split, edge = F.lit(names[0]), 1.0
        for k in names[:0:-1]:
            low = edge - max(0.0, want[k]) / rest
            split = F.when((at >= low) & (at < edge), F.lit(k)).otherwise(split)
            edge = low
        return split

    turn = 40 * F.pow(2, F.col("band"))  # one turn holds 20 to 40 groups in any band
    wheel = F.pmod((F.col("at") + F.pmod(F.hash("band"), F.lit(40))) * 1.0, turn) / turn
    several = placed.filter("band > 0").select("lead", "n", on_wheel(wheel).alias("split"))
    for r in several.groupBy("split").agg(F.sum("n").alias("n")).collect():  # one row a split
        want[r.split] -= r.n
    single = placed.filter("band = 0").select("lead", "n", on_wheel((F.col("at") + 0.5) / F.col("of")).alias("split"))
    dealt = several.unionByName(single)
    if not large:
        return dealt
    lead_type = groups.schema["lead"].dataType.simpleString()
    return dealt.unionByName(spark.createDataFrame(large, f"lead {lead_type}, n bigint, split string"))


def assign_splits(df: DataFrame, fractions: dict[str, float] | None = None, **columns: str) -> DataFrame:
    """``(rec, lead, split)``: groups of related records dealt whole to the splits."""
    members = cut(related_groups(df, **columns))
    sizes = cut(members.groupBy("lead").agg(F.count("*").alias("n")))
    return members.join(deal(sizes, fractions).select("lead", "split"), "lead").select("rec", "lead", "split")
