"""Texts that stop before their end (problem 2).

For every source the discrete hazard of each length (texts of that length among
those at least as long) is compared with the pooled hazard of its neighbouring
lengths; a one-sided Poisson bound, controlled for false discoveries over all
sources, units and lengths, names the lengths at which a source cuts.  A text of
such a length whose ending is incomplete, or at least not closed, was cut there
(``length``).

Not every cut is at a fixed length: a transfer may break anywhere.  Away from
the significant lengths a text counts only where its ending proves the cut by
itself, and each kind of proof is a reason of its own: an open JSON value
(``json``), a word that never ends a sentence (``word``), a cut mark (``mark``),
or far less text than the tokens paid for (``tokens``).  Which words end
sentences is counted over all finished sentences of the table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.plans.durable import cut

#: What is put behind a text that was cut.
CUT_MARK = r"\[(?:\.{3}|…|\.\.|truncated|cut|cut off|continued|snip)\]|<\|[a-z_]{2,20}\|>|\((?:\.{3}|…|truncated|cut)\)|…|\.{3}|�"
#: Markup that may close behind a text, cut or not.
CLOSING = r"\*{1,3}|_{2}|</[a-z]{1,10}>|<br ?/?>|`{1,3}|~{3}"
WIDTH = 120
#: A word counts as known from so many uses, as a possible ending from so many and this share of its uses.
MIN_WORD = 5
MIN_ENDINGS = 2
LEAST_ENDING = 0.004
#: Of words used less often nothing is said: one that ends a twentieth of its sentences may well not be seen to end any.
RARE = 60
#: A JSON key whose last values lack a closing mark this rarely always has one.
MOST_WITHOUT = 0.05
#: A text holds about four characters a token; below this many it lacks what was paid for.
CHARS_A_TOKEN = 3.2
MIN_TOKENS = 8
ALPHA = 1e-3
NEIGHBOURS = 10
#: Bins of p values.
BINS = 4096
#: Token counts bunch in a narrow hump, so that only the next few are comparable.
NEAR_TOKENS = 3
UNITS = ("chars", "bytes", "tokens")
_STOPS, _CLOSERS, _AFTER_VALUE = frozenset(".!?"), "\"'”’»)*_", frozenset(",}]")
_DIGITS = re.compile(r"\d")
_AROUND = "\"'.,;:!?()[]{}<>*_`“”«»„…–—-"


def strip_marks(text: Column) -> Column:
    """``text`` without the marks and markup at its end; the pattern only runs where one could be."""
    some = F.right(F.rtrim(text), F.lit(1)).isin(*"])>…�*_`~") | text.endswith("...")
    return F.when(some, F.regexp_replace(text, rf"(?i)(?:\s*(?:{CUT_MARK}|{CLOSING}))+\s*\z", "")).otherwise(text)


def ending(text: Column) -> tuple[Column, Column]:
    """``(rest, marked)``: the last code points without marks and markup, and whether a cut mark was there."""
    last = F.right(text, F.lit(WIDTH))
    rest = strip_marks(last)
    removed = F.substring(last, F.char_length(rest) + 1, F.lit(WIDTH))
    return rest, (F.char_length(removed) > 0) & removed.rlike(rf"(?i){CUT_MARK}")


def finished(rest: Column) -> Column:
    """Whether a text without its marks ends in a closing mark of a sentence."""
    return rest.rlike(r"[.!?。！？]\s*[\"'”’»“)\]]{0,3}\s*\z")


def last_words(rest: Column) -> tuple[Column, Column]:
    """The last word and the one before it; quotes and brackets around them do not count."""
    bare = F.regexp_replace(rest, r"[\s\"'”’»“„«)\](\[{}`*_>~|]+\z", "")
    last = F.regexp_extract(bare, r"([^\s\"“”«»„(){}\[\]]+)\z", 1)
    before = F.regexp_extract(bare, r"([^\s\"“”«»„(){}\[\]]+)[\s\"“”«»„(){}\[\]]+[^\s\"“”«»„(){}\[\]]+\z", 1)
    return last, before


def word_key(word: Column) -> Column:
    """Lower case, digits alike."""
    return F.regexp_replace(F.lower(word), r"\d", "0")


def is_json(text: Column) -> Column:
    """Whether a text is (the start of) a JSON object or list, maybe fenced or announced."""
    return text.rlike(r"\A(?:[^{\[\n]{0,80}\n)?\s*(?:```[a-z]{0,10}\s*)?[{\[]\s*(?:[\"'{\[}\]]|\z)")


def unbalanced(text: Column) -> Column:
    """Whether a bracket or brace stays open."""

    def count(c: str) -> Column:
        return F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit("")))

    return (count("{") > count("}")) | (count("[") > count("]"))


def ends_in(tokens: list[str], is_json: bool) -> Iterator[tuple[str, str]]:
    """``(word before, word)`` at each end of a finished sentence, or of a JSON string value."""
    before = ""
    for token in tokens:
        if is_json:
            at = token.find('"', 1) if token[1:2] not in _AFTER_VALUE else token.find('"')
            ended = at >= 0 and token[at + 1 : at + 2] in _AFTER_VALUE
            word = token[:at].strip(_AROUND) if ended else ""
            if ended and not word:
                word, before = before.strip(_AROUND), ""
        else:
            bare = token.rstrip(_CLOSERS)
            ended = bare[-1:] in _STOPS and bare[-2:-1] not in _STOPS
            word = bare.strip(_AROUND) if ended else ""
            if ended and not word:
                word, before = before.strip(_AROUND), ""
        if ended and word:
            yield before.strip(_AROUND), word
        before = token


def counts(src: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(ends, words)`` of all texts, each ``(word, n)``, counted per partition before anything is shuffled.

    ``ends`` has how often a word ends a finished sentence or string value, of
    texts without a cut mark.  Names are coined without end, so a capitalised
    word also counts as "a name after that word", ``<word before> <name>``; a
    number counts with the word before it, so that a year of three digits shows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        ends: Counter[tuple[str, str]] = Counter()

        def rows() -> pa.RecordBatch:
            clean: Counter[tuple[bool, str]] = Counter()
            for token, n in words.items():
                word = token.strip(_AROUND).lower()
                if word.replace("_", "").isalpha():
                    clean[False, word] += n
            for (before, word), n in ends.items():
                clean[True, _DIGITS.sub("0", word.lower())] += n
                if word[0].isupper():
                    clean[True, _DIGITS.sub("0", before.lower()) + " <name>"] += n
                elif word[-1].isdigit():
                    clean[True, _DIGITS.sub("0", f"{before} {word}".lower())] += n
                    clean[True, _DIGITS.sub("0", before.lower()) + " <number>"] += n
            words.clear()
            ends.clear()
            return pa.RecordBatch.from_pydict({"is_end": pa.array([k[0] for k in clean], pa.bool_()), "word": pa.array([k[1] for k in clean], pa.string()), "n": pa.array(clean.values(), pa.int64())})

        for batch in batches:
            for text, is_json, marked in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = text.split()
                words.update(tokens)
                if not marked:
                    ends.update(ends_in(tokens, is_json))
            if len(words) + len(ends) > 500_000:
                yield rows()
        yield rows()

    seen = src.select("text", "is_json", "marked").mapInArrow(count, "is_end boolean, word string, n bigint")
    summed = cut(seen.groupBy("is_end", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= F.when(F.col("is_end"), MIN_ENDINGS).otherwise(MIN_WORD)))
    return summed.filter("is_end").select("word", "n"), summed.filter("NOT is_end").select("word", "n")


def beginnings(words: DataFrame) -> DataFrame:
    """``(word, total)``: every known word and every beginning of one, with the count of what it may be."""
    parts = F.transform(F.sequence(F.lit(1), F.char_length("word")), lambda i: F.substring("word", 1, i))
    return words.select(F.explode(parts).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("total"))


def closing_keys(src: DataFrame) -> DataFrame:
    """``(json_key, closes)``: the JSON keys whose last values nearly always end in a closing mark."""
    return (
        src.filter(F.col("is_json") & ~unbalanced(F.col("text")))
        .groupBy(last_key(F.col("text")).alias("json_key"))
        .agg(F.avg((~finished(_inner(F.col("rest")))).cast("int")).alias("without"))
        .select("json_key", (F.col("without") < MOST_WITHOUT).alias("closes"))
    )


def last_key(text: Column) -> Column:
    """The key of the last string value of a JSON text."""
    return F.regexp_extract(text, r"(?s)\A.*[\"']([A-Za-z_]{1,40})[\"']\s*:\s*[\"']", 1)


def _inner(rest: Column) -> Column:
    """A text without the closers of JSON and the marks before them."""
    return strip_marks(F.regexp_replace(rest, r"[\"'}\]\s`]+\z", ""))


def cut_lengths(lengths: DataFrame, alpha: float = ALPHA, near: int = NEIGHBOURS) -> DataFrame:
    """``(source, unit, length, n, at_risk, log_p)`` of the lengths at which a source cuts.

    ``lengths`` has a row for each text: ``source`` and ``chars``, ``bytes`` and ``tokens`` (maybe null).
    The p value is the Chernoff bound of a Poisson count, valid at every size;
    Benjamini-Hochberg holds the share of false lengths below ``alpha``.
    """
    units = F.create_map(*[x for u in UNITS for x in (F.lit(u), F.col(u).cast("int"))])
    counted = lengths.select("source", F.explode(units).alias("unit", "length")).filter("length IS NOT NULL")
    counted = cut(counted.groupBy("source", "unit", "length").agg(F.count("*").alias("n")))
    by = Window.partitionBy("source", "unit").orderBy("length")
    risk = counted.withColumn("at_risk", F.sum("n").over(by.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)))
    wide, close = by.rangeBetween(-near, near), by.rangeBetween(-min(near, NEAR_TOKENS), min(near, NEAR_TOKENS))
    around = lambda c: F.when(F.col("unit") == "tokens", F.sum(c).over(close)).otherwise(F.sum(c).over(wide)) - F.col(c)
    h = risk.withColumn("others", around("n")).withColumn("other_risk", around("at_risk"))
    mean = F.col("at_risk") * (F.col("others") + 1) / (F.col("other_risk") + F.col("at_risk"))
    h = h.withColumn("mean", mean)
    log_p = F.when(F.col("n") > F.col("mean"), F.col("n") - F.col("mean") - F.col("n") * F.log(F.col("n") / F.col("mean"))).otherwise(0.0)
    tests = h.withColumn("log_p", log_p)
    few = cut(tests.filter(F.col("log_p") < math.log(alpha)).withColumn("bin", F.least(F.floor(-F.col("log_p")), F.lit(BINS)).cast("int")))
    m = tests.agg(F.count("*").alias("m"))
    # ranks by p: the counts of the smaller bins, of which there are at most BINS, and the place within a bin
    before = few.groupBy("bin").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(Window.orderBy(F.desc("bin"))) - F.col("c")).select("bin", "before")
    placed = few.join(F.broadcast(before), "bin").withColumn("i", F.col("before") + F.row_number().over(Window.partitionBy("bin").orderBy("log_p", "source", "unit", "length")))
    passed = placed.crossJoin(F.broadcast(m)).withColumn("ok", F.col("log_p") <= math.log(alpha) + F.log("i") - F.log("m"))
    last = passed.filter("ok").agg(F.max("i").alias("last"))
    return passed.crossJoin(F.broadcast(last)).filter(F.col("i") <= F.col("last")).select("source", "unit", "length", "n", "at_risk", "log_p")


def prepared(df: DataFrame, key: str, text: str, source: str, prompt: str | None, tokens: str | None) -> DataFrame:
    """What the checks need of each text, in one narrow projection (the text itself comes along)."""
    rest, marked = ending(F.col("text"))
    src = df.select(
        F.col(key).alias("key"),
        F.coalesce(F.col(source), F.lit("")).alias("source"),
        F.col(text).alias("text"),
        (F.col(prompt) if prompt else F.lit(None).cast("string")).alias("prompt"),
        (F.col(tokens) if tokens else F.lit(None).cast("int")).alias("tokens"),
    ).filter(F.col("text").rlike(r"\S"))
    src = src.withColumn("rest", rest).withColumn("marked", marked).withColumn("is_json", is_json(F.col("text")))
    whole = F.char_length("text")
    chars = whole - F.least(whole, F.lit(WIDTH)) + F.char_length("rest")
    octets = F.octet_length("text") - F.octet_length(F.right("text", F.lit(WIDTH))) + F.octet_length("rest")
    return src.withColumn("chars", chars).withColumn("bytes", octets)


def suspects(src: DataFrame) -> DataFrame:
    """Texts whose ending has to be looked up, and JSON that is open; finished texts drop out."""
    # a cut value may have been closed again: closers are taken off before its own ending is looked at
    end = F.when(F.col("is_json"), _inner(F.col("rest"))).otherwise(F.col("rest"))
    last, before = last_words(F.col("end"))
    out = src.withColumn("open", F.col("is_json") & unbalanced(F.col("text"))).withColumn("end", end)
    out = out.withColumn("half", ~F.col("is_json") & F.rtrim("text").endswith("�"))
    out = out.filter(F.col("open") | F.col("half") | ~finished(F.col("end")))
    tail = F.right(F.regexp_replace(F.lower("end"), r"[^\p{L}\p{N}]+", ""), F.lit(14))
    asked = F.regexp_replace(F.lower(F.coalesce("prompt", F.lit(""))), r"[^\p{L}\p{N}]+", "")
    out = out.withColumn("last", last).withColumn("before", before)
    name, number = F.col("last").rlike(r"\A\p{Lu}"), F.col("last").rlike(r"\A[^\p{Lu}].*\d\z|\A\d\z")
    return out.select(
        "key", "source", "is_json", "open", "half", "marked", "chars", "bytes", "tokens", "end",
        word_key(F.col("last")).alias("word"),
        F.when(name, F.concat(word_key(F.col("before")), F.lit(" <name>"))).when(number, F.concat(word_key(F.col("before")), F.lit(" "), word_key(F.col("last")))).alias("name"),
        F.when(number, F.concat(word_key(F.col("before")), F.lit(" <number>"))).alias("number"),
        F.when(F.col("is_json"), last_key(F.col("text"))).alias("json_key"),
        (F.col("is_json") & F.right("text", F.lit(WIDTH)).rlike(rf"(?i)(?:{CUT_MARK})[\"'}}\]\s`]*\z")).alias("inside_mark"),
        (F.char_length("before") > 0).alias("several"),
        F.col("last").rlike(r"[,;:(–—-]\z|\A[–—-]\z").alias("open_mark"),
        F.col("last").rlike(r"://|[%€$]\z|\A[^\p{L}]*\z|\d\z").alias("no_word"),
        ((F.char_length(tail) >= 10) & asked.endswith(tail)).alias("asked"),
        F.col("text").rlike(r"\A\s*[\[(<{].{0,30}[\])>}]\s*\z|\A\s*\S{0,20}:\s*\z").alias("filler"),
    )


def truncated(
    df: DataFrame, key: str, text: str = "text", source: str = "source", prompt: str | None = "prompt", tokens: str | None = "completion_tokens"
) -> DataFrame:
    """``(key, source, reason)``: one row for each text that stops before its end.

    ``reason`` is length (an incomplete or unclosed ending at a significant
    length), or, at any other length, json (an open value), word (an ending that
    no finished sentence has), mark (a cut mark behind a possible ending) or
    tokens (far less text than the tokens usually stand for).
    Defined results: null and blank texts, bare fillers, single words and texts
    ending as their prompt does are no cases; a null source is a source of its
    own; a repeated row comes out as often; an empty table gives no rows.
    """
    src = prepared(df, key, text, source, prompt, tokens)
    ends, words = counts(src)
    known = beginnings(words)
    limits = cut(cut_lengths(src))
    at = {u: limits.filter(F.col("unit") == u).select("source", F.col("length").alias(u), F.lit(True).alias(f"at_{u}")) for u in UNITS}
    s = suspects(src)
    for c in ("name", "number", "json_key"):  # what is null meets nothing, and is dealt to all tasks
        s = s.withColumn(c, F.coalesce(c, F.concat(F.lit("\0"), F.pmod(F.xxhash64("key"), F.lit(4096)).cast("string"))))
    s = s.join(ends.select("word", F.col("n").alias("ends")), "word", "left")
    s = s.join(ends.select(F.col("word").alias("name"), F.lit(True).alias("name_ends")), "name", "left").join(known, "word", "left")
    s = s.join(ends.select(F.col("word").alias("number"), F.lit(True).alias("number_ends")), "number", "left")
    s = s.join(closing_keys(src), "json_key", "left")
    for u in UNITS:
        s = s.join(at[u], ["source", u], "left")  # a row for each significant length
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rare = F.coalesce(F.col("total") < RARE, F.lit(True))
    nameless = F.col("name").startswith("\0")
    ends_here = (F.col("ends") >= F.greatest(F.lit(MIN_ENDINGS), F.coalesce("total", F.lit(0)) * LEAST_ENDING)) | yes("name_ends") | F.col("no_word") | (rare & nameless)
    ends_here = F.coalesce(ends_here, F.lit(False)) & ~(yes("number_ends") & ~yes("name_ends"))
    missing = (F.col("tokens") >= MIN_TOKENS) & (F.col("chars") < F.col("tokens") * CHARS_A_TOKEN)
    prose = ~F.col("is_json") & F.col("several") & ~F.col("filler") & ~F.col("asked")
    # two words without a closing mark are an answer ("Total: 9712"), at any length
    unclosed = prose & F.col("end").rlike(r"\S\s+\S+\s+\S*[\p{L}\d][\s\"'”’»]*\z")
    proof = (
        F.when(F.col("open"), "json")
        .when(F.col("half"), "mark")
        .when(F.col("is_json"), F.when(F.col("inside_mark"), "mark").when(F.col("several") & (yes("closes") | (~rare & ~ends_here)), "word"))
        .when(F.col("marked") & F.col("end").rlike(r"\p{L}"), "mark")
        .when(prose & (F.col("open_mark") | ~ends_here), "word")
    )
    limit = yes("at_chars") | yes("at_bytes") | yes("at_tokens")
    reason = F.when((proof.isNotNull() | unclosed) & limit, "length").otherwise(F.coalesce(proof, F.when(unclosed & missing, "tokens")))
    return s.withColumn("reason", reason).filter("reason IS NOT NULL").select("key", "source", "reason")


def rates(df: DataFrame, found: DataFrame, source: str = "source") -> DataFrame:
    """``(source, n, n_cut, share)``: how often each source cuts."""
    n = df.groupBy(F.coalesce(F.col(source), F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    n_cut = found.groupBy("source").agg(F.count("*").alias("n_cut"))
    out = n.join(n_cut, "source", "left").select("source", "n", F.coalesce("n_cut", F.lit(0)).alias("n_cut"))
    return out.withColumn("share", F.col("n_cut") / F.col("n"))
