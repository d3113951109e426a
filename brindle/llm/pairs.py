"""Defective question-and-answer pairs (problem 3).

``empty``, ``copy`` and ``other_language`` are read off each pair in one Arrow
pass; ``truncated`` comes from the length hazards and endings of problem 2.

``refusal`` needs the whole table, and no list of wordings.  The openings of all
answers are clustered: nearly equal ones, found by a prefix filter over their
five-word shingles, are linked and the links closed to components.  A cluster that recurs under
unrelated prompts and within different answers is a template, and so is a later
piece of such an answer that recurs likewise.  What recurs by chance, because it
is made of common parts, is told by its parts: the words a template begins and
ends with seldom stand with others.  An answer that consists of templates has
nothing to say about its question: a refusal.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm import truncation
from brindle.llm.groups import spanning_forest
from brindle.plans.durable import cut

#: Answers that stand for no answer, lower case.
FILLERS = (
    "n/a", "na", "none", "null", "nil", "nan", "tbd", "todo", "no answer", "answer", "a", "response", "output", "empty", "undefined",
    "pending", "lorem ipsum", "no response", "not available", "keine antwort", "antwort", "sin respuesta", "respuesta", "réponse", "pas de réponse", "k.a", "s/o", "s.o",
)
#: Frequent function words that tell four languages apart.
FUNCTION_WORDS = {
    "en": "the and of to with for in is was that but so by from has have are this near each than not before after while because",
    "de": "der die das und den dem des ein eine mit für im ist hat aber nicht auf zu von durch ohne ob gegen wir denn dass seit",
    "fr": "le les des du et une pour dans est mais que qui avec sans sur par au car nous ce cette depuis selon malgré tandis",
    "es": "el los las del y una para en es pero que con sin por al se más este esta según como desde mientras porque tras",
}
#: Names of the four languages in the four languages.
LANGUAGE_NAMES = {
    "en": "english|englisch|anglais|inglés|ingles|inglese",
    "de": "german|deutsch|allemand|alemán|aleman",
    "fr": "french|französisch|français|francais|francés|frances",
    "es": "spanish|spanisch|espagnol|español|espanol|castellano",
}
#: Unrelated prompts, and different answers, that a template recurs in.
PROMPTS = 3
#: Words of a piece from which it can open an answer and is held against its parts.
OPENING = 4
#: Words of an answer that may be its own (a name, a date), and their largest share.
OWN_WORDS, OWN_SHARE = 3, 0.25
#: Share of the pieces that begin, or end, with the same words which a template makes up at least.
COHESION = 0.5
#: Prompts are related by a word that so small a share of the prompts has (or so few of them).
RARE_WORD, FEW_PROMPTS = 0.0005, 8
#: Rows of a table of hashes that are sent to all tasks at most.
MOST_SENT = 200_000
SIMILAR = 0.8
SHINGLE = 5
#: Sets that meet under one shingle before they are compared with two of them first.
CROWD = 2000
VOCABULARY = 50_000
_WORD = re.compile(r"[^\W\d_]+|\d+")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Words that begin a clause giving a reason, with or without a comma before them.
_REASONS = {w: re.compile(rf"{w}(?<!\w{w})(?!\w)") for w in ("because", "weil", "denn", "parce", "car", "porque")}
_PUNCTUATION = ".,;:!?()[]\"“”«»–—"
_LONE_HYPHEN = re.compile(r"-(?<=\s-)(?=\s)")
_MARKUP = re.compile(r"<[^<>]{0,40}>|[\s​‌‍⁠﻿\-–—*_\"'`.,:;!?…{}\[\]()<>|/\\#~=+]+")
_ALNUM = re.compile(r"[^\W_]")
_DRESS = re.compile(r"^\s*(?:[>#*\"“„«']+\s*)*(?:(?:q|question|frage|pregunta|query|prompt)\s*[:.]\s*)?", re.I)
_QUOTED = re.compile(r"\"[^\"]{10,}\"|“[^”]{10,}”|«[^»]{10,}»|„[^“”]{10,}[“”]")
_ASKED = {k: re.compile(rf"\b(?:in|auf|en|in)\s+(?:{v})\b", re.I) for k, v in LANGUAGE_NAMES.items()}


def is_empty(answer: str | None) -> bool:
    """Null, blank, only markup, or a filler."""
    if answer is None:
        return True
    if len(answer) > 400:
        return not _ALNUM.search(answer)
    bare = _MARKUP.sub(" ", answer).strip().lower()
    return not bare or (len(answer) < 40 and (bare in FILLERS or answer.strip().strip("[](){}<>:. ").lower() in FILLERS))


def is_copy(question: str | None, answer: str | None) -> bool:
    """Whether the answer is the question alone: once or a few times, dressed or with few words changed."""
    if not question or not answer or len(answer) > 4 * len(question) + 40:
        return False
    q, a = _WORD.findall(question.lower()), _WORD.findall(_DRESS.sub("", answer).lower())
    if len(q) < 2 or len(a) < 2:
        return False
    times = max(1, round(len(a) / len(q)))
    want = Counter({w: n * times for w, n in Counter(q).items()})
    shared = sum((want & Counter(a)).values())
    return shared / max(len(a), len(q) * times) >= (0.82 if len(q) > 5 else 0.7)


_SEEDS: dict[str, str] = {w: k for k, v in FUNCTION_WORDS.items() for w in v.split() if sum(w in x.split() for x in FUNCTION_WORDS.values()) == 1}


def _spaced(text: str) -> list[str]:
    """The lower-case words between blanks and the commonest marks (``str.replace`` beats a pattern here)."""
    text = text.lower()
    for c in ".,;:!?\"()'’":
        text = text.replace(c, " ")
    return text.split()


def seed_language(words: list[str], least: int = 4) -> str | None:
    """The language whose function words clearly lead, or none."""
    top = Counter(filter(None, map(_SEEDS.get, words))).most_common(2)
    return top[0][0] if top and top[0][1] >= least and (len(top) == 1 or top[0][1] >= 2 * top[1][1]) else None


def language_model(texts: DataFrame, text: str, vocabulary: int = VOCABULARY) -> dict[str, list[float]]:
    """Log probabilities of the most frequent ``vocabulary`` words in each language.

    The texts label themselves by their function words; counts are taken over
    all of them, per partition first.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter[str]] = {k: Counter() for k in FUNCTION_WORDS}

        def rows() -> pa.RecordBatch:
            clean: Counter[tuple[str, str]] = Counter()
            for k, c in seen.items():
                for token, n in c.items():
                    for w in _LETTERS.findall(token):
                        clean[k, w] += n
                c.clear()
            return pa.RecordBatch.from_pydict({"language": pa.array([k for k, _ in clean], pa.string()), "word": pa.array([w for _, w in clean], pa.string()), "n": pa.array(clean.values(), pa.int64())})

        for batch in batches:
            for t in batch.column(0).to_pylist():
                tokens = t.lower().split() if t else []
                if len(tokens) >= 8 and (k := seed_language(tokens)):
                    seen[k].update(tokens)
            if sum(map(len, seen.values())) > 500_000:
                yield rows()
        yield rows()

    counts = texts.select(text).mapInArrow(count, "language string, word string, n bigint")
    by_word = counts.groupBy("word").pivot("language", list(FUNCTION_WORDS)).agg(F.sum("n")).na.fill(0)
    total = sum((F.col(k) for k in FUNCTION_WORDS), F.lit(0))
    top = by_word.withColumn("total", total).filter("total >= 5").orderBy(F.desc("total"), "word").limit(vocabulary).collect()
    sums = {k: sum(r[k] for r in top) + 0.5 * len(top) for k in FUNCTION_WORDS}
    return {r.word: [math.log((r[k] + 0.5) / (sums[k] or 1)) for k in FUNCTION_WORDS] for r in top}


def language(text: str, model: dict[str, list[float]], margin: float) -> str | None:
    """The language with the highest likelihood, if it leads by ``margin``."""
    found = [v for w in _LETTERS.findall(text.lower()) if (v := model.get(w))]
    if not found:
        return None
    scores = sorted(zip((sum(x) for x in zip(*found)), FUNCTION_WORDS), reverse=True)
    return scores[0][1] if scores[0][0] - scores[1][0] >= margin else None


def other_language(question: str, answer: str, model: dict[str, list[float]]) -> bool:
    """Whether the answer, quotations aside, is in another language than asked for."""
    said = seed_language(_spaced(answer))
    asked = [k for k, p in _ASKED.items() if p.search(question)] if "(" in question or said is None or said != seed_language(_spaced(question), 3) else [said]
    if asked and asked[-1] == said and '"' not in answer:
        return False
    if said is None or _QUOTED.search(answer):
        said = language(_QUOTED.sub(" ", answer), model, 6.0)
    if said is None:
        return False
    wanted = asked[-1] if asked else language(question, model, 3.0)
    return wanted is not None and wanted != said


def units(answer: str) -> list[str]:
    """The normalised pieces of an answer between punctuation marks, lone hyphens and words that begin a reason; empty ones left out."""
    text = answer.lower().replace("'", " ").replace("’", " ")
    for c in _PUNCTUATION:
        text = text.replace(c, "\n")
    if "-" in text:
        text = _LONE_HYPHEN.sub("\n", text)
    for w, alone in _REASONS.items():
        if w in text:
            text = alone.sub(f"\n{w}", text)
    parts = (p.split() for p in text.split("\n"))
    return [u for w in parts if w and (u := " ".join(w if "".join(w).isalpha() else _LETTERS.findall(" ".join(w))))]


def _hashes(texts: list[str]) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts)) ^ np.uint64(1 << 63)).view(np.int64)


def _lists(values: pa.Array, sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), pa.int32()), values)


def read_off(pairs: DataFrame, model: dict[str, list[float]]) -> DataFrame:
    """``(tbl, key, defect, prompt, asked, answer, opening, pieces)``: what one pair alone shows, and the pieces of its answer by their hashes.

    ``opening`` is the first piece of some words in full, ``asked`` the prompt's
    words, ``head`` and ``tail`` the first and last three words of a piece.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(model)
    names = ["tbl", "key", "defect", "prompt", "asked", "answer", "opening", "pieces"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, defects, prompts, asked, answers, openings = [], [], [], [], [], []
            n_asked, n_pieces, pieces, words, heads, tails = [], [], [], [], [], []
            for i, (q, a) in enumerate(zip(batch.column("question").to_pylist(), batch.column("answer").to_pylist())):
                defect = "empty" if is_empty(a) else "copy" if is_copy(q, a) else "other_language" if q and other_language(q, a, shared.value) else None
                said = units(a) if defect not in ("empty", "copy") else []
                opening = next((u for u in said if u.count(" ") >= OPENING - 1), None)
                if not defect and not opening:
                    continue
                at.append(i)
                defects.append(defect)
                openings.append(opening)
                prompt = sorted(set(_LETTERS.findall((q or "").lower())))
                prompts.append(" ".join(prompt))
                answers.append("\n".join(said))
                if not opening:
                    prompt, said = [], []
                asked += prompt
                n_asked.append(len(prompt))
                pieces += said
                n_pieces.append(len(said))
                for u in said:
                    w = u.split(" ")
                    words.append(len(w))
                    heads.append(" ".join(w[:3]))
                    tails.append(" ".join(w[-3:]))
            take = pa.array(at, pa.int64())
            parts = pa.StructArray.from_arrays([pa.array(_hashes(pieces)), pa.array(words, pa.int32()), pa.array(_hashes(heads)), pa.array(_hashes(tails))], ["u", "words", "head", "tail"])
            columns = [batch.column("tbl").take(take), batch.column("key").take(take), pa.array(defects, pa.string()), pa.array(_hashes(prompts)), _lists(pa.array(_hashes(asked)), n_asked)]
            columns += [pa.array(_hashes(answers)), pa.array(openings, pa.string()), _lists(parts, n_pieces)]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "tbl string, key bigint, defect string, prompt bigint, asked array<bigint>, answer bigint, opening string, pieces array<struct<u:bigint,words:int,head:bigint,tail:bigint>>"
    return pairs.select("tbl", "key", "question", "answer").mapInArrow(check, schema)


def shingles(unit: Column) -> Column:
    """The distinct hashes of a unit's word shingles; a short unit is one shingle."""
    words = F.split(unit, " ")
    return F.when(F.size(words) <= SHINGLE, F.array(F.xxhash64(unit))).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - SHINGLE + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " "))))
    )


def alike_sets(units: DataFrame) -> DataFrame:
    """``(u, c, k, m, h)`` of ``(u, s)``, ids and their shingles: those that may be similar to another one, by classes.

    ``h`` are the shingles that several units have, the rarest first, ``m`` counts
    all.  Units with equal ``h`` and ``m`` have the same similarity to any unit
    and to each other, as what a unit has alone is common to no two: they are one
    class, named after its least unit ``c``, of ``k`` units, and meet others once.
    """
    each = units.select("u", F.size("s").alias("m"), F.explode("s").alias("h"))
    counts = each.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    shared = each.join(counts, "h").groupBy("u", "m").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("o"))
    enough = shared.filter(F.size("o") >= F.lit(SIMILAR) * F.col("m") - 1e-9).select("u", "m", F.col("o.h").alias("h"))
    like = Window.partitionBy("m", "h")
    return cut(enough.select("u", F.min("u").over(like).alias("c"), F.count("*").over(like).alias("k"), "m", "h"))


def band(m: Column) -> Column:
    """The least of the sizes that count as one with ``m``: itself below 32, else those with the same five leading bits."""
    step = F.call_function("shiftleft", F.lit(1), F.greatest(F.length(F.bin(m)) - 5, F.lit(0)))
    return m - m % step


def similar_pairs(sets: DataFrame) -> DataFrame:
    """``(a, b)`` of ``(c, m, h)``, ids, sizes and ordered shingles, that have a Jaccard similarity of ``SIMILAR`` or more: all of them, or enough for their components.

    Prefix filter: two sets of sizes ``ma`` and ``mb`` so alike have
    ``SIMILAR / (1 + SIMILAR)`` of ``ma + mb`` in common, so the first place where
    they meet leaves room for that many behind it.  A set stands under its first
    shingles once for each band of sizes that its partner may have, as far as such
    a partner leaves room: a shingle that many have seldom stands so far in front.
    What meets is verified in full.

    Where more than ``CROWD`` meet, all are first compared with two of them; then
    only what that has not put in the crowd's largest component meets the others,
    so that of a crowd of sets all alike not every pair is made.
    """
    share = F.lit(SIMILAR / (1 + SIMILAR))
    least = F.ceil(F.lit(SIMILAR) * F.col("m") - 1e-9).cast("int")
    most = F.floor(F.col("m") / F.lit(SIMILAR) + 1e-9).cast("int")
    # what a set has alone stands before all others in the order and meets nothing
    own = F.col("m") - F.size("h")
    partners = sets.select("c", "m", "h", own.alias("own"), least.alias("least"), F.explode(F.array_distinct(F.transform(F.sequence(least, most), band))).alias("to"))
    room = F.col("m") - F.ceil(share * (F.col("m") + F.greatest("to", "least")) - 1e-9).cast("int") + 1 - F.col("own")
    first = cut(partners.filter(room > 0).select("c", "m", "own", "to", F.posexplode(F.slice("h", F.lit(1), room)).alias("i", "h")))
    first = first.withColumn("own", F.col("own") + F.col("i")).withColumn("size", band(F.col("m"))).drop("i")
    whole = lambda x: sets.select(F.col("c").alias(x), F.col("m").alias(f"m{x}"), F.col("h").alias(f"s{x}"))
    common = F.size(F.array_intersect("sa", "sb"))

    def verified(met: DataFrame) -> DataFrame:
        both = met.select("a", "b").distinct().join(whole("a"), "a").join(whole("b"), "b")
        return both.filter(common >= F.lit(SIMILAR) * (F.col("ma") + F.col("mb") - common) - 1e-9).select("a", "b")

    def meetings(one: DataFrame, other: DataFrame) -> DataFrame:
        a = one.select("h", F.col("c").alias("a"), F.col("m").alias("ma"), (F.col("m") - F.col("own")).alias("la"), F.col("size").alias("p"), F.col("to").alias("q"), F.col("part").alias("pa"))
        b = other.select("h", F.col("c").alias("b"), F.col("m").alias("mb"), (F.col("m") - F.col("own")).alias("lb"), F.col("size").alias("q"), F.col("to").alias("p"), F.col("part").alias("pb"))
        fits = (F.least("la", "lb") >= share * (F.col("ma") + F.col("mb")) - 1e-9) & (F.least("ma", "mb") >= F.lit(SIMILAR) * F.greatest("ma", "mb") - 1e-9)
        return a.join(b, ["h", "p", "q"]).filter(fits & (F.col("pa") != F.col("pb")))

    at = ["h", "low", "high"]
    placed = first.withColumn("low", F.least("size", "to")).withColumn("high", F.greatest("size", "to")).withColumn("part", F.col("c"))
    crowds = cut(placed.groupBy(at).agg(F.count("*").alias("n"), F.array(F.min("c"), F.max("c")).alias("two")).filter(F.col("n") > CROWD))
    if not crowds.limit(1).count():
        return verified(meetings(placed, placed).filter("a < b"))
    crowd = placed.join(crowds, at)
    star = crowd.select("c", F.explode("two").alias("to")).filter("c != to").select(F.least("c", "to").alias("a"), F.greatest("c", "to").alias("b"))
    star = cut(verified(star))
    _, roots = spanning_forest(star.withColumn("w", F.lit(1)))
    crowd = cut(crowd.drop("part").join(roots, F.col("c") == F.col("node"), "left").withColumn("part", F.coalesce("root", "c")).select(*at, "c", "m", "own", "size", "to", "part"))
    most = crowd.groupBy(*at, "part").agg(F.count("*").alias("n")).groupBy(at).agg(F.max_by("part", "n").alias("most"))
    rest = crowd.join(most, at).filter("part != most")
    calm = placed.join(crowds.select(at), at, "left_anti")
    met = meetings(rest, crowd).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return verified(meetings(calm, calm).filter("a < b").select("a", "b").unionAll(met)).unionAll(star)


def opening_clusters(read: DataFrame, answers: int = 2) -> DataFrame:
    """``(opening, cluster)`` of the openings that are nearly equal to another one; the rest are clusters of their own.

    Equal openings are one row before any meets another; compared are those that
    open so many different answers at least.  A Jaccard similarity of ``SIMILAR``
    or more links two, none left out, and the clusters are the connected
    components.
    """
    met = read.groupBy("opening", "answer").agg(F.first(F.lit(1))).groupBy("opening").agg(F.count("*").alias("n")).filter(F.col("n") >= answers) if answers > 1 else read.select("opening").distinct()
    long = met.select("opening").filter(F.size(F.split("opening", " ")) > SHINGLE)
    units = cut(long.select(F.xxhash64("opening").alias("u"), shingles(F.col("opening")).alias("s"), "opening"))
    sets = alike_sets(units)
    _, roots = spanning_forest(similar_pairs(sets.filter("u = c")).withColumn("w", F.lit(1)))
    # a class linked to another one is one component with it; else its units are linked among themselves, or none is
    inside = (F.col("k") > 1) & (F.size("h") >= F.lit(SIMILAR) * (2 * F.col("m") - F.size("h")) - 1e-9)
    found = sets.join(roots, F.col("c") == F.col("node"), "left").select("u", F.coalesce("root", F.when(inside, F.col("c"))).alias("cluster")).filter("cluster IS NOT NULL")
    return found.join(units, "u").select("opening", "cluster")


def often_met(said: DataFrame, piece: str) -> DataFrame:
    """``(piece, n)`` of ``(piece, prompt, answer)`` that stand under so many prompts and in so many answers; ``n`` counts the prompts."""
    many = lambda c, n: said.select(piece, c).distinct().groupBy(piece).agg(F.count("*").alias(n)).filter(F.col(n) >= PROMPTS)
    return many("prompt", "n").join(many("answer", "answers"), piece).select(piece, "n")


def unrelated(said: DataFrame, often: DataFrame, piece: str) -> DataFrame:
    """``(piece)`` of ``often`` that recur under prompts which share no rare word, by ``(piece, prompt, asked)``.

    A prompt is related to another of the piece by a word that few prompts have.
    """
    asked = cut(said.select(piece, "prompt", F.explode("asked").alias("word")).distinct())
    prompts = asked.select("word", "prompt").distinct().groupBy("word").agg(F.count("*").alias("df"))
    total = asked.select("prompt").distinct().agg(F.count("*").alias("total"))
    rare = prompts.crossJoin(F.broadcast(total)).filter(F.col("df") <= F.greatest(F.lit(float(FEW_PROMPTS)), F.col("total") * RARE_WORD)).select("word")  # total: one row
    few = cut(asked.join(rare, "word"))
    shared = few.groupBy(piece, "word").agg(F.count("*").alias("c")).filter("c > 1").select(piece, "word")
    related = few.join(shared, [piece, "word"]).select(piece, "prompt").distinct().groupBy(piece).agg(F.count("*").alias("related"))
    return often.join(related, piece, "left").filter(F.col("n") - F.coalesce("related", F.lit(0)) >= PROMPTS).select(piece)


def recurring(said: DataFrame, piece: str) -> DataFrame:
    """``(piece)`` of ``(piece, prompt, asked, answer)`` that recur in several answers under unrelated prompts."""
    often = cut(often_met(said, piece))
    return unrelated(said.join(small(often).select(piece), piece), often, piece)


def small(df: DataFrame) -> DataFrame:
    """For a join: a written table of one or two columns is sent to all tasks only if it has few rows."""
    return F.broadcast(df) if df.count() <= MOST_SENT else df


def refusals(read: DataFrame) -> DataFrame:
    """``(tbl, key, own)`` of the answers that open with a template and consist of templates, but for ``own`` words.

    Wide rows are not shuffled: openings are counted by hash, and only the
    answers with an opening met often go on with their pieces.
    """
    opened = read.filter("opening IS NOT NULL").withColumn("opened", F.xxhash64("opening"))
    names = cut(opening_clusters(opened, answers=1).select(F.xxhash64("opening").alias("opened"), "cluster"))
    cluster = lambda df: df.join(small(names), "opened", "left").withColumn("cluster", F.coalesce("cluster", "opened"))
    often = cut(often_met(cluster(opened.select("opened", "prompt", "answer")), "cluster"))
    known = cut(cluster(opened.drop("opening", "defect")).join(small(often).select("cluster"), "cluster"))
    templates = cut(unrelated(known, often, "cluster"))
    held = known.join(small(templates), "cluster")
    each = cut(held.select("tbl", "key", "prompt", "asked", "answer", F.explode("pieces").alias("p")).select("tbl", "key", "prompt", "asked", "answer", "p.*"))
    again = recurring(each.select("u", "prompt", "asked", "answer"), "u").withColumn("again", F.lit(True))
    # how often a piece stands anywhere, and how often others begin or end as it does: one count by hash
    keys = lambda: F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("h")) for k, c in enumerate(("u", "head", "tail"))])).alias("x")
    every = read.select(F.explode("pieces").alias("p")).select("p.*").filter(F.col("words") >= OPENING)
    parts = cut(each.filter(F.col("words") >= OPENING).select("u", "head", "tail").distinct())
    counted = every.select(keys()).select("x.*").groupBy("kind", "h").agg(F.count("*").alias("n"))
    counted = cut(counted.join(parts.select(keys()).select("x.*").distinct(), ["kind", "h"], "left_semi"))
    whole = parts
    for k, c in enumerate(("u", "head", "tail")):
        whole = whole.join(counted.filter(F.col("kind") == k).select(F.col("h").alias(c), F.col("n").alias(f"n_{c}")), c)
    whole = whole.filter(F.col("n_u") >= COHESION * F.least("n_head", "n_tail")).select("u", F.lit(True).alias("whole"))
    judged = each.join(again, "u", "left").join(whole, "u", "left")
    template = F.coalesce(F.col("again") & ((F.col("words") < OPENING) | F.col("whole")), F.lit(False))
    sums = judged.groupBy("tbl", "key").agg(
        F.bool_or(template & (F.col("words") >= OPENING)).alias("opens"), F.sum("words").alias("words"), F.sum(F.when(template, 0).otherwise(F.col("words"))).alias("own")
    )
    return sums.filter(F.col("opens") & (F.col("own") <= OWN_WORDS) & (F.col("own") <= OWN_SHARE * F.col("words"))).select("tbl", "key", "own")


def defects(pairs: DataFrame) -> DataFrame:
    """``(tbl, key, defect)`` of ``(tbl, key, question, answer, tokens, source)``: one row a defective pair.

    Where several defects show, the first of empty, copy, refusal, truncated,
    other_language stands; with words of its own, an answer is rather truncated
    than a refusal.  Defined results: a null or blank answer is empty; a
    null question can only leave empty, refusal or truncated; repeated rows give
    one row a key; an empty table gives no rows.
    """
    read = cut(read_off(pairs, language_model(pairs, "answer")))
    own = read.filter("defect IS NOT NULL").select("tbl", "key", "defect")
    filled = pairs.withColumn("id", F.struct("tbl", "key"))
    short_of = truncation.truncated(filled, "id", "answer", "source", "question", "tokens").select("key.tbl", "key.key", F.lit("truncated").alias("defect"))
    declined = refusals(read).select("tbl", "key", F.when(F.col("own") == 0, "refusal").otherwise("refusal in part").alias("defect"))
    found = own.unionByName(short_of).unionByName(declined)
    order = F.array_position(F.array(*[F.lit(x) for x in ("empty", "copy", "refusal", "truncated", "refusal in part", "other_language")]), F.col("defect"))
    first = found.groupBy("tbl", "key").agg(F.min_by("defect", order).alias("defect"))
    return first.withColumn("defect", F.when(F.col("defect") == "refusal in part", "refusal").otherwise(F.col("defect")))
