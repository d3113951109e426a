"""Records that stand, exactly or almost, on both sides of a split (problem 4).

A prefix filter over word multisets, kept as a distributed table.  The k-th use
of a word in a field is one token, so a text of ``n`` words is a set of ``n``
tokens and two texts that agree share five sixths of the longer one's.  With all
tokens in one global order, rare ones first, the first shared token is among the
first ``n // 6 + 1`` of either text.  Every distinct text (copies share a class
and appear once) is stored under those tokens; a token common in texts of like
length is stored in pairs with a token that must be shared as well.  Texts of a
train and a held-out record that share a key and could agree by their lengths
and token sets are merged into coverage exactly: the longest common subsequence
of their words.  No pair is lost: the order, the common tokens and those that
nearly all texts have are taken from a sample and only decide how many pairs are
compared.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.plans.durable import cut

AGREE = 5 / 6
#: Texts from which the order of tokens is taken; any order gives the same result.
ORDER_SAMPLE = 6_000
#: Bins that tokens are counted in; tokens of a bin have one place in the order.
BINS = 1 << 18
#: Texts of like length holding a token beyond which it is stored in pairs; texts of one field and PAIRED words or more never do.
COMMON = 1000
PAIRED = 300
#: Share of the texts of like length that hold a token beyond which it tells nothing in a token set.
EVERYWHERE = 0.5
#: Bits of a token set, by the words of a text.
BITS = ((40, 128), (130, 256), (300, 512), (800, 1024), (1 << 62, 2048))
LONGS = 32
#: Words of texts that a task keeps in hand while it compares pairs.
KEPT_WORDS = 500_000
#: Rows and words of a chunk that is worked on at once.
ROWS, WORDS = 1024, 150_000
MOST_BROADCAST = 200_000
_TAG = re.compile(r"<[^<>\n]{1,60}>|&[a-z]{2,8};|&#\d{1,6};")
_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile(r"[­\u200b-\u200f\u202a-\u202e\u2060\ufeff]")
_ODD = re.compile(r"[^\x00-\x7f]")
_PLAIN = {i: chr(i).lower() if chr(i).isalnum() else " " for i in range(128)}


class _Folded(dict):
    """What each character beyond ASCII stands for: compatible form, lower case, no accents."""

    def __missing__(self, c: str) -> str:
        plain = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", c).casefold())
        value = self[c] = "" if _HIDDEN.match(c) else "".join(x for x in plain if not unicodedata.combining(x))
        return value


_FOLDED = _Folded()


def words(text: str | None) -> list[str]:
    """The words of a text, case, punctuation, spacing, Unicode form and markup aside."""
    if not text:
        return []
    if not text.isascii():
        for c in set(_ODD.findall(text)):
            text = text.replace(c, _FOLDED[c])
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text.lower())
    if text.isascii():
        return text.translate(_PLAIN).split()
    return _WORD.findall(text.lower())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bands(n: np.ndarray) -> np.ndarray:
    """Band of a length: lengths that could agree are in the same or in neighbouring bands."""
    return np.minimum(np.log(n) / math.log(1.2**2 + 1e-6), 31).astype(np.int64)


_PAIRED_BAND = int(bands(np.array([PAIRED]))[0])
_BAND_BITS = np.array([next(size for most, size in BITS if 1.44**b < most) for b in range(32)], np.int64)


@dataclass(frozen=True)
class Order:
    """By bin: how often a sample has its tokens, and a bit for each band in which one is common or nearly everywhere."""

    uses: np.ndarray
    common: np.ndarray
    everywhere: np.ndarray


class _Hashes(dict):
    """Word hashes, computed once a word."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _class(parts: list[list[str]]) -> int:
    """The class of texts equal in all fields, as a signed integer."""
    h = xxhash.xxh3_64_intdigest("\n".join([" ".join(p) for p in parts]))
    return h - (1 << 64) if h >> 63 else h


def classes(df: DataFrame) -> DataFrame:
    """``(key, train, class)`` of ``(key, train, texts array<string>)``; texts without words drop out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, texts in enumerate(batch.column(2).to_pylist()):
                parts = [words(t) for t in texts]
                if all(parts):
                    at.append(i)
                    found.append(_class(parts))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(found, pa.int64())], ["key", "train", "class"])

    return df.select("key", "train", "texts").mapInArrow(run, "key bigint, train boolean, class bigint")


class Chunk:
    """Texts whose tokens are worked on at once; all have the same number of fields."""

    def __init__(self, parts: list[list[list[str]]], known: _Hashes):
        self.fields = len(parts[0])
        self.sizes = np.array([[len(p) for p in t] for t in parts], np.int64)
        self.total = self.sizes.sum(axis=1)
        sizes = self.sizes.ravel()
        group = np.repeat(np.arange(len(sizes)), sizes)
        h = np.fromiter(map(known.__getitem__, chain.from_iterable(chain.from_iterable(parts))), np.uint64, len(group))
        h = _mixed(h + (group % self.fields).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        low = np.uint64((1 << 50) - 1)
        code = np.sort((group.astype(np.uint64) << np.uint64(50)) | (h & low))
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        use = np.arange(len(code)) - np.repeat(first, np.diff(np.concatenate([first, [len(code)]])))
        self.group = group
        self.start = np.cumsum(sizes) - sizes
        self.token = _mixed((code & low) + use.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)

    @property
    def row(self) -> np.ndarray:
        return self.group // self.fields

    def bins(self) -> np.ndarray:
        return (self.token & np.uint64(BINS - 1)).astype(np.int64)

    def ordered(self, order: Order) -> np.ndarray:
        """The tokens of each text and field, rare ones first."""
        uses = np.minimum(order.uses[self.bins()], (1 << 18) - 1).astype(np.uint64)
        code = np.sort((self.group.astype(np.uint64) << np.uint64(50)) | (uses << np.uint64(32)) | self.token)
        return code & np.uint64(0xFFFFFFFF)

    def sets(self, order: Order, band: np.ndarray) -> np.ndarray:
        """Token sets in bits, ``LONGS`` integers a text; tokens nearly everywhere are left out."""
        row, bins = self.row, self.bins()
        told = (order.everywhere[bins] >> band[row].astype(np.uint32)) & np.uint32(1) == 0
        bit = (self.token >> np.uint64(21)).astype(np.int64) & (_BAND_BITS[band][row] - 1)
        out = np.zeros((len(band), LONGS * 64), bool)
        out[row[told], bit[told]] = True
        return np.packbits(out, axis=1).view(np.int64)

    def keys(self, tokens: np.ndarray, order: Order, band: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and the row of each, of which two texts that agree and differ share one at least."""
        n = self.sizes[rows, 0]
        at = np.repeat(self.start[rows * self.fields], n // 6 + 1) + _ranges(n // 6 + 1)
        head, row = tokens[at], np.repeat(rows, n // 6 + 1)
        salt = _mixed(band.astype(np.uint64) + np.uint64(1))
        paired = (order.common[(head & np.uint64(BINS - 1)).astype(np.int64)] >> band[row].astype(np.uint32)) & np.uint32(1) == 1
        if self.fields == 1:
            paired &= (band[row] < _PAIRED_BAND) & (self.sizes[row, 0] > 1)
            lo, hi = at + 1, self.start[row] + np.minimum(self.sizes[row, 0], self.sizes[row, 0] // 6 + 2)
        else:
            lo = self.start[row * self.fields + 1]
            hi = lo + self.sizes[row, 1] // 6 + 1
        lo, times = lo[paired], (hi - lo)[paired]
        partner = tokens[np.repeat(lo, times) + _ranges(times)]
        pairs = (np.repeat(head[paired], times) << np.uint64(32)) | partner
        pair_row = np.repeat(row[paired], times)
        keys = [_mixed(head[~paired] ^ salt[row[~paired]]), _mixed(_mixed(pairs) ^ salt[pair_row])]
        return np.concatenate(keys), np.concatenate([row[~paired], pair_row])


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 of each size, one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _chunks(batches: Iterator[pa.RecordBatch], once: bool) -> Iterator[tuple[list[int], list[list[list[str]]]]]:
    """``(classes, parts)`` of the texts with words in every field; with ``once``, a class that this task has met lately is left out."""
    found, parts, size, met = [], [], 0, set()
    for batch in batches:
        for texts in batch.column(0).to_pylist():
            own = [words(t) for t in texts]
            if not all(own) or not own:
                continue
            name = _class(own)
            if once:
                if name in met:
                    continue
                if len(met) > 1_000_000:
                    met.clear()
                met.add(name)
            if parts and (len(parts) >= ROWS or size > WORDS or len(own) != len(parts[0])):
                yield found, parts
                found, parts, size = [], [], 0
            found.append(name)
            parts.append(own)
            size += sum(map(len, own))
    if parts:
        yield found, parts


def word_order(df: DataFrame, sample: int = ORDER_SAMPLE) -> Order:
    """The order of tokens by their uses in about ``sample`` rows, chosen by the hashes of their keys."""
    total = max(1, df.count())
    share = min(1.0, sample / total)
    few = df.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) <= int((1 << 40) * share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for _, parts in _chunks(batches, False):
            chunk = Chunk(parts, known)
            band = bands(chunk.total)
            code, c = np.unique(band[chunk.row] * BINS + chunk.bins(), return_counts=True)
            code = np.concatenate([code, band * BINS - 1 - BINS * 64])  # below 0: the texts of each band
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(np.concatenate([c, np.ones(len(band), np.int64)]))], ["code", "c"])

    counted = few.select("texts").mapInArrow(run, "code bigint, c bigint").groupBy("code").agg(F.sum("c").alias("c")).toArrow()
    code, c = counted.column("code").to_numpy(), counted.column("c").to_numpy()
    texts = np.ones(32)
    of_band = code < 0
    texts[(code[of_band] + 1 + BINS * 64) // BINS] = c[of_band]
    code, c = code[~of_band], c[~of_band]
    band, bins = code // BINS, code % BINS
    flags = []
    for ok in (c > max(1.0, COMMON * share), (c > 3) & (c > EVERYWHERE * texts[band])):
        flag = np.zeros(BINS, np.uint32)
        np.bitwise_or.at(flag, bins[ok], np.uint32(1) << band[ok].astype(np.uint32))
        flags.append(flag)
    return Order(np.bincount(bins, c, BINS).astype(np.int32), *flags)


def keyed(df: DataFrame, train: bool, order: Order) -> DataFrame:
    """``(k, class, n, total, w0 .. w31)`` of ``texts``: a row for each key of each text.

    ``n`` and ``total`` count the words of the first and of all fields, ``w`` is
    the token set.  The held-out side, the smaller as a rule, is looked up in the
    neighbouring bands of lengths.
    """
    shared = df.sparkSession.sparkContext.broadcast(order)
    names = ["k", "class", "n", "total", *[f"w{j}" for j in range(LONGS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, order = _Hashes(), shared.value
        for found, parts in _chunks(batches, True):
            chunk = Chunk(parts, known)
            tokens, own = chunk.ordered(order), bands(chunk.total)
            name = np.array(found, np.int64)
            for step in (0,) if train else (-1, 0, 1):
                band = np.clip(own + step, 0, 31)
                reached = (own == band) if step == 0 else (own != band) & (bands(np.maximum(1, np.where(step < 0, -(-5 * chunk.total // 6), 6 * chunk.total // 5))) == band)
                rows = np.flatnonzero(reached)
                if not len(rows):
                    continue
                k, row = chunk.keys(tokens, order, band, rows)
                bits = chunk.sets(order, band)
                ints = [k.view(np.int64), name[row], chunk.sizes[row, 0].astype(np.int32), chunk.total[row].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in ints), *(pa.array(bits[:, j][row]) for j in range(LONGS))], names)

    sides = df.filter("train" if train else "NOT train").select("texts")
    return sides.mapInArrow(run, "k bigint, class bigint, n int, total int, " + ", ".join(f"w{j} bigint" for j in range(LONGS)))


def candidates(df: DataFrame) -> DataFrame:
    """``(x, y)``: classes of a train and a held-out record that share a key and could agree by lengths and token sets."""
    order = word_order(df)

    def side(train: bool, own: str) -> DataFrame:
        rows = keyed(df, train, order).repartition("k").dropDuplicates(["k", "class"])  # the join follows this partitioning
        return rows.select("k", *[F.col(c).alias(own + c) for c in rows.columns if c != "k"])

    def alike(n: str) -> Column:
        return 6 * F.least("x" + n, "y" + n) >= 5 * F.greatest("x" + n, "y" + n)

    def covered(a: str, b: str) -> Column:
        missing = sum((F.bit_count(F.col(f"{a}w{j}").bitwiseAND(F.bitwise_not(f"{b}w{j}"))) for j in range(LONGS)), F.lit(0))
        return 6 * (F.col(a + "total") - missing) >= 5 * F.greatest("xtotal", "ytotal")

    fits = alike("total") & alike("n") & covered("x", "y") & covered("y", "x") & (F.col("xclass") != F.col("yclass"))
    return side(True, "x").join(side(False, "y"), "k").filter(fits).select(F.col("xclass").alias("x"), F.col("yclass").alias("y")).distinct()


def agreeing(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def almost_same(xs: list[list[str]], ys: list[list[str]], least: float = AGREE) -> bool:
    """Whether in every field at least ``least`` of the words of the longer text agree in order."""
    for a, b in zip(xs, ys):
        longer = least * max(len(a), len(b)) - 1e-9
        if min(len(a), len(b)) < longer or sum((Counter(a) & Counter(b)).values()) < longer or agreeing(a, b) < longer:
            return False
    return True


class _Texts(dict):
    """Words of the classes compared lately."""

    size = 0

    def of(self, name: int, texts: list[str]) -> list[list[str]]:
        found = self.get(name)
        if found is None:
            if self.size > KEPT_WORDS:
                self.clear()
                self.size = 0
            found = self[name] = [words(t) for t in texts]
            self.size += sum(map(len, found))
        return found


def cross_split(df: DataFrame) -> DataFrame:
    """``(id_a, id_b)``, ``id_a < id_b``, of ``(key bigint, train boolean, texts array<string>)``.

    Every pair of a train and a held-out record that are the same or almost the
    same in all fields.  Defined results: a record with a null, blank or
    wordless field, or with null ``train``, is in no pair; repeated keys count
    once; an empty table gives no rows.
    """
    df = df.filter(F.col("train").isNotNull() & F.col("key").isNotNull())
    members = cut(classes(df).distinct())
    linked = cut(candidates(df))
    heads = members.groupBy("class").agg(F.min("key").alias("key"))
    wanted = linked.select(F.col("x").alias("class")).unionAll(linked.select(F.col("y").alias("class"))).distinct().join(heads, "class")
    few = linked.count() <= MOST_BROADCAST
    wanted = cut(wanted)
    texts = df.select("key", "texts").join(F.broadcast(wanted) if few else wanted, "key").dropDuplicates(["class"]).select("class", "texts")
    together = linked.join(texts.select(F.col("class").alias("x"), F.col("texts").alias("tx")), "x").join(texts.select(F.col("class").alias("y"), F.col("texts").alias("ty")), "y")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Texts()
        for batch in batches:
            ok = [almost_same(held.of(x, tx), held.of(y, ty)) for x, y, tx, ty in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "tx", "ty")))]
            kept = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("x"), kept.column("y")], ["x", "y"])

    near = together.select("x", "y", "tx", "ty").mapInArrow(verify, "x bigint, y bigint")
    both = members.groupBy("class").agg(F.bool_or("train").alias("t"), F.bool_or(~F.col("train")).alias("o")).filter("t AND o")
    links = near.unionAll(both.select(F.col("class").alias("x"), F.col("class").alias("y")))
    t = members.filter("train").select(F.col("class").alias("x"), F.col("key").alias("kt"))
    o = members.filter("NOT train").select(F.col("class").alias("y"), F.col("key").alias("ko"))
    out = links.distinct().join(t, "x").join(o, "y").filter("kt != ko")
    return out.select(F.least("kt", "ko").alias("id_a"), F.greatest("kt", "ko").alias("id_b")).distinct()


def is_train(split: Column) -> Column:
    """True for train, false for any other named split, null for none; case and spaces are irrelevant."""
    name = F.lower(F.trim(split))
    return F.when(name == "", None).otherwise(name == "train")


def split_name(split: Column) -> Column:
    """One spelling of each split: dev and valid mean validation."""
    name = F.lower(F.trim(split))
    return F.when(name.isin("dev", "valid", "val", "validation"), "validation").otherwise(name)


def leak_report(df: DataFrame, pairs: DataFrame, key: str, split: str, source: str) -> DataFrame:
    """``(split, source, n, n_leaked)`` of the held-out records."""
    leaked = pairs.select(F.col("id_a").alias("k")).unionAll(pairs.select(F.col("id_b").alias("k"))).distinct()
    held = df.select(F.col(key).alias("k"), split_name(F.col(split)).alias("split"), F.col(source).alias("source")).filter("split != 'train'")
    marked = held.join(leaked.withColumn("leaked", F.lit(1)), "k", "left")
    return marked.groupBy("split", "source").agg(F.count("*").alias("n"), F.count("leaked").alias("n_leaked"))
