"""Evaluation texts inside corpus documents (problem 8).

Both sides become templates: numbers, units and rare words (names) turn into
typed placeholders, so a question with other parameters still has the same
windows.  The windows of the items are a hash table of stated size; every
document is probed against it where it is read.  Items that share several of
their rarer windows with a document are aligned with it: runs of shared windows
are chained in the order of both texts, the chained words are the share held,
and the placeholders' values must map consistently.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.overlap import words

LEAST = 0.4
WINDOW = 5
#: A word is kept as it is when so many items use it, else it is a name.
COMMON = 3
#: Rarer windows stand in at most this share of the items; so many hits make an item a candidate.
RARE_SHARE = 0.01
HITS = 3
CONTENT = 3
GAP = 3
CONSISTENT = 0.5
#: Items are probed in blocks whose tables stay below this many windows, about 30 bytes each.
BLOCK_WINDOWS = 2_000_000
#: Words that stand for a unit of measure or money in four languages.
UNITS = frozenset(
    "percent per cent prozent pourcent ciento million millions millionen millones billion milliarden month months monat monate monaten mois mes meses "
    "year years jahr jahre jahren an ans ano anos day days tag tage tagen jour jours dia dias euro euros dollar dollars pound pounds coin coins eur usd".split()
)
_NUMBER = re.compile(r"\d")


@dataclass
class Items:
    """The templates of a block of items, ready to be probed."""

    ids: list[int] = field(default_factory=list)
    words: list[list[str]] = field(default_factory=list)
    vocabulary: dict[str, int] = field(default_factory=dict)
    keys: np.ndarray | None = None  # sorted window hashes, each with its items and places
    item: np.ndarray | None = None
    place: np.ndarray | None = None
    rare: np.ndarray | None = None


NUMBER, UNIT, NAME = 1, 2, 3


def template(tokens: list[str], vocabulary: dict[str, int]) -> np.ndarray:
    """Ids of the words; placeholders have the ids of their types."""
    get = vocabulary.get
    return np.fromiter((get(w) or (NUMBER if _NUMBER.search(w) else UNIT if w in UNITS else NAME) for w in tokens), np.int64, len(tokens))


def window_hashes(t: np.ndarray) -> np.ndarray:
    """Hash of each window; a window of placeholders mostly gives 0, which is in no table."""
    n = len(t) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    u = t.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    solid = np.zeros(n, np.int64)
    for i in range(WINDOW):
        part = u[i : i + n]
        h = h * np.uint64(0x9E3779B97F4A7C15) + part
        solid += part > NAME
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.where(solid >= CONTENT, h | np.uint64(1), np.uint64(0))


def prepare(rows: list[tuple[int, str]]) -> Items:
    """The window table of items ``(id, text)``; items without a full window are left out."""
    out = Items()
    tokens = [(i, words(t)) for i, t in rows]
    tokens = [(i, w) for i, w in tokens if len(w) >= WINDOW]
    uses = Counter(w for _, ws in tokens for w in set(ws))
    common = COMMON if len(tokens) >= 20 else 1
    kept = sorted(w for w, n in uses.items() if n >= common and not _NUMBER.search(w) and w not in UNITS)
    out.vocabulary = {w: k + NAME + 1 for k, w in enumerate(kept)}
    hashes, item, place = [], [], []
    for k, (i, ws) in enumerate(tokens):
        h = window_hashes(template(ws, out.vocabulary))
        at = np.flatnonzero(h)
        out.ids.append(i)
        out.words.append(ws)
        hashes.append(h[at])
        item.append(np.full(len(at), k))
        place.append(at)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    order = np.argsort(h, kind="stable")
    out.keys = h[order]
    out.item = (np.concatenate(item) if item else np.zeros(0, np.int64))[order]
    out.place = (np.concatenate(place) if place else np.zeros(0, np.int64))[order]
    # in how many items each window stands; an item with few rarer windows counts all of its own
    pairs = np.unique(np.stack([out.keys.astype(np.int64), out.item]), axis=1) if len(h) else np.zeros((2, 0), np.int64)
    values, n_items = np.unique(pairs[0], return_counts=True)
    spread = dict(zip(values.tolist(), n_items.tolist()))
    limit = max(2, RARE_SHARE * len(tokens))
    out.rare = np.array([spread[x] <= limit for x in out.keys.astype(np.int64).tolist()], bool)
    own = np.bincount(out.item[out.rare], minlength=len(tokens)) if len(h) else np.zeros(0, int)
    out.rare |= (own < 4 * HITS)[out.item] if len(h) else False
    return out


def block_of(whole: Items, first: int, last: int) -> Items:
    """Items ``first`` to ``last - 1`` of a window table; what is a word and what is rare stays as in the whole."""
    own = (whole.item >= first) & (whole.item < last)
    out = Items(whole.ids[first:last], whole.words[first:last], whole.vocabulary)
    out.keys, out.item, out.place, out.rare = whole.keys[own], whole.item[own] - first, whole.place[own], whole.rare[own]
    return out


def chain(places: np.ndarray, spots: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs ``(item place, document place, windows)`` of shared windows, chained in both orders.

    Each run is a maximal diagonal; the chain with the most windows wins.
    """
    order = np.lexsort((places, places - spots))
    p, s = places[order], spots[order]
    brk = np.flatnonzero((np.diff(p) != 1) | (np.diff(s) != 1)) + 1
    starts = np.concatenate([[0], brk])
    ends = np.concatenate([brk, [len(p)]])
    runs = sorted((int(p[a]), int(s[a]), int(b - a)) for a, b in zip(starts, ends))
    best = [r[2] for r in runs]
    back = [-1] * len(runs)
    for j, (pj, sj, nj) in enumerate(runs):
        for i in range(j):
            pi, si, ni = runs[i]
            if pi + ni <= pj and si + ni <= sj and best[i] + nj > best[j]:
                best[j], back[j] = best[i] + nj, i
    out, j = [], max(range(len(runs)), key=best.__getitem__)
    while j >= 0:
        out.append(runs[j])
        j = back[j]
    return out[::-1]


def held(runs: list[tuple[int, int, int]], item: list[str], doc: list[str]) -> float:
    """Share of an item's words that a chain holds, gaps of a few changed words included.

    A placeholder with another value keeps a window together but is no word held.
    """
    total, done, before = 0, 0, None
    for p, s, k in runs:
        end = p + k + WINDOW - 1
        if before and 0 < p - done <= GAP and abs((s - before) - (p - done)) <= 1:
            total += p - done
        total += sum(item[j] == doc[s + j - p] for j in range(max(done, p), end))
        done, before = max(done, end), s + k + WINDOW - 1
    return total / len(item)


def consistent(runs: list[tuple[int, int, int]], item: list[str], doc: list[str], vocabulary: dict[str, int]) -> bool:
    """Whether each placeholder value of the item mostly stands for one value of the document."""
    seen: dict[str, Counter[str]] = defaultdict(Counter)
    for p, s, k in runs:
        for i in range(k + WINDOW - 1):
            if item[p + i] not in vocabulary:
                seen[item[p + i]][doc[s + i]] += 1
    total = sum(sum(c.values()) for c in seen.values())
    agree = sum(c.most_common(1)[0][1] for c in seen.values())
    return agree >= CONSISTENT * total


def leaked_items(tokens: list[str], items: Items, least: float = LEAST) -> list[int]:
    """Ids of the items that a document of these words holds."""
    h = window_hashes(template(tokens, items.vocabulary))
    lo = np.searchsorted(items.keys, h, "left")
    hi = np.searchsorted(items.keys, h, "right")
    hit = np.flatnonzero((hi > lo) & (h > 0))
    if len(hit) < HITS:
        return []
    sizes = (hi - lo)[hit]
    rows = np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    spots = np.repeat(hit, sizes)
    rare = items.rare[rows]
    counts = np.bincount(items.item[rows[rare]], minlength=len(items.ids))
    out = []
    for k in np.flatnonzero(counts >= HITS):
        mine = items.item[rows] == k
        runs = chain(items.place[rows[mine]], spots[mine])
        if held(runs, items.words[k], tokens) >= least and consistent(runs, items.words[k], tokens, items.vocabulary):
            out.append(items.ids[k])
    return out


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """``(doc_id, item_id)``: documents that hold at least ``least`` of an item's words in order.

    The items are the stated query set: they are read to the driver, made
    templates over one vocabulary, and probed in blocks of at most
    ``BLOCK_WINDOWS`` windows, each block against all documents; the blocks do
    not change the result.  Defined results: null, empty and short texts (fewer
    than ``WINDOW`` words) hold nothing and are held nowhere; repeated rows give
    one row; an empty side gives no rows.
    """
    spark = docs.sparkSession
    rows = [(r[0], r[1]) for r in items.select(item_id, text).filter(F.col(text).isNotNull() & F.col(item_id).isNotNull()).distinct().toLocalIterator()]
    whole = prepare(sorted(rows))
    bounds, size = [0], 0
    for k, n in enumerate(np.bincount(whole.item, minlength=len(whole.ids)).tolist()):
        if size and size + n > BLOCK_WINDOWS:
            bounds.append(k)
            size = 0
        size += n
    blocks = [block_of(whole, a, b) for a, b in zip(bounds, [*bounds[1:], len(whole.ids)])]
    doc_type, item_type = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    out = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)

        def probe(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, found = [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    if t:
                        for k in leaked_items(words(t), shared.value, least):
                            at.append(i)
                            found.append(k)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, batch_type)], ["d", "i"])

        batch_type = pa.int64() if item_type == "bigint" else pa.int32() if item_type == "int" else pa.string()
        part = docs.select(F.col(doc_id), F.col(text)).mapInArrow(probe, f"d {doc_type}, i {item_type}")
        out = part if out is None else out.unionAll(part)
    return out.distinct().select(F.col("d").alias(doc_id), F.col("i").alias(item_id))
