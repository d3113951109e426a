"""Reading level of prose, from sentences to documents (problem 9).

Every word gets two regularised level scores: its own mean level among rated
texts, shrunk towards the overall mean by its count, and a character score that
its letter groups give, so unseen words and other languages have one as well.
A regularised multinomial model turns a sentence's scores and shape into a
distribution over the levels; the word-weighted mean of the sentences'
distributions, their spread and the text's shape go into a second, calibrated
model whose cut points are set on ratings it was not fitted on.  The fit uses a
bounded sample of rated texts; every document is scored whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 4
LEAST_WORDS = 20
LEAST_PROSE = 0.6
#: Rated documents that the models are fitted on at most.
SAMPLE = 2000
SHRINK_WORD, SHRINK_CHARS = 8.0, 20.0
CHUNK = 24
_END = re.compile(r"(?<=[.!?;])[\"'”’»)]*\s+|\n+")
_TAG = re.compile(r"<[^<>\n]{1,60}>")
_PLAIN = re.compile(r"^[\"'“„«(\[*_>#-]*[^\W\d_]+(?:['’.-][^\W\d_]+)*[\"'”“’»)\].,;:!?*_…-]*$")
_SOLID = re.compile(r"[^\W_]")
_EDGE = "\"'“”„«»()[]{}*_>#.,;:!?…-–—"


def is_prose(tokens: list[str]) -> bool:
    """Enough words, most of them plain words: no table, log, record, settings or run of signs."""
    solid = [t for t in tokens if _SOLID.search(t)]
    if len(solid) < LEAST_WORDS:
        return False
    return sum(1 for t in tokens if _PLAIN.match(t)) >= LEAST_PROSE * len(tokens)


def sentences(text: str) -> list[list[str]]:
    """Sentences as token lists; a text without marks is cut every ``CHUNK`` words."""
    out: list[list[str]] = []
    for part in _END.split(_TAG.sub(" ", text)):
        tokens = part.split()
        if len(tokens) > 3 * CHUNK:
            out += [tokens[i : i + CHUNK] for i in range(0, len(tokens), CHUNK)]
        elif tokens:
            out.append(tokens)
    return out


def letter_groups(word: str) -> list[str]:
    """Groups of three letters of a word with its edges, its ending of four and its length."""
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)] + [w[-5:], f"#{min(len(word), 16)}"]


def softmax_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 200) -> np.ndarray:
    """Multinomial logistic weights, L2-penalised, by full-batch accelerated gradient descent."""
    w = np.zeros((x.shape[1], y.shape[1]))
    back, total = w.copy(), weight.sum()
    step = 1.0 / (0.5 * np.linalg.norm(x * np.sqrt(weight / total)[:, None], 2) ** 2 + penalty)
    for k in range(rounds):
        look = w + k / (k + 3) * (w - back)
        back = w
        p = softmax(x @ look)
        w = look - step * (x.T @ ((p - y) * (weight / total)[:, None]) + penalty * look)
    return w


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _soft_label(level: np.ndarray) -> np.ndarray:
    """A mean rating as weights on its two neighbouring levels."""
    low = np.clip(np.floor(level).astype(int), 1, LEVELS - 1)
    out = np.zeros((len(level), LEVELS))
    part = np.clip(level - low, 0, 1)
    rows = np.arange(len(level))
    out[rows, low - 1] = 1 - part
    out[rows, low] += part
    return out


@dataclass
class Scores:
    """The word scores; ``of`` keeps what it has seen."""

    words: dict[str, float]
    groups: dict[str, float]
    mean: float

    def __post_init__(self):
        self.seen: dict[str, tuple[float, float, float]] = {}

    def of(self, token: str) -> tuple[float, float, float]:
        """Word score, character score and letters of a token."""
        got = self.seen.get(token)
        if got is None:
            if len(self.seen) > 300_000:
                self.seen.clear()
            word = token.strip(_EDGE).lower()
            parts = [self.groups.get(g, self.mean) for g in letter_groups(word)]
            chars = sum(parts) / len(parts)
            got = self.seen[token] = (self.words.get(word, chars), chars, float(len(word)))
        return got


def fit_scores(texts: list[list[list[str]]], levels: np.ndarray) -> Scores:
    """Shrunken mean level of each word and letter group; a text counts once for each."""
    mean = float(levels.mean()) if len(levels) else (1 + LEVELS) / 2
    sums: list[dict[str, list[float]]] = [defaultdict(lambda: [0.0, 0.0]), defaultdict(lambda: [0.0, 0.0])]
    for doc, level in zip(texts, levels):
        words = {t.strip(_EDGE).lower() for s in doc for t in s}
        for table, keys in zip(sums, (words, {g for w in words for g in letter_groups(w)})):
            for k in keys:
                e = table[k]
                e[0] += level
                e[1] += 1
    word, group = [{k: (s + shrink * mean) / (n + shrink) for k, (s, n) in t.items() if n > 1} for t, shrink in zip(sums, (SHRINK_WORD, SHRINK_CHARS))]
    return Scores(word, group, mean)


def sentence_features(docs: list[list[list[str]]], scores: Scores) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all sentences of all documents, words a sentence, sentences a document."""
    lengths = np.array([len(s) for d in docs for s in d], np.int64)
    per_doc = np.array([len(d) for d in docs], np.int64)
    of = scores.of
    flat = np.array([of(t) for d in docs for s in d for t in s]).reshape(-1, 3)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    mean = np.add.reduceat(flat, starts, axis=0) / lengths[:, None] if len(lengths) else np.zeros((0, 3))
    high = np.maximum.reduceat(flat[:, 0], starts) if len(lengths) else np.zeros(0)
    spread = np.sqrt(np.maximum(0, np.add.reduceat(flat[:, 0] ** 2, starts) / lengths - mean[:, 0] ** 2)) if len(lengths) else np.zeros(0)
    long = np.add.reduceat((flat[:, 2] > 9).astype(float), starts) / lengths if len(lengths) else np.zeros(0)
    x = np.column_stack([np.ones(len(lengths)), mean[:, 0], mean[:, 1], mean[:, 2] / 5, high, spread, long, np.log1p(lengths)])
    return x, lengths, per_doc


def document_features(x: np.ndarray, p: np.ndarray, lengths: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """Word-weighted mean and spread of the sentences' distributions and features."""
    starts = np.concatenate([[0], np.cumsum(per_doc)[:-1]]).astype(np.int64)
    n = np.add.reduceat(lengths.astype(float), starts)[:, None]
    mean = lambda v: np.add.reduceat(v * lengths[:, None], starts, axis=0) / n
    level = (p @ np.arange(1, LEVELS + 1))[:, None]
    m = mean(level)
    sd = np.sqrt(np.maximum(0, mean(level**2) - m**2))
    return np.hstack([mean(p), m, m**2 / 4, sd, mean(x)])


@dataclass
class ReadingModel:
    """Fitted models; ``predict`` gives levels of tokenised documents."""

    scores: Scores
    scale: tuple[np.ndarray, np.ndarray]
    sentence: np.ndarray
    doc_scale: tuple[np.ndarray, np.ndarray]
    doc: np.ndarray
    cuts: np.ndarray

    def raw(self, docs: list[list[list[str]]]) -> np.ndarray:
        x, lengths, per_doc = sentence_features(docs, self.scores)
        p = softmax(_scaled(x, self.scale) @ self.sentence)
        f = document_features(x, p, lengths, per_doc)
        return np.hstack([np.ones((len(f), 1)), _scaled(f, self.doc_scale)]) @ self.doc

    def predict(self, docs: list[list[list[str]]]) -> np.ndarray:
        if not docs:
            return np.zeros(0, int)
        return 1 + np.searchsorted(self.cuts, self.raw(docs))


def _scaled(x: np.ndarray, scale: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (x - scale[0]) / scale[1]


def _scale_of(x: np.ndarray, keep_first: bool) -> tuple[np.ndarray, np.ndarray]:
    mu, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd < 1e-9] = 1.0
    if keep_first:
        mu[0], sd[0] = 0.0, 1.0
    return mu, sd


def best_cuts(raw: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Cut points between the levels that agree with most of the ratings, each searched on its own."""
    cuts = []
    for k in range(1, LEVELS):
        grid = np.linspace(k + 0.2, k + 0.8, 61)
        wrong = [np.sum(((raw > c) != (levels > k + 0.01)) * np.abs(levels - k - 0.5)) for c in grid]
        near = np.flatnonzero(np.array(wrong) <= min(wrong) + 1e-9)
        cuts.append(grid[near[len(near) // 2]])
    return np.maximum.accumulate(np.array(cuts))


def fit(docs: list[list[list[str]]], levels: np.ndarray, folds: int = 3, penalty: float = 1e-3, ridge: float = 3.0) -> ReadingModel:
    """Fit on tokenised rated documents and their mean ratings.

    Scores and sentence model that the document model learns from come from the
    other folds, so the second stage is calibrated on unseen texts.
    """
    levels = np.asarray(levels, float)
    n = len(docs)
    fold = np.arange(n) % max(1, min(folds, n // 2)) if n >= 4 else np.zeros(n, int)

    def stage_one(rows: np.ndarray):
        some = [docs[i] for i in rows]
        scores = fit_scores(some, levels[rows])
        x, lengths, per_doc = sentence_features(some, scores)
        scale = _scale_of(x, True)
        y = _soft_label(np.repeat(levels[rows], per_doc))
        return scores, scale, softmax_fit(_scaled(x, scale), y, lengths.astype(float), penalty)

    features = None
    for k in range(fold.max() + 1 if n else 0):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        scores, scale, w = stage_one(rest if len(rest) else own)
        x, lengths, per_doc = sentence_features([docs[i] for i in own], scores)
        f = document_features(x, softmax(_scaled(x, scale) @ w), lengths, per_doc)
        features = np.zeros((n, f.shape[1])) if features is None else features
        features[own] = f
    scores, scale, w = stage_one(np.arange(n))
    doc_scale = _scale_of(features, False)
    z = np.hstack([np.ones((n, 1)), _scaled(features, doc_scale)])
    solve = lambda a, b: np.linalg.solve(a.T @ a + ridge * np.diag([0.0] + [1.0] * (a.shape[1] - 1)), a.T @ b)
    held = np.zeros(n)
    for k in range(fold.max() + 1):
        rest, own = fold != k, fold == k
        held[own] = z[own] @ solve(z[rest] if rest.any() else z, levels[rest] if rest.any() else levels)
    return ReadingModel(scores, scale, w, doc_scale, solve(z, levels), best_cuts(held, levels))


def reading_levels(docs: DataFrame, ratings: DataFrame, doc_id: str = "doc_id", text: str = "text", level: str = "level", sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, level int)`` of every document of prose.

    ``ratings`` has ``(doc_id, level)``; null and impossible levels and ratings
    of no prose are left out, several of a document are averaged.  Defined
    results: null, blank, short and non-prose texts have no row; repeated rows
    have a row each; without any rating there is no scale and so no row.
    """
    mean = ratings.filter(F.col(level).between(1, LEVELS)).groupBy(doc_id).agg(F.avg(level).alias("_mean"))
    mean = mean.orderBy(F.xxhash64(doc_id), doc_id).limit(sample)
    rated = docs.select(doc_id, text).join(F.broadcast(mean), doc_id).filter(F.col(text).isNotNull()).select(text, "_mean").collect()  # at most the sample, but for repeated ids
    rows = sorted({(r[0], r[1]) for r in rated if is_prose(r[0].split())})
    id_type = docs.schema[doc_id].dataType.simpleString()
    if not rows:
        return docs.sparkSession.createDataFrame([], f"{doc_id} {id_type}, level int")
    model = fit([sentences(t) for t, _ in rows], np.array([m for _, m in rows]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, max(1, len(texts)), 1000):
                keep, parts = [], []
                for i in range(at, min(at + 1000, len(texts))):
                    t = texts[i]
                    if t and is_prose(t.split()):
                        keep.append(i)
                        parts.append(sentences(t))
                found = shared.value.predict(parts)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(found, pa.int32())], ["d", "level"])

    return docs.select(doc_id, text).mapInArrow(score, f"d {id_type}, level int").select(F.col("d").alias(doc_id), "level")
