"""Personal data in free text, found and replaced (problem 6).

Patterns propose candidate mentions; a skip-chain conditional random field
labels them.  Its nodes are a text's candidates, its unary potentials a
regularised log-linear model of shape and context, its edges tie neighbours and,
across any distance, candidates with a token the same or alike (a name, a number,
an address); loopy message passing settles the labels of the whole text.

The marks to learn from are incomplete, so a first model learns which candidates
get marked and divides by the share of true mentions that are marked; features
and ties are then fitted together, by pseudo-likelihood, to what follows.  Given
names and common words are counted over all texts, the weights are learned from
a bounded sample of them.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("O", "email", "phone", "id_number", "address", "name")
#: Label names of the marks, folded to letters, and the kind each stands for.
LABELS = {
    "emailaddress": "email", "email": "email", "phonenumber": "phone", "telephonenum": "phone", "phone": "phone", "idcardnumber": "id_number", "taxnum": "id_number",
    "socialnum": "id_number", "passport": "id_number", "accountnumber": "id_number", "streetaddress": "address", "street": "address", "address": "address",
    "personname": "name", "firstname": "name", "givenname": "name", "person": "name", "name": "name", "surname": "name",
}
#: Texts that the model is fitted on at most.
SAMPLE = 12_000
COMMON_SHARE = 0.0006
#: Marked names that a given name is the first word of, at least.
LEAST_MARKS = 3
ROUNDS = 24
#: Strongest tie.
MOST_TIE = 2.0
#: Features seen less often are one feature; a weight's pull to 0 counts as so many candidates.
LEAST_USES = 12
PULL = 4.0
#: Candidates of at least this share of the top markable rate count as true when the rate of marks is taken.
MARKABLE = 0.3
#: A candidate as markable as this share of a true mention's rate is surely one: what is never personal is hardly ever marked.
LENIENT = 0.45
_W = r"[^\W\d_]"
_WORD = rf"{_W}[\w'’-]*"
_TOWN = rf"{_W}[\w'’-]+"
#: The words by which streets and houses are known in four languages.
_EN = r"(?:road|rd|street|st|lane|ln|avenue|ave|close|drive|dr|court|ct|way|place|pl|square|sq|terrace|boulevard|blvd|crescent|park|hill|row)\b\.?"
_FR = r"(?:rue|avenue|av\.|boulevard|bd|place|chemin|all[ée]e|impasse|quai|route|cours)"
_ES = r"(?:calle|c/|avda\.?|avenida|av\.|plaza|pza\.?|paseo|ronda|camino|carrer)"
_DE = r"(?:stra(?:ß|ss)e|str\.|weg|platz|gasse|allee|ring|damm|ufer|steig)"
_SEP = r",?\s{1,3}"
FAMILIES = {
    "english": re.compile(rf"\d{{1,4}}[a-z]?\s(?:{_WORD}\s){{1,3}}{_EN},\s{{1,3}}{_TOWN}(?:{_SEP}(?:[A-Z]{{2}}\s)?\d{{4,6}}\b)?", re.I),
    "postcode": re.compile(
        rf"\b(?:(?:am|an der|auf der|im|zum|zur)\s)?{_W}[\w-]*{_DE}\s?\d{{1,4}}\s?[a-z]?,\s{{1,3}}\d{{5}}\s{_TOWN}"
        rf"|\b\d{{1,4}}(?:\s(?:bis|ter|quater))?,?\s{_FR}\s(?:(?:du|de la|des|de l['’]|de|d['’])\s?)?{_WORD}(?:\s{_WORD})?,\s{{1,3}}\d{{5}}\s{_TOWN}"
        rf"|\b{_ES}\s(?:(?:de la|del|de)\s)?{_WORD}(?:\s{_WORD})?,?\s\d{{1,4}}(?:,\s\d{{1,2}}\s?[ºª°]\w?)?,\s{{1,3}}\d{{5}}\s{_TOWN}",
        re.I,
    ),
    "number": re.compile(
        r"(?=[a-z]{0,3} ?[+(]?\d)(?:"
        r"\+\d{1,3}[ .-]?(?:\(\d\)[ .-]?)?\d(?:[\d]|[ .-](?=\d)){5,14}\d"
        r"|00 ?\d{1,3}[ .-]?\d(?:\d|[ .-](?=\d)){6,13}\d"
        r"|\(\d{2,4}\)[ -]?\d{3}[ -]?\d{3,5}"
        r"|[a-z]{2}\d{2}(?: ?\d{4}){3,6}(?: ?\d{1,3})?"
        r"|[a-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[a-z]\b"
        r"|[a-z]{2}\d{6}-\d{3}|[a-z]\d{7}[a-z]|[a-z]{1,3}\d{6,10}"
        r"|\d{3}-\d{2}-\d{4}|\d\.\d{3}\.\d{4}\.\d{4}|\d{3}\.\d{3}\.\d{3}|0\d{1,2}(?:[. ]\d{2}){4}"
        r"|0\d{1,4} ?/ ?\d{3,8}(?:-\d{2,4})?|0\d{2,4} \d{2,6}(?: \d{2,5}){0,3}|\d{2} \d{3} \d{2} \d{2}"
        r"|\d{3}-\d{4}|\d{8,12}|\d{2,5}-\d{2,4}-\d{3,6}|\d{2} \d{3} \d{3} \d{3}"
        r")(?![\w/@]|[.,-]\d)",
        re.I,
    ),
}
_AT = re.compile(r"@|[\[(]\s?at\s?[\])]", re.I)
_LOCAL = re.compile(r"[\w.+%-]{1,64}\s?\Z")
_DOMAIN = re.compile(r"\s?([\w-]{1,60}(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)[a-z0-9-]{2,40})+(?<!-))", re.I)
_DIGITS = re.compile(r"\d+")
_HOUSE = re.compile(r"\d{1,4}[A-Za-z]?(?=\s[^\W\d_])")
_FLAT = re.compile(r"\b(?:flat|apt\.?|unit|suite)\s\d{1,4}[a-z]?,\s{1,3}\Z", re.I)
_BEFORE = re.compile(rf"(?<![\w@.+-])({_W}[\w’'-]{{2,}}),[  \n]\Z")
_AFTER = re.compile(rf"(?:[  \n]([A-ZÀ-Þ])\.)?(?:[  \n]({_W}[\w’'-]{{2,}}))?")
_INITIAL = re.compile(rf"([A-ZÀ-Þ])\.[  ]({_W}[\w’'-]{{3,}})")
_TOKEN = re.compile(rf"{_W}+")
_GAP = "[  \n]"
_DIGIT = re.compile(r"\d")
_NAME = re.compile(rf"(?:{_W}|[-'’])+")
_NO_GIVEN = re.compile(r"[\w@+]|\.\w|-\w*@")
_SOFT = re.compile(r"(?<=.)[aeiouyh]+")
_TWICE = re.compile(r"(.)\1+")
_LETTER = re.compile(_W)


@dataclass
class Lexicon:
    """Given names and common words, folded to lower case."""

    given: frozenset[str] = frozenset()
    common: frozenset[str] = frozenset()

    def places(self, text: str) -> list[tuple[int, int]]:
        """Where given names stand as words of their own, in order; most texts are told by one look at their words."""
        low = text.lower()
        there = self.given.intersection(_TOKEN.findall(low))
        if not there:
            return []
        if len(low) != len(text):  # a letter whose lower case is longer: look at the words of the text itself
            found = [m.span() for m in _TOKEN.finditer(text) if m[0].lower() in there]
        else:
            found = []
            for name in there:
                at = low.find(name)
                while at >= 0:
                    found.append((at, at + len(name)))
                    at = low.find(name, at + 1)
            found.sort()
        return [(a, b) for a, b in found if not (a and (text[a - 1].isalnum() or text[a - 1] in "_@.+-")) and not _NO_GIVEN.match(text, b)]

    def is_surname(self, word: str | None, like: str) -> bool:
        """A coined word, written as the given name beside it is."""
        if not word or len(word) < 4 or not _NAME.fullmatch(word):
            return False
        if like[:1].isupper() and not word[0].isupper():
            return False
        return not any(p.lower() in self.common for p in re.split(r"[-'’]", word) if p)


@dataclass(frozen=True)
class Candidate:
    start: int
    end: int
    family: str


def _is_word(c: str, more: str) -> bool:
    return c.isalnum() or c == "_" or c in more


def candidates(text: str, lexicon: Lexicon) -> list[Candidate]:
    """Proposed mentions, in order and without overlaps; emails and addresses go before numbers and names."""
    found: list[Candidate] = []
    taken: list[tuple[int, int]] = []

    def add(start: int, end: int, family: str) -> None:
        if all(end <= a or start >= b for a, b in taken):
            found.append(Candidate(start, end, family))
            taken.append((start, end))

    if "@" in text or "[" in text or "(" in text:
        for m in _AT.finditer(text):
            local = _LOCAL.search(text, max(0, m.start() - 65), m.start())
            domain = _DOMAIN.match(text, m.end())
            if local and domain and _LETTER.search(domain[1].rpartition(".")[2].rpartition(" ")[2]):
                add(local.start(), domain.end(), "email")
    runs = [m.span() for m in _DIGITS.finditer(text)]  # every pattern with digits is tried around a run of them alone
    for a, b in runs:
        if b - a == 5 and text[b : b + 1].isspace() and not (a and _is_word(text[a - 1], ".-")):
            for m in FAMILIES["postcode"].finditer(text, max(0, a - 100), min(len(text), b + 60)):
                if m.start() < a < m.end():
                    add(m.start(), m.end(), "address")
    for a, b in runs:
        if b - a < 5 and not (a and _is_word(text[a - 1], ".,+/-")) and _HOUSE.match(text, a) and (m := FAMILIES["english"].match(text, a)):
            flat = _FLAT.search(text, max(0, a - 16), a)
            add(flat.start() if flat else a, m.end(), "address")
    done = 0
    for a, _ in runs:
        for at in range(max(done, a - 5), a + 1):
            if not (at and _is_word(text[at - 1], "#/@.-")) and (m := FAMILIES["number"].match(text, at)):
                add(at, m.end(), "number")
                done = m.end()
                break
    for start, end in lexicon.places(text):
        given, tail = text[start:end], _AFTER.match(text, end)
        initial, after = tail.groups()
        if after and lexicon.is_surname(after, given):
            end = tail.end()
        elif initial and not after:
            end = tail.end()
        elif not initial and (before := _BEFORE.search(text, max(0, start - 48), start)) and lexicon.is_surname(before[1], given):
            start = before.start()
        add(start, end, "name")
    for m in _INITIAL.finditer(text):
        if not (m.start() and _is_word(text[m.start() - 1], ".")) and lexicon.is_surname(m[2], m[1]):
            add(m.start(), m.end(), "initial")
    return sorted(found, key=lambda c: c.start)


def shape(s: str) -> str:
    """Digits as 0, capitals as A, other letters as a; runs of letters are one."""
    s = _DIGIT.sub("0", s)
    s = re.sub(r"[A-ZÀ-Þ]+", "A", s)
    return re.sub(r"[a-zß-ÿ]+", "a", s)[:40]


def _word_before(text: str, at: int) -> list[str]:
    return text[max(0, at - 48) : at].split()[-2:]


def features(text: str, c: Candidate) -> list[str]:
    """Context and shape of a candidate as strings."""
    before = _word_before(text, c.start)
    last = _DIGIT.sub("0", before[-1].lower()) if before else "^"
    two = _DIGIT.sub("0", " ".join(before).lower()) if len(before) > 1 else "^ " + last
    after = text[c.end : c.end + 24].split()
    nxt = shape(after[0]) if after and (_DIGIT.search(after[0]) or len(after[0]) < 2) else _DIGIT.sub("0", after[0].lower()) if after else "$"
    glued = text[c.end : c.end + 1]
    s = shape(text[c.start : c.end]) if c.family in ("number", "initial", "name") else ""
    f = c.family
    return [f, f"{f}|s={s}", f"{f}|p={last}", f"{f}|q={''.join(_TOKEN.findall(last))}", f"{f}|pp={two}", f"{f}|n={nxt}", f"{f}|d={nxt[:1] == '0'}", f"{f}|g={glued if not glued.isalnum() else 'x'}", f"{f}|s={s}|p={last}"]


def allowed(family: str) -> tuple[int, ...]:
    """Labels a candidate of a family can have."""
    if family == "number":
        return (0, 2, 3)
    return (0, KINDS.index("name" if family == "initial" else family))


def link_keys(text: str, c: Candidate) -> set[tuple[str, str]]:
    """What a candidate has to share with another one to be tied to it: ``same`` tokens, or ``alike`` ones."""
    s = text[c.start : c.end].lower()
    if c.family in ("name", "initial"):
        tokens = {w for w in _TOKEN.findall(s) if len(w) > 2}
        return {("same", w) for w in tokens} | {("alike", k) for w in tokens if len(k := skeleton(w)) > 2}
    if c.family == "number":
        bare = re.sub(r"\W", "", s)
        return {("same", bare), ("alike", bare[-7:])} if len(bare) > 7 else {("same", bare)}
    return {("same", re.sub(r"\s+", " ", s)), ("alike", re.sub(r"[\W_]+", "", s))}


@lru_cache(100_000)
def skeleton(word: str) -> str:
    """What spellings of a name share: no accents, no vowels behind the first letter, no doubled letters."""
    plain = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    return _TWICE.sub(r"\1", _SOFT.sub("", plain))


TIES = ("same", "alike", "chain")


def edges(text: str, nodes: list[Candidate]) -> list[tuple[int, int, int]]:
    """``(a, b, kind of tie)``: to the next candidate nearby and, across any distance, to the next one with a token the same or alike."""
    out: dict[tuple[int, int], int] = {}
    last: dict[tuple[str, str], int] = {}
    for j, c in enumerate(nodes):
        if j and nodes[j - 1].family == c.family and c.start - nodes[j - 1].end < 60:
            out[j - 1, j] = 2
        for k in link_keys(text, c):
            if k in last:
                e, kind = (last[k], j), TIES.index(k[0])
                out[e] = min(out.get(e, kind), kind)
            last[k] = j
    return [(a, b, k) for (a, b), k in out.items()]


@dataclass
class FieldModel:
    """Weights of the field, fitted together; ``label`` settles the candidates of texts."""

    lexicon: Lexicon
    weights: dict[str, tuple[float, ...]]
    ties: tuple[float, ...] = (0.0, 0.0, 0.0)

    def unary(self, text: str, nodes: list[Candidate]) -> list[list[float]]:
        """Log potentials, one row a node; labels a family cannot have are very low."""
        get, rare = self.weights.get, self.weights.get("rare")
        out = []
        for c in nodes:
            found = [w for f in features(text, c) if (w := get(f, rare)) is not None]
            row = [-30.0] * len(KINDS)
            for k in allowed(c.family):
                row[k] = sum((w[k] for w in found), 0.0)
            out.append(row)
        return out

    def label_all(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """Mentions ``(start, end, kind)`` of each text; one round of messages goes through all texts at once."""
        nodes, unary, ties, begin = [], [], [], []
        for t in texts:
            begin.append(len(unary))
            own = candidates(t, self.lexicon) if t else []
            nodes.append(own)
            if own:
                ties += [(a + begin[-1], b + begin[-1], self.ties[k]) for a, b, k in edges(t, own)] if len(own) > 1 else []
                unary += self.unary(t, own)
        if not unary:
            return [[] for _ in texts]
        best = messages(np.array(unary), ties).argmax(axis=1).tolist()
        return [[(c.start, c.end, KINDS[k]) for c, k in zip(own, best[at : at + len(own)]) if k] for own, at in zip(nodes, begin)]

    def label(self, text: str) -> list[tuple[int, int, str]]:
        """Mentions ``(start, end, kind)`` of a text."""
        return self.label_all([text])[0]


def messages(unary: np.ndarray, ties: list[tuple[int, int, float]], rounds: int = ROUNDS) -> np.ndarray:
    """Beliefs after loopy sum-product message passing with damped updates; ties reward equal labels.

    All messages of a round are sent at once, so texts do not affect each other.
    """
    if not ties:
        return unary
    a, b = (np.array([t[i] for t in ties], np.int64) for i in (0, 1))
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    gain = np.tile(np.exp(np.array([t[2] for t in ties])) - 1.0, 2)[:, None]
    back = np.roll(np.arange(len(src)), len(a))
    msg = np.zeros((len(src), unary.shape[1]))
    belief = unary
    for _ in range(rounds):
        z = belief[src] - msg[back]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        new = np.log(e.sum(axis=1, keepdims=True) + gain * e)
        msg = 0.5 * (msg + new - new.max(axis=1, keepdims=True))
        belief = unary + np.stack([np.bincount(dst, msg[:, k], len(unary)) for k in range(unary.shape[1])], axis=1)
    return belief


def _kind(label: str | None) -> str | None:
    return LABELS.get(re.sub(r"[^a-z]", "", (label or "").lower()))


def _marks(text: str, spans) -> list[tuple[int, int, str]]:
    """Marks of a kind within the text, white space and punctuation around them trimmed."""
    out = []
    for s in spans or []:
        kind = _kind(s["label"]) if s is not None else None
        if kind and s["start"] is not None and s["end"] is not None and 0 <= s["start"] < s["end"] <= len(text):
            out.append((s["start"], s["end"], kind))
    return out


def _count(rows: Iterable[tuple[str, list]], uses: Counter[str], first: Counter[str]) -> None:
    """Add how many texts use a word, and how many marked names a word is the first of."""
    for text, spans in rows:
        uses.update(set(_TOKEN.findall(text.lower())))
        for a, b, kind in _marks(text, spans):
            if kind == "name":
                part = text[a:b]
                head = part.partition(",")[2] or part
                token = _TOKEN.match(head.strip())
                if token and len(token[0]) > 2:
                    first[token[0].lower()] += 1


def _lexicon(uses: dict[str, int], first: dict[str, int], total: int) -> Lexicon:
    least = max(3, COMMON_SHARE * total)
    # a name seen first in several names; surnames are coined and do not repeat like this
    given = {w for w, n in first.items() if n >= max(LEAST_MARKS, 0.02 * uses[w]) and n >= 0.04 * uses[w]}
    return Lexicon(frozenset(given), frozenset(w for w, n in uses.items() if n >= least and w not in given))


def learn_lexicon(rows: list[tuple[str, list]]) -> Lexicon:
    """Given names from marked names, common words from how many texts use a word."""
    uses: Counter[str] = Counter()
    first: Counter[str] = Counter()
    _count(rows, uses, first)
    return _lexicon(uses, first, len(rows))


def learn_lexicon_on(df: DataFrame, total: int, text: str = "text", spans: str = "spans") -> Lexicon:
    """``learn_lexicon`` over all ``total`` rows; the driver gets only words that are common or begin several marked names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses: Counter[str] = Counter()
        first: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            found = list(uses)
            return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([uses[w] for w in found], pa.int64()), pa.array([first[w] for w in found], pa.int64())], ["word", "uses", "first"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            _count(zip(texts, batch.column(1).to_pylist()), uses, first)
            if len(uses) > 400_000:
                uses.update(dict.fromkeys(first, 0))  # a mark within a word begins with what is no word of the text
                yield counted()
                uses.clear()
                first.clear()
        uses.update(dict.fromkeys(first, 0))
        yield counted()

    words = df.select(text, spans).mapInArrow(run, "word string, uses bigint, first bigint").groupBy("word").agg(F.sum("uses").alias("uses"), F.sum("first").alias("first"))
    found = words.filter((F.col("first") >= LEAST_MARKS) | (F.col("uses") >= max(3, COMMON_SHARE * total))).collect()
    return _lexicon({r[0]: r[1] for r in found}, {r[0]: r[2] for r in found if r[2]}, total)


def _pseudo_likelihood(x: np.ndarray, y: np.ndarray, mask: np.ndarray, n_features: int, ties: np.ndarray | None, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and ties that make each label most likely given the labels tied to it; accelerated gradient steps.

    ``ties`` counts, for each node, kind of tie and label, the tied nodes with that label.
    """
    count = np.bincount(x.ravel(), minlength=n_features).astype(float)
    w = np.zeros((n_features, len(KINDS)))
    back, target = w.copy(), np.eye(len(KINDS))[y]
    t = np.zeros(0 if ties is None else ties.shape[1])
    weight = None if ties is None else (ties**2).sum(axis=(0, 2)) + 10
    step = 1.0 / (0.5 * (x.shape[1] + (0 if ties is None else ties.shape[1])))
    for k in range(rounds):  # each feature's step is scaled by its count, which preconditions rare ones
        look = w + k / (k + 3) * (w - back)
        back = w
        z = look[x].sum(axis=1) + mask
        if ties is not None:
            z = z + np.tensordot(ties, t, (1, 0))
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = np.stack([np.bincount(x.ravel(), np.repeat((p - target)[:, j], x.shape[1]), n_features) for j in range(len(KINDS))], axis=1)
        w = look - step * (g + PULL * look) / (count + 10)[:, None]
        if ties is not None:
            t = np.clip(t - step * (np.einsum("ik,itk->t", p - target, ties) + PULL * t) / weight, 0.0, MOST_TIE)
    return w, t


def _posterior(x: np.ndarray, w: np.ndarray, mask: np.ndarray) -> np.ndarray:
    z = w[x].sum(axis=1) + mask
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, list]], rounds: int = 150, lexicon: Lexicon | None = None) -> FieldModel:
    """Fit the field on ``(text, spans)`` whose marks may be incomplete; the lexicon is learned from them if there is none.

    First the share of true mentions that are marked is estimated from which
    candidates get marked, and divided out; the labels that follow are what the
    field, its features and its ties together, is fitted to by pseudo-likelihood.
    """
    lexicon = lexicon or learn_lexicon(rows)
    index: dict[str, int] = {}
    feats, labels, families, tied = [], [], [], []
    uses: Counter[str] = Counter()
    found = []
    for text, spans in rows:
        own = candidates(text, lexicon)
        told = [features(text, c) for c in own]
        for f in told:
            uses.update(f)
        found.append((own, told))
    for (text, spans), (own, told) in zip(rows, found):
        marks = _marks(text, spans)
        tied += [(a + len(feats), b + len(feats), k) for a, b, k in edges(text, own)] if len(own) > 1 else []
        for c, f in zip(own, told):
            kind = next((k for a, b, k in marks if a < c.end and c.start < b and KINDS.index(k) in allowed(c.family)), "O")
            feats.append([index.setdefault(x if uses[x] >= LEAST_USES else "rare", len(index)) for x in f])
            labels.append(KINDS.index(kind))
            families.append(c.family)
    if not feats:
        return FieldModel(lexicon, {})
    x, y = np.array(feats), np.array(labels)
    mask = np.full((len(y), len(KINDS)), -1e9)
    for i, f in enumerate(families):
        mask[i, list(allowed(f))] = 0.0
    p = _posterior(x, _pseudo_likelihood(x, y, mask, len(index), None, rounds)[0], mask)
    marked = np.ones(len(KINDS))
    for k in range(1, len(KINDS)):
        own = p[y == k, k]
        if len(own) < 20:
            marked[k] = 0.5
            continue
        rate = float(own.mean())
        for _ in range(4):  # the rate among the candidates that look markable, which settles at once
            rate = float(np.mean(y[p[:, k] >= MARKABLE * rate] == k))
        marked[k] = rate
    true = np.minimum(p / (LENIENT * marked), 1.0)
    true[:, 0] = 1 - np.minimum(true[:, 1:].sum(axis=1), 1.0)
    likely = np.where(y > 0, y, true.argmax(axis=1))  # a mark is right; what is left out is judged by the rate
    ties = np.zeros((len(y), len(TIES), len(KINDS)))
    for a, b, k in tied:
        ties[a, k, likely[b]] += 1
        ties[b, k, likely[a]] += 1
    w, t = _pseudo_likelihood(x, likely, mask, len(index), ties, rounds)
    return FieldModel(lexicon, {f: tuple(w[i].tolist()) for f, i in index.items()}, tuple(t.tolist()))


def fit_on(df: DataFrame, key: str, text: str = "text", spans: str = "spans", sample: int = SAMPLE) -> FieldModel:
    """Fit on the at most ``sample`` rows with the smallest hashes of their ids, with a lexicon from all rows.

    A count sets the hash bound that a little more than ``sample`` rows pass, so
    the tasks send the driver about the sample, however many they are.
    """
    marked = df.filter(F.col(text).rlike(r"\S")).select(key, text, spans, F.pmod(F.xxhash64(key), F.lit(1 << 40)).alias("_h"))
    total = marked.count()
    bound = int((1 << 40) * min(1.0, (sample + 6 * sample**0.5) / max(1, total)))
    few = marked.filter(F.col("_h") <= bound).orderBy("_h", key).limit(sample)
    return fit([(r[1], r[2]) for r in few.collect()], lexicon=learn_lexicon_on(marked, total, text, spans))


def find_personal(df: DataFrame, key: str, model: FieldModel, text: str = "text") -> DataFrame:
    """``(key, start_pos, end_pos, kind)``: every mention in every text, offsets in code points.

    Defined results: null and blank texts have no mentions; repeated rows have
    theirs each; an empty table gives no rows; other columns do not matter.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, a, b, kinds = [], [], [], []
            for i, mentions in enumerate(shared.value.label_all(batch.column(1).to_pylist())):
                for start, end, kind in mentions:
                    at.append(i)
                    a.append(start)
                    b.append(end)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(kinds, pa.string())], ["key", "start_pos", "end_pos", "kind"])

    return df.select(key, text).mapInArrow(run, f"key {key_type}, start_pos int, end_pos int, kind string").withColumnRenamed("key", key)


def redact(text: str, mentions: list[tuple[int, int, str]]) -> str:
    """The text with ``[KIND]`` in place of each mention."""
    out, at = [], 0
    for start, end, kind in sorted(mentions):
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, key: str, model: FieldModel, text: str = "text") -> DataFrame:
    """``(key, text)``: every row with typed placeholders for its mentions; null stays null."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            texts = [redact(t, m) if m else t for t, m in zip(texts, shared.value.label_all(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    return df.select(key, text).mapInArrow(run, f"key {key_type}, text string").withColumnRenamed("key", key)
