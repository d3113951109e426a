"""Tokens, offsets, labels and prompts as Column expressions."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters, digits and underscores of any script: what a word character is in Python and RE2 alike.
WORD = r"[\p{L}\p{N}_]+"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squash(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def word_tokens(text: Column) -> Column:
    """Lower-case words; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


_WORDS = re.compile(r"\w+")
_TOKEN_TYPE = pa.list_(pa.struct([("tok", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


_SPARK_TYPE = T.ArrayType(T.StructType([T.StructField("tok", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.arrow_udf(_SPARK_TYPE)
def _offsets(texts: pa.Array) -> pa.Array:
    lengths, toks, starts, ends = [0], [], [], []
    valid = []
    for t in texts.to_pylist():
        valid.append(t is not None)
        for m in _WORDS.finditer(t or ""):
            toks.append(m.group())
            starts.append(m.start())
            ends.append(m.end())
        lengths.append(len(toks))
    rows = pa.StructArray.from_arrays([pa.array(toks, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], fields=list(_TOKEN_TYPE.value_type))
    return pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), rows, mask=pa.array([not v for v in valid], pa.bool_()))


def tokens_with_offsets(text: Column) -> Column:
    """Array of ``struct(tok, start, end)`` in code points, half-open, case kept; null for null.

    Spark has no function for all match positions, and adding up lengths in a
    fold copies the array at every word, so this is an Arrow function.
    """
    return _offsets(text)


@F.arrow_udf(T.IntegerType())
def _runs(queries: pa.Array, passages: pa.Array) -> pa.Array:
    out = []
    for q, p in zip(queries.to_pylist(), passages.to_pylist()):
        best, ends = 0, {}
        if q and p:
            words, places = _WORDS.findall(q), defaultdict(list)
            wanted = set(words)
            for i, w in enumerate(_WORDS.findall(p)):
                if w in wanted:
                    places[w].append(i)
            for w in words:  # runs by the place they end at in the passage
                ends = {i: ends.get(i - 1, 0) + 1 for i in places.get(w, ())}
                best = max(best, max(ends.values(), default=0))
        out.append(best)
    return pa.array(out, pa.int32())


def longest_run(query: Column, passage: Column) -> Column:
    """Words of the longest run of the query that the passage repeats, case aside; 0 without any.

    Row by row: a run is found where both texts are, so nothing is shuffled.
    """
    return _runs(F.lower(query), F.lower(passage))


@F.arrow_udf(T.IntegerType())
def _shared(a: pa.Array, b: pa.Array) -> pa.Array:
    both = zip(a.to_pylist(), b.to_pylist())
    return pa.array([sum((Counter(x.split(" ")) & Counter(y.split(" "))).values()) if x and y else 0 for x, y in both], pa.int32())


def shared_words(a: Column, b: Column) -> Column:
    """Words, parted by single spaces, that two texts have in common, as multisets."""
    return _shared(a, b)


def window_starts(n: Column, size: int, overlap: int, least: int = 0) -> Column:
    """Window numbers of ``size`` tokens with ``overlap``: a later window needs ``least`` tokens, none begins after the end is reached."""
    stride = size - overlap
    if stride <= 0:
        raise ValueError("overlap must be below size")
    last = F.greatest(F.lit(0), F.ceil((n - size) / stride)).cast("int")
    every = F.sequence(F.lit(0), last)
    kept = F.filter(every, lambda k: (k == 0) | (F.least(F.lit(size), n - k * stride) >= least))
    return F.when(n > 0, kept).otherwise(F.expr("CAST(array() AS array<int>)"))


def humanize_label(label: Column) -> Column:
    """``first_name``, ``driverLicenseNumber`` and ``kebab-case`` as lower-case words; an empty outcome keeps the label."""
    spaced = F.regexp_replace(label, r"[_-]", " ")
    spaced = F.regexp_replace(spaced, r"([\p{Ll}\p{Nd}])(\p{Lu})", "$1 $2")
    words = F.lower(squash(spaced))
    return F.when(words == "", label).otherwise(words)


def first_prefix(name: Column, registry: dict[str, str]) -> Column:
    """The value of the first registry key that ``name`` starts with, or null."""
    out = F.lit(None).cast("string")
    for prefix, value in reversed(list(registry.items())):
        out = F.when(name.startswith(prefix), F.lit(value)).otherwise(out)
    return out


def passage(title: Column, text: Column) -> Column:
    """Title and text on two lines, or whichever is there."""
    return strip(F.concat_ws("\n", F.nullif(strip(F.coalesce(title, F.lit(""))), F.lit("")), strip(F.coalesce(text, F.lit("")))))


def numbered_block(passages: Column) -> Column:
    """``[1] ...`` blocks, an empty line between them."""
    return F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p)), "\n\n")


def chat_messages(system: Column, user: Column, assistant: Column) -> Column:
    """``array<struct<role, content>>``; roles without content are left out."""
    message = lambda role, content: F.when(content.isNotNull(), F.struct(F.lit(role).alias("role"), content.alias("content")))
    return F.array_compact(F.array(message("system", system), message("user", user), message("assistant", assistant)))


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1] from the first 64 bits of the SHA-256 of ``seed::key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}::"), key), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def split_of(key: Column, train: float = 0.9, dev: float = 0.05, seed: int = 42) -> Column:
    """train, dev or test by the hash of ``key``: rows of one key stay together."""
    u = unit_hash(key, seed)
    return F.when(u < train, "train").when(u < train + dev, "dev").otherwise("test")


def split_alias(name: Column) -> Column:
    """dev and valid as validation, case and spaces aside."""
    low = F.lower(F.trim(name))
    return F.when(low.isin("dev", "valid", "val"), "validation").otherwise(low)
