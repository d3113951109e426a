"""Where models enter: protocols with deterministic offline defaults, and request building."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STYLES = ("natural_question", "keyword_query", "paraphrased_statement")
Batches = Iterator[pd.DataFrame]


class Tokenizer(Protocol):
    """Text to an array of tokens, as a Column."""

    def __call__(self, text: Column) -> Column: ...


class Scorer(Protocol):
    """Query and passage to a score, as a Column."""

    def __call__(self, query: Column, passage: Column) -> Column: ...


class Encoder(Protocol):
    """Text to a vector, as a Column."""

    def __call__(self, text: Column) -> Column: ...


class Generator(Protocol):
    """Batches of requests to batches of responses: what ``mapInPandas`` takes."""

    def __call__(self, batches: Batches) -> Batches: ...


def overlap_scorer(query: Column, passage: Column) -> Column:
    """Share of the query's distinct words that the passage has: the default scorer."""
    from brindle.functions.text import word_tokens

    q, p = F.array_distinct(word_tokens(query)), word_tokens(passage)
    n = F.size(q)
    return F.when(n > 0, F.size(F.array_intersect(q, p)) / n).otherwise(F.lit(0.0))


VECTOR_SIZE = 64


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _hashed(words: pa.Array) -> pa.Array:
    known: dict[str, int] = {}
    out = []
    for tokens in words.to_pylist():
        if tokens is None:
            out.append(None)
            continue
        v = np.zeros(VECTOR_SIZE)
        for w in tokens:
            at = known.get(w)
            if at is None:
                at = known[w] = int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % VECTOR_SIZE
            v[at] += 1
        n = np.sqrt(v @ v)
        out.append(v / n if n else v)
    return pa.array(out, pa.list_(pa.float64()))


def hashed_vector(text: Column) -> Column:
    """Word counts in ``VECTOR_SIZE`` hashed places, to unit length: the default encoder."""
    from brindle.functions.text import word_tokens

    return _hashed(word_tokens(text))


def generation_request(chunk_text: Column, styles: tuple[str, ...] = STYLES) -> Column:
    """The user message that asks for one query of each style."""
    return F.concat(F.lit("Write one query per style (" + ", ".join(styles) + ") for: "), chunk_text)


def multi_hop_request(block: Column) -> Column:
    """The user message that asks for one query over several passages."""
    return F.concat(F.lit("Write one query that needs all of these passages.\n\n"), block)


def judge_request(query: Column, passage: Column) -> Column:
    """The user message that asks for a score."""
    return F.concat(F.lit("Rate from 1 to 5 how well the passage answers the query.\nQuery: "), query, F.lit("\nPassage: "), passage)


def stub_queries(text: Column, styles: tuple[str, ...] = STYLES, words: int = 8) -> Column:
    """Deterministic offline queries of a chunk: some of its own words, differently for each style."""
    from brindle.functions.text import word_tokens

    t = word_tokens(text)
    pick = [
        F.slice(t, 1, words),
        F.filter(F.slice(t, 1, 3 * words), lambda w, i: i % 3 == 0),
        F.filter(F.slice(t, 1, 2 * words), lambda w, i: i % 2 == 1),
    ]
    return F.array(*[F.struct(F.lit(s).alias("style"), F.array_join(p, " ").alias("query")) for s, p in zip(styles, pick)])


def run_generator(requests: DataFrame, generator: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """Requests through a generator; errors stay in the rows.  Write the result before going on: it is paid for."""
    return requests.mapInPandas(generator, schema)
