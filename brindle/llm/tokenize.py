"""Encoding a corpus with a public byte-level BPE tokenizer (problem 7).

Ordinary texts are encoded where they are read, in Arrow batches, without a
shuffle.  A text above ``leaf_chars`` is cut at pre-token boundaries into leaves
that are encoded in parallel.  A pre-token that is itself longer than a leaf
(a long run without any split point) is halved until its parts fit; the parts
are encoded in parallel, too, and joined pairwise up a tree: a window of tokens
around the join is encoded again, growing until its first and last token are
those that the two sides have there.  Every adjacent pair of tokens of the
joined sequence then comes from a valid encoding, and the byte-pair encoding of
a string is the only sequence with that property, so the result is exact.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the split pattern published with the 50k byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF_CHARS = 16_384
_CACHE: dict[str, object] = {}


def load_encoding(path: str):
    """The encoder of a ``.tiktoken`` ranks file, once per Python worker."""
    if path not in _CACHE:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _CACHE[path] = tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _CACHE[path]


def join_tokens(left: list[int], right: list[int], encode, token_bytes, width: int = 8) -> list[int]:
    """Exact encoding of ``bytes(left) + bytes(right)`` from the encodings of both.

    ``encode`` maps bytes to ids without any splitting, ``token_bytes`` an id to
    its bytes.  The window starts ``width`` tokens wide on either side and
    doubles until both of its ends agree with the sides or it covers a side.
    """
    if not left or not right:
        return left + right
    while True:
        a, b = min(width, len(left)), min(width, len(right))
        window = b"".join(map(token_bytes, left[len(left) - a :] + right[:b]))
        ids = encode(window)
        left_agrees = a == len(left) or ids[0] == left[len(left) - a]
        right_agrees = b == len(right) or ids[-1] == right[b - 1]
        if left_agrees and right_agrees:
            return left[: len(left) - a] + ids + right[b:]
        width *= 2


def tree_join(parts: list[list[int]], encode, token_bytes) -> list[int]:
    """Join the encodings of consecutive parts pairwise, level by level."""
    while len(parts) > 1:
        joined = [join_tokens(parts[i], parts[i + 1], encode, token_bytes) for i in range(0, len(parts) - 1, 2)]
        parts = joined + ([parts[-1]] if len(parts) % 2 else [])
    return parts[0] if parts else []


def halves(data: bytes, size: int) -> list[bytes]:
    """``data`` halved until each part has at most ``size`` bytes."""
    if len(data) <= size:
        return [data]
    mid = len(data) // 2
    return halves(data[:mid], size) + halves(data[mid:], size)


def leaves(text: str, leaf_chars: int) -> list[tuple[int, bytes]]:
    """``(run, bytes)`` in order: run -1 is whole pre-tokens, run >= 0 an unsplit pre-token or a part of it.

    White space splits by what follows it, so a leaf that would end in a white
    pre-token gives that one as an unsplit run of its own.
    """
    out: list[tuple[int, bytes]] = []
    begin = last = end = run = 0

    def flush() -> int:
        stop = last if text[last:end].isspace() else end
        if stop > begin:
            out.append((-1, text[begin:stop].encode()))
        if end > stop:
            out.append((run, text[stop:end].encode()))
        return run + (end > stop)

    for m in regex.finditer(PATTERN, text):
        if m.end() - m.start() > leaf_chars:
            if end > begin:
                run = flush()
            out += [(run, part) for part in halves(m.group().encode(), leaf_chars)]
            run += 1
            begin = last = end = m.end()
            continue
        if m.end() - begin > leaf_chars and end > begin:
            run = flush()
            begin = end
        last, end = m.span()
    if end > begin:
        flush()
    return out


def encode_leaf(run: int, data: bytes, encoding) -> list[int]:
    """Ids of one leaf; a leaf of whole pre-tokens is split as a text is, a part is not."""
    return encoding.encode_ordinary(data.decode()) if run < 0 else encoding._encode_single_piece(data)


def assemble(runs: list[int], ids: list[list[int]], encoding) -> list[int]:
    """Ids of the text whose leaves, in order, have these runs and ids."""
    out: list[int] = []
    i = 0
    while i < len(runs):
        j = i + 1
        while runs[i] >= 0 and j < len(runs) and runs[j] == runs[i]:
            j += 1
        out += tree_join(ids[i:j], encoding._encode_single_piece, encoding.decode_single_token_bytes)
        i = j
    return out


def _arrow_lists(rows: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.fromiter((x for r in rows for x in r), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_corpus(
    df: DataFrame,
    id_col: str,
    text_col: str = "text",
    tokenizer_path: str = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken",
    leaf_chars: int = LEAF_CHARS,
) -> DataFrame:
    """One row ``(id, ids array<int>)`` per row of ``df``, without special tokens.

    Defined results: a null and an empty text both give an empty list; strings
    that look like special tokens are ordinary text; a repeated row comes out as
    often as it is in ``df``, and rows that share an id keep their own texts;
    an empty table gives no rows; other columns do not matter.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    schema = f"_id {id_type}, ids array<int>"

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(tokenizer_path)
        for batch in batches:
            rows = [encoding.encode_ordinary(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _arrow_lists(rows)], ["_id", "ids"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, text, digest in zip(pdf["_id"], pdf["_t"], pdf["_h"]):
                parts = leaves(text, leaf_chars)
                yield pd.DataFrame(
                    {"_id": pd.Series([key] * len(parts), dtype=pdf["_id"].dtype), "_h": digest, "_ix": range(len(parts)), "_run": [r for r, _ in parts], "_b": [b for _, b in parts]}
                )

    def leaf_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_encoding(tokenizer_path)
        for pdf in batches:
            pdf["_ids"] = [encode_leaf(r, bytes(b), encoding) for r, b in zip(pdf["_run"], pdf["_b"])]
            yield pdf[["_id", "_h", "_ix", "_run", "_ids"]]

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        encoding = load_encoding(tokenizer_path)
        copies = int((pdf["_ix"] == 0).sum())
        one = pdf.drop_duplicates("_ix").sort_values("_ix")
        ids = assemble(one["_run"].tolist(), [list(x) for x in one["_ids"]], encoding)
        return pd.DataFrame({"_id": pd.Series([pdf["_id"].iloc[0]] * copies, dtype=pdf["_id"].dtype), "ids": [ids] * copies})

    length = F.coalesce(F.char_length("_t"), F.lit(0))
    short = src.filter(length <= leaf_chars).mapInArrow(plain, schema)
    long = (
        src.filter(length > leaf_chars)
        .withColumn("_h", F.xxhash64("_t"))
        .mapInPandas(cut, f"_id {id_type}, _h bigint, _ix int, _run int, _b binary")
        .repartition("_id", "_h", "_ix")
        .mapInPandas(leaf_ids, f"_id {id_type}, _h bigint, _ix int, _run int, _ids array<int>")
        .groupBy("_id", "_h")
        .applyInPandas(whole, schema)
    )
    return short.unionByName(long).select(F.col("_id").alias(id_col), "ids")
