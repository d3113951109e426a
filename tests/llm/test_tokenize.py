import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import tokenize

PATH = f"{tokenize.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdeè 中'\n!9", max_size=300), st.integers(1, 40))
def test_leaves_give_the_direct_encoding(text, leaf):
    enc = tokenize.load_encoding(PATH)
    parts = tokenize.leaves(text, leaf)
    ids = [tokenize.encode_leaf(r, b, enc) for r, b in parts]
    assert tokenize.assemble([r for r, _ in parts], ids, enc) == enc.encode_ordinary(text)


def test_long_unsplit_text_is_exact():
    rnd = random.Random(3)
    enc = tokenize.load_encoding(PATH)
    for alphabet in ("ab", "aeinrst", "=", "中文字"):
        text = "".join(rnd.choice(alphabet) for _ in range(6000))
        parts = tokenize.leaves(text, 100)
        assert len(parts) > 30
        ids = [tokenize.encode_leaf(r, b, enc) for r, b in parts]
        assert tokenize.assemble([r for r, _ in parts], ids, enc) == enc.encode_ordinary(text)


def test_operator(spark):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(f"{tokenize.TOKENIZER_DIR}/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    texts = ["Hello world", "", None, "<|endoftext|> ok", "x" * 5000 + " tail words " * 300, "a b", "a b", " \r\n  \U0001f600é"]
    rows = [(i, t, [7]) for i, t in enumerate(texts)] + [(4, texts[4], [7]), (4, "y" * 3000, [7])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids array<int>")
    got = sorted((r.doc_id, list(r.ids)) for r in tokenize.encode_corpus(df, "doc_id", tokenizer_path=PATH, leaf_chars=512).collect())
    want = sorted((i, reference.encode(t, add_special_tokens=False).ids if t else []) for i, t, _ in rows)
    assert got == want
    assert tokenize.encode_corpus(df.limit(0), "doc_id").count() == 0
