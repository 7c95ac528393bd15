"""Encoding against the public library, round trips, and the hard texts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quayside.llm import tokenizer as K

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    path = f"{K.TOKENIZER_DIR}/byte_bpe_50k.json"
    library = tokenizers.Tokenizer.from_file(path)
    library.encode_special_tokens = True
    return K.BytePairEncoder(open(path, encoding="utf-8").read()), library


def test_equals_the_library_on_odd_texts(both):
    own, library = both
    rng = random.Random(7)
    signs = [chr(c) for c in [*range(0x20, 0x250), *range(0x370, 0x500), *range(0x3000, 0x3060), 0x200B, 0xFEFF, 0x1F600, 0x1D7F6]]
    for _ in range(300):
        text = "".join(rng.choice(signs) if rng.random() < 0.6 else rng.choice(" \n\tab1'") for _ in range(rng.randint(0, 60)))
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
        assert own.decode(own.encode(text)) == text
    for text in ("<|endoftext|> x", "a" * 20_000, "ab " * 5_000, "   \n\n  ", "''s'll"):
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.text())
def test_round_trip(both, text):
    own, library = both
    text = text.encode("utf-8", "ignore").decode()
    ids = own.encode(text)
    assert own.decode(ids) == text and ids == library.encode(text, add_special_tokens=False).ids


def test_documents(spark):
    documents = spark.createDataFrame([(1, "Good value"), (2, ""), (3, None), (1, "Good value")], "doc_id long, text string").selectExpr("*", "'x' AS ids", "1 AS n")
    rows = sorted((r["doc_id"], list(r["ids"])) for r in K.encode_documents(documents).collect())
    assert rows[0] == rows[1] and rows[0][1] and rows[2:] == [(2, []), (3, [])]
    assert {(r["doc_id"], r["text"]) for r in K.round_trip(documents).collect()} == {(1, "Good value"), (2, ""), (3, "")}
    assert K.encode_documents(documents.limit(0)).count() == 0
