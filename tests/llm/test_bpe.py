import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import AWKWARD, clashing, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from duskveil.llm import bpe as B

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
ODD = [
    "aaaaaaaaaaaa" * 50, "  ", "a  b", "a \n b", "\xa0a \xa0 b", "é" * 1000, "!!!!????" * 99, "日本語" * 30, "0123456789" * 500,
    "<|endoftext|>", "it's 's 'll x'll '", "a\x1c b\x85 c", "²½Ⅷ x_y __", *AWKWARD,
]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def raw(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_same_ids(library):
    random.seed(3)
    texts = ODD + ["".join(random.choice("abcdeéèAB 19!?'\n\t\xa0") for _ in range(random.randint(1, 200))) for _ in range(1500)]
    encoder = B.Encoder(RANKS, PATTERN)
    found = encoder.encode(texts)
    assert found == [raw(library.encode_ordinary(t or "")) for t in texts]
    assert [encoder.decode(f) for f in found] == [(t or "").encode() for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, text):
    if any("\ud800" <= c <= "\udfff" for c in text):
        return
    assert B.encoder_of(RANKS, PATTERN).encode([text]) == [raw(library.encode_ordinary(text))]


def test_lower_rank_after_a_merge(tmp_path):
    """Ranks in which a merge makes way for one of a lower rank."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"bc", b"abab", b"aa", b"aaa"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    random.seed(1)
    texts = ["".join(random.choice("abc") for _ in range(random.randint(1, 30))) for _ in range(2000)]
    assert B.Encoder(str(path), PATTERN).encode(texts) == [raw(library.encode_ordinary(t)) for t in texts]


def test_forgetting(monkeypatch, library):
    monkeypatch.setattr(B, "REMEMBERED", 5)
    monkeypatch.setattr(B, "REPLAY_SYMBOLS", 7)
    encoder = B.Encoder(RANKS, PATTERN)
    for text in ["one two three four five six seven", "one eight nine ten twoo", "eight one strawberries"] * 3:
        assert encoder.encode([text]) == [raw(library.encode_ordinary(text))]


def test_rows(spark, library):
    docs = documents(spark, ODD, ids=[None, *range(len(ODD) - 1)])
    found = B.round_trip(clashing(docs), RANKS, PATTERN).collect()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = sorted((len(i := library.encode_ordinary(t or "")), sha(raw(i)), sha((t or "").encode())) for t in ODD)
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == want
    assert B.round_trip(docs.limit(0), RANKS, PATTERN).count() == 0


def test_decoded_documents(spark):
    docs = documents(spark, ["Hello, wörld", None, ""])
    texts = {r["doc_id"]: r["text"] for r in B.decode_documents(B.encode_documents(docs, RANKS, PATTERN), RANKS).collect()}
    assert texts == {0: "Hello, wörld", 1: "", 2: ""}
