"""Byte-level BPE against the tiktoken library, and the round trip."""

import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from textgauge.llm import bpe
from textgauge.llm.queries import QUERIES

PATH = P.path("byte_bpe_50k.tiktoken")
EDGES = [
    None, "", " ", "a", "\n\n\n   x", "  leading", "été Straße 北京大学 🙂🙂👩‍👩‍👧", "it's they'll I'd", "  x\u0085y",
    "a" * 1000, "ab" * 700 + "c", "<|endoftext|>", "0123456789" * 40, "\x00\x01\x7f", "=" * 300 + "-" * 301, "word " * 20000,
]


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    return bpe.Ranks(open(PATH, "rb").read())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("abe th", max_size=400), st.text("aàn=0", min_size=200, max_size=900)), max_size=6))
def test_any_text(tik, ranks, texts):
    import regex

    ids, counts = bpe.encode_texts(ranks, regex.compile(P.PATTERN), texts)
    want = [tik.encode_ordinary(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_unsettled_merges(ranks):
    """A vocabulary in which a merge makes a pair of lower rank: both ways agree."""
    letters = [bytes([b]) for b in range(256)]
    words = [b"aba", b"ab", b"bb", b"abab", b"aa"]
    own = bpe.Ranks(b"\n".join(base64.b64encode(w) + b" %d" % i for i, w in enumerate(letters + words)))
    assert not own.settled[257]
    tik = tiktoken.Encoding(
        "own", pat_str=r"[\s\S]+", mergeable_ranks={w: i for i, w in enumerate(letters + words)}, special_tokens={}
    )
    import random

    rng = random.Random(5)
    for n in (2, 5, 40, 200):
        piece = "".join(rng.choice("ab") for _ in range(n))
        want = tik.encode_ordinary(piece)
        assert own.encode_pieces([piece.encode()])[0].tolist() == want
        if n > 1:
            import numpy as np

            row = own.of_byte[np.frombuffer(piece.encode(), np.uint8)]
            assert own.merge_wide(row).tolist() == want


def test_frames(spark, tik):
    rows = [(i, t, "x", [1]) for i, t in enumerate(EDGES)] + [(0, None, None, None), (3, "a", "x", [2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bytes string, ids array<int>")
    made = bpe.bpe_decode(bpe.bpe_encode(docs, PATH, P.PATTERN), PATH, data="raw")
    assert made.columns == ["doc_id", "text", "bytes", "ids", "raw"]
    got = made.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == tik.encode_ordinary(r.text or "") and bytes(r.raw).decode() == (r.text or "")
    empty = docs.limit(0)
    assert bpe.bpe_decode(bpe.bpe_encode(empty, PATH, P.PATTERN), PATH).count() == 0
    nulls = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [bytes(r.bytes) for r in bpe.bpe_decode(nulls, PATH).collect()] == [b"", b""]


def test_query(spark, tik, small):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = QUERIES["op1_bpe"](spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = tik.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
