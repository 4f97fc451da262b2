"""Token files against the tokenizers library, and the index against a dictionary."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from textgauge.llm import tokenfile as tf
from textgauge.llm.queries import QUERIES

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def test_words_alone_and_in_texts(tok):
    texts = [
        "", " ", "A b  C", "don't  I'LL x's 's", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "é e ́x",
        " a b\x1cc\x85d", "ΟΔΟΣ İI ﬁ ǅ", "12 3.4,5 ...!? …—“x”", "北京 大学 🙂🙂 👩‍👩‍👧", "x" * 3000, "a\tb\nc\x0bd\x0ce\r\n",
    ]
    encode = tf.WordEncoder(PATH)
    for text, made in zip(texts, encode(texts, 1)):
        assert np.frombuffer(made, encode.kind).tolist() == tok.encode(text, add_special_tokens=False).ids + [1]


def test_tokenizer_without_special_tokens(tok):
    encode = tf.WordEncoder(PATH)
    encode.mark = None
    assert np.frombuffer(encode(["a b c, d"], 1)[0], encode.kind).tolist() == tok.encode("a b c, d", add_special_tokens=False).ids + [1]


def test_word_memory_is_bounded(tok, monkeypatch):
    monkeypatch.setattr(tf, "WORDS", 3)
    encode = tf.WordEncoder(PATH)
    for text in ("a b c d e", "a b", "f g", "a f"):
        ids = np.frombuffer(encode([text], 7)[0], encode.kind).tolist()
        assert ids == tok.encode(text, add_special_tokens=False).ids + [7]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 70_000])
def test_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    h, g = rng.integers(0, 2**64, (2, n), np.uint64)
    if n > 10:
        h[:10] = h[0]  # equal in one hash only
    first, count = np.arange(n), np.arange(n) % 3 + 1
    data = tf.pack_index(h, g, first, count)
    assert len(data) < 40 * n + 500
    for got, want in zip(tf.search_index(data, h, g), (first, count)):
        assert (got == want).all()
    others = rng.integers(0, 2**64, (2, 500), np.uint64)
    assert (tf.search_index(data, *others)[1] == 0).all()


def test_files(spark, tok, tmp_path):
    rows = [(i, f"some text {i} " * (i % 5), None) for i in range(200)]
    rows += [(None, "no key", 1), (None, None, 2), (7, "again", 3), (7, "again", 3), (999, "x " * 30000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(5)
    folder = str(tmp_path / "t")
    tf.write_tokens(docs, PATH, folder, end=5)
    keys = spark.createDataFrame([(r[0],) for r in rows if r[0] != 7] + [(7,), (12345,), (3,)], "doc_id long").dropDuplicates()
    got = tf.read_tokens(spark, folder, keys).collect()
    assert len(got) == len(rows)
    want = sorted(
        ((r[0], tok.encode(r[1] or "", add_special_tokens=False).ids + [5]) for r in rows),
        key=lambda x: (x[0] is not None, x[0] or 0),
    )
    by = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by] == [w[0] for w in want]
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((str(a), b) for a, b in want)
    at = 0
    for r in by:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    twice = spark.createDataFrame([(3,), (3,)], "doc_id long")
    assert tf.read_tokens(spark, folder, twice).count() == 2


def test_many_rows_of_one_key(spark, tmp_path):
    docs = spark.range(3000).selectExpr("1L as doc_id", "concat('w', id % 9) as text")
    folder = str(tmp_path / "t")
    tf.write_tokens(docs, PATH, folder)
    got = tf.read_tokens(spark, folder, spark.createDataFrame([(1,)], "doc_id long")).collect()
    assert len(got) == 3000 and len({r.start for r in got}) == 3000


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = str(tmp_path / "t")
    tf.write_tokens(docs, PATH, folder)
    assert tf.read_tokens(spark, folder, docs.select("doc_id")).count() == 0


def test_query(spark, tok, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in QUERIES["op10_token_files"](spark, small).collect()}
    assert len(got) == len(docs)
    at = 0
    for d in docs:
        ids = tok.encode(d.text or "", add_special_tokens=False).ids + [1]
        r = got[d.doc_id]
        assert (r.start, r.n_tokens) == (at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
