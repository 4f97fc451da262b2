"""Prefix token counts against the tokenizers library, prefix by prefix."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textgauge.llm import prefixes
from textgauge.llm.common import saved
from textgauge.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "don't we'll they're 've ' 'r 'l", "a   b \n\n c\t\td  \n", "hello<|endoftext|> x<|endoftext|><|endoftext|>  y<|endof",
    "foo =<|endoftext|>z", "naïve café — “quotes” 日本語 テキスト 😀😀  x　中", "a" * 40, "'''s '''re!'re x're", "࢏՘ab ࢏ c",
    "    return x;\n\n\n\tfoo()", "!!!!'s ''t  's  'll 'LL", "x<|endoftext|>", " <|endoftext|> ", " \u0085x",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return prefixes.PrefixCounter(PATH)


def made_up(n):
    rng = random.Random(5)
    letters = [*"aabcdeehhinorstt   '\n\t.,!<|>0123", "the", "ing", " 's", "'re", "é", "日", " ", "<|endoftext|>", "'ll", "  "]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def test_every_prefix(counter, library):
    for text in TEXTS + made_up(400):
        want = [library(text[: i + 1]) for i in range(len(text))]
        assert list(counter.counts(text)) == want, text
        assert counter.total(text) == (want[-1] if want else 0)
        for budget in (0, 1, 2, 3, 5, 9, 100):
            fits = max((i + 1 for i, n in enumerate(want) if n <= budget), default=0)
            assert counter.within(text, budget) == fits, (text, budget)


def test_remembering_little_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(prefixes, "PIECES", 3)
    monkeypatch.setattr(prefixes, "PAIRS", 3)
    counter = prefixes.PrefixCounter(PATH)
    assert [counter.total(t) for t in TEXTS] == [library(t) for t in TEXTS]


def test_other_tokenizers_raise():
    with pytest.raises(ValueError):
        prefixes.PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))


def test_stored_prefixes_answer(spark, library):
    long = " ".join(made_up(300))
    rows = [(1, None), (2, ""), (None, "it's a test"), (3, long), (4, "ab" * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stored = saved(prefixes.prefix_counts(docs, PATH, block=64), "prefixes")
    text_of = {k: t or "" for k, t in rows}
    asked = [(k, n) for k, t in text_of.items() for n in (-1, 0, 1, 63, 64, 65, 700, len(t), 10**7)] + [(99, 3)]
    got = prefixes.tokens_at(stored, spark.createDataFrame(asked, "doc_id long, chars long"), block=64).collect()
    assert len(got) == len(asked)
    for r in got:
        want = library(text_of[r.doc_id][: max(0, r.chars)]) if r.doc_id in text_of else None
        assert r.n_tokens == want, r
    counter = prefixes.PrefixCounter(PATH)
    for budget in (0, 1, 5, 300):
        fits = {r.doc_id: r.fits_chars for r in prefixes.longest_within(stored, budget, block=64).collect()}
        assert fits == {k: counter.within(t, budget) for k, t in text_of.items()}


def test_table_and_clashing_columns(spark, small, library):
    got = QUERIES["op12_token_counts"](spark, small).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        n = library(docs[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 1024)
        assert library(docs[r.doc_id][: r.fits_chars]) <= 1024 and (n > 1024 or r.fits_chars == len(docs[r.doc_id]))
    odd = spark.createDataFrame([(1, "a b", 7, "x"), (1, "a b", 7, "x"), (None, None, None, None)], "doc_id long, text string, n_tokens int, `_text` string")
    made = prefixes.count_tokens(odd, PATH, 1024)
    assert made.columns == ["doc_id", "text", "_text", "n_tokens", "fits_chars"]
    assert sorted(tuple(r) for r in made.fillna("-").fillna(0).collect()) == [(0, "-", "-", 0, 0), (1, "a b", "x", 2, 3), (1, "a b", "x", 2, 3)]
    assert prefixes.count_tokens(odd.filter(F.lit(False)), PATH, 1024).count() == 0
