"""Language ID: counts against plain Python, edge cases, held-out accuracy on the tables."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textgauge.llm import langid
from textgauge.llm.queries import QUERIES


def plain(text):
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    s = f" {' '.join(low.split(' '))} "
    while "  " in s:
        s = s.replace("  ", " ")
    return Counter(g for k in (1, 2, 3) for i in range(len(s) - k + 1) if (g := s[i : i + k]).strip() and (g[0] != " " or g[-1] != " "))


@pytest.mark.parametrize("block", [7, 1_000_000])
def test_counts(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    texts = ["", "  ", "Ab", "one two\n\n3three, İ Été ß", "日本語 text", "a" * 30, "x 1 y", "end "]
    got = langid.count_ngrams(texts)
    for text, row in zip(texts, got):
        want = plain(text)
        assert row.sum() == sum(want.values()), text
        again = langid.count_ngrams([text])[0]
        assert (row == again).all()


def test_long_text_in_pieces(monkeypatch):
    text = "The quick  brown fox, l'été et 12 chats. " * 50
    whole = langid.count_ngrams([text])
    monkeypatch.setattr(langid, "BLOCK", 33)
    assert (langid.count_ngrams([text]) == whole).all()


def test_clusters_do_not_depend_on_order():
    rng = np.random.default_rng(3)
    v = np.abs(rng.normal(size=(60, 20)))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert np.allclose(langid.cluster(v, 4), langid.cluster(v[rng.permutation(60)], 4))
    assert len(langid.cluster(v[:2], 4)) == 2 and len(langid.cluster(np.repeat(v[:1], 5, 0), 3)) == 3


def test_edges(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.fit(docs.withColumn("lang", F.when(F.col("doc_id") % 7 > 0, F.col("lang"))))
    rows = [(1, None, "a"), (2, "", None), (3, "123 *** 4", "x"), (4, "und die der einheit", "x"), (4, "und die der einheit", "x"),
            (None, "the and of the " * 100_000, "x"), (6, "Съешь же ещё этих мягких французских булок", "x")]
    given = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = langid.identify(given, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score", "rejected"]
    out = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows)
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(out[i].rejected for i in (1, 2, 3))
    assert (out[4].lang_pred, out[4].rejected) == ("de", False)
    assert (out[None].lang_pred, out[None].rejected) == ("en", False)
    assert out[6].rejected and out[6].lang_pred in model.names


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit(none)
    assert model.names == () and langid.identify(none, model).count() == 0
    one = spark.createDataFrame([(1, "word", None)], none.schema)
    assert [(r.lang_pred, r.score, r.rejected) for r in langid.identify(one, langid.fit(one)).collect()] == [("und", 0.0, True)]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "n_chars")
    got = QUERIES["op9_language"](spark, folder).join(docs, "doc_id").filter("held_out")
    rows = got.collect()
    assert 200 < len(rows) and not any(r.rejected for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
