"""What one task holds, and what is shuffled, stays in proportion on larger tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textgauge.operators import bpe, gram_homes, ngrams, tokenizing
from textgauge.operators.tokenizing import item_slices


def test_parts_of_a_batch_are_bounded():
    rows = [[1] * 3, None, [], [2] * 50, [3], [4] * 4, [5] * 4, []]
    whole = pa.array(rows, pa.list_(pa.int32()))
    for col, want in ((whole, rows), (whole.slice(1, 6), rows[1:7]), (whole.slice(0, 0), [])):
        parts = list(item_slices(col, 8))
        assert [r for p in parts for r in p.to_pylist()] == want
        assert all(len(p.flatten()) <= 8 or len(p.drop_null().flatten()) == 50 for p in parts)
    assert len(list(item_slices(whole, 8))) == 4


def test_ids_do_not_depend_on_the_parts(spark):
    # one batch of several parts, a row longer than a part, null and empty rows
    words = [f"w{i % 700}" for i in range(tokenizing.SLICE_ITEMS + 10)]
    rows = [(0, words), (1, words[5:200_000]), (2, None), (3, []), (4, ["w1", None, "no"]), (5, words[:3])]
    df = spark.createDataFrame(rows, "doc_id long, tok array<string>").coalesce(1)
    entries = ["<unk>", *(f"w{i}" for i in range(600))]
    vocab = spark.createDataFrame(list(enumerate(entries)), "id int, token string")
    number = {t: i for i, t in enumerate(entries)}
    want = {k: [number.get(t, 0) for t in r or ()] for k, r in rows}
    coded = tokenizing.encode(df, vocab)
    assert {r.doc_id: r.input_ids or [] for r in coded.collect()} == want
    text = {r.doc_id: r.text for r in tokenizing.decode(coded, vocab, skip=("<unk>",)).collect()}
    assert all(text[k] == "".join(entries[i] for i in ids if i) for k, ids in want.items())
    whole = [r for r in rows if r[1] and None not in r[1]]
    got = bpe.bpe_encode(df.filter("doc_id in (0, 1, 5)"), [(b"w", b"1")]).collect()
    plain = lambda t: list(t.encode()) if not t.startswith("w1") else [256, *t[2:].encode()]
    assert {r.doc_id: r.input_ids for r in got} == {k: [i for t in r for i in plain(t)] for k, r in whole}


def test_joined_items_are_not_rows(spark, plan):
    rows = [(1, ["a", "b", "a", None]), (1, ["a", "b", "a", None]), (None, ["b", "x"]), (2, None), (3, []), (4, ["a"] * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, tok array<string>").repartition(3)
    # an entry twice, and one with two ids
    vocab = spark.createDataFrame([(0, "<unk>"), (5, "a"), (5, "a"), (7, "b"), (6, "b")], "id int, token string")
    joined = tokenizing.encode_by_join(df, vocab, salts=3)
    number = {"a": [5], "b": [6, 7]}
    want = [(k, [i for t in r or () for i in number.get(t, [0])]) for k, r in rows]
    got = [(r.doc_id, r.input_ids) for r in joined.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    back = tokenizing.decode_by_join(joined, vocab, skip=("b",))
    shown = {0: "<unk>", 5: "a"}
    texts = [(k, "".join(shown.get(i, "") for i in ids)) for k, ids in want]
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=repr) == sorted(texts, key=repr)
    # only distinct items of a block are made rows, and a block meets its rows under one number
    for made in (joined, back):
        text = plan(made)
        assert "posexplode_outer" not in text and "posexplode(_words" in text and "hashpartitioning(_block" in text


def test_grams_as_numbers_and_dealt_out_once(spark, plan):
    rng = random.Random(5)
    windows = [(i, [rng.randint(0, 5) for _ in range(rng.randint(0, 9))]) for i in range(60)]
    train = spark.createDataFrame(windows[:40], "id long, input_ids array<int>")
    # ids that the vocabulary does not have, and rows twice
    test = spark.createDataFrame([*windows[40:], (90, [1, 99, 2]), (91, [1, -7, 2])], "id long, input_ids array<int>")
    tests = ngrams.count_grams(test, 5, by=("id",))
    tests = tests.unionByName(tests.filter("id = 90"))
    said = []
    for size in (None, 7):
        counts = ngrams.count_grams(train, 5, vocab_size=size)
        model = ngrams.ngram_tables(counts, 5, size)
        scored = ngrams.score_ngrams(model, tests, (2, 3, 4, 5), 7, by=("id",))
        said.append(sorted((r.id, r.order, tuple(r.gram), r.n, round(r.nll, 9)) for r in scored.collect()))
        assert dict(model.dtypes)["key"] == ("array<int>" if size is None else "bigint")
        # the longer orders are counted, asked and put together after one dealing out by home
        assert "hashpartitioning(home" in plan(scored) and "hashpartitioning(key" not in plan(model)
    assert said[0] == said[1] and len(said[0]) == 4 * tests.count()
    with pytest.raises(Exception, match="vocabulary"):
        ngrams.count_grams(test, 5, vocab_size=7).collect()


def some_windows(spark, n, seed=8, most=5):
    rng = random.Random(seed)
    rows = [(i, "ab"[i % 2], [min(int(rng.expovariate(0.5)), most) for _ in range(rng.randint(0, 12))]) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, None), (n + 1, "a", [3])], "id long, side string, input_ids array<int>")


def test_counted_grams_are_moved_in_rows_of_bytes(spark, plan):
    windows = some_windows(spark, 80)
    counted = [ngrams.count_grams(windows, 4, by=("side",), vocab_size=size) for size in (None, 7)]
    said = [sorted((r.side or "", tuple(r.gram), r.n) for r in c.collect()) for c in counted]
    assert said[0] == said[1] and len(said[0]) > 100
    train, test = (counted[1].filter(F.col("side") == s).drop("side") for s in "ab")
    scored = ngrams.score_ngrams(ngrams.ngram_tables(train, 4, 7), test, (2, 3, 4), 7)
    # training grams meet the asked ones as bytes: no gram is a row in an exchange, a sort or a window
    text = plan(scored)
    assert "hashpartitioning(home" in text and "Window" not in text and "keys" in text and "Sort [place" in text


@pytest.mark.parametrize("order, orders", [(5, (2, 3, 4, 5)), (4, (2, 4)), (3, (2, 3, 5)), (2, (2, 4))])
def test_model_and_scores_of_hot_homes_equal_those_of_arrays(spark, monkeypatch, order, orders):
    monkeypatch.setattr(ngrams, "HOT_TARGETS", 1)
    monkeypatch.setattr(ngrams, "HOT_SHARE", 1 << 40)
    windows = some_windows(spark, 120)
    counts = ngrams.count_grams(windows.filter("id < 90"), order)
    counts = spark.createDataFrame([*counts.collect(), ([1, 2], 3), ([4], 2)], "gram array<int>, n long")  # counts in parts
    tests = ngrams.count_grams(windows.filter("id >= 90"), 5, by=("side",))
    tests = tests.unionByName(spark.createDataFrame([("a", [1, 9, 2, 2], 1), ("a", [0], 2)], tests.schema))
    models = [ngrams.ngram_tables(counts, order, size) for size in (None, 7)]
    assert len(models[1].gram_parts[2]) > 5
    form = ngrams._form(7, order)
    rows = [
        sorted((r.level, tuple(r.key), r.is_context, *(r[c] for c in ngrams.SUMS)) for r in m.collect())
        for m in (models[0], models[1].withColumn("key", form.unpack(F.col("key"))))
    ]
    assert rows[0] == rows[1] and {r[0] for r in rows[0]} == set(range(1, order + 1))
    # a model that went through other steps is asked row by row
    said = []
    for model in (*models, models[1].filter("true")):
        scored = ngrams.score_ngrams(model, tests, orders, 7, by=("side",)).collect()
        said.append(sorted((r.side or "", r.order, tuple(r.gram), r.n, round(r.nll, 9)) for r in scored))
    assert said[0] == said[1] == said[2] and len(said[0]) == len(orders) * tests.count()


def test_pieces_of_homes_do_not_change_scores(monkeypatch):
    rng, base, order, hot = random.Random(2), 7, 5, [8, 15]
    grams = sorted({tuple(min(int(rng.expovariate(0.6)), 4) for _ in range(rng.choice((2, 3, 4, 5)))) for _ in range(900)})
    keys = gram_homes.turned(gram_homes.numbers(pa.array(grams, pa.list_(pa.int32())), base, order), base, order)
    train, test, size = np.arange(len(keys)) % 3 > 0, keys[::3], np.array([len(g) for g in grams])[::3]
    n = np.arange(1, len(keys) + 1)
    (part, at), blobs = gram_homes.packed(gram_homes.places(keys[train], base, order, hot)[::-1], keys[train], n[train])
    place = (at << gram_homes.PART_BITS) + part
    places = [*place, *gram_homes.placed(test, base, order, hot).field("place").to_numpy()]
    asked = [{"t": int(k), "size": int(s), "q2": 0.5, "p2": 0.25, "turned": int(k)} for k, s in zip(test, size)]
    kinds = {"t": pa.int64(), "size": pa.int32(), "q2": pa.float64(), "p2": pa.float64(), "turned": pa.int64()}
    asked = pa.array([None] * len(place) + asked, pa.struct(kinds))
    columns = [pa.array(places), *(pa.array([*b.to_pylist(), *[None] * len(test)], pa.binary()) for b in blobs), asked]
    rows = pa.RecordBatch.from_arrays(columns, names=["place", "keys", "n", "asked"]).sort_by("place")
    said, ends = [], []
    for most in (1 << 20, 8):
        monkeypatch.setattr(gram_homes, "ROWS", most)
        parts = [rows.slice(i, 5) for i in range(0, len(rows), 5)]
        ends.append([p[3] for p in gram_homes.pieces(iter(parts))])
        made = gram_homes.scores(iter(parts), base, order, [2, 3, 4, 5], 0.75, 1, ["t", "nll2", "nll3", "nll4", "nll5"])
        said.append({r["t"]: [round(r[f"nll{k}"], 9) for k in (2, 3, 4, 5)] for b in made for r in b.to_pylist()})
    assert said[0] == said[1] and len(said[0]) == len(test) and len({tuple(v) for v in said[0].values()}) > 20
    assert ends[0] == [True] and len(ends[1]) > 10 and False in ends[1]
