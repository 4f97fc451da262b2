"""Losses, perplexity, the counted model, curves and pass@k."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textgauge.functions.scores import perplexity_of
from textgauge.operators import chunking, countlm, curves, scoring
from textgauge.operators.tokenizing import byte_tokenize

# Published results: (variant, loss, perplexity).
CAPACITY = [("82M", 1.4860, 4.42), ("117M", 1.3365, 3.81), ("345M", 1.2051, 3.34)]
SCALING = [(0.0, 2.2948, 9.92), (0.1, 1.4932, 4.45), (0.5, 1.3511, 3.86), (1.0, 1.3365, 3.81)]
LAYERS = [("all", 1.4932, 4.45), ("bottom", 1.5350, 4.64), ("top", 1.6126, 5.02)]


def test_shift_pairs(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, [7]), (2, [])], "doc_id long, input_ids array<int>")
    pairs = scoring.shift_pairs(df, keep=("doc_id",), position=True).collect()
    assert [tuple(r) for r in pairs] == [(0, 0, 1, 2), (0, 1, 2, 3)]
    assert scoring.shift_pairs(df).count() == 2


def test_cross_entropy_against_numpy(spark):
    rng = np.random.default_rng(5)
    logits = rng.normal(size=(40, 9)) * 30
    labels = [int(x) for x in rng.integers(0, 9, 40)]
    labels[3] = labels[8] = -100
    df = spark.createDataFrame(
        [(i, [float(x) for x in row], y) for i, (row, y) in enumerate(zip(logits, labels))],
        "i int, logits array<double>, label int",
    )
    got = {r["i"]: r["nll"] for r in scoring.token_nll(df).collect()}
    assert set(got) == {i for i, y in enumerate(labels) if y != -100}
    for i, nll in got.items():
        shifted = logits[i] - logits[i].max()
        assert nll == pytest.approx(np.log(np.exp(shifted).sum()) - shifted[labels[i]], abs=1e-9)
    padded = scoring.token_nll(df, pad_id=labels[0])
    assert padded.filter(F.col("label") == labels[0]).count() == 0


def test_perplexity_edges(spark):
    def frame(values):
        return spark.createDataFrame([(float(v),) for v in values], "nll double")

    assert tuple(scoring.perplexity(frame([])).first()) == (None, None, 0)
    loss, ppl, n = scoring.perplexity(frame([710, 710])).first()
    assert (loss, ppl, n) == (710.0, math.inf, 2)
    ignored = spark.createDataFrame([([1.0, 2.0], -100)] * 3, "logits array<double>, label int")
    assert scoring.perplexity(scoring.token_nll(ignored)).first()["eval_loss"] is None


@pytest.mark.parametrize("loss, shown", [(l, p) for _, l, p in CAPACITY + SCALING + LAYERS])
def test_published_pairs(spark, loss, shown):
    ppl = spark.range(1).select(perplexity_of(F.lit(loss))).first()[0]
    assert round(ppl, 2) == shown


def test_chunk_mean_differs_only_for_unequal_chunks(spark):
    rows = [(0, 1.0), (0, 3.0), (1, 5.0), (1, 7.0)]
    even = spark.createDataFrame(rows, "chunk int, nll double")
    assert scoring.perplexity_by_chunk(even, ["chunk"]).first()["eval_loss"] == 4.0
    assert scoring.perplexity(even).first()["eval_loss"] == 4.0
    odd = even.filter("nll < 7")
    assert scoring.perplexity_by_chunk(odd, ["chunk"]).first()["eval_loss"] == 3.5
    assert scoring.perplexity(odd).first()["eval_loss"] == 3.0


def test_score_with_a_user_model(spark):
    df = spark.createDataFrame([(i, [i, i + 1, i + 2]) for i in range(37)], "doc_id long, input_ids array<int>")

    def make():
        return lambda ids: ids.sum(axis=1) / 10.0

    got = {r["doc_id"]: (r["nll"], r["n_tokens"]) for r in scoring.score(df, make, 3, batch=5).collect()}
    assert got == {i: (pytest.approx((3 * i + 3) / 10), 2) for i in range(37)}
    with pytest.raises(Exception, match="must have 4 tokens"):
        scoring.score(df, make, 4).collect()


def pairs_of(rows, names="prev int, next int"):
    return lambda spark: spark.createDataFrame(rows, names)


@pytest.mark.parametrize("vocab_size", [8, 5000])
def test_count_lm_by_hand(spark, vocab_size):
    """Small models are broadcast, large ones joined; seen, unseen pair and unseen context."""
    train = pairs_of([(1, 2)] * 3 + [(1, 3)])(spark)
    lm = countlm.count_lm(countlm.count_pairs(train), vocab_size, alpha=0.5)
    assert lm.small == (vocab_size == 8)
    test = pairs_of([(1, 2), (1, 2), (1, 4), (5, 1)])(spark)
    got = {
        (r["prev"], r["next"]): (r["n"], r["nll"])
        for r in countlm.score_count_lm(lm, countlm.count_pairs(test)).collect()
    }
    a, v = 0.5, vocab_size
    assert got[1, 2] == (2, pytest.approx(-math.log((3 + a) / (4 + a * v))))
    assert got[1, 4] == (1, pytest.approx(-math.log(a / (4 + a * v))))
    assert got[5, 1] == (1, pytest.approx(math.log(v)))


def test_nested_losses_equal_separate_models(spark):
    random.seed(11)
    rows = [(random.choice([-1, 0, 1, 1, 2]), random.randrange(6), random.randrange(6)) for _ in range(900)]
    df = spark.createDataFrame(rows, "rung int, prev int, next int")
    got = {
        r["step"]: r["eval_loss"]
        for r in countlm.nested_losses(countlm.count_pairs(df, by=("rung",)), 3, 6).collect()
    }
    assert got[-1] == pytest.approx(math.log(6))
    test = countlm.count_pairs(df.filter("rung < 0"))
    for step in range(3):
        lm = countlm.count_lm(countlm.count_pairs(df.filter(f"rung BETWEEN 0 AND {step}")), 6)
        scored = countlm.score_count_lm(lm, test)
        want = scoring.perplexity(scored, weight="n").first()["eval_loss"]
        assert got[step] == pytest.approx(want)


def test_alpha_must_be_positive(spark):
    with pytest.raises(ValueError):
        countlm.count_lm(countlm.count_pairs(pairs_of([(1, 2)])(spark)), 4, alpha=0)


def test_scaling_curve_of_published_results(spark):
    df = spark.createDataFrame([(f, l) for f, l, _ in SCALING], "fraction double, eval_loss double")
    rows = curves.scaling_curve(df).orderBy("fraction").collect()
    assert [round(r["perplexity"], 2) for r in rows] == [p for _, _, p in SCALING]
    assert [r["gain_prev"] and round(r["gain_prev"], 4) for r in rows] == [None, 0.8016, 0.1421, 0.0146]
    assert [round(r["gain_zero"], 4) for r in rows] == [0.0, 0.8016, 0.9437, 0.9583]


@pytest.mark.parametrize("table", [CAPACITY, LAYERS])
def test_compare_published_variants(spark, table):
    df = spark.createDataFrame([(v, l) for v, l, _ in table], "variant string, eval_loss double")
    rows = {r["variant"]: r for r in curves.compare_runs(df, "variant").collect()}
    order = sorted(table, key=lambda t: t[1])
    for place, (variant, loss, ppl) in enumerate(order, 1):
        row = rows[variant]
        assert (row["rank"], round(row["perplexity"], 2)) == (place, ppl)
        assert row["behind_best"] == pytest.approx(loss - order[0][1])


def test_pass_at_k_against_binomials(spark):
    cases = [(n, c) for n in range(1, 14) for c in range(n + 1)] + [(5000, 2500), (5000, 1), (12, 0)]
    rows = [(i, j < c) for i, (n, c) in enumerate(cases) for j in range(n)]
    df = spark.createDataFrame(rows, "task_id int, passed boolean")
    got = scoring.pass_at_k(df, ks=(1, 3, 10)).collect()
    assert len(got) == len(cases)
    for r in got:
        n, c = cases[r["task_id"]]
        assert (r["n"], r["c"]) == (n, c)
        for k in (1, 3, 10):
            value = r[f"pass_at_{k}"]
            if n < k:
                assert value is None
            else:
                assert value == pytest.approx(1 - math.comb(n - c, k) / math.comb(n, k), abs=1e-9)
            if n >= k and c == 0:
                assert value == 0.0


def test_k_is_reported_only_when_all_tasks_have_enough_samples(spark):
    df = spark.createDataFrame(
        [(0, True)] * 4 + [(0, False)] * 8 + [(1, False)] * 9, "task_id int, passed boolean"
    )
    row = scoring.mean_pass_at_k(scoring.pass_at_k(df)).first()
    assert row["pass_at_1"] == pytest.approx((4 / 12 + 0) / 2) and row["pass_at_10"] is None


@pytest.mark.parametrize("m, s", [(64, 64), (8, 3), (4, 9), (1, 1), (2, 1)])
def test_byte_pairs_equal_the_windowed_route(spark, small, m, s):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang", "text")
    extra = [(-1, "x", None), (-2, "x", ""), (-3, "x", "a"), (-4, "x", "ab"), (-5, None, "aé" * 9)]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, lang string, text string"))
    chunks = chunking.chunk(byte_tokenize(docs), m, s, keep=("lang",))
    want = countlm.count_pairs(scoring.shift_pairs(chunks, keep=("lang",)), by=("lang",))
    got = countlm.count_byte_pairs(docs, m, s, by=("lang",))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_byte_pairs_across_blocks(spark):
    """A text longer than a block of positions, and no grouping columns."""
    df = spark.createDataFrame([("abc" * 500_000,), ("ab",)], "text string")
    got = {(r["prev"], r["next"]): r["n"] for r in countlm.count_byte_pairs(df, 2, 1).collect()}
    assert got == {(97, 98): 500_001, (98, 99): 500_000, (99, 97): 499_999}


def test_byte_pairs_with_many_groups(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    chunks = chunking.chunk(byte_tokenize(docs), 32, 20)
    want = countlm.count_pairs(scoring.shift_pairs(chunks, keep=("doc_id",)), by=("doc_id",))
    got = countlm.count_byte_pairs(docs.coalesce(1), 32, 20, by=("doc_id",))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_rows_without_a_loss_do_not_count(spark):
    df = spark.createDataFrame([(math.log(2), 1), (None, 3)], "nll double, n int")
    row = scoring.perplexity(df).first()
    assert (row["eval_loss"], row["n_tokens"]) == (pytest.approx(math.log(2)), 1)
    assert scoring.perplexity(df, weight="n").first()["n_tokens"] == 1


def test_label_outside_the_logits(spark):
    df = spark.createDataFrame([([0.0, 0.0], 0), ([0.0, 0.0], 2)], "logits array<double>, label int")
    with pytest.raises(Exception, match="outside its logits"):
        scoring.token_nll(df).collect()
