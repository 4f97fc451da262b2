"""The n-gram model against plain Python, its probabilities and its counts."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textgauge.operators import countlm, ngrams, scoring

V, D = 7, 0.75


class Plain:
    """Interpolated discounting by definition, from windows of training ids."""

    def __init__(self, windows, order):
        self.order = order
        self.n, self.before = Counter(), defaultdict(set)
        for w in windows:
            for end in range(1, len(w)):
                for k in range(1, min(order, end + 1) + 1):
                    gram = tuple(w[end - k + 1 : end + 1])
                    self.n[gram] += 1
                    if end - k >= 0 and k < order:
                        self.before[gram].add(w[end - k])

    def p(self, gram, top=True):
        if not gram:
            return 1 / V
        raw = top and len(gram) == self.order
        count = (lambda g: self.n[g]) if raw else (lambda g: len(self.before[g]) if g in self.before else 0)
        known = [g for g in self.n if len(g) == len(gram) and g[:-1] == gram[:-1] and count(g)]
        lower = self.p(gram[1:], False)
        total = sum(map(count, known))
        return lower if not total else (max(count(gram) - D, 0) + D * len(known) * lower) / total


def made(seed, n, length=12):
    rng = random.Random(seed)
    return [[min(int(rng.expovariate(0.6)), V - 2) for _ in range(rng.randint(0, length))] for _ in range(n)]


def frame(spark, windows):
    return spark.createDataFrame([(i, w) for i, w in enumerate(windows)], "id long, input_ids array<int>")


@pytest.fixture(scope="module")
def scored(spark):
    train, test = made(1, 30), [*made(2, 12), [V - 1, V - 1, 0], [0], []]
    model = ngrams.ngram_tables(ngrams.count_grams(frame(spark, train), 4), 4)
    got = ngrams.score_ngrams(model, ngrams.count_grams(frame(spark, test), 4), (2, 3, 4), V).collect()
    return train, test, got


def test_against_definition(scored):
    train, test, got = scored
    total = Counter()
    for k in (2, 3, 4):
        plain = Plain(train, k)
        want = Counter()
        for w in test:
            for end in range(1, len(w)):
                want[tuple(w[max(0, end - k + 1) : end + 1])] += 1
        for r in (r for r in got if r.order == k):
            total[k, tuple(r.gram)] += r.n
            assert math.isclose(r.nll, -math.log(plain.p(tuple(r.gram))), rel_tol=1e-9), (k, r.gram)
        assert {g: n for (o, g), n in total.items() if o == k} == want


def test_probabilities_add_up(spark, scored):
    train = scored[0]
    model = ngrams.ngram_tables(ngrams.count_grams(frame(spark, train), 3), 3)
    # every token after a known context, an unknown one, and at the start of a window
    contexts = [(0, 1), (V - 1, V - 1), (1,), (V - 1, 0)]
    rows = [([*c, t], 1) for c in contexts for t in range(V)]
    got = ngrams.score_ngrams(model, spark.createDataFrame(rows, "gram array<int>, n long"), (3,), V).collect()
    sums = Counter()
    for r in got:
        sums[tuple(r.gram[:-1])] += math.exp(-r.nll)
    assert set(sums) == set(contexts) and all(math.isclose(s, 1, rel_tol=1e-9) for s in sums.values())


def test_bigrams_equal_the_counted_model(spark, scored):
    train = frame(spark, scored[0])
    grams = ngrams.count_grams(train, 2).select(F.col("gram")[0].alias("prev"), F.col("gram")[1].alias("next"), "n")
    pairs = countlm.count_pairs(scoring.shift_pairs(train.filter("size(input_ids) > 0"), keep=()))
    assert sorted(map(tuple, grams.collect())) == sorted(map(tuple, pairs.collect()))


def test_groups_edges_and_errors(spark):
    rows = [("a", [1, 2, 3]), ("a", [1, 2]), ("b", None), (None, [1, 2])]
    chunks = spark.createDataFrame(rows, "side string, input_ids array<int>")
    counts = ngrams.count_grams(chunks, 2, by=("side",))
    assert sorted((r.side or "", tuple(r.gram), r.n) for r in counts.collect()) == [("", (1, 2), 1), ("a", (1, 2), 2), ("a", (2, 3), 1)]
    none = ngrams.ngram_tables(counts.drop("side").limit(0), 2)
    alone = ngrams.score_ngrams(none, counts, (2,), 10, by=("side",)).collect()
    assert len(alone) == 3 and all(math.isclose(r.nll, math.log(10)) for r in alone)
    with pytest.raises(ValueError):
        ngrams.count_grams(chunks, 1)
    with pytest.raises(ValueError):
        ngrams.score_ngrams(none, counts, (2,), 10, discount=0)
