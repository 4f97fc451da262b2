"""Spelling variants against brute force over edits of every word."""

import random
import re
import zlib
from collections import Counter

import pytest

from textgauge.llm import variants
from textgauge.llm.queries import QUERIES


def edits(word, letters):
    out = set()
    for i in range(len(word) + 1):
        out |= {word[:i] + c + word[i:] for c in letters}
        if i < len(word):
            out |= {word[:i] + word[i + 1 :]} | {word[:i] + c + word[i + 1 :] for c in letters}
    return out - {word}


def plain(words):
    letters = set("".join(words))
    near = {w: [x for x in edits(w, letters) if x in words] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words[form[w]] if form[w] is not None else None) for w, n in words.items()}


def rows(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def count(docs):
    total = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize("most", [5_000, 40, 3])
def test_against_all_edits(spark, most):
    rng = random.Random(3)
    words = {}
    while len(words) < 1500:
        words["".join(rng.choice("abcé" if rng.random() < 0.5 else "ab") for _ in range(rng.randint(5, 9)))] = rng.choice([3, 4, 6, 7, 12, 25, 100])
    for _ in range(40):  # around the length from which words are compared by hash
        w = "".join(rng.choice("ab") for _ in range(rng.choice([62, 63, 64, 65, 66, 200])))
        words[w] = rng.randint(3, 20)
        for _ in range(4):
            i = rng.randrange(len(w))
            words[rng.choice([w[:i] + "c" + w[i:], w[:i] + w[i + 1 :], w[:i] + "d" + w[i + 1 :], w + "a"])] = rng.randint(3, 50)
    got = variants.variant_groups(spark.createDataFrame(list(words.items()), "word string, n long"), most=most)
    assert rows(got) == plain(words)


def test_minimal_acceptor():
    words = sorted(["tap", "taps", "top", "tops", "toper", "á", "a"])
    arcs, final = variants.acceptor(words)
    said = []

    def walk(state, read):
        if final[state]:
            said.append(read)
        for c, to in arcs[state].items():
            walk(to, read + c)

    walk(len(arcs) - 1, "")
    assert sorted(said) == words
    shapes = {(f, *sorted(a.items())) for a, f in zip(arcs, final)}
    assert len(shapes) == len(arcs)  # no two states are equal


def test_whole_table(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_variants"](spark, small)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows(got) == plain(count(docs))


def test_edges(spark):
    long = "x" * 120_000
    docs = [(1, None), (2, ""), (None, "Größe GRÖSSE größe größe Größen größen größen"), (3, "12 ÷×÷×÷ "), (4, f"{long} {long}y {long}"), (5, f"{long} {long}y {long}y")]
    docs += [(6, "Ähnlich ähnlich ÄHNLICH ähnlich ähnlich")] * 2
    table = spark.createDataFrame([(*d, "a", 1) for d in docs], "doc_id long, text string, word string, n int")
    words = variants.word_counts(table.drop("word", "n"))
    assert {r.word: r.n for r in words.collect()} == count(docs)
    assert rows(variants.variant_groups(variants.word_counts(table))) == {
        w: v for w, v in plain_long(count(docs)).items()
    }
    none = variants.variant_groups(variants.word_counts(table.limit(0)))
    assert none.count() == 0 and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def plain_long(words):
    """As plain, by comparing all pairs, for words too long to try all edits."""

    def one_edit(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        i = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]

    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    out = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 2 * n else None
        out[w] = (form, form or w, n, len(near[w]), words[form] if form else None)
    return out
