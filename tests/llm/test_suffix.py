"""Removal of repeats against looking every string up in a dictionary."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from textgauge.llm import suffix
from textgauge.llm.queries import QUERIES


def plain(texts, length):
    """(bytes, removed, runs, what is left) of every text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), runs, bytes(b for b, g in zip(d, gone) if not g)))
    return out


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300), st.sampled_from([3, 8, 13, 40]))
def test_suffix_array(data, depth):
    for text in (data, bytes(b % 3 for b in data), data + b"\0\0\0" + data):
        got = [text[i : i + depth] for i in suffix.suffix_array(np.frombuffer(text, np.uint8), depth)]
        assert got == sorted(text[i : i + depth] for i in range(len(text)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", max_size=60), max_size=6), st.sampled_from([1, 5, 8, 9, 16]))
def test_repeated_windows(texts, length):
    pieces = [t.encode() for t in texts]
    seen = Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
    for p, flags in zip(pieces, suffix.repeated_windows(pieces, length)):
        assert flags.tolist() == [seen[p[i : i + length]] > 1 for i in range(len(p) - length + 1)]


@settings(max_examples=100, deadline=None)
@given(st.text("ab c", max_size=200), st.text("abc", min_size=25, max_size=80))
def test_equal_windows_have_equal_anchors(a, b):
    seen = {}
    for text in (a + b, b + a, b):
        data = text.encode()
        start, windows, anchor = suffix.runs(np.frombuffer(data, np.uint8), 20, 6, slice_bits=6)
        assert windows.sum() == max(0, len(data) - 19)
        for s, n, h in zip(start, windows, anchor):
            for i in range(s, s + n):
                assert seen.setdefault(data[i : i + 20], h) == h


def corpus():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = say(12), say(6)
    texts = [None, "", "short", "a" * 90, "ab" * 40, line, line]
    for i in range(60):
        t = say(rng.randrange(3, 40))
        if i % 3 == 0:
            t = f"{t} {passage} {say(9)}"
        if i % 4 == 0:
            t = f"{line} {t}"
        texts += [t] * (1 + (i % 10 == 0))
    big = say(400)
    return texts + [big, big[:900] + "#" + big[903:], big[500:1500] + passage]


@pytest.mark.parametrize("hot,bits", [(20_000, 20), (1, 20), (2, 7)])
def test_job(spark, monkeypatch, hot, bits):
    monkeypatch.setattr(suffix.runs, "__defaults__", (bits,))
    monkeypatch.setattr(suffix, "ARRAY_BYTES", 2000)
    texts = corpus()
    rows = [(i, t, 1.5, None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid double, kept string").repartition(3)
    made = suffix.remove_repeats(docs, length=24, gram=6, hot=hot, passage=5)
    assert made.columns == ["doc_id", "text", "rid", "n_bytes", "n_removed", "n_spans", "kept", "n_passages", "passage_words"]
    rows = made.collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows}
    assert [got[i] for i in range(len(texts))] == plain(texts, 24)
    assert {r.doc_id: (r.n_passages, r.passage_words) for r in rows} == dict(enumerate(passages(texts, 5)))


def passages(texts, size):
    """Stretches of words that stand in another text too, and their words, by a dictionary of all windows."""
    cut = [[w for w in re.split(r"[ \t\n\v\f\r]+", t or "") if w] for t in texts]
    where = defaultdict(set)
    for i, words in enumerate(cut):
        for k in range(len(words) - size + 1):
            where[tuple(words[k : k + size])].add(i)
    out = []
    for words in cut:
        held = [False] * len(words)
        for k in range(len(words) - size + 1):
            if len(where[tuple(words[k : k + size])]) > 1:
                held[k : k + size] = [True] * size
        # windows that only touch are two passages unless they share a word
        spans, last = 0, -1
        for k in range(len(words) - size + 1):
            if len(where[tuple(words[k : k + size])]) > 1:
                spans += k > last
                last = k + size
        out.append((spans, sum(held)))
    return out


@pytest.mark.parametrize("size", [8, 51])
def test_passages_of_words(spark, size):
    rng = random.Random(size)
    words = [f"w{i}" for i in range(40)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, edge = say(size), say(size - 1)
    texts = [f"{say(30)} {shared} {say(20)}", f"{shared}\n{say(4)}", f"{say(9)} {edge} {say(9)}", f"{edge} {say(9)}", None, "", say(200)]
    twice = say(size + 3)
    texts += [f"{twice} {say(5)} {twice}", say(70), texts[0], f"{say(3)} {shared.replace(' ', '  ')}", f"{shared} {say(40)} {shared} {twice[:20]}"]
    texts += [" ".join(["x"] * 300), " ".join(["x"] * 90), "word " * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_passages, r.passage_words) for r in suffix.remove_repeats(docs, passage=size).collect()}
    assert got == dict(enumerate(passages(texts, size)))
    off = suffix.remove_repeats(docs, passage=0).select("n_passages", "passage_words").distinct().collect()
    assert [tuple(r) for r in off] == [(0, 0)]


def test_text_is_moved_once(spark, monkeypatch):
    """The last join carries each text as one column, and pieces of runs are dealt out without being written."""
    written = []
    saved = suffix.saved
    monkeypatch.setattr(suffix, "saved", lambda df, name: written.append(name) or saved(df, name))
    docs = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    made = suffix.remove_repeats(docs, length=24, gram=6, passage=5)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("AS _data#") < plan.index("Join LeftOuter")  # the plan's root comes first
    assert not [n for n in written if "pieces" in n]


def test_texts_scanned_together():
    """Texts that are scanned end to end have the runs that they have by themselves."""
    texts = [(t or "").encode() for t in corpus()]
    sizes = np.array([len(t) for t in texts])
    start, windows, anchor = suffix.runs(np.frombuffer(b"".join(texts), np.uint8), 24, 6)
    kept, owner, start, windows = suffix._inside(start, windows, sizes, 24)
    start -= (np.cumsum(sizes) - sizes)[owner]
    got = list(zip(owner.tolist(), start.tolist(), windows.tolist(), anchor[kept].tolist()))
    want = []
    for i, t in enumerate(texts):
        want += [(i, *x) for x in zip(*(c.tolist() for c in suffix.runs(np.frombuffer(t, np.uint8), 24, 6)))]
    assert got == want


@pytest.mark.parametrize("n", [1000, 1 << 22])
def test_ranks_of_many_places(n):
    """Ranks are right also where the ranks of two places and a place do not fit one number."""
    rng = np.random.default_rng(1)
    text = rng.integers(0, 256, n, dtype=np.uint8)
    text[n // 2 : n // 2 + 300] = text[:300]
    rank = suffix.suffix_ranks(text, 40)
    order = np.argsort(rank)
    assert sorted(np.flatnonzero(np.bincount(rank)[rank] > 1)) == [*range(261), *range(n // 2, n // 2 + 261)]
    some = order[:: n // 500]
    assert [bytes(text[i : i + 40]) for i in some] == sorted(bytes(text[i : i + 40]) for i in some)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.remove_repeats(docs).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op3_repeats"](spark, folder).collect()}
    assert len(got) == len(docs)
    removed = 0
    for d, want in zip(docs, plain([d.text for d in docs], 400)):
        r = got[d.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (*want[:3], hashlib.sha256(want[3]).hexdigest())
        removed += r.n_removed
    assert removed > 100_000
    want = passages([d.text for d in docs], 51)
    assert [(got[d.doc_id].n_passages, got[d.doc_id].passage_words) for d in docs] == want
