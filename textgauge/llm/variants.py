"""Spelling variants: words one edit apart, by composing a vocabulary acceptor with a one-edit transducer and itself.

The transducer copies letters and changes, adds or drops one. Composed with the acceptor of the vocabulary on both sides
it accepts the pairs of words that are one edit apart. Up to the edit both sides read the same letters, so they
are in one state of the acceptor; after it they read the same rest, from two states. What can follow the edit thus
depends on the state alone, and in a minimised acceptor many beginnings share a state: it is searched once for all.

The composition is dealt out by its initial states. A partition holds the words that share a beginning, of at least
``LETTERS`` letters, and longer until no more than ``most`` words share it; a task builds the minimal acceptor of what
follows and enumerates the pairs whose edit comes later. Pairs whose edit is among the letters of the beginning
leave the initial states by different arcs: they are found where both must read the same rest, by grouping on beginning,
place of the edit and rest. Such a group has as many words as there are letters, at most. Every pair is
found once: its edit is put where the two words first differ. Words of over ``LONG`` letters, which no vocabulary
needs and junk may hold, meet in such groups for every place of the edit, by hashes of what they must share, and are compared then.

Of each word the near word with the largest count is its form, if that count is large enough; roots follow forms by
doubling the steps each round.

Defined results: a null text has no words; a null key counts as empty in what is deleted. Equal rows count each. Ties of counts go to the
word that is smaller in code-point order. An empty table has no words. Texts of any length are read whole, by a
bounded number of words at a time.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textgauge.llm.common import column, cut_batches, numbered, saved
from textgauge.llm.shingles import mix

#: Letters of a beginning at least, and words that may share one.
LETTERS, MOST = 2, 5_000
#: Distinct words that a task counts together.
COUNTED = 400_000
RUN = "[A-Za-zÀ-ÿ]+"
#: Words of more letters are not put in acceptors; their rests are grouped by hash and compared.
LONG = 64


# --- words ------------------------------------------------------------------------------------


def word_counts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 5, least: int = 3, drop_one_of: int = 97
) -> DataFrame:
    """(word, n): runs of Latin letters, A-Z lower-cased, with at least ``least_chars`` letters and occurrences.

    From every ``drop_one_of``-th word of a document, by crc32 of key and word, one letter is deleted, as a
    writing error that is known; 0 deletes none.
    """
    said = F.coalesce(column(docs, key).cast("string"), F.lit(""))
    rows = docs.select(said.alias("key"), column(docs, text).alias("text")).filter("text IS NOT NULL")

    def run(batches):
        find = re.compile(RUN).findall
        total: dict[str, int] = {}
        for whole in batches:
            for batch in cut_batches(whole, 1):
                for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    low = value.encode("utf-8").lower().decode("utf-8")  # bytes.lower knows A-Z only
                    start = zlib.crc32(f"{name}:".encode())
                    for word, n in Counter(find(low)).items():
                        if len(word) < least_chars:
                            continue
                        if drop_one_of:
                            h = zlib.crc32(word.encode("utf-8"), start)
                            if h % drop_one_of == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < least_chars:
                                    continue
                        total[word] = total.get(word, 0) + n
                    if len(total) > COUNTED:
                        yield _table(("word", "n"), total.items(), (pa.string(), pa.int64()))
                        total = {}
        yield _table(("word", "n"), total.items(), (pa.string(), pa.int64()))

    counted = rows.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _table(names: tuple[str, ...], rows: Iterable[tuple], kinds: tuple) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=list(names))


# --- composition ------------------------------------------------------------------------------


def acceptor(words: list[str]) -> tuple[list[dict[str, int]], list[bool]]:
    """The minimal acceptor of sorted distinct words: arcs and acceptance of each state; the last is initial.

    A state is finished when the words leave its branch, and is shared with an equal finished one.
    """
    arcs: list[dict[str, int]] = []
    final: list[bool] = []
    known: dict[tuple, int] = {}
    branch: list[tuple[dict[str, int], bool]] = [({}, False)]  # unfinished states of the last word
    last = ""

    def finish(depth: int) -> None:
        while len(branch) > depth + 1:
            own, accepts = branch.pop()
            name = (accepts, *own.items())
            state = known.get(name)
            if state is None:
                state = known[name] = len(arcs)
                arcs.append(own)
                final.append(accepts)
            branch[-1][0][last[len(branch) - 1]] = state

    for word in words:
        same = 0
        while same < len(last) and same < len(word) and last[same] == word[same]:
            same += 1
        finish(same)
        branch += [({}, False) for _ in word[same:]]
        branch[-1] = (branch[-1][0], True)
        last = word
    finish(0)
    arcs.append(branch[0][0])
    final.append(branch[0][1])
    return arcs, final


class Composition:
    """Acceptor, one-edit transducer, acceptor: enumerates the pairs of words one edit apart."""

    def __init__(self, words: list[str]):
        self.arcs, self.final = acceptor(words)
        self.shared: dict[tuple[int, int], tuple[str, ...]] = {}
        self.edits: dict[int, list[tuple[str, str]]] = {}

    def rests(self, a: int, b: int) -> tuple[str, ...]:
        """What both of two states accept."""
        if a > b:
            a, b = b, a
        made = self.shared.get((a, b))
        if made is None:
            out = [""] if self.final[a] and self.final[b] else []
            left, right = self.arcs[a], self.arcs[b]
            for c in left if a == b else left.keys() & right.keys():
                out += [c + r for r in self.rests(left[c], right[c])]
            made = self.shared[a, b] = tuple(out)
        return made

    def edited(self, state: int) -> list[tuple[str, str]]:
        """Pairs of rests from one state that differ by an edit of the first letter."""
        made = self.edits.get(state)
        if made is None:
            made = []
            out = sorted(self.arcs[state].items())
            for i, (a, to) in enumerate(out):
                for b, other in out[i + 1 :]:  # one letter for another
                    made += [(a + r, b + r) for r in self.rests(to, other)]
                # one letter more than the other, which goes on with another letter or ends here
                made += [(a + r, r) for r in self.rests(to, state) if r[:1] != a]
            self.edits[state] = made
        return made

    def pairs(self) -> Iterator[tuple[str, str]]:
        todo = [(len(self.arcs) - 1, "")]
        while todo:
            state, read = todo.pop()
            for x, y in self.edited(state):
                yield read + x, read + y
            todo += [(to, read + c) for c, to in self.arcs[state].items()]


def _compose(batches):
    """Rows (start, word, n), beginning by beginning, to (word, near, n of near) in both directions."""
    kinds = (pa.string(), pa.string(), pa.int64())
    names = ("word", "near", "near_n")

    def found(start: str, counts: dict[str, int]) -> Iterator[pa.RecordBatch]:
        cut = len(start)
        out = []
        for x, y in Composition(sorted(w[cut:] for w in counts)).pairs():
            a, b = start + x, start + y
            out += [(a, b, counts[b]), (b, a, counts[a])]
            if len(out) > 100_000:
                yield _table(names, out, kinds)
                out = []
        yield _table(names, out, kinds)

    held, counts = None, {}
    for batch in batches:
        for start, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if start != held:
                if len(counts) > 1:
                    yield from found(held, counts)
                held, counts = start, {}
            counts[word] = n
    if len(counts) > 1:
        yield from found(held, counts)


def initial_states(words: DataFrame, letters: int = LETTERS, most: int = MOST) -> DataFrame:
    """``words`` with the beginning ``start`` that names each one's partition, and ``depth``, the letters up to there.

    A beginning that more than ``most`` words share is cut one letter later, again and again. A word that ends
    before counts its end as a letter and is a partition of its own.
    """
    depth, hot, starts = letters, None, None
    while True:
        grown = F.left("word", F.lit(depth))
        at = words.select(grown.alias("start"), (F.length("word") < depth).alias("ended"))
        if hot is not None:
            at = words.join(hot, F.left("word", F.lit(depth - 1)) == F.col("hot"), "left_semi").select(
                grown.alias("start"), (F.length("word") < depth).alias("ended")
            )
        sizes = saved(at.groupBy("start", "ended").agg(F.count("*").alias("words")), "beginnings")
        over = sizes.filter(~F.col("ended") & (F.col("words") > most)).select(F.col("start").alias("hot"))
        fits = sizes.filter(F.col("ended") | (F.col("words") <= most)).select(F.col("start").alias("s"), F.lit(depth).alias("depth"), "ended")
        starts = fits if starts is None else starts.union(fits)
        if over.isEmpty():
            break
        hot, depth = over, depth + 1
    # only beginnings longer than the common ones need looking up
    longer = saved(starts.filter(F.col("depth") > letters), "long-beginnings")
    made = words.withColumns({"start": F.left("word", F.lit(letters)), "depth": F.lit(letters)})
    for d in range(letters + 1, depth + 1):
        own = longer.filter(F.col("depth") == d).select(F.col("s").alias("_start"), F.col("ended").alias("_ended"))
        fits = (F.left("word", F.lit(d)) == F.col("_start")) & ((F.length("word") < d) == F.col("_ended"))
        made = made.join(own, fits, "left").select(
            *words.columns,
            F.coalesce("_start", "start").alias("start"),
            F.when(F.col("_start").isNotNull(), d).otherwise(F.col("depth")).alias("depth"),
        )
    return made


def near_words(words: DataFrame, letters: int = LETTERS, most: int = MOST) -> DataFrame:
    """(word, near, near_n): both directions of every pair of the words (word, n) that are one edit apart."""
    words = words.select("word", "n")
    dealt = initial_states(words.filter(F.length("word") <= LONG), letters, most)
    dealt = saved(dealt, "dealt-words")
    whole = dealt.filter(F.length("word") >= F.col("depth")).select("start", "word", "n")
    later = whole.repartition("start").sortWithinPartitions("start").mapInArrow(_compose, "word string, near string, near_n long")

    # edits among the first letters: the letter that one side reads, nothing for a side that reads none
    places = F.sequence(F.lit(0), F.least(F.col("depth") - 1, F.length("word")))
    arcs = F.explode(places).alias("at")
    rows = dealt.select("word", "n", arcs)
    head = F.expr("left(word, at)")
    reads = F.expr("at < length(word)")
    read = rows.filter(reads).select(
        F.concat(head, F.lit("*"), F.expr("substring(word, at + 2)")).alias("rest"), "word", "n", F.expr("substring(word, at + 1, 1)").alias("letter"), F.expr("substring(word, at + 2, 1)").alias("next")
    )
    stay = rows.select(
        F.concat(head, F.lit("*"), F.expr("substring(word, at + 1)")).alias("rest"), "word", "n", F.lit("").alias("letter"), F.expr("substring(word, at + 1, 1)").alias("next")
    )
    same = read.union(stay).groupBy("rest").agg(F.collect_list(F.struct("word", "n", "letter", "next")).alias("g")).filter("size(g) > 1")
    first = same.selectExpr(f"explode({_differing('word', 'n')}) AS p").select(
        F.col("p.x_word").alias("word"), F.col("p.y_word").alias("near"), F.col("p.y_n").alias("near_n")
    )
    both = later.union(first)
    long = words.filter(F.length("word") >= LONG)
    return both if long.isEmpty() else both.union(_long_pairs(long))


def _differing(*fields: str) -> str:
    """The pairs (x, y) of different words in a group g, with these fields of each.

    An added letter counts only if the other word goes on with another one.
    """
    made = ", ".join(f"{side}.{f} AS {side}_{f}" for side in "xy" for f in fields)
    return (
        "flatten(transform(g, x -> transform(filter(g, y -> CASE WHEN x.letter = '' THEN y.letter <> '' AND y.letter <> y.next"
        f" WHEN y.letter = '' THEN x.letter <> x.next ELSE x.letter <> y.letter END), y -> struct({made}))))"
    )


def _hash_rests(batches):
    """(id, word) to one row for each place of an edit and side: hash of what is shared, letter and next letter."""
    base = np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        for name, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            codes = np.frombuffer(word.encode("utf-32-le"), np.uint32)
            n = len(codes)
            powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))
            values = mix(codes.astype(np.uint64) + np.uint64(1))
            head = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[:n])])
            at = np.arange(n)
            # rests as they stand after one letter less
            moved = (head[n] - head[1:]) * np.uint64(pow(int(base), -1, 1 << 64))
            letters = list(word)
            for rest, places, own, ahead in (
                (moved, at, letters, [*letters[1:], ""]),
                (head[n] - head, np.arange(n + 1), [""] * (n + 1), [*letters, ""]),
            ):
                key = mix(mix(head[places] + np.uint64(7)) ^ mix(rest + places.astype(np.uint64)))
                for k in range(0, len(places), 50_000):
                    part = slice(k, k + 50_000)
                    size = len(places[part])
                    cols = [key[part].view(np.int64), np.full(size, name), places[part]]
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(c, pa.int64()) for c in cols), *(pa.array(c[part], pa.string()) for c in (own, ahead))],
                        names=["rest", "id", "at", "letter", "next"],
                    )


def _long_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of words of at least LONG letters, but for pairs of just so many."""
    words = saved(numbered(words, "id"), "long-words")
    rows = words.select("id", "word").mapInArrow(_hash_rests, "rest long, id long, at long, letter string, next string")
    same = rows.groupBy("rest", "at").agg(F.collect_list(F.struct("id", "letter", "next")).alias("g")).filter("size(g) > 1")
    found = same.select("at", F.expr(f"explode({_differing('id', 'letter')})").alias("p")).select("at", "p.*")
    found = saved(found, "long-pairs")
    found = found.join(words.select(F.col("id").alias("x_id"), "word"), "x_id")
    found = found.join(words.select(F.col("id").alias("y_id"), F.col("word").alias("near"), F.col("n").alias("near_n")), "y_id")
    rest = "substring({0}, int(at + 1 + length({1}_letter)))"
    equal = f"left(word, int(at)) = left(near, int(at)) AND {rest.format('word', 'x')} = {rest.format('near', 'y')}"
    return found.filter(equal).filter((F.length("word") > LONG) | (F.length("near") > LONG)).select("word", "near", "near_n")


# --- forms and roots --------------------------------------------------------------------------


def variant_groups(words: DataFrame, ratio: int = 2, letters: int = LETTERS, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word (word, n).

    A word's form is its near word of largest count, if that is at least ``ratio`` times its own; its root is the last of its forms' forms.
    """
    words = saved(words, "vocabulary")
    near = near_words(words, letters, most).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    )
    near = near.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    own = words.join(near, "word", "left")
    takes = F.col("near_n") >= ratio * F.col("n")
    own = own.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("near")).alias("form"), F.when(takes, F.col("near_n")).alias("form_n")
    )
    own = saved(own, "forms")
    steps = own.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = steps.select(F.col("word").alias("at"), F.col("root").alias("further"))
        steps = steps.join(ahead, F.col("root") == F.col("at"), "left")
        steps = saved(steps.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if steps.filter("moved").isEmpty():
            break
        steps = steps.drop("moved")
    return own.join(steps.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
