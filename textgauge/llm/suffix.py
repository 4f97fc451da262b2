"""Removal of repeated byte strings by suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts elsewhere is removed. A corpus has no
suffix array that fits one machine, so strings are first dealt out by content:

1. Every window of ``length`` bytes has an anchor, the least hash among the grams that it holds. Equal
   windows have equal anchors at equal places. Neighbouring windows with one anchor form a run, kept as
   (hash of its text, place, anchor, digest of its bytes): one row for about 170 bytes.
2. Runs with equal anchor and digest are equal as a whole; if there are several, all their windows
   repeat. A run that is alone with its anchor repeats nowhere.
3. Different runs with one anchor, mostly the edges of shared passages, are fetched once each and sorted:
   tasks hold whole anchors and build suffix arrays over them by doubling. Places are ranked by their first
   bytes, then by pairs of ranks for twice as many bytes, until ``length`` is reached or all ranks differ;
   neighbours of equal rank are windows that repeat. An anchor with more than ``hot`` different
   runs is not gathered: its windows are hashed and counted, which Spark combines before shuffling.

Only the order of the first ``length`` bytes matters, so comparing stops there.

Passages of so many words that also stand in another document are told beside it, in the same scan: words become hashes,
windows of words get anchors and form runs as above. Runs with several kinds for one anchor are cut into windows, and what
counts is whether a window stands in two documents. Such passages may be shorter than ``length`` bytes; they are counted, not removed.

Defined results: a null or empty text has no bytes; texts shorter than ``length`` lose nothing. Equal rows
repeat each other, whatever their keys. Matches never cross documents. Words are runs of bytes other than ASCII white space,
compared as they are; a passage within one document only is none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from textgauge.llm.common import checked, column, fresh, numbered, saved, text_of
from textgauge.llm.shingles import _BASE, _INVERSE, _VALUES, _powers, mix, word_hashes

U = np.uint64
#: Bits of a place inside a slice of a text; the rest of 64 bits hold the anchor.
PLACE_BITS = 20
#: Bytes that one suffix array covers, unless a single anchor has more.
ARRAY_BYTES = 500_000


def runs(data: np.ndarray, length: int, gram: int, slice_bits: int = PLACE_BITS) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor) of the runs of a text."""
    step = (1 << slice_bits) - length
    found = [_slice_runs(data[i : i + step + length - 1], length, gram) for i in range(0, max(0, len(data) - length + 1), step)]
    starts = [s + i * step for i, (s, _, _) in enumerate(found)]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.concatenate(starts), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])


def _slice_runs(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sums = np.concatenate([np.zeros(1, U), np.cumsum(_VALUES[data] * _powers(_BASE, len(data)))])
    grams = (sums[gram:] - sums[:-gram]) * _powers(_INVERSE, len(data) - gram + 1)
    return _anchored(mix(grams), length - gram + 1)


def _anchored(grams: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor) of the runs of windows of ``wide`` grams."""
    places = U((1 << PLACE_BITS) - 1)
    keys = (grams & ~places) | np.arange(len(grams), dtype=U)
    # minimum of each stretch of ``wide`` keys, from minima to the left and right inside blocks
    n = len(keys)
    padded = np.full(-(-n // wide) * wide, np.iinfo(np.uint64).max, U)
    padded[:n] = keys
    blocks = padded.reshape(-1, wide)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: n - wide + 1], left[wide - 1 : n])
    cuts = np.flatnonzero(np.diff(least)) + 1
    starts = np.concatenate([[0], cuts])
    sizes = np.diff(np.concatenate([starts, [len(least)]]))
    return starts, sizes, (least[starts] >> U(PLACE_BITS)).astype(np.int64)


#: Words of a gram whose hash may be the anchor of a window of words.
WORD_GRAM = 8
#: Bytes of texts that are scanned together; a longer text is scanned by itself.
CHUNK_BYTES = 1 << 15


def _inside(start: np.ndarray, windows: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(which runs, their texts, first and number of windows) of runs over texts end to end, without windows that cross texts.

    The windows of a run share a gram, so they lie inside one text at most.
    """
    some = np.flatnonzero(sizes >= length)
    if not len(some):
        return (np.zeros(0, np.int64),) * 4
    ends = np.cumsum(sizes)[some]
    which = np.searchsorted(ends - length, start)  # the first text with a window there or behind
    owner = np.minimum(which, len(some) - 1)
    low = np.maximum(start, (ends - sizes[some])[owner])
    high = np.minimum(start + windows, ends[owner] - length + 1)
    kept = np.flatnonzero((which < len(some)) & (low < high))
    return kept, some[owner[kept]], low[kept], (high - low)[kept]


def word_runs(words: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor, digest) of the runs of windows of ``length`` words, given the hashes and number of the texts' words."""
    found = []
    step = (1 << PLACE_BITS) - length
    first = np.cumsum(counts) - counts
    for i in range(0, max(0, len(words) - length + 1), step):
        part = words[i : i + step + length - 1]
        sums = np.concatenate([np.zeros(1, U), np.cumsum(part * _powers(_BASE, len(part)))])
        inverse = _powers(_INVERSE, len(part) + 1)
        gram = min(WORD_GRAM, length)
        grams = mix((sums[gram:] - sums[:-gram]) * inverse[: len(part) - gram + 1])
        start, windows, anchor = _anchored(grams, length - gram + 1)
        kept, owner, low, windows = _inside(start + i, windows, counts, length)
        start = low - i
        stop = start + windows + length - 1
        digest = mix((sums[stop] - sums[start]) * inverse[start] + windows.astype(U))
        found.append((owner, low - first[owner], windows, anchor[kept], digest.view(np.int64)))
    if not found:
        return (np.zeros(0, np.int64),) * 5
    return tuple(np.concatenate(x) for x in zip(*found))


# --- suffix array -----------------------------------------------------------------------------


def suffix_ranks(text: np.ndarray, depth: int, room: np.ndarray | None = None) -> np.ndarray:
    """Ranks of all places by the ``depth`` bytes that start there, equal for equal bytes.

    Ranks by some bytes give those by twice as many: by the rank of a place, then that of the place behind these bytes. Only
    places whose rank is not their own yet are sorted again. ``room`` holds the bytes from each place to the end of its
    piece; places with less than ``depth`` may get any rank.
    """
    n = len(text)
    bits = U(n.bit_length())
    padded = np.zeros(n + 4, U)  # behind the end there is less than any byte
    padded[:n] = text
    padded[:n] += U(1)
    reach = min(4, depth)
    key = np.zeros(n, U)
    for i in range(reach):
        key = key << U(9) | padded[i : i + n]
    live, key = _ordered(np.arange(n), key, 9 * reach)
    slots = np.arange(1, n + 1, dtype=np.uint32)  # where the live places stand among all
    rank = np.zeros(n + depth, np.uint32)  # zeros behind the end
    while len(live):
        # a group's rank is the slot of its first place
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(live)))
        own = np.repeat(slots[starts], sizes)
        rank[live] = own
        if reach == depth:
            break
        step = min(reach, depth - reach)
        reach += step
        kept = np.repeat(sizes > 1, sizes)
        if room is not None:
            kept &= room[live] >= reach
        live, slots = live[kept], slots[kept]
        key = own[kept].astype(U) << bits | rank[live + step]
        live, key = _ordered(live, key, 2 * int(bits))
    return rank[:n]


def _ordered(at: np.ndarray, key: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and their keys of ``wide`` bits by key."""
    bits = int(at.max(initial=0)).bit_length()
    if wide + bits <= 64:  # numbers are sorted faster than they are ordered
        both = np.sort(key << U(bits) | at.view(U))
        return (both & U((1 << bits) - 1)).view(np.int64), both >> U(bits)
    order = np.argsort(key)
    return at[order], key[order]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` ordered by the ``depth`` bytes from there on, equal ones next to each other."""
    return np.argsort(suffix_ranks(text, depth), kind="stable")


def _repeated(pieces: list[bytes], length: int) -> np.ndarray:
    """Which places of the pieces, each followed by one byte, start ``length`` bytes that occur more than once in the pieces."""
    text = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    room = (np.repeat(np.cumsum(sizes + 1) - 1, sizes + 1) - np.arange(len(text))).astype(np.int32)
    starts = np.flatnonzero(room >= length)
    flags = np.zeros(len(text), bool)
    if len(starts) > 1:
        rank = suffix_ranks(text, length, room)[starts]
        order = np.argsort(rank)
        equal = rank[order][1:] == rank[order][:-1]
        flags[starts[order[:-1][equal]]] = True
        flags[starts[order[1:][equal]]] = True
    return flags


def repeated_windows(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, which of its windows of ``length`` bytes occur more than once in the pieces."""
    ends = np.cumsum([len(p) + 1 for p in pieces])
    return [f[: max(0, len(f) - length)] for f in np.split(_repeated(pieces, length), ends[:-1])] if pieces else []


# --- the job ----------------------------------------------------------------------------------

#: A run's start and number of windows (below ``length``) in one number.
SHIFT = 12


def _scan(length: int, gram: int, passage: int):
    """(row, h1, h2, bytes) to one row for each run, row, loc, anchor, digest, words; and one for the text, its hashes at loc -1."""

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                found: list[tuple[np.ndarray, ...]] = []
                of_words: list[tuple[np.ndarray, ...]] = []
                texts = [memoryview(value.as_buffer()) for value in batch.column(3)]
                sizes = np.array([len(t) for t in texts], np.int64)
                for first, stop in _chunks(sizes):
                    own = sizes[first:stop]
                    data = b"".join(texts[first:stop])
                    start, windows, anchor = runs(np.frombuffer(data, np.uint8), length, gram)
                    kept, owner, start, windows = _inside(start, windows, own, length)
                    view = memoryview(data)
                    stops = (start + windows + length - 1).tolist()
                    digests = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(start.tolist(), stops)]
                    start -= (np.cumsum(own) - own)[owner]
                    found.append((owner + first, (start << SHIFT) + windows, anchor[kept], np.array(digests, U).view(np.int64)))
                    if passage:
                        owner, start, windows, anchor, digest = word_runs(*word_hashes(texts[first:stop]), passage)
                        of_words.append((owner + first, (start << SHIFT) + windows, anchor, digest))
                row, h1, h2 = (batch.column(i).to_numpy() for i in range(3))
                yield _rows(row, (np.full(len(row), -1), h1, h2), False)
                for own, words in ((found, False), (of_words, True)):
                    if own:
                        owner, *cols = [np.concatenate(c) for c in zip(*own)]
                        yield _rows(row[owner], cols, words)

    return run


def _chunks(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of neighbouring texts of ``CHUNK_BYTES`` together; a longer text is one by itself."""
    ends, out, start = np.cumsum(sizes), [], 0
    while start < len(sizes):
        before = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, "right")))
        out.append((start, stop))
        start = stop
    return out


def _rows(row: np.ndarray, cols, words: bool) -> pa.RecordBatch:
    made = [pa.array(c, pa.int64()) for c in (row, *cols)]
    return pa.RecordBatch.from_arrays([*made, pa.array(np.full(len(row), words))], names=["row", "loc", "anchor", "digest", "words"])


PIECE = ("words", "anchor", "digest", "low", "high", "piece")


def _cut_pieces(length: int, passage: int):
    """(bytes, wanted runs) to one row for each run, with its bytes, or the hashes of its words."""

    def run(batches):
        for batch in batches:
            for value, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
                data = memoryview(value.as_buffer())
                out: list[tuple] = []
                words = word_hashes([bytes(data)])[0] if any(w["words"] for w in wanted) else None
                for w in wanted:
                    a, windows = w["loc"] >> SHIFT, w["loc"] & (1 << SHIFT) - 1
                    piece = words[a : a + windows + passage - 1].tobytes() if w["words"] else bytes(data[a : a + windows + length - 1])
                    out.append((w["words"], w["anchor"], w["digest"], w["low"], w["high"], piece))
                cols = list(zip(*out)) or [()] * len(PIECE)
                kinds = (pa.bool_(), *[pa.int64()] * 4, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=list(PIECE))

    return run


def _shared_words(rows: list[tuple], passage: int) -> np.ndarray:
    """Which places of the pieces of words, each followed by one word, start ``passage`` words that stand in two rows.

    ``low`` and ``high`` are the first and last row that hold a piece.
    """
    words = np.frombuffer(bytes(8).join([*(r[5] for r in rows), b""]), U)
    sizes = np.array([len(r[5]) // 8 for r in rows], np.int64)
    windows = sizes - passage + 1
    owner = np.repeat(np.arange(len(rows)), windows)
    at = np.arange(len(owner)) + np.repeat(np.cumsum(sizes + 1) - sizes - 1 - np.cumsum(windows) + windows, windows)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(words * _powers(_BASE, len(words)))])
    made = mix((sums[at + passage] - sums[at]) * _powers(_INVERSE, len(words))[at])
    bounds = np.array([r[3:5] for r in rows], np.int64)
    # equal windows belong together only under one anchor, which they have
    order = np.argsort(made)
    made = made[order]
    starts = np.flatnonzero(np.concatenate([[True], made[1:] != made[:-1]]))
    low = np.minimum.reduceat(bounds[owner[order], 0], starts)
    high = np.maximum.reduceat(bounds[owner[order], 1], starts)
    flags = np.zeros(len(words), bool)
    flags[at[order]] = np.repeat(low < high, np.diff(np.append(starts, len(order))))
    return flags


def _search(length: int, passage: int):
    """Rows (words, anchor, digest, low, high, piece), anchor by anchor, to the ranges of windows that repeat, or of words that stand in two rows."""

    def search(rows: list[tuple]) -> pa.RecordBatch:
        if of_words := rows[0][0]:
            flags, sizes = _shared_words(rows, passage), np.array([len(r[5]) // 8 for r in rows], np.int64)
        else:
            flags, sizes = _repeated([r[5] for r in rows], length), np.array([len(r[5]) for r in rows], np.int64)
        edges = np.flatnonzero(np.diff(flags, prepend=False, append=False))
        low, high = edges[::2], edges[1::2]
        ends = np.cumsum(sizes + 1)
        which = np.searchsorted(ends, low, "right")
        first = (ends - sizes - 1)[which]
        anchor, digest = (np.array([r[i] for r in rows], np.int64)[which] for i in (1, 2))
        cols = [pa.array(c, pa.int64()) for c in (anchor, digest, low - first, high - first)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(low), of_words)), *cols], names=["words", "anchor", "digest", "low", "high"])

    def run(batches):
        done: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if done and (row[0] != done[-1][0] or size > ARRAY_BYTES and row[1] != done[-1][1]):
                    yield search(done)
                    done, size = [], 0
                done.append(row)
                size += len(row[5])
        if done:
            yield search(done)

    return run


def _hash_windows(length: int, step: int = 1):
    """Rows (anchor, digest, piece) to a hash of 128 bits for each window, which starts every ``step`` bytes."""

    def run(batches):
        for batch in batches:
            for anchor, digest, piece in zip(*(batch.column(i).to_pylist() for i in range(3))):
                view = memoryview(piece)
                n = (len(piece) - length) // step + 1
                made = [xxhash.xxh3_128_digest(view[i * step : i * step + length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([anchor] * n), pa.array([digest] * n), pa.array(range(n), pa.int64()), pa.array(made, pa.binary())],
                    names=["anchor", "digest", "low", "window"],
                )

    return run


def _passages(ranges: list[dict] | None, passage: int) -> tuple[int, int]:
    """Stretches of words that the windows cover, and their words."""
    spans = words = last = 0
    for low, high in sorted((r["low"], r["high"]) for r in ranges or ()):
        stop = high + passage - 1
        if spans == 0 or low > last:
            spans += 1
            words += stop - low
        else:
            words += max(0, stop - last)
        last = max(last, stop)
    return spans, words


def _remove(length: int, passage: int, at: int, names: list[str]):
    """(columns, bytes, ranges of windows, of windows of words) to the columns, sizes, the bytes that are left and passages."""

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                made = []
                for value, ranges, of_words in zip(batch.column(at), batch.column(at + 1).to_pylist(), batch.column(at + 2).to_pylist()):
                    data = value.as_buffer().to_pybytes() if value.is_valid else b""
                    kept, last, removed, spans = [], 0, 0, 0
                    for low, high in sorted((r["low"], r["high"]) for r in ranges or ()):
                        stop = high + length - 1
                        if spans == 0 or low > last:
                            spans += 1
                            kept.append(data[last:low])
                            removed += stop - low
                        else:
                            removed += max(0, stop - last)
                        last = max(last, stop)
                    made.append((len(data), removed, spans, b"".join([*kept, data[last:]]), *_passages(of_words, passage)))
                cols = list(zip(*made)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], *(pa.array(c, t) for c, t in zip(cols, kinds))], names=names)

    return run


def remove_repeats(
    docs: DataFrame,
    text: str = "text",
    length: int = 400,
    gram: int = 64,
    hot: int = 20_000,
    passage: int = 51,
    new: tuple[str, str, str, str, str, str] = ("n_bytes", "n_removed", "n_spans", "kept", "n_passages", "passage_words"),
) -> DataFrame:
    """``docs`` with the number of bytes, removed bytes and removed runs, the bytes that are left, and the number and words of
    the passages of ``passage`` words or more that stand in another document too (0 looks for none).

    New columns replace those of the same names.
    """
    if not gram <= length < 1 << SHIFT or not 0 <= passage < 1 << SHIFT:
        raise ValueError(f"length and passage must be below {1 << SHIFT}, length not below gram")
    held = [c for c in docs.columns if c not in new]
    base = docs.select(*(column(docs, c) for c in held))
    data, h1, h2, wanted, shared = (fresh(base, f"_{c}") for c in ("data", "h1", "h2", "ranges", "shared"))
    base = base.withColumn(data, text_of(docs, text).cast("binary"))
    base = base.withColumns({h1: F.xxhash64(data), h2: F.xxhash64(F.lit("second"), data)})
    texts = base.select(F.col(h1).alias("h1"), F.col(h2).alias("h2"), F.col(data).alias("data"))
    each = numbered(texts, "row").select("row", "h1", "h2", "data")
    each = saved(each.mapInArrow(_scan(length, gram, passage), "row long, loc long, anchor long, digest long, words boolean"), "runs")
    # the first row of every text stands for it
    owners = each.filter("loc < 0").groupBy(F.col("anchor").alias("h1"), F.col("digest").alias("h2")).agg(F.min("row").alias("row"))
    owners = saved(owners, "texts")
    each = each.filter("loc >= 0")

    kinds = each.groupBy("words", "anchor", "digest").agg(
        F.count("*").alias("copies"), F.min("row").alias("first"), F.min_by("loc", "row").alias("loc"), F.max("row").alias("high")
    )
    kinds = kinds.withColumnRenamed("first", "row").withColumn("n", F.count("*").over(Window.partitionBy("words", "anchor")))
    # runs that occur as a whole elsewhere: bytes may repeat in one document, words must stand in two
    whole = F.when(F.col("words"), F.col("row") < F.col("high")).otherwise(F.col("copies") > 1)
    kinds = saved(kinds.filter(whole | (F.col("n") > 1)), "repeated-anchors")
    copied = each.join(kinds.filter(whole).select("words", "anchor", "digest"), ["words", "anchor", "digest"], "left_semi")
    copied = copied.selectExpr("words", "row", f"loc >> {SHIFT} AS low", f"(loc >> {SHIFT}) + (loc & {(1 << SHIFT) - 1}) AS high")

    # different runs with one anchor
    mixed = kinds.filter("n > 1")
    cold = F.col("n") <= hot

    def pieces(some: DataFrame) -> DataFrame:
        cuts = F.collect_list(F.struct("words", "anchor", "digest", "loc", F.col("row").alias("low"), "high")).alias("cuts")
        cuts = saved(some.join(owners, "row").groupBy("h1", "h2").agg(cuts), "cuts")
        held_by = texts.join(checked(cuts.select("h1", "h2")), ["h1", "h2"], "left_semi")
        held_by = held_by.groupBy("h1", "h2").agg(F.first("data").alias("data")).join(cuts, ["h1", "h2"]).select("data", "cuts")
        shape = "words boolean, anchor long, digest long, low long, high long, piece binary"
        return held_by.mapInArrow(_cut_pieces(length, passage), shape)

    # dealt out by anchor as they are cut; only those of hot anchors are written
    ranges = pieces(mixed.filter(cold)).repartition("words", "anchor").sortWithinPartitions("words", "anchor")
    ranges = ranges.mapInArrow(_search(length, passage), "words boolean, anchor long, digest long, low long, high long")
    heat = {r.words for r in mixed.filter(~cold).select("words").distinct().collect()}
    hot_ones = saved(pieces(mixed.filter(~cold)), "hot-pieces") if heat else None
    shape = "anchor long, digest long, low long, window binary"
    if False in heat:
        windows = hot_ones.filter(~F.col("words")).select("anchor", "digest", "piece")
        windows = windows.mapInArrow(_hash_windows(length), shape)
        again = windows.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window")
        again = windows.join(again, "window", "left_semi")
        ranges = ranges.union(again.selectExpr("false", "anchor", "digest", "low", "low + 1"))
    if True in heat:
        windows = hot_ones.filter("words")
        held_in = windows.select("anchor", "digest", F.col("low").alias("first"), F.col("high").alias("last"))
        windows = windows.select("anchor", "digest", "piece").mapInArrow(_hash_windows(8 * passage, 8), shape)
        windows = windows.join(held_in, ["anchor", "digest"])
        again = windows.groupBy("window").agg(F.min("first").alias("first"), F.max("last").alias("last")).filter("first < last")
        again = windows.join(again.select("window"), "window", "left_semi")
        ranges = ranges.union(again.selectExpr("true", "anchor", "digest", "low", "low + 1"))
    single = mixed.filter(~whole)
    start = F.expr(f"loc >> {SHIFT} AS start")
    alone = single.filter("copies = 1").select("words", "anchor", "digest", "row", start)
    # passages within one document have several places there
    again = checked(single.filter("copies > 1").select("words", "anchor", "digest"))
    again = each.filter("words").join(again, ["words", "anchor", "digest"], "left_semi").select("words", "anchor", "digest", "row", start)
    edges = ranges.join(alone.union(again), ["words", "anchor", "digest"])
    edges = edges.selectExpr("words", "row", "start + low AS low", "start + high AS high")

    span = F.struct("low", "high")
    spans = copied.union(edges).join(checked(owners), "row").groupBy("h1", "h2").agg(
        F.collect_list(F.when(~F.col("words"), span)).alias("ranges"), F.collect_list(F.when(F.col("words"), span)).alias("shared")
    )
    spans = spans.select(F.col("h1").alias(h1), F.col("h2").alias(h2), F.col("ranges").alias(wanted), F.col("shared").alias(shared))
    # a text that stays a column is moved once, as that column
    stays = text in held
    joined = (base.drop(data) if stays else base).join(spans, [h1, h2], "left")
    moved = text_of(joined, text).cast("binary").alias(data) if stays else column(joined, data)
    joined = joined.select(*(column(joined, c) for c in held), moved, wanted, shared)
    out = StructType([docs.schema[c] for c in held])
    for name, kind in zip(new, (LongType(), LongType(), LongType(), BinaryType(), LongType(), LongType())):
        out.add(StructField(name, kind))
    return joined.mapInArrow(_remove(length, passage, len(held), out.names), out)
