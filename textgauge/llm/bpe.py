"""Byte-level BPE on padded numpy matrices, bucketed by length.

Texts are split by the tokenizer's pattern. The distinct pieces of a slice of texts become rows of
matrices, one for each range of lengths, padded at the right. In each round every row merges its
leftmost pair of minimum rank; ranks of pairs come from a hash table in two arrays, and rows without
a pair left are taken out of the matrix. Spark deals out the rows; nothing is shuffled.

Defined results: a null or empty text gives no ids and decodes to empty bytes; other columns pass
through untouched. A text's ids do not depend on its neighbours or on batch sizes. Ids unknown to the
vocabulary raise on decoding; a null list of ids decodes to empty bytes.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from textgauge.llm.common import column, cut_batches

NONE = np.int32(2**31 - 1)
#: Rows at least this wide merge all places of a pair in one round where that gives the same ids.
WIDE = 256


class Ranks:
    """A rank file as arrays: bytes of every id, and a hash table from pairs of ids to the merged id."""

    def __init__(self, lines: bytes):
        tokens = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, lines.splitlines())]
        self.ids = dict(tokens)
        size = max(self.ids.values()) + 1
        words = [b""] * size
        for token, i in tokens:
            words[i] = token
        self.known = np.zeros(size, bool)
        self.known[list(self.ids.values())] = True
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(words), np.uint8)
        self.of_byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            (a, b, merged)
            for token, merged in tokens
            for cut in range(1, len(token))
            if (a := self.ids.get(token[:cut])) is not None
            and (b := self.ids.get(token[cut:])) is not None
        ]
        left, right, merged = np.array(pairs, np.int64).reshape(-1, 3).T
        self._fill(left << 32 | right, merged.astype(np.int32))
        # a token is settled if no pair that holds it merges to a lower rank than its own
        self.settled = np.ones(size, bool)
        self.settled[left[merged < left]] = False
        self.settled[right[merged < right]] = False

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probing, at most a quarter full."""
        self.bits = max(4, int(4 * len(keys)).bit_length())
        mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slots, self.probes = self._slots(keys), 0
        while len(keys):
            self.probes += 1
            free = self.keys[slots] < 0
            _, first = np.unique(np.where(free, slots, -1), return_index=True)
            placed = first[free[first]]
            self.keys[slots[placed]], self.values[slots[placed]] = keys[placed], values[placed]
            rest = np.ones(len(keys), bool)
            rest[placed] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of each pair, NONE where the pair does not merge or holds padding (-1)."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(keys.shape, NONE, np.int32)
        ask = np.nonzero((left.ravel() >= 0) & (right.ravel() >= 0))[0]
        flat, found = keys.ravel(), out.ravel()
        slots, mask = self._slots(flat[ask]), (1 << self.bits) - 1
        for _ in range(self.probes):
            there = self.keys[slots]
            hit = there == flat[ask]
            found[ask[hit]] = self.values[slots[hit]]
            more = ~hit & (there >= 0)
            if not more.any():
                break
            ask, slots = ask[more], (slots[more] + 1) & mask
        return found.reshape(keys.shape)

    def merge_rows(self, rows: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of byte ids, padded with -1 at the right."""
        out: list[np.ndarray] = [rows[0][:0]] * len(rows)
        place = np.arange(len(rows))
        ranks = self.ranks(rows[:, :-1], rows[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1)
            each = np.arange(len(rows))
            best = ranks[each, at]
            done = best == NONE
            if done.any():
                for k in np.nonzero(done)[0]:
                    out[place[k]] = rows[k][rows[k] >= 0]
                live = ~done
                rows, ranks, place, at, best = rows[live], ranks[live], place[live], at[live], best[live]
                each = each[: len(rows)]
                if not len(rows):
                    break
            rows[each, at] = best
            shift = np.arange(rows.shape[1] - 1)[None, :]
            rows = np.take_along_axis(rows, shift + (shift > at[:, None]), axis=1)
            if rows.shape[1] == 1:
                for k in each:
                    out[place[k]] = rows[k]
                break
            shift = shift[:, :-1]
            ranks = np.take_along_axis(ranks, shift + (shift >= at[:, None]), axis=1)
            last = rows.shape[1] - 1
            for side in (at - 1, at):
                ok = (side >= 0) & (side < last)
                r, c = each[ok], side[ok]
                ranks[r, c] = self.ranks(rows[r, c], rows[r, c + 1])
            if len(rows) and (width := int((rows >= 0).sum(axis=1).max())) < rows.shape[1] // 2:
                width = max(width, 2)
                rows, ranks = rows[:, :width], ranks[:, : width - 1]
        return out

    def merge_wide(self, row: np.ndarray) -> np.ndarray:
        """Ids of one long row.

        Merging the leftmost minimum makes new pairs. If none of them can have a lower rank, the
        following rounds would take the other places of the same pair from left to right, so these
        are merged at once; otherwise only the leftmost is.
        """
        ranks = self.ranks(row[:-1], row[1:])
        while len(row) > 1 and (best := ranks.min()) != NONE:
            at = np.nonzero(ranks == best)[0]
            if self.settled[best]:
                # of places that touch, every other one counted from the start of their run
                run = np.cumsum(np.diff(at, prepend=-2) > 1)
                first = at[np.searchsorted(run, run)]
                at = at[(at - first) % 2 == 0]
            else:
                at = at[:1]
            row[at] = best
            keep = np.ones(len(row), bool)
            keep[at + 1] = False
            row = row[keep]
            if len(row) < 2:
                break
            ranks = ranks[np.nonzero(keep)[0][:-1]]
            new = np.cumsum(keep)[at] - 1
            touched = np.unique(np.concatenate([new - 1, new]))
            touched = touched[(touched >= 0) & (touched < len(row) - 1)]
            ranks[touched] = self.ranks(row[touched], row[touched + 1])
        return row

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of every piece; pieces of like length share a matrix."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        for i in np.nonzero(lengths >= WIDE)[0]:
            out[i] = self.merge_wide(self.of_byte[np.frombuffer(pieces[i], np.uint8)])
        for i in np.nonzero(lengths == 1)[0]:
            out[i] = self.of_byte[pieces[i][0] : pieces[i][0] + 1]
        low = 2
        while low < WIDE:
            high = min(WIDE, low + max(1, low // 2))
            chosen = np.nonzero((lengths >= low) & (lengths < high))[0]
            step = max(1, 1_000_000 // high)
            for part in (chosen[k : k + step] for k in range(0, len(chosen), step)):
                flat = np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)
                rows = np.full((len(part), int(lengths[part].max())), -1, np.int32)
                rows[np.arange(rows.shape[1])[None, :] < lengths[part][:, None]] = self.of_byte[flat]
                for i, ids in zip(part, self.merge_rows(rows)):
                    out[i] = ids
            low = high
        return out

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and the end of each list's bytes, of lists with these counts."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("ids outside the vocabulary")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        made = self.flat[np.arange(len(shift)) + shift]
        return made, np.concatenate([[0], ends])[np.cumsum(counts)]


@lru_cache(maxsize=2)
def _ranks(name: str) -> Ranks:
    """Read once per Python worker from the files that Spark has shipped."""
    with open(SparkFiles.get(name), "rb") as f:
        return Ranks(f.read())


def ship(spark: SparkSession, path: str) -> str:
    """Hand a vocabulary file to the executors; returns the name under which they find it."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode_texts(ranks: Ranks, pattern, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in a row, and the number of each text's ids."""
    number: dict[str, int] = {}
    places = [
        np.fromiter((number.setdefault(p, len(number)) for p in pattern.findall(t)), np.int64)
        for t in texts
    ]
    made = ranks.encode_pieces([p.encode("utf-8") for p in number])
    sizes = np.array([len(m) for m in made], np.int64)
    flat = np.concatenate(made) if made else np.zeros(0, np.int32)
    starts = np.cumsum(sizes) - sizes
    order = np.concatenate(places) if places else np.zeros(0, np.int64)
    each = sizes[order] if len(order) else order
    ends = np.cumsum(each)
    ids = flat[np.arange(int(each.sum())) + np.repeat(starts[order] - (ends - each), each)]
    bounds = np.cumsum([0, *map(len, places)])
    return ids, np.diff(np.concatenate([[0], ends])[bounds])


def bpe_encode(
    docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids"
) -> DataFrame:
    """``docs`` with the token ids of each text in the column ``ids`` (replaced if it is there)."""
    name = ship(docs.sparkSession, path)
    held = [c for c in docs.columns if c != ids]
    at = held.index(text)

    def run(batches):
        import regex

        ranks, find = _ranks(name), regex.compile(pattern)
        for whole in batches:
            for batch in cut_batches(whole, at):
                texts = [t or "" for t in batch.column(at).to_pylist()]
                made, counts = encode_texts(ranks, find, texts)
                yield _with(batch, held, ids, pa.ListArray.from_arrays(_offsets(counts), pa.array(made, pa.int32())))

    schema = StructType([docs.schema[c] for c in held] + [StructField(ids, ArrayType(IntegerType()))])
    return docs.select(*(column(docs, c) for c in held)).mapInArrow(run, schema)


def bpe_decode(docs: DataFrame, path: str, ids: str = "ids", data: str = "bytes") -> DataFrame:
    """``docs`` with the bytes of each list of ids in the column ``data`` (replaced if it is there)."""
    name = ship(docs.sparkSession, path)
    held = [c for c in docs.columns if c != data]
    at = held.index(ids)

    def run(batches):
        ranks = _ranks(name)
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                lists = batch.column(at)
                lists = lists.fill_null([]) if lists.null_count else lists
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                counts = np.array(lists.value_lengths(), np.int64)
                made, ends = ranks.decode(flat, counts)
                offsets = np.concatenate([[0], ends])
                if offsets[-1] >= 2**31:
                    raise ValueError("a batch decodes to over 2 GiB; lower arrow.maxRecordsPerBatch")
                values = pa.Array.from_buffers(
                    pa.binary(), batch.num_rows,
                    [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(made))],
                )
                yield _with(batch, held, data, values)

    schema = StructType([docs.schema[c] for c in held] + [StructField(data, BinaryType())])
    return docs.select(*(column(docs, c) for c in held)).mapInArrow(run, schema)


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))


def _with(batch: pa.RecordBatch, held: list[str], name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*held, name])
