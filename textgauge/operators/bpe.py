"""Byte-level BPE with a given merge list, encoded where the documents lie.

Merges never cross pre-tokens, and a corpus repeats its pre-tokens: each part of an Arrow batch is
dictionary-encoded, and only pre-tokens not met before in the task go through the merges.
There is no shuffle and no join back.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from textgauge.operators.tokenizing import item_slices, once

MAX_MERGES = 1_000_000
#: Bytes of merged pre-tokens and their ids that a task keeps for the next batches.
KNOWN_BYTES = 32_000_000


def printable_bytes() -> list[str]:
    """The published byte alphabet of merge files: one visible character per byte value.

    Visible Latin-1 bytes stand for themselves, the others get code points from 256 on.
    """
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


def read_bpe(
    spark: SparkSession, merges_path: str, vocab_path: str
) -> tuple[list[tuple[bytes, bytes]], dict[bytes, int]]:
    """Merge list in rank order and token ids, from the usual text and JSON files."""
    value_of = {c: b for b, c in enumerate(printable_bytes())}

    def raw(token: str) -> bytes:
        return bytes(value_of[c] for c in token)

    lines = spark.read.text(merges_path, wholetext=True).first()["value"].split("\n")
    pairs = [
        line.split(" ") for line in lines if line.strip() and not line.startswith("#version")
    ]
    if len(pairs) > MAX_MERGES:
        raise ValueError(f"more than {MAX_MERGES} merges")
    entries = json.loads(spark.read.text(vocab_path, wholetext=True).first()["value"])
    ids = {raw(t): i for t, i in entries.items() if all(c in value_of for c in t)}
    return [(raw(a), raw(b)) for a, b in pairs], ids


def byte_vocab(merges: Sequence[tuple[bytes, bytes]]) -> dict[bytes, int]:
    """Default ids: byte values first, then one id per merge in rank order."""
    ids = {bytes([b]): b for b in range(256)}
    for a, b in merges:
        ids.setdefault(a + b, len(ids))
    return ids


def join_pairs(parts: list[int], pairs: Mapping[tuple[int, int], tuple[int, int, int, int]]) -> list[int]:
    """Join the best-ranked pair of neighbours wherever it occurs, until no pair is known.

    Places of pairs wait in a queue by rank and place, and pieces are linked to their neighbours, so
    a long word takes little more than linear time. All places of a rank are joined before the
    pairs that this makes are looked at.
    """
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    queue = [(pairs[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in pairs]
    heapq.heapify(queue)
    end = len(parts)
    while queue:
        rank, made = queue[0][0], []
        while queue and queue[0][0] == rank:
            i = heapq.heappop(queue)[1]
            j = after[i] if parts[i] >= 0 else end
            found = pairs.get((parts[i], parts[j])) if j < end else None
            if found is None or found[0] != rank:
                continue  # one of the two was joined meanwhile
            parts[i], parts[j] = found[3], -1
            after[i] = after[j]
            if after[j] < end:
                before[after[j]] = i
            made.append(i)
        for i in made:
            for a in {i, before[i]}:
                b = after[a] if a >= 0 and parts[a] >= 0 else end
                if b < end and (parts[a], parts[b]) in pairs:
                    heapq.heappush(queue, (pairs[parts[a], parts[b]][0], a))
    return [p for p in parts if p >= 0]


def bpe_encode(
    df: DataFrame,
    merges: Sequence[tuple[bytes, bytes]],
    ids: Mapping[bytes, int] | None = None,
    *,
    tok: str = "tok",
) -> DataFrame:
    """``tok`` (pre-tokens) becomes ``input_ids``."""
    if len(merges) > MAX_MERGES:
        raise ValueError(f"more than {MAX_MERGES} merges")
    # Pieces are numbered (bytes first) and a pair leads to (rank, left, right, joined piece).
    pieces = {bytes([b]): b for b in range(256)}
    pairs: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for rank, (a, b) in enumerate(merges):
        if a not in pieces or b not in pieces:
            raise ValueError(f"merge {rank} joins {a!r} and {b!r}, one of which is never made")
        left, right = pieces[a], pieces[b]
        joined = pieces.setdefault(a + b, len(pieces))
        pairs.setdefault((left, right), (rank, left, right, joined))
    wanted = dict(ids) if ids is not None else byte_vocab(merges)
    missing = [p for p in pieces if p not in wanted]
    if missing:
        raise ValueError(f"the vocabulary lacks {len(missing)} pieces, such as {missing[0]!r}")
    table = df.sparkSession.sparkContext.broadcast((pairs, [wanted[p] for p in pieces]))

    @F.arrow_udf("array<int>")
    def to_ids(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        pairs, numbers = table.value
        known: dict[str, bytes] = {}
        held = 0
        for col in (part for whole in columns for part in item_slices(whole)):
            coded = col.flatten().dictionary_encode()
            coded_words = []
            for word in coded.dictionary.to_pylist():
                made = known.get(word)
                if made is None:
                    pieces = join_pairs(list(word.encode("utf-8")), pairs)
                    made = np.array([numbers[p] for p in pieces], np.int32).tobytes()
                    size = len(made) + len(word) + 200
                    if held + size > KNOWN_BYTES:  # bounds the memory of a worker, not the result
                        known.clear()
                        held = 0
                    known[word] = made
                    held += size
                coded_words.append(made)
            sizes = np.fromiter((len(c) // 4 for c in coded_words), np.int64, len(coded_words))
            flat = np.frombuffer(b"".join(coded_words), np.int32)
            begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            at = np.asarray(coded.indices, dtype=np.int64)
            counts = sizes[at] if len(at) else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(counts)])
            # positions in flat: each occurrence walks through the ids of its word
            walk = np.arange(ends[-1]) - np.repeat(ends[:-1] - begins[at], counts)
            offsets = np.asarray(col.offsets)
            yield pa.ListArray.from_arrays(pa.array(ends[offsets - offsets[0]], pa.int32()), pa.array(flat[walk]))

    return df.withColumn("input_ids", once(to_ids)(tok)).drop(tok)
