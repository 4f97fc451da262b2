"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

1. Every text becomes its set of word shingles and a signature; texts with equal sets form a class and
   go on as one.
2. Classes whose signatures agree on a band of four values meet in a bucket. With 32 bands, a pair at
   the threshold of 0.8 misses all buckets once in twenty million times.
3. In each bucket all members are compared with the first one only, which is linear in the bucket. Pairs
   whose signatures agree on less than ``threshold - SLACK`` of the values (over six
   standard deviations) are left out, the rest is confirmed on the full shingle sets. Union-find groups the links.
4. What is left are buckets that still hold several groups. Their members meet in blocks of bounded size
   and every pair from different groups is tried, again on the full sets; only links leave the task.

Only links that join groups are looked for: groups and representatives are complete, the list of all
similar pairs is not made.

Defined results: a text that is null or has no word links with nothing. Equal texts with words are one
group. A group is named by its least key; null keys are never names unless all keys of a group are null,
and then a row of a null key is kept. Of repeated rows with the least key one is kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from textgauge.llm.common import checked, column, cut_batches, fresh, saved
from textgauge.llm.components import components
from textgauge.llm.shingles import shingle_sets, superminhash

SLOTS, ROWS = 128, 4
#: Bytes of text whose sets and signatures are made together.
SLICE = 1_000_000
#: Signatures estimate a similarity of 0.8 with a standard deviation below 0.036.
SLACK = 0.22
#: Members and shingles of a block; a task holds two blocks.
BLOCK, BLOCK_SHINGLES = 512, 400_000


def sketch(docs: DataFrame, key: str, text: str, keep: tuple[str, ...], k: int) -> tuple[DataFrame, dict[str, str]]:
    """A written table of the kept columns and text with set size, digest of the set, signature, number."""
    kept = [column(docs, c) for c in dict.fromkeys((key, text, *keep))]
    base = docs.select(*kept)
    names = {}
    for c in ("text", "n", "digest", "sig", "rid"):
        names[c] = fresh(base, f"_{c}")
    held = base.columns
    at = held.index(text)

    def run(batches):
        for whole in batches:
            for batch in cut_batches(whole, at, SLICE):
                sets = shingle_sets([t or "" for t in batch.column(at).to_pylist()], k)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                sig = superminhash(sets, SLOTS)
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns,
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array([s.tobytes() for s in sig], pa.binary()),
                    ],
                    names=[*held, names["n"], names["digest"], names["sig"]],
                )

    new = [(names["n"], LongType()), (names["digest"], BinaryType()), (names["sig"], BinaryType())]
    schema = StructType(list(base.schema) + [StructField(*x) for x in new])
    made = base.mapInArrow(run, schema).withColumn(names["rid"], F.monotonically_increasing_id())
    return saved(made, "sketches"), names


def _similar(threshold: int):
    """Keeps pairs (a, b, text a, text b) whose sets share ``threshold`` hundredths of their union."""

    def run(batches, k):
        for whole in batches:
            for batch in cut_batches(whole, 2, SLICE):
                left = shingle_sets(batch.column(2).to_pylist(), k)
                right = shingle_sets(batch.column(3).to_pylist(), k)
                yes = pa.array([linked(x, y, threshold) for x, y in zip(left, right)], pa.bool_())
                yield batch.select([0, 1]).filter(yes)

    return run


def linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether 100 * intersection >= threshold * union, on sorted sets that are not empty."""
    common = np.intersect1d(x, y, assume_unique=True).size
    return common > 0 and 100 * common >= threshold * (len(x) + len(y) - common)


def _promising(threshold: int):
    """Keeps pairs (a, b, signature a, signature b) whose estimate is near the threshold or above."""

    def run(batches):
        for batch in batches:
            x, y = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, SLOTS) for i in (2, 3)
            )
            yes = (x == y).mean(axis=1) >= threshold / 100 - SLACK
            yield batch.select([0, 1]).filter(pa.array(yes))

    return run


def _blocks(threshold: int, k: int):
    """Links between different groups inside each (bucket, i, j), whose rows come one after another."""

    def links(group: list[tuple], band: int) -> list[tuple[int, int]]:
        ids, first, own = (np.array([g[c] for g in group]) for c in (0, 1, 2))
        two = group[0][4] != group[0][5]
        sets = shingle_sets([g[3] for g in group], k)
        sigs, sizes = superminhash(sets, SLOTS), np.array([len(s) for s in sets])
        found = []
        for a in range(len(group)):
            others = np.arange(a + 1, len(group))
            few, many = np.minimum(sizes[others], sizes[a]), np.maximum(sizes[others], sizes[a])
            yes = (own[others] != own[a]) & (100 * few >= threshold * many)
            if two:
                yes &= first[others] != first[a]
            others = others[yes]
            equal = sigs[others] == sigs[a]
            alike = equal.mean(axis=1)
            # a pair that shares several buckets is tried in that of its first band
            yes = equal.reshape(len(others), SLOTS // ROWS, ROWS).all(axis=2).argmax(axis=1) == band
            yes &= alike >= threshold / 100 - SLACK
            others = others[yes][np.argsort(-alike[yes], kind="stable")]
            while len(others):
                now, others = others[:32], others[32:]
                common = _common(sets[a], [sets[b] for b in now])
                yes = 100 * common >= threshold * (sizes[a] + sizes[now] - common)
                for b in now[yes]:
                    x, y = own[a], own[b]
                    if x != y:
                        own[own == max(x, y)] = min(x, y)
                        found.append((int(ids[a]), int(ids[b])))
                others = others[own[others] != own[a]]
        return found

    def run(batches):
        held, group = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in range(8)]
            out = []
            for bucket, i, j, cid, blk, comp, text, band in zip(*cols):
                if (bucket, i, j, band) != held:
                    out += links(group, held[3]) if len(group) > 1 else []
                    held, group = (bucket, i, j, band), []
                group.append((cid, blk, comp, text, i, j))
            yield _pairs(out)
        if len(group) > 1:
            yield _pairs(links(group, held[3]))

    return run


def _common(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with others, none of them empty."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    starts = np.cumsum([0, *map(len, others[:-1])])
    return np.add.reduceat((one[at] == flat).astype(np.int64), starts)


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
    k: int = 5,
    threshold: int = 80,
) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """The written sketch table, and for each of its rows: rid, id, n, component, kept."""
    table, names = sketch(docs, key, text, keep, k)
    rows = table.select(
        F.col(names["rid"]).alias("rid"),
        column(table, key).alias("id"),
        F.col(names["n"]).alias("n"),
        F.col(names["digest"]).alias("digest"),
        F.col(names["sig"]).alias("sig"),
    )
    classes = rows.filter("n > 0").groupBy("digest", "sig", "n").agg(F.min("rid").alias("cid"))
    classes = saved(classes, "classes")
    texts = table.select(F.col(names["rid"]).alias("cid"), column(table, text).alias("text"))
    width = 2 * ROWS
    places = F.sequence(F.lit(0), F.lit(SLOTS // ROWS - 1))
    slots = F.transform(places, lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * width + 1, F.lit(width))))
    bands = classes.select("cid", "n", F.posexplode(slots).alias("band", "bucket"))

    # every member against the first of its bucket
    heads = bands.groupBy("bucket").agg(F.min("cid").alias("head"), F.count("*").alias("size")).filter("size > 1")
    pairs = bands.join(heads, "bucket").filter("cid <> head").select("cid", "head").distinct()
    sigs = classes.select("cid", "n", "sig")
    pairs = pairs.join(sigs, "cid").join(sigs.toDF("head", "n2", "sig2"), "head")
    pairs = pairs.filter(f"100 * least(n, n2) >= {threshold} * greatest(n, n2)").select("cid", "head", "sig", "sig2")
    pairs = saved(pairs.mapInArrow(_promising(threshold), "cid long, head long"), "pairs")
    needed = saved(pairs.select("cid").union(pairs.select("head")).distinct(), "needed")
    said = texts.join(checked(needed), "cid", "left_semi")
    both = pairs.join(said, "cid").join(said.toDF("head", "text2"), "head").select("cid", "head", "text", "text2")
    confirm = _similar(threshold)
    links = saved(both.mapInArrow(lambda b: confirm(b, k), "a long, b long"), "star-links")
    group = components(links).withColumnRenamed("node", "cid")

    # buckets that still hold several groups, in blocks
    grouped = bands.join(group, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    open_ = (
        grouped.groupBy("bucket")
        .agg(F.count("*").alias("size"), F.sum("n").alias("all"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("band").alias("band"))
        .filter("size > 2 AND low < high")
        .selectExpr("bucket", "band", f"int(greatest(ceil(size / {BLOCK}), ceil(all / {BLOCK_SHINGLES}))) AS blocks")
    )
    open_ = saved(open_, "open-buckets")
    members = grouped.drop("band").join(checked(open_), "bucket").selectExpr(
        "bucket", "band", "cid", "comp", "pmod(xxhash64(cid), blocks) AS blk", "explode(sequence(0, blocks - 1)) AS other"
    )
    members = saved(
        members.selectExpr("bucket", "least(blk, other) AS i", "greatest(blk, other) AS j", "cid", "blk", "comp", "band"), "members"
    )
    left = saved(members.select("cid").distinct(), "left")
    said = texts.join(checked(left), "cid", "left_semi")
    placed = members.join(said, "cid").select("bucket", "i", "j", "cid", "blk", "comp", "text", "band")
    placed = placed.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "band", "cid")
    more = placed.mapInArrow(_blocks(threshold, k), "a long, b long")
    group = components(links.union(more)).withColumnRenamed("node", "cid")

    known = classes.select("digest", "cid").join(group, "cid", "left").select("digest", F.coalesce("comp", "cid").alias("comp"))
    grouped = rows.drop("sig").join(known, "digest", "left").withColumn("comp", F.when(F.col("n") > 0, F.col("comp")))
    grouped = saved(grouped.withColumn("comp", F.coalesce("comp", "rid")).drop("digest"), "grouped")
    first = grouped.groupBy("comp").agg(
        F.min("id").alias("component"), F.coalesce(F.min_by("rid", "id"), F.min("rid")).alias("first")
    )
    placed = grouped.join(first, "comp")
    return table, placed.select("rid", "id", "n", "component", (F.col("rid") == F.col("first")).alias("kept")), names


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group, with all columns of ``docs``."""
    table, placed, names = near_groups(docs, key, text, tuple(docs.columns), **options)
    gone = saved(placed.filter("not kept").select(F.col("rid").alias(names["rid"])), "near-copies")
    return table.join(checked(gone), names["rid"], "left_anti").select(*(column(table, c) for c in docs.columns))
