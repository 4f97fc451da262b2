"""Token ids as raw binary shards, with a minimal perfect hash index for keyed access.

Layout of a folder (any store that pyarrow.fs and all executors reach):

* ``ids/<shard>-<attempt>.bin``: the ids of consecutive documents in ascending key order, little-endian,
  two bytes each if the vocabulary fits, else four; nothing between documents.
* ``ids/<shard>-<attempt>.off``: for each document of the shard the number of ids before it, and the
  total, as little-endian 64-bit integers.
* ``index/<part>-<attempt>.mph``: a minimal perfect hash over the keys of one hash part, and for each
  slot the key's fingerprint, its first document's number and how many documents share the key.
* ``shards``, ``parts``: Parquet lists of the committed files. Files of failed attempts are not listed.

A lookup hashes the key to its part, walks the levels of bits (constant on average) to a slot, compares
the fingerprint, and reads one range of a payload.

Defined results: a null text counts as empty, so its document holds the end id only. Documents with
equal keys stand next to each other, ordered by a hash of their texts, and a lookup returns all of them; a null
key is a key of its own and stands first. A key that is not stored gives no row. An empty table gives
a folder with empty lists.
"""

from __future__ import annotations

import os
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from textgauge.llm.common import column, cut_batches, saved, text_of
from textgauge.session import shared_dir

#: Distinct words whose ids a Python worker remembers between batches.
WORDS = 1_500_000
#: Keys of one index part.
PART_KEYS = 1 << 18
#: Bits per key in each level of the hash.
GAMMA = 2.0
#: Adjacent documents are read together in ranges up to so many bytes.
RANGE_BYTES = 8_000_000


# --- encoding ---------------------------------------------------------------------------------


class WordEncoder:
    """Encodes texts with the tokenizers library, each distinct word once.

    Only for tokenizers that drop white space and never join across it. Words are cut at ASCII white
    space, so all that the tokenizer does to a word it does to the word alone.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.words: dict[bytes, bytes] = {}
        special = (t for t in self.tokenizer.get_added_tokens_decoder().values() if t.special and not t.normalized)
        self.mark = next((t.content for t in special if t.content[0] == "<" and not (t.lstrip or t.rstrip)), None)

    def _remember(self, words: list[bytes]) -> None:
        """Encode words in one text with a special token between them, at which the ids are cut."""
        text = self.mark.join(w.decode("utf-8") for w in words)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
        cuts = np.flatnonzero(ids == self.tokenizer.token_to_id(self.mark))
        data, size = ids.tobytes(), self.kind.itemsize
        starts = (np.concatenate([[0], cuts + 1]) * size).tolist()
        stops = (np.concatenate([cuts, [len(ids)]]) * size).tolist()
        self.words.update(zip(words, (data[a:b] for a, b in zip(starts, stops, strict=True)), strict=True))

    def __call__(self, texts: list[str], end: int) -> list[bytes]:
        """The ids of each text and the end id, as bytes."""
        split = [t.encode("utf-8").split() for t in texts]
        new = list({w for words in split for w in words if w not in self.words})
        if len(self.words) + len(new) > WORDS:
            self.words = {}
            new = list({w for words in split for w in words})
        plain = [w for w in new if b"<" not in w] if self.mark else []
        for k in range(0, len(plain), 4096):
            self._remember(plain[k : k + 4096])
        alone = [w for w in new if w not in self.words]
        coded = self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in alone], add_special_tokens=False)
        self.words.update((w, np.array(c.ids, self.kind).tobytes()) for w, c in zip(alone, coded))
        last = np.array([end], self.kind).tobytes()
        return [b"".join([*map(self.words.__getitem__, words), last]) for words in split]


@lru_cache(maxsize=1)
def _encoder(name: str) -> WordEncoder:
    return WordEncoder(SparkFiles.get(name))


# --- minimal perfect hash ---------------------------------------------------------------------


def _mix(h: np.ndarray, g: np.ndarray, level: int) -> np.ndarray:
    x = h ^ (g * np.uint64(2 * level + 1) + np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_hash(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the levels and all their bits: a key sets the bit of the first level it has alone."""
    sizes, levels = [], []
    while len(h):
        if len(sizes) == 200:
            raise ValueError("keys repeat, or hash alike in 128 bits")
        size = -(-max(64, int(GAMMA * len(h))) // 64) * 64
        at = (_mix(h, g, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        rest = ~alone[at]
        h, g = h[rest], g[rest]
    bits = np.concatenate(levels) if levels else np.zeros(0, bool)
    return np.array(sizes, np.int64), np.packbits(bits, bitorder="little").view("<u8")


def find_slots(sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 for some of those that are not stored. ranks: bits set before each word."""
    slots = np.full(len(h), -1, np.int64)
    ask, base = np.arange(len(h)), 0
    for level, size in enumerate(sizes):
        at = (_mix(h[ask], g[ask], level) % np.uint64(size)).astype(np.int64) + base
        word, bit = words[at >> 6], (at & 63).astype(np.uint64)
        hit = (word >> bit) & np.uint64(1) == 1
        below = word & ((np.uint64(1) << bit) - np.uint64(1))
        slots[ask[hit]] = ranks[at[hit] >> 6] + np.bitwise_count(below[hit])
        ask, base = ask[~hit], base + size
        if not len(ask):
            break
    return slots


def pack_index(h: np.ndarray, g: np.ndarray, first: np.ndarray, count: np.ndarray) -> bytes:
    """One index part: header, level sizes, bits, ranks, then fingerprint, first and count by slot."""
    sizes, words = build_hash(h, g)
    ranks = np.cumsum(np.bitwise_count(words).astype(np.int64)) - np.bitwise_count(words)
    slots = find_slots(sizes, words, ranks, h, g)
    by_slot = np.empty((3, len(h)), np.int64)
    by_slot[:, slots] = g.view(np.int64), first, count
    head = np.array([len(h), len(sizes), len(words)], np.int64)
    return b"".join(a.astype("<i8" if a.dtype != np.uint64 else "<u8").tobytes() for a in (head, sizes, words, ranks, by_slot))


def search_index(data: bytes, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First document and count of each key; the count is 0 where the fingerprint differs."""
    n, levels, width = np.frombuffer(data, "<i8", 3)
    rest = np.frombuffer(data, "<i8", offset=24)
    sizes, words, ranks, by_slot = np.split(rest, np.cumsum([levels, width, width]))
    by_slot = by_slot.reshape(3, n)
    slots = find_slots(sizes, words.view("<u8"), ranks, h, g)
    there = slots >= 0
    there[there] = by_slot[0, slots[there]] == g.view(np.int64)[there]
    first, count = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    first[there], count[there] = by_slot[1, slots[there]], by_slot[2, slots[there]]
    return first, count


# --- files ------------------------------------------------------------------------------------


def _open_store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _commit(folder: str, name: str, write) -> None:
    """Write under a name that no other attempt uses; a reader sees listed names only."""
    store, root = _open_store(folder)
    store.create_dir(os.path.dirname(f"{root}/{name}"), recursive=True)
    with store.open_output_stream(f"{root}/{name}") as out:
        write(out)


def _keyed(df: DataFrame, key: str, parts: int) -> DataFrame:
    """With two hashes of the key and the part of the index that holds it."""
    said, is_null = F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(key).isNull()
    return df.withColumns({"h": F.xxhash64(said, is_null), "g": F.xxhash64(is_null, said, F.lit("g"))}).withColumn(
        "part", F.pmod("h", F.lit(parts)).cast("int")
    )


def write_tokens(
    docs: DataFrame, path: str, folder: str, end: int = 1, key: str = "doc_id", text: str = "text"
) -> None:
    """Encode every text with the tokenizer file ``path`` and write shards and index to ``folder``."""
    spark = docs.sparkSession
    spark.sparkContext.addFile(path)
    tokenizer = path.rsplit("/", 1)[-1]
    width = WordEncoder(path).kind.itemsize
    order = (F.col("key"), F.xxhash64("text"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(column(docs, key).alias("key"), text_of(docs, text).alias("text"))
    texts = texts.repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def write(batches):
        name = f"ids/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        store, root = _open_store(folder)
        store.create_dir(f"{root}/ids", recursive=True)
        encode, sizes, row = _encoder(tokenizer), [], 0
        with store.open_output_stream(f"{root}/{name}.bin") as out:
            for batch in (part for whole in batches for part in cut_batches(whole, 1)):
                n = batch.num_rows
                ids = encode(batch.column(1).to_pylist(), end)
                each = np.fromiter(map(len, ids), np.int64, n)
                for x in ids:
                    out.write(x)
                sizes.append(each // width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([name] * n), pa.array(np.arange(row, row + n)), pa.array(each // width)],
                    names=["key", "file", "row", "n"],
                )
                row += n
        offsets = np.cumsum(np.concatenate([[0], *sizes]))
        _commit(folder, f"{name}.off", lambda out: out.write(offsets.astype("<i8").tobytes()))

    kinds = [("file", StringType()), ("row", LongType()), ("n", LongType())]
    schema = StructType([StructField("key", docs.schema[key].dataType)] + [StructField(*k) for k in kinds])
    entries = saved(texts.mapInArrow(write, schema), "entries")

    each = entries.groupBy("file").agg(F.count("*").alias("docs"), F.sum("n").alias("ids"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    listed = each.select(
        "file",
        "docs",
        "ids",
        F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("first"),
        F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"),
        F.lit(width).alias("width"),
    )
    listed.coalesce(1).write.parquet(f"{folder}/shards")
    listed = spark.read.parquet(f"{folder}/shards")

    total = listed.agg(F.sum("docs")).first()[0] or 0
    parts = max(1, -(-total // PART_KEYS))
    keys = (
        entries.join(listed.select("file", "first"), "file")
        .groupBy("key")
        .agg(F.min(F.col("first") + F.col("row")).alias("first"), F.count("*").alias("count"))
    )

    def index(pdf):
        import pandas as pd

        name = f"index/{pdf['part'].iloc[0]:06d}-{uuid.uuid4().hex}.mph"
        h, g = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("h", "g"))
        data = pack_index(h, g, pdf["first"].to_numpy(np.int64), pdf["count"].to_numpy(np.int64))
        _commit(folder, name, lambda out: out.write(data))
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "file": [name], "keys": [len(pdf)], "parts": [parts]})

    _keyed(keys, "key", parts).select("part", "h", "g", "first", "count").groupBy("part").applyInPandas(
        index, "part int, file string, keys long, parts long"
    ).write.parquet(f"{folder}/parts")


def read_tokens(spark: SparkSession, folder: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids) of the stored documents that have one of the keys, by the index.

    ``start`` counts the ids of all documents before; ``ids`` are little-endian 32-bit bytes. A key
    that is asked for several times answers each time.
    """
    shards = spark.read.parquet(f"{folder}/shards").orderBy("first").collect()  # a row for each file
    parts = {r.part: (r.file, r.parts) for r in spark.read.parquet(f"{folder}/parts").collect()}
    n_parts = next(iter(parts.values()))[1] if parts else 1
    files = {k: v[0] for k, v in parts.items()}
    kind = keys.schema[key].dataType
    asked = _keyed(keys.select(column(keys, key).alias("key")), "key", n_parts)

    def find(batches):
        held, data = -1, b""
        for batch in batches:
            part, h, g = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            first, count = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
            for p in np.unique(part):
                if p not in files:
                    continue
                if p != held:
                    store, root = _open_store(folder)
                    with store.open_input_file(f"{root}/{files[p]}") as f:
                        held, data = p, f.read()
                own = part == p
                first[own], count[own] = search_index(data, h[own].view(np.uint64), g[own].view(np.uint64))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(first), pa.array(count)], names=["key", "first", "count"])
            yield out.filter(pa.array(count > 0))

    schema = StructType([StructField("key", kind), StructField("first", LongType()), StructField("count", LongType())])
    found = asked.select("key", "part", "h", "g").repartition("part", "h").sortWithinPartitions("part").mapInArrow(find, schema)
    blocks = found.select("key", "first", "count", F.explode(F.expr("sequence(0, (count - 1) div 1024)")).alias("b"))
    rows = blocks.select(
        "key", F.explode(F.expr("sequence(first + b * 1024, first + least(count, (b + 1) * 1024) - 1)")).alias("row")
    )
    rows = saved(rows, "found").repartitionByRange("row").sortWithinPartitions("row")
    firsts = np.array([s["first"] for s in shards], np.int64)
    table = [(s["file"], s["start"], s["width"]) for s in shards]

    def read(batches):
        store, root = _open_store(folder)
        held, offsets = -1, None
        for batch in batches:
            row = batch.column(1).to_numpy(zero_copy_only=False)
            shard = np.searchsorted(firsts, row, "right") - 1
            at = 0
            while at < len(row):
                s = shard[at]
                name, start, width = table[s]
                if s != held:
                    with store.open_input_file(f"{root}/{name}.off") as f:
                        held, offsets = s, np.frombuffer(f.read(), "<i8")
                own = row - firsts[s]
                # rows up to the end of a range of neighbours in this shard
                stop = at + 1
                low = offsets[own[at]] * width
                while (
                    stop < len(row)
                    and shard[stop] == s
                    and own[stop] - own[stop - 1] <= 1
                    and offsets[own[stop] + 1] * width - low <= RANGE_BYTES
                ):
                    stop += 1
                with store.open_input_file(f"{root}/{name}.bin") as f:
                    f.seek(int(low))
                    data = f.read(int(offsets[own[stop - 1] + 1] * width - low))
                cut = [(offsets[o] * width - low, offsets[o + 1] * width - low) for o in own[at:stop]]
                ids = [np.frombuffer(data[a:b], f"<u{width}").astype("<u4").tobytes() for a, b in cut]
                begin = offsets[own[at:stop]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, stop - at),
                        pa.array(start + begin),
                        pa.array(offsets[own[at:stop] + 1] - begin),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["key", "start", "n_tokens", "ids"],
                )
                at = stop

    schema = StructType(
        [StructField("key", kind), StructField("start", LongType()), StructField("n_tokens", LongType()), StructField("ids", BinaryType())]
    )
    return rows.mapInArrow(read, schema).withColumnRenamed("key", key)


def token_folder(spark: SparkSession) -> str:
    return shared_dir(spark, "tokens")
