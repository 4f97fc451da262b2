"""Tokenization: text to ids and back, with lineage kept in ``doc_id``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textgauge.functions.tokens import byte_ids, byte_text, pretokens
from textgauge.session import written

# A vocabulary up to this many entries (of up to some dozens of bytes each) is sent to the
# executors; a longer one is joined instead.
BROADCAST_ENTRIES = 1_000_000

# The special token of byte-level BPE models, used as end and padding mark.
EOS = "<|endoftext|>"
UNK = "<unk>"


def pretokenize(df: DataFrame, lookahead: bool = True, text: str = "text") -> DataFrame:
    """Adds ``tok``, the lossless pre-token split."""
    return df.withColumn("tok", pretokens(F.col(text), lookahead))


def byte_tokenize(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the text by ``input_ids`` with byte values."""
    return df.withColumn("input_ids", byte_ids(F.col(text))).drop(text)


def byte_detokenize(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    return df.withColumn("text", byte_text(F.col(ids)))


def token_counts(df: DataFrame, tok: str = "tok") -> DataFrame:
    """``(token, count)``.

    The outer generator keeps the optimizer from testing the array for emptiness in a filter of
    its own, which would tokenize every text a second time.
    """
    words = df.select(F.explode_outer(tok).alias("token")).filter(F.col("token").isNotNull())
    return words.groupBy("token").count()


def build_vocab(
    df: DataFrame, size: int, specials: Sequence[str] = (UNK, EOS), tok: str = "tok"
) -> DataFrame:
    """``(id, token, count)``: special tokens first, then the ``size`` most frequent tokens.

    Equal counts go in token order. Counting combines inside each task before the shuffle, so
    a token that makes up a third of the corpus is one row per task. How often a token must
    occur at least is read off the counts of counts; only tokens above that enter the ranking,
    which at most ``size`` rows leave; one task gives those their ids. Distinct counts are few (below the square root of twice
    the corpus length), so ranking them in one task is safe.
    """
    if size < 1:
        raise ValueError(f"size must be at least 1, got {size}")
    counts = token_counts(df, tok)
    tiers = counts.groupBy("count").agg(F.count(F.lit(1)).alias("tokens"))
    above = F.sum("tokens").over(W.orderBy(F.desc("count"))) - F.col("tokens")
    needed = tiers.select("count", above.alias("above")).filter(F.col("above") < size)
    floor = needed.agg(F.min("count")).scalar()
    top = counts.filter(F.col("count") >= floor).orderBy(F.desc("count"), "token").limit(size)
    ranked = top.groupBy().agg(
        F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "token"))).alias("all")
    )
    learned = ranked.select(F.posexplode("all")).select(
        (F.col("pos") + len(specials)).alias("id"), "col.token", (-F.col("col.c")).alias("count")
    )
    if not specials:
        return learned
    named = [F.struct(F.lit(i).alias("id"), F.lit(s).alias("token")) for i, s in enumerate(specials)]
    fixed = df.sparkSession.range(1).select(F.inline(F.array(*named)))
    fixed = fixed.select("id", "token", F.lit(0).cast("long").alias("count"))
    return fixed.unionByName(learned)


@dataclass(frozen=True)
class Special:
    """Special tokens of a vocabulary; padding falls back to the end mark."""

    unk: str = UNK
    eos: str = EOS
    pad: str | None = None

    @property
    def padding(self) -> str:
        return self.eos if self.pad is None else self.pad


def vocab_report(vocab: DataFrame, special: Special = Special()) -> DataFrame:
    """One row: entries, and the ids of unknown, end and padding tokens."""

    def id_of(token: str) -> Column:
        return F.max(F.when(F.col("token") == token, F.col("id")))

    return vocab.agg(
        F.count(F.lit(1)).alias("vocab_size"),
        id_of(special.unk).alias("unk_id"),
        id_of(special.eos).alias("eos_id"),
        id_of(special.padding).alias("pad_id"),
    )


def once(udf):
    """Keeps the optimizer from repeating a costly UDF in every filter and use of its result.

    It copies deterministic expressions into filters it pushes down, Python calls included.
    Filter on other columns before encoding, as filters do not pass such a UDF.
    """
    return udf.asNondeterministic()


#: Items of a list column that a Python worker takes at once from an Arrow batch.
SLICE_ITEMS = 250_000


def item_slices(col: pa.ListArray, items: int = SLICE_ITEMS) -> Iterator[pa.ListArray]:
    """A list column in consecutive parts of about ``items`` items.

    Bounds what is made of a batch, whatever its size; a longer row is a part of its own.
    """
    import numpy as np

    ends = np.asarray(col.offsets)[1:]
    start, before = 0, int(col.offsets[0].as_py()) if len(col) else 0
    while start < len(col):
        stop = max(start + 1, int(np.searchsorted(ends, before + items, "right")))
        yield col.slice(start, stop - start)
        start, before = stop, int(ends[stop - 1])


def _fetch_vocab(vocab: DataFrame, limit: int) -> list | None:
    """Rows of a vocabulary within the limit, else None."""
    rows = vocab.select("id", "token").limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def encode(
    df: DataFrame,
    vocab: DataFrame,
    *,
    tok: str = "tok",
    key: str = "doc_id",
    unk: str = UNK,
    limit: int = BROADCAST_ENTRIES,
) -> DataFrame:
    """``tok`` becomes ``input_ids`` plus an ``attention_mask`` of ones.

    No truncation, no padding, no special tokens; a document without tokens keeps its row
    with empty arrays. A vocabulary within ``limit`` entries goes to every executor and the
    documents stay where they are; a longer one is joined, see :func:`encode_by_join`.
    """
    rows = _fetch_vocab(vocab, limit)
    if rows is None:
        return encode_by_join(df, vocab, tok=tok, key=key, unk=unk)
    ids = {r["token"]: r["id"] for r in rows}
    if unk not in ids:
        raise ValueError(f"the vocabulary has no entry {unk!r}")
    table = df.sparkSession.sparkContext.broadcast(ids)

    @F.arrow_udf("array<int>")
    def look_up(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        ids = table.value
        unknown = ids[unk]
        for col in (part for whole in columns for part in item_slices(whole)):
            # each distinct token of a part is looked up once
            words = col.flatten().dictionary_encode()
            found = np.array([ids.get(t, unknown) for t in words.dictionary.to_pylist()], np.int32)
            made = pa.array(found).take(words.indices).fill_null(unknown)
            offsets = np.asarray(col.offsets)
            yield pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), made)

    return _with_mask(df.withColumn("input_ids", once(look_up)(tok)).drop(tok))


def _with_mask(df: DataFrame) -> DataFrame:
    return df.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))


def encode_by_join(
    df: DataFrame,
    vocab: DataFrame,
    *,
    tok: str = "tok",
    key: str = "doc_id",
    unk: str = UNK,
    salts: int = 16,
) -> DataFrame:
    """The same for a vocabulary of any size, as a salted join.

    The vocabulary is repeated per salt. Each block of rows asks once for a token that it holds and picks
    the salt, so neither a frequent token nor a huge document makes a hot task.
    """
    unknown = vocab.filter(F.col("token") == unk).select("id").first()
    if unknown is None:
        raise ValueError(f"the vocabulary has no entry {unk!r}")
    entries = vocab.select("token", F.coalesce("id", F.lit(unknown["id"])).alias("value"))
    made = _by_position(df, tok, "token", entries, F.lit(unknown["id"]), salts, keep=False)
    return _with_mask(made.withColumn("input_ids", F.col("_made").cast("array<int>")).drop("_made"))


def _by_position(
    df: DataFrame, items: str, name: str, entries: DataFrame, other: Column, salts: int, keep: bool = True
) -> DataFrame:
    """Adds ``_made``: for each item of an array column its ``value`` in ``entries``, else ``other``, in place.

    Rows that lie together form a block, which numbers its distinct items; the rows with their numbers are
    written once. Only the distinct items meet the entries, under (item, salt), and come back as
    one array for each block, in which its rows look up their numbers. So what is shuffled is a number for each
    item, not a row. Several entries of an item give all their values, in order.
    """
    kind = df.schema[items].dataType.elementType.simpleString()

    @F.arrow_udf(f"struct<block:bigint,at:array<int>,words:array<{kind}>>")
    def number(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np
        from pyspark import TaskContext

        # holds once the rows are written
        block = TaskContext.get().partitionId() << 32
        for col in (part for whole in columns for part in item_slices(whole)):
            coded = col.flatten().dictionary_encode("encode")
            offsets = np.asarray(col.offsets)
            at = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), coded.indices.cast(pa.int32()))
            # the block's first row holds its items
            ends = np.full(len(col) + 1, len(coded.dictionary), np.int32)
            ends[0] = 0
            words = pa.ListArray.from_arrays(pa.array(ends), coded.dictionary)
            blocks = pa.array(np.full(len(col), block), pa.int64())
            yield pa.StructArray.from_arrays([blocks, at, words], names=["block", "at", "words"])
            block += 1

    marked = df.withColumn("_b", once(number)(items))
    parts = [F.col(f"_b.{c}").alias(f"_{c}") for c in ("block", "at", "words")]
    marked = marked.select("*", *parts).drop("_b", *(() if keep else (items,)))
    marked = written(marked, "numbered")
    asked = marked.filter(F.size("_words") > 0).select("_block", F.posexplode("_words").alias("_pos", name))
    asked = asked.withColumn("_salt", F.pmod("_block", F.lit(salts)).cast("int"))
    known = entries.groupBy(name).agg(F.array_sort(F.collect_set("value")).alias("_values"))
    copies = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    values = F.coalesce("_values", F.array(other))
    hits = asked.join(copies, [name, "_salt"], "left").select("_block", F.struct("_pos", values.alias("values")).alias("_hit"))
    found = hits.groupBy("_block").agg(F.array_sort(F.collect_list("_hit"))["values"].alias("_found"))
    rest = marked.drop("_words").join(found, "_block", "left")
    made = F.coalesce(F.flatten(F.transform("_at", lambda i: F.get("_found", i))), F.array())
    return rest.withColumn("_made", made).drop("_block", "_at", "_found")


def decode(
    df: DataFrame,
    vocab: DataFrame,
    *,
    ids: str = "input_ids",
    key: str = "doc_id",
    skip: Sequence[str] = (),
    limit: int = BROADCAST_ENTRIES,
) -> DataFrame:
    """Adds ``text``: the tokens of ``ids`` joined; tokens named in ``skip`` are left out.

    Ids without an entry give nothing. A vocabulary beyond ``limit`` entries is joined, see
    :func:`decode_by_join`; the rows are the same.
    """
    rows = _fetch_vocab(vocab, limit)
    if rows is None:
        return decode_by_join(df, vocab, ids=ids, key=key, skip=skip)
    table = df.sparkSession.sparkContext.broadcast(
        {r["id"]: "" if r["token"] in skip else r["token"] for r in rows}
    )

    @F.arrow_udf("array<string>")
    def look_up(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        names = table.value
        for col in (part for whole in columns for part in item_slices(whole)):
            numbers = col.flatten().dictionary_encode()
            found = pa.array([names.get(i) for i in numbers.dictionary.to_pylist()], pa.string())
            offsets = np.asarray(col.offsets)
            yield pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), found.take(numbers.indices))

    return df.withColumn("text", F.array_join(once(look_up)(ids), ""))


def decode_by_join(
    df: DataFrame,
    vocab: DataFrame,
    *,
    ids: str = "input_ids",
    key: str = "doc_id",
    skip: Sequence[str] = (),
    salts: int = 16,
) -> DataFrame:
    """The same for a vocabulary of any size, as a salted join."""
    shown = vocab.filter(~F.col("token").isin(*skip)) if skip else vocab
    entries = shown.select("id", F.coalesce("token", F.lit("")).alias("value"))
    made = _by_position(df, ids, "id", entries, F.lit(""), salts)
    return made.withColumn("text", F.array_join(F.col("_made").cast("array<string>"), "")).drop("_made")


def token_profile(df: DataFrame, length: Column, short: int, by: Sequence[str] = ()) -> DataFrame:
    """Documents, tokens, mean and exact quartiles of the length, share of short documents.

    Lengths are counted first, so that the quantiles weigh distinct lengths instead of
    gathering one value per document.
    """
    sizes = df.select(*by, length.cast("long").alias("len")).groupBy(*by, "len").count()

    def quantile(q: float) -> Column:
        return F.percentile("len", F.lit(q), F.col("count"))

    docs = F.sum("count")
    return sizes.groupBy(*by).agg(
        docs.alias("docs"),
        F.sum(F.col("len") * F.col("count")).alias("tokens"),
        (F.sum(F.col("len") * F.col("count")) / docs).alias("mean_len"),
        quantile(0.25).alias("q25"),
        quantile(0.5).alias("median"),
        quantile(0.75).alias("q75"),
        F.max("len").alias("max_len"),
        (F.sum(F.when(F.col("len") < short, F.col("count")).otherwise(0)) / docs).alias(
            "short_share"
        ),
    )
