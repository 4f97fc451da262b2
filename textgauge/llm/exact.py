"""Exact dedup by content-defined chunk recipes.

A text is cut after the words whose hash falls below a share of the hash range, so that equal
passages give equal chunks wherever they stand. Each document becomes its recipe, the ordered list
of its chunk identifiers; documents with equal recipes have equal texts. Long texts move once, as
distinct chunks, to prove that an identifier names one chunk only; grouping moves 8 bytes a chunk.

Defined results: a null text counts as empty, empty texts equal each other, texts equal up to
white space runs are equal. Of equal texts the row with the smallest key stays; a null key loses to
any other, and of rows that share the smallest key one stays. Other columns are carried untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from textgauge.llm.common import checked, column, fresh, saved, text_of

#: ASCII white space.
SPACES = "[\\x20\\x09-\\x0D]+"


def chunks_of(words: F.Column, mean_words: int) -> F.Column:
    """Words (never null or empty as a list) joined to chunks that end after every marked word."""
    marks = F.array_compact(
        F.transform(words, lambda w, i: F.when(F.pmod(F.xxhash64(w), F.lit(mean_words)) == 0, i + 1))
    )
    ends = F.array_union(marks, F.array(F.size(words)))
    starts = F.concat(F.array(F.lit(0)), ends)
    spans = F.arrays_zip(ends.alias("e"), F.slice(starts, 1, F.size(ends)).alias("s"))
    return F.transform(
        spans, lambda x: F.array_join(F.slice(words, x["s"] + 1, x["e"] - x["s"]), " ")
    )


def chunked(df: DataFrame, text: F.Column, name: str, mean_words: int) -> DataFrame:
    """``df`` with the chunks of a text, white space runs made one blank, in the column ``name``."""
    words = fresh(df, "_words")
    df = df.withColumn(words, F.split(F.regexp_replace(text, SPACES, " "), " "))
    return df.withColumn(name, chunks_of(F.col(words), mean_words)).drop(words)


def recipes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
    mean_words: int = 128,
    identify: Callable[[F.Column], F.Column] = F.xxhash64,
) -> tuple[DataFrame, dict[str, str]]:
    """A written table of key, text and ``keep`` with row number, the text's SHA-256 and its recipe.

    Returns the table and the names given to the new columns. ``identify`` names a chunk; clashes
    are resolved, so that even a poor one gives right results.
    """
    base = docs.select(*(column(docs, c) for c in dict.fromkeys((key, text, *keep))))
    names = {c: fresh(base, f"_{c}") for c in ("rid", "sha", "chunks", "recipe")}
    said = text_of(base, text)
    made = base.withColumn(names["sha"], F.sha2(F.regexp_replace(said, SPACES, " "), 256))
    made = chunked(made, said, names["chunks"], mean_words)
    made = made.withColumn(names["recipe"], F.transform(names["chunks"], lambda c: identify(c))).drop(names["chunks"])
    return saved(made.withColumn(names["rid"], F.monotonically_increasing_id()), "recipes"), names


def _named_chunks(table: DataFrame, text: str, names: dict[str, str], mean_words: int) -> DataFrame:
    """(rid, text, recipe, chunks) of the written table, the chunks cut again from its texts."""
    rows = table.select(
        F.col(names["rid"]).alias("rid"), text_of(table, text).alias("text"), F.col(names["recipe"]).alias("recipe")
    )
    return chunked(rows, F.col("text"), "chunks", mean_words)


def _clashes(chunks: DataFrame) -> DataFrame:
    """The identifiers that name several chunks. Moves every distinct chunk once."""
    pairs = F.arrays_zip(F.col("recipe").alias("h"), F.col("chunks").alias("c"))
    distinct = chunks.select(F.explode(pairs).alias("x")).select("x.h", "x.c").distinct()
    return saved(distinct.groupBy("h").count().filter("count > 1").select("h"), "shared-ids")


def _marks(chunks: DataFrame, shared: DataFrame) -> DataFrame:
    """For rows with an identifier that names several chunks: which of them, by position."""
    pairs = F.arrays_zip(F.col("recipe").alias("h"), F.col("chunks").alias("c"))
    placed = chunks.select("rid", F.posexplode(pairs).alias("pos", "x")).select("rid", "pos", "x.h", "x.c")
    placed = placed.join(checked(shared), "h", "left_semi")
    number = placed.select("h", "c").distinct().withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("c")))
    marked = placed.join(number, ["h", "c"]).groupBy("rid")
    return marked.agg(F.sort_array(F.collect_list(F.struct("pos", "k"))).alias("marks"))


def exact_groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
    mean_words: int = 128,
    identify: Callable[[F.Column], F.Column] = F.xxhash64,
) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """The written recipe table, and for each of its rows the group: rid, id, sha, keep_id,
    group_size, kept."""
    table, names = recipes(docs, key, text, keep, mean_words, identify)
    chunks = _named_chunks(table, text, names, mean_words)
    shared = _clashes(chunks)
    kind = "array<struct<pos:int,k:int>>"
    narrow = table.select(
        F.col(names["rid"]).alias("rid"),
        column(table, key).alias("id"),
        F.col(names["sha"]).alias("sha"),
        F.col(names["recipe"]).alias("recipe"),
    )
    if shared.isEmpty():
        narrow = narrow.withColumn("marks", F.array().cast(kind))
    else:
        narrow = narrow.join(_marks(chunks, shared), "rid", "left")
        narrow = narrow.withColumn("marks", F.coalesce("marks", F.array().cast(kind)))
    groups = narrow.groupBy("recipe", "marks").agg(
        F.min("id").alias("keep_id"),
        F.count("*").alias("group_size"),
        F.coalesce(F.min_by("rid", "id"), F.min("rid")).alias("first"),
    )
    placed = narrow.join(groups, ["recipe", "marks"])
    return (
        table,
        placed.select("rid", "id", "sha", "keep_id", "group_size", (F.col("rid") == F.col("first")).alias("kept")),
        names,
    )


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per distinct text, with all columns of ``docs``."""
    table, placed, names = exact_groups(docs, key, text, tuple(docs.columns), **options)
    gone = saved(placed.filter("not kept").select(F.col("rid").alias(names["rid"])), "copies")
    return table.join(checked(gone), names["rid"], "left_anti").select(
        *(column(table, c) for c in docs.columns)
    )
