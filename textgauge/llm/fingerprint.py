"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle whose hash lies below a fixed share of the hash range, so its size follows
the text's. The sketch of a union is the union of the sketches, and the share of one sketch found in
another estimates how much of one text stands in the other, however unequal their lengths.

Defined results: a null text counts as empty. Words are runs other than ASCII white space; a text of
fewer than ``k`` words is one shingle, a text without words none. A sketch may be empty; then two texts
are alike (1) if their words are the same, otherwise not (0). Extra columns are left out of the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from textgauge.llm.common import checked, column, saved, text_of

#: Words of a shingle, the share of hashes that is kept, and hexadecimal digits of a kept hash.
K, SHARE, DIGITS = 5, 0.25, 12


def sketched(df: DataFrame, text: str, name: str, k: int = K, share: float = SHARE) -> DataFrame:
    """``df`` with the struct column ``name``: n (shingles), words (hash of all words), hashes (sorted)."""
    limit = f"{min(int(share * (1 << 32)), (1 << 32) - 1):08x}"
    words, joined = f"{name}_words", f"{name}_joined"
    df = df.withColumn(joined, F.trim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")))
    df = df.withColumn(words, F.split(joined, " "))
    size = F.size(words)
    places = F.sequence(F.lit(0), F.greatest(size - k, F.lit(0)))
    hashes = F.transform(places, lambda i: F.md5(F.array_join(F.slice(F.col(words), i + 1, F.lit(k)), " ")))
    low = F.filter(hashes, lambda h: h <= limit if share >= 1 else h < limit)
    kept = F.array_sort(F.array_distinct(F.transform(low, lambda h: F.substring(h, 1, DIGITS))))
    some = F.col(joined) != ""
    made = F.struct(
        F.when(some, F.greatest(size - k, F.lit(0)) + 1).otherwise(0).cast("long").alias("n"),
        F.substring(F.md5(joined), 1, DIGITS).alias("words"),
        F.when(some, kept).otherwise(F.array().cast("array<string>")).alias("hashes"),
    )
    return df.withColumn(name, made).drop(words, joined)


def fingerprint(sketch: str) -> F.Column:
    """The sketch as a string: number of shingles, hash of all words, kept hashes."""
    s = F.col(sketch)
    return F.concat_ws(":", s["n"].cast("string"), s["words"], F.array_join(s["hashes"], ""))


def likeness(a: str, b: str) -> F.Column:
    """Estimated share of the smaller text's shingles that the other holds, from 0 to 1."""
    x, y = F.col(a), F.col(b)
    smaller = F.least(F.size(x["hashes"]), F.size(y["hashes"]))
    common = F.size(F.array_intersect(x["hashes"], y["hashes"]))
    said = F.when(x["words"] == y["words"], 1.0).when(smaller > 0, common / smaller)
    return F.coalesce(said, F.lit(0.0))


def merged(df: DataFrame, by: list[str], sketch: str) -> DataFrame:
    """Hashes of the union of the texts of each group, one row a group; combined before the shuffle."""
    rows = df.select(*by, F.explode_outer(F.col(sketch)["hashes"]).alias("hash")).distinct()
    return rows.groupBy(*by).agg(F.array_sort(F.collect_set("hash")).alias("hashes"))


def successors(keys: DataFrame) -> DataFrame:
    """(key, next, next_hash, cut): for each distinct key the next greater one; the last is followed by the first.

    ``keys`` holds key, hash and cut; the greatest cut and the least hash of a key are taken. Keys are dealt
    out by range; only the first key of each range meets in one task.
    """
    spark = keys.sparkSession
    each = keys.filter("key IS NOT NULL").groupBy("key").agg(F.max("cut").alias("cut"), F.min("hash").alias("hash"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = each.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id())
    ranged = saved(ranged, "ranges")
    firsts = ranged.groupBy("part").agg(F.min("key").alias("key"))
    firsts = firsts.join(ranged, ["part", "key"]).select("part", F.struct("key", "hash").alias("first"))
    order = Window.orderBy("part")  # a row for each range
    ring = firsts.select(
        "part", F.coalesce(F.lead("first").over(order), F.first("first").over(order)).alias("after")
    )
    ring = saved(ring, "range-heads")
    inside = F.lead(F.struct("key", "hash")).over(Window.partitionBy("part").orderBy("key"))
    found = ranged.withColumn("next", inside).join(checked(ring), "part")
    after = F.coalesce("next", "after")
    return found.select("key", "cut", after["key"].alias("next"), after["hash"].alias("next_hash"))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, share: float = SHARE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next text are.

    The edited text has its last quarter replaced by as much of the next text's start. The next text is
    that of the next greater key; of rows with one key, the text of least hash stands for it. Rows
    without a key have no next text: their edited text ends early, ``near_next`` is 0.

    Returns key, n_chars, edited, the two sketches, near_edited, near_next.
    """
    rows = docs.select(column(docs, key).alias("key"), text_of(docs, text).alias("text"))
    cut = F.floor(F.length("text") / 4).cast("int")
    ring = successors(rows.select("key", F.xxhash64("text").alias("hash"), cut.alias("cut")))
    ring = saved(ring, "successors")
    wanted = ring.select(F.col("key").alias("owner"), "cut", F.col("next").alias("key"), "next_hash")
    # both sides start with the same outer join, so that texts are dealt out by key once; the outer
    # generator keeps Spark from turning one of the two into another join
    placed = rows.join(wanted, "key", "left")
    stands = F.xxhash64("text") == F.col("next_hash")
    each = F.inline_outer(F.when(stands, F.array(F.struct("owner", "text", "cut"))))
    right = placed.select(each.alias("owner", "text", "cut")).filter("owner IS NOT NULL")
    right = sketched(right, "text", "next_sketch", k, share).select(
        F.col("owner").alias("key"),
        F.expr("substring(text, 1, cut)").alias("head"),
        F.col("next_sketch")["n"].alias("next_n"),
        F.col("next_sketch")["words"].alias("next_words"),
        F.unhex(F.array_join(F.col("next_sketch")["hashes"], "")).alias("next_hashes"),
    )
    rows = placed.select("key", "text")
    both = rows.join(right.dropDuplicates(["key"]), "key", "left").withColumn("n_chars", F.length("text").cast("long"))
    next_ = F.struct(F.col("next_n").alias("n"), F.col("next_words").alias("words"), _unpacked("next_hashes").alias("hashes"))
    both = both.withColumn("next_sketch", F.when(F.col("next_n").isNotNull(), next_))
    head = F.expr("substring(coalesce(head, ''), 1, int(floor(n_chars / 4)))")
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, int(n_chars - floor(n_chars / 4)))"), head))
    both = sketched(sketched(both, "text", "sketch", k, share), "edited", "edited_sketch", k, share)
    return both.select(
        F.col("key").alias(key),
        "n_chars",
        "edited",
        "sketch",
        "edited_sketch",
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
    )


def _unpacked(hashes: str) -> F.Column:
    """The kept hashes out of their bytes."""
    return F.regexp_extract_all(F.lower(F.hex(hashes)), F.lit(f"[0-9a-f]{{{DIGITS}}}"), F.lit(0))
