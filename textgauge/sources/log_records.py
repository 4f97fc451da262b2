"""Whole records out of run logs: a line of the known shape and the lines that follow it, such as a traceback.

Files are read in splits, and a record may begin in one and end in another. Lines are put together inside their
split first, in one shuffle by split; what a split holds before its first record belongs to the last record
of the splits before it, in the same file or in the rotated part before. That carry is worked out on one narrow row for
each split, so only the few records at borders are moved again.

Defined results: every line is in exactly one record. Lines before the first record of a run make a record
without fields. Empty lines count. A carriage return before a line break is not part of a line. A record of over
``PIECE_BYTES`` is given in consecutive pieces, the fields with the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from textgauge.functions.text import strip_ansi
from textgauge.session import written
from textgauge.sources.run_logs import LINE, parse_file_name, parse_lines

# Fixed value: a rotated part ends with a number, the oldest with the largest.
ROTATED = r"^(.*\.log)\.(\d+)$"
PIECE_BYTES = 64_000_000
RUN_FILE = r"_\d{4}-\d\d-\d\d_\d{6}(?:\.log)?$"


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, path, source, part, block, at)`` of every line below ``path``.

    ``source`` names the files that follow each other: all parts of a rotated log, all files in a run's folder. ``part``
    is the number of a rotated part, 0 for the current one. ``at`` orders the lines of a split, which starts at byte ``block``.
    """
    lines = spark.read.format("text").option("recursiveFileLookup", "true").option("lineSep", "\n").load(path)
    file = F.col("_metadata.file_path")
    rows = lines.select(
        "value", file.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )
    whole = F.regexp_replace("path", ROTATED, "$1")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    source = F.when(whole.rlike(RUN_FILE), whole).when(F.url_decode(folder).rlike(RUN_FILE), folder).otherwise(F.col("path"))
    number = F.regexp_extract("path", ROTATED, 2).try_cast("int")
    return rows.select("value", "path", source.alias("source"), F.coalesce(number, F.lit(0)).alias("part"), "block", "at")


def assemble(lines: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``(source, part, path, offset, piece, lines, head, body)`` of every record of lines as :func:`read_log_lines` gives them.

    ``offset`` is the byte of the file at which the record, or the piece, starts; ``head`` its first line, NULL without one;
    ``body`` the lines after it, NULL if there are none. Colour codes are taken out.
    """
    in_split = W.partitionBy("path", "block").orderBy("at")
    before = in_split.rowsBetween(W.unboundedPreceding, -1)
    size = F.octet_length("value") + 1
    clean = strip_ansi(F.regexp_replace("value", "\r\\z", ""))
    placed = lines.select("source", "part", "path", "block", "at", size.cast("long").alias("bytes"), clean.alias("value"))
    placed = placed.withColumn("is_head", F.col("value").rlike(LINE))
    placed = placed.select(
        "*",
        F.sum(F.col("is_head").cast("long")).over(in_split).alias("rec"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("skip"),
    )
    # partitioned by split already: no further shuffle
    part = placed.groupBy("source", "part", "path", "block", "rec").agg(
        F.min("skip").alias("skip"),
        F.sum("bytes").alias("bytes"),
        F.count(F.lit(1)).alias("lines"),
        F.max(F.when(F.col("is_head"), F.col("value"))).alias("head"),
        F.sort_array(F.collect_list(F.when(~F.col("is_head"), F.struct("at", "value")))).alias("rest"),
    )
    rest = F.when(F.size("rest") > 0, F.array_join(F.transform("rest", lambda x: x["value"]), "\n"))
    part = written(part.withColumn("body", rest).drop("rest"), "log-parts")

    # one narrow row for each split: bytes before it, and the record that its first lines go on with
    lead = F.sum(F.when(F.col("rec") == 0, F.col("bytes")).otherwise(0)).alias("lead")
    splits = part.groupBy("source", "part", "path", "block").agg(F.sum("bytes").alias("bytes"), F.max("rec").alias("last"), lead)
    in_file = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    order = [F.desc("part"), "path", "block"]
    in_run = W.partitionBy("source").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    last = F.when(F.col("last") > 0, F.struct("path", "block", F.col("last").alias("rec")))
    splits = splits.select(
        "source", "part", "path", "block", "lead",
        F.coalesce(F.sum("bytes").over(in_file), F.lit(0)).alias("start"),
        F.last(last, ignorenulls=True).over(in_run).alias("goes_on"),
        F.row_number().over(W.partitionBy("source").orderBy(*order)).alias("turn"),
    )
    so_far = W.partitionBy("source", "goes_on").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("piece", F.floor(F.coalesce(F.sum("lead").over(so_far), F.lit(0)) / piece_bytes))
    splits = written(splits.drop("lead"), "log-splits")

    placed = part.join(splits, ["source", "part", "path", "block"])
    own = F.struct("path", "block", "rec")
    named = placed.select(
        "source", "part", "path", (F.col("start") + F.col("skip")).alias("offset"), "lines", "head", "body", "turn",
        F.when(F.col("rec") == 0, F.col("piece")).otherwise(0).alias("piece"),
        F.when((F.col("rec") == 0) & F.col("goes_on").isNotNull(), F.col("goes_on"))
        .when(F.col("rec") == 0, F.struct(F.lit("").alias("path"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("rec")))
        .otherwise(own).alias("record"),
        (F.col("rec") == 0).alias("carried"),
    )
    named = written(named, "log-records")
    # records that go on in another split meet their first part; all others stay where they are
    border = named.filter("carried").select("source", "record").distinct()
    alone = named.join(border, ["source", "record"], "left_anti")
    met = named.join(border, ["source", "record"], "left_semi").groupBy("source", "record", "piece").agg(
        F.min(F.struct("turn", "offset", "part", "path")).alias("first"),
        F.sum("lines").alias("lines"),
        F.max("head").alias("head"),
        F.sort_array(F.collect_list(F.when(F.col("body").isNotNull(), F.struct("turn", "offset", "body")))).alias("bodies"),
    )
    bodies = F.when(F.size("bodies") > 0, F.array_join(F.transform("bodies", lambda x: x["body"]), "\n"))
    columns = ("source", "part", "path", "offset", "piece", "lines", "head", "body")
    met = met.select("source", "first.part", "first.path", "first.offset", "piece", "lines", "head", bodies.alias("body"))
    return alone.select(*columns).unionByName(met.select(*columns))


def read_log_records(spark: SparkSession, path: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """All records below ``path``: experiment and run_start, place, the six fields and the following lines as ``body``.

    ``ORDER BY part DESC, path, offset`` gives the records of a run in the order in which they were written.
    """
    made = assemble(read_log_lines(spark, path), piece_bytes)
    keep = ("experiment", "run_start", "part", "path", "offset", "piece", "lines", "body")
    named = made.select("*", *parse_file_name(F.col("path"))).select(*keep, "head")
    parsed = parse_lines(named.filter(F.col("head").isNotNull()), line="head", keep=keep)
    none = [F.lit(None).cast(parsed.schema[c].dataType).alias(c) for c in parsed.columns if c not in keep]
    return parsed.unionByName(named.filter(F.col("head").isNull()).select(*keep, *none))
