"""Run logs: ``time | LEVEL | logger | file:line | message`` lines, batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from textgauge.functions.text import strip_ansi

# The shape of a line and of a file name. A rotated part ends with .1, .2, ...
LINE = r"(?s)\A\d{4}-\d\d-\d\d \d\d:\d\d:\d\d \| \w+ *\| \S+ *\| [^:|]+:\d+ \| .*\z"
SEPARATOR = r" \| "
FILE_NAME = r"([^/=]+)_(\d{4}-\d\d-\d\d_\d{6})(?:\.log(?:\.\d+)?)?$"
LINE_TIME = "yyyy-MM-dd HH:mm:ss"
FILE_TIME = "yyyy-MM-dd_HHmmss"


def parse_lines(
    df: DataFrame,
    line: str = "value",
    keep: tuple[str, ...] = (),
    seen: Observation | None = None,
) -> DataFrame:
    """Six typed fields per line; lines of another shape (a traceback, say) are left out.

    ``seen`` gets ``lines`` and ``other_lines``, the number of all lines and of those left out.

    Colour codes are taken out first: levels and messages of warnings carry them. The message
    may itself hold the separator, so a line is split into five parts at most. Cleaning, check
    and split sit in one generator, which Spark runs once per line instead of once per field.
    """
    clean = F.array(strip_ansi(F.col(line)))
    parts = F.transform(clean, lambda text: F.when(text.rlike(LINE), F.split(text, SEPARATOR, 5)))
    cut = df.select(*keep, F.explode(parts).alias("_p"))
    if seen is not None:
        other = F.count_if(F.col("_p").isNull())
        cut = cut.observe(seen, F.count(F.lit(1)).alias("lines"), other.alias("other_lines"))
    cut = cut.filter(F.col("_p").isNotNull())

    def part(i: int) -> Column:
        return F.get("_p", F.lit(i))

    return cut.select(
        *keep,
        F.try_to_timestamp(part(0), F.lit(LINE_TIME)).alias("ts"),
        F.rtrim(part(1)).alias("level"),
        F.rtrim(part(2)).alias("logger"),
        F.substring_index(part(3), ":", 1).alias("file"),
        F.substring_index(part(3), ":", -1).cast("int").alias("line"),
        part(4).alias("message"),
    )


def parse_file_name(path: Column) -> list[Column]:
    """Experiment and start time from a file name, or from a run folder around part files."""
    base = F.substring_index(path, "/", -1)
    folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    name = F.url_decode(F.when(base.rlike(FILE_NAME), base).otherwise(folder))
    return [
        F.regexp_extract(name, FILE_NAME, 1).alias("experiment"),
        F.try_to_timestamp(F.regexp_extract(name, FILE_NAME, 2), F.lit(FILE_TIME)).alias(
            "run_start"
        ),
    ]


def read_run_logs(
    spark: SparkSession, path: str, *, stream: bool = False, max_files: int | None = None
) -> DataFrame:
    """All log files below ``path``: the six fields plus ``experiment`` and ``run_start``.

    As a stream, ``max_files`` bounds how many new files a micro-batch takes.
    """
    reader = spark.readStream.schema("value string") if stream else spark.read
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    raw = reader.format("text").option("recursiveFileLookup", "true").load(path)
    named = raw.select("value", *parse_file_name(F.col("_metadata.file_path")))
    return parse_lines(named, keep=("experiment", "run_start"))
