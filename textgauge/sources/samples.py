"""Generated samples as JSON lines, and prompt banks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SAMPLE_SCHEMA = "task_id string, sample_idx int, completion string"

# The default prompt bank.
DEFAULT_PROMPTS = (
    'def fibonacci(n: int) -> list[int]:\n    """Return the first n Fibonacci numbers."""\n',
    'def remove_duplicates(items: list) -> list:\n    """Return a new list with duplicates removed, preserving order."""\n',
    'def binary_search(arr: list[int], target: int) -> int:\n    """Return index of target in sorted arr, or -1 if not found."""\n',
    'def reverse_words(sentence: str) -> str:\n    """Reverse the order of words in the sentence."""\n',
    'def is_palindrome(s: str) -> bool:\n    """Check whether s reads the same forwards and backwards, ignoring case and punctuation."""\n',
    'def factorial(n: int) -> int:\n    """Compute n! recursively."""\n',
    'def flatten(nested: list) -> list:\n    """Flatten a nested list of arbitrary depth into a flat list."""\n',
    'class Counter:\n    """A simple counter that can be incremented, decremented, and reset."""\n\n    def __init__(self, start: int = 0) -> None:\n',
    'class Stack:\n    """A LIFO stack with push, pop, and peek operations."""\n\n    def __init__(self) -> None:\n',
    'def read_lines(filename: str) -> list[str]:\n    """Read all lines from a file and return them as a list, stripping whitespace."""\n',
    'def chunked(iterable, size: int):\n    """Yield successive chunks of the given size from the iterable."""\n',
    'def safe_divide(a: float, b: float) -> float:\n    """Divide a by b, returning 0.0 if b is zero."""\n',
    'def square_even(numbers: list[int]) -> list[int]:\n    """Square every even number in the list."""\n',
    'def group_by_first_letter(words: list[str]) -> dict[str, list[str]]:\n    """Group words by their first letter."""\n',
    'def count_lines_in_file(filepath: str) -> int:\n    """Count the number of lines in a text file."""\n',
)


def write_samples(df: DataFrame, path: str) -> None:
    """One JSON object per line; ``sample_idx`` is kept because files have no row order."""
    (
        df.select(F.col("task_id").cast("string"), F.col("sample_idx").cast("int"), "completion")
        .write.mode("errorifexists")
        .json(path)
    )


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLE_SCHEMA).json(path)


def read_prompts(
    spark: SparkSession, path: str | None = None, *, lines: bool = False
) -> DataFrame:
    """``(bank, prompt_id, prompt)`` from JSON arrays of bare strings.

    One array per file, which may span lines; with ``lines=True`` one array per line, for banks
    that should be read in parallel. ``bank`` is the file name and ``prompt_id`` the position in
    the array. Without a path: the default bank.
    """
    if path is None:
        rows = [("default", i, p) for i, p in enumerate(DEFAULT_PROMPTS)]
        return spark.createDataFrame(rows, "bank string, prompt_id int, prompt string")
    raw = spark.read.text(path, wholetext=not lines)
    name = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    return raw.select(
        name.alias("bank"), F.posexplode(F.from_json("value", "array<string>"))
    ).toDF("bank", "prompt_id", "prompt")
