"""Truncation, escaping and formatting of generated text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# Marks at which a completion ends.
STOPS = ("\ndef ", "\nclass ", "\nif __name__")
BLOCK_STARTS = ("def ", "class ", "if __name__")

# White space as a Unicode-aware strip() sees it.
SPACE = r"[\s\x1c-\x1f]"


def truncate_stop(text: Column, stops: Sequence[str] = STOPS) -> Column:
    """Text before the first occurrence of each stop mark, applied in order."""
    return reduce(lambda col, stop: F.substring_index(col, stop, 1), stops, text)


def truncate_block(text: Column) -> Column:
    """Cut before the first blank line, or from line 2 on (counted from 0) a new block.

    A cut text ends with one line break; a text without a cut stays as it is.
    """
    starts = "|".join(BLOCK_STARTS)
    lines = F.split(text, "\n", -1)

    def ends(line: Column, i: Column) -> Column:
        blank = line.rlike(rf"(?U)\A{SPACE}*\z")
        block = line.rlike(rf"(?U)\A{SPACE}*({starts})")
        return blank | ((i > 1) & block)

    at = F.array_position(F.transform(lines, ends), True)
    kept = F.array_join(F.slice(lines, F.lit(1), (at - 1).cast("int")), "\n")
    return F.when(at > 0, F.concat(kept, F.lit("\n"))).otherwise(text)


def right_strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U){SPACE}+\z", "")


def widen_fences(text: Column) -> Column:
    """Triple back-ticks become quadruple, so that they cannot close a code block."""
    return F.replace(text, F.lit("```"), F.lit("````"))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1b\[[0-9;]*m", "")


def fixed_point(value: Column, digits: int = 4) -> Column:
    """Half-even text with a fixed number of decimals; ``inf`` and ``nan`` in lower case."""
    shown = F.format_string(f"%.{digits}f", F.bround(value, digits))
    return (
        F.when(F.isnan(value), "nan")
        .when(value == float("inf"), "inf")
        .when(value == float("-inf"), "-inf")
        .otherwise(shown)
    )


def run_file_name(experiment: Column, start: Column) -> Column:
    """``<experiment>_YYYY-MM-DD_HHMMSS.log`` with blanks and slashes replaced."""
    safe = F.replace(F.replace(experiment, F.lit(" "), F.lit("_")), F.lit("/"), F.lit("-"))
    return F.concat(safe, F.lit("_"), F.date_format(start, "yyyy-MM-dd_HHmmss"), F.lit(".log"))
