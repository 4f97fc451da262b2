"""Arithmetic of fixed-length windows over a token sequence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def check_window(max_length: int, stride: int) -> None:
    if max_length < 1:
        raise ValueError(f"max_length must be at least 1, got {max_length}")
    if stride < 1:
        raise ValueError(f"stride must be at least 1, got {stride}")


def div(a: Column, b: int) -> Column:
    """Integer division."""
    return F.call_function("div", a, F.lit(b))


def window_count(length: Column, max_length: int, stride: int) -> Column:
    """Whole windows in a sequence; the tail after the last one is dropped."""
    check_window(max_length, stride)
    n = div(length - max_length, stride) + 1
    return F.when(length >= max_length, n).otherwise(0).cast("int")


def covered_tokens(length: Column, max_length: int, stride: int) -> Column:
    """Positions held by at least one window."""
    n = window_count(length, max_length, stride)
    step = min(stride, max_length)
    return F.when(n > 0, (n - 1) * step + max_length).otherwise(0)


def windows_at(pos: Column, length: Column, max_length: int, stride: int) -> Column:
    """How many windows hold the 0-based position ``pos``."""
    n = window_count(length, max_length, stride)
    last = F.least(n - 1, div(pos, stride))
    # first window that still reaches pos: ceil((pos - max_length + 1) / stride), not below 0
    first = F.greatest(F.lit(0), div(pos - max_length + stride, stride))
    first = F.when(pos < max_length, 0).otherwise(first)
    return F.greatest(last - first + 1, F.lit(0))
