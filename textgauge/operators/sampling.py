"""Exact-size subsamples by hash order, without sorting or shuffling the rows.

A subsample is "the k rows with the smallest order hash". The k-th smallest hash is found
with counts of hash prefixes; after that the subsample is a filter on the source. At most
``4096 * seeds`` counts and a few thousand hashes reach the driver, however many rows there
are, and rows never move.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from textgauge.functions.ordering import SAMPLE_SALT, order_hash

_DIGITS = 3  # hex digits added per counting pass
_SMALL = 4096  # a bucket of at most this many hashes is fetched and ranked
_ALL = "f" * 32


@dataclass(frozen=True)
class Cut:
    """Rows with ``order hash <= bound`` are the ``size`` first rows of one seeded shuffle."""

    seed: int
    salt: str
    size: int
    bound: str

    def keeps(self, keys: Sequence[str], hash_col: Column | None = None) -> Column:
        if self.size == 0:
            return F.lit(False)
        if self.bound == _ALL:
            return F.lit(True)
        h = order_hash(self.seed, self.salt, keys) if hash_col is None else hash_col
        return h <= F.lit(self.bound)


def subset_size(total: int, fraction: float) -> int:
    """``max(int(total * fraction), 1)``; nothing out of nothing."""
    return 0 if total == 0 else max(int(total * fraction), 1)


def check_fraction(fraction: float) -> None:
    if not 0.0 < fraction <= 1.0:
        raise ValueError(f"fraction must be in (0.0, 1.0], got {fraction}")


def find_cuts(
    df: DataFrame,
    keys: Sequence[str],
    seeds: Sequence[int],
    sizes: Callable[[int], Sequence[int]],
    salt: str = SAMPLE_SALT,
) -> tuple[int, dict[int, list[Cut]]]:
    """Row count, and per seed the cuts for ``sizes(row count)``.

    All seeds and sizes share each pass over the key columns. The first pass counts all rows
    by their first hash digits; later passes look only at the buckets a bound falls into,
    1/4096 of the rows each time. ``keys`` must identify a row. As ``df`` is read once per pass,
    sample stored tables rather than the result of long computations.
    """
    hashes = F.array(
        *[F.struct(F.lit(s).alias("seed"), order_hash(s, salt, keys).alias("h")) for s in seeds]
    )
    hashed = df.select(*keys).select(F.inline(hashes))

    def counts(part: DataFrame, digits: int) -> dict[tuple[int, str], int]:
        rows = part.groupBy("seed", F.substring("h", 1, digits).alias("p")).count().collect()
        return {(r["seed"], r["p"]): r["count"] for r in rows}

    level = counts(hashed, _DIGITS)
    total = sum(n for (seed, _), n in level.items() if seed == seeds[0])
    wanted = sizes(total)
    bounds: dict[tuple[int, int], str] = {}
    open_at: dict[tuple[int, int], tuple[str, int]] = {}  # prefix, rows still needed in it
    for seed in seeds:
        for size in wanted:
            if size >= total:
                bounds[seed, size] = _ALL
            elif size <= 0:
                bounds[seed, size] = ""
            else:
                open_at[seed, size] = ("", size)

    digits = _DIGITS
    while open_at:
        narrowed = {}
        for (seed, size), (prefix, need) in open_at.items():
            for p in sorted(p for s, p in level if s == seed and p.startswith(prefix)):
                n = level[seed, p]
                if need <= n:
                    break
                need -= n
            if need == n:
                bounds[seed, size] = p.ljust(32, "f")
            elif digits >= 32:
                raise ValueError(f"key columns {list(keys)} do not identify rows")
            else:
                narrowed[seed, size] = (p, need)
        open_at = narrowed
        if not open_at:
            break
        inside = {(seed, p) for (seed, _), (p, _) in open_at.items()}
        held = F.lit(False)
        for seed, p in sorted(inside):
            held = held | ((F.col("seed") == seed) & F.col("h").startswith(p))
        part = hashed.filter(held)
        if max(level[key] for key in inside) <= _SMALL:
            # short enough to rank one by one; still as counts, so copies cannot pile up
            digits = 32
        else:
            digits = min(digits + _DIGITS, 32)
        level = counts(part, digits)

    return total, {
        seed: [Cut(seed, salt, min(max(k, 0), total), bounds[seed, k]) for k in wanted]
        for seed in seeds
    }


def subsample(
    df: DataFrame, fraction: float, keys: Sequence[str], seed: int = 42, salt: str = SAMPLE_SALT
) -> DataFrame:
    """Exactly ``max(int(N * fraction), 1)`` rows; fraction 1 changes nothing.

    Works on documents and on chunks alike: ``keys`` is ``["doc_id"]`` or
    ``["doc_id", "chunk_idx"]``. Fractions of one seed nest.
    """
    check_fraction(fraction)
    if fraction == 1.0:
        return df
    _, cuts = find_cuts(df, keys, [seed], lambda n: [subset_size(n, fraction)], salt)
    return df.filter(cuts[seed][0].keeps(keys))


def held_out_rows(total: int, test_size: float) -> int:
    """``ceil(total * test_size)`` rows on the test side."""
    return math.ceil(total * test_size)
