"""Reproducible pseudo-random order from an explicit key.

Spark rows have no position, so a seeded shuffle is expressed as "order by md5 of
seed, salt and key". md5 gives the same text in every engine and on every Spark version.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

SAMPLE_SALT = "sample"
SPLIT_SALT = "split"


def order_hash(seed: int, salt: str, keys: Sequence[str]) -> Column:
    """32 hex digits; rows sorted by it are in the shuffled order of ``(seed, salt)``.

    Different keys give different texts: separators inside a key part are escaped, and a missing
    part reads ``\\N``, which no escaped part does. Numbers stay as they are.
    """

    def part(key: str) -> Column:
        text = F.col(key).cast("string")
        for mark in ("\\", ":"):
            text = F.replace(text, F.lit(mark), F.lit("\\" + mark))
        return F.coalesce(text, F.lit("\\N"))

    parts = [part(k) for k in keys]
    return F.md5(F.concat_ws(":", F.lit(f"{seed}:{salt}"), *parts).cast("binary"))


def below_share(hash_col: Column, share: float) -> Column:
    """True for the share of rows with the smallest hashes, up to chance (32-bit cut)."""
    if not 0.0 <= share <= 1.0:
        raise ValueError(f"share must be in [0, 1], got {share}")
    cut = math.floor(share * 2**32)
    if cut >= 2**32:
        return F.lit(True)
    return F.substring(hash_col, 1, 8) < F.lit(f"{cut:08x}")
