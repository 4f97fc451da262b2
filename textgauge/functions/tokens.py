"""Text to tokens without a vocabulary: bytes and pre-tokens."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The published pre-token pattern of byte-level BPE, in Java syntax. (?U)
# makes \s cover all Unicode white space. The short form leaves out the look-ahead, for
# comparison with regex engines that have none.
PRETOKEN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRETOKEN_SHORT = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def pretokens(text: Column, lookahead: bool = True) -> Column:
    """Lossless split: joining the result gives the text back."""
    pattern = PRETOKEN if lookahead else PRETOKEN_SHORT
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def byte_chars(text: Column) -> Column:
    """One single-character string per UTF-8 byte (Latin-1 view of the bytes)."""
    latin = F.decode(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), "ISO-8859-1")
    # split('', '') yields one empty string, so that one is taken out again
    return F.when(F.octet_length(text) > 0, F.split(latin, "")).otherwise(
        F.array().cast("array<string>")
    )


def byte_ids(text: Column) -> Column:
    """Byte values 0-255 of the UTF-8 form.

    Splitting the Latin-1 view is about twice as fast as cutting the hex form into pairs
    and needs no ``conv``; indexing the binary position by position would be quadratic.
    """
    return F.transform(byte_chars(text), lambda c: F.ascii(c))


def byte_text(ids: Column) -> Column:
    """Inverse of :func:`byte_ids`."""
    pairs = F.transform(ids, lambda b: F.lpad(F.hex(b), 2, "0"))
    return F.decode(F.unhex(F.array_join(pairs, "")), "UTF-8")


def ids_digest(ids: Column) -> Column:
    """Short fingerprint of an id array, the same in every engine."""
    return F.md5(F.array_join(ids.cast("array<string>"), ",").cast("binary"))
