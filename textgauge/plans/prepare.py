"""Corpus preparation end to end: subsample, tokenize, chunk, account, save."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from textgauge.operators.chunking import chunk, chunk_stats
from textgauge.operators.sampling import subsample
from textgauge.operators.tokenizing import byte_tokenize
from textgauge.sources.chunks import write_chunks


@dataclass(frozen=True)
class Prepared:
    """Lazy chunks and their one-row accounting; ``path`` and ``rows`` once saved."""

    chunks: DataFrame
    stats: DataFrame
    path: str | None = None
    rows: int | None = None


def prepare(
    docs: DataFrame,
    *,
    max_length: int = 256,
    stride: int | None = None,
    fraction: float = 1.0,
    seed: int = 42,
    tokenize: Callable[[DataFrame], DataFrame] = byte_tokenize,
    tokenizer: str = "bytes",
    length: Callable[[], object] | None = None,
    save_to: str | None = None,
) -> Prepared:
    """From ``(doc_id, text)`` to chunks: one narrow stage behind the subsample's cut.

    ``tokenize`` turns ``text`` into ``input_ids``. ``length`` may give the token count as an
    expression over the text (``octet_length`` for bytes), which spares the accounting the
    tokenization.
    """
    stride = max_length if stride is None else stride
    kept = subsample(docs, fraction, ["doc_id"], seed)
    tokens = tokenize(kept)
    if length is None and tokenize is byte_tokenize:
        stats = chunk_stats(kept, F.octet_length("text"), max_length, stride)
    elif length is None:
        stats = chunk_stats(tokens, F.size("input_ids"), max_length, stride)
    else:
        stats = chunk_stats(kept, length(), max_length, stride)
    if tokenize is byte_tokenize:
        # a token is a byte: shorter texts cannot fill a window, and go before they are tokenized
        tokens = tokenize(kept.filter(F.octet_length("text") >= max_length))
    chunks = chunk(tokens, max_length, stride)
    if save_to is None:
        return Prepared(chunks, stats)
    path, rows = write_chunks(
        chunks,
        save_to,
        fraction=fraction,
        tokenizer=tokenizer,
        max_length=max_length,
        stride=stride,
        seed=seed,
    )
    return Prepared(chunks, stats, path, rows)
