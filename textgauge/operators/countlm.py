"""A counted bigram language model: train on one side of a split, score the other.

Counting goes before every shuffle and join: after it a pair is one row per side, so neither
frequent pairs nor frequent contexts make a hot task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from textgauge.functions.scores import smoothed_nll
from textgauge.functions.windows import check_window

# Models with at most this many possible pairs are small enough for every executor.
BROADCAST_PAIRS = 1 << 20


def count_pairs(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, prev, next, n)``."""
    return pairs.groupBy(*by, "prev", "next").agg(F.count(F.lit(1)).alias("n"))


def count_byte_pairs(
    df: DataFrame,
    max_length: int,
    stride: int | None = None,
    *,
    text: str = "text",
    by: Sequence[str] = (),
) -> DataFrame:
    """``(*by, prev, next, n)`` over the byte windows of each text, without making the windows.

    The same numbers as tokenizing, chunking, shifting and :func:`count_pairs` in a fraction of
    the time: a pair counts once for every window that holds both its bytes, which
    follows from its position, so each Arrow batch is reduced to at most 65,536 counts per group
    before anything is shuffled. Work goes in blocks of positions, so memory does not grow with
    the length of a text.
    """
    stride = max_length if stride is None else stride
    check_window(max_length, stride)
    types = (f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    schema = ", ".join([*types, "prev int, next int, n long"])
    names = list(by)
    block = 1 << 16  # positions per step; the work arrays then stay in the processor's cache
    dense = 64  # up to this many groups in a batch get a table of 65,536 counts each

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            firsts: dict = {}  # group values -> number of the group
            codes = np.zeros(batch.num_rows, np.int64)
            if names:
                rows = zip(*(batch.column(c).to_pylist() for c in names))
                codes = np.fromiter(
                    (firsts.setdefault(r, len(firsts)) for r in rows), np.int64, batch.num_rows
                )
            _, heads = np.unique(codes, return_index=True)

            def counted(group, pair, n):
                row = pa.array(heads[group])
                columns = [batch.column(c).take(row) for c in names]
                columns.append(pa.array(pair >> 8, pa.int32()))
                columns.append(pa.array(pair & 255, pa.int32()))
                columns.append(pa.array(n, pa.int64()))
                return pa.RecordBatch.from_arrays(columns, names=[*names, "prev", "next", "n"])

            raw = batch.column(text).cast(pa.large_binary())
            _, ends, values = raw.buffers()
            offsets = np.frombuffer(ends, np.int64)[raw.offset : raw.offset + len(raw) + 1]
            if len(raw) == 0 or offsets[-1] - offsets[0] < 2:
                continue
            data = np.frombuffer(values, np.uint8)
            sizes = np.diff(offsets)
            windows = np.where(sizes >= max_length, (sizes - max_length) // stride + 1, 0)
            last_window = (windows - 1).astype(np.int32)
            tables = np.zeros((len(heads), 65536)) if len(heads) <= dense else None
            stop = int(offsets[-1]) - 1
            for begin in range(int(offsets[0]), stop, block):
                end = min(begin + block, stop)
                first, last = np.searchsorted(offsets, [begin, end - 1], side="right") - 1
                docs = np.arange(first, last + 1)
                spans = np.minimum(offsets[docs + 1], end) - np.maximum(offsets[docs], begin)
                doc = np.repeat(docs, spans)
                pos = (np.arange(begin, end) - offsets[doc]).astype(np.int32)
                low = np.maximum((pos + 1 - max_length + stride) // stride, 0)
                high = np.minimum(pos // stride, last_window[doc])
                weight = np.maximum(high - low + 1, 0)
                at = np.flatnonzero(weight)
                pair = data[begin:end][at].astype(np.int32) * 256 + data[begin + 1 : end + 1][at]
                weight = weight[at]
                present = np.unique(codes[docs])
                if tables is None:
                    keys, where = np.unique(codes[doc[at]] * 65536 + pair, return_inverse=True)
                    n = np.bincount(where, weight, minlength=len(keys))
                    yield counted(keys >> 16, keys & 65535, n.astype(np.int64))
                elif len(present) == 1:
                    tables[present[0]] += np.bincount(pair, weight, minlength=65536)
                else:
                    group = codes[doc[at]]
                    for g in present:
                        own = group == g
                        tables[g] += np.bincount(pair[own], weight[own], minlength=65536)
            if tables is not None:
                group, pair = np.nonzero(tables)
                yield counted(group, pair, tables[group, pair].astype(np.int64))

    part = df.select(*by, F.coalesce(text, F.lit("")).alias(text)).mapInArrow(run, schema)
    return part.groupBy(*by, "prev", "next").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class CountLm:
    """``pairs(prev, next, n)``, ``contexts(prev, n)`` and the smoothing."""

    pairs: DataFrame
    contexts: DataFrame
    alpha: float
    vocab_size: int

    @property
    def small(self) -> bool:
        """Proven bound: ids lie below ``vocab_size``, so pairs are at most its square."""
        return self.vocab_size**2 <= BROADCAST_PAIRS


def count_lm(counts: DataFrame, vocab_size: int, alpha: float = 1.0) -> CountLm:
    """Model out of training counts ``(prev, next, n)``."""
    if alpha <= 0:
        raise ValueError(f"alpha must be positive, got {alpha}")
    contexts = counts.groupBy("prev").agg(F.sum("n").alias("n"))
    return CountLm(counts, contexts, alpha, vocab_size)


def score_count_lm(lm: CountLm, counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, prev, next, n, nll)`` for counted test pairs; ``nll`` is that of one occurrence.

    Pairs and contexts without training data get the smoothed share.
    """
    pairs = lm.pairs.select("prev", "next", F.col("n").alias("_pair"))
    contexts = lm.contexts.select("prev", F.col("n").alias("_context"))
    if lm.small:
        pairs, contexts = F.broadcast(pairs), F.broadcast(contexts)
    joined = counts.join(pairs, ["prev", "next"], "left").join(contexts, "prev", "left")
    nll = smoothed_nll(F.col("_pair"), F.col("_context"), lm.alpha, lm.vocab_size)
    return joined.select(*by, "prev", "next", "n", nll.alias("nll"))


def pair_probabilities(lm: CountLm) -> DataFrame:
    """``(prev, next, nll)`` of all pairs seen in training."""
    contexts = lm.contexts.select("prev", F.col("n").alias("_context"))
    joined = lm.pairs.join(F.broadcast(contexts) if lm.small else contexts, "prev")
    nll = smoothed_nll(F.col("n"), F.col("_context"), lm.alpha, lm.vocab_size)
    return joined.select("prev", "next", nll.alias("nll"))


def nested_losses(
    counts: DataFrame, steps: int, vocab_size: int, alpha: float = 1.0, by: Sequence[str] = ()
) -> DataFrame:
    """``(*by, step, eval_loss, n_tokens)`` of models trained on nested prefixes of the data.

    ``counts`` is ``(*by, prev, next, rung, n)``: training pairs under the first step that
    contains them (0-based), test pairs under a negative rung. Step -1 of the result is the
    model without data. All models come out of the same two shuffles: train and test counts of
    a pair meet as columns of one row instead of being joined.
    """
    total = F.col("n")
    wide = counts.groupBy(*by, "prev", "next").agg(
        F.sum(F.when(F.col("rung") < 0, total).otherwise(0)).alias("test"),
        *[
            F.sum(F.when((F.col("rung") >= 0) & (F.col("rung") <= i), total).otherwise(0)).alias(f"c{i}")
            for i in range(steps)
        ],
    )
    context = W.partitionBy(*by, "prev")  # at most vocab_size rows each
    models = [
        F.struct(F.lit(-1).alias("step"), F.lit(0).cast("long").alias("pair"), F.lit(0).cast("long").alias("context"))
    ] + [
        F.struct(F.lit(i).alias("step"), F.col(f"c{i}").alias("pair"), F.col(f"x{i}").alias("context"))
        for i in range(steps)
    ]
    wide = wide.select("*", *[F.sum(f"c{i}").over(context).alias(f"x{i}") for i in range(steps)])
    long = wide.filter(F.col("test") > 0).select(*by, "test", F.inline(F.array(*models)))
    nll = smoothed_nll(F.col("pair"), F.col("context"), alpha, vocab_size)
    return long.groupBy(*by, "step").agg(
        (F.sum(F.col("test") * nll) / F.sum("test")).alias("eval_loss"),
        F.sum("test").alias("n_tokens"),
    )
