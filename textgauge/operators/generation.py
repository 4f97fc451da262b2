"""Tables around a text generator: completions, grouping, pairing, next-token shaping."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textgauge.functions.text import STOPS, truncate_block, truncate_stop
from textgauge.operators.workers import once_per_worker
from textgauge.session import shared_dir, written



def generate(
    prompts: DataFrame,
    make_fn: Callable[[], Callable[..., list[list[str]]]],
    n: int = 1,
    *,
    key: str = "prompt_id",
    inputs: Sequence[str] = ("prompt",),
) -> DataFrame:
    """``(prompt_id, sample_idx, completion)``: n completions per prompt, without the prompt.

    ``make_fn`` runs once per Python worker (load the model there) and returns a function from the
    lists of the ``inputs`` columns to one list of ``n`` completions per row. Batches follow the
    session's Arrow settings.
    """
    key_type = prompts.schema[key].dataType.simpleString()
    load = once_per_worker(make_fn)

    def run(batches):
        complete = load()
        for batch in batches:
            out = batch[[key]].copy()
            out["completions"] = complete(*(batch[c].tolist() for c in inputs))
            bad = out["completions"].map(len) != n
            if bad.any():
                raise ValueError(f"the generator must return {n} completions per prompt")
            yield out

    made = prompts.select(key, *inputs).mapInPandas(run, f"{key} {key_type}, completions array<string>")
    return made.select(key, F.posexplode("completions").alias("sample_idx", "completion"))


def sampler(
    distribution: DataFrame, *, n: int = 1, seed: int = 42, max_new_tokens: int = 128
) -> Callable[[], Callable[[list[str], list[str]], list[list[str]]]]:
    """A bundled generator for :func:`generate` over a shaped ``(context, token, p)`` table.

    It takes prompts and their last tokens. The next token depends on the last one and is drawn by a
    hash of seed, prompt, sample and step, so results do not depend on partitioning; a table shaped
    with ``top_k=1`` is greedy. The table is written to the shared folder once and read by each
    Python worker, which must have room for it; :func:`sample_by_join` needs no such room.
    """
    path = shared_dir(distribution.sparkSession, "next-tokens")
    distribution.select("context", "token", "p").write.parquet(path)

    def make_fn():
        import hashlib

        import numpy as np
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        table = ds.dataset(root, filesystem=store, format="parquet").to_table()
        table = table.sort_by([("context", "ascending"), ("p", "descending"), ("token", "ascending")])
        tokens = table.column("token").to_pylist()
        names = table.column("context").to_pylist()
        p = table.column("p").to_numpy()
        first = np.flatnonzero([i == 0 or names[i] != names[i - 1] for i in range(len(names))])
        number = {names[i]: k for k, i in enumerate(first)}
        ends = np.append(first[1:], len(names)).astype(np.int64)
        upto = np.concatenate([np.cumsum(p[a:b]) for a, b in zip(first, ends)]) if len(first) else p
        follows = np.array([number.get(t, -1) for t in tokens], np.int64)
        rounds = int(np.max(ends - first, initial=1)).bit_length()

        def complete(prompts: list[str], lasts: list[str | None]) -> list[list[str]]:
            asked = [(prompt, j) for prompt in prompts for j in range(n)]
            at = np.repeat([number.get(t, -1) for t in lasts], n).astype(np.int64)
            made: list[list[str]] = [[] for _ in asked]
            for step in range(max_new_tokens):
                live = np.flatnonzero(at >= 0)
                if not len(live):
                    break
                texts = (f"{seed}:{asked[i][0]}:{asked[i][1]}:{step}".encode() for i in live)
                u = np.array([int(hashlib.md5(t).hexdigest()[:8], 16) / 2**32 for t in texts])
                # the first place whose cumulative share is above u, else the last
                low, high = first[at[live]], ends[at[live]] - 1
                for _ in range(rounds):
                    mid = (low + high) // 2
                    above = upto[mid] > u
                    high = np.where(above, mid, high)
                    low = np.where(above, low, np.minimum(mid + 1, high))
                for i, place in zip(live, low):
                    made[i].append(tokens[place])
                at[live] = follows[low]
            done = ["".join(m) for m in made]
            return [done[i : i + n] for i in range(0, len(done), n)]

        return complete

    return make_fn


def sample_by_join(
    prompts: DataFrame,
    distribution: DataFrame,
    *,
    n: int = 1,
    seed: int = 42,
    max_new_tokens: int = 128,
    key: str = "prompt_id",
    last: str = "last",
) -> DataFrame:
    """The same completions as :func:`generate` with :func:`sampler`, for a table of any size.

    ``last`` is the column with each prompt's last token. Every step joins the rows that still run
    with the choices of their last token; rows are written in between, so plans stay short.
    """
    choices = distribution.groupBy("context").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("q"), "token"))).alias("c")
    )
    zero = F.struct(F.lit(0.0).alias("x"), F.array().cast("array<double>").alias("xs"))

    def add(acc: Column, c: Column) -> Column:
        x = acc["x"] - c["q"]
        return F.struct(x.alias("x"), F.concat(acc["xs"], F.array(x)).alias("xs"))

    choices = written(
        choices.select(
            F.col("context").alias("_last"),
            F.transform("c", lambda c: c["token"]).alias("_tokens"),
            F.aggregate("c", zero, add, lambda acc: acc["xs"]).alias("_upto"),
        ),
        "choices",
    )
    samples = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample_idx")
    rows = prompts.select(key, "prompt", samples, F.col(last).alias("_last"), F.lit("").alias("completion"))
    for step in range(max_new_tokens):
        text = F.concat_ws(":", F.lit(seed), "prompt", "sample_idx", F.lit(step))
        u = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 2**32
        place = F.least(F.size(F.filter("_upto", lambda x: x <= u)), F.size("_upto") - 1)
        drawn = F.get("_tokens", place)
        rows = rows.join(choices, "_last", "left").select(
            key,
            "prompt",
            "sample_idx",
            drawn.alias("_last"),
            F.concat("completion", F.coalesce(drawn, F.lit(""))).alias("completion"),
        )
        if step % 4 == 3:
            rows = written(rows, "sampled")
            if rows.filter(F.col("_last").isNotNull()).isEmpty():
                break
    return rows.select(key, "sample_idx", "completion")


def greedy_by_join(
    prompts: DataFrame,
    best: DataFrame,
    *,
    max_new_tokens: int = 128,
    key: str = "prompt_id",
    last: str = "last",
) -> DataFrame:
    """``(prompt_id, sample_idx, completion)``: the most probable tokens one after another.

    ``best`` holds one ``token`` for each ``context``. Where 1, 2, 4, ... steps lead from a context is worked out once for
    all contexts, each from the one before; a prompt then takes the jumps that add up to the number of
    tokens. That is one join for each binary digit instead of each token, with tables of any size.
    """
    jumps = written(best.select("context", F.col("token").alias("made"), F.col("token").alias("end")), "jumps")
    rows = prompts.select(key, F.col(last).alias("_at"), F.lit("").alias("completion"))
    left = max_new_tokens
    while left:
        if left & 1:
            rows = rows.join(jumps.withColumnRenamed("context", "_at"), "_at", "left").select(
                key, F.col("end").alias("_at"), F.concat("completion", F.coalesce("made", F.lit(""))).alias("completion")
            )
        left >>= 1
        if left:
            further = jumps.select(F.col("context").alias("end"), F.col("made").alias("more"), F.col("end").alias("last"))
            both = F.concat("made", F.coalesce("more", F.lit("")))
            jumps = written(jumps.join(further, "end", "left").select("context", both.alias("made"), F.col("last").alias("end")), "jumps")
    return rows.select(key, F.lit(0).alias("sample_idx"), "completion")


def with_truncation(
    df: DataFrame, col: str = "completion", how: str = "stop", stops: Sequence[str] = STOPS
) -> DataFrame:
    """Cuts a completion at stop marks (``stop``) or at the end of its block (``block``)."""
    if how not in ("stop", "block"):
        raise ValueError(f"how must be 'stop' or 'block', got {how!r}")
    cut = truncate_stop(F.col(col), stops) if how == "stop" else truncate_block(F.col(col))
    return df.withColumn(col, cut)


def collect_samples(
    samples: DataFrame, tasks: DataFrame, *, task: str = "task_id", block: int = 1000
) -> DataFrame:
    """``(task_id, block_idx, n, completions)``: completions of each task in sample order.

    Samples ``0..block-1`` of a task form its first row, the next ones its second, and so on: a
    task with very many samples becomes many rows, never one huge array. Tasks without samples
    keep one row with an empty list; samples of unknown tasks are left out.
    """
    if block < 1:
        raise ValueError(f"block must be at least 1, got {block}")
    named = tasks.select(task).distinct()
    block_idx = F.call_function("div", F.col("sample_idx"), F.lit(block)).cast("int")
    packed = samples.groupBy(task, block_idx.alias("block_idx")).agg(
        F.array_sort(F.collect_list(F.struct("sample_idx", "completion"))).alias("_s")
    )
    # A semi and an anti join instead of one outer join: a task with very many blocks is then on
    # the side that a skewed join may split.
    found = packed.join(named, task, "left_semi").select(
        task, "block_idx", F.transform("_s", lambda s: s["completion"]).alias("completions")
    )
    none = named.join(samples.select(task).distinct(), task, "left_anti").select(
        task, F.lit(0).alias("block_idx"), F.array().cast("array<string>").alias("completions")
    )
    return found.unionByName(none).select(
        task, "block_idx", F.size("completions").alias("n"), "completions"
    )


def compare_cases(
    prompts: DataFrame, baseline: DataFrame, candidate: DataFrame, key: str = "prompt_id"
) -> DataFrame:
    """``(prompt_id, prompt, baseline, candidate)`` with both texts as prompt + cut completion.

    Every prompt gives one row; where a side has no completion, its text is NULL. Several
    completions of a prompt on one side raise.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        each = df.groupBy(key).agg(F.max("completion").alias("_c"), F.count(F.lit(1)).alias("_n"))
        several = F.raise_error(F.lit("a side has several completions of one prompt"))
        return each.select(key, F.when(F.col("_n") > 1, several).otherwise(truncate_block(F.col("_c"))).alias(name))

    joined = prompts.join(side(baseline, "_a"), key, "left").join(side(candidate, "_b"), key, "left")
    return joined.select(
        key,
        "prompt",
        F.concat("prompt", "_a").alias("baseline"),
        F.concat("prompt", "_b").alias("candidate"),
    )


def shape_distribution(
    weights: DataFrame,
    *,
    temperature: float = 1.0,
    top_k: int = 0,
    top_p: float = 1.0,
    repetition_penalty: float = 1.0,
    seen: DataFrame | None = None,
    do_sample: bool = True,
) -> DataFrame:
    """``(context, token, p)`` after the usual decoding settings, from ``(context, token, weight)``.

    Temperature raises probabilities to ``1/T``; ``top_k`` keeps the k best tokens (0 = all);
    ``top_p`` keeps tokens while the mass before them is below it; the rest is renormalized.
    ``seen`` lists ``(context, token)`` already used: as scores are log-probabilities (not
    positive), the penalty multiplies them, so ``p`` becomes ``p ** penalty``. Without sampling
    only the penalty counts and the best token is kept. Ties go in token order.

    Weights are summed per pair first, so a context has at most one row per vocabulary entry.
    """
    if temperature <= 0 or not 0 < top_p <= 1 or top_k < 0 or repetition_penalty <= 0:
        raise ValueError("need temperature > 0, 0 < top_p <= 1, top_k >= 0, repetition_penalty > 0")
    summed = weights.groupBy("context", "token").agg(F.sum("weight").cast("double").alias("weight"))
    whole = W.partitionBy("context")
    df = summed.filter(F.col("weight") > 0)
    if not do_sample:
        temperature, top_k, top_p = 1.0, 1, 1.0
    if repetition_penalty != 1.0 and seen is not None:
        # the penalty acts on shares, so these come first
        df = df.withColumn("p", F.col("weight") / F.sum("weight").over(whole)).drop("weight")
        used = seen.select("context", "token").distinct().withColumn("used", F.lit(True))
        df = df.join(used, ["context", "token"], "left").withColumn(
            "p", F.when(F.col("used"), F.pow("p", F.lit(repetition_penalty))).otherwise(F.col("p"))
        ).drop("used")
    else:
        # shares are weights up to a factor, which the last normalization takes out: the ranking
        # comes first, and Spark cuts it in each task before the shuffle
        df = df.withColumnRenamed("weight", "p")
    best = whole.orderBy(F.desc("p"), "token")
    if top_k:
        df = df.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= top_k).drop("_r")
    if temperature != 1.0:
        # relative to the greatest, so that large weights do not overflow
        df = df.withColumn("p", F.pow(F.col("p") / F.max("p").over(whole), F.lit(1.0 / temperature)))
    df = df.withColumn("p", F.col("p") / F.sum("p").over(whole))
    if top_p < 1.0:
        before = F.coalesce(
            F.sum("p").over(best.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)
        )
        # the edge is rounded, as sums of the same shares may differ in the last bits
        df = df.withColumn("_b", F.round(before, 9)).filter(F.col("_b") < top_p).drop("_b")
        df = df.withColumn("p", F.col("p") / F.sum("p").over(whole))
    return df.select("context", "token", "p")
