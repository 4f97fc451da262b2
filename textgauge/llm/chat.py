"""Chat formatting of logged conversations, after collapsing cumulative snapshots.

Chat logs often store a conversation again after every turn. Each turn gets the hash of all turns so far
(a running exclusive-or of turn hashes that hold the place of the turn, in two lanes of 64 bits). A
conversation whose last hash is an inner hash of another one is a prefix of that one; anti-joins keep
the maximal conversations, and of equal ones that of the least key. Only these are rendered.

Defined results: turns are ordered by number, then role and text; null numbers come first and repeated
turns count each. A null role reads ``unknown``, a null text is empty. Turns without a conversation key
form one conversation. Extra columns are left out. Markers of the format inside a role or text get a
blank after the bar, so that a text cannot end its own turn. A conversation becomes one row, so the
longest must fit a task, hot keys beside it do not meet in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from textgauge.llm.common import checked, column, saved

BEGIN, END = "<|im_start|>", "<|im_end|>"


def _plain(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    def said(name: str, missing: str) -> F.Column:
        safe = F.replace(column(turns, name), F.lit(BEGIN), F.lit("<| im_start|>"))
        return F.coalesce(F.replace(safe, F.lit(END), F.lit("<| im_end|>")), F.lit(missing))

    return turns.select(
        column(turns, conv).alias("conv"),
        column(turns, turn).alias("turn"),
        said(role, "unknown").alias("role"),
        said(text, "").alias("text"),
    )


def prefix_hashes(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv, i, n, p1, p2): for the i-th of n turns the hash of the first i."""
    rows = _plain(turns, conv, turn, role, text)
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    rows = rows.withColumns({"i": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy("conv"))})
    rows = rows.withColumns({"h1": F.xxhash64("i", "role", "text"), "h2": F.xxhash64("text", F.lit("second"), "role", "i")})
    so_far = Window.partitionBy("conv").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("conv", "i", "n", F.bit_xor("h1").over(so_far).alias("p1"), F.bit_xor("h2").over(so_far).alias("p2"))


def maximal(hashes: DataFrame) -> DataFrame:
    """(conv, n, copies) of the conversations that no longer one starts with; one of equal ones."""
    inner = hashes.filter("i < n").select("i", "p1", "p2").distinct()
    ends = hashes.filter("i = n").drop("n")
    alone = ends.join(inner, ["i", "p1", "p2"], "left_anti")
    return alone.groupBy("i", "p1", "p2").agg(F.min("conv").alias("conv"), F.count("*").alias("copies")).select(
        "conv", F.col("i").cast("long").alias("n"), "copies"
    )


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv, n_turns, copies, chat) of every maximal conversation."""
    kept = saved(maximal(saved(prefix_hashes(turns, conv, turn, role, text), "turn-hashes")), "maximal")
    rows = _plain(turns, conv, turn, role, text).withColumnRenamed("conv", "own")
    rows = rows.join(checked(kept), F.col("own").eqNullSafe(F.col("conv"))).drop("own")
    each = rows.groupBy("conv", "n", "copies").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    shown = F.transform("turns", lambda t: F.concat(F.lit(BEGIN), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n")))
    return each.select(F.col("conv").alias(conv), F.col("n").alias("n_turns"), "copies", F.array_join(shown, "").alias("chat"))
