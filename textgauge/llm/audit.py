"""Filter interaction audit: what each filter of a chain removes, in every order, and its fair share.

A document is described by the set of filters that it fails. Counts by part and set are all that the audit
needs: with them the removals of all coalitions of filters are tabulated. What a filter removes at a step of an order
is the difference of two coalitions. A filter's fair share, its Shapley value, is the solution of a least-squares
problem: numbers for the filters whose sums come closest to the removals of all coalitions, weighted by the Shapley kernel,
under the condition that all filters together get what they all remove. Its normal equations are the same for
every part, so they are solved once in rational numbers, with the removals left as unknowns; applied to a part
they give whole numbers, no rounding.

Only narrow rows (key, part, digest, set) are shuffled; equal ones are counted before, so that a group of
copies of any size is a few rows by then. Texts never move.

Defined results: a null part is the empty string, a null text is empty. Texts are identical if their SHA-256 are. A null key is
neither smaller nor greater than another, so its row fails no test for copies and makes no other row fail; rows that
share the smallest key of a text are no copies. A document has a label if any row of it in the labels has.
An empty table has no parts. Columns of other names do not matter.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame, functions as F

from textgauge.llm.common import column, saved, text_of

SPACES = "[\\x20\\x09-\\x0D]+"
#: Counts that are kept of every part and set of failed filters.
COUNTS = ("docs", "good", "toxic")


def text_filters(text: str = "text") -> dict[str, F.Column]:
    """Failure conditions by letter, on the text alone."""
    words = F.array_remove(F.split(text, SPACES), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": F.col(text).rlike("[#$%&*|]"),
    }


def failed_sets(
    docs: DataFrame,
    filters: Mapping[str, F.Column],
    labels: DataFrame | None = None,
    key: str = "doc_id",
    text: str = "text",
    part: str = "source",
) -> DataFrame:
    """(part, failed, docs, good, toxic): counts of documents by the filters they fail, as bits.

    The filters are conditions on the column ``text``, in the order of their bits; one more bit behind them stands for
    copies: the text of a document with a smaller key.
    """
    rows = docs.select(
        column(docs, key).alias("key"), F.coalesce(column(docs, part).cast("string"), F.lit("")).alias("part"), text_of(docs, text).alias("text")
    )
    bits = [F.when(condition, 1 << i).otherwise(0) for i, condition in enumerate(filters.values())]
    set_of = sum(bits[1:], bits[0]) if bits else F.lit(0)
    rows = rows.select("key", "part", F.unhex(F.sha2("text", 256)).alias("digest"), set_of.cast("int").alias("failed"))
    rows = rows.groupBy("key", "part", "digest", "failed").agg(F.count("*").alias("n"))

    if labels is None:
        rows = rows.withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    else:
        known = labels.select(column(labels, key).alias("key"), (column(labels, "quality") == 1).alias("good"), (column(labels, "toxic") == 1).alias("toxic"))
        known = known.filter("key IS NOT NULL AND (good OR toxic)").groupBy("key").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
        # null keys match nothing: spread them
        rows = rows.withColumn("salt", F.when(F.col("key").isNull(), F.xxhash64("digest")).otherwise(0))
        rows = rows.join(known.withColumn("salt", F.lit(0).cast("long")), ["key", "salt"], "left").drop("salt")
        rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})

    # of each text and part: all rows, and those of the smallest key here, without null keys
    group = ["digest", "part", "failed", "good", "toxic"]
    low = rows.groupBy(*group).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("unkeyed"),
        F.min(F.struct(F.col("key").isNull().alias("none"), "key", "n")).alias("first"),
    )
    low = low.select(*group, "n", "unkeyed", F.col("first.key").alias("key"), F.when(~F.col("first.none"), F.col("first.n")).otherwise(0).alias("at_key"))
    low = saved(low, "audit-texts")
    least = low.groupBy("digest").agg(F.min("key").alias("least"))
    own = low.join(least, "digest")
    first = F.col("unkeyed") + F.when(F.col("key") == F.col("least"), F.col("at_key")).otherwise(0)
    copy = 1 << len(filters)
    both = F.array(
        F.struct(F.col("failed").alias("failed"), first.alias("n")),
        F.struct((F.col("failed") + copy).alias("failed"), (F.col("n") - first).alias("n")),
    )
    cells = own.select("part", "good", "toxic", F.explode(both).alias("x")).filter("x.n > 0")
    return cells.groupBy("part", F.col("x.failed").alias("failed")).agg(
        F.sum("x.n").alias("docs"),
        F.sum(F.when(F.col("good"), F.col("x.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("x.n")).otherwise(0)).alias("toxic"),
    )


def coalitions(sets: DataFrame, filters: int) -> DataFrame:
    """(part, total, removed): documents of a part, and an array of what each coalition of filters removes.

    The coalition's bits are its place in the array; an element holds ``COUNTS``.
    """
    cells = F.collect_list(F.struct("failed", *COUNTS))  # one for each set of filters at most
    table = sets.groupBy("part").agg(F.sum("docs").alias("total"), cells.alias("cells"))

    def total(cells: F.Column, name: str) -> F.Column:
        return F.aggregate(cells, F.lit(0).cast("long"), lambda a, c: a + c[name])

    def removed(coalition: F.Column) -> F.Column:
        hit = F.filter("cells", lambda c: c["failed"].bitwiseAND(coalition) != 0)
        return F.struct(*(total(hit, name).alias(name) for name in COUNTS))

    each = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    return table.select("part", "total", F.transform(each, removed).alias("removed"))


def shapley_rows(filters: int) -> list[list[Fraction]]:
    """For each filter the factors of the coalitions' values in its Shapley value.

    Solves the kernel-weighted normal equations with a multiplier for the condition that the values of all filters
    add up to that of the whole coalition. Exact: in rationals, by elimination.
    """
    whole = (1 << filters) - 1
    inner = [s for s in range(1, whole)]
    weight = {s: Fraction(filters - 1, math.comb(filters, s.bit_count()) * s.bit_count() * (filters - s.bit_count())) for s in inner}
    rows = []
    for i in range(filters):
        left = [sum((weight[s] for s in inner if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(filters)]
        right = [weight[s] if s in weight and s >> i & 1 else Fraction(0) for s in range(whole + 1)]
        rows.append([*left, Fraction(1), *right])
    ends = [Fraction(0)] * (whole + 1)
    ends[whole] = Fraction(1)
    rows.append([Fraction(1)] * filters + [Fraction(0)] + ends)
    size = filters + 1
    for c in range(size):
        at = next(r for r in range(c, size) if rows[r][c])
        rows[c], rows[at] = rows[at], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(size):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c])]
    return [row[size:] for row in rows[:filters]]


def audit(table: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, from the coalitions of the parts.

    ``shapley`` is the filter's removals summed over all orders: its Shapley value times their number.
    """
    filters, orders = len(letters), math.factorial(len(letters))
    factors = [[f * orders for f in row] for row in shapley_rows(filters)]
    if any(f.denominator != 1 for row in factors for f in row):
        raise ArithmeticError("values summed over all orders must be whole numbers")
    docs = F.col("removed.docs")
    shares = [
        F.aggregate(
            F.zip_with(docs, F.array(*(F.lit(int(f)).cast("long") for f in row)), lambda v, f: v * f), F.lit(0).cast("long"), lambda a, x: a + x
        )
        for row in factors
    ]
    rows = table.withColumn("shares", F.array(*shares))
    named = F.array(*(F.lit("".join(p)) for p in itertools.permutations(letters)))
    rows = rows.withColumn("filter_order", F.explode(named))
    rows = rows.withColumn("places", F.transform(F.split("filter_order", ""), lambda c: F.instr(F.lit(letters), c) - 1))
    rows = rows.select("*", F.posexplode("places").alias("pos", "place"))
    rows = rows.withColumn("bit", F.expr("shiftleft(1, place)"))
    rows = rows.withColumn("before", F.expr("aggregate(slice(places, 1, pos), 0, (a, p) -> a + shiftleft(1, p))"))
    rows = rows.withColumn("after", F.col("before") + F.col("bit"))
    whole = (1 << filters) - 1
    of = lambda coalition, name: F.get("removed", coalition)[name]
    gone = {name: of(F.col("after"), name) - of(F.col("before"), name) for name in COUNTS}
    return rows.select(
        "part",
        "filter_order",
        (F.col("pos") + 1).cast("int").alias("step"),
        (F.col("total") - of(F.col("after"), "docs")).alias("kept"),
        gone["docs"].alias("removed"),
        (of(F.col("bit"), "docs") - gone["docs"]).alias("redundant"),
        (of(F.lit(whole), "docs") - of(F.lit(whole) - F.col("bit"), "docs")).alias("unique_fails"),
        gone["good"].alias("good_lost"),
        gone["toxic"].alias("toxic_lost"),
        F.get("shares", F.col("place")).alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The audit of the text filters A to D and of copies, E."""
    filters = text_filters("text")
    sets = saved(failed_sets(docs, filters, labels, key, text, part), "failed-sets")
    letters = "".join(filters) + "E"
    return audit(saved(coalitions(sets, len(letters)), "coalitions"), letters)
