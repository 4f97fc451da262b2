"""A counted n-gram language model with interpolated discounting, for all orders up to a limit at once.

Every target in a window is counted once, with as much history as the highest order takes. Lower orders follow
from that table by dropping the first token of each gram, again and again; how often a gram is dropped to is the
number of different tokens before it, which is what a lower order counts in place of occurrences. After the first
count each gram is one row.

A gram's home are the last two tokens of its context. Dropping first tokens down to three and taking the context leave
the home as it is, so rows are dealt out by home once, and all orders from three on are counted and asked where they lie.
Only grams of two tokens and one are dealt out anew. A home that a large share of the different grams has makes one
larger task, whose aggregates and sorts spill. With a known vocabulary a gram is one number, and numbers are moved and
counted many at once, see ``gram_homes``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from textgauge.functions.windows import div
from textgauge.operators import gram_homes
from textgauge.operators.tokenizing import once
from textgauge.session import written

SUMS = ("n", "before", "total", "kinds", "total_before", "kinds_before")


class _Arrays:
    """Grams as arrays of any ids."""

    def pack(self, gram: Column) -> Column:
        return gram

    def size(self, key: Column) -> Column:
        return F.size(key)

    def ending(self, key: Column, k: int) -> Column:
        return F.slice(key, F.greatest(F.size(key) - k + 1, F.lit(1)), F.lit(k))

    def context(self, key: Column) -> Column:
        return F.slice(key, F.lit(1), F.size(key) - 1)

    def home(self, key: Column) -> Column:
        return self.ending(self.context(key), 2)


class _Numbers(_Arrays):
    """Grams of up to ``order`` ids below ``vocab_size`` as one number, the last token as its lowest digit.

    Digit 0 is no token. All other ids share a digit, which training grams cannot have.
    """

    def __init__(self, vocab_size: int, order: int):
        self.base, self.order = vocab_size + 2, order

    def pack(self, gram: Column) -> Column:
        base, order = self.base, self.order

        @F.arrow_udf("bigint")
        def number(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for grams in columns:
                yield pa.array(gram_homes.numbers(grams, base, order, checked=False))

        return once(number)(gram)

    def unpack(self, key: Column) -> Column:
        ids = [(div(key, self.base**i) % self.base - 1).cast("int") for i in range(self.order)]
        gram = F.array().cast("array<int>")
        for size in range(1, self.order + 1):
            gram = F.when(key >= self.base ** (size - 1), F.array(*reversed(ids[:size]))).otherwise(gram)
        return gram

    def known(self) -> dict:
        return {"vocab_size": self.base - 2, "order": self.order}

    def key_of(self, counts: DataFrame) -> Column | None:
        """The column that ``count_grams`` packed in this form, if the counts have it."""
        has = "gram_key" in counts.columns and counts.schema["gram_key"].metadata == self.known()
        return F.col("gram_key") if has else None

    def turned(self, key: Column) -> Column:
        """The key with the context's digits backwards before the target's, see ``gram_homes``."""
        digits = (div(key, self.base**i) % self.base * F.lit(self.base ** (self.order - i)) for i in range(1, self.order))
        return sum(digits, key % self.base)

    def size(self, key: Column) -> Column:
        return sum(((key >= F.lit(self.base**i)).cast("int") for i in range(1, self.order)), (key > 0).cast("int"))

    def ending(self, key: Column, k: int) -> Column:
        return key % F.lit(self.base**k)

    def context(self, key: Column) -> Column:
        return div(key, self.base)


def _form(vocab_size: int | None, order: int) -> _Arrays:
    fits = vocab_size is not None and (vocab_size + 2) ** order < 2**63
    return _Numbers(vocab_size, order) if fits else _Arrays()


#: Training grams of one partition: of arrays, whose tables at home take several times as much memory, and of numbers.
HOME_ROWS, HOME_NUMBERS = 200_000, 1_000_000

#: A home is hot from so many targets on, and from one in so many of all targets.
HOT_TARGETS, HOT_SHARE = 100_000, 1024


def _at_home(df: DataFrame, parts: int) -> DataFrame:
    """Dealt out by home; the number is given so that every table at home is cut the same way."""
    return df.repartition(parts, "home")


def _schema(df: DataFrame | StructType, own: Sequence[str], more: str) -> StructType:
    """Own columns of ``df`` and those that a DDL string names."""
    known = df if isinstance(df, StructType) else df.schema
    return StructType([*(known[c] for c in own), *StructType.fromDDL(more).fields])


def _in_bins(df: DataFrame) -> DataFrame:
    """Rows of ``gram_homes.packed`` dealt out and sorted by bin."""
    return df.repartition("bin").sortWithinPartitions("bin")


def _train_homes(counts: DataFrame, form: _Numbers, hot: list[int]) -> DataFrame:
    base, order, names = form.base, form.order, ["home", "place", "keys", "n"]
    return counts.mapInArrow(lambda batches: gram_homes.homes(batches, base, order, hot, names), "home int, place int, keys binary, n binary")


def _sorted_places(df: DataFrame, parts: int) -> DataFrame:
    return _at_home(df, parts).sortWithinPartitions("place").drop("home")


def count_grams(
    chunks: DataFrame, order: int, *, ids: str = "input_ids", by: Sequence[str] = (), vocab_size: int | None = None
) -> DataFrame:
    """``(*by, gram, n)``: each target with up to ``order - 1`` tokens before it in its window, counted.

    The first token of a window is no target. NULL or short windows have none. If ``vocab_size`` is given, ids are
    below it, which is checked, and less is shuffled; the counts are written as numbers, in a last column ``gram_key``
    that the model and scoring take, and ``gram`` is made of them where it is asked for.
    """
    if order < 2:
        raise ValueError(f"order must be at least 2, got {order}")
    tokens = F.col(ids)
    ends = F.when(F.size(tokens) > 1, F.sequence(F.lit(2), F.size(tokens)))
    first = lambda end: F.greatest(end - (order - 1), F.lit(1))
    grams = F.transform(ends, lambda end: F.slice(tokens, first(end), end - first(end) + 1))
    form = _form(vocab_size, order)
    if not isinstance(form, _Numbers):
        return chunks.select(*by, F.explode(grams).alias("gram")).groupBy(*by, "gram").agg(F.count(F.lit(1)).alias("n"))
    groups = [F.col(c).alias(f"_{i}") for i, c in enumerate(by)]
    windows = chunks.select(*groups, tokens.alias("_ids"))
    base, width, own = form.base, len(groups), windows.columns[:-1]
    binned, made = (_schema(windows, own, more) for more in ("bin int, keys binary, n binary", "gram_key bigint, n bigint"))
    names = binned.names, made.names
    part = windows.mapInArrow(lambda batches: gram_homes.counted_targets(batches, width, base, order, names[0]), binned)
    counted = _in_bins(part).mapInArrow(lambda batches: gram_homes.counts(batches, width, names[1]), made)
    own = [F.col(f"_{i}").alias(c) for i, c in enumerate(by)]
    key = F.col("gram_key")
    return written(counted, "grams").select(*own, form.unpack(key).alias("gram"), "n", key.alias("gram_key", metadata=form.known()))


def ngram_tables(counts: DataFrame, order: int, vocab_size: int | None = None) -> DataFrame:
    """The model out of training counts: ``(level, home, key, is_context, n, before, total, kinds, total_before, kinds_before)``.

    One row for each gram of ``level`` tokens and one for each context of such grams, at the same ``home``. ``n`` counts
    occurrences, ``before`` different tokens before the gram. ``total`` and ``kinds`` are their sum and number over
    the grams that continue a context by a token, the same for ``before``. The empty gram is the context of single
    tokens. The model is not written: scoring counts and asks in one pass. ``counts`` are read several times, so save
    them before.
    """
    form = _form(vocab_size, order)
    if isinstance(form, _Numbers):
        return _number_tables(counts, form)
    parts = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), counts.count() // HOME_ROWS)
    key, home = F.col("key"), form.home(F.col("key")).alias("home")
    longest = _at_home(counts.select(form.pack(F.col("gram")).alias("key"), "n").select(home, "key", "n"), parts)
    longest = longest.groupBy("home", "key").agg(F.sum("n").alias("n")).withColumn("before", F.lit(0).cast("long"))
    tables, held = [], longest.filter(form.size(key) == order)
    for size in range(order - 1, 0, -1):
        tables.append(held)
        shorter = held.select("home", form.ending(key, size).alias("key"), "n", F.lit(1).cast("long").alias("before"))
        # grams at the start of a window have no token before them
        both = shorter.unionByName(longest.filter(form.size(key) == size))
        if size < 3:
            both = _at_home(both.select(home, "key", "n", "before"), parts)
        held = both.groupBy("home", "key").agg(F.sum("n").alias("n"), F.sum("before").alias("before"))
    tables.append(held)
    return _model({order - i: t for i, t in enumerate(tables)}, form, {"parts": parts})


def _model(tables: dict[int, DataFrame], form: _Arrays, known: dict) -> DataFrame:
    """Rows of the model out of ``(home, key, n, before)`` of some levels."""
    key = F.col("key")
    rows = None
    for level, table in tables.items():
        table = table.withColumn("level", F.lit(level))
        rows = table if rows is None else rows.unionByName(table)
    none, seen = F.lit(0).cast("long"), F.when(F.col("before") > 0, 1).otherwise(0).cast("long")

    def row(of: Column, is_context: bool, *values: Column) -> Column:
        return F.struct(of.alias("key"), F.lit(is_context).alias("is_context"), *(v.alias(c) for v, c in zip(values, SUMS)))

    as_gram = row(key, False, F.col("n"), F.col("before"), none, none, none, none)
    as_context = row(form.context(key), True, none, none, F.col("n"), F.lit(1).cast("long"), F.col("before"), seen)
    rows = rows.select("level", "home", F.inline(F.array(as_gram, as_context)))
    model = rows.groupBy("level", "home", "key", "is_context").agg(*[F.sum(c).alias(c) for c in SUMS])
    return model.select("level", "home", key.alias("key", metadata=known), "is_context", *SUMS)


def _number_tables(counts: DataFrame, form: _Numbers) -> DataFrame:
    """The model of grams as numbers.

    Pairs and single tokens, at most the square of the vocabulary, are counted from the endings of three tokens and written.
    Longer grams are sorted at home and counted in one pass by ``gram_homes``. The model carries both, so that scoring
    counts the longer ones in the pass in which it asks.
    """
    base, order = form.base, form.order
    parts = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), counts.count() // HOME_NUMBERS)
    key = form.key_of(counts)
    grams = counts.select(F.col("gram") if key is None else key, F.col("n").cast("long").alias("n"))
    binned, made = ["bin", "keys", "n"], ["pair", "n", "before"]
    endings = grams.mapInArrow(lambda batches: gram_homes.counted_endings(batches, base, order, binned), "bin int, keys binary, n binary")
    pairs = _in_bins(endings).mapInArrow(lambda batches: gram_homes.pairs(batches, base, made), "pair bigint, n bigint, before bigint")
    pairs = written(pairs, "pairs")
    # homes with many targets, by how often their two tokens follow each other; no more than HOT_SHARE of them
    floor = F.greatest(F.lit(HOT_TARGETS), F.sum("n") / HOT_SHARE)
    often = pairs.crossJoin(F.broadcast(pairs.agg(floor.alias("floor")))).filter(F.col("n") > F.col("floor")).select("pair").collect()
    hot = sorted(r["pair"] % base * base + r["pair"] // base for r in often)
    key, home = F.col("key"), form.home(F.col("key")).alias("home")
    two = pairs.filter(F.col("pair") >= base).withColumnRenamed("pair", "key").select(home, "key", "n", "before")
    single = pairs.filter((F.col("pair") < base) & (F.col("pair") > 0)).select(F.col("pair").alias("last"), "n", "before")
    last = two.select(form.ending(key, 1).alias("last"), "n", F.lit(1).cast("long").alias("before"))
    one = last.unionByName(single).groupBy("last").agg(F.sum("n").alias("n"), F.sum("before").alias("before"))
    one = one.withColumnRenamed("last", "key")
    known = {"parts": parts, **form.known()}
    low = _model({2: two, 1: one.select(home, "key", "n", "before")}, form, known)
    model = low
    if order > 2:
        columns = low.columns
        sums = ", ".join(f"{c} bigint" for c in SUMS)
        none = F.lit(None).cast("boolean").alias("asked")
        high = _sorted_places(_train_homes(grams, form, hot).select("*", none), parts).mapInArrow(
            lambda batches: gram_homes.tables(batches, base, order, columns), f"level int, home bigint, key bigint, is_context boolean, {sums}"
        )
        model = high.unionByName(low).select("level", "home", key.alias("key", metadata=known), "is_context", *SUMS)
    model.gram_parts = low, grams, hot
    return model


def score_ngrams(
    model: DataFrame,
    counts: DataFrame,
    orders: Sequence[int],
    vocab_size: int,
    discount: float = 0.75,
    by: Sequence[str] = (),
) -> DataFrame:
    """``(*by, order, gram, n, nll)`` of counted test targets under the model of each order.

    ``gram`` is the target with the history that the order takes. A target with less history than an
    order takes, at the start of a window, gets the lower order that fits. Tokens never seen get the share
    that discounting leaves to the uniform distribution over ``vocab_size``; a context never seen leaves
    everything to the shorter one.
    """
    if not 0 < discount <= 1:
        raise ValueError(f"discount must be in (0, 1], got {discount}")
    longest = max(orders)
    known = model.schema["key"].metadata
    form = _form(known.get("vocab_size"), known.get("order", longest))

    def mixed(own: Column, of: Column, kinds: Column, lower: Column) -> Column:
        own, of, kinds = (F.coalesce(c, F.lit(0)).cast("double") for c in (own, of, kinds))
        taken = F.greatest(own - discount, F.lit(0.0)) + discount * kinds * lower
        return F.when(of > 0, taken / of).otherwise(lower)

    # of longer grams the last tokens that the model's order takes
    packed = form.key_of(counts) if isinstance(form, _Numbers) else None
    packed = form.pack(F.col("gram")) if packed is None else packed
    tests = counts.filter("gram IS NOT NULL").select(*by, "gram", "n", packed.alias("_key"))
    tests = tests.withColumn("_pair", form.ending(F.col("_key"), 2))

    # single tokens and pairs: all single tokens share one context
    pairs = tests.select("_pair").distinct().withColumn("_last", form.ending(F.col("_pair"), 1))
    pairs = pairs.withColumn("_first", form.context(F.col("_pair")))
    low, *longer = getattr(model, "gram_parts", (model,))
    ones, twos = (low.filter(F.col("level") == k) for k in (1, 2))
    top = ones.filter("is_context").agg(F.sum("total_before").alias("_of"), F.sum("kinds_before").alias("_kinds"))
    single = ones.filter("NOT is_context").select(F.col("key").alias("_last"), F.col("before").alias("_own"))
    pairs = pairs.join(single, "_last", "left").crossJoin(F.broadcast(top))  # one row
    pairs = pairs.withColumn("p1", mixed(F.col("_own"), F.col("_of"), F.col("_kinds"), F.lit(1.0 / vocab_size)))
    seen = twos.filter("NOT is_context").select(F.col("key").alias("_pair"), "n", "before")
    pairs = pairs.join(seen, "_pair", "left")
    contexts = twos.filter("is_context").select(F.col("key").alias("_first"), *SUMS[2:])
    pairs = pairs.join(contexts, "_first", "left")
    two = form.size(F.col("_pair")) == 2
    q2, p2 = (mixed(F.col(c), F.col(f"total{e}"), F.col(f"kinds{e}"), F.col("p1")) for c, e in (("n", ""), ("before", "_before")))
    q2, p2 = (F.when(two, p).otherwise(F.col("p1")) for p in (q2, p2))
    pairs = pairs.select("_pair", q2.alias("q2"), p2.alias("p2"))

    if longer:
        return _scored_at_home(tests.join(pairs, "_pair"), *longer, form, orders, discount, by, known["parts"])

    # longer grams and their contexts are asked for where they lie; level 0 is the test's own row
    home, own = form.home(F.col("_key")).alias("home"), (*by, "gram", "n")
    tests = tests.join(pairs, "_pair").select(home, *[F.col(c).alias(f"_{c}") for c in own], "_key", "q2", "p2")
    tests = _at_home(tests, known["parts"])
    levels = range(3, longest + 1)
    none, end = F.lit(0).cast("long"), lambda k: form.ending(F.col("_key"), k)
    asks = [F.struct(F.lit(0).alias("level"), F.col("_key").alias("key"), F.lit(False).alias("is_context"), "q2", "p2")]
    for k in levels:
        for is_context, of in ((False, end(k)), (True, form.context(end(k)))):
            nothing = (F.lit(None).cast("double").alias(c) for c in ("q2", "p2"))
            ask = F.struct(F.lit(k).alias("level"), of.alias("key"), F.lit(is_context).alias("is_context"), *nothing)
            asks.append(F.when(F.size("_gram") >= k, ask))
    own = [f"_{c}" for c in own]
    asks = tests.select("home", *own, F.inline(F.filter(F.array(*asks), lambda a: a.isNotNull())))
    asks = asks.select("*", *[none.alias(c) for c in SUMS])
    told = model.filter((F.col("level") >= 3) & (F.col("level") <= longest))
    absent = [F.lit(None).cast(asks.schema[c].dataType).alias(c) for c in (*own, "q2", "p2")]
    told = told.select("home", "level", "key", "is_context", *absent, *SUMS).unionByName(asks)
    same = W.partitionBy("home", "level", "key", "is_context")
    told = told.select("home", "level", *own, "q2", "p2", *[F.sum(c).over(same).alias(c) for c in SUMS])
    told = told.filter("_gram IS NOT NULL")
    # equal rows of the counts are asked for and given as often as they come
    rows = told.groupBy("home", *own).agg(
        F.count_if(F.col("level") == 0).alias("_times"),
        F.max("q2").alias("q2"),
        F.max("p2").alias("p2"),
        *[F.max(F.when(F.col("level") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in levels for c in SUMS],
    )
    for k in levels:
        fits, lower = F.size("_gram") >= k, F.col(f"p{k - 1}")
        highest = mixed(F.col(f"n{k}"), F.col(f"total{k}"), F.col(f"kinds{k}"), lower)
        below = mixed(F.col(f"before{k}"), F.col(f"total_before{k}"), F.col(f"kinds_before{k}"), lower)
        rows = rows.withColumns({f"q{k}": F.when(fits, highest), f"p{k}": F.when(fits, below)})
    scored = []
    for k in orders:
        short = F.coalesce(f"q{k}", *[f"p{i}" for i in range(k - 1, 1, -1)])
        taken = F.slice("_gram", F.greatest(F.size("_gram") - k + 1, F.lit(1)), F.least(F.size("_gram"), F.lit(k)))
        scored.append(F.struct(F.lit(k).alias("order"), taken.alias("taken"), (-F.log(short)).alias("nll")))
    rows = rows.select(*own, F.explode(F.array_repeat(F.array(*scored), F.col("_times").cast("int"))).alias("_s"))
    rows = rows.select(*own, F.inline("_s"))
    return rows.select(*[F.col(f"_{c}").alias(c) for c in by], "order", F.col("taken").alias("gram"), F.col("_n").alias("n"), "nll")


def _scored_at_home(
    tests: DataFrame,
    grams: DataFrame,
    hot: list[int],
    form: _Numbers,
    orders: Sequence[int],
    discount: float,
    by: Sequence[str],
    parts: int,
) -> DataFrame:
    """Scores of grams as numbers: test rows meet the training grams of their home, which are counted there."""
    base, order, wanted = form.base, form.order, list(orders)

    @F.arrow_udf("struct<home:int,place:int>")
    def placed(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for keys in columns:
            yield gram_homes.placed(keys.to_numpy(), base, order, hot)

    own = [*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], F.col("gram").alias("_gram"), F.col("n").alias("_n")]
    width = len(own)
    asked = F.struct(*own, F.size("gram").alias("_size"), "q2", "p2", F.col("turned"))
    tests = tests.withColumn("turned", form.turned(F.col("_key")))
    tests = tests.select(once(placed)("turned").alias("_at"), asked.alias("asked"))
    tests = tests.select("_at.home", "_at.place", *[F.lit(None).cast("binary").alias(c) for c in ("keys", "n")], "asked")
    of = tests.schema["asked"].dataType
    both = _train_homes(grams, form, hot).withColumn("asked", F.lit(None).cast(of)).unionByName(tests)
    columns = of.names[:width]
    schema = _schema(of, columns, ", ".join(f"nll{k} double" for k in orders))
    names = schema.names
    rows = _sorted_places(both, parts).mapInArrow(
        lambda batches: gram_homes.scores(batches, base, order, wanted, discount, width, names), schema
    )
    scored = [F.struct(F.lit(k).alias("order"), F.col(f"nll{k}").alias("nll")) for k in orders]
    rows = rows.select(*columns, F.inline(F.array(*scored)))
    taken = F.slice("_gram", F.greatest(F.size("_gram") - F.col("order") + 1, F.lit(1)), F.least(F.size("_gram"), F.col("order")))
    return rows.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(by)], "order", taken.alias("gram"), F.col("_n").alias("n"), "nll")
