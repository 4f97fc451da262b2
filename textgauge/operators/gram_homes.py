"""Grams as numbers in Arrow batches: targets of windows, sums by key, and the tables of an n-gram model home by home.

A turned key has the context's digits backwards before the target's: last token, token before it and so on. Its home are
the first two digits. Grams of a home meet in one bin, and many of them in one row of bytes, so that Spark moves and sorts
few rows. A home with a large share of the grams has places for some of the tokens before it, which are worked off one by one:
contexts of three tokens and more lie in one place, and of the three-token grams counts are kept, of which there is one a target.
So a task holds the rows of some homes or of a place, and the test rows of a hot home.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Rows that are put together at once: targets of a task before they are dealt out, rows of homes after it.
ROWS = 1 << 20

#: Bits of the number of a bin, in which keys are moved and counted together, and of a place in the bin of a hot home.
BITS, PART_BITS = 12, 5


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of their values."""
    if not len(keys):
        return keys, *values
    if (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys)
        keys, values = keys[order], [v[order] for v in values]
    ends = np.flatnonzero(np.concatenate([keys[1:] != keys[:-1], [True]]))
    return keys[ends], *(np.diff(np.cumsum(v)[ends], prepend=0) for v in values)


def targets(windows: pa.ListArray, base: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The key of each target with up to ``order - 1`` tokens before it, and the number of its window."""
    sizes = windows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ids = windows.flatten()
    at = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    asked = sizes[row] > 1
    digits = ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    if ((digits < 1) | (digits > base - 2))[asked].any():
        raise ValueError("an id is not below the size of the vocabulary")
    keys = digits.copy()
    for back in range(1, order):
        keys[back:] += np.where(at[back:] >= back, digits[:-back], 0) * base**back
    wanted = at > 0
    return keys[wanted], row[wanted]


def numbers(grams: pa.ListArray, base: int, order: int, checked: bool = True) -> np.ndarray:
    """Keys of the last ``order`` tokens of grams. Ids that the vocabulary does not have fail, or share a digit."""
    sizes = grams.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ids = grams.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    known = (ids >= 0) & (ids < base - 2)
    if checked and (grams.null_count or not known.all()):
        raise ValueError("an id is not below the size of the vocabulary")
    digits, ends = np.where(known, ids + 1, base - 1), np.cumsum(sizes)
    keys = np.zeros(len(grams), np.int64)
    for i in range(order):
        has = sizes > i
        keys[has] += digits[ends[has] - 1 - i] * base**i
    return keys


def keys_of(grams: pa.Array, base: int, order: int) -> np.ndarray:
    """Keys of grams that are numbers already or still lists."""
    return grams.to_numpy() if pa.types.is_int64(grams.type) else numbers(grams, base, order)


def turned(keys: np.ndarray, base: int, order: int) -> np.ndarray:
    rest = keys // base
    made = keys - rest * base
    for i in range(1, order):
        longer = rest // base
        made += (rest - longer * base) * base ** (order - i)
        rest = longer
    return made


def mixed(values: np.ndarray, bits: int) -> np.ndarray:
    return (values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int32)


def places(keys: np.ndarray, base: int, order: int, hot: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The bin of turned keys' homes, and the number of their place in it.

    Other homes share bins of one place. A hot home has a bin of its own, and a place for some of the tokens before it.
    """
    homes, known = keys // base ** max(order - 2, 1), np.asarray(hot, np.int64)
    at = np.searchsorted(known, homes)
    own = known[np.minimum(at, len(known) - 1)] == homes if hot else np.zeros(len(keys), bool)
    bins = np.where(own, (1 << BITS) + at, mixed(homes, BITS)).astype(np.int32)
    parts = mixed(keys // base ** max(order - 3, 0) % base, PART_BITS)
    return bins, np.where(own, parts, 0).astype(np.int32)


def placed(keys: np.ndarray, base: int, order: int, hot: list[int]) -> pa.StructArray:
    bins, parts = places(keys, base, order, hot)
    return pa.StructArray.from_arrays([pa.array(bins), pa.array((bins << PART_BITS) + parts)], names=["home", "place"])


def packed(of: Sequence[np.ndarray], keys: np.ndarray, n: np.ndarray) -> tuple[list[np.ndarray], list[pa.Array]]:
    """Distinct values of ``of``, the main one last, and all their keys and counts in one row, so that few rows are moved."""
    # columns of up to 16 bits are sorted by their digits
    order = np.lexsort([c.astype(np.min_scalar_type(c.max())) for c in of])
    of = [c[order] for c in of]
    first = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in of], axis=0)]))
    ends = pa.py_buffer((np.append(first, len(order)) * 8).astype(np.int32))
    blobs = [pa.Array.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(v[order])]) for v in (keys, n)]
    return [c[first] for c in of], blobs


def counted_targets(batches: Iterator[pa.RecordBatch], by: int, base: int, order: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """``(*by, bin, keys, n)``: ``by`` columns and the last column's windows, combined as far as ``ROWS`` targets reach."""
    groups: dict[str, int] = {}
    heads, held, n = [], [], 0

    def combined():
        made = [np.unique(np.concatenate(keys), return_counts=True) for keys in held if keys]
        group = np.repeat([i for i, keys in enumerate(held) if keys], [len(k) for k, _ in made])
        keys, times = (np.concatenate([m[i] for m in made]).astype(np.int64) for i in (0, 1))
        (group, at), blobs = packed((group, mixed(keys, BITS)), keys, times)
        own = [pa.concat_arrays([h[c] for h in heads]).take(pa.array(group)) for c in range(by)]
        return pa.RecordBatch.from_arrays([*own, pa.array(at), *blobs], names=names)

    for batch in batches:
        keys, row = targets(batch.column(by), base, order)
        codes = np.zeros(batch.num_rows, np.int64)
        rows = zip(*(batch.column(c).to_pylist() for c in range(by))) if by else iter([()])
        for i, r in enumerate(rows):
            if (code := groups.setdefault(repr(r), len(groups))) == len(heads):
                heads.append([batch.column(c).slice(i, 1) for c in range(by)])
                held.append([])
            codes[i if by else slice(None)] = code
        codes = codes[row]
        if len(groups) > 1:
            turn = np.argsort(codes, kind="stable")
            codes, keys = codes[turn], keys[turn]
        present, first = np.unique(codes, return_index=True)
        for code, part in zip(present, np.split(keys, first[1:])):
            held[code].append(part)
        n += len(keys)
        if n >= ROWS or len(heads) >= ROWS >> 4:
            if n:
                yield combined()
            groups.clear()
            heads, held, n = [], [], 0
    if n:
        yield combined()


def counted_endings(batches: Iterator[pa.RecordBatch], base: int, order: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """``(bin, keys, n)`` of the keys' endings of three tokens, combined as far as ``ROWS`` rows reach; a pair has one bin."""
    held, n = [], 0

    def combined():
        keys, times = summed(*(np.concatenate(c) for c in zip(*held)))
        (at,), blobs = packed((mixed(keys % base**2, BITS),), keys, times)
        return pa.RecordBatch.from_arrays([pa.array(at), *blobs], names=names)

    for batch in batches:
        held.append((keys_of(batch.column(0), base, order) % base ** min(3, order), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= ROWS:
            yield combined()
            held, n = [], 0
    if n:
        yield combined()


def bins(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[tuple[list[pa.Array], np.ndarray, np.ndarray]]]:
    """Groups of a bin with their keys and sums, out of rows of ``(*by, bin, keys, n)`` sorted by bin."""
    last, groups = None, {}

    def done():
        return [(head, *summed(np.concatenate(keys), np.concatenate(n))) for head, keys, n in groups.values()]

    for batch in batches:
        rows = [repr(r) for r in zip(*(batch.column(c).to_pylist() for c in range(by)))] if by else [""] * batch.num_rows
        for i, (row, at) in enumerate(zip(rows, batch.column(by).to_pylist())):
            if at != last and groups:
                yield done()
                groups = {}
            last = at
            if row not in groups:
                groups[row] = [batch.column(c).slice(i, 1) for c in range(by)], [], []
            for column, values in zip((by + 1, by + 2), groups[row][1:]):
                values.append(np.frombuffer(batch.column(column)[i].as_buffer(), np.int64))
    if groups:
        yield done()


def counts(batches: Iterator[pa.RecordBatch], by: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """``(*by, key, n)`` out of rows sorted by bin."""
    for made in bins(batches, by):
        group = pa.array(np.repeat(np.arange(len(made)), [len(keys) for _, keys, _ in made]))
        own = [pa.concat_arrays([head[c] for head, *_ in made]).take(group) for c in range(by)]
        yield pa.RecordBatch.from_arrays([*own, *(pa.array(np.concatenate([m[i] for m in made])) for i in (1, 2))], names=names)


def pairs(batches: Iterator[pa.RecordBatch], base: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """``(pair, n, before)`` out of rows of endings sorted by bin."""
    for ((_, keys, n),) in bins(batches, 0):
        # at the start of a window a pair has no token before it
        made = summed(keys % base**2, n, (keys >= base**2).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=names)


def homes(batches: Iterator[pa.RecordBatch], base: int, order: int, hot: list[int], names: list[str]) -> Iterator[pa.RecordBatch]:
    """``(home, place, keys, n)``: turned keys of ``(gram or its key, n)`` by bin and place, of ``ROWS`` rows at once."""
    held, n = [], 0

    def dealt():
        keys, times = (np.concatenate(c) for c in zip(*held))
        (part, at), blobs = packed(places(keys, base, order, hot)[::-1], keys, times)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array((at << PART_BITS) + part), *blobs], names=names)

    for batch in batches:
        held.append((turned(keys_of(batch.column(0), base, order), base, order), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= ROWS:
            yield dealt()
            held, n = [], 0
    if n:
        yield dealt()


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array | None, bool]]:
    """Turned keys with their counts, test rows, and whether the last home is complete, of some places at once.

    Rows are ``(place, keys, n, asked)`` sorted by place; ``asked`` is NULL for keys, these for a test row.
    """
    last, keys, n, tests, size = None, [], [], [], 0
    none = np.zeros(0, np.int64)

    def piece(ends):
        test = pa.concat_arrays(tests) if tests else None
        return np.concatenate([none, *keys]), np.concatenate([none, *n]), test, ends

    for batch in batches:
        if not batch.num_rows:
            continue
        place, blob = batch.column(0).to_numpy(), ~batch.column(1).is_null().to_numpy(zero_copy_only=False)
        asked, before = batch.column(3).filter(pa.array(~blob)), np.concatenate([[0], np.cumsum(~blob)])
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        for start, stop in zip(first, np.append(first[1:], len(place))):
            now = int(place[start])
            if now != last and size >= ROWS >> 2:
                yield piece(now >> PART_BITS != last >> PART_BITS)
                keys, n, tests, size = [], [], [], 0
            last = now
            for i in start + np.flatnonzero(blob[start:stop]):
                for column, values in ((1, keys), (2, n)):
                    values.append(np.frombuffer(batch.column(column)[i].as_buffer(), np.int64))
                size += len(keys[-1])
            if before[stop] > before[start]:
                tests.append(asked.slice(before[start], before[stop] - before[start]))
                size += len(tests[-1])
    if last is not None:
        yield piece(True)


class Tables:
    """Counts of all levels from three on, out of turned keys of grams of up to ``order`` tokens."""

    def __init__(self, base: int, order: int):
        self.base, self.order = base, order
        self.three: list[tuple[np.ndarray, ...]] = []

    def level(self, keys: np.ndarray, k: int) -> np.ndarray:
        """The last ``k`` tokens of turned keys, turned."""
        return keys // self.base ** (self.order - k + 1) * self.base + keys % self.base

    def add(self, keys: np.ndarray, n: np.ndarray) -> dict[int, tuple]:
        """Levels above three of a piece; those of three tokens wait for the rest of their home."""
        keys, n = summed(keys, n)
        size = np.full(len(keys), self.order)
        short = np.flatnonzero(keys // self.base % self.base == 0)
        size[short] = 1 + sum((keys[short] // self.base ** (self.order - j) % self.base > 0).astype(int) for j in range(1, self.order))
        made, held = {}, None
        for k in range(self.order, 2, -1):
            own = size == k
            grams, times = self.level(keys[own], k), n[own]
            before = np.zeros(len(grams), np.int64)
            if held is not None:
                shorter = held[0] // self.base**2 * self.base + held[0] % self.base
                grams, times = np.concatenate([shorter, grams]), np.concatenate([held[1], times])
                before = np.concatenate([np.ones(len(shorter), np.int64), before])
            held = summed(grams, times, before)
            if k > 3:
                made[k] = (held, self.contexts(*held))
            else:
                self.three.append(held)
        return made

    def rest(self) -> dict[int, tuple]:
        """Level three of the homes that are complete."""
        if not self.three:
            return {}
        held = self.three[0] if len(self.three) == 1 else summed(*(np.concatenate(c) for c in zip(*self.three)))
        self.three = []
        return {3: (held, self.contexts(*held))}

    def close(self) -> None:
        """Puts the parts of an open home together."""
        if len(self.three) > 1:
            self.three = [summed(*(np.concatenate(c) for c in zip(*self.three)))]

    def contexts(self, grams: np.ndarray, n: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
        """``(context, total, kinds, total_before, kinds_before)``."""
        return summed(grams // self.base, n, np.ones(len(grams), np.int64), before, (before > 0).astype(np.int64))

    def turned_back(self, grams: np.ndarray, k: int) -> np.ndarray:
        """Keys of ``k`` tokens out of their turned ones."""
        keys = grams % self.base
        for j in range(1, k):
            keys = keys + grams // self.base ** (k - j) % self.base * self.base**j
        return keys

    def rows(self, made: dict[int, tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
        """``(level, home, key, is_context, *SUMS)``."""
        for k, (held, contexts) in made.items():
            for is_context, (keys, *sums) in ((False, held), (True, contexts)):
                keys = self.turned_back(keys * self.base if is_context else keys, k)
                of = keys // self.base
                keys, none = of if is_context else keys, np.zeros(len(keys), np.int64)
                sums = [none, none, *sums] if is_context else [*sums, none, none, none, none]
                columns = [np.full(len(keys), k, np.int32), of % self.base**2, keys, np.full(len(keys), is_context), *sums]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def tables(batches: Iterator[pa.RecordBatch], base: int, order: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of the model from level three on, out of rows sorted by place."""
    of = Tables(base, order)
    for keys, n, _, ends in pieces(batches):
        yield from of.rows(of.add(keys, n), names)
        if ends:
            yield from of.rows(of.rest(), names)
        else:
            of.close()


def found(keys: np.ndarray, table: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    """Values of keys in a sorted table, 0 for others."""
    known, *values = table
    if not len(known):
        return [np.zeros(len(keys), np.int64) for _ in values]
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    hit = known[at] == keys
    return [np.where(hit, v[at], 0) for v in values]


def share(own: np.ndarray, of: np.ndarray, kinds: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """``a, b`` of the probability ``a + b * lower`` that discounting leaves."""
    seen, whole = of > 0, np.maximum(of, 1).astype(float)
    a = np.where(seen, np.maximum(own - discount, 0.0) / whole, 0.0)
    return a, np.where(seen, discount * kinds / whole, 1.0)


def scores(
    batches: Iterator[pa.RecordBatch], base: int, order: int, orders: list[int], discount: float, own: int, names: list[str]
) -> Iterator[pa.RecordBatch]:
    """The first ``own`` test columns and the nll of each order, out of rows sorted by place.

    ``asked`` has ``own`` columns, tokens, q2, p2 and the turned key.
    """
    of, longest = Tables(base, order), max(orders)
    waiting: list[tuple] = []

    def asked(made, k, keys):
        grams = of.level(keys, k)
        held, contexts = made.get(k) or ((np.zeros(0, np.int64),) * 3, (np.zeros(0, np.int64),) * 5)
        n, before = found(grams, held)
        total, kinds, total_before, kinds_before = found(grams // base, contexts)
        return share(n, total, kinds, discount), share(before, total_before, kinds_before, discount)

    def said(made):
        for test, keys, longer in waiting:
            size, q2, p2 = (test.column(own + i).to_numpy() for i in range(3))
            short, lower = {2: q2}, p2
            if longest > 2:
                fits = size >= 3
                (a, b), (c, d) = asked(made, 3, keys) if order > 2 else ((0.0, 1.0),) * 2
                short[3], lower = np.where(fits, a + b * p2, p2), np.where(fits, c + d * p2, p2)
            for k, (a, b) in longer.items():
                short[k] = a + b * lower
            with np.errstate(divide="ignore"):
                losses = [pa.array(-np.log(short[k]), mask=~(short[k] > 0)) for k in orders]
            columns = [test.column(i).combine_chunks() for i in range(own)]
            yield from pa.Table.from_arrays([*columns, *losses], names=names).to_batches()
        waiting.clear()

    for keys, n, asked_rows, ends in pieces(batches):
        made = of.add(keys, n)
        if asked_rows is not None:
            *columns, keys = asked_rows.flatten()
            test, keys = pa.Table.from_arrays(columns, names=[*names[:own], "size", "q2", "p2"]), keys.to_numpy()
            size = test.column(own).to_numpy()
            # all orders above three as a line over the probability of three tokens
            longer, a, b = {}, np.zeros(len(test)), np.ones(len(test))
            for k in range(4, longest + 1):
                if k > order:
                    longer[k] = a, b
                    continue
                fits, ((c, d), (e, f)) = size >= k, asked(made, k, keys)
                longer[k] = np.where(fits, c + d * a, a), np.where(fits, d * b, b)
                a, b = np.where(fits, e + f * a, a), np.where(fits, f * b, b)
            waiting.append((test, keys, longer))
        if ends:
            yield from said(of.rest())
        else:
            of.close()
