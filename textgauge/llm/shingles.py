"""Word shingles of texts as 64-bit hashes, and SuperMinHash signatures, in numpy.

Words are maximal runs of bytes other than ASCII white space, with A-Z lower-cased. A text's set holds
its distinct shingles of ``k`` words; a text of fewer words has the whole sequence as its only shingle,
a text without words the empty set.
"""

from __future__ import annotations

import numpy as np

#: Bytes hashed together; a longer text is cut at white space.
SLICE = 2_000_000
U = np.uint64
_WORD = np.ones(256, bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_FACTORS = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(16)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word in an array of bytes."""
    inside = _WORD[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * _powers(_BASE, len(data)))])
    raw = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts]
    return mix(raw + (ends - starts).astype(np.uint64)), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of lower-cased texts, and how many words each text has."""
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    hashes, places, start = [], [], 0
    while start < len(data):
        stop = min(len(data), start + SLICE)
        if stop < len(data):
            spaces = np.flatnonzero(~_WORD[data[start:stop]])
            if len(spaces):
                stop = start + int(spaces[-1]) + 1
            else:  # one word longer than a slice
                spaces = np.flatnonzero(~_WORD[data[stop:]])
                stop = stop + int(spaces[0]) + 1 if len(spaces) else len(data)
        h, at = _hash_words(data[start:stop])
        hashes.append(h)
        places.append(at + start)
        start = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    place = np.concatenate(places)
    return np.concatenate(hashes), np.diff(np.searchsorted(place, bounds))


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    words, counts = word_hashes([t.encode("utf-8").lower() for t in texts])
    n = max(0, len(words) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled += words[j : j + n] * _FACTORS[j]
    rolled = mix(rolled)
    out, at = [], 0
    for count in counts:
        if count >= k:
            out.append(np.unique(rolled[at : at + count - k + 1]))
        elif count:
            few = (words[at : at + count] * _FACTORS[:count]).sum(dtype=np.uint64) + U(int(count))
            out.append(mix(np.array([few], np.uint64)))
        else:
            out.append(words[:0])
        at += count
    return out


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures of ``m`` 16-bit values, a row for each set; rows of empty sets are zero.

    Every element walks through a random permutation of the ``m`` slots. At step ``j`` it offers its slot
    the value ``j`` plus a random fraction, and the slot keeps the least. A set stops as soon as all its
    slots hold values below the next step, which no later offer can undercut.
    """
    assert m <= 256
    sizes = np.array([len(s) for s in sets], np.int64)
    some = np.flatnonzero(sizes)
    out = np.zeros((len(sets), m), np.uint16)
    if not len(some):
        return out
    h = np.concatenate([sets[i] for i in some])
    row = np.repeat(np.arange(len(some)), sizes[some])
    best = np.full(len(some) * m, np.iinfo(np.uint64).max, np.uint64)

    def draw(j: int) -> tuple[np.ndarray, np.ndarray]:
        x = mix(h + U((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        return (x & U(0xFFFFFF)) % U(m - j) + U(j), U(j) << U(40) | x >> U(24)

    swapped: list[np.ndarray] = []  # where steps 0 and 1 went
    order = None
    for j in range(m):
        at, value = draw(j)
        if j == 0:
            slot = at
            swapped.append(at)
        elif j == 1:
            slot = np.where(at == swapped[0], U(0), at)
            swapped.append(at)
        else:
            each = np.arange(len(h))
            if order is None:  # few sets come here: those with a few hundred elements or less
                order = np.tile(np.arange(m, dtype=np.uint8), (len(h), 1))
                for i, was in enumerate(swapped):
                    order[each, was], order[:, i] = order[:, i], order[each, was]
            slot = order[each, at].astype(np.uint64)
            order[each, at] = order[:, j]
        np.minimum.at(best, row * m + slot.astype(np.int64), value)
        if j + 1 < m:
            live = (best.reshape(-1, m).max(axis=1) >= U(j + 1) << U(40))[row]
            if not live.any():
                break
            if not live.all():
                h, row = h[live], row[live]
                swapped = [s[live] for s in swapped]
                order = None if order is None else order[live]
    out[some] = (mix(best) & U(0xFFFF)).astype(np.uint16).reshape(-1, m)
    return out
