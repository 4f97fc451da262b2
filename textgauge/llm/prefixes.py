"""Token counts of every prefix of a text, by dynamic programming.

A byte-level BPE vocabulary settles where merges may stand side by side: a row of tokens is the encoding
of its bytes exactly if every neighbouring pair is the encoding of its own bytes. So of the tokens that end at a
place just one can be the last token of the prefix that ends there: the one that may follow the last token of
the prefix before it. One pass over a piece gives last tokens and counts of all its prefixes; nothing is
encoded twice, neither for another length nor for another budget.

``prefix_counts`` stores the counts in blocks of code points, ``tokens_at`` answers how many tokens a cut text
has, ``longest_within`` how much of a text fits a budget, both from the stored blocks alone. ``count_tokens``
gives whole texts and the longest prefix within a budget in the same pass. Spark deals out the rows; only the look-ups
shuffle, and these move blocks of numbers, never texts.

Counts are those of the tokenizers library without added tokens at the ends. Special strings in a text are one
token each, as the library has it by default; a prefix that ends inside of one counts its characters as text.

Defined results: a null or empty text has no tokens, no prefixes but the empty one, and one block without counts.
Equal keys keep their rows each in ``count_tokens``; stored prefixes need keys that name a row, a null key is a
key of its own. Very long texts take time and memory in proportion to their length. Tokenizers of another
kind raise.
"""

from __future__ import annotations

import itertools
import json
import sys
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from textgauge.llm.bpe import ship
from textgauge.llm.common import column, cut_batches, fresh

#: Fixed value: the published pre-token pattern of this family of tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces, and pairs of tokens, that a Python worker remembers; and places for pairs by hash, in bits.
PIECES, PAIRS, PAIR_BITS = 400_000, 500_000, 20
#: Bytes of the pieces that are counted together, by length; longer ones are counted alone.
TOGETHER = 40
#: Code points of a stored block.
BLOCK = 4096
NEVER = sys.maxsize


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself if it is printable Latin, else one after 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=1)
def _assigned() -> np.ndarray:
    """Whether Python's own version of Unicode knows a code point; on others versions may differ in their class."""
    return np.fromiter((unicodedata.category(chr(c)) != "Cn" for c in range(0x110000)), bool, 0x110000)


class Table:
    """Whole numbers to whole numbers of 0 and above, by hashing in arrays, at most a quarter full."""

    def __init__(self, pairs: dict[int, int]):
        keys, values = (np.array(list(x), np.int64) for x in (pairs.keys(), pairs.values()))
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        slots = _slots(keys, self.bits)
        while len(keys):
            free = self.keys[slots] < 0
            _, first = np.unique(np.where(free, slots, -1), return_index=True)
            first = first[free[first]]
            self.keys[slots[first]], self.values[slots[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & (1 << self.bits) - 1

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where a key is unknown."""
        out = np.full(len(keys), -1, np.int64)
        at, slots = np.arange(len(keys)), _slots(keys, self.bits)
        while len(at):
            there = self.keys[slots]
            hit = there == keys[at]
            out[at[hit]] = self.values[slots[hit]]
            more = ~hit & (there >= 0)
            at, slots = at[more], (slots[more] + 1) & (1 << self.bits) - 1
        return out


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


class Merges:
    """A byte-level BPE vocabulary, and which of its tokens may follow which."""

    def __init__(self, spec: dict):
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(
            model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        )
        bytewise = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if not (plain and bytewise and spec["normalizer"] is None):
            raise ValueError("prefix counts need a byte-level BPE tokenizer with merges alone")
        added = spec["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("special strings that take neighbouring characters are not counted")
        self.marks = sorted((t["content"] for t in added), key=len, reverse=True)
        of = _byte_alphabet()
        names = [bytes(of[c] for c in t) for t in model["vocab"] if t not in self.marks and all(c in of for c in t)]
        number = {name: i for i, name in enumerate(names)}
        self.rank = [-1] * len(names)  # of the merge that makes a token; bytes are there from the start
        self.parts: list[tuple[int, int] | None] = [None] * len(names)
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = (number[bytes(of[c] for c in t)] for t in (left, right))
            made = number[names[a] + names[b]]
            if self.parts[made] or max(self.rank[a], self.rank[b]) >= rank:
                raise ValueError("merges that do not build on earlier ones")
            self.parts[made], self.rank[made], self.merged[a, b] = (a, b), rank, rank
        self.sizes = [len(n) for n in names]
        self.ends = [self._spine(t, 1) for t in range(len(names))]
        self.starts = [self._spine(t, 0) for t in range(len(names))]
        self.find = ahocorasick.Automaton()
        arcs: dict[int, int] = {}
        ends = {}
        for t, name in enumerate(names):
            # a token is used only if its own bytes are encoded as itself
            if self.parts[t] is None and len(name) == 1 or self.parts[t] and not self._crossed(*self.parts[t], self.rank[t]):
                self.find.add_word(name.decode("latin-1"), t)
                node = 0
                for byte in name:
                    node = arcs.setdefault(node << 8 | byte, len(arcs) + 1)
                ends[node] = t
        self.find.make_automaton()
        self.arcs = Table(arcs)
        self.token_at = np.full(len(arcs) + 1, -1, np.int64)
        self.token_at[list(ends.keys())] = list(ends.values())
        # answers about pairs: a newer one takes the place of an older
        self.asked, self.told = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.pairs: dict[tuple[int, int], bool] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at an end of ``token`` while it is built, and the merge that takes each up."""
        out, until = [(token, NEVER)], self.rank[token]
        while self.parts[token]:
            token = self.parts[token][side]
            out.append((token, until))
            until = self.rank[token]
        return out

    def _crossed(self, left: int, right: int, before: int = NEVER) -> bool:
        """Whether a merge across the border comes earlier than the merges that use up its two sides.

        At one rank the leftmost place goes first: inside the left token before the border, there before the right token.
        """
        for a, a_until in self.ends[left]:
            for b, b_until in self.starts[right]:
                rank = self.merged.get((a, b), NEVER)
                if rank < min(a_until, before) and rank <= b_until:
                    return True
        return False

    def follows(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = not self._crossed(left, right)
        return known

    def follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``follows`` of many pairs."""
        keys = left << 32 | right
        slots = _slots(keys, PAIR_BITS)
        new = self.asked[slots] != keys
        if not new.any():
            return self.told[slots]
        unknown, back = np.unique(keys[new], return_inverse=True)
        said = np.fromiter((not self._crossed(k >> 32, k & 0xFFFFFFFF) for k in unknown.tolist()), bool, len(unknown))
        out = self.told[slots]
        out[new] = said[back]
        at = _slots(unknown, PAIR_BITS)
        self.asked[at], self.told[at] = unknown, said  # of two for one place the same wins in both
        return out

    def totals(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of whole pieces of one length: the same as ``by_byte``, for all of them at each place at once."""
        n, size = len(pieces), len(pieces[0])
        data = np.frombuffer(b"".join(pieces), np.uint8).reshape(n, size).astype(np.int64)
        found: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(size + 1)]
        for start in range(size):
            rows, node = np.arange(n), np.zeros(n, np.int64)
            for end in range(start + 1, size + 1):
                node = self.arcs.get(node << 8 | data[rows, end - 1])
                on = node >= 0
                rows, node = rows[on], node[on]
                if not len(rows):
                    break
                token = self.token_at[node]
                some = token >= 0
                found[end].append((rows[some], np.full(int(some.sum()), start), token[some]))
        last, count = np.full((n, size + 1), -1, np.int64), np.zeros((n, size + 1), np.int64)
        for end in range(1, size + 1):
            rows, start, token = (np.concatenate(x) for x in zip(*found[end]))
            yes = start == 0
            inner = ~yes
            yes[inner] = self.follow(last[rows[inner], start[inner]], token[inner])
            rows, start = rows[yes], start[yes]
            last[rows, end], count[rows, end] = token[yes], count[rows, start] + 1
        return count[:, size]

    def by_byte(self, data: bytes) -> list[int]:
        """Tokens of every prefix of a piece, the empty one first."""
        last, count = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        sizes, follows = self.sizes, self.follows
        for end, token in self.find.iter(data.decode("latin-1")):
            if last[end + 1] < 0:
                start = end + 1 - sizes[token]
                if start == 0 or last[start] >= 0 and follows(last[start], token):
                    last[end + 1], count[end + 1] = token, count[start] + 1
        return count


class PrefixCounter:
    """Counts of prefixes of texts; remembers those of pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.merges = Merges(json.load(f))
        self.path, self.library = path, None
        self.find = regex.compile(PATTERN)
        self.mark = regex.compile("|".join(map(regex.escape, self.merges.marks))) if self.merges.marks else None
        self.known: dict[str, list[int]] = {}
        self.whole: dict[str, int] = {}

    def of_piece(self, piece: str) -> list[int]:
        """Tokens of the prefixes of one piece, by code points, from the first on."""
        made = self.known.get(piece)
        if made is None:
            data = piece.encode("utf-8")
            made = self.merges.by_byte(data)[1:]
            if len(data) > len(piece):  # prefixes end where a character does
                made = [n for n, after in zip(made, itertools.chain(data[1:], b"x")) if after & 0xC0 != 0x80]
            if len(piece) == 3 and piece in ("'re", "'ve", "'ll"):
                made[1] = 2  # cut short, the sign and the letter are pieces of their own
            if len(self.known) >= PIECES // 8:
                self.known.clear()
            self.known[piece] = made
        return made

    def learn(self, pieces: list[list[str]]) -> None:
        """Count the pieces that are not known yet, those of one length together."""
        new = {p for own in pieces for p in own if p not in self.whole}
        if len(self.whole) + len(new) > PIECES:
            self.whole.clear()
            new = {p for own in pieces for p in own}
        by_size: dict[int, list[str]] = {}
        for p in new:
            by_size.setdefault(len(p.encode("utf-8")), []).append(p)
        for size, own in by_size.items():
            if size > TOGETHER:
                self.whole.update((p, self.merges.by_byte(p.encode("utf-8"))[-1]) for p in own)
                continue
            step = max(1, 400_000 // (size * size))
            for k in range(0, len(own), step):
                part = own[k : k + step]
                self.whole.update(zip(part, self.merges.totals([p.encode("utf-8") for p in part]).tolist()))

    def pieces(self, text: str) -> list[str]:
        if text.isascii() or _assigned()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].all():
            return self.find.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def parts(self, text: str) -> list[tuple[str, str]]:
        """Stretches of ordinary text and the special string behind each, empty behind the last."""
        if self.mark is None or not any(m in text for m in self.merges.marks):
            return [(text, "")]
        out, at = [], 0
        for found in self.mark.finditer(text):
            out.append((text[at : found.start()], found.group()))
            at = found.end()
        return [*out, (text[at:], "")]

    def totals(self, texts: list[str]) -> tuple[list[int], list[list[list[str]]]]:
        """Tokens of each text, and the pieces of its parts."""
        pieces = [[self.pieces(part) for part, _ in self.parts(t)] for t in texts]
        self.learn([own for parts in pieces for own in parts])
        get = self.whole.__getitem__
        return [len(parts) - 1 + sum(sum(map(get, own)) for own in parts) for parts in pieces], pieces

    def total(self, text: str) -> int:
        return self.totals([text])[0][0]

    def within(self, text: str, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens."""
        (_,), (pieces,) = self.totals([text])
        return self.fits(text, pieces, budget)

    def fits(self, text: str, pieces: list[list[str]], budget: int) -> int:
        """``within`` of a text whose pieces are known."""
        best, at, used = 0, 0, 0
        for (part, mark), own in zip(self.parts(text), pieces):
            reach = self._last_within(self.pieces(part + mark[:-1]) if mark else own, budget - used)
            best = at + reach if reach else best
            used += sum(map(self.whole.__getitem__, own))
            at += len(part) + len(mark)
            if mark:
                used += 1
                best = at if used <= budget else best
            if used > budget:  # no later prefix has fewer tokens
                break
        return best

    def _last_within(self, pieces: list[str], budget: int) -> int:
        """Code points of the longest prefix of ordinary text within a budget, 0 if only the empty one is.

        A prefix that ends behind a piece has the tokens of the pieces up to there, so only what follows the last such
        that fits is looked at, from where no white space hangs over.
        """
        self.learn([pieces])
        used = np.cumsum([0, *map(self.whole.__getitem__, pieces)])
        start = min(int(np.searchsorted(used, budget, "right")), len(pieces)) - 1
        while start > 0 and (pieces[start].isspace() or pieces[start - 1].isspace()):
            start -= 1
        start = max(0, start)
        stop = start
        while stop < len(pieces) and (used[stop] <= budget or pieces[stop].isspace() or pieces[stop - 1].isspace()):
            stop += 1
        fits = np.flatnonzero(self._stretch(pieces[start:stop]) <= budget - used[start])
        before = sum(map(len, pieces[:start]))
        return before + int(fits[-1]) + 1 if len(fits) else before if used[start] <= budget else 0

    def counts(self, text: str) -> np.ndarray:
        """Tokens of every prefix of a text by code points, from the first on."""
        made, used = [], 0
        for part, mark in self.parts(text):
            # inside a special string its characters still are text
            made.append(self._stretch(self.pieces(part + mark[:-1] if mark else part)) + used)
            if mark:
                used += self.total(part) + 1
                made.append(np.array([used], np.int64))
        return np.concatenate(made) if made else np.zeros(0, np.int64)

    def _stretch(self, pieces: list[str]) -> np.ndarray:
        """Counts of the prefixes of ordinary text, given by its pieces."""
        text, out = "".join(pieces), []
        base, blank_from, blank_base = 0, -1, 0
        for piece in pieces:
            own = self.of_piece(piece)
            if piece.isspace():
                # white space is one piece up to where a prefix ends, however the whole text cuts it later
                if blank_from < 0:
                    blank_from, blank_base = len(out), base
                run = text[blank_from : len(out) + len(piece)]
                out += [blank_base + n for n in self.of_piece(run)[len(out) - blank_from :]]
            else:
                made = [base + n for n in own]
                if blank_from >= 0 and piece[0] == " ":
                    made[0] = blank_base + self.of_piece(text[blank_from : len(out) + 1])[-1]
                out += made
                blank_from = -1
            base += own[-1]
        return np.array(out, np.int64)


@lru_cache(maxsize=2)
def _counter(name: str) -> PrefixCounter:
    """Made once per Python worker from the file that Spark has shipped."""
    return PrefixCounter(SparkFiles.get(name))


def count_tokens(
    docs: DataFrame, path: str, budget: int, text: str = "text", new: tuple[str, str] = ("n_tokens", "fits_chars")
) -> DataFrame:
    """``docs`` with the tokens of each text, and the code points of its longest prefix of at most ``budget`` tokens.

    New columns replace those of the same names.
    """
    name = ship(docs.sparkSession, path)
    held = [c for c in docs.columns if c not in new]
    base = docs.select(*(column(docs, c) for c in held))
    own = fresh(base, "_text")
    base = base.withColumn(own, column(docs, text))
    at = len(held)

    def run(batches):
        counter = _counter(name)
        for whole in batches:
            for batch in cut_batches(whole, at, 2_000_000):
                texts = [t or "" for t in batch.column(at).to_pylist()]
                totals, pieces = counter.totals(texts)
                fits = [len(t) if n <= budget else counter.fits(t, p, budget) for t, n, p in zip(texts, totals, pieces)]
                cols = [*batch.columns[:at], pa.array(totals, pa.int64()), pa.array(fits, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*held, *new])

    schema = StructType([docs.schema[c] for c in held] + [StructField(c, LongType()) for c in new])
    return base.mapInArrow(run, schema)


def prefix_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(key, n_chars, block, counts, least): tokens of the prefixes that end in each block of code points.

    ``counts[i]`` belongs to the prefix of ``block * size + i + 1`` code points. To be written and asked by
    ``tokens_at`` and ``longest_within``.
    """
    name = ship(docs.sparkSession, path)
    rows = docs.select(column(docs, key).alias(key), column(docs, text).alias("_text"))

    def run(batches):
        counter = _counter(name)
        for whole in batches:
            for batch in cut_batches(whole, 1, 500_000):
                for row, value in enumerate(batch.column(1).to_pylist()):
                    counts = counter.counts(value or "")
                    parts = [counts[i : i + block] for i in range(0, max(1, len(counts)), block)]
                    n = len(parts)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([row] * n)),
                            pa.array([len(counts)] * n, pa.int64()),
                            pa.array(range(n), pa.int64()),
                            pa.array(parts, pa.list_(pa.int32())),
                            pa.array([int(p.min()) if len(p) else 0 for p in parts], pa.int64()),
                        ],
                        names=[key, "n_chars", "block", "counts", "least"],
                    )

    kinds = [("n_chars", LongType()), ("block", LongType()), ("counts", ArrayType(IntegerType())), ("least", LongType())]
    return rows.mapInArrow(run, StructType([StructField(key, docs.schema[key].dataType)] + [StructField(*k) for k in kinds]))


def tokens_at(stored: DataFrame, asked: DataFrame, key: str = "doc_id", chars: str = "chars", block: int = BLOCK) -> DataFrame:
    """``asked`` (key, chars, ...) with ``n_tokens`` of the text cut behind so many code points.

    No or a negative number of code points has no tokens, more than there are give the whole text; an unknown key gives null.
    """
    sizes = stored.filter("block = 0").select(F.col(key).alias("_key"), F.col("n_chars").alias("_n"))
    placed = asked.join(sizes, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    placed = placed.withColumn("_end", F.greatest(F.least(F.col(chars), F.col("_n")), F.lit(0)))
    blocks = stored.select(F.col(key).alias("_key"), F.col("block").alias("_block"), "counts")
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.expr(f"greatest(_end - 1, 0) div {block}") == F.col("_block"))
    found = placed.join(blocks, same, "left")
    said = F.when(F.col("_end") == 0, F.lit(0)).otherwise(F.get("counts", F.expr(f"int((_end - 1) % {block})")))
    return found.select(*(column(asked, c) for c in asked.columns), said.cast("long").alias("n_tokens"))


def longest_within(stored: DataFrame, budget: int, key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(key, fits_chars): code points of each text's longest prefix of at most ``budget`` tokens.

    Counts may fall as a prefix grows, so the last fitting place counts, not the first that is too long.
    """
    fits = F.array_max(F.transform("counts", lambda n, i: F.when(n <= budget, i + 1)))
    last = F.when(F.col("least") <= budget, F.col("block") * block + F.coalesce(fits, F.lit(0)))
    return stored.groupBy(key).agg(F.coalesce(F.max(last), F.lit(0)).cast("long").alias("fits_chars"))
