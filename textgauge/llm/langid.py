"""Language identification by nearest centroid.

A text's letters, lower-cased, with every run of other characters as one space, give counts of
character n-grams (one to three), hashed to a fixed number of buckets. Weighted by TF-IDF and scaled to
length one, they are compared by cosine with several centroids per language; the language of the
nearest centroid wins, the first by name on a tie. A text that is farther from its centroid than a
distance learned for texts of its language and size is marked as rejected.

The distances come from the sample: of each language a fifth at a time is compared with centroids of the
other four, whole and as its first ``PIECES`` characters. Per number of distinct n-grams, in powers of two,
``SLACK`` of a low quantile of these cosines is the least that a text may have. Between
two powers it goes up in a line, reached at the upper one. Sizes with fewer than ``LEAST`` comparisons take
what the next smaller size has; below the smallest, only ``max_distance`` counts.

Fitting takes a bounded sample, at most ``per_language`` texts of each language, those with the smallest
text hashes; the bound is a parameter. Clusters are found per language on the executors. The model that
the tasks get holds ``languages * clusters * BUCKETS`` numbers and does not grow with the corpus.

Defined results: ``und``, score 0 and rejected for a null text, a text without a letter, and any text
if there was nothing to learn from. Null labels and null texts are not learned from. Copies of a text
count once in the sample. Other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from textgauge.llm.common import checked, column, cut_batches, fresh, saved

BUCKETS = 1 << 13
#: Characters whose n-grams are counted together.
BLOCK = 250_000
#: Texts whose counts are held together as rows of BUCKETS numbers.
BLOCK_TEXTS = 128
UNKNOWN = "und"
#: Characters of the beginnings that rejection is learned from, besides whole texts.
PIECES = (25, 50, 100, 200, 400)
FOLDS = 5
LEAST = 40
QUANTILE = 0.005
SLACK = 0.55
#: Sizes by powers of two of distinct n-grams.
SIZES = BUCKETS.bit_length()


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """Code point to lower-case letter; a space for all that is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def _codes(text: str) -> np.ndarray:
    return _lower()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _add(counts: np.ndarray, codes: np.ndarray, rows: np.ndarray, start: int) -> None:
    """Count the n-grams that end at or after ``start`` and lie in one row."""
    wide = codes.astype(np.uint64)
    h = np.zeros(len(wide), np.uint64)
    for k, factor in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)):
        h[k:] += wide[: len(wide) - k] * np.uint64(factor)
        ends = np.arange(max(start, k), len(wide))
        ends = ends[(rows[ends - k] == rows[ends]) & ((codes[ends] != 32) | (codes[ends - k] != 32))]
        x = h[ends] + np.uint64(k)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        at = rows[ends] * BUCKETS + (x >> np.uint64(51)).astype(np.int64)
        counts += np.bincount(at, minlength=counts.size)


def _collapsed(codes: np.ndarray) -> np.ndarray:
    return (codes != 32) | (np.concatenate([[0], codes[:-1]]) != 32)


def count_ngrams(texts: list[str]) -> np.ndarray:
    """Counts of hashed n-grams, a row for each text."""
    out = np.zeros(len(texts) * BUCKETS, np.float32)
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) <= BLOCK):
            size += len(texts[stop])
            stop += 1
        own = out[start * BUCKETS : stop * BUCKETS]
        if stop == start + 1:
            last = np.array([32], np.uint32)
            for i in range(0, len(texts[start]) + 1, BLOCK):
                ending = i + BLOCK > len(texts[start])
                codes = np.concatenate([last, _codes(texts[start][i : i + BLOCK] + " " * ending)])
                codes = codes[_collapsed(codes)]
                _add(own, codes, np.zeros(len(codes), np.int64), len(last) * (i > 0))
                last = codes[-2:]
        else:
            parts = texts[start:stop]
            codes = _codes(" " + "  ".join(parts) + " ")
            rows = np.repeat(np.arange(len(parts)), [len(p) + 2 for p in parts])
            keep = _collapsed(codes) | (np.diff(rows, prepend=0) > 0)
            _add(own, codes[keep], rows[keep], 0)
        start = stop
    return out.reshape(len(texts), BUCKETS)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    made = np.log1p(counts, dtype=np.float32)
    made *= idf
    made /= np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)
    return made


def _dense(at: list[np.ndarray], n: list[np.ndarray]) -> np.ndarray:
    """Rows of counts from the numbers of their buckets and what these hold."""
    made = np.zeros((len(at), BUCKETS), np.float32)
    for row, a, b in zip(made, at, n):
        row[a] = b
    return made


def cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart starts; the result depends on the set of rows alone."""
    vectors = vectors[np.lexsort(vectors.T[:8])]
    centers = [vectors.mean(axis=0)]
    centers[0] /= max(np.linalg.norm(centers[0]), 1e-12)
    near = vectors @ centers[0]
    for _ in range(min(k, len(vectors)) - 1):
        centers.append(vectors[near.argmin()])
        near = np.maximum(near, vectors @ centers[-1])
    made = np.array(centers)
    for _ in range(rounds):
        own = (vectors @ made.T).argmax(axis=1)
        for j in range(len(made)):
            if (own == j).any():
                made[j] = vectors[own == j].mean(axis=0)
                made[j] /= max(np.linalg.norm(made[j]), 1e-12)
    return made


def _size(distinct: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(distinct, 1))


def floors(cosine: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The least cosine for each size, from those of clean texts; 0 where too few are as small."""
    made = np.zeros(SIZES)
    for i in range(SIZES):
        own = cosine[size.astype(np.int64) == i]
        made[i] = SLACK * np.quantile(own, QUANTILE) if len(own) >= LEAST else made[i - 1] if i else 0
    return made


@dataclass(frozen=True)
class Languages:
    """Sorted names, the row of each centroid's language, the centroids, the weights of n-grams and, for each
    language, the least cosine by size."""

    names: tuple[str, ...]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and the least cosine of a text of that language and size."""
        names, scores, least = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        for i in range(0, len(texts), BLOCK_TEXTS):
            counts = count_ngrams(texts[i : i + BLOCK_TEXTS])
            some = np.nonzero(counts.any(axis=1))[0]
            if len(some) and self.names:
                cosine = _vectors(counts[some], self.idf) @ self.centroids.T
                best = cosine.argmax(axis=1)
                scores[some + i] = np.clip(cosine[np.arange(len(some)), best], 0, 1)
                size = _size((counts[some] > 0).sum(axis=1))
                at, owner = size.astype(np.int64), self.owner[best]
                below = np.where(at > 0, self.floors[owner, at - 1], 0)
                least[some + i] = below + (size - at) * (self.floors[owner, at] - below)
                for row, name in zip(some + i, self.owner[best]):
                    names[row] = self.names[name]
        return names, scores, least


def fit(
    docs: DataFrame, lang: str = "lang", text: str = "text", per_language: int = 500, clusters: int = 4
) -> Languages:
    """Learn from at most ``per_language`` labelled texts of each language."""
    rows = docs.select(column(docs, lang).cast("string").alias("lang"), column(docs, text).alias("text"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("h", F.xxhash64("text"))
    # a cut on the hash leaves a few times as many texts as wanted, so that no task ranks a whole language
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("texts"))
    share = F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.col("texts"))
    cut = saved(sizes.select("lang", (share * (1 << 31)).alias("cut")), "language-sizes")
    near = rows.join(checked(cut), "lang").filter(F.pmod("h", F.lit(1 << 31)) <= F.col("cut"))
    near = near.groupBy("lang", "h").agg(F.first("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 31)), "h")
    chosen = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (part.slice(k, BLOCK_TEXTS) for part in cut_batches(whole, 1) for k in range(0, part.num_rows, BLOCK_TEXTS)):
                texts = batch.column(1).to_pylist()
                for piece in (0, *PIECES):
                    rows = [i for i, t in enumerate(texts) if not piece or len(t) > piece]
                    counts = count_ngrams([texts[i][: piece or None] for i in rows])
                    there = [np.nonzero(c)[0] for c in counts]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(rows, pa.int64())),
                            batch.column(2).take(pa.array(rows, pa.int64())),
                            pa.array([not piece] * len(rows), pa.bool_()),
                            pa.array([t.astype(np.int32) for t in there], pa.list_(pa.int32())),
                            pa.array([c[t] for c, t in zip(counts, there)], pa.list_(pa.float32())),
                        ],
                        names=["lang", "h", "whole", "at", "n"],
                    )

    shape = "lang string, h long, whole boolean, at array<int>, n array<float>"
    sample = chosen.select("lang", "text", "h").mapInArrow(count, shape)
    sample = saved(sample.filter("size(at) > 0"), "language-sample")
    texts = sample.filter("whole")
    total = texts.count()
    idf = np.zeros(BUCKETS)
    for r in texts.select(F.explode("at").alias("b")).groupBy("b").count().collect():  # BUCKETS rows at most
        idf[r.b] = np.log((1 + total) / (1 + r["count"])) + 1
    names: list[str] = []

    weight = idf.astype(np.float32)

    def centers(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["h", "whole"], ignore_index=True)
        whole, at, n = pdf["whole"].to_numpy(), pdf["at"], pdf["n"]
        fold = (pdf["h"].rank(method="dense").to_numpy().astype(np.int64) - 1) % FOLDS
        learn = np.flatnonzero(whole)
        vectors = _vectors(_dense(at[learn], n[learn]), weight)  # per_language rows at most
        cosine, known = np.zeros(len(pdf)), np.zeros(len(pdf), bool)
        for i in range(FOLDS):
            out, rest = np.flatnonzero(fold == i), fold[learn] != i
            if not (len(out) and rest.any()):
                continue
            others = cluster(vectors[rest], clusters).T
            for k in range(0, len(out), BLOCK_TEXTS):
                own = out[k : k + BLOCK_TEXTS]
                cosine[own] = (_vectors(_dense(at[own], n[own]), weight) @ others).max(axis=1)
            known[out] = True
        least = floors(cosine[known], _size(at[known].map(len).to_numpy()))
        made = cluster(vectors, clusters)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "center": list(made), "floors": [least] * len(made)})

    shape = "lang string, center array<float>, floors array<double>"
    found = sample.groupBy("lang").applyInPandas(centers, shape).collect()
    found.sort(key=lambda r: (r.lang, r.center))
    names = sorted({r.lang for r in found})
    return Languages(
        tuple(names),
        np.array([names.index(r.lang) for r in found], np.int64),
        np.array([r.center for r in found], np.float32).reshape(-1, BUCKETS),
        weight,
        np.array([next(r.floors for r in found if r.lang == n) for n in names]).reshape(-1, SIZES),
    )


def identify(
    docs: DataFrame,
    model: Languages,
    text: str = "text",
    pred: str = "lang_pred",
    score: str = "score",
    rejected: str = "rejected",
    max_distance: float = 0.95,
) -> DataFrame:
    """``docs`` with language, cosine and whether the nearest centroid is farther than the learned distance
    for the language and size of the text, or than ``max_distance``.

    New columns replace those of the same names.
    """
    new = (pred, score, rejected)
    held = [c for c in docs.columns if c not in new]
    base = docs.select(*(column(docs, c) for c in held))
    own = fresh(base, "_text")
    base = base.withColumn(own, column(docs, text))
    at = len(held)

    def run(batches):
        for whole in batches:
            for batch in cut_batches(whole, at):
                names, scores, least = model.predict([t or "" for t in batch.column(at).to_pylist()])
                far = [n == UNKNOWN or 1 - s > max_distance or s < f for n, s, f in zip(names, scores, least)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:at], pa.array(names, pa.string()), pa.array(scores), pa.array(far, pa.bool_())],
                    names=[*held, *new],
                )

    kinds = (StringType(), DoubleType(), BooleanType())
    schema = StructType([docs.schema[c] for c in held] + [StructField(*x) for x in zip(new, kinds)])
    return base.mapInArrow(run, schema)
