"""Queries on samples, splits and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from textgauge.catalog.base import (
    SAMPLE_HASH,
    SPLIT_HASH,
    TENTH,
    byte_docs,
    query,
    saved,
    table,
)
from textgauge.functions import windows
from textgauge.operators import chunking, ladder, leakage, sampling, splitting
from textgauge.plans import evaluate
from textgauge.sources import corpus
from textgauge.session import shared_dir
from textgauge.sources import chunks as chunk_files


@query(
    f"""
    SELECT doc_id, lang FROM documents
    QUALIFY row_number() OVER (ORDER BY {SAMPLE_HASH})
            <= greatest((SELECT floor(count(*) * 0.25::DOUBLE) FROM documents), 1)"""
)
def subsample_docs(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang")
    return sampling.subsample(df, 0.25, ["doc_id"])


@query(
    """
    SELECT o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (ORDER BY md5(concat('7:sample:', o_orderkey)))
            <= greatest((SELECT floor(count(*) * 0.5::DOUBLE) FROM orders), 1)"""
)
def subsample_orders(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return sampling.subsample(df, 0.5, ["o_orderkey"], seed=7)


@query(
    f"""
    WITH w AS (SELECT doc_id, unnest(range(0, (strlen(text) - 128) // 128 + 1)) AS i
               FROM documents WHERE strlen(text) >= 128)
    SELECT doc_id, i::INT AS chunk_idx FROM w
    QUALIFY row_number() OVER (ORDER BY md5(concat('42:sample:', doc_id, ':', i)))
            <= greatest((SELECT floor(count(*) * 0.1::DOUBLE) FROM w), 1)"""
)
def subsample_chunks(spark, sf):
    path, _ = chunk_files.write_chunks(
        chunking.chunk(byte_docs(spark, sf), 128),
        shared_dir(spark, "chunks"),
        tokenizer="bytes",
        max_length=128,
        stride=128,
    )
    saved = chunk_files.read_chunks(spark, path)
    return sampling.subsample(saved, 0.1, ["doc_id", "chunk_idx"]).select("doc_id", "chunk_idx")


@query(
    f"""
    SELECT doc_id, CASE WHEN substr({SPLIT_HASH}, 1, 8) < {TENTH} THEN 'test' ELSE 'train' END AS split
    FROM documents"""
)
def split_train_test(spark, sf):
    return splitting.split(table(spark, sf, "documents").select("doc_id"), ["doc_id"])


@query(
    f"""
    SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {SPLIT_HASH})
                             <= ceil((SELECT count(*) FROM documents) * 0.1::DOUBLE)
                        THEN 'test' ELSE 'train' END AS split
    FROM documents"""
)
def split_exact(spark, sf):
    df = table(spark, sf, "documents").select("doc_id")
    return splitting.split(df, ["doc_id"], exact=True)


@query(
    f"""
    WITH s AS (SELECT substr({SPLIT_HASH}, 1, 8) < {TENTH} AS t FROM documents)
    SELECT count(*) FILTER (NOT t) AS train_rows,
           count(*) FILTER (NOT t) * 100.0::DOUBLE / greatest(count(*), 1) AS train_pct,
           count(*) FILTER (t) AS test_rows,
           count(*) FILTER (t) * 100.0::DOUBLE / greatest(count(*), 1) AS test_pct
    FROM s"""
)
def split_profile(spark, sf):
    return splitting.split_profile(split_train_test(spark, sf))


def _byte_chunk_keys(spark, sf):
    """Chunk keys from text lengths alone."""
    n = windows.window_count(F.octet_length("text"), 128, 64)
    df = table(spark, sf, "documents").select("doc_id", F.when(n > 0, F.sequence(F.lit(0), n - 1)).alias("i"))
    return df.select("doc_id", F.explode("i").alias("chunk_idx"))


@query(
    f"""
    WITH w AS (SELECT doc_id, unnest(range(0, (strlen(text) - 128) // 64 + 1)) AS i
               FROM documents WHERE strlen(text) >= 128),
    s AS (SELECT doc_id, substr(md5(concat('42:split:', doc_id, ':', i)), 1, 8) < {TENTH} AS t FROM w),
    d AS (SELECT doc_id, bool_or(t) AS b, bool_or(NOT t) AS a FROM s GROUP BY doc_id)
    SELECT count(*) FILTER (a AND NOT b) AS train_only, count(*) FILTER (b AND NOT a) AS test_only,
           count(*) FILTER (a AND b) AS on_both
    FROM d"""
)
def split_overlap(spark, sf):
    both = splitting.split(_byte_chunk_keys(spark, sf), ["doc_id", "chunk_idx"], unit="chunk")
    train, test = (both.filter(F.col("split") == side) for side in ("train", "test"))
    return splitting.split_overlap(train, test, ["doc_id"])


@query(
    f"""
    WITH w AS (SELECT doc_id, unnest(range(0, (strlen(text) - 128) // 64 + 1)) AS i
               FROM documents WHERE strlen(text) >= 128),
    s AS (SELECT doc_id, i, substr(md5(concat('42:split:', doc_id, ':', i)), 1, 8) < {TENTH} AS t FROM w)
    SELECT doc_id, i::INT AS chunk_idx FROM s
    WHERE t AND doc_id IN (SELECT doc_id FROM s WHERE NOT t)"""
)
def leaked_rows(spark, sf):
    both = splitting.split(_byte_chunk_keys(spark, sf), ["doc_id", "chunk_idx"], unit="chunk")
    train, test = (both.filter(F.col("split") == side) for side in ("train", "test"))
    return splitting.leaked_rows(train, test, ["doc_id"]).select("doc_id", "chunk_idx")


STRADDLE_SQL = f"""
    w AS (SELECT doc_id, unnest(range(0, (strlen(text) - 128) // 64 + 1)) AS i
          FROM documents WHERE strlen(text) >= 128),
    s AS (SELECT doc_id, i * 64 AS a, CASE WHEN substr(md5(concat('42:split:', doc_id, ':', i)), 1, 8) < {TENTH}
                                           THEN 'test' ELSE 'train' END AS side FROM w)"""


@query(
    f"""
    WITH {STRADDLE_SQL},
    o AS (SELECT x.side, x.doc_id, x.a, count(y.a) AS pairs
          FROM s x LEFT JOIN s y ON y.doc_id = x.doc_id AND y.side <> x.side AND abs(y.a - x.a) < 128 GROUP BY ALL),
    -- the positions of each side, one by one
    p AS (SELECT side, doc_id, a, a + unnest(range(128)) AS pos FROM s),
    q AS (SELECT DISTINCT side, doc_id, pos FROM p),
    t AS (SELECT p.side, count(*) AS leaked_tokens
          FROM p JOIN q ON q.doc_id = p.doc_id AND q.pos = p.pos AND q.side <> p.side GROUP BY 1)
    SELECT side, count(*) AS windows, count(*) FILTER (pairs > 0) AS leaking_windows, sum(pairs)::BIGINT AS pairs,
           coalesce(any_value(leaked_tokens), 0) AS leaked_tokens
    FROM o LEFT JOIN t USING (side) GROUP BY side"""
)
def window_leakage(spark, sf):
    """Byte windows of 128 with stride 64, split one by one."""
    keys = _byte_chunk_keys(spark, sf)
    both = splitting.split(keys, ["doc_id", "chunk_idx"], unit="chunk").withColumn("start", F.col("chunk_idx") * 64)
    train, test = (both.filter(F.col("split") == side) for side in ("train", "test"))
    return leakage.window_leakage(train, test, 128)


@query(
    f"""
    WITH {STRADDLE_SQL},
    p AS (SELECT side, doc_id, a, a + unnest(range(128)) AS pos FROM s),
    q AS (SELECT DISTINCT side, doc_id, pos FROM p),
    t AS (SELECT p.side, p.doc_id, p.a, count(*) AS shared_tokens
          FROM p JOIN q ON q.doc_id = p.doc_id AND q.pos = p.pos AND q.side <> p.side GROUP BY ALL),
    n AS (SELECT x.side, x.doc_id, x.a, count(*) AS pairs
          FROM s x JOIN s y ON y.doc_id = x.doc_id AND y.side <> x.side AND abs(y.a - x.a) < 128 GROUP BY ALL)
    SELECT doc_id, a::BIGINT AS start, pairs, shared_tokens FROM n JOIN t USING (side, doc_id, a) WHERE side = 'test'"""
)
def leaking_windows(spark, sf):
    keys = _byte_chunk_keys(spark, sf)
    both = splitting.split(keys, ["doc_id", "chunk_idx"], unit="chunk").withColumn("start", F.col("chunk_idx") * 64)
    train, test = (both.filter(F.col("split") == side) for side in ("train", "test"))
    found = leakage.window_overlaps(train, test, 128).filter(F.col("side") == "test")
    return found.select("doc_id", "start", "pairs", "shared_tokens")


@query(
    """
    SELECT lang, m.name AS model_name, f.f AS data_fraction, s.seed::INT AS seed,
           ((m.i * 6 + f.i) * 3 + s.i)::INT AS run_idx,
           greatest(floor(docs * f.f), 1)::BIGINT AS subset_docs
    FROM (SELECT lang, count(*) AS docs FROM documents GROUP BY lang),
         (VALUES (0, 'gpt2'), (1, 'distilgpt2'), (2, 'gpt2-medium')) AS m(i, name),
         (VALUES (0, 0.01::DOUBLE), (1, 0.05::DOUBLE), (2, 0.10::DOUBLE), (3, 0.25::DOUBLE),
                 (4, 0.50::DOUBLE), (5, 1.0::DOUBLE)) AS f(i, f),
         (VALUES (0, 42), (1, 123), (2, 456)) AS s(i, seed)"""
)
def run_grid(spark, sf):
    per_lang = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    size = F.greatest(F.floor(F.col("docs") * F.col("data_fraction")), F.lit(1))
    return ladder.with_run_grid(per_lang).withColumn("subset_docs", size).drop("docs")


LADDER_SQL = """
    d AS (SELECT doc_id, strlen(text) AS tokens,
                 CASE WHEN strlen(text) >= 256 THEN (strlen(text) - 256) // 200 + 1 ELSE 0 END AS chunks
          FROM documents),
    r AS (SELECT seed, doc_id, tokens, chunks,
                 row_number() OVER (PARTITION BY seed ORDER BY md5(concat(seed, ':sample:', doc_id))) AS rn
          FROM d, (VALUES (42), (123), (456)) AS s(seed)),
    ladder AS (
      SELECT seed::INT AS seed, fraction, count(*) AS docs, sum(tokens)::BIGINT AS tokens,
             sum(chunks)::BIGINT AS chunks
      FROM r, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) AS f(fraction)
      WHERE rn <= greatest(floor((SELECT count(*) FROM d) * fraction), 1)
      GROUP BY ALL)"""


def _ladder(spark, sf):
    df = corpus.read_corpus(spark, f"{sf}/documents.parquet").select(
        "doc_id",
        F.octet_length("text").alias("tokens"),
        windows.window_count(F.octet_length("text"), 256, 200).alias("chunks"),
    )
    return ladder.fraction_ladder(df, (0.1, 0.5, 1.0), ladder.SEEDS, ["doc_id"], ["tokens", "chunks"])


@query(f"WITH {LADDER_SQL} SELECT * FROM ladder")
def fraction_ladder(spark, sf):
    return _ladder(spark, sf)


@query(
    f"""
    WITH {LADDER_SQL}
    SELECT seed, fraction, docs, tokens, chunks, tier, batch::INT AS effective_batch,
           (ceil(chunks / batch::DOUBLE) * 3)::BIGINT AS steps, chunks * 768 AS train_tokens
    FROM ladder, (VALUES ('low_vram', 4 * 4 * 2), ('high_throughput', 16 * 1 * 2),
                         ('default', 8 * 2 * 2)) AS t(tier, batch)"""
)
def run_budget(spark, sf):
    return ladder.run_budget(_ladder(spark, sf), 256, world=2)


@query(
    """
    WITH w AS (SELECT doc_id, unnest(range(0, (strlen(text) - 128) // 128 + 1)) AS i
               FROM documents WHERE strlen(text) >= 128),
    s AS (SELECT doc_id, i FROM w
          QUALIFY row_number() OVER (ORDER BY md5(concat('42:sample:', doc_id, ':', i)))
                  <= greatest((SELECT floor(count(*) * 0.5::DOUBLE) FROM w), 1))
    SELECT doc_id, i::INT AS chunk_idx,
           CASE WHEN row_number() OVER (ORDER BY md5(concat('42:split:', doc_id, ':', i)))
                     <= ceil((SELECT count(*) FROM s) * 0.1::DOUBLE) THEN 'test' ELSE 'train' END AS split
    FROM s"""
)
def load_and_split(spark, sf):
    path, _ = chunk_files.write_chunks(
        chunking.chunk(byte_docs(spark, sf), 128),
        shared_dir(spark, "chunks"),
        tokenizer="bytes",
        max_length=128,
        stride=128,
    )
    sides, _ = evaluate.load_and_split(spark, path, 0.5)
    return sides.select("doc_id", "chunk_idx", "split")
