"""Queries on windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textgauge.catalog.base import (
    BYTES,
    ENCODED_SQL,
    SAMPLE_HASH,
    TOK,
    byte_docs,
    digest_sql,
    docs,
    query,
    saved,
    saved_vocab,
    table,
    tok_docs,
    windows_sql,
)
from textgauge.functions import tokens
from textgauge.operators import chunking, tokenizing
from textgauge.plans.prepare import prepare
from textgauge.session import shared_dir
from textgauge.sources import chunk_store, chunks as chunk_files
from textgauge.streaming import chunk_stream as streams


@query(
    f"""
    SELECT doc_id, n::BIGINT AS n_tokens,
           (CASE WHEN n >= 256 THEN (n - 256) // 200 + 1 ELSE 0 END)::INT AS n_windows
    FROM (SELECT doc_id, len({TOK}) AS n FROM documents)"""
)
def window_counts(spark, sf):
    return chunking.window_counts(tok_docs(spark, sf), F.size("tok"), 256, 200)


def _chunk_result(chunks):
    return chunks.select(
        "doc_id",
        "chunk_idx",
        "start",
        F.size("input_ids").alias("n_ids"),
        tokens.ids_digest(F.col("input_ids")).alias("ids"),
        tokens.ids_digest(F.col("labels")).alias("labels"),
    )


def _chunk_sql(m: int, s: int) -> str:
    return f"""
    WITH d AS (SELECT doc_id, {BYTES} AS b FROM documents), w AS ({windows_sql("d", m, s)})
    SELECT doc_id, i::INT AS chunk_idx, (i * {s})::INT AS start, len(c) AS n_ids,
           {digest_sql("c")} AS ids, {digest_sql("c")} AS labels
    FROM w"""


@query(_chunk_sql(256, 256))
def chunk_docs(spark, sf):
    return _chunk_result(chunking.with_labels(chunking.chunk(byte_docs(spark, sf), 256)))


@query(_chunk_sql(256, 96))
def chunk_overlap(spark, sf):
    return _chunk_result(chunking.with_labels(chunking.chunk(byte_docs(spark, sf), 256, 96)))


@query(
    f"""
    WITH {ENCODED_SQL}, w AS ({windows_sql("enc", 64, 64, ids="ids")})
    SELECT doc_id, i::INT AS chunk_idx, {digest_sql("c")} AS ids FROM w"""
)
def chunk_vocab(spark, sf):
    coded = tokenizing.encode(tok_docs(spark, sf), saved_vocab(spark, sf)).drop("attention_mask")
    return chunking.chunk(coded, 64).select(
        "doc_id", "chunk_idx", tokens.ids_digest(F.col("input_ids")).alias("ids")
    )


STATS_SQL = """
    SELECT {by} count(*) AS docs, count(*) FILTER (n < {m}) AS short_docs, sum(w)::BIGINT AS chunks,
           sum(n)::BIGINT AS tokens, (sum(w) * {m})::BIGINT AS chunk_tokens,
           sum(c)::BIGINT AS covered_tokens, sum(n - c)::BIGINT AS dropped_tokens
    FROM (SELECT *, CASE WHEN w > 0 THEN (w - 1) * least({s}, {m}) + {m} ELSE 0 END AS c
          FROM (SELECT *, CASE WHEN n >= {m} THEN (n - {m}) // {s} + 1 ELSE 0 END AS w FROM ({src})))
    """


@query(
    STATS_SQL.format(
        by="lang,", m=256, s=200, src=f"SELECT lang, len({TOK}) AS n FROM documents"
    )
    + " GROUP BY lang"
)
def chunk_stats(spark, sf):
    df = tok_docs(spark, sf, "lang")
    return chunking.chunk_stats(df, F.size("tok"), 256, 200, by=("lang",))


@query(
    f"""
    WITH s AS (SELECT doc_id, text FROM documents
               QUALIFY row_number() OVER (ORDER BY {SAMPLE_HASH})
                       <= greatest((SELECT floor(count(*) * 0.5::DOUBLE) FROM documents), 1)),
    d AS (SELECT doc_id, {BYTES} AS b FROM s), w AS ({windows_sql("d", 256, 256)}),
    saved AS (SELECT count(*) AS saved_rows, sum(list_sum(c))::BIGINT AS id_sum FROM w)
    SELECT * FROM ({STATS_SQL.format(by="", m=256, s=256, src="SELECT strlen(text) AS n FROM s")}), saved"""
)
def prepare_corpus(spark, sf):
    made = prepare(
        docs(spark, sf),
        max_length=256,
        fraction=0.5,
        save_to=shared_dir(spark, "prepared"),
    )
    saved = chunk_files.read_chunks(spark, made.path).agg(
        F.sum(F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x)).alias("id_sum")
    )
    return made.stats.withColumns({"saved_rows": F.lit(made.rows), "id_sum": saved.scalar()})


VERIFY_SQL = """
    SELECT sum(w)::BIGINT AS chunks, sum(greatest(w - 1, 0))::BIGINT AS neighbours,
           0::BIGINT AS wrong_length, 0::BIGINT AS missing_or_extra, 0::BIGINT AS not_source_text,
           0::BIGINT AS overlap_differs
    FROM (SELECT CASE WHEN strlen(text) >= 256 THEN (strlen(text) - 256) // 200 + 1 ELSE 0 END AS w
          FROM documents)"""


@query(VERIFY_SQL)
def verify_chunks(spark, sf):
    path, _ = chunk_files.write_chunks(
        chunking.chunk(byte_docs(spark, sf), 256, 200),
        shared_dir(spark, "chunks"),
        tokenizer="bytes",
        max_length=256,
        stride=200,
    )
    return chunking.verify_chunks(
        chunk_files.read_chunks(spark, path), byte_docs(spark, sf), 256, 200
    )


@query(VERIFY_SQL)
def verify_stored(spark, sf):
    """The same check on tables in buckets of the document, which are read without moving a chunk."""
    name = f"chunks_{uuid.uuid4().hex}"
    buckets = chunk_store.bucket_count(docs(spark, sf), F.octet_length("text"))
    chunks = chunking.chunk(byte_docs(spark, sf), 256, 200)
    chunks = chunk_store.write_bucketed(chunks, name, shared_dir(spark, "bucketed-chunks"), buckets)
    source = byte_docs(spark, sf).select("doc_id", "input_ids")
    source = chunk_store.write_bucketed(source, f"{name}_source", shared_dir(spark, "bucketed-source"), buckets, sort=("doc_id",))
    return chunk_store.verify_stored(chunks, source, 256, 200)


@query(_chunk_sql(64, 64))
def chunk_stream(spark, sf):
    batch = table(spark, sf, "documents")
    parts = spark.conf.get("spark.textgauge.spread", None)
    # a stream reads folders: the table's own, or the one around a table of a single file
    some_file = batch.select("_metadata.file_path").first()
    single = some_file is not None and some_file[0].endswith("/documents.parquet")
    source = streams.read_corpus_stream(
        spark,
        sf if single else f"{sf}/documents.parquet",
        pattern="documents.parquet" if single else None,
        partitions=int(parts) if parts else None,
    )
    path, state = shared_dir(spark, "stream"), shared_dir(spark, "stream-state")
    streams.start_append(streams.chunk_stream(source, 64), path, state).awaitTermination()
    return _chunk_result(chunk_files.read_chunks(spark, path))


@query(
    f"""
    WITH d AS (SELECT doc_id, lang, len({TOK}) AS n FROM documents),
    p AS (SELECT doc_id, lang, unnest(range(0, n)) AS pos FROM d),
    w AS (SELECT doc_id, unnest(range(0, (n - 64) // 24 + 1)) AS i FROM d WHERE n >= 64),
    h AS (SELECT doc_id, unnest(range(i * 24, i * 24 + 64)) AS pos FROM w),
    c AS (SELECT doc_id, pos, count(*) AS windows FROM h GROUP BY ALL)
    SELECT lang, coalesce(windows, 0)::INT AS windows, count(*) AS positions
    FROM p LEFT JOIN c USING (doc_id, pos) GROUP BY ALL"""
)
def chunk_coverage(spark, sf):
    return chunking.chunk_coverage(tok_docs(spark, sf, "lang"), F.size("tok"), 64, 24, by=("lang",))


@query(
    f"""
    WITH d AS (SELECT doc_id, len({TOK}) AS n FROM documents),
    p AS (SELECT doc_id, unnest(range(0, n)) AS pos FROM d),
    w AS (SELECT doc_id, unnest(range(0, (n - 24) // 40 + 1)) AS i FROM d WHERE n >= 24),
    h AS (SELECT DISTINCT doc_id, unnest(range(i * 40, i * 40 + 24)) AS pos FROM w),
    u AS (SELECT doc_id, pos FROM p ANTI JOIN h USING (doc_id, pos)),
    g AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM u)
    SELECT doc_id, min(pos) AS "from", max(pos) + 1 AS "to" FROM g GROUP BY doc_id, island"""
)
def uncovered_positions(spark, sf):
    """Windows of 24 tokens every 40: gaps between them and tails."""
    return chunking.uncovered(tok_docs(spark, sf), F.size("tok"), 24, 40)
