"""Queries on tokenizers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from textgauge.catalog.base import (
    BYTES,
    ENCODED_SQL,
    TOK,
    VOCAB_SQL,
    byte_docs,
    digest_sql,
    docs,
    query,
    r6,
    saved,
    saved_vocab,
    tok_docs,
)
from textgauge.functions import tokens
from textgauge.operators import bpe, profiles, scoring, tokenizing
from textgauge.session import shared_dir


@query(
    f"""
    SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, '|')) AS tokens,
           (array_to_string(t, '') = text)::INT AS lossless
    FROM (SELECT doc_id, text, {TOK} AS t FROM documents)"""
)
def pretokens(spark, sf):
    df = tokenizing.pretokenize(docs(spark, sf), lookahead=False)
    return df.select(
        "doc_id",
        F.size("tok").alias("n_tokens"),
        F.md5(F.array_join("tok", "|").cast("binary")).alias("tokens"),
        (F.array_join("tok", "") == F.col("text")).cast("int").alias("lossless"),
    )


# The look-ahead of the full pattern for an engine that has none: a mark before the last blank of every
# run of several that precedes other text, then the short pattern between the marks.
FULL_TOK = (
    r"flatten(list_transform(string_split(regexp_replace(text, '(\s)(\s\S)', '\1' || chr(1) || '\2', 'g'), "
    rf"chr(1)), lambda part: {TOK.replace('(text,', '(part,')}))"
)


@query(
    f"""
    SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, '|')) AS tokens
    FROM (SELECT doc_id, {FULL_TOK} AS t
          FROM (SELECT doc_id, replace(text, ' ', '  ') || E'\n \t' || text AS text FROM documents))"""
)
def pretokens_full(spark, sf):
    """The published pattern, over texts with runs of blanks."""
    wide = F.concat(F.replace("text", F.lit(" "), F.lit("  ")), F.lit("\n \t"), "text")
    df = tokenizing.pretokenize(docs(spark, sf).withColumn("text", wide))
    return df.select(
        "doc_id",
        F.size("tok").alias("n_tokens"),
        F.md5(F.array_join("tok", "|").cast("binary")).alias("tokens"),
    )


@query(f"SELECT doc_id, len(b) AS n_ids, {digest_sql('b')} AS ids FROM (SELECT doc_id, {BYTES} AS b FROM documents)")
def byte_tokens(spark, sf):
    return byte_docs(spark, sf).select(
        "doc_id",
        F.size("input_ids").alias("n_ids"),
        tokens.ids_digest(F.col("input_ids")).alias("ids"),
    )


@query(
    f"""
    WITH {VOCAB_SQL}
    SELECT 0 AS id, '<unk>' AS token, 0::BIGINT AS count
    UNION ALL SELECT 1, '<|endoftext|>', 0 UNION ALL SELECT id, token, n FROM vocab"""
)
def vocab_topk(spark, sf):
    return tokenizing.build_vocab(tok_docs(spark, sf), 5000)


@query(
    f"""
    WITH {VOCAB_SQL}
    SELECT count(*) + 2 AS vocab_size, 0 AS unk_id, 1 AS eos_id, 1 AS pad_id FROM vocab"""
)
def vocab_report(spark, sf):
    return tokenizing.vocab_report(saved_vocab(spark, sf))


ENCODED_RESULT = f"""
    SELECT doc_id, coalesce(len(ids), 0) AS n_ids, {digest_sql("coalesce(ids, [])")} AS ids,
           coalesce(len(ids), 0) AS mask_sum
    FROM documents LEFT JOIN enc USING (doc_id)"""


def _encoded_result(df):
    return df.select(
        "doc_id",
        F.size("input_ids").alias("n_ids"),
        tokens.ids_digest(F.col("input_ids")).alias("ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"),
    )


@query(f"WITH {ENCODED_SQL} {ENCODED_RESULT}")
def encode_ids(spark, sf):
    return _encoded_result(tokenizing.encode(tok_docs(spark, sf), saved_vocab(spark, sf)))


@query(f"WITH {ENCODED_SQL} {ENCODED_RESULT}")
def encode_by_join(spark, sf):
    return _encoded_result(tokenizing.encode_by_join(tok_docs(spark, sf), saved_vocab(spark, sf)))


@query(
    f"""
    WITH {ENCODED_SQL}
    SELECT doc_id, coalesce(len(ids), 0) AS n_ids,
           md5(coalesce((SELECT string_agg(coalesce(v.token, ''), '' ORDER BY p.pos)
                FROM placed p LEFT JOIN vocab v ON v.token = p.token WHERE p.doc_id = d.doc_id), '')) AS text
    FROM documents d LEFT JOIN enc USING (doc_id)"""
)
def decode_roundtrip(spark, sf):
    vocab = saved_vocab(spark, sf)
    coded = tokenizing.encode(tok_docs(spark, sf), vocab)
    back = tokenizing.decode(coded, vocab, skip=(tokenizing.UNK, tokenizing.EOS))
    return back.select(
        "doc_id", F.size("input_ids").alias("n_ids"), F.md5(F.col("text").cast("binary")).alias("text")
    )


@query(
    f"""
    WITH {ENCODED_SQL}
    SELECT doc_id, coalesce(len(ids), 0) AS n_ids,
           md5(coalesce((SELECT string_agg(coalesce(v.token, ''), '' ORDER BY p.pos)
                FROM placed p LEFT JOIN vocab v ON v.token = p.token WHERE p.doc_id = d.doc_id), '')) AS text
    FROM documents d LEFT JOIN enc USING (doc_id)"""
)
def decode_by_join(spark, sf):
    vocab = saved_vocab(spark, sf)
    coded = tokenizing.encode(tok_docs(spark, sf), vocab)
    back = tokenizing.decode_by_join(coded, vocab, skip=(tokenizing.UNK, tokenizing.EOS))
    return back.select(
        "doc_id", F.size("input_ids").alias("n_ids"), F.md5(F.col("text").cast("binary")).alias("text")
    )


@query("SELECT doc_id, md5(text) AS text FROM documents")
def decode_bytes(spark, sf):
    back = tokenizing.byte_detokenize(byte_docs(spark, sf))
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"))


@query(
    f"""
    SELECT lang, count(*) AS docs, sum(n)::BIGINT AS tokens, round(avg(n), 6) AS mean_len,
           quantile_cont(n, 0.25)::DOUBLE AS q25, quantile_cont(n, 0.5)::DOUBLE AS median,
           quantile_cont(n, 0.75)::DOUBLE AS q75, max(n) AS max_len,
           round(count(*) FILTER (n < 256) / count(*)::DOUBLE, 6) AS short_share
    FROM (SELECT lang, len({TOK}) AS n FROM documents) GROUP BY lang"""
)
def token_profile(spark, sf):
    df = tok_docs(spark, sf, "lang")
    out = tokenizing.token_profile(df, F.size("tok"), 256, by=("lang",))
    return out.withColumn("mean_len", r6("mean_len")).withColumn("short_share", r6("short_share"))


# Two levels of byte-pair merges, counted in the corpus: 48 pairs of bytes, then 48 pairs of
# the pieces that these leave. In the SQL a piece is written <hex> and a merge is one replace.
BPE_SQL = f"""
    w AS (SELECT token, count(*) AS n, regexp_replace(hex(encode(token)), '(..)', '<\\1>', 'g') AS s0
          FROM (SELECT unnest({TOK}) AS token FROM documents) GROUP BY token),
    p1 AS (SELECT unnest(q[1:-2]) AS a, unnest(q[2:]) AS b, n
           FROM (SELECT regexp_extract_all(s0, '<[0-9A-F]+>') AS q, n FROM w) WHERE len(q) > 1),
    m1 AS (SELECT a, b, row_number() OVER (ORDER BY sum(n) DESC, a, b) AS r
           FROM p1 GROUP BY a, b QUALIFY r <= 48),
    l1 AS (SELECT list(a || b ORDER BY r) AS f,
                  list(replace(a || b, '><', '') ORDER BY r) AS t FROM m1),
    w1 AS (SELECT token, n, list_reduce(list_prepend(s0, range(1, 49)::VARCHAR[]),
                  lambda s, i: replace(s, f[i::INT], t[i::INT])) AS s1 FROM w, l1),
    p2 AS (SELECT unnest(q[1:-2]) AS a, unnest(q[2:]) AS b, n
           FROM (SELECT regexp_extract_all(s1, '<[0-9A-F]+>') AS q, n FROM w1) WHERE len(q) > 1),
    m2 AS (SELECT a, b, row_number() OVER (ORDER BY sum(n) DESC, a, b) AS r
           FROM p2 WHERE (a, b) NOT IN (SELECT (a, b) FROM m1) GROUP BY a, b QUALIFY r <= 48),
    l2 AS (SELECT list(a || b ORDER BY r) AS f,
                  list(replace(a || b, '><', '') ORDER BY r) AS t FROM m2)"""


def _top_pairs(pieces: DataFrame, k: int) -> list[tuple[str, str]]:
    """The k most frequent neighbour pairs of ``(piece array, n)`` rows, ties in text order."""
    pairs = scoring.shift_pairs(pieces, ids="pieces", keep=("n",))
    best = pairs.groupBy("prev", "next").agg(F.sum("n").alias("n"))
    rows = best.orderBy(F.desc("n"), "prev", "next").limit(k).collect()
    return [(r["prev"], r["next"]) for r in rows]


def _through_files(spark, merges: list[tuple[bytes, bytes]]):
    """Merges and ids written as the usual two files and read back."""
    shown = bpe.printable_bytes()
    name = lambda token: "".join(shown[b] for b in token)
    lines = "\n".join(["#version: 0.2", *(f"{name(a)} {name(b)}" for a, b in merges)])
    entries = json.dumps({name(t): i for t, i in bpe.byte_vocab(merges).items()})
    paths = []
    for text in (lines, entries):
        paths.append(shared_dir(spark, "bpe"))
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(paths[-1])
    return bpe.read_bpe(spark, *paths)


def _merges(words: DataFrame) -> list[tuple[bytes, bytes]]:
    """Merges counted over the distinct pre-tokens ``(tok, n)``."""
    hexed = F.regexp_extract_all(F.hex(F.encode("token", "UTF-8")), F.lit(".."), F.lit(0))
    first = _top_pairs(words.select(hexed.alias("pieces"), "n"), 48)
    merges = [(bytes.fromhex(a), bytes.fromhex(b)) for a, b in first]
    ids = bpe.byte_vocab(merges)
    # written <hex> as in the SQL, so that ties sort the same way
    names = F.array(*[F.lit(f"<{t.hex().upper()}>") for t in ids])
    coded = bpe.bpe_encode(words.select(F.array("token").alias("tok"), "n"), merges)
    pieces = coded.select(F.transform("input_ids", lambda i: F.get(names, i)).alias("pieces"), "n")
    second = [(a[1:-1], b[1:-1]) for a, b in _top_pairs(pieces, 48)]
    return merges + [(bytes.fromhex(a), bytes.fromhex(b)) for a, b in second]


@query(
    f"""
    WITH {BPE_SQL},
    done AS (SELECT token, list_reduce(list_prepend(s1, range(1, 49)::VARCHAR[]),
                lambda s, i: replace(s, f[i::INT], t[i::INT])) AS s2 FROM w1, l2),
    placed AS (SELECT doc_id, unnest(tok) AS token, unnest(range(0, len(tok))) AS pos
               FROM (SELECT doc_id, {TOK} AS tok FROM documents))
    SELECT doc_id, coalesce(sum(len(regexp_extract_all(s2, '<[0-9A-F]+>'))), 0)::BIGINT AS n_ids,
           md5(coalesce(string_agg(s2, '' ORDER BY pos), '')) AS pieces
    FROM documents LEFT JOIN placed USING (doc_id) LEFT JOIN done USING (token) GROUP BY doc_id"""
)
def bpe_pieces(spark, sf):
    df = tok_docs(spark, sf)
    words = tokenizing.token_counts(df).withColumnRenamed("count", "n")
    merges, ids = _through_files(spark, _merges(saved(words, "words")))
    coded = bpe.bpe_encode(df, merges, ids)
    names = [f"<{t.hex().upper()}>" for t in bpe.byte_vocab(merges)]
    vocab = spark.createDataFrame(list(enumerate(names)), "id int, token string")
    back = tokenizing.decode(coded, vocab)
    return back.select(
        "doc_id",
        F.size("input_ids").cast("long").alias("n_ids"),
        F.md5(F.col("text").cast("binary")).alias("pieces"),
    )


@query(
    f"""
    WITH d AS (SELECT len({TOK}) AS n FROM documents)
    SELECT count(*) AS docs, sum(n)::BIGINT AS tokens, count(*) FILTER (n < 64) AS short_docs, max(n)::BIGINT AS longest,
           round(avg(n), 6) AS mean_length, true AS quantiles_hold, true AS frequent_hold
    FROM d"""
)
def profile_sketches(spark, sf):
    """Two deliveries of a corpus, profiled one after the other; the sketches are held against exact ranks and counts."""
    folder, store = shared_dir(spark, "grown"), shared_dir(spark, "profiles")
    for part in (0, 1):
        docs(spark, sf).filter(F.col("doc_id") % 2 == part).write.mode("append").parquet(folder)
        rows = profiles.update_profiles(spark, folder, store, lambda df: tokenizing.pretokenize(df, lookahead=False))
    asked = (0.25, 0.5, 0.75, 0.95)
    said = profiles.merge_profiles(rows, asked)
    words = tok_docs(spark, sf)
    sizes = words.select(F.size("tok").alias("n"))
    ranks = sizes.crossJoin(F.broadcast(said.select("quantiles"))).agg(  # one row
        *(F.avg((F.col("n") <= F.get("quantiles", F.lit(i))).cast("double")).alias(f"r{i}") for i in range(len(asked))),
        *(F.avg((F.col("n") < F.get("quantiles", F.lit(i))).cast("double")).alias(f"b{i}") for i in range(len(asked))),
    )
    near = F.lit(True)
    for i, q in enumerate(asked):
        near = near & (F.col(f"r{i}") >= q - 0.03) & (F.col(f"b{i}") <= q + 0.03)
    counts = words.select(F.explode("tok").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    top = said.select("tokens", F.inline("frequent")).join(counts, "item")
    close = F.bool_and(F.abs(F.col("n") - F.col("count")) <= F.col("tokens") / (0.75 * profiles.ITEMS))
    held = top.agg(close.alias("frequent_hold"))
    row = said.select("docs", "tokens", "short_docs", "longest", r6("mean_length").alias("mean_length"))
    return row.crossJoin(ranks.select(near.alias("quantiles_hold"))).crossJoin(held)  # one row each
