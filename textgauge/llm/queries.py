"""Registered queries of the corpus operators, each over its whole table, with SQL where it can say it."""

from __future__ import annotations

import string
from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from textgauge.llm import (
    audit, bpe, chat, exact, fingerprint, langid, near, packing, prefixes, secrets, suffix, tokenfile, variants,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


@query()
def op1_bpe(spark, sf):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = documents(spark, sf).select("doc_id", "text")
    made = bpe.bpe_encode(docs, path, public_tokenizers.PATTERN).drop("text")
    return bpe.bpe_decode(made, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def _sketch_sql(source: str, text: str, name: str) -> str:
    return f"""
    {name} AS (
      SELECT doc_id, CASE WHEN j = '' THEN 0 ELSE greatest(len(w) - 5, 0) + 1 END AS n, md5(j)[:12] AS words,
             CASE WHEN j = '' THEN [] ELSE list_sort(list_distinct(list_transform(list_filter(list_transform(
               range(greatest(len(w) - 5, 0) + 1), lambda i: md5(array_to_string(w[i + 1 : i + 5], ' '))),
               lambda h: h < '40000000'), lambda h: h[:12]))) END AS hashes
      FROM (SELECT doc_id, j, string_split(j, ' ') AS w
            FROM (SELECT doc_id, trim(regexp_replace({text}, '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS j FROM {source})))"""


@query(rf"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    ring AS (SELECT doc_id, text, length(text) AS n_chars, length(text) // 4 AS cut,
                    coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id,
                    coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
             FROM t WINDOW w AS (ORDER BY doc_id)),
    e AS (SELECT *, left(text, n_chars - cut) || left(next_text, cut) AS edited FROM ring),
    {_sketch_sql("t", "text", "a")},
    {_sketch_sql("e", "edited", "b")},
    f AS (SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, a, b, c
          FROM e JOIN a USING (doc_id) JOIN b USING (doc_id) JOIN a AS c ON c.doc_id = e.next_id)
    SELECT doc_id, n_chars, edited_sha256,
           concat_ws(':', a.n, a.words, array_to_string(a.hashes, '')) AS fingerprint,
           concat_ws(':', b.n, b.words, array_to_string(b.hashes, '')) AS edited_fingerprint,
           CASE WHEN a.words = b.words THEN 1.0
                WHEN least(len(a.hashes), len(b.hashes)) = 0 THEN 0.0
                ELSE len(list_intersect(a.hashes, b.hashes)) / least(len(a.hashes), len(b.hashes)) END::DOUBLE AS near_edited,
           CASE WHEN a.words = c.words THEN 1.0
                WHEN least(len(a.hashes), len(c.hashes)) = 0 THEN 0.0
                ELSE len(list_intersect(a.hashes, c.hashes)) / least(len(a.hashes), len(c.hashes)) END::DOUBLE AS near_next
    FROM f""")
def op2_fingerprint(spark, sf):
    made = fingerprint.edited_fingerprints(documents(spark, sf))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.fingerprint("sketch").alias("fingerprint"),
        fingerprint.fingerprint("edited_sketch").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query(r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS x FROM documents),
    -- every string of 400 bytes
    w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS h
          FROM (SELECT doc_id, x, unnest(range(0, strlen(x) // 2 - 399)) AS i FROM t WHERE strlen(x) >= 800)),
    hit AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY h) > 1),
    run AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b
            FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS part
                  FROM (SELECT doc_id, i, (i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) > 400)::INT AS fresh FROM hit))
            GROUP BY doc_id, part),
    left_ AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM run),
    cut AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS stop,
                   string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept
            FROM left_ JOIN t USING (doc_id) GROUP BY doc_id),
    -- every string of 51 words
    v AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 50], ' ')) AS h
          FROM (SELECT doc_id, words, unnest(range(1, len(words) - 49)) AS i
                FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t) WHERE len(words) > 50)),
    both_ AS (SELECT h FROM v GROUP BY h HAVING min(doc_id) < max(doc_id)),
    shared AS (SELECT doc_id, i FROM v WHERE h IN (SELECT h FROM both_)),
    said AS (SELECT doc_id, min(i) AS a, max(i) + 51 AS b
             FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS part
                   FROM (SELECT doc_id, i, (i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) > 51)::INT AS fresh FROM shared))
             GROUP BY doc_id, part),
    p AS (SELECT doc_id, count(*) AS n_passages, sum(b - a) AS passage_words FROM said GROUP BY doc_id)
    SELECT doc_id, strlen(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
           sha256(unhex(coalesce(kept || substr(x, 2 * stop + 1), x))) AS kept_sha256,
           coalesce(n_passages, 0) AS n_passages, coalesce(passage_words, 0)::BIGINT AS passage_words
    FROM t LEFT JOIN cut USING (doc_id) LEFT JOIN p USING (doc_id)""")
def op3_repeats(spark, sf):
    made = suffix.remove_repeats(documents(spark, sf).select("doc_id", "text"), length=400)
    return made.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "passage_words"
    )


@query("""
    WITH q AS (SELECT conv_id, turn,
                      replace(replace(coalesce(role, 'unknown'), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') AS role,
                      replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') AS text
               FROM conversations),
    t AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns
          FROM q GROUP BY conv_id),
    p AS (SELECT conv_id, turns[1 : i] AS head, i < len(turns) AS inside
          FROM (SELECT conv_id, turns, unnest(range(1, len(turns) + 1)) AS i FROM t)),
    said AS (SELECT head, list_transform(head, lambda x: {'role': x.role, 'text': x.text}) AS words, conv_id, inside FROM p),
    top AS (SELECT min(conv_id) AS conv_id, any_value(len(words)) AS n_turns, count(*) AS copies, words
            FROM said WHERE NOT inside AND words NOT IN (SELECT words FROM said WHERE inside) GROUP BY words)
    SELECT conv_id, n_turns, copies,
           array_to_string(list_transform(words, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '') AS chat
    FROM top""")
def op4_chat(spark, sf):
    return chat.format_chats(spark.read.parquet(f"{sf}/conversations.parquet"))


@query()
def op5_secrets(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text", "source")
    model = secrets.train(secrets.labelled_findings(docs))
    found = secrets.scan_secrets(docs, model, path="source")
    return found.select(
        "doc_id",
        "place",
        "start",
        F.length("value").cast("long").alias("length"),
        "kind",
        F.sha2("value", 256).alias("value_sha256"),
        "score",
        "is_secret",
    )


@query(r"""
    WITH RECURSIVE t AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM t),
    x AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_, any_value(a.n + b.n) AS n
          FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM p WHERE 100 * both_ >= 80 * (n - both_)),
    e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id AS d, doc_id AS c FROM s UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.d)
    SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM s JOIN (SELECT d, min(c) AS component_id FROM reach GROUP BY d) ON d = doc_id""".replace("{upper}", string.ascii_uppercase).replace("{lower}", string.ascii_lowercase))
def op6_near_dedup(spark, sf):
    _, placed, _ = near.near_groups(documents(spark, sf), k=4)
    return placed.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )


@query()
def op7_packing(spark, sf):
    docs = documents(spark, sf)
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1  # bytes and an end mark
    same = F.trim(F.regexp_replace(F.lower("text"), "[\\x20\\x09-\\x0D]+", " "))
    return packing.pack(docs, size, same, capacity=8192)


@query(r"""
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n
               FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = min(doc_id) OVER w AS kept, sha256(n) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY n)""")
def op8_exact_dedup(spark, sf):
    _, placed, _ = exact.exact_groups(documents(spark, sf))
    return placed.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )


@query()
def op9_language(spark, sf):
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = documents(spark, sf).select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = langid.fit(docs.filter("not held_out"))
    said = langid.identify(docs.drop("lang"), model)
    return said.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query()
def op10_token_files(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    folder = tokenfile.token_folder(spark)
    tokenfile.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), folder)
    read = tokenfile.read_tokens(spark, folder, docs.select("doc_id").distinct())
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op11_variants(spark, sf):
    words = variants.word_counts(documents(spark, sf).select("doc_id", "text"))
    return variants.variant_groups(words)


@query()
def op12_token_counts(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    made = prefixes.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), budget=1024)
    return made.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 1024).alias("over_limit"),
        "fits_chars",
    )


@query(r"""
    WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
    l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                 (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END)
                 || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
                 || (CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' ELSE '' END)
                 || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
                 || (CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS failed
          FROM w LEFT JOIN l USING (doc_id)),
    c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY part, failed),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
               WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    steps AS (SELECT filter_order, step::INTEGER AS step, filter_order[step] AS own, left(filter_order, step - 1) AS before
              FROM orders, (SELECT unnest(range(1, 6)) AS step)),
    r AS (SELECT part, filter_order, step, own,
                 sum(n) FILTER (translate(failed, before || own, '') = failed) AS kept,
                 sum(n) FILTER (contains(failed, own) AND translate(failed, before, '') = failed) AS removed,
                 sum(n) FILTER (contains(failed, own) AND translate(failed, before, '') <> failed) AS redundant,
                 sum(n) FILTER (failed = own) AS unique_fails,
                 sum(good) FILTER (contains(failed, own) AND translate(failed, before, '') = failed) AS good_lost,
                 sum(toxic) FILTER (contains(failed, own) AND translate(failed, before, '') = failed) AS toxic_lost
          FROM c, steps GROUP BY part, filter_order, step, own)
    SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
           coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
           coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
           (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley
    FROM r""")
def op13_filter_audit(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return audit.audit_documents(documents(spark, sf), labels)


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
