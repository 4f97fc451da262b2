"""Queries on completions."""

from __future__ import annotations

from pyspark.sql import functions as F

from textgauge.catalog.base import (
    TOK,
    assistant_samples,
    docs,
    query,
    r6,
    saved,
    table,
    tok_docs,
    turn_pairs,
)
from textgauge.functions import tokens
from textgauge.operators import countlm, generation, scoring
from textgauge.sources import corpus


@query(
    r"""
    SELECT doc_id,
           md5(split_part(split_part(split_part(text || E'\nclass A' || text || E'\ndef ' || text,
               E'\ndef ', 1), E'\nclass ', 1), E'\nif __name__', 1)) AS cut
    FROM documents"""
)
def truncate_stop(spark, sf):
    long = F.concat("text", F.lit("\nclass A"), "text", F.lit("\ndef "), "text")
    df = corpus.read_corpus(spark, f"{sf}/documents.parquet").select(
        "doc_id", long.alias("completion")
    )
    cut = generation.with_truncation(df)
    return cut.select("doc_id", F.md5(F.col("completion").cast("binary")).alias("cut"))


@query(
    r"""
    WITH x AS (SELECT doc_id, text || E'\n  def f\n' || text || E'\n\n' || text AS t FROM documents),
    l AS (SELECT doc_id, t, string_split(t, E'\n') AS lines FROM x),
    c AS (SELECT doc_id, t, lines,
                 list_position(list_transform(range(0, len(lines)), lambda i:
                   regexp_full_match(lines[i + 1], '\s*')
                   OR (i > 1 AND regexp_matches(lines[i + 1], '^\s*(def |class |if __name__)'))), true) AS p
          FROM l)
    SELECT doc_id, md5(CASE WHEN p > 0 THEN array_to_string(lines[1 : p - 1], E'\n') || E'\n'
                            ELSE t END) AS cut
    FROM c"""
)
def truncate_block(spark, sf):
    long = F.concat("text", F.lit("\n  def f\n"), "text", F.lit("\n\n"), "text")
    df = docs(spark, sf).select("doc_id", long.alias("completion"))
    cut = generation.with_truncation(df, how="block")
    return cut.select("doc_id", F.md5(F.col("completion").cast("binary")).alias("cut"))


@query(
    """
    WITH tasks AS (SELECT DISTINCT conv_id FROM conversations),
    s AS (SELECT conv_id, turn // 4 AS block_idx, count(*) AS n, string_agg(text, '|' ORDER BY turn) AS t
          FROM conversations WHERE role = 'assistant' GROUP BY ALL)
    SELECT conv_id::VARCHAR AS task_id, coalesce(block_idx, 0)::INT AS block_idx,
           coalesce(n, 0)::INT AS n, md5(coalesce(t, '')) AS completions
    FROM tasks LEFT JOIN s USING (conv_id)"""
)
def collect_samples(spark, sf):
    tasks = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("task_id"))
    out = generation.collect_samples(assistant_samples(spark, sf), tasks.distinct(), block=4)
    return out.withColumn(
        "completions", F.md5(F.array_join("completions", "|").cast("binary"))
    )


@query(
    r"""
    WITH p AS (SELECT u.conv_id * 1000000 + u.turn AS prompt_id, u.text AS prompt, a.text AS body
               FROM conversations u LEFT JOIN conversations a
                 ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
               WHERE u.role = 'user')
    SELECT prompt_id, md5(prompt) AS prompt, md5(prompt || body) AS baseline,
           md5(prompt || body || E'\n') AS candidate
    FROM p"""
)
def compare_cases(spark, sf):
    pairs = turn_pairs(spark, sf).select(
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("prompt_id"), "prompt", "completion"
    )
    pairs = saved(pairs, "turn-pairs")
    answered = pairs.filter(F.col("completion").isNotNull())
    longer = F.concat("completion", F.lit("\n\n"), "prompt").alias("completion")
    out = generation.compare_cases(
        pairs.select("prompt_id", "prompt"),
        answered.select("prompt_id", "completion"),
        answered.select("prompt_id", longer),
    )
    names = ("prompt", "baseline", "candidate")
    return out.select("prompt_id", *[F.md5(F.col(c).cast("binary")).alias(c) for c in names])


NEXT_SQL = f"""
    t AS (SELECT doc_id, {TOK} AS tok FROM documents),
    bi AS (SELECT prev AS context, next AS token, count(*)::DOUBLE AS w
           FROM (SELECT unnest(tok[1:-2]) AS prev, unnest(tok[2:]) AS next FROM t WHERE len(tok) > 1)
           GROUP BY ALL)"""


def _next_weights(spark, sf):
    """Counts of all pairs of neighbouring pre-tokens."""
    pairs = countlm.count_pairs(scoring.shift_pairs(tok_docs(spark, sf), ids="tok"))
    return pairs.select(
        F.col("prev").alias("context"), F.col("next").alias("token"), F.col("n").alias("weight")
    )


@query(
    f"""
    WITH {NEXT_SQL},
    a AS (SELECT context, token, w / sum(w) OVER (PARTITION BY context) AS p0 FROM bi),
    b AS (SELECT context, token, pow(p0, 1.0::DOUBLE / 0.8::DOUBLE) AS p1 FROM a),
    k AS (SELECT context, token, p1 FROM b
          QUALIFY row_number() OVER (PARTITION BY context ORDER BY p1 DESC, token) <= 50),
    q AS (SELECT context, token, p1 / sum(p1) OVER (PARTITION BY context) AS p2 FROM k),
    s AS (SELECT context, token, p2 FROM q
          QUALIFY round(coalesce(sum(p2) OVER (PARTITION BY context ORDER BY p2 DESC, token
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) < 0.95)
    SELECT context, token, round(p2 / sum(p2) OVER (PARTITION BY context), 6) AS p FROM s"""
)
def topk_topp(spark, sf):
    shaped = generation.shape_distribution(
        _next_weights(spark, sf), temperature=0.8, top_k=50, top_p=0.95
    )
    return shaped.withColumn("p", r6("p"))


@query(
    f"""
    WITH {NEXT_SQL},
    a AS (SELECT context, token, w / sum(w) OVER (PARTITION BY context) AS p0 FROM bi),
    b AS (SELECT context, token, CASE WHEN token = context THEN pow(p0, 1.3::DOUBLE) ELSE p0 END AS p1 FROM a),
    k AS (SELECT context, token, p1 FROM b
          QUALIFY row_number() OVER (PARTITION BY context ORDER BY round(p1, 12) DESC, token) <= 20)
    SELECT context, token, round(p1 / sum(p1) OVER (PARTITION BY context), 6) AS p FROM k"""
)
def topk_penalty(spark, sf):
    """A token that repeats the one before it is penalized."""
    weights = _next_weights(spark, sf)
    repeats = weights.filter("context = token")
    shaped = generation.shape_distribution(weights, top_k=20, repetition_penalty=1.3, seen=repeats)
    return shaped.withColumn("p", r6("p"))


@query(
    f"""
    WITH RECURSIVE {NEXT_SQL},
    best AS (SELECT context, token FROM bi
             QUALIFY row_number() OVER (PARTITION BY context ORDER BY w DESC, token) = 1),
    gen AS (
      SELECT conv_id, turn, 0 AS step, ({TOK})[-1] AS last, '' AS made
      FROM conversations WHERE role = 'user'
      UNION ALL
      SELECT conv_id, turn, step + 1, token, made || token
      FROM gen JOIN best ON best.context = gen.last WHERE step < 12)
    SELECT conv_id * 1000000 + turn AS prompt_id, 0 AS sample_idx, max_by(made, step) AS completion
    FROM gen GROUP BY conv_id, turn"""
)
def generate_greedy(spark, sf):
    greedy = generation.shape_distribution(_next_weights(spark, sf), do_sample=False)
    return generation.greedy_by_join(_prompts(spark, sf), greedy, max_new_tokens=12)


@query(
    f"""
    WITH RECURSIVE {NEXT_SQL},
    a AS (SELECT context, token, w, sum(w) OVER (PARTITION BY context ORDER BY w DESC, token
                 ROWS UNBOUNDED PRECEDING) AS upto FROM bi
          QUALIFY row_number() OVER (PARTITION BY context ORDER BY w DESC, token) <= 8),
    c AS (SELECT context, token, (upto - w) / max(upto) OVER (PARTITION BY context) AS lo,
                 upto / max(upto) OVER (PARTITION BY context) AS hi FROM a),
    gen AS (
      SELECT conv_id, turn, j, 0 AS step, text AS prompt, ({TOK})[-1] AS last, '' AS made
      FROM conversations, (VALUES (0), (1), (2)) AS s(j) WHERE role = 'user'
      UNION ALL
      SELECT conv_id, turn, j, step + 1, prompt, token, made || token
      FROM (SELECT gen.*, ('0x' || substr(md5(concat('42:', prompt, ':', j, ':', step)), 1, 8))::BIGINT
                          / 4294967296.0::DOUBLE AS u FROM gen WHERE step < 6) g
      JOIN c ON c.context = g.last AND g.u >= c.lo AND g.u < c.hi)
    SELECT conv_id * 1000000 + turn AS prompt_id, j AS sample_idx, max_by(made, step) AS completion
    FROM gen GROUP BY conv_id, turn, j"""
)
def generate_sampled(spark, sf):
    shaped = generation.shape_distribution(_next_weights(spark, sf), top_k=8)
    return generation.sample_by_join(_prompts(spark, sf), shaped, n=3, max_new_tokens=6)


def _prompts(spark, sf):
    """User turns with their last pre-token."""
    turns = table(spark, sf, "conversations").filter("role = 'user'")
    return turns.select(
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("prompt_id"),
        F.col("text").alias("prompt"),
        F.element_at(tokens.pretokens(F.col("text"), lookahead=False), -1).alias("last"),
    )
