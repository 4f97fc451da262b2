"""Queries on sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from textgauge.catalog.base import (
    BYTES,
    LOG_SQL,
    assistant_samples,
    byte_docs,
    digest_sql,
    log_lines,
    logit_nll,
    logs,
    query,
    run_day,
    stamp,
    table,
    turn_pairs,
    windows_sql,
)
from textgauge.functions import text, tokens
from textgauge.operators import chunking, scoring
from textgauge.sources import corpus, log_records as records, reports, run_logs, samples
from textgauge.session import shared_dir
from textgauge.sources import chunks as chunk_files


@query(
    """
    SELECT lang, count(*) AS docs, sum(length(text))::BIGINT AS chars,
           sum(strlen(text))::BIGINT AS bytes,
           count(*) FILTER (coalesce(length(text), 0) = 0) AS empty_docs
    FROM documents GROUP BY lang"""
)
def corpus_profile(spark, sf):
    df = corpus.read_corpus(spark, f"{sf}/documents.parquet", keep=("lang",))
    return corpus.corpus_profile(df, by=("lang",))


@query(
    f"""
    WITH d AS (SELECT doc_id, {BYTES} AS b FROM documents),
         w AS ({windows_sql("d", 128, 100)})
    SELECT doc_id, i::INT AS chunk_idx, (i * 100)::INT AS start,
           {digest_sql("c")} AS ids, {digest_sql("c")} AS labels
    FROM w"""
)
def chunks_roundtrip(spark, sf):
    made = chunking.chunk(byte_docs(spark, sf), 128, 100)
    path, _ = chunk_files.write_chunks(
        made, shared_dir(spark, "chunks"), tokenizer="bytes", max_length=128, stride=100
    )
    back = chunk_files.read_chunks(spark, path)
    return back.select(
        "doc_id",
        "chunk_idx",
        "start",
        tokens.ids_digest(F.col("input_ids")).alias("ids"),
        tokens.ids_digest(F.col("labels")).alias("labels"),
    )


@query(
    """
    SELECT conv_id::VARCHAR AS task_id, turn::INT AS sample_idx, text AS completion
    FROM conversations WHERE role = 'assistant'"""
)
def samples_roundtrip(spark, sf):
    path = shared_dir(spark, "samples")
    samples.write_samples(assistant_samples(spark, sf), path)
    return samples.read_samples(spark, path)


@query(
    """
    SELECT (turn % 16)::INT AS prompt_id, text AS prompt, count(*) AS n
    FROM (SELECT text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn
          FROM conversations WHERE role = 'user')
    GROUP BY ALL"""
)
def prompt_bank(spark, sf):
    turns = table(spark, sf, "conversations").filter("role = 'user'")
    # a bank per conversation, in turn order, cut into lines of 16 prompts; none is left out
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
    lines = turns.withColumn("i", place).groupBy("conv_id", F.expr("i div 16")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda t: t["text"]).alias("part")
    )
    path = shared_dir(spark, "prompts")
    lines.select(F.to_json("part").alias("value")).write.text(path)
    back = samples.read_prompts(spark, path, lines=True)
    return back.groupBy("prompt_id", "prompt").agg(F.count(F.lit(1)).alias("n"))


MESSAGE_SQL = """
           CASE event_type
             WHEN 'purchase' THEN printf('Epoch %.2f | eval_loss: %.4f | perplexity: %.2f',
                                         epoch, value / 100, exp(value / 100))
             WHEN 'view' THEN 'Train / Val split: ' || event_id || ' chunks (90.0%) / '
                              || user_id || ' chunks (10.0%).'
             WHEN 'signup' THEN 'Chunking complete: ' || user_id || ' chunks from ' || event_id
                                || ' documents (~0 short docs discarded, 1.0%).'
             WHEN 'error' THEN printf('Final — Validation Loss: %.4f | Perplexity (PPL): %.2f',
                                      value / 100, exp(value / 100))
             ELSE 'seen | ' || props END"""


@query(
    f"""
    WITH {LOG_SQL}
    SELECT event_id, stamp, level, logger, 'steps.src' AS file, user_id::INT AS line,
           {MESSAGE_SQL} AS message
    FROM logs"""
)
def log_parse(spark, sf):
    return logs(spark, sf).select(
        "event_id", stamp(), "level", "logger", "file", "line", "message"
    )


@query(
    f"""
    WITH {LOG_SQL}
    SELECT experiment, run_day, level, count(*) AS lines, min(stamp) AS first_at, max(stamp) AS last_at
    FROM logs GROUP BY ALL"""
)
def log_files(spark, sf):
    lines = log_lines(spark, sf)
    name = text.run_file_name(F.col("experiment"), F.col("run_start"))
    path = shared_dir(spark, "logs")
    lines.select(name.alias("run"), "value").write.partitionBy("run").text(path)
    back = run_logs.read_run_logs(spark, path)
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return back.groupBy("experiment", run_day(), "level").agg(
        F.count(F.lit(1)).alias("lines"), F.min(at).alias("first_at"), F.max(at).alias("last_at")
    )


@query(
    f"""
    WITH {LOG_SQL}
    SELECT experiment, run_day, stamp, level, {MESSAGE_SQL} AS message,
           CASE event_type WHEN 'error' THEN E'Traceback:\\n  step ' || event_id || E'\\n\\nfailed | ' || props
                           WHEN 'click' THEN 'see ' || props END AS body,
           CASE event_type WHEN 'error' THEN 5 WHEN 'click' THEN 2 ELSE 1 END::BIGINT AS lines
    FROM logs"""
)
def log_records(spark, sf):
    """Errors are logged with a traceback, clicks with one more line."""
    events = table(spark, sf, "events").select("event_id", "event_type", "props")
    rest = F.when(
        F.col("event_type") == "error",
        F.concat(F.lit("\nTraceback:\n  step "), F.col("event_id").cast("string"), F.lit("\n\nfailed | "), "props"),
    ).when(F.col("event_type") == "click", F.concat(F.lit("\nsee "), "props"))
    lines = log_lines(spark, sf).join(events, "event_id")
    name = text.run_file_name(F.col("experiment"), F.col("run_start"))
    path = shared_dir(spark, "logs")
    value = F.concat("value", F.coalesce(rest, F.lit("")))
    lines.select(name.alias("run"), value.alias("value")).write.partitionBy("run").text(path)
    found = records.read_log_records(spark, path)
    return found.select("experiment", run_day(), stamp(), "level", "message", "body", "lines")


@query(
    r"""
    WITH c AS (
      SELECT u.conv_id * 1000000 + u.turn AS case_idx, u.text AS prompt, a.text AS body
      FROM conversations u LEFT JOIN conversations a
        ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
      WHERE u.role = 'user'),
    r AS (SELECT case_idx, rtrim(prompt, E' \t\n\r') AS p,
                 replace(rtrim(coalesce(body, ''), E' \t\n\r'), '```', '````') AS a,
                 replace(rtrim(coalesce('```' || body || E'\n```\n', ''), E' \t\n\r'), '```', '````') AS b
          FROM c)
    SELECT case_idx, E'## Case ' || case_idx || E'\n\n### Prompt\n\n```python\n' || p
           || E'\n```\n\n### base\n\n```python\n' || a
           || E'\n```\n\n### tuned\n\n```python\n' || b || E'\n```\n\n---\n' AS markdown
    FROM r"""
)
def case_markdown(spark, sf):
    fence = F.lit("```")
    cases = turn_pairs(spark, sf).select(
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("case_idx"),
        "prompt",
        F.col("completion").alias("baseline"),
        F.concat(fence, "completion", F.lit("\n"), fence, F.lit("\n")).alias("candidate"),
    )
    return reports.render_cases(cases, ("base", "tuned"))


@query(
    """
    WITH x AS (
      SELECT label, ln(list_sum(list_transform(embedding::DOUBLE[], lambda z: exp(z))))
                    - embedding[label + 1]::DOUBLE AS nll FROM embeddings),
    m AS (SELECT label, avg(nll) AS loss, count(*) AS n FROM x GROUP BY label)
    SELECT label, 'Cross-Entropy Loss' AS metric, printf('%.4f', loss) AS value FROM m
    UNION ALL
    SELECT label, 'Perplexity (PPL)', printf('%.4f', exp(loss)) FROM m"""
)
def metric_table(spark, sf):
    scored = scoring.perplexity(logit_nll(spark, sf), by=("label",))
    names = {"eval_loss": "Cross-Entropy Loss", "perplexity": "Perplexity (PPL)"}
    return reports.metric_table(scored, names, keys=("label",))
