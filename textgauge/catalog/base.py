"""Registry, inputs and SQL building blocks shared by the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from textgauge.functions import tokens
from textgauge.operators import runlogs, scoring, tokenizing
from textgauge.session import spread, written as saved
from textgauge.sources import corpus, run_logs

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


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    """Documents, spread over the cores when their files are fewer than those."""
    return spread(corpus.read_corpus(spark, f"{sf}/documents.parquet", keep=keep), "doc_id")


def byte_docs(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    return tokenizing.byte_tokenize(docs(spark, sf, *keep))


def tok_docs(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    """Pre-tokens by the pattern without look-ahead, which other regex engines share."""
    return tokenizing.pretokenize(docs(spark, sf, *keep), lookahead=False).drop("text")


def r6(col) -> F.Column:
    return F.round(col, 6)


PAT = tokens.PRETOKEN_SHORT.removeprefix("(?U)").replace("'", "''")

TOK = f"regexp_extract_all(text, '{PAT}')"

BYTES = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::INT)"

SPLIT_HASH = "md5(concat('42:split:', doc_id))"

SAMPLE_HASH = "md5(concat('42:sample:', doc_id))"

# floor(0.1 * 2^32) as hex digits
TENTH = "'19999999'"


def windows_sql(source: str, m: int, s: int, ids: str = "b", keep: str = "doc_id") -> str:
    """Windows of the list ``ids``: (keep, i, c)."""
    return f"""
      SELECT {keep}, i, {ids}[i * {s} + 1 : i * {s} + {m}] AS c
      FROM (SELECT {keep}, {ids}, unnest(range(0, (len({ids}) - {m}) // {s} + 1)) AS i
            FROM {source} WHERE len({ids}) >= {m})"""


def digest_sql(ids: str) -> str:
    return f"md5(array_to_string({ids}, ','))"


def log_lines(spark, sf):
    """Log lines out of the events: five message formats, warnings and errors in colour."""
    kind = F.col("event_type")
    loss = F.col("value") / 100
    message = (
        F.when(
            kind == "purchase",
            F.format_string(
                "Epoch %.2f | eval_loss: %.4f | perplexity: %.2f",
                (F.col("event_id") % 300) / 100.0,
                loss,
                F.exp(loss),
            ),
        )
        .when(
            kind == "view",
            F.format_string(
                "Train / Val split: %d chunks (90.0%%) / %d chunks (10.0%%).", "event_id", "user_id"
            ),
        )
        .when(
            kind == "signup",
            F.format_string(
                "Chunking complete: %d chunks from %d documents (~%d short docs discarded, 1.0%%).",
                "user_id",
                "event_id",
                F.lit(0),
            ),
        )
        .when(
            kind == "error",
            F.format_string(
                "Final — Validation Loss: %.4f | Perplexity (PPL): %.2f", loss, F.exp(loss)
            ),
        )
        .otherwise(F.concat(F.lit("seen | "), "props"))
    )
    level = (
        F.when(kind == "error", "ERROR")
        .when(kind == "click", "WARNING")
        .when(kind == "signup", "DEBUG")
        .otherwise("INFO")
    )
    logger = (
        F.when(kind == "click", "datasets")
        .when(kind == "signup", "transformers.tokens")
        .otherwise("trainer")
    )
    colour = F.when(kind == "error", "\x1b[31m").when(kind == "click", "\x1b[33m").otherwise("")
    reset = F.when(colour != "", "\x1b[0m").otherwise("")
    line = F.format_string(
        "%s | %-8s | %-25s | %s:%d | %s",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        F.concat(colour, level, reset),
        logger,
        F.lit("steps.src"),
        "user_id",
        F.concat(colour, message, reset),
    )
    return spread(table(spark, sf, "events"), "event_id").select(
        F.concat(F.lit("ablation_"), F.col("user_id") % 8).alias("experiment"),
        F.date_trunc("week", "ts").alias("run_start"),
        "event_id",
        line.alias("value"),
    )


LOG_SQL = """
    logs AS (
      SELECT 'ablation_' || (user_id % 8) AS experiment,
             strftime(date_trunc('week', ts), '%Y-%m-%d') AS run_day,
             strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, event_id, user_id, value, props, event_type,
             CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING'
                  WHEN 'signup' THEN 'DEBUG' ELSE 'INFO' END AS level,
             CASE event_type WHEN 'click' THEN 'datasets'
                  WHEN 'signup' THEN 'transformers.tokens' ELSE 'trainer' END AS logger,
             CASE WHEN event_type = 'purchase' THEN (event_id % 300) / 100.0 END::DOUBLE AS epoch,
             CASE WHEN event_type IN ('purchase', 'error')
                  THEN printf('%.4f', value / 100)::DOUBLE END AS eval_loss,
             CASE WHEN event_type IN ('purchase', 'error')
                  THEN printf('%.2f', exp(value / 100))::DOUBLE END AS perplexity
      FROM events)"""


def logs(spark, sf):
    return run_logs.parse_lines(log_lines(spark, sf), keep=("experiment", "run_start", "event_id"))


def run_metrics(spark, sf):
    return runlogs.extract_metrics(logs(spark, sf))


def stamp(col: str = "ts"):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias("stamp")


def run_day():
    return F.date_format("run_start", "yyyy-MM-dd").alias("run_day")


VOCAB_SQL = f"""
    t AS (SELECT doc_id, {TOK} AS tok FROM documents),
    counts AS (SELECT token, count(*) AS n FROM (SELECT unnest(tok) AS token FROM t) GROUP BY token),
    vocab AS (SELECT (1 + row_number() OVER (ORDER BY n DESC, token))::INT AS id, token, n
              FROM counts ORDER BY n DESC, token LIMIT 5000)"""


def saved_vocab(spark, sf):
    return saved(tokenizing.build_vocab(tok_docs(spark, sf), 5000), "vocab")


ENCODED_SQL = f"""
    {VOCAB_SQL},
    placed AS (SELECT doc_id, unnest(tok) AS token, unnest(range(0, len(tok))) AS pos FROM t),
    enc AS (SELECT doc_id, list(coalesce(id, 0) ORDER BY pos) AS ids
            FROM placed LEFT JOIN vocab USING (token) GROUP BY doc_id)"""


def logit_nll(spark, sf):
    df = table(spark, sf, "embeddings").withColumnRenamed("embedding", "logits")
    return scoring.token_nll(df)


def rounded(df):
    return df.withColumn("eval_loss", r6("eval_loss")).withColumn("perplexity", r6("perplexity"))


def assistant_samples(spark, sf):
    turns = table(spark, sf, "conversations").filter("role = 'assistant'")
    return turns.select(
        F.col("conv_id").cast("string").alias("task_id"),
        F.col("turn").cast("int").alias("sample_idx"),
        F.col("text").alias("completion"),
    )


def turn_pairs(spark, sf):
    """All user turns, with the assistant turn after each where there is one."""
    turns = table(spark, sf, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    answered = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("completion")
    )
    return asked.join(answered, ["conv_id", "turn"], "left")
