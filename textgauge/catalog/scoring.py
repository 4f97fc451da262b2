"""Queries on losses, models and pass@k."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textgauge.catalog.base import (
    BYTES,
    ENCODED_SQL,
    LOG_SQL,
    SAMPLE_HASH,
    SPLIT_HASH,
    TENTH,
    byte_docs,
    docs,
    logit_nll,
    query,
    r6,
    rounded,
    run_metrics,
    saved,
    saved_vocab,
    table,
    tok_docs,
    windows_sql,
)
from textgauge.operators import chunking, countlm, curves, ngrams, scoring, splitting, tokenizing
from textgauge.plans import evaluate
from textgauge.sources import reports
from textgauge.plans.scaling import scaling_study


def pairs_sql(source: str, m: int, keep: str) -> str:
    """Shifted pairs of the windows of a byte table ``source(keep..., b)``."""
    return f"""
      SELECT {keep}, unnest(c[1:{m - 1}]) AS prev, unnest(c[2:{m}]) AS next
      FROM ({windows_sql(source, m, m, keep=keep)})"""


@query(
    f"""
    WITH d AS (SELECT lang, {BYTES} AS b FROM documents)
    SELECT lang, prev, next, count(*) AS n FROM ({pairs_sql("d", 64, "lang")}) GROUP BY ALL"""
)
def shift_pairs(spark, sf):
    chunks = chunking.chunk(byte_docs(spark, sf, "lang"), 64, keep=("lang",))
    return countlm.count_pairs(scoring.shift_pairs(chunks, keep=("lang",)), by=("lang",))


NLL_SQL = """
    x AS (SELECT vec_id, label, vec_id // 7 AS chunk,
                 ln(list_sum(list_transform(embedding::DOUBLE[], lambda z: exp(z))))
                 - embedding[label + 1]::DOUBLE AS nll
          FROM embeddings)"""


@query(f"WITH {NLL_SQL} SELECT vec_id, label, round(nll, 6) AS nll FROM x")
def logits_cross_entropy(spark, sf):
    return logit_nll(spark, sf).select("vec_id", "label", r6("nll").alias("nll"))


@query(
    f"""
    WITH {NLL_SQL}
    SELECT label, round(avg(nll), 6) AS eval_loss, round(exp(avg(nll)), 6) AS perplexity,
           count(*) AS n_tokens
    FROM x GROUP BY label"""
)
def perplexity(spark, sf):
    return rounded(scoring.perplexity(logit_nll(spark, sf), by=("label",)))


@query(
    f"""
    WITH {NLL_SQL}, c AS (SELECT chunk, avg(nll) AS loss FROM x WHERE label <> 3 GROUP BY chunk)
    SELECT round(avg(loss), 6) AS eval_loss, round(exp(avg(loss)), 6) AS perplexity,
           count(*) AS n_chunks
    FROM c"""
)
def perplexity_chunk_mean(spark, sf):
    # label 3 plays the padding token here, so chunks differ in their scored tokens
    df = table(spark, sf, "embeddings").withColumnRenamed("embedding", "logits")
    scored = scoring.token_nll(df.withColumn("chunk", F.expr("vec_id div 7")), pad_id=3)
    return rounded(scoring.perplexity_by_chunk(scored, ["chunk"]))


def _sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and test documents."""
    placed = splitting.split(df, ["doc_id"])
    train, test = (placed.filter(F.col("split") == side) for side in ("train", "test"))
    return train, test


def _byte_lm(train: DataFrame) -> countlm.CountLm:
    """A byte model counted over windows of 64 bytes."""
    return countlm.count_lm(countlm.count_byte_pairs(train, 64), 256)


def _held_out_loss(df: DataFrame, by: str) -> DataFrame:
    """Loss of the byte model on the held-out documents, per value of a column."""
    train, test = _sides(df)
    counts = countlm.count_byte_pairs(test.filter(F.col(by).isNotNull()), 64, by=(by,))
    scored = countlm.score_count_lm(_byte_lm(train), counts, by=(by,))
    return rounded(scoring.perplexity(scored, weight="n", by=(by,)))


LM_SQL = f"""
    d AS (SELECT doc_id, lang, substr({SPLIT_HASH}, 1, 8) < {TENTH} AS held, {BYTES} AS b FROM documents),
    pairs AS ({pairs_sql("d", 64, "doc_id, lang, held")}),
    c2 AS (SELECT prev, next, count(*) AS n FROM pairs WHERE NOT held GROUP BY ALL),
    c1 AS (SELECT prev, count(*) AS n FROM pairs WHERE NOT held GROUP BY ALL)"""

LM_NLL = "-ln((coalesce(c2.n, 0) + 1.0::DOUBLE) / (coalesce(c1.n, 0) + 256.0::DOUBLE))"


@query(
    f"""
    WITH {LM_SQL},
    s AS (SELECT lang, {LM_NLL} AS nll
          FROM (SELECT * FROM pairs WHERE held) p LEFT JOIN c2 USING (prev, next)
          LEFT JOIN c1 ON c1.prev = p.prev)
    SELECT lang, round(avg(nll), 6) AS eval_loss, round(exp(avg(nll)), 6) AS perplexity,
           count(*) AS n_tokens
    FROM s GROUP BY lang"""
)
def count_lm_perplexity(spark, sf):
    return _held_out_loss(docs(spark, sf, "lang"), "lang")


@query(
    f"""
    WITH {LM_SQL},
    q AS (SELECT item_id, {BYTES} AS b FROM benchmark),
    qp AS (SELECT item_id, unnest(b[1:-2]) AS prev, unnest(b[2:]) AS next FROM q WHERE len(b) > 1),
    s AS (SELECT item_id, {LM_NLL} AS nll FROM qp LEFT JOIN c2 USING (prev, next)
          LEFT JOIN c1 ON c1.prev = qp.prev)
    SELECT item_id, round(avg(nll), 6) AS eval_loss, round(exp(avg(nll)), 6) AS perplexity,
           count(*) AS n_tokens
    FROM s GROUP BY item_id"""
)
def benchmark_perplexity(spark, sf):
    items = tokenizing.byte_tokenize(table(spark, sf, "benchmark"))
    counts = countlm.count_pairs(scoring.shift_pairs(items, keep=("item_id",)), by=("item_id",))
    scored = countlm.score_count_lm(_byte_lm(_sides(docs(spark, sf))[0]), counts, by=("item_id",))
    return rounded(scoring.perplexity(scored, weight="n", by=("item_id",)))


@query(
    f"""
    WITH {LM_SQL},
    s AS (SELECT doc_id, {LM_NLL} AS nll
          FROM (SELECT * FROM pairs WHERE held) p LEFT JOIN c2 USING (prev, next)
          LEFT JOIN c1 ON c1.prev = p.prev)
    SELECT quality, round(avg(nll), 6) AS eval_loss, round(exp(avg(nll)), 6) AS perplexity,
           count(*) AS n_tokens
    FROM s JOIN labels USING (doc_id) GROUP BY quality"""
)
def perplexity_by_quality(spark, sf):
    # labels meet documents while those are one row each
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return _held_out_loss(docs(spark, sf).join(labels, "doc_id", "left"), "quality")


@query(
    f"""
    WITH {ENCODED_SQL},
    d AS (SELECT doc_id, substr({SPLIT_HASH}, 1, 8) < {TENTH} AS held, ids FROM enc),
    w AS ({windows_sql("d", 64, 64, ids="ids", keep="doc_id, held")}),
    pairs AS (SELECT held, unnest(c[1:63]) AS prev, unnest(c[2:64]) AS next FROM w),
    c2 AS (SELECT prev, next, count(*) AS n FROM pairs WHERE NOT held GROUP BY ALL),
    c1 AS (SELECT prev, count(*) AS n FROM pairs WHERE NOT held GROUP BY ALL),
    s AS (SELECT -ln((coalesce(c2.n, 0) + 1) / (coalesce(c1.n, 0) + 5002)::DOUBLE) AS nll
          FROM (SELECT * FROM pairs WHERE held) p LEFT JOIN c2 USING (prev, next)
          LEFT JOIN c1 ON c1.prev = p.prev)
    SELECT round(avg(nll), 6) AS eval_loss, round(exp(avg(nll)), 6) AS perplexity, count(*) AS n_tokens FROM s"""
)
def count_lm_vocab(spark, sf):
    """The counted model over ids of a vocabulary, too many pairs to be sent to executors."""
    vocab = saved_vocab(spark, sf)
    coded = tokenizing.encode(tok_docs(spark, sf), vocab)
    both = splitting.split(coded, ["doc_id"]).select("doc_id", "split", "input_ids")
    pairs = scoring.shift_pairs(chunking.chunk(both, 64, keep=("doc_id", "split")), keep=("split",))
    counts = saved(countlm.count_pairs(pairs, by=("split",)), "pairs")
    train, test = (counts.filter(F.col("split") == side).drop("split") for side in ("train", "test"))
    lm = countlm.count_lm(train, 5002)
    return rounded(scoring.perplexity(countlm.score_count_lm(lm, test), weight="n"))


NGRAM_ORDERS = (2, 3, 4, 5)


def _ngram_sql() -> str:
    """Interpolated discounting written out order by order, over every single target."""
    top = max(NGRAM_ORDERS)
    parts = [
        f"""
        {ENCODED_SQL},
        d AS (SELECT doc_id, substr({SPLIT_HASH}, 1, 8) < {TENTH} AS held, ids FROM enc),
        w AS ({windows_sql("d", 64, 64, ids="ids", keep="doc_id, held")}),
        g AS (SELECT held, c[greatest(p - {top - 1}, 1) : p] AS g FROM (SELECT held, c, unnest(range(2, 65)) AS p FROM w))"""
    ]
    for k in range(1, top + 1):
        parts.append(f"""
        n{k} AS (SELECT g[-{k}:] AS key, count(*) AS n, count(DISTINCT g[-{k + 1}]) FILTER (len(g) > {k}) AS before
                 FROM g WHERE NOT held AND len(g) >= {k} GROUP BY 1),
        h{k} AS (SELECT key[1:{k - 1}] AS context, sum(n) AS total, count(*) AS kinds, sum(before) AS total_before,
                        count(*) FILTER (before > 0) AS kinds_before FROM n{k} GROUP BY 1)""")

    def mixed(k: int, own: str, end: str, lower: str) -> str:
        own, of, kinds = f"coalesce(n{k}.{own}, 0)", f"coalesce(h{k}.total{end}, 0)", f"coalesce(h{k}.kinds{end}, 0)"
        return f"(CASE WHEN {of} > 0 THEN (greatest({own} - 0.75::DOUBLE, 0) + 0.75::DOUBLE * {kinds} * {lower}) / {of} ELSE {lower} END)"

    parts.append("p0 AS (SELECT g, 1 / 5002.0::DOUBLE AS p0 FROM g WHERE held)")
    for k in range(1, top + 1):
        context = f"t.g[len(t.g) - {k - 1} : len(t.g) - 1]" if k > 1 else "t.g[1:0]"
        lower = f"t.p{k - 1}"
        parts.append(f"""
        p{k} AS (SELECT t.*, CASE WHEN len(t.g) >= {k} THEN {mixed(k, 'before', '_before', lower)} END AS p{k},
                        CASE WHEN len(t.g) >= {k} THEN {mixed(k, 'n', '', lower)} END AS q{k}
                 FROM p{k - 1} t LEFT JOIN n{k} ON len(t.g) >= {k} AND n{k}.key = t.g[-{k}:]
                 LEFT JOIN h{k} ON len(t.g) >= {k} AND h{k}.context = {context})""")
    each = [f"SELECT {k} AS \"order\", -ln(coalesce(q{k}, {', '.join(f'p{i}' for i in range(k - 1, 0, -1))})) AS nll FROM p{top}" for k in NGRAM_ORDERS]
    return f"""
    WITH {', '.join(parts)}
    SELECT "order"::INT AS "order", round(avg(nll), 6) AS eval_loss, round(exp(avg(nll)), 6) AS perplexity, count(*) AS n_tokens
    FROM ({' UNION ALL '.join(each)}) GROUP BY 1"""


@query(_ngram_sql())
def ngram_perplexity(spark, sf):
    """Models of two to five tokens over ids of a vocabulary, by interpolated discounting."""
    vocab = saved_vocab(spark, sf)
    coded = tokenizing.encode(tok_docs(spark, sf), vocab)
    both = splitting.split(coded, ["doc_id"]).select("doc_id", "split", "input_ids")
    chunks = chunking.chunk(both, 64, keep=("doc_id", "split"))
    counts = ngrams.count_grams(chunks, max(NGRAM_ORDERS), by=("split",), vocab_size=5002)  # written there
    train, test = (counts.filter(F.col("split") == side).drop("split") for side in ("train", "test"))
    model = ngrams.ngram_tables(train, max(NGRAM_ORDERS), 5002)
    scored = ngrams.score_ngrams(model, test, NGRAM_ORDERS, 5002)
    # scoring runs in Python workers; its row for each order is written, so the plan given back stays in the JVM
    return rounded(saved(scoring.perplexity(scored, weight="n", by=("order",)), "losses"))


@query(
    f"""
    WITH d AS (SELECT doc_id, lang, substr({SPLIT_HASH}, 1, 8) < {TENTH} AS held, {BYTES} AS b
               FROM documents),
    w AS ({windows_sql("d", 64, 64, keep="doc_id, lang, held")}),
    pairs AS (SELECT doc_id, i, held, unnest(c[1:63]) AS prev, unnest(c[2:64]) AS next FROM w),
    c2 AS (SELECT prev, next, count(*) AS n FROM pairs WHERE NOT held GROUP BY ALL),
    c1 AS (SELECT prev, count(*) AS n FROM pairs WHERE NOT held GROUP BY ALL)
    SELECT p.doc_id, p.i::INT AS chunk_idx, round(avg({LM_NLL}), 6) AS nll, 63 AS n_tokens
    FROM (SELECT * FROM pairs WHERE held) p LEFT JOIN c2 USING (prev, next)
    LEFT JOIN c1 ON c1.prev = p.prev
    GROUP BY ALL"""
)
def score_chunks(spark, sf):
    train, test = _sides(docs(spark, sf))
    chunks = chunking.chunk(tokenizing.byte_tokenize(test), 64)
    scored = scoring.score(chunks, _byte_model(train), 64, batch=256)
    return scored.select("doc_id", "chunk_idx", r6("nll").alias("nll"), "n_tokens")


def _byte_model(train: DataFrame):
    """The counted byte model as a user model: a table of 256 x 256 losses per worker."""
    lm = _byte_lm(train)
    known = countlm.pair_probabilities(lm).collect()
    totals = {r["prev"]: r["n"] for r in lm.contexts.collect()}
    unseen = [totals.get(b, 0) for b in range(256)]
    shared = train.sparkSession.sparkContext.broadcast(([tuple(r) for r in known], unseen))

    def make_predict_fn():
        import numpy as np

        pairs, contexts = shared.value
        losses = np.repeat(np.log(np.asarray(contexts, float) + 256.0)[:, None], 256, axis=1)
        for prev, following, nll in pairs:
            losses[prev, following] = nll
        return lambda ids: losses[ids[:, :-1].astype(int), ids[:, 1:].astype(int)].mean(axis=1)

    return make_predict_fn


@query(
    f"""
    WITH {LM_SQL},
    s AS (SELECT lang, {LM_NLL} AS nll
          FROM (SELECT * FROM pairs WHERE held) p LEFT JOIN c2 USING (prev, next)
          LEFT JOIN c1 ON c1.prev = p.prev),
    m AS (SELECT lang, avg(nll) AS loss FROM s GROUP BY lang)
    SELECT lang, 'Cross-Entropy Loss' AS metric, printf('%.4f', loss) AS value FROM m
    UNION ALL SELECT lang, 'Perplexity (PPL)', printf('%.4f', exp(loss)) FROM m"""
)
def evaluate_model(spark, sf):
    train, test = _sides(docs(spark, sf, "lang"))
    chunks = chunking.chunk(tokenizing.byte_tokenize(test), 64, keep=("lang",))
    metrics = evaluate.evaluate_model(chunks, _byte_model(train), 64, batch=256, by=("lang",))
    return evaluate.model_report(metrics, by=("lang",))


CURVE_SQL = f"""
    d AS (SELECT doc_id, substr({SPLIT_HASH}, 1, 8) < {TENTH} AS held, {BYTES} AS b FROM documents),
    ranked AS (SELECT doc_id, row_number() OVER (ORDER BY {SAMPLE_HASH}) AS rn FROM d WHERE NOT held),
    f AS (SELECT fraction, CASE WHEN fraction > 0 THEN
                 greatest(floor((SELECT count(*) FROM ranked) * fraction), 1) ELSE 0 END AS k
          FROM (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) AS v(fraction)),
    pairs AS ({pairs_sql("d", 64, "doc_id, held")}),
    per_doc AS (SELECT doc_id, held, prev, next, count(*) AS n FROM pairs GROUP BY ALL),
    c2 AS (SELECT fraction, prev, next, sum(n) AS n
           FROM per_doc JOIN ranked USING (doc_id) JOIN f ON rn <= k GROUP BY ALL),
    c1 AS (SELECT fraction, prev, sum(n) AS n FROM c2 GROUP BY ALL),
    test AS (SELECT prev, next, sum(n) AS n FROM per_doc WHERE held GROUP BY ALL),
    curve AS (
      SELECT f.fraction, sum(test.n * {LM_NLL}) / sum(test.n) AS eval_loss, sum(test.n)::BIGINT AS n_tokens
      FROM test JOIN f ON true
      LEFT JOIN c2 ON c2.fraction = f.fraction AND c2.prev = test.prev AND c2.next = test.next
      LEFT JOIN c1 ON c1.fraction = f.fraction AND c1.prev = test.prev
      GROUP BY f.fraction)"""


@query(
    f"""
    WITH {CURVE_SQL}
    SELECT fraction, round(eval_loss, 6) AS eval_loss, n_tokens, round(exp(eval_loss), 6) AS perplexity,
           round(lag(eval_loss) OVER (ORDER BY fraction) - eval_loss, 6) AS gain_prev,
           round(first(eval_loss) OVER (ORDER BY fraction) - eval_loss, 6) AS gain_zero
    FROM curve"""
)
def scaling_curve(spark, sf):
    curve = rounded(scaling_study(docs(spark, sf)))
    return curve.withColumn("gain_prev", r6("gain_prev")).withColumn("gain_zero", r6("gain_zero"))


@query(
    f"""
    WITH {LOG_SQL},
    m AS (SELECT experiment, avg(eval_loss) AS loss, count(*) AS runs
          FROM logs WHERE event_type = 'error' GROUP BY experiment)
    SELECT experiment, runs, round(loss, 6) AS eval_loss, round(exp(loss), 6) AS perplexity,
           rank() OVER (ORDER BY loss)::INT AS rank, round(loss - min(loss) OVER (), 6) AS behind_best
    FROM m"""
)
def compare_runs(spark, sf):
    final = run_metrics(spark, sf).filter(F.col("kind") == "final")
    out = rounded(curves.compare_runs(final, "experiment"))
    return out.withColumn("behind_best", r6("behind_best"))


PASS_SQL = """
    t AS (SELECT user_id AS task_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS c
          FROM events GROUP BY user_id),
    p AS (SELECT task_id, n, c, k,
                 CASE WHEN n < k THEN NULL WHEN n - c < k THEN 1.0::DOUBLE
                      ELSE 1.0::DOUBLE - list_product(list_transform(range(n - c + 1, n + 1),
                           lambda i: 1.0::DOUBLE - k / i::DOUBLE)) END AS v
          FROM t, (VALUES (1), (10)) AS ks(k))"""


@query(
    f"""
    WITH {PASS_SQL}
    SELECT task_id, n, c, round(max(v) FILTER (k = 1), 6) AS pass_at_1,
           round(max(v) FILTER (k = 10), 6) AS pass_at_10
    FROM p GROUP BY ALL"""
)
def pass_at_k(spark, sf):
    per_task = scoring.pass_at_k(_flags(spark, sf))
    return per_task.withColumn("pass_at_1", r6("pass_at_1")).withColumn("pass_at_10", r6("pass_at_10"))


@query(
    f"""
    WITH {PASS_SQL}
    SELECT 'pass@' || k AS metric, printf('%.4f', avg(v)) AS value
    FROM p GROUP BY k HAVING min(n) >= k"""
)
def pass_at_k_mean(spark, sf):
    mean = scoring.mean_pass_at_k(scoring.pass_at_k(_flags(spark, sf)))
    return reports.metric_table(mean, {"pass_at_1": "pass@1", "pass_at_10": "pass@10"})


def _flags(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("task_id"), (F.col("event_type") == "purchase").alias("passed")
    )
