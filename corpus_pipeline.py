"""The corpus pipeline: documents to packed training bins, stage by stage.

Every stage reads the Parquet that the one before wrote. All stages but the last return the columns of
the table that they are given; the last returns where each piece of each document goes.

* language: documents without a letter, or far from every learned language, go.
* exact: of documents equal up to white space, that of the least doc_id stays.
* near: of documents that share 80 % of their five-word shingles, and of chains of such, that of the least
  doc_id stays; texts without words stay.
* secrets: every document stays; secrets in its text become ``[SECRET]``, and n_chars follows.
* pack: every document gets its place in bins of 8192 bytes, one document of a source in each bin.

Rows with null keys stay, unless a stage drops them for their text; repeated rows are copies of each other, of which one stays.
An empty table gives no rows. Further columns, also of names that stages use inside, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textgauge.llm import exact, langid, near, packing, secrets
from textgauge.llm.common import column, fresh, saved

CAPACITY = 8192


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    pred, score, rejected = (fresh(docs, f"_{n}") for n in ("pred", "score", "rejected"))
    said = langid.identify(docs, model, pred=pred, score=score, rejected=rejected)
    return said.filter(~F.col(rejected)).select(*(column(said, c) for c in docs.columns))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.near_dedup(docs, k=5, threshold=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_findings(docs))
    made = secrets.redact(docs, model, path="source" if "source" in docs.columns else None)
    if "n_chars" not in made.columns:
        return made
    changed = F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
    return made.withColumn("n_chars", changed)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1  # bytes and an end mark
    return packing.pack(docs, size, F.xxhash64(F.lower("text")), capacity=CAPACITY)


STAGES = [
    ("language", language),
    ("exact", exact_copies),
    ("near", near_copies),
    ("secrets", secret_scan),
    ("pack", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs, f"stage-{name}")
    return docs
