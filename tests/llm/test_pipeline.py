"""The pipeline against plain Python, stage by stage, each on what the stage before kept."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_near import groups, near_copies

import corpus_pipeline
from textgauge.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOLDER = "/root/testdata/sf0.01"


def least(rows, group_of):
    """Ids of the rows with the least id of each group."""
    by = {}
    for r in rows:
        by.setdefault(group_of(r), []).append(r.doc_id)
    return {min(v) for v in by.values()}


def test_stages_on_the_table(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = docs.collect()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        if name == "language":
            assert {r.doc_id for r in rows} == {r.doc_id for r in kept if any(c.isalpha() for c in r.text or "")}
        elif name == "exact":
            assert {r.doc_id for r in rows} == least(kept, lambda r: re.sub("[ \t-\r]+", " ", r.text))
        elif name == "near":
            want = {g[2] for g in groups([(r.doc_id, r.text) for r in kept], 5)}
            assert {r.doc_id for r in rows} == want and len(want) < len(kept)
        elif name == "secrets":
            plain = {r.doc_id: re.sub(r'(?i)(token = ")[0-9a-f]{40}"', r'\1[SECRET]"', r.text) for r in kept}
            assert {r.doc_id: r.text for r in rows} == plain and plain != {r.doc_id: r.text for r in kept}
            assert all(r.n_chars == len(r.text) for r in rows)
        else:
            sizes = {r.doc_id: len(r.text.encode()) + 1 for r in kept}
            got = {}
            for r in rows:
                got[r.doc_id] = got.get(r.doc_id, 0) + r.length
            assert got == sizes
        if i < 4:
            assert docs.columns == columns
        kept = rows
    whole = QUERIES["pipeline"](spark, FOLDER)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, kept))


def test_clean_documents_stay_and_odd_rows_pass(spark):
    rng = random.Random(8)
    words = "the of and to in that with ing tion er est ent".split()
    say = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    rows = [(i, say(60), "en", "s", 5) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", "en", None, 0), (102, "12 34", None, "s", 5), (None, say(30), None, None, None),
             (103, say(5000), "en", "s", 1), (0, rows[0][1], "en", "s", 5), (104, rows[1][1] + "  ", "en", "t", 9)]
    rows += [(200 + i, t + " " + t, None, "u", 1) for i, t in enumerate(near_copies(5, 80, 4, 1))]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"_RID": F.lit("x"), "sig": F.lit(1)})
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, "")
        if i < 4:
            assert docs.columns == [*(c.split()[0] for c in SCHEMA.split(", ")), "_RID", "sig"]
    ids = sorted({str(r.doc_id) for r in docs.collect()})
    assert ids == sorted([str(i) for i in range(40)] + ["None", "103", "200"])


@pytest.mark.parametrize("n", range(5))
def test_empty_table(spark, n):
    docs = spark.createDataFrame([], SCHEMA)
    assert corpus_pipeline.STAGES[n][1](spark, docs, "").count() == 0
