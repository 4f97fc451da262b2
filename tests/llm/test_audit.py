"""Filter audit: rational solution against the definition, whole audit against plain Python, edge cases."""

import itertools
import math
import random
from fractions import Fraction

import pytest
from compare import duck, rows_of

from textgauge.llm import audit
from textgauge.llm.queries import SQL


def test_least_squares_give_shapley_values():
    rng = random.Random(2)
    for m in (2, 3, 5, 6):
        value = [0] + [rng.randrange(1000) for _ in range((1 << m) - 1)]
        got = [sum(f * v for f, v in zip(row, value)) for row in audit.shapley_rows(m)]
        want = []
        for i in range(m):
            gains = Fraction(0)
            for s in range(1 << m):
                if not s >> i & 1:
                    k = s.bit_count()
                    gains += Fraction(math.factorial(k) * math.factorial(m - k - 1), math.factorial(m)) * (value[s | 1 << i] - value[s])
            want.append(gains)
        assert got == want


def plain(rows, labels):
    """The audit by walking through every order."""
    texts, good, toxic = {}, set(), set()
    for key, _, text in rows:
        if key is not None:
            texts[text or ""] = min(key, texts.get(text or "", key))
    for key, q, t in labels:
        good |= {key} if q == 1 else set()
        toxic |= {key} if t == 1 else set()
    docs = {}
    for key, part, text in rows:
        text = text or ""
        words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": key is not None and key > texts[text],
        }
        docs.setdefault(part or "", []).append((key, {k for k, v in fails.items() if v}))
    out = []
    for part, all_ in docs.items():
        shares, steps = dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = all_
            for i, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shares[f] += len(gone)
                failing = sum(f in d[1] for d in all_)
                steps.append([part, "".join(order), i + 1, len(left), len(gone), failing - len(gone), sum(d[1] == {f} for d in all_),
                              sum(d[0] in good for d in gone if d[0] is not None), sum(d[0] in toxic for d in gone if d[0] is not None), f])
        out += [tuple(s[:-1] + [shares[s[-1]]]) for s in steps]
    return sorted(out)


def test_against_plain_python(spark):
    rng = random.Random(7)
    words = "alpha beta Gamma delta # 50% epsilon ZETA eta".split()
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 5, 199, 200, 201, 400)]
    texts += [" ".join(f"w{i}" for i in range(300)), "\tx\n" * 250, None, "", "É" * 10, " ".join(["a"] * 300)]
    rows = [(rng.choice([None, *range(60)]), rng.choice(["web", "books", None, ""]), rng.choice(texts)) for _ in range(150)]
    rows += [(70 + i, "web", "the same text, many times") for i in range(200)] + [(70, "web", "the same text, many times")] * 3
    labels = [(rng.choice([None, *range(90)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    docs = docs.selectExpr("*", "1 AS part", "2 AS failed", "'x' AS n")  # names that clash
    found = audit.audit_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert found.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert dict(found.dtypes)["step"] == "int" and dict(found.dtypes)["shapley"] == "bigint"
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, labels)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit_documents(none, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], none.schema)
    got = audit.audit_documents(one, labels).collect()
    assert len(got) == 600 and {r.part for r in got} == {""} and sum(r.removed for r in got) == 120


@pytest.fixture(scope="module")
def answers(small):
    result = duck(small).execute(SQL["op13_filter_audit"])
    return rows_of([d[0] for d in result.description], result.fetchall())[1]


def test_sql_says_the_same_as_plain_python(spark, small, answers):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    names = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert rows_of(names, plain(docs, labels))[1] == answers
