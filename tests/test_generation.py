"""Truncation, sample tables, cases, distribution shaping and generators."""

import pytest
from pyspark.sql import functions as F

from textgauge.functions import text
from textgauge.operators import generation
from textgauge.plans import evaluate
from textgauge.sources import reports


def column(spark, values, expr):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def cut_block(value):
    """The rule, line by line."""
    lines = value.split("\n")
    for i, line in enumerate(lines):
        starts = line.strip().startswith(("def ", "class ", "if __name__"))
        if line.strip() == "" or (starts and i > 1):
            return "\n".join(lines[:i]) + "\n"
    return value


BLOCKS = [
    "",
    "\nrest",
    "a\n\nb",
    "a\n \t　 \x1c\nb",
    "a\ndef b\nc",
    "a\nb\ndef c\nd",
    "a\nb\n    def c\nd",
    "a\nb\n class c",
    "a\nb\nif __name__ == 'x'",
    "a\nb\ndefine\nc",
    "a\nb",
    "a\r\nb\r\n\r\nc",
    "def a\nclass b\n  c\n",
]


def test_block_truncation(spark):
    assert column(spark, BLOCKS, text.truncate_block) == [cut_block(b) for b in BLOCKS]


def test_stop_truncation(spark):
    values = ["a\ndef b", "a\nclass b\ndef c", "x\nif __name__\nclass y", "plain def x", "\ndef all", ""]
    want = [v.split("\ndef ")[0].split("\nclass ")[0].split("\nif __name__")[0] for v in values]
    assert column(spark, values, text.truncate_stop) == want


def test_right_strip_and_fences(spark):
    values = ["a \n\t ", " \n", "x```y````", "a "]
    assert column(spark, values, text.right_strip) == [v.rstrip() for v in values]
    assert column(spark, values, text.widen_fences) == [v.replace("```", "````") for v in values]


def test_fixed_point(spark):
    values = [0.03125, 1.4860, float("inf"), float("-inf"), float("nan"), 12345.6, 0.0, -1.5]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    got = [r[0] for r in df.orderBy("i").select(text.fixed_point(F.col("x"))).collect()]
    assert got == [f"{v:.4f}" for v in values]


def test_truncation_choice(spark):
    df = spark.createDataFrame([("a\n\nb\ndef c",)], "completion string")
    assert generation.with_truncation(df).first()[0] == "a\n\nb"
    assert generation.with_truncation(df, how="block").first()[0] == "a\n"
    with pytest.raises(ValueError):
        generation.with_truncation(df, how="line")


def test_collect_samples_in_order_and_blocks(spark):
    samples = spark.createDataFrame(
        [("a", i, f"s{i}") for i in reversed(range(7))] + [("x", 0, "stray")],
        "task_id string, sample_idx int, completion string",
    )
    tasks = spark.createDataFrame([("a",), ("b",)], "task_id string")
    got = generation.collect_samples(samples, tasks, block=3).orderBy("task_id", "block_idx").collect()
    assert [tuple(r) for r in got] == [
        ("a", 0, 3, ["s0", "s1", "s2"]),
        ("a", 1, 3, ["s3", "s4", "s5"]),
        ("a", 2, 1, ["s6"]),
        ("b", 0, 0, []),
    ]
    whole = generation.collect_samples(samples, tasks).filter("task_id = 'a'").first()
    assert whole["completions"] == [f"s{i}" for i in range(7)]


def test_compare_cases(spark):
    prompts = spark.createDataFrame([(0, "p\n"), (1, "q\n")], "prompt_id int, prompt string")
    base = spark.createDataFrame([(0, "a\n\nb"), (1, "c")], "prompt_id int, completion string")
    cand = spark.createDataFrame([(1, "d\ne\ndef f"), (0, "g")], "prompt_id int, completion string")
    got = generation.compare_cases(prompts, base, cand).orderBy("prompt_id").collect()
    assert [tuple(r) for r in got] == [(0, "p\n", "p\na\n", "p\ng"), (1, "q\n", "q\nc", "q\nd\ne\n")]
    # a prompt keeps its row without a completion; two completions on a side are refused
    got = generation.compare_cases(prompts, base.filter("prompt_id = 0"), cand).orderBy("prompt_id").collect()
    assert [tuple(r)[2:] for r in got] == [("p\na\n", "p\ng"), (None, "q\nd\ne\n")]
    with pytest.raises(Exception, match="several completions"):
        generation.compare_cases(prompts, base.union(base), cand).collect()


def shaped(df, **settings):
    return {
        (r["context"], r["token"]): r["p"] for r in generation.shape_distribution(df, **settings).collect()
    }


@pytest.fixture(scope="module")
def weights(spark):
    rows = [("c", "x", 5.0), ("c", "y", 3.0), ("c", "z", 1.0), ("c", "z", 1.0), ("d", "x", 4.0)]
    return spark.createDataFrame(rows, "context string, token string, weight double")


def test_shaping(weights, spark):
    def close(want):
        return {k: pytest.approx(v) for k, v in want.items()}

    assert shaped(weights) == close({("c", "x"): 0.5, ("c", "y"): 0.3, ("c", "z"): 0.2, ("d", "x"): 1})
    assert shaped(weights, top_k=2) == close({("c", "x"): 5 / 8, ("c", "y"): 3 / 8, ("d", "x"): 1})
    # the token that crosses the edge is kept, the next one is not
    assert shaped(weights, top_p=0.5) == close({("c", "x"): 1, ("d", "x"): 1})
    assert shaped(weights, top_p=0.51) == close({("c", "x"): 5 / 8, ("c", "y"): 3 / 8, ("d", "x"): 1})
    hot = shaped(weights, temperature=0.5)
    assert hot["c", "x"] == pytest.approx(0.25 / (0.25 + 0.09 + 0.04))
    seen = spark.createDataFrame([("c", "x")], "context string, token string")
    punished = shaped(weights, repetition_penalty=2.0, seen=seen)
    assert punished["c", "y"] == pytest.approx(0.3 / (0.25 + 0.3 + 0.2))
    greedy = shaped(weights, do_sample=False, temperature=0.1, top_p=0.1, repetition_penalty=2.0, seen=seen)
    assert greedy == close({("c", "y"): 1, ("d", "x"): 1})


@pytest.mark.parametrize("bad", [{"temperature": 0}, {"top_p": 0}, {"top_p": 1.5}, {"top_k": -1}])
def test_shaping_arguments(weights, bad):
    with pytest.raises(ValueError):
        generation.shape_distribution(weights, **bad)


def test_generate_with_a_user_model(spark):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(9)], "prompt_id long, prompt string")

    def make():
        return lambda batch: [[f"{p}-{j}" for j in range(2)] for p in batch]

    got = {(r[0], r[1]): r[2] for r in generation.generate(prompts, make, 2).collect()}
    assert got == {(i, j): f"p{i}-{j}" for i in range(9) for j in range(2)}
    with pytest.raises(Exception, match="3 completions"):
        generation.generate(prompts, make, 3).collect()


def test_sampler_is_independent_of_partitioning(spark, weights):
    dist = generation.shape_distribution(
        spark.createDataFrame(
            [("x", "y", 1.0), ("x", "z", 1.0), ("y", "x", 1.0), ("z", "x", 1.0)],
            "context string, token string, weight double",
        )
    )
    rows = [(i, f"{i}x", "x") for i in range(20)] + [(20, "", None), (21, "?", "?")]
    prompts = spark.createDataFrame(rows, "prompt_id long, prompt string, last string")
    make = generation.sampler(dist, n=2, max_new_tokens=5)
    one, many = (
        sorted(map(tuple, generation.generate(prompts.repartition(k), make, 2, inputs=("prompt", "last")).collect()))
        for k in (1, 7)
    )
    joined = generation.sample_by_join(prompts, dist, n=2, max_new_tokens=5)
    assert sorted(map(tuple, joined.collect())) == one
    assert [r[2] for r in one if r[0] >= 20] == [""] * 4
    one, many = ([r for r in x if r[0] < 20] for x in (one, many))
    assert one == many and {len(r[2]) for r in one} == {5}
    assert len({r[2] for r in one}) > 2


def test_case_study_and_report(spark, tmp_path):
    prompts = spark.createDataFrame([(i, f"p{i}\n") for i in range(12)], "prompt_id int, prompt string")

    def model(mark):
        return lambda: lambda batch: [[f"{mark}{p.strip()}\n\nrest"] for p in batch]

    cases = evaluate.case_study(prompts, model("a"), model("b"))
    got = {r["prompt_id"]: tuple(r)[1:] for r in cases.collect()}
    assert got == {i: (f"p{i}\n", f"p{i}\nap{i}\n", f"p{i}\nbp{i}\n") for i in range(12)}
    numbered = cases.withColumn("case_idx", F.col("prompt_id") + 1)
    reports.write_report(numbered, str(tmp_path / "r"), ("old", "new"), title="T")
    parts = sorted((tmp_path / "r").glob("part-*"))
    text = "".join(p.read_text(encoding="utf-8") for p in parts)
    assert text.startswith("# T\n") and text.index("## Case 2\n") < text.index("## Case 11\n")
    assert text.count("### new") == 12


def test_sample_tasks(spark):
    tasks = spark.createDataFrame([("t1", "p"), ("t2", "q")], "task_id string, prompt string")

    def make():
        return lambda batch: [[f"{p}{j}\ndef x" for j in range(3)] for p in batch]

    got = sorted(tuple(r) for r in evaluate.sample_tasks(tasks, make, 3).collect())
    assert got == [(t, j, f"{p}{j}") for t, p in (("t1", "p"), ("t2", "q")) for j in range(3)]


@pytest.mark.parametrize("steps", [0, 1, 5, 12])
def test_greedy_jumps_equal_steps(spark, steps):
    follows = {"a": "b", "b": "c", "c": "a", "d": "e", "x": "x"}
    best = spark.createDataFrame([(k, v, 1.0) for k, v in follows.items()], "context string, token string, p double")
    rows = [(i, "p", last) for i, last in enumerate([*"abcdex", None, "unknown"])]
    prompts = spark.createDataFrame(rows, "prompt_id int, prompt string, last string")
    got = {r.prompt_id: r.completion for r in generation.greedy_by_join(prompts, best, max_new_tokens=steps).collect()}
    want = {}
    for i, _, at in rows:
        made = ""
        for _ in range(steps):
            at = follows.get(at)
            made += at or ""
        want[i] = made
    assert got == want
    walked = generation.generate(prompts, generation.sampler(best, max_new_tokens=steps), inputs=("prompt", "last"))
    assert {r.prompt_id: r.completion for r in walked.collect()} == want
