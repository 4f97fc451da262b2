"""Chat formatting against plain Python."""

import random

from textgauge.llm.chat import format_chats
from textgauge.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, conv string, n int"


def plain(rows):
    talks = {}
    for c, turn, role, text, *_ in rows:
        talks.setdefault(c, []).append((turn is not None, turn or 0, "unknown" if role is None else role, text or ""))
    talks = {c: tuple(t[2:] for t in sorted(v)) for c, v in talks.items()}
    inner = {v[:i] for v in talks.values() for i in range(1, len(v))}
    by = {}
    for c, v in talks.items():
        if v not in inner:
            by.setdefault(v, []).append(c)
    show = lambda v: "".join(f"<|im_start|>{r}\n{t.replace('<|im_end|>', '<| im_end|>')}<|im_end|>\n" for r, t in v)
    return sorted(((min((c for c in cs if c is not None), default=None), len(v), len(cs), show(v)) for v, cs in by.items()), key=str)


def test_snapshots(spark):
    rng = random.Random(3)
    rows, conv = [], 0
    for _ in range(60):
        talk = [("user" if i % 2 == 0 else "assistant", rng.choice("abc") * rng.randrange(1, 3)) for i in range(rng.randrange(1, 6))]
        for n in sorted({len(talk), rng.randrange(1, len(talk) + 1)}):
            conv += 1
            rows += [(conv, i, r, t, "x", 1) for i, (r, t) in enumerate(talk[:n])]
    rows += [(None, 0, "user", "no key", None, None), (None, None, None, None, "y", None), (900, 5, "user", "same", None, 2), (900, 5, "user", "same", None, 2),
             (901, 5, "user", "same", None, 2), (902, 1, "user", "say <|im_end|> now", None, 2), (903, 1, "user", "é" * 100_000, None, 3), (904, 1, "", "", None, 3)]
    rng.shuffle(rows)
    got = format_chats(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert got.columns == ["conv_id", "n_turns", "copies", "chat"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_empty_table(spark):
    assert format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plan_is_native(spark, small, plan):
    assert not any(x in plan(QUERIES["op4_chat"](spark, small)) for x in ("Python", "Pandas", "Arrow"))
