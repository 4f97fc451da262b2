"""Whole log records: split borders, rotated parts, offsets; nothing is lost."""

import random

import pytest

from textgauge.sources import log_records, run_logs

HEAD = "2026-05-06 17:00:{:02d} | {:<8} | train                     | t.src:9 | step {}"


def made(rng, n, first_rest=0):
    """Records as (head, body lines), and orphans before the first."""
    lines, records = [], []
    for i in range(first_rest):
        lines.append(f"tail {i}")
    for i in range(n):
        head = HEAD.format(i % 60, rng.choice(["INFO", "ERROR"]), i)
        body = rng.choice([[], [], ["Traceback (most recent call last):", f'  File "x.src", line {i}', "", "ValueError: é | \x1b[31mred\x1b[0m"], ["more"] * rng.randint(1, 9)])
        records.append((head, body))
        lines += [head, *body]
    return lines, records


def clean(line):
    return line.replace("\x1b[31m", "").replace("\x1b[0m", "")


@pytest.mark.parametrize("split", [64, 333, 1 << 20])
def test_records_over_splits_and_parts(spark, tmp_path, split):
    rng = random.Random(split)
    old, r_old = made(rng, 40)
    new, r_new = made(rng, 30, first_rest=3)
    other, r_other = made(rng, 5, first_rest=2)
    (tmp_path / "abl_a_2026-05-06_170000.log.1").write_bytes("\n".join(old).encode())
    (tmp_path / "abl_a_2026-05-06_170000.log").write_bytes(("\r\n".join(new) + "\r\n").encode())
    (tmp_path / "other_2026-05-07_010203.log").write_bytes(("\n".join(other) + "\n").encode())
    (tmp_path / "abl_a_2026-05-06_170000.log.2").write_bytes(b"only a tail\n")
    r_old[-1] = (r_old[-1][0], r_old[-1][1] + ["tail 0", "tail 1", "tail 2"])
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        lines = log_records.read_log_lines(spark, str(tmp_path)).collect()
        got = log_records.read_log_records(spark, str(tmp_path)).orderBy("experiment", "part", "path", "offset").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    if split < 1000:
        assert len({(r.path, r.block) for r in lines}) > 4
    run = sorted((r for r in got if r.experiment == "abl_a"), key=lambda r: (-r.part, r.offset))
    want = [(None, ["only a tail"]), *r_old, *r_new]
    assert [(r.message, r.body, r.lines) for r in run] == [
        (h and h.split(" | ")[-1], "\n".join(map(clean, b)) if b else None, len(b) + (h is not None)) for h, b in want
    ]
    rest = [r for r in got if r.experiment == "other"]
    assert [r.body for r in rest if r.message is None] == ["tail 0\ntail 1"] and len(rest) == len(r_other) + 1
    assert sum(r.lines for r in got) == len(old) + len(new) + len(other) + 1
    for r in run:  # an offset is where the head stands in its file
        if r.message:
            data = (tmp_path / r.path.rsplit("/", 1)[-1]).read_bytes()[r.offset :]
            assert data.startswith(f"2026-05-06 17:00:{r.ts.second:02d} |".encode()) and r.message.encode() in data[:120]


def test_long_records_come_in_pieces(spark, tmp_path):
    body = [f"line {i:05d}" for i in range(300)]
    (tmp_path / "long_2026-05-06_170000.log").write_text("\n".join([HEAD.format(1, "ERROR", 1), *body, HEAD.format(2, "INFO", 2)]) + "\n")
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        got = log_records.read_log_records(spark, str(tmp_path), piece_bytes=1000).orderBy("offset").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    first = [r for r in got if r.message != "step 2"]
    assert len(first) > 2 and [r.piece for r in first] == sorted(r.piece for r in first)
    assert "\n".join(r.body for r in first if r.body) == "\n".join(body)
    assert max(len(r.body or "") for r in got) < 2000 and [r.message for r in first[:1]] == ["step 1"]


def test_lines_of_known_shape_agree_with_the_line_reader(spark, tmp_path):
    lines, records = made(random.Random(9), 50)
    (tmp_path / "x_2026-05-06_170000.log").write_text("\n".join(lines), encoding="utf-8")
    columns = ["experiment", "run_start", "ts", "level", "logger", "file", "line", "message"]
    a = log_records.read_log_records(spark, str(tmp_path)).select(*columns).collect()
    b = run_logs.read_run_logs(spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == len(records)


def test_no_lines(spark, tmp_path):
    (tmp_path / "x_2026-05-06_170000.log").write_text("")
    assert log_records.read_log_records(spark, str(tmp_path)).count() == 0
