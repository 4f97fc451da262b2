"""Readable reports: side-by-side cases in Markdown, and metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from textgauge.functions.text import fixed_point, right_strip, widen_fences

# Headings of the case report.
CASE_TITLE = "Qualitative Case Study: Code Generation Comparison"
CASE_LABELS = ("GPT-2 (Zero-Shot)", "GPT-2 (Fine-Tuned)")
CASE_NOTE = (
    "> Each case shows the identical prompt fed to both models, "
    "followed by side-by-side completions.\n"
)


def report_head(title: str = CASE_TITLE, generated: str | None = None) -> str:
    """Text in front of the first case."""
    stamp = [f"> Generated on {generated}\n"] if generated else []
    return "\n".join([f"# {title}\n", *stamp, CASE_NOTE, "---\n"])


def render_cases(
    df: DataFrame, labels: Sequence[str] = CASE_LABELS, idx: str = "case_idx"
) -> DataFrame:
    """``(case_idx, markdown)``: one numbered section per case, rendered row by row.

    Sections of a report are the rows in ``case_idx`` order, joined by line breaks.
    Back-ticks are widened in the two completions only; a missing completion is an empty block.
    """

    def block(text: Column) -> Column:
        return F.concat(F.lit("```python\n"), text, F.lit("\n```\n"))

    def completion(name: str) -> Column:
        return block(widen_fences(right_strip(F.coalesce(F.col(name), F.lit("")))))

    section = F.concat_ws(
        "\n",
        F.concat(F.lit("## Case "), F.col(idx).cast("string"), F.lit("\n")),
        F.lit("### Prompt\n"),
        block(right_strip(F.col("prompt"))),
        F.lit(f"### {labels[0]}\n"),
        completion("baseline"),
        F.lit(f"### {labels[1]}\n"),
        completion("candidate"),
        F.lit("---\n"),
    )
    return df.select(F.col(idx).alias("case_idx"), section.alias("markdown"))


def write_report(
    cases: DataFrame,
    path: str,
    labels: Sequence[str] = CASE_LABELS,
    *,
    idx: str = "case_idx",
    title: str = CASE_TITLE,
    generated: str | None = None,
) -> None:
    """Head and sections as text files; joined in name order they are the whole report.

    The sections are range-partitioned and sorted by case, so writing is spread over tasks.
    """
    sections = render_cases(cases, labels, idx).select(
        F.lit(1).alias("part"), "case_idx", "markdown"
    )
    head = cases.sparkSession.range(1).select(
        F.lit(0).alias("part"),
        F.lit(None).cast(cases.schema[idx].dataType).alias("case_idx"),
        F.lit(report_head(title, generated)).alias("markdown"),
    )
    ordered = head.unionByName(sections).orderBy("part", "case_idx")
    ordered.select(F.col("markdown").alias("value")).write.text(path)


def metric_table(
    df: DataFrame, metrics: dict[str, str], keys: Sequence[str] = ()
) -> DataFrame:
    """One ``(metric, value)`` row per metric column, values as text with 4 decimals.

    ``metrics`` maps columns to shown names. NULL metrics (a pass@k that is not reported)
    have no row.
    """
    shown = df.select(*keys, *[F.col(c).cast("double").alias(n) for c, n in metrics.items()])
    long = shown.unpivot(list(keys), list(metrics.values()), "metric", "number")
    return long.filter(F.col("number").isNotNull()).select(
        *keys, "metric", fixed_point(F.col("number")).alias("value")
    )
