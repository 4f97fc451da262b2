"""Registered queries: every operator over the whole given tables, with its SQL check.

A query is ``(spark, folder of parquet tables) -> DataFrame``. The SQL is written apart from
the Spark code and answers the same question in plain relational form.
"""

from textgauge.catalog import (  # noqa: F401 - importing a module registers its queries
    storage,
    sampling,
    tokenizing,
    chunking,
    scoring,
    generation,
    runlogs,
)
from textgauge.catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
