"""Connected components of links by union-find in parts and contraction between them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textgauge.llm.common import saved


def _forest(batches):
    """Union-find over the links of one task; every node with the least node that it reaches here."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["node", "comp"]
        )


def components(links: DataFrame) -> DataFrame:
    """(node, comp): every node of the links (two columns of longs) with the least node it reaches.

    A task holds the links of one input split at most. Nodes with several roots tie those roots together,
    and each node jumps to the root of its root, until every node has one root.
    """
    edges = saved(links, "links")
    while True:
        found = saved(edges.mapInArrow(_forest, "node long, comp long"), "forest")
        ends = found.groupBy("node").agg(F.min("comp").alias("comp"), F.max("comp").alias("top"))
        ends = saved(ends, "roots")
        if ends.filter("comp < top").isEmpty():
            return ends.select("node", "comp")
        label = ends.select(F.col("node").alias("comp"), F.col("comp").alias("jump"))
        jumped = ends.join(label, "comp").select("node", F.col("jump").alias("comp"))
        tied = found.withColumnRenamed("comp", "root").join(ends, "node").filter("root <> comp")
        edges = saved(jumped.union(tied.select("root", "comp").distinct()), "links")
