"""Connected components of a graph given as a table of links, without collecting any component."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import staged

FOREST_NODES = 400_000  # nodes a task holds before it passes its stars on


def _stars(parent: dict[int, int]) -> pa.RecordBatch:
    nodes, roots = [], []
    for x in parent:
        r = x
        while parent[r] != r:
            r = parent[r]
        if r != x:
            nodes.append(x)
            roots.append(r)
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["a", "b"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the links a task sees by stars around the smallest node; connectivity stays."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > FOREST_NODES:
            yield _stars(parent)
            parent = {}
    yield _stars(parent)


def _to_stars(links: DataFrame) -> DataFrame:
    """One round: every node passes the smallest node it knows to its larger, then to its smaller neighbours."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(low.select("a", F.col("m").alias("b")))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node of its component.

    ``links`` holds two long columns. Links to oneself, repeated links and nulls are ignored, an empty table gives an
    empty table. Each round is written to the shared folder, so lineage stays short and lost executors cost a stage.
    Rounds end when all links form stars, which is tested on the whole table.
    """
    a, b = links.columns
    links = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    for _ in range(rounds):
        links = staged(links.mapInArrow(_forest, "a long, b long").distinct(), "stars")
        ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
        degree = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if degree.agg(F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0))).first()[0] == 0:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        links = _to_stars(links)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
