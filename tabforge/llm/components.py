"""Connected components by alternating large and small stars, all in DataFrames.

Every part of the edges is first reduced to stars by the task that holds it, which
leaves an edge per node of a part. Parts have a bounded number of edges, so this
does much for a small graph and something for a large one. Rounds of large and
small stars then join the parts until only stars are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.session import settle

EDGES_PER_PART = 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one part (a above b) -> an edge from each node to the smallest it reaches."""
    top: dict[int, int] = {}

    def find(node: int) -> int:
        path = []
        while (above := top.get(node, node)) != node:
            path.append(node)
            node = above
        for passed in path:
            top[passed] = node
        return node

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(a), find(b)
            if x != y:
                top[max(x, y)] = min(x, y)
    nodes = list(top)
    labels = [find(n) for n in nodes]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(labels, pa.int64())], ["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("low"))
    kept = both.join(least, "a").where("b > a")
    return kept.select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. Edges go down."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(least.select("a", F.col("low").alias("b"))).distinct()


def _only_stars(edges: DataFrame) -> bool:
    """Whether every upper end has one edge and no lower end is an upper end."""
    uppers = edges.groupBy("a").agg(F.count("*").alias("n"))
    lowers = edges.select(F.col("b").alias("a")).distinct().withColumn("is_lower", F.lit(1))
    wrong = uppers.join(lowers, "a", "left").where("n > 1 OR is_lower = 1")
    return wrong.isEmpty()


def components(pairs: DataFrame) -> DataFrame:
    """(node, label) for every node of ``pairs`` (a, b); the label is its smallest node."""
    edges = pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = settle(edges)
    parts = max(1, -(-edges.count() // EDGES_PER_PART))
    edges = settle(edges.coalesce(parts).mapInArrow(_contract, "a long, b long"))
    while not _only_stars(edges):
        edges = settle(_small_star(_large_star(edges)))
    own = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(own)
