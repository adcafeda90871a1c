"""Connected components of a graph of longs: blocks of edges are contracted in tasks, then alternating large-star and
small-star rounds of grouping and joins connect what several blocks hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm import common

#: Edges that a task contracts at once (about 60 MB); a graph of no more needs no rounds.
BLOCK = 500_000


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Of each node, the least of itself and its neighbours; partial minima are formed before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))


def large_star(edges: DataFrame) -> DataFrame:
    """Each greater neighbour of a node is linked to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u != v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, is linked to the node's least neighbour."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = _least_neighbour(down)
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return linked.unionByName(least.select("u", F.col("least").alias("v"))).where("u != v").distinct()


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges (u, v) but the least of its component, and that least one."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
    tied = root != np.arange(len(nodes))
    return nodes[tied], nodes[root[tied]]


def contracted(edges: DataFrame, tasks: int, block: int) -> DataFrame:
    """Edges that connect the same nodes: of each block of edges, those of its components to their least nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            found = stars(*[np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (0, 1)])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["u", "v"])

        for batch in batches:
            if n + batch.num_rows > block and held:
                yield out()
                held, n = [], 0
            held.append(batch)
            n += batch.num_rows
        if held:
            yield out()

    return edges.select("u", "v").coalesce(tasks).mapInArrow(run, "u long, v long")


def components(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """``node`` and ``component`` (the least node reachable) of all nodes that ``edges`` (u, v) name.

    There are as many tasks as the edges fill blocks, so a small graph is one task's work, however many partitions a
    shuffle has.  A larger one takes rounds until none changes an edge, or until one block holds what is left of it;
    each ends in a table, so lineage stays short and an executor that is lost costs one round at most.  The number of
    rounds grows with the logarithm of a component's diameter.
    """
    now = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u != v").distinct()
    now = common.written(now, "edges")
    mark = None
    while True:
        row = now.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")).alias("s")).first()
        if (row["n"], row["x"], row["s"]) == mark:
            break
        few = contracted(now, -(-row["n"] // block) or 1, block)
        if row["n"] <= block:
            now = few
            break
        mark = (row["n"], row["x"], row["s"])
        before, now = now, common.written(small_star(large_star(few)), "edges")
        common.dropped(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
