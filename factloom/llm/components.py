"""Connected components of an edge table by alternating large-star and small-star rounds.

Before each round every task joins what its own edges connect, in blocks of bounded size, so rounds are
only needed for what several blocks hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.frames import cut, drop, merge_join


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round on edges (a > b): nodes re-attach to the least neighbour of their centre."""
    if large:
        around = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = merge_join(around, least, "a")
    moved = moved.where(F.col("b") > F.col("a")) if large else moved
    out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out if large else out.union(least.select("a", F.col("m").alias("b")))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of a block of edges that reaches a smaller one, and the least node that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        while (label[label] != label).any():
            label = label[label]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _contracted(edges: DataFrame, most: int) -> DataFrame:
    """The edges with the nodes of each block of about `most` edges joined to the least one they reach."""

    def run(batches):
        held, size = [], 0

        def told():
            a, b = (np.concatenate([h.column(i).to_numpy() for h in held]) for i in range(2))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in stars(a, b)], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= most:
                yield told()
                held, size = [], 0
        if held:
            yield told()

    return edges.mapInArrow(run, "a long, b long")


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one centre and no centre hangs on another (edges a > b)."""
    ends = edges.select(F.col("a").alias("x"), F.col("b").alias("on"), F.lit(0).alias("down")).union(edges.select(F.col("b").alias("x"), F.lit(None).cast("long").alias("on"), F.lit(1).alias("down")))
    each = ends.groupBy("x").agg(F.min("on").alias("lo"), F.max("on").alias("hi"), F.max("down").alias("down"))
    return each.where("lo <> hi OR (lo IS NOT NULL AND down > 0)").isEmpty()


def components(pairs: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, block: int = 500_000) -> DataFrame:
    """Label every node of an undirected edge table with the least node it can reach.

    Returns (node, component) of long nodes. Loops and repeated edges are fine, null ends are left out, an
    empty table gives an empty result. Rounds grow with the logarithm of the longest path; `rounds` only
    stops a loop that does not end. `block` bounds the edges that a task holds; it changes no result. The
    driver sees one row a round at most.
    """
    edges = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = cut(edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")))
    for _ in range(rounds):
        joined = cut(_contracted(edges, block))
        drop(edges)
        edges = joined
        if _settled(edges):
            break
        after = cut(_star(_star(edges, True), False).where("a <> b").distinct())
        drop(edges)
        edges = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b")).distinct()
