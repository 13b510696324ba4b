"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches), for each node but the smallest ones, of a block of edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        # Hook the roots, not only the ends, then halve the paths: a few turns even for long chains.
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


def contract(edges: DataFrame, block: int = 500_000) -> DataFrame:
    """The same components with at most one edge for each node of a block of rows: (a, b) with a > b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out():
            a, b = forest(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b")))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= block:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return edges.mapInArrow(run, "a long, b long")


def forests(edges: DataFrame, block: int = 500_000) -> DataFrame:
    """The same components as a written forest of each block of ``block`` edges; blocks are joined while that takes edges away.

    The number of tasks follows the number of edges, not that of partitions: a
    task always holds one block, and a hot group's edges, which every partition
    met, are gone before any join sees them.
    """
    now = common.cut(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b"), "edges")
    n, before = now.count(), None
    while before is None or n < before // 2:
        before = n
        now = common.cut(contract(now.coalesce(max(1, -(-n // block))), block), "edges")
        n = now.count()
        if before <= block:
            break
    return now


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): each node of ``edges`` (a, b) with the smallest node it reaches. Nodes without another are left out.

    Blocks of edges are first contracted to forests. Where one block held all,
    that is the result. Else large-star and small-star steps take turns until
    nothing changes: each step moves edges to the smallest neighbour, so a hot
    node's edges stay rows of their own, counted into one minimum before the
    shuffle. Each round is written to the shared folder.
    """
    now = forests(edges)
    for _ in range(rounds):
        # Done once every node has one edge and no parent has a parent.
        n = now.count()
        tops = now.select(F.col("b").alias("a")).distinct()
        if now.select("a").distinct().count() == n and now.join(tops, "a", "left_semi").limit(1).count() == 0:
            break
        # Large star: the larger neighbours of a node go to the smallest of its neighbours and itself.
        both = now.unionByName(now.selectExpr("b AS a", "a AS b"))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").filter("b > a").selectExpr("b AS a", "m AS b").filter("a <> b").distinct()
        # Small star: the smaller neighbours of a node, and itself, go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.selectExpr("b AS a", "m AS b").unionByName(least.selectExpr("a", "m AS b")).filter("a <> b").distinct()
        now = common.cut(small, "edges")
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return now.selectExpr("a AS node", "b AS component").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
