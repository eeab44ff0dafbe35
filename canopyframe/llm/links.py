"""Connected components of links between rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyframe.llm.common import release, stored

#: Links that a task joins at a time; more come in further portions.
PORTION = 1 << 20


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for all ends of ``links (a, b)``; the root is the smallest node of the component.

    Each task hangs the nodes of its links on the smallest node it can reach by them,
    which joins no others and parts none: first as the links are read, then in rounds
    that deal them out by both ends and again by the larger end. A node with many links may be spread over tasks; a later
    round brings the few links that are left of it together. The rounds end, by a count
    over all links, when every node hangs on one root and no root on another. Each
    round is a table, which Spark reads in as few tasks as its size asks for.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    edges = stored(_hang(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))))
    while not _stars(edges):
        ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = stored(_hang(_hang(ends.hint("rebalance", "u")).hint("rebalance", "u")))
        release(links.sparkSession)
    leaves = edges.distinct().select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _hang(links: DataFrame) -> DataFrame:
    """Links of each task's nodes with the smallest that they reach; Spark may split a large task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for batch in batches:
            waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows >= PORTION:
                yield _joined(waiting)
                waiting, rows = [], 0
        if rows:
            yield _joined(waiting)

    return links.mapInArrow(run, "u bigint, v bigint")


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    nodes, ends = np.unique(np.concatenate([side for part in parts for side in part]), return_inverse=True)
    cuts = np.cumsum([len(side) for part in parts for side in part])[:-1]
    sides = np.split(ends, cuts)
    a, b = np.concatenate(sides[::2]), np.concatenate(sides[1::2])
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for side in (a, b):
            np.minimum.at(new, side, low)
            np.minimum.at(new, root[side], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    hung = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[hung]), pa.array(nodes[root[hung]])], names=["u", "v"])


def _stars(edges: DataFrame) -> bool:
    """If every node hangs on one root and no root hangs on another."""
    ends = edges.unionByName(edges.select(F.col("v").alias("u"), "v"))
    hung = ends.groupBy("u").agg((F.min("v") != F.max("v")).alias("apart"))
    return not hung.agg(F.max("apart")).first()[0]
