"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenbank.llm.common import saved

#: Edges that one task may join at the end, some 3 MB.
FEW = 200_000


def components(edges: DataFrame, few: int = FEW, rows: int | None = None) -> DataFrame:
    """(node, root) for every node of edges (a, b); ``root`` is the least node that it reaches.

    Each round links a node's larger neighbours to its least one, then its
    smaller ones, until the edges are stars around the roots: O(log^2 n)
    rounds. Only edges move, each round is written to the shared checkpoint
    folder, and the driver sees counts alone. Once there are ``few`` edges, whose
    nodes are whole numbers, one task joins them, with the same roots; at once if a saved
    table's number of ``rows`` is given and so small. No edges give no rows.
    """
    ends = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if rows is not None and rows <= few and whole_numbers(ends):
        return joined_at_once(ends)
    stars, seen = saved(ends.distinct()), None
    while True:
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFFFF))).first()
        if now == seen or not now[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        if now[0] <= few and whole_numbers(stars):
            return joined_at_once(stars)
        seen = now
        stars = saved(_small_star(_large_star(stars)))


def whole_numbers(edges: DataFrame) -> bool:
    return {x.dataType.simpleString() for x in edges.schema} <= {"bigint", "int"}


def joined_at_once(edges: DataFrame) -> DataFrame:
    """(node, root) of few edges (u, v), joined in one task."""
    kind = edges.schema["u"].dataType.simpleString()
    return saved(edges.coalesce(1).mapInArrow(_joined, f"node {kind}, root {kind}"))


def _joined(batches):
    """Roots of all edges of one task: labels are lowered along edges and then followed, until they stand."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        # The roots of both ends take the lower one, and each node its root's root.
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    kind = held[0].schema.field(0).type
    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in (nodes, nodes[root])], names=["node", "root"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
