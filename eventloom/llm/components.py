"""Connected components of a graph given as an edge table.

Alternating large-star and small-star rounds: every node's larger neighbours
are tied to its smallest neighbour, then the same for its smaller ones. A round
is two grouped minima with joins; no node's neighbour list is ever collected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_scratch, pin_at


def local_roots(size: int, left: np.ndarray, right: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """Smallest position reachable from each of ``size`` positions by the links
    ``left``-``right`` and those already in ``parent``."""
    parent = np.arange(size) if parent is None else parent
    while True:
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            return parent
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def components(edges: DataFrame) -> DataFrame:
    """Nodes of ``edges`` (longs ``a``, ``b``; any order, repeats and loops
    allowed) with ``component``, the smallest node they can reach.

    An empty table gives an empty result; a node that has only a loop does not
    appear. Each round is a written table; superseded ones are removed.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    table, path = pin_at(pairs.where("hi <> lo").distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(
            df.agg(
                F.count(F.lit(1)),
                F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0)),
            ).first()
        )

    before = mark(table)
    while before[0]:
        both = table.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            table.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").select(
            F.explode(F.array(F.struct("hi", "m"), F.struct(F.col("lo").alias("hi"), "m"))).alias("e")
        )
        small = small.select(F.col("e.hi").alias("hi"), F.col("e.m").alias("lo")).where("hi <> lo").distinct()
        fresh, fresh_path = pin_at(small, "edges")
        after = mark(fresh)
        drop_scratch(spark, path)
        table, path = fresh, fresh_path
        if after == before:
            break
        before = after
    leaves = table.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = table.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return leaves.unionAll(roots)
