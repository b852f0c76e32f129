"""Connected components of an edge table by alternating large and small stars.

Each round is two grouped passes; the edge set only shrinks towards a forest of stars, in a number
of rounds that grows with the logarithm of the longest path.  Every round is written to the shared
folder, so the lineage stays short and no task holds more than the rows it streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star pass over (a, b): neighbours of a node are hung on the smallest of them."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not large:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    hung = both.join(least, "u")
    if large:
        out = hung.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, store: Store, name: str = "cc") -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component is its smallest node.

    No edges give no rows; loops and repeated edges are harmless.  Nodes are longs.
    """
    now = store.put(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}_0")
    seen = None
    for i in range(1, MAX_ROUNDS):
        now = store.put(_star(_star(now, True), False), f"{name}_{i}")
        # A forest of stars on smallest nodes: nobody who points to a root is pointed at.
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        store.drop(f"{name}_{i - 1}")
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def with_component(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``component_id``: that of ``key``, or the key itself where it has no edge."""
    return rows.join(found.select(F.col("node").alias(key), F.col("component").alias("_component")), key, "left").withColumn("component_id", F.coalesce("_component", F.col(key))).drop("_component")


__all__ = ["components", "with_component"]
