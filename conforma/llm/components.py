"""Connected components by alternating large and small stars, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Links each node's (smaller, if small; else larger) neighbours to the least of all of them."""
    if small:
        big = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        own = edges.select(*big)
    else:
        own = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = own.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = own.join(least, own["u"] == least["w"])
    if small:
        linked = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.filter("u <> v").distinct()


def connected(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node, component: the least node that edges (u, v) reach, for every node with an edge.

    Stars converge in a number of rounds that grows with the logarithm of the longest path. Each round's
    table replaces the last one's in scratch; the last one stays, as the result reads it.
    """
    current = scratch.write(edges.select("u", "v").filter("u <> v").distinct(), f"{name}-0")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).head())

    seen, turn = mark(current), 0
    while True:
        turn += 1
        current = scratch.write(_stars(_stars(current, False), True), f"{name}-{turn}")
        scratch.remove(f"{name}-{turn - 1}")
        now = mark(current)
        if now == seen:
            break
        seen = now
    labels = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return labels.unionByName(roots)
