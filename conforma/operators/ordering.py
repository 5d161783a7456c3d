"""Places and running sums of ordered groups of any size.

A window over a key sorts all rows of the key in one task. Here rows are sorted over all tasks at once, by key and order;
each part of the sorted rows is numbered by itself, and starts where the parts before it end. What one task
holds depends on the number of parts, not on the largest key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import kept


def in_parts(rows: DataFrame, by: list[str], parts: int | None = None) -> DataFrame:
    """rows with __part: in the order of by, cut into parts (the session's shuffle partitions unless said) of about
    equal size. Written once, as the cuts are drawn from a sample and must not change."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(rows.repartitionByRange(parts, *by).withColumn("__part", F.spark_partition_id()))


def numbered(
    rows: DataFrame, keys: list[str], order: list[Column], place: str = "place", sums: dict[str, Column] | None = None, parts: int | None = None
) -> DataFrame:
    """rows with place (long, from 1) in the order of their key, and running sums (name: addend, up to and with the row).

    Rows that are equal in keys and order come in any order. parts: how many parts the rows are sorted
    into (by default the session's shuffle partitions); only rows that are equal in keys and order stay together.
    """
    sums = sums or {}
    columns = rows.columns
    named = {f"__o{i}": o for i, o in enumerate(order)} | {f"__s_{n}": c for n, c in sums.items()}
    by = [*keys, *(c for c in named if c.startswith("__o"))]
    placed = in_parts(rows.withColumns(named), by, parts)
    totals = placed.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), *[F.sum(f"__s_{n}").alias(f"__t_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = {"__n": F.coalesce(F.sum("__n").over(earlier), F.lit(0))}
    before |= {f"__t_{n}": F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)) for n in sums}
    starts = totals.select(*[F.col(c).alias(f"__k_{c}") for c in keys], F.col("__part").alias("__p"), *[c.alias(n) for n, c in before.items()])

    local = Window.partitionBy(*keys, "__part").orderBy(*by[len(keys) :])
    running = local.rowsBetween(Window.unboundedPreceding, 0)
    own = {place: F.row_number().over(local).cast("long")} | {n: F.sum(f"__s_{n}").over(running) for n in sums}
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in keys], F.col("__part") == F.col("__p"))
    found = placed.withColumns(own).join(starts, same)
    out = [(F.col(place) + F.col("__n")).alias(place), *[(F.col(n) + F.col(f"__t_{n}")).alias(n) for n in sums]]
    return found.select(*[c for c in columns if c not in (place, *sums)], *out)
