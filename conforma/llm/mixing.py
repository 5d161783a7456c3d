"""Mixes sources to target weights by fitting each source's budget of tokens exactly.

Documents are counted by source and exact length. A source takes all its documents as often as its target allows;
the rest of its target is a budget for one more copy of some: first the same share of each length's documents, then
the longest that fit, until about RESERVE words are left, for which a bounded knapsack finds the sum of lengths (with
as many of each as there are left) that comes nearest. The result says how many of each length are taken; which ones,
a seeded hash of the documents says: buckets of hashes are counted for a length, whole buckets are taken up to the one
that the number falls in, and only in that one are documents ranked.

Targets are shared by weight; what exceeds LIMIT times a source's size goes to the others, by weight, until none is above.

Defined cases: a null text has length 0 and is never taken more than its source's whole copies; a null source is a
source of its own, the last one; repeated rows are documents of their own (equal ones are interchangeable); null ids
hash alike and are ranked by what else the row has; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table

WEIGHTS = (3, 1, 2)
TOTAL = 1.5
LIMIT = 2
RESERVE = 1 << 16
RANKED = 2000
SEED = 12


def n_words(text: str = "text") -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t-\r]+"))


def nearest_sum(lengths: np.ndarray, counts: np.ndarray, budget: int, top: int) -> np.ndarray:
    """How many of each length to take so that their sum, at most top, comes nearest to budget (the smaller of two).

    Bounded knapsack over reachable sums; counts are split into powers of two. For each sum the first item that
    reached it is kept, and what remained of the sum then was reached by items before.
    """
    used = np.zeros(len(lengths), np.int64)
    top = max(0, top)
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    by = np.full(top + 1, -1, np.int32)
    items = []
    for i in np.argsort(-lengths, kind="stable"):
        left = min(int(counts[i]), top // int(lengths[i]))
        part = 1
        while left > 0 and not (budget <= top and reached[budget]):
            n = min(part, left)
            left, part = left - n, 2 * part
            step = n * int(lengths[i])
            fresh = np.flatnonzero(reached[: top + 1 - step] & ~reached[step:]) + step
            reached[fresh] = True
            by[fresh] = len(items)
            items.append((i, n, step))
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, n, step = items[by[at]]
        used[i] += n
        at -= step
    return used


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, reserve: int = RESERVE) -> np.ndarray:
    """How many documents of each length to take for a sum near budget."""
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    reserve = min(reserve, budget)
    share = (budget - reserve) / total
    taken = np.minimum(counts, np.floor(counts * share).astype(np.int64))
    taken[lengths == 0] = 0
    left = budget - int((taken * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):  # the longest that fit, down to the reserve
        if lengths[i] and left > reserve:
            n = min(int(counts[i] - taken[i]), (left - reserve) // int(lengths[i]))
            taken[i] += n
            left -= n * int(lengths[i])
    rest = counts - taken
    open_ = np.flatnonzero((rest > 0) & (lengths > 0))
    if not len(open_):
        return taken
    least = int(lengths[open_].min())
    if left + least <= 4 * reserve or left + least <= 4 * RESERVE:
        taken[open_] += nearest_sum(lengths[open_], rest[open_], left, left + least)
        return taken
    # what is left is longer than the reserve each: the longest that fit, then one more if that is nearer
    for i in open_[np.argsort(-lengths[open_], kind="stable")]:
        n = min(int(counts[i] - taken[i]), left // int(lengths[i]))
        taken[i] += n
        left -= n * int(lengths[i])
    over = [i for i in open_ if taken[i] < counts[i]]
    i = min(over, key=lambda i: lengths[i], default=None)
    if i is not None and lengths[i] - left < left:
        taken[i] += 1
    return taken


def ranked_sources(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Sources with their weights: in code point order, null last, the weights repeat.

    Sources are ordered over partitions; a source's place is what earlier partitions hold (their counts come to
    the driver, one number each) and its place in its own.
    """
    spark = sizes.sparkSession
    held = sizes.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    held = held.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    held = Scratch(spark, "mixing-order").write(held, "order")
    counts = sorted(tuple(r) for r in held.groupBy("part").agg(F.count("*")).collect())
    before = accumulate((n for _, n in counts), initial=0)
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "part int, before long")
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    return held.join(F.broadcast(starts), "part").select("source", "source_size", weight.cast("double").alias("weight"))


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, limit: float = LIMIT) -> DataFrame:
    """source, source_size, target. A round finds what each unit of weight gets once sources at their limit are set
    aside; it ends when no other source comes above its limit."""
    ranked = Scratch(sizes.sparkSession, "mixing-sources").write(ranked_sources(sizes, weights), "sources")
    whole = ranked.agg(F.sum("source_size")).head()[0] or 0
    most, unit = F.col("source_size") * float(limit), 0.0
    while True:
        full = most <= F.col("weight") * unit
        fixed, free = ranked.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight")))).head()
        if not free:
            break
        now = max(unit, (whole * total - (fixed or 0.0)) / free)
        if now <= unit:
            break
        unit = now
    free_target = F.col("weight") * F.lit(float(unit))
    target = F.least(most, free_target) if free else most  # noqa: B023
    return ranked.select("source", "source_size", target.alias("target"))


def _fitted(reserve: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        whole = int(target // size) if size else 0
        lengths, counts = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        more = fit(lengths, counts, round(target - whole * size), reserve)
        return rows.assign(whole=whole, more=more)[["source", "size", "n", "source_size", "target", "whole", "more"]]

    return run


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    total: float = TOTAL,
    limit: int = LIMIT,
    seed: int = SEED,
    size: Column | None = None,
    reserve: int = RESERVE,
    ranked: int = RANKED,
) -> DataFrame:
    """doc_id, row_hash (of id and text), source, size, source_size, target, copies of each document.

    weights belong to the sources in code point order, again and again; all sources together get total times the
    size of the table, none more than limit times its own. size: a document's tokens (default: its words).
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = docs.select(
        "doc_id",
        F.xxhash64("doc_id", "text").alias("row_hash"),
        "source",
        F.coalesce(n_words() if size is None else size, F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id").alias("hash"),
    )
    sized = scratch.write(sized, "sizes")
    lengths = scratch.write(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    shared = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, total, limit)
    named = lengths.join(shared.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    plan = named.groupBy("source").applyInPandas(
        _fitted(reserve), "source string, size long, n long, source_size long, target double, whole int, more long"
    )
    plan = scratch.write(plan.withColumn("bits", F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / ranked))).cast("int")), "plan")
    of = plan.withColumnsRenamed({"source": "of", "size": "long"})
    rows = sized.join(of, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("long"))).drop("of", "long")
    none, every = F.col("more") == 0, F.col("more") == F.col("n")
    settled = rows.filter(none | every).withColumn("copies", F.col("whole") + F.when(every, 1).otherwise(0))

    # the first bits of the hash are a document's bucket: bits are chosen so that a bucket has about `ranked` documents
    some = rows.filter(~(none | every))
    some = some.withColumn("bucket", F.expr("case when bits = 0 then 0L else shiftrightunsigned(hash, 64 - bits) end"))
    counts = some.groupBy("source", "size", "bucket").agg(F.count("*").alias("here"), F.first("more").alias("take"))
    earlier = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("open", F.col("take") - F.coalesce(F.sum("here").over(earlier), F.lit(0)))
    counts = scratch.write(
        counts.select(F.col("source").alias("of"), F.col("size").alias("long"), F.col("bucket").alias("b"), "here", "open"), "buckets"
    )
    some = some.join(counts, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("long")) & (F.col("bucket") == F.col("b")))
    some = some.drop("of", "long", "b")
    whole = some.filter("open <= 0 or open >= here")
    whole = whole.withColumn("copies", F.col("whole") + F.when(F.col("open") > 0, 1).otherwise(0))
    cut = some.filter("open > 0 and open < here")
    order = Window.partitionBy("source", "size", "bucket").orderBy("hash", "doc_id", "row_hash")
    cut = cut.withColumn("copies", F.col("whole") + F.when(F.row_number().over(order) <= F.col("open"), 1).otherwise(0))
    columns = ["doc_id", "row_hash", "source", "size", "source_size", "target", "copies"]
    return settled.select(*columns).unionByName(whole.select(*columns)).unionByName(cut.select(*columns))


def take(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix says; of rows with equal id and text one stands for all."""
    copies = mixed.filter("copies > 0").groupBy("row_hash").agg(F.sum("copies").alias("copies"))
    rows = docs.withColumn("row_hash", F.xxhash64("doc_id", "text"))
    rows = rows.dropDuplicates(["row_hash"]).join(copies, "row_hash")
    again = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return rows.select(*docs.columns, again).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
