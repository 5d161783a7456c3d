"""Places and running sums over parts, and overlaps on crowded slides."""

from statistics import median

import numpy as np
from pyspark.sql import functions as F

from conforma.functions import grid as G
from conforma.operators import design, ordering, transform


def test_numbers_and_sums_of_many_and_of_one_key(spark):
    rng = np.random.default_rng(1)
    for keys in (["only"] * 3000, [f"k{int(k)}" if k < 30 else None for k in rng.integers(0, 31, 3000)]):
        rows = [(k, int(o), int(v)) for k, o, v in zip(keys, rng.permutation(3000), rng.integers(-5, 90, 3000), strict=True)]
        df = spark.createDataFrame(rows, "k string, o long, v int")
        got = {tuple(r) for r in ordering.numbered(df, ["k"], [F.col("o")], "n", {"so_far": F.col("v")}, parts=7).collect()}
        want, seen = set(), {}
        for k, o, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
            n, total = seen.get(k, (0, 0))
            seen[k] = n + 1, total + v
            want.add((k, o, v, *seen[k]))
        assert got == want


def test_one_deck_is_cut_into_even_parts(spark):
    df = spark.range(40_000).select(F.lit("deck").alias("deck_id"), F.xxhash64("id").alias("slide_no"))
    sizes = [r["n"] for r in ordering.in_parts(df, ["deck_id", "slide_no"], 8).groupBy("__part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * median(sizes)


def test_descending_order_and_a_place_that_is_there_already(spark):
    df = spark.createDataFrame([("a", i, 99) for i in range(50)], "k string, o int, place int")
    got = ordering.numbered(df, ["k"], [-F.col("o")], parts=4)
    assert {(r.o, r.place) for r in got.collect()} == {(i, 50 - i) for i in range(50)}
    assert got.columns == ["k", "o", "place"]
    assert ordering.numbered(df.limit(0), ["k"], [F.col("o")]).collect() == []


def test_subtitles_of_one_long_deck_follow_each_other(spark):
    df = spark.range(5000).select(F.lit("d").alias("deck_id"), F.col("id").alias("slide_no"), F.expr("repeat('palavra ', int(id % 30))").alias("text"))
    rows = transform.subtitles(df).orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1, 5001)) and rows[0].start_ms == 0
    assert all(a.end_ms == b.start_ms for a, b in zip(rows, rows[1:], strict=False))


SHAPE = "deck_id string, slide_no long, shape_ord int, x long, y long, cx long, cy long, depth int, decorative boolean, hidden boolean"


def pairs(boxes):
    x, y, cx, cy = (np.array(c, np.int64) for c in zip(*boxes, strict=True))
    out = set()
    for i in range(len(x)):
        j = np.arange(i + 1, len(x))
        w = np.maximum(0, np.minimum(x[i] + cx[i], x[j] + cx[j]) - np.maximum(x[i], x[j]))
        h = np.maximum(0, np.minimum(y[i] + cy[i], y[j] + cy[j]) - np.maximum(y[i], y[j]))
        small = np.minimum(cx[i] * cy[i], cx[j] * cy[j])
        meet = (x[i] + G.TOLERANCE < x[j] + cx[j]) & (x[j] + G.TOLERANCE < x[i] + cx[i])
        meet &= (y[i] + G.TOLERANCE < y[j] + cy[j]) & (y[j] + G.TOLERANCE < y[i] + cy[i])
        hit = meet & (small > 0) & (w * h > 0.10 * small)
        out |= {(i, int(k)) for k in j[hit]}
    return out


def overlaps(spark, boxes):
    df = spark.createDataFrame([("d", 1, i, *map(int, b), 0, False, False) for i, b in enumerate(boxes)], SHAPE)
    rows = design.overlapping(df).collect()
    assert len(rows) == len({(r.shape_ord, r.detail) for r in rows})  # each pair once
    return {(r.shape_ord, int(r.detail)) for r in rows}


def test_overlaps_of_boxes_of_all_sizes(spark):
    rng = np.random.default_rng(2)
    for n in (2, 17, 400):
        size = (G.cm(1) * rng.pareto(1.2, (n, 2)) + 1).astype(np.int64).clip(0, G.WIDTH)
        at = rng.integers(-G.cm(5), G.WIDTH, (n, 2))
        boxes = np.concatenate([at, size], axis=1)
        boxes[0] = (0, 0, G.WIDTH, G.HEIGHT)
        boxes[-1] = boxes[n // 2]
        boxes[n // 3, 2:] = 0
        assert overlaps(spark, boxes.tolist()) == pairs(boxes.tolist())


def test_a_crowded_slide_takes_no_quadratic_task(spark):
    """60,000 boxes in a lattice, each over a third of its right neighbour: pairs are as many as boxes, and cells
    hold a bounded number of boxes."""
    side, step = 245, G.cm(3)
    boxes = [(c * step, r * 2 * step, step * 4 // 3, step) for r in range(side) for c in range(side)]
    df = spark.createDataFrame([("d", 1, i, *b, 0, False, False) for i, b in enumerate(boxes)], SHAPE)
    cells = design.in_cells(df).groupBy("cell_x", "cell_y").count().agg(F.max("count"), F.sum("count")).head()
    assert cells[0] <= 8 * design.PER_CELL and cells[1] <= 5 * len(boxes)
    assert design.overlapping(df).count() == side * (side - 1)
