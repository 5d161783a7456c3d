"""Layer N: the geometry of slides. Shapes: top-level, not hidden, boxes resolved (see resolve.box)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grid as G
from ..functions import text as T
from .report import finding, row_findings, union
from .resolve import column_bands, is_title
from .rules import PK, SHAPE, in_scope, order_ranks, scope, within


def useful(shapes: DataFrame) -> DataFrame:
    return scope(shapes, decorative=False, hidden=False).filter("x is not null")


def distorted_tests(columns: list[str]) -> list[tuple]:
    """A picture's ratio is off its native one by over 1 %; without native size, unverified."""
    native = F.try_divide("native_w", "native_h")
    off = F.try_divide(F.abs(F.try_divide("cx", "cy") - native), native)
    unknown = F.col("native_w").isNull() | F.col("native_h").isNull()
    tests = [("N01", "E", off > G.RATIO_TOLERANCE, off), ("N01", "E", unknown, None, None, "unverified")]
    return within(in_scope(columns) & F.expr("tag = 'pic' and cx is not null and cy > 0"), tests)


def distorted(shapes: DataFrame) -> DataFrame:
    return row_findings(shapes, distorted_tests(shapes.columns))


def useful_scope(columns: list[str]):
    return in_scope(columns, decorative=False, hidden=False) & F.col("x").isNotNull()


def outside_tests(columns: list[str]) -> list[tuple]:
    """Into the footer, or else beyond the margins."""
    foot = F.col("y") + F.col("cy") > G.FOOTER_Y + G.TOLERANCE
    safe = G.inside_safe_area(*[F.col(c) for c in ("x", "y", "cx", "cy")])
    cause = F.when(foot, "footer").when(~safe, "margin")
    return within(useful_scope(columns), [("N02", "E", cause.isNotNull(), F.col("y") + F.col("cy"), cause)])


def outside(shapes: DataFrame) -> DataFrame:
    return row_findings(shapes, outside_tests(shapes.columns))


PER_CELL = 16


def in_cells(boxes: DataFrame, per_cell: int = PER_CELL) -> DataFrame:
    """A row for each cell of its slide's grid that a box touches: cell_x, cell_y, and first_x, first_y, the box's first
    cell. Two boxes that overlap share the cell at the left upper corner of what they share, whose numbers are
    the greater ones of their first cells; a pair is met there only.

    A slide of n boxes has about n / per_cell cells, none smaller than its average box, so that boxes
    lie in about four cells and cells hold about per_cell boxes, however many a slide has.
    """
    side = F.ceil(F.sqrt(F.count("*") / F.lit(float(per_cell))))

    def width(low: str, size: str) -> Column:
        extent = F.max(F.col(low) + F.col(size)) - F.min(low)
        return F.greatest(F.lit(1), F.ceil(extent / side), F.ceil(F.avg(size))).cast("long")

    grid = boxes.groupBy(*PK).agg(F.min("x").alias("__x"), F.min("y").alias("__y"), width("x", "cx").alias("__w"), width("y", "cy").alias("__h"))

    def cell(low: str, size: str | None, origin: str, step: str) -> Column:
        at = F.col(low) - F.col(origin) + (F.greatest(F.lit(0), F.col(size)) if size else F.lit(0))
        return F.floor(at / F.col(step)).cast("int")

    rows = boxes.join(grid, PK)
    rows = rows.withColumns({"first_x": cell("x", None, "__x", "__w"), "first_y": cell("y", None, "__y", "__h")})
    rows = rows.withColumn("cell_x", F.explode(F.sequence("first_x", cell("x", "cx", "__x", "__w"))))
    rows = rows.withColumn("cell_y", F.explode(F.sequence("first_y", cell("y", "cy", "__y", "__h"))))
    return rows.drop("__x", "__y", "__w", "__h")


def overlapping(shapes: DataFrame) -> DataFrame:
    """Two shapes of a slide share over 10 % of the smaller one's area."""
    rows = in_cells(useful(shapes).select(*SHAPE, "x", "y", "cx", "cy"))
    a, b = rows.alias("a"), rows.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*PK, "cell_x", "cell_y")]
    once = (F.greatest("a.first_x", "b.first_x") == F.col("a.cell_x")) & (F.greatest("a.first_y", "b.first_y") == F.col("a.cell_y"))
    pairs = a.join(b, reduce(lambda p, q: p & q, same) & once & (F.col("a.shape_ord") < F.col("b.shape_ord")) & G.overlap("a", "b"))
    smaller = F.least(F.col("a.cx") * F.col("a.cy"), F.col("b.cx") * F.col("b.cy"))
    share = G.intersection("a", "b") / smaller
    found = pairs.filter((smaller > 0) & (share > 0.10))
    found = found.select(*[F.col(f"a.{c}") for c in SHAPE], F.col("b.shape_ord").alias("other"), share.alias("share"))
    return finding(found, "N03", "A", F.col("share"), F.col("other"))


def visual_order(shapes: DataFrame) -> DataFrame:
    """Like C02 with the grid's height; columns count only if the body has two bands or more."""
    rows = useful(shapes).filter("media_kind is null").withColumn("titled", is_title(F.col("ph_type")))
    bands = column_bands(rows.filter("not titled"), PK, G.TOLERANCE)
    bands = bands.groupBy(*PK).agg(F.max("band").alias("bands"))
    ranked = order_ranks(rows, G.HEIGHT // 12)
    grouped = ranked.groupBy(*PK).agg(
        F.count("*").alias("n"),
        F.bool_or(F.col("rn_tree") != F.col("rn_row")).alias("off_row"),
        F.bool_or(F.col("rn_tree") != F.col("rn_col")).alias("off_col"),
        F.min(F.when(F.col("titled"), F.struct("shape_ord", "rn_row"))).alias("t"),
        F.min_by("shape_ord", "rn_row").alias("top"),
    )
    joined = grouped.join(bands, PK, "left")
    columns = ~F.col("off_col") & (F.coalesce("bands", F.lit(0)) >= 2)
    bad = joined.filter((F.col("n") > 1) & F.col("off_row") & ~columns)
    above = F.coalesce(F.col("t.rn_row") > 1, F.lit(False))
    bad = bad.withColumn("shape_ord", F.when(above, F.col("top")))
    return finding(bad, "N04", "E", F.col("n"), F.when(above, "above title").otherwise("order"))


def idle(shapes: DataFrame, slides: DataFrame) -> DataFrame:
    """The body's bounding box leaves over 42 % of the usable area empty."""
    body = useful(shapes).filter(~is_title(F.col("ph_type"))).groupBy(*PK)
    body = body.agg(
        F.min("x").alias("x0"),
        F.greatest(F.lit(G.CONTENT_Y), F.min("y")).alias("y0"),
        F.max(F.col("x") + F.col("cx")).alias("x1"),
        F.max(F.col("y") + F.col("cy")).alias("y1"),
    )
    layout = F.lower(T.strip(F.coalesce("layout_name", F.lit(""))))
    kept = slides.filter(~layout.isin(*G.BREATHING_LAYOUTS)).select(*PK, layout.alias("layout"))
    width = F.when(F.col("layout").contains("libras"), G.columns_width(8)).otherwise(G.WIDTH - 2 * G.MARGIN)
    area = width * F.lit(G.FOOTER_Y - G.CONTENT_Y).cast("long")
    share = 1 - (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / area
    rows = body.join(kept, PK).withColumn("share", share)
    return finding(rows.filter(F.col("share") > G.IDLE_MOST), "N05", "A", F.col("share"))


def near_edges(shapes: DataFrame) -> DataFrame:
    """The first two left edges of a slide that nearly align."""
    lefts = useful(shapes).select(*PK, "x").distinct()
    ahead = F.lead("x").over(Window.partitionBy(*PK).orderBy("x"))
    gaps = lefts.withColumn("gap", ahead - F.col("x")).filter(F.col("gap").between(1, 3 * G.TOLERANCE))
    first = gaps.groupBy(*PK).agg(F.min("x").alias("x"), F.min_by("gap", "x").alias("gap"))
    return finding(first, "N06", "A", F.col("gap"), F.col("x"))


def title_heights(shapes: DataFrame, slides: DataFrame) -> DataFrame:
    """Titles of one layout at different heights (to 0.1 cm)."""
    rows = scope(shapes, hidden=False).filter(is_title(F.col("ph_type")) & F.col("y").isNotNull())
    rows = rows.join(slides.select(*PK, "layout_name"), PK)
    n = F.count_distinct(F.bround(F.col("y") / F.lit(float(G.EMU_CM)), 1))
    grouped = rows.groupBy("deck_id", F.coalesce("layout_name", F.lit("")).alias("layout")).agg(n.alias("n"))
    return finding(grouped.filter("n > 1"), "N07", "A", F.col("n"), F.col("layout"))


def variety(runs: DataFrame) -> DataFrame:
    """Over four sizes, and over four colours, on one slide."""
    rows = scope(runs, groups=True, decorative=False).filter(~T.blank(F.col("text")))
    n = rows.groupBy(*PK).agg(
        F.count_distinct(F.nullif("sz", F.lit(0))).alias("sizes"), F.count_distinct("literal_colour").alias("colours")
    )
    return union([finding(n.filter(F.col(c) > 4), "N08", "A", F.col(c), F.lit(c)) for c in ("sizes", "colours")])


def inherited_caps_tests(columns: list[str]) -> list[tuple]:
    """A shape's text shows in capitals that it inherits."""
    shown = F.col("caps").isin("all", "small") & ~T.blank(F.col("text"))
    return within(in_scope(columns, hidden=False), [("N09", "E", shown, None, F.col("caps"))])


def inherited_caps(shapes: DataFrame) -> DataFrame:
    return row_findings(shapes, inherited_caps_tests(shapes.columns))


def small_figure_tests(columns: list[str]) -> list[tuple]:
    """A picture's shorter side is below 6 cm."""
    side = F.least("cx", "cy")
    figure = F.expr("tag = 'pic' and media_kind is null")
    return within(useful_scope(columns), [("N10", "A", figure & (side < G.FIGURE_LEAST), side)])


def small_figures(shapes: DataFrame) -> DataFrame:
    return row_findings(shapes, small_figure_tests(shapes.columns))


def furniture(shapes: DataFrame, slides: DataFrame) -> DataFrame:
    """In decks of four slides or more, a decorative name on most of them."""
    rows = scope(shapes, hidden=False).filter(F.col("decorative") & F.col("x").isNotNull())
    named = rows.groupBy("deck_id", F.coalesce("name", F.lit("")).alias("name"))
    named = named.agg(F.count("*").alias("n"), F.count_distinct("x", "y", "cx", "cy").alias("boxes"))
    total = slides.groupBy("deck_id").agg(F.count("*").alias("total")).filter("total >= 4")
    least = F.greatest(F.lit(4), F.floor(F.col("total") * 0.6))
    return finding(named.join(total, "deck_id").filter(F.col("n") >= least), "N11", "A", F.col("n"), F.col("name"))


def text_overflow(shapes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The estimated height of a box's text exceeds 1.25 times the box.

    paragraphs: text, first_size (1/100 pt, null: 18 pt), line_pct (null: single).
    """
    boxes = useful(shapes).filter("tag = 'sp' and media_kind is null and cx > 0 and cy > 0")
    rows = paragraphs.filter(~T.blank(F.col("text"))).select(*SHAPE, F.char_length("text").alias("length"), "first_size", "line_pct")
    rows = rows.join(boxes.select(*SHAPE, "cx", "cy"), SHAPE)
    points = F.coalesce(F.nullif("first_size", F.lit(0)) / 100.0, F.lit(18.0))
    per_line = F.greatest(F.lit(8), (F.col("cx") / G.EMU_CM / (points * (G.CM_PER_POINT * 0.5))).cast("int"))
    lines = F.greatest(F.lit(1), F.ceil(F.col("length") / per_line))
    spacing = F.coalesce(F.nullif("line_pct", F.lit(0)), F.lit(100000)) / 100000.0
    need = lines * points * G.CM_PER_POINT * spacing * 1.2
    total = rows.groupBy(*SHAPE).agg(F.sum(need).alias("need"), F.first("cy").alias("cy"))
    return finding(total.filter(F.col("need") > F.col("cy") / G.EMU_CM * 1.25), "N12", "A", F.col("need"))
