"""Slide geometry: the grid's measures in EMU and interval expressions on boxes.

A box is four long columns: x, y, cx, cy.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMU_CM = 360_000


def cm(x: float) -> int:
    return round(x * EMU_CM)


# The grid, in cm.
WIDTH, HEIGHT = cm(33.87), cm(19.05)
MARGIN, CONTENT_Y, CONTENT_END, FOOTER_Y = cm(1.4), cm(4.2), cm(17.4), cm(17.9)
COLUMNS, GUTTER = 12, cm(0.5)
TOLERANCE = cm(0.12)
IDLE_MOST = 0.42
FIGURE_LEAST = cm(6)
RATIO_TOLERANCE = 0.01
TARGET_LEAST = 228_600
BREATHING_LAYOUTS = ("capa", "seção", "secao", "citação", "citacao", "encerramento")
CM_PER_POINT = 0.03528


def columns_width(n: int) -> int:
    one = (WIDTH - 2 * MARGIN - (COLUMNS - 1) * GUTTER) // COLUMNS
    return n * one + (n - 1) * GUTTER


def column_x(i: int) -> int:
    """The left edge of column i, from 0."""
    one = (WIDTH - 2 * MARGIN - (COLUMNS - 1) * GUTTER) // COLUMNS
    return MARGIN + i * (one + GUTTER)


def inside_safe_area(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    low, right, bottom = MARGIN - TOLERANCE, WIDTH - MARGIN + TOLERANCE, FOOTER_Y + TOLERANCE
    return x.between(low, right) & (x + cx <= right) & (y >= low) & (y + cy <= bottom)


def overlap(a: str, b: str, slack: int = TOLERANCE) -> Column:
    """Whether two aliased boxes meet by more than slack."""
    c = F.col
    return (
        (c(f"{a}.x") + slack < c(f"{b}.x") + c(f"{b}.cx"))
        & (c(f"{b}.x") + slack < c(f"{a}.x") + c(f"{a}.cx"))
        & (c(f"{a}.y") + slack < c(f"{b}.y") + c(f"{b}.cy"))
        & (c(f"{b}.y") + slack < c(f"{a}.y") + c(f"{a}.cy"))
    )


def intersection(a: str, b: str) -> Column:
    """The area two aliased boxes share."""

    def side(p: str, s: str) -> Column:
        ends = F.least(F.col(f"{a}.{p}") + F.col(f"{a}.{s}"), F.col(f"{b}.{p}") + F.col(f"{b}.{s}"))
        return F.greatest(F.lit(0), ends - F.greatest(f"{a}.{p}", f"{b}.{p}"))

    return side("x", "cx") * side("y", "cy")


def fit(width: Column, height: Column, box_w: Column, box_h: Column) -> Column:
    """(w, h, dx, dy): an image scaled into a box, its ratio kept, centred."""
    scale = F.least(box_w / width, box_h / height)
    w, h = (width * scale).cast("bigint"), (height * scale).cast("bigint")
    return F.struct(
        w.alias("w"),
        h.alias("h"),
        ((box_w - w) / 2).cast("bigint").alias("dx"),
        ((box_h - h) / 2).cast("bigint").alias("dy"),
    )


# Heights of a card's edge and lines, and of a table's rows.
CARD_EDGE, CARD_LINE, CARD_LEAST = cm(2.6), cm(1.5), 0.72
ROW_LEAST, ROW_MOST = cm(1.05), cm(1.75)


def card_height(lines: Column) -> Column:
    """The height of a row of cards whose fullest one has that many lines, its title included."""
    room = CONTENT_END - CONTENT_Y
    return F.greatest(F.lit(int(room * CARD_LEAST)), F.least(F.lit(room), lines * CARD_LINE + CARD_EDGE)).cast("bigint")


def table_box(y: Column, rows: Column) -> Column:
    """(row_height, height, y, fits, most): a table of that many rows, its header included, in what is left below y. A
    short one moves down by a third of the room left; most is how many rows would do where it doesn't fit."""
    room = F.lit(FOOTER_Y) - y
    row = F.greatest(F.lit(ROW_LEAST), F.least(F.lit(ROW_MOST), F.floor(room / rows))).cast("bigint")
    height = row * rows
    place = y + F.when(height < room, F.floor((room - height) / 3)).otherwise(0)
    fits = place + height <= FOOTER_Y
    most = F.when(~fits, F.greatest(F.lit(1), (room / ROW_LEAST).cast("bigint") - 1))
    return F.struct(
        row.alias("row_height"), height.cast("bigint").alias("height"), place.cast("bigint").alias("y"), fits.alias("fits"), most.cast("bigint").alias("most")
    )
