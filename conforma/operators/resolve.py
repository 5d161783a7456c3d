"""Inherited attributes: ordered fall-backs as left joins to small style tables, with their origin.

Style tables: style_level(deck_id, part, scope, ph_type, ph_idx, ph_ord, lvl, sz, cap, x, y, cx, cy),
scope being 'layout', 'master', 'text' (ph_type then is the bucket) or 'default'. Tables of styles
grow with templates, not with documents; Spark decides by their size whether to broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def style_bucket(ph_type: Column) -> Column:
    return (
        F.when(ph_type.isin("title", "ctrTitle"), "title")
        .when(ph_type.isin("body", "subTitle", "obj"), "body")
        .otherwise("other")
    )


def is_title(ph_type: Column) -> Column:
    return F.coalesce(ph_type.isin("title", "ctrTitle"), F.lit(False))


def match_placeholder(shapes: DataFrame, placeholders: DataFrame) -> DataFrame:
    """shapes (deck_id, slide_no, shape_ord, part, ph_type, ph_idx) with the best of the part's
    placeholders: the first of equal idx or both titles, else the first of equal type."""
    p = placeholders.select(
        "deck_id", "part", F.col("ph_type").alias("p_type"), F.col("ph_idx").alias("p_idx"), "ph_ord", "style"
    )
    titles = is_title(F.col("ph_type")) & is_title(F.col("p_type"))
    close = (F.col("ph_idx") == F.col("p_idx")) | titles
    same = F.col("ph_type") == F.col("p_type")
    rows = shapes.join(p, ["deck_id", "part"]).filter(close | same)
    rank = F.struct(F.when(close, 0).otherwise(1), "ph_ord")
    return rows.groupBy("deck_id", "slide_no", "shape_ord").agg(F.min_by("style", rank).alias("style"))


def first_of(chain: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """The first value that is not null, and its origin's name."""
    value = F.coalesce(*[c for _, c in chain])
    origin = F.lit(None).cast("string")
    for name, c in reversed(chain):
        origin = F.when(c.isNotNull(), F.lit(name)).otherwise(origin)
    return value, F.coalesce(origin, F.lit("unresolved"))


def font_size(runs: DataFrame) -> DataFrame:
    """runs with size and size_origin from run, paragraph, shape, layout, master, text and default
    sizes; a size of 0 counts as none, and shapes that are no placeholder skip layout to text."""

    def own(c: str) -> Column:
        return F.nullif(F.col(c), F.lit(0))

    def held(c: str) -> Column:
        return F.when(F.col("is_ph"), own(c))

    chain = [
        ("run", own("sz")),
        ("paragraph", own("para_sz")),
        ("shape", own("shape_sz")),
        ("layout", held("layout_sz")),
        ("master", held("master_sz")),
        ("text style", held("text_sz")),
        ("default", own("default_sz")),
    ]
    value, origin = first_of(chain)
    return runs.withColumns({"size": value, "size_origin": origin})


def caps(rows: DataFrame) -> DataFrame:
    """rows with caps and caps_origin; inherited values other than all and small count as none."""

    def inherited(c: str) -> Column:
        return F.when(F.col(c).isin("all", "small"), F.col(c))

    chain = [("run", F.col("run_cap")), ("paragraph", F.col("para_cap"))]
    chain += [(n, inherited(f"{n}_cap")) for n in ("layout", "master", "text")]
    value, origin = first_of(chain)
    return rows.withColumns({"caps": value, "caps_origin": origin})


def bold(run: Column, paragraph: Column) -> Column:
    return F.coalesce(run, paragraph, F.lit(False))


def box(rows: DataFrame) -> DataFrame:
    """rows with x, y, cx, cy and box_origin from struct columns own, layout_box and master_box (the
    last two only for placeholders); a box is taken whole."""
    chain = [
        ("slide", F.col("own")),
        ("layout", F.when(F.col("is_ph"), F.col("layout_box"))),
        ("master", F.when(F.col("is_ph"), F.col("master_box"))),
    ]
    value, origin = first_of(chain)
    found = rows.withColumns({"__box": value, "box_origin": origin})
    return found.withColumns({c: F.col(f"__box.{c}") for c in ("x", "y", "cx", "cy")}).drop("__box")


def schemes_by_master(schemes: DataFrame, slides: DataFrame) -> DataFrame:
    """deck_id, master_part, slot, hex: the colours of every master that slides use; a master without a theme of its
    own, and slides without a master, have the deck's (part null). A row a master and slot."""
    masters = slides.select("deck_id", "master_part").distinct()
    own = schemes.filter("part is not null").select("deck_id", F.col("part").alias("master_part"), "slot", "hex")
    lacking = masters.join(own.select("deck_id", "master_part").distinct(), ["deck_id", "master_part"], "left_anti")
    general = lacking.join(schemes.filter("part is null").select("deck_id", "slot", "hex"), "deck_id")
    return own.unionByName(general.select(*own.columns))


def theme_colour(colours: DataFrame, maps: DataFrame, schemes: DataFrame) -> DataFrame:
    """colours (…, deck_id, slide_no, alias) with hex: alias to slot by the most specific map (slide,
    layout, master), slot to the scheme's colour, that of the slide's master where schemes and colours name
    it (master_part); 'phClr' stays unresolved."""
    rank = F.when(F.col("level") == "slide", 0).when(F.col("level") == "layout", 1).otherwise(2)
    slots = maps.groupBy("deck_id", "slide_no", "alias").agg(F.min_by("slot", rank).alias("slot"))
    known = colours.join(slots, ["deck_id", "slide_no", "alias"], "left")
    known = known.withColumn("slot", F.when(F.col("alias") != "phClr", F.coalesce("slot", "alias")))
    if "master_part" not in schemes.columns:
        return known.join(schemes.select("deck_id", "slot", "hex"), ["deck_id", "slot"], "left")
    held = schemes.select(*[F.col(c).alias(f"__{c}") for c in ("deck_id", "master_part", "slot")], "hex")
    same = (F.col("deck_id") == F.col("__deck_id")) & (F.col("slot") == F.col("__slot")) & F.col("master_part").eqNullSafe(F.col("__master_part"))
    return known.join(held, same, "left").drop("__deck_id", "__master_part", "__slot")


def background(slides: DataFrame) -> DataFrame:
    """slides with bg and bg_origin from slide_bg, layout_bg, master_bg and light1."""
    names = ("slide", "layout", "master")
    value, origin = first_of([*[(n, F.col(f"{n}_bg")) for n in names], ("theme", F.col("light1"))])
    return slides.withColumns({"bg": value, "bg_origin": origin})


def column_bands(boxes: DataFrame, keys: list[str], slack: int) -> DataFrame:
    """boxes with band: the number of the merged x-interval that each box falls into."""
    order = Window.partitionBy(*keys).orderBy("x", "cx", "shape_ord")
    reach = F.max(F.col("x") + F.col("cx")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("x") >= reach - slack), 1).otherwise(0)
    held = boxes.withColumn("__new", fresh)
    return held.withColumn("band", F.sum("__new").over(order)).drop("__new")
