"""Decks in, findings out: inherited attributes are resolved, then the whole catalogue runs.

The tables are those of sources.pptx.read_decks. Styles are joined to shapes, and shapes to runs and
paragraphs, by their keys; style tables grow with templates only. A deck without layouts, masters or a
theme has what its slides say themselves; what can't be resolved is unverified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour as C
from ..functions import text as T
from . import catalogue, report, resolve, rules

SLIDE = ["deck_id", "slide_no"]
SHAPE = [*SLIDE, "shape_ord"]
PARAGRAPH = [*SHAPE, "para_ord"]

# The slots of a colour scheme, which colours may name without a map.
SLOTS = ("dk1", "lt1", "dk2", "lt2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink")


def inherited(shapes: DataFrame, slides: DataFrame, styles: DataFrame) -> DataFrame:
    """shapes with resolved boxes (x, y, cx, cy, box_origin) and the list styles of their layout, master,
    master's text and deck (layout_levels, master_levels, text_levels, default_levels)."""
    parts = slides.select(*SLIDE, "layout_part", "master_part")
    rows = shapes.join(parts, SLIDE, "left")
    for scope in ("layout", "master"):
        held = styles.filter(F.col("scope") == scope).withColumn("style", F.struct("levels", F.struct("x", "y", "cx", "cy").alias("box")))
        own = rows.filter("is_ph").select(*SHAPE, F.col(f"{scope}_part").alias("part"), "ph_type", "ph_idx")
        found = resolve.match_placeholder(own, held)
        box = F.when(F.col("style.box.x").isNotNull(), F.col("style.box"))
        rows = rows.join(found.select(*SHAPE, F.col("style.levels").alias(f"{scope}_levels"), box.alias(f"{scope}_box")), SHAPE, "left")
    text = styles.filter("scope = 'text'").select("deck_id", F.col("part").alias("master_part"), F.col("ph_type").alias("bucket"), F.col("levels").alias("text_levels"))
    default = styles.filter("scope = 'default'").select("deck_id", F.col("levels").alias("default_levels"))
    rows = rows.withColumn("bucket", resolve.style_bucket(F.col("ph_type"))).join(text, ["deck_id", "master_part", "bucket"], "left")
    rows = rows.join(default, "deck_id", "left").withColumn("own", F.when(F.col("x").isNotNull(), F.struct("x", "y", "cx", "cy")))
    return resolve.box(rows.drop("x", "y", "cx", "cy")).drop("own", "layout_box", "master_box", "layout_part", "master_part", "bucket")


def palettes(maps: DataFrame, schemes: DataFrame, slides: DataFrame) -> DataFrame:
    """Each slide's colours by alias: palette (map), of its maps' aliases and the scheme's slots."""
    slots = slides.select(*SLIDE, F.explode(F.array(*[F.lit(s) for s in SLOTS])).alias("alias"))
    aliases = maps.select(*SLIDE, "alias").unionByName(slots).distinct()
    aliases = aliases.join(slides.select(*SLIDE, "master_part"), SLIDE)
    known = resolve.theme_colour(aliases, maps, resolve.schemes_by_master(schemes, slides)).filter("hex is not null")
    return known.groupBy(*SLIDE).agg(F.map_from_entries(F.collect_list(F.struct("alias", "hex"))).alias("palette"))


def shown(colour: Column, palette: Column) -> Column:
    """The hex value of a written colour; null where it has no single or known one."""
    base = C.parse_hex(F.coalesce(colour["hex"], F.try_element_at(palette, colour["alias"])))
    changed = F.coalesce(F.size(colour["mods"]), F.lit(0)) > 0
    return F.when(base.isNotNull(), F.when(changed, C.to_hex(C.modified(base, colour["mods"]))).otherwise(C.to_hex(base)))


def alias(name: str) -> Column:
    """A theme's colour, unmodified."""
    kind = "struct<hex: string, alias: string, mods: array<struct<name: string, val: int>>, reason: string>"
    return F.from_json(F.lit(f'{{"alias": "{name}"}}'), kind)


def resolved_runs(runs: DataFrame, shapes: DataFrame, slides: DataFrame, palette: DataFrame) -> DataFrame:
    """runs with size, fg, bg and reason, each inherited where a run doesn't set its own."""
    level = ("levels", "layout_levels", "master_levels", "text_levels", "default_levels")
    rows = runs.join(shapes.select(*SHAPE, "is_ph", "fill", "style_colour", *level), SHAPE, "left")
    rows = rows.join(slides.select(*SLIDE, "slide_bg", "layout_bg", "master_bg"), SLIDE, "left").join(palette, SLIDE, "left")
    sizes = {"shape_sz": "levels", "layout_sz": "layout_levels", "master_sz": "master_levels", "text_sz": "text_levels", "default_sz": "default_levels"}
    rows = resolve.font_size(rows.withColumns({n: F.get(F.col(f"{c}.sz"), F.col("lvl")) for n, c in sizes.items()}))
    own = [F.get(F.col(f"{c}.colour"), F.col("lvl")) for c in level]
    held = [F.when(F.col("is_ph"), c) for c in own[1:4]]
    fg = F.coalesce("colour", "para_colour", own[0], "style_colour", *held, own[4], alias("tx1"))
    bg = F.coalesce("cell_fill", "fill", "slide_bg", "layout_bg", "master_bg", alias("bg1"))
    rows = rows.withColumns({"__f": fg, "__b": bg})
    unknown = F.coalesce("__f.reason", "__b.reason", F.lit("unresolved colour"))
    rows = rows.withColumns({"fg": shown(F.col("__f"), F.col("palette")), "bg": shown(F.col("__b"), F.col("palette"))})
    rows = rows.withColumn("reason", F.when(F.col("fg").isNull() | F.col("bg").isNull(), unknown))
    return rows.withColumn("bold", resolve.bold(F.col("bold"), F.lit(None).cast("boolean"))).drop("__f", "__b", "palette", "fill", "style_colour", *level)


def resolved_caps(runs: DataFrame, paragraphs: DataFrame, shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """paragraphs with caps, max_size and first_size, and shapes with the caps of their first paragraph that has any."""
    spoken = runs.filter(~T.blank(F.col("text"))).groupBy(*PARAGRAPH)
    first = F.min_by("size", "run_ord").alias("first_size")
    spoken = spoken.agg(F.max("size").alias("max_size"), first, F.min_by("run_cap", "run_ord").alias("run_cap"))
    level = ("layout", "master", "text")
    held = shapes.select(*SHAPE, *[F.when(F.col("is_ph"), F.col(f"{n}_levels.cap")).alias(f"__{n}") for n in level])
    rows = paragraphs.join(spoken, PARAGRAPH, "left").join(held, SHAPE, "left")
    rows = resolve.caps(rows.withColumns({f"{n}_cap": F.get(F.col(f"__{n}"), F.col("lvl")) for n in level})).drop(*[f"__{n}" for n in level])
    big = rows.filter(F.col("caps").isin("all", "small")).groupBy(*SHAPE).agg(F.min_by("caps", "para_ord").alias("caps"))
    return rows, shapes.join(big, SHAPE, "left")


def linked(runs: DataFrame, shapes: DataFrame, rels: DataFrame) -> DataFrame:
    """Texts with links of their own and, for links of whole shapes, the shapes' texts; with targets."""
    keys = ["deck_id", "slide_no", "shape_ord", "text", "link_rid"]
    rows = runs.filter("link_rid is not null").select(*keys).unionByName(shapes.filter("link_rid is not null").select(*keys))
    return rules.link_targets(rows.filter(~T.blank(F.col("text"))), rels)


def resolved(decks: dict[str, DataFrame], out: str) -> dict[str, DataFrame]:
    """decks with shapes, runs and paragraphs resolved, each written once below the shared folder out."""

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{out}/{name}")
        return rows.sparkSession.read.parquet(f"{out}/{name}")

    slides = decks["slide"]
    shapes = kept(inherited(decks["shape"], slides, decks["style"]), "boxes")
    palette = palettes(decks["colour_map"], decks["scheme"], slides)
    runs = kept(resolved_runs(decks["run"], shapes, slides, palette), "runs")
    paragraphs, shapes = resolved_caps(runs, decks["paragraph"], shapes)
    shapes = shapes.join(decks["deck"].select("deck_id", "slide_w", "slide_h"), "deck_id", "left")
    return decks | {"run": runs, "paragraph": kept(paragraphs, "paragraphs"), "shape": kept(shapes, "shapes")}


def audit(decks: dict[str, DataFrame], out: str, language: str = "pt") -> DataFrame:
    """The findings of all rules on decks (the tables of read_decks).

    The rules read resolved tables, which are written below out (a new shared folder), so that nothing is
    resolved anew for each rule; rules of single rows take one scan a table (see catalogue).
    """
    return findings(resolved(decks, out), language)


def findings(tables: dict[str, DataFrame], language: str = "pt") -> DataFrame:
    """The findings on resolved tables."""
    links = linked(tables["run"], tables["shape"], tables["rel"])
    return report.union([catalogue.row_rules(tables, language), catalogue.grouped_rules(tables, links, language)])


def reports(decks: dict[str, DataFrame], out: str, language: str = "pt") -> tuple[DataFrame, DataFrame]:
    """The findings, and the rules that were evaluated on each deck."""
    tables = resolved(decks, out)
    return findings(tables, language), catalogue.evaluated(tables)
