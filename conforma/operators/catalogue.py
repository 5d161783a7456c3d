"""All rules of single rows in one pass a grain.

Each grain (deck, section, slide, shape, paragraph, run) has facts, which are worked out once for a row,
and tests on them. `row_rules` evaluates all tests of a grain in one scan of its table and one projection, however many
rules there are; `grouped_rules` has those that compare rows, one plan for each key they are grouped by.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import design, rules
from .report import row_findings, union

GRAINS = ("deck", "section", "slide", "shape", "paragraph", "run")


def _linked(columns: list[str]) -> list[tuple]:
    """H01, H02 on texts with links of their own."""
    return rules.within(F.col("link_rid").isNotNull() & ~T.blank(F.col("text")), rules.link_tests())


def tests(grain: str, columns: list[str], language: str = "pt") -> list[tuple]:
    """The tests of a grain: (rule, severity, condition[, value[, detail[, verdict]]]), scope included.

    A rule whose facts a table doesn't have (columns) is left out, and so is not among `rules_of`.
    """
    of: dict[str, list[tuple[Callable[[], list[tuple]], set[str]]]] = {
        "deck": [(lambda: rules.metadata_tests(language), {"title", "language", "author", "stem"}), (rules.constant_tests, set())],
        "section": [(rules.section_tests, {"name"})],
        "slide": [(rules.blank_layout_tests, {"layout_name"}), (rules.transition_tests, {"transition_children"})],
        "shape": [
            (lambda: rules.loose_text_tests(columns), {"tag", "is_ph", "text"}),
            (lambda: rules.object_tests(columns), {"n_children", "alt", "name", "slide_w", "slide_h"}),
            (rules.alt_tests, {"tag", "is_ph", "text", "alt", "content_uri"}),
            (lambda: rules.media_tests(columns), {"has_link", "media_kind", "cx", "cy"}),
            (lambda: design.distorted_tests(columns), {"native_w", "native_h"}),
            (lambda: design.outside_tests(columns), {"x", "y", "cx", "cy", "hidden"}),
            (lambda: design.inherited_caps_tests(columns), {"caps", "text", "hidden"}),
            (lambda: design.small_figure_tests(columns), {"tag", "media_kind", "cx", "cy", "hidden"}),
            (lambda: _linked(columns), {"link_rid", "text"}),
        ],
        "paragraph": [
            (lambda: rules.typed_bullet_tests(columns), {"text", "bullet"}),
            (lambda: rules.long_line_tests(columns), {"text"}),
            (lambda: rules.shouted_tests(columns), {"text"}),
            (lambda: rules.paragraph_tests(columns), {"text", "titled", "cell_ri", "max_size", "line_pct", "algn"}),
        ],
        "run": [
            (lambda: rules.contrast_tests(columns), {"fg", "bg", "reason", "size", "bold"}),
            (lambda: rules.run_tests(columns), {"typeface", "size", "titled", "i", "u", "has_link"}),
            (lambda: _linked(columns), {"link_rid", "text"}),
        ],
    }
    return [test for make, needs in of[grain] if needs <= set(columns) for test in make()]


def facts(grain: str, rows: DataFrame) -> DataFrame:
    """rows with the facts that several tests of the grain share."""
    if grain == "shape" and {"tag", "is_ph", "text", "alt", "content_uri"} <= set(rows.columns):
        return rules.alt_facts(rows)
    if grain == "run" and {"fg", "bg", "size", "bold"} <= set(rows.columns):
        return rules.contrast_facts(rows)
    return rows


def rules_of(grain: str, columns: list[str]) -> list[str]:
    """Ids of the rules that are evaluated on a table with these columns."""
    return sorted({test[0] for test in tests(grain, columns)})


def row_rules(tables: dict[str, DataFrame], language: str = "pt") -> DataFrame:
    """Findings of all rules of single rows: each table is scanned once. Tables may be absent.

    shape: slide_w and slide_h on every row; D07 is kept on slides without notes, which only its candidates are
    joined with.
    """
    found = []
    for grain in GRAINS:
        if grain in tables:
            rows = tables[grain]
            own = row_findings(facts(grain, rows), tests(grain, rows.columns, language))
            if grain == "shape" and "notes" in tables.get("slide", rows.limit(0)).columns:
                own = rules.silent_only(own, tables["slide"])
            found.append(own)
    return union(found)


def grouped_rules(tables: dict[str, DataFrame], links: DataFrame, language: str = "pt") -> DataFrame:
    """Findings of the rules that count, rank or compare the rows of a slide, a deck or a text."""
    deck, slides, shapes, paragraphs, runs = (tables[k] for k in ("deck", "slide", "shape", "paragraph", "run"))
    key = [*rules.SHAPE, "tbl_ord"]
    meta = tables["table_cell"].groupBy(*key).agg(F.first("first_row").alias("first_row"))
    meta = meta.join(shapes.select(*rules.SHAPE, "alt", "depth", "decorative"), rules.SHAPE)
    notes = slides.select("deck_id", F.col("notes").alias("text"))
    return union(
        [
            rules.run_language(runs, language), rules.titles(slides, shapes), rules.repeated_sections(tables["section"]),
            rules.title_first(shapes), rules.reading_order(shapes, deck), rules.crowded_blocks(paragraphs),
            rules.unexplained_acronyms(paragraphs, notes), rules.tables(meta, tables["table_cell"]), rules.ambiguous_links(links),
            rules.media_counts(shapes, deck), design.overlapping(shapes), design.visual_order(shapes), design.idle(shapes, slides),
            design.near_edges(shapes), design.title_heights(shapes, slides), design.variety(runs), design.furniture(shapes, slides),
            design.text_overflow(shapes, paragraphs),
        ]
    )


#: The rules of grouped_rules, by the table that they need.
GROUPED = {
    "run": ("A03", "N08"), "shape": ("B01", "B02", "B03", "C01", "C02", "I02", "J01", "J02", "N03", "N04", "N05", "N06", "N07", "N11"),
    "paragraph": ("F07", "F10", "N12"), "section": ("B08",), "table_cell": ("G01", "G03", "G04", "G05"), "rel": ("H03",),
}

#: Rules that never fail by the catalogue's logic but count as evaluated with the table.
IMPLIED: dict[str, tuple[str, ...]] = {"shape": ("D10",)}


def evaluated(tables: dict[str, DataFrame]) -> DataFrame:
    """deck_id, rule: what was evaluated on each deck. A rule counts where its table has rows of the deck; N01 and the
    constant rows, which no audit of slides can verify, don't count unless a picture's native size is known."""
    ran = []
    always = {rule for rule, _ in rules.ALWAYS_UNVERIFIED}
    for grain, rows in tables.items():
        own = set(rules_of(grain, rows.columns)) if grain in GRAINS else set()
        own |= {*GROUPED.get(grain, ()), *IMPLIED.get(grain, ())}
        own -= always | {"N01", "I01", "I02", "J01", "J02", "D07", "E09"}
        if own:
            ids = F.explode(F.array(*[F.lit(r) for r in sorted(own)])).alias("rule")
            ran.append(rows.select("deck_id").distinct().select("deck_id", ids))
        if "native_w" in rows.columns:
            sized = rows.filter("tag = 'pic' and native_w is not null and native_h is not null")
            ran.append(sized.select("deck_id", F.lit("N01").alias("rule")).distinct())
    return union(ran).distinct()
