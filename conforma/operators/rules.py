"""The rule catalogue over fact tables, layers A to L.

Every function takes fact tables and returns findings. Scope (groups, decorative and hidden shapes,
cells) is set by `in_scope()`. The expected language is a parameter. Rules of single rows are lists of tests
(`..._tests`), which a function applies to rows of its own, and `catalogue` to all rows of a grain at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colour as C
from ..functions import grid as G
from ..functions import text as T
from .report import finding, row_findings, union
from .resolve import is_title

PK = ["deck_id", "slide_no"]
SHAPE = [*PK, "shape_ord"]


def in_scope(columns: list[str], groups: bool = False, decorative: bool = True, hidden: bool = True, cells: bool = True) -> Column:
    """Whether a row is of a top-level shape, unless groups, and none that the rule doesn't look at."""
    keep = F.lit(True)
    if not groups and "depth" in columns:
        keep &= F.col("depth") == 0
    if not decorative:
        keep &= ~F.col("decorative")
    if not hidden:
        keep &= ~F.col("hidden")
    if not cells and "cell_ri" in columns:
        keep &= F.col("cell_ri").isNull()
    return keep


def scope(rows: DataFrame, **flags: bool) -> DataFrame:
    """Rows in a rule's scope."""
    return rows.filter(in_scope(rows.columns, **flags))


def within(keep: Column, tests: list[tuple]) -> list[tuple]:
    """Tests that look at no other rows than those to keep."""
    return [(rule, severity, keep & condition, *more) for rule, severity, condition, *more in tests]


# A: metadata


def metadata_tests(language: str = "pt") -> list[tuple]:
    """A01, A02, A04, A05, A06."""
    title, lang, author = (T.strip(F.coalesce(c, F.lit(""))) for c in ("title", "language", "author"))
    lang, author = F.lower(lang), F.lower(author)
    same = F.lower(title) == F.lower("stem")
    ratio = F.col("slide_w") / F.col("slide_h")
    ratio = F.when(F.col("slide_h") > 0, ratio)
    return [
        ("A01", "E", (title == "") | same, None, title),
        ("A02", "E", ~lang.startswith(language), None, F.col("language")),
        ("A04", "A", (author == "") | author.isin(*T.GENERIC_AUTHORS), None, F.col("author")),
        ("A05", "A", T.strip(F.col("stem")).rlike(T.GENERIC_FILE_NAME), None, F.col("stem")),
        ("A06", "D", F.abs(ratio - 16 / 9) > 0.02, ratio),
    ]


def metadata(decks: DataFrame, language: str = "pt") -> DataFrame:
    return row_findings(decks, metadata_tests(language))


SLIDES_NAMED = 12


def run_language(runs: DataFrame, language: str = "pt") -> DataFrame:
    """One finding for each foreign or missing run language of a deck: its count, first example and first
    slides. Slides are put in order by parts of a deck, so that no group holds all of a deck's."""
    lang = F.coalesce(F.nullif("lang", F.lit("")), F.lit("absent"))
    rows = runs.filter(~T.blank(F.col("text"))).withColumn("lang", lang)
    rows = rows.filter(~F.lower("lang").startswith(language))
    order = F.struct("slide_no", "shape_ord", "para_ord", "run_ord")
    example = F.struct(order.alias("at"), F.substring("text", 1, 40).alias("text"))
    by_slide = rows.groupBy("deck_id", "lang", "slide_no").agg(F.count("*").alias("n"), F.min(example).alias("first"))

    def earliest(lists: Column) -> Column:
        return F.slice(F.array_sort(lists), 1, SLIDES_NAMED).alias("slides")

    sums = [F.sum("n").alias("n"), F.min("first").alias("first")]
    part = F.pmod(F.xxhash64("slide_no"), F.lit(256))
    parts = by_slide.groupBy("deck_id", "lang", part).agg(*sums, earliest(F.collect_list("slide_no")))
    grouped = parts.groupBy("deck_id", "lang").agg(*sums, earliest(F.flatten(F.collect_list("slides"))))
    named = F.concat(F.lit("slides "), F.array_join(F.transform("slides", lambda s: s.cast("string")), ", "))
    return finding(grouped, "A03", "E", F.col("n"), F.concat_ws(": ", "lang", F.concat_ws("; ", "first.text", named)))


# B: structure


def titles(slides: DataFrame, shapes: DataFrame) -> DataFrame:
    """Slides without a title, with a blank one, and titles on several slides."""
    own = scope(shapes).filter(is_title(F.col("ph_type")))
    first = own.groupBy(*PK).agg(F.min_by(F.struct("shape_ord", "text"), "shape_ord").alias("t"))
    missing = slides.join(first, PK, "left_anti")
    text = T.strip(F.coalesce(F.col("t.text"), F.lit("")))
    first = first.select(*PK, F.col("t.shape_ord").alias("shape_ord"), text.alias("text"))
    again = first.filter("text <> ''").groupBy("deck_id", F.lower("text").alias("title"))
    again = again.agg(F.count("*").alias("n"), F.min("slide_no").alias("slide_no")).filter("n > 1")
    return union(
        [
            finding(missing, "B01", "E"),
            finding(first.filter("text = ''"), "B02", "E"),
            finding(again, "B03", "E", F.col("n"), F.col("title")),
        ]
    )


def loose_text_tests(columns: list[str]) -> list[tuple]:
    """Text in a box that is no placeholder."""
    loose = (F.col("tag") == "sp") & ~F.col("is_ph") & ~T.blank(F.col("text"))
    return within(in_scope(columns), [("B05", "E", loose, None, F.substring("text", 1, 50))])


def loose_text(shapes: DataFrame) -> DataFrame:
    return row_findings(shapes, loose_text_tests(shapes.columns))


def blank_layout_tests() -> list[tuple]:
    """B06."""
    return [("B06", "A", F.lower(F.trim("layout_name")).isin("em branco", "blank"))]


def blank_layout(slides: DataFrame) -> DataFrame:
    return row_findings(slides, blank_layout_tests())


def section_tests() -> list[tuple]:
    """Section names without meaning."""
    name = T.strip(F.coalesce("name", F.lit("")))
    return [("B07", "E", (name == "") | name.rlike(T.DEFAULT_SECTION), None, F.col("name"))]


def sections(table: DataFrame) -> DataFrame:
    """Repeated names."""
    return union([row_findings(table, section_tests()), repeated_sections(table)])


def repeated_sections(table: DataFrame) -> DataFrame:
    """B08."""
    name = T.strip(F.coalesce("name", F.lit("")))
    again = table.groupBy("deck_id", F.lower(name).alias("name")).agg(F.count("*").alias("n"))
    return finding(again.filter("n > 1"), "B08", "D", F.col("n"), F.col("name"))


def typed_bullet_tests(columns: list[str]) -> list[tuple]:
    """Lists typed with dashes or stars where no native bullet is set."""
    typed = T.strip(F.col("text")).rlike(T.TYPED_BULLET)
    native = F.coalesce(F.col("bullet"), F.lit("buNone")) != "buNone"
    return within(in_scope(columns, groups=True, cells=False), [("B09", "A", typed & ~native, None, F.substring("text", 1, 40))])


def typed_bullets(paragraphs: DataFrame) -> DataFrame:
    return row_findings(paragraphs, typed_bullet_tests(paragraphs.columns))


# C: reading order


def title_first(shapes: DataFrame) -> DataFrame:
    """Something comes before the title."""
    rows = scope(shapes, decorative=False, hidden=False)
    titled = is_title(F.col("ph_type"))
    grouped = rows.groupBy(*PK).agg(
        F.min_by(F.struct("shape_ord", "name", titled.alias("titled")), "shape_ord").alias("f"),
        F.bool_or(titled).alias("any"),
    )
    late = grouped.filter(F.col("any") & ~F.col("f.titled"))
    return finding(late.withColumn("shape_ord", F.col("f.shape_ord")), "C01", "E", detail=F.col("f.name"))


def order_ranks(boxes: DataFrame, band: Column | int) -> DataFrame:
    """boxes with rn_tree, rn_row (bands from top, then left) and rn_col (left, then top)."""
    group = Window.partitionBy(*PK)
    row = F.floor(F.col("y") / band)
    return boxes.withColumns(
        {
            "rn_tree": F.row_number().over(group.orderBy("shape_ord")),
            "rn_row": F.row_number().over(group.orderBy(row, "x", "shape_ord")),
            "rn_col": F.row_number().over(group.orderBy("x", "y", "shape_ord")),
        }
    )


def reading_order(shapes: DataFrame, decks: DataFrame) -> DataFrame:
    """The tree's order is neither that of rows nor, with two columns or more, that of columns.

    Decks' heights are joined with slides, so that no window has a whole deck in one task.
    """
    rows = scope(shapes, decorative=False, hidden=False).filter("media_kind is null and x is not null")
    heights = decks.select("deck_id", F.greatest(F.lit(1), F.floor(F.col("slide_h") / 12)).alias("band"))
    slides = rows.groupBy(*PK).agg(F.collect_list(F.struct("shape_ord", "x", "y")).alias("boxes"))
    slides = slides.withColumn("n", F.size("boxes")).filter("n > 1").join(heights, "deck_id")

    def places(*by: Callable[[Column], Column]) -> Column:
        """shape_ord of a slide's boxes in an order."""
        keys = F.transform("boxes", lambda b: F.struct(*[f(b).alias(f"k{i}") for i, f in enumerate(by)], b["shape_ord"].alias("o")))
        return F.transform(F.array_sort(keys), lambda k: k["o"])

    x, y = (lambda b: b["x"]), (lambda b: b["y"])
    found = slides.withColumns(
        {
            "off_row": places() != places(lambda b: F.floor(b["y"] / F.col("band")), x),
            "off_col": places() != places(x, y),
            "lefts": F.size(F.array_distinct("boxes.x")),
        }
    )
    return finding(found.filter("off_row and not (not off_col and lefts >= 2)"), "C02", "E", F.col("n"))


def object_tests(columns: list[str]) -> list[tuple]:
    """Groups without a description, automatic names, shapes off the slide (slide_w, slide_h)."""
    shown = ~F.col("decorative")
    out = F.expr("x + cx <= 0 or y + cy <= 0 or x >= slide_w or y >= slide_h")
    return within(
        in_scope(columns),
        [
            ("C04", "A", shown & (F.col("n_children") > 5) & T.blank(F.col("alt")), F.col("n_children")),
            ("C05", "A", F.trim("name").rlike(T.AUTOMATIC_NAME), None, F.col("name")),
            ("C06", "A", out & shown & ~is_title(F.col("ph_type"))),
        ],
    )


def objects(shapes: DataFrame, decks: DataFrame) -> DataFrame:
    sized = shapes.join(decks.select("deck_id", "slide_w", "slide_h"), "deck_id")
    return row_findings(sized, object_tests(shapes.columns))


# D: alternative text


def alt_facts(shapes: DataFrame) -> DataFrame:
    """shapes with what the tests of a description look at, each worked out once."""
    plain = (F.col("tag") == "sp") & ~F.col("is_ph") & T.blank(F.col("text"))
    candidate = in_scope(shapes.columns) & (F.col("tag").isin("pic", "graphicFrame", "grpSp", "cxnSp") | plain)
    rows = shapes.withColumn("__alt", F.coalesce("alt", F.lit("")))
    said = candidate & ~F.col("decorative") & ~T.blank(F.col("__alt"))
    return rows.withColumns({"__described": candidate, "__said": F.when(said, F.col("__alt"))})


def alt_tests() -> list[tuple]:
    """D01 to D06, D08, D11, and D07 (unverified), on rows of alt_facts.

    Candidates are pictures, frames, groups, connectors, and shapes without text that are no
    placeholder. A decorative shape with text, a missing and a blank text end the examination; the
    other rules add up. D10 can never fail, as a missing text ends it before. D07 holds only on slides
    without notes (silent).
    """
    alt, said, decorative = F.col("__alt"), F.col("__said"), F.col("decorative")
    dense = F.coalesce(F.col("content_uri").rlike("/(chart|diagram)$"), F.lit(False))
    tests = [
        ("D11", "E", decorative & ~T.blank(alt)),
        ("D01", "E", ~decorative & (alt == "")),
        ("D02", "E", ~decorative & (alt != "") & T.blank(alt)),
        ("D03", "E", T.looks_like_file(said) | T.generic_alt(said)),
        ("D04", "A", said.rlike(T.ALT_PREFIX)),
        ("D05", "E", said.rlike(T.AUTOMATIC_ALT)),
        ("D06", "A", F.char_length(said) > 150),
        ("D08", "A", T.lacks_accent(said)),
    ]
    tests = [(*x, F.char_length(alt), alt) for x in tests]
    return within(F.col("__described"), [*tests, ("D07", "E", dense & said.isNotNull(), None, None, "unverified")])


def silent_only(findings: DataFrame, slides: DataFrame) -> DataFrame:
    """findings without D07 on slides that have notes."""
    spoken = slides.filter(~T.blank(F.col("notes"))).select(*PK, F.lit("D07").alias("rule"))
    return findings.join(spoken, [*PK, "rule"], "left_anti").select(*findings.columns)


def alt_text(shapes: DataFrame, slides: DataFrame) -> DataFrame:
    return silent_only(row_findings(alt_facts(shapes), alt_tests()), slides)


# E: contrast


def contrast_facts(runs: DataFrame) -> DataFrame:
    """runs with luminances, ratio and size class, column by column, so that no expression is worked out twice."""
    for side in ("fg", "bg"):
        runs = runs.withColumn(f"__{side}", C.parse_hex(F.col(side)))
        runs = runs.withColumn(f"__l{side}", C.luminance(F.col(f"__{side}")))
    large = C.large_text(F.col("size"), F.col("bold"))
    runs = runs.withColumns({"__ratio": C.ratio(F.col("__lfg"), F.col("__lbg")), "__large": large})
    ratio, large = F.col("__ratio"), F.col("__large")
    low = ratio + 0.005 < F.when(large, 3.0).otherwise(4.5)
    rule = F.when(low & ~large, "E01").when(low, "E02").when(~large & (ratio < 7.0), "E03")
    return runs.withColumn("__level", rule)


def contrast_tests(columns: list[str]) -> list[tuple]:
    """E01, E02, E03, E08, and E09 or E01 unverified, on rows of contrast_facts.

    runs: size, bold, fg and bg (hex, null if unresolved) and reason.
    """
    ratio, level, text = F.col("__ratio"), F.col("__level"), F.col("text")
    glare = (F.upper("fg") == "000000") & (F.upper("bg") == "FFFFFF")
    graded = F.coalesce(F.col("reason").rlike("gradient|picture|pattern"), F.lit(False))
    return within(
        in_scope(columns, groups=True, decorative=False) & ~T.blank(text),
        [
            *[(r, s, level == r, ratio, text) for r, s in (("E01", "E"), ("E02", "E"), ("E03", "D"))],
            ("E08", "A", glare, ratio, text),
            ("E09", "A", ratio.isNull() & graded, None, F.col("reason"), "unverified"),
            ("E01", "A", ratio.isNull() & ~graded, None, F.col("reason"), "unverified"),
        ],
    )


def contrast(runs: DataFrame) -> DataFrame:
    return row_findings(contrast_facts(runs), contrast_tests(runs.columns))


# F: typography

LINE_MOST = 80
PARAGRAPHS_MOST = 6


def long_line_tests(columns: list[str]) -> list[tuple]:
    """lines of over 80 characters."""
    length = F.char_length(T.strip(F.col("text")))
    return within(in_scope(columns, groups=True, cells=False), [("F07", "A", length > LINE_MOST, length)])


def crowded_blocks(paragraphs: DataFrame) -> DataFrame:
    """more than six paragraphs in a block that is no title."""
    rows = scope(paragraphs, groups=True, cells=False).filter(~T.blank(F.col("text")) & ~F.col("titled"))
    n = rows.groupBy(*SHAPE).agg(F.count("*").alias("n"))
    return finding(n.filter(F.col("n") > PARAGRAPHS_MOST), "F07", "A", F.col("n"))


def crowded(paragraphs: DataFrame) -> DataFrame:
    """F07, blocks and lines."""
    return union([crowded_blocks(paragraphs), row_findings(paragraphs, long_line_tests(paragraphs.columns))])


def text_lines(paragraphs: DataFrame) -> DataFrame:
    """F06 (typed capitals) and F07, lines in one pass and blocks in another."""
    rows = scope(paragraphs, groups=True).withColumn("t", T.strip(F.col("text"))).filter("t <> ''")
    outside = F.col("cell_ri").isNull() if "cell_ri" in rows.columns else F.lit(True)
    length = F.char_length("t")
    n = rows.filter(~F.col("titled") & outside).groupBy(*SHAPE).agg(F.count("*").alias("n"))
    return union(
        [
            finding(n.filter(F.col("n") > PARAGRAPHS_MOST), "F07", "A", F.col("n")),
            row_findings(
                rows,
                [
                    ("F07", "A", outside & (length > LINE_MOST), length),
                    ("F06", "A", T.all_caps(F.col("t")), None, F.substring("text", 1, 40)),
                ],
            ),
        ]
    )


def shouted_tests(columns: list[str]) -> list[tuple]:
    """F06 for sentences in capitals, typed or (where caps is known) inherited."""
    tests = [("F06", "A", T.all_caps(F.col("text")), None, F.substring("text", 1, 40))]
    if "caps" in columns:
        tests.append(("F06", "A", F.col("caps").isin("all", "small"), None, F.col("caps")))
    return within(in_scope(columns, groups=True) & ~T.blank(F.col("text")), tests)


def shouted(paragraphs: DataFrame) -> DataFrame:
    return row_findings(paragraphs, shouted_tests(paragraphs.columns))


def paragraph_tests(columns: list[str]) -> list[tuple]:
    """F04 justified text; F05 tight lines (body below 1.5, titles below 0.9; large body exempt)."""
    body = ~F.col("titled") & F.col("cell_ri").isNull() & (F.coalesce("max_size", F.lit(0)) < 4000)
    tight = (body & (F.col("line_pct") < 150000)) | (F.col("titled") & (F.col("line_pct") < 90000))
    return within(
        in_scope(columns, groups=True) & ~T.blank(F.col("text")),
        [("F04", "E", F.col("algn") == "just"), ("F05", "A", tight, F.col("line_pct") / 100000)],
    )


def paragraph_setting(paragraphs: DataFrame) -> DataFrame:
    return row_findings(paragraphs, paragraph_tests(paragraphs.columns))


def run_tests(columns: list[str]) -> list[tuple]:
    """F01 typefaces, F02 and F03 sizes, F06 italics and underlines outside links."""
    face = F.lower(T.strip(F.col("typeface")))
    unsafe = (face != "") & ~F.col("typeface").startswith("+") & ~face.isin(*T.SANS_SAFE)
    size, titled = F.col("size"), F.col("titled")
    underlined = (F.coalesce("u", F.lit("none")) != "none") & ~F.col("has_link")
    shown = F.substring("text", 1, 30)
    return within(
        in_scope(columns, groups=True) & ~T.blank(F.col("text")),
        [
            ("F01", "A", unsafe, None, F.col("typeface")),
            ("F02", "E", size.isNull(), None, None, "unverified"),
            ("F02", "E", ~titled & (size < 1800), size / 100),
            ("F03", "A", titled & (size < 3200), size / 100),
            ("F06", "A", F.coalesce("i", F.lit(False)), None, shown),
            ("F06", "A", underlined, None, shown),
        ],
    )


def run_setting(runs: DataFrame) -> DataFrame:
    return row_findings(runs, run_tests(runs.columns))


def unexplained_acronyms(paragraphs: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """an acronym's first place in a deck, if the deck never spells it out.

    Exempt at that place: known ones, emphasised words, rule ids, those after a lower-case letter and
    a hyphen, and file names. paragraphs: deck_id, slide_no, shape_ord, para_ord, text; notes: deck_id,
    text.
    """
    rows = scope(paragraphs, groups=True)
    places = rows.select("deck_id", "slide_no", "shape_ord", "para_ord", "text", F.posexplode(T.acronyms(F.col("text"))).alias("k", "acronym"))
    spot = F.struct("slide_no", "shape_ord", "para_ord", "k", "text")
    first = places.groupBy("deck_id", "acronym").agg(F.min(spot).alias("s")).select("deck_id", "acronym", "s.*")
    texts = rows.select("deck_id", "text")
    if notes is not None:
        texts = texts.unionByName(notes.select("deck_id", "text"))
    spelled = texts.select(
        "deck_id",
        F.explode(
            F.concat(
                F.regexp_extract_all("text", F.lit(r"\(([A-ZÀ-Ý][A-ZÀ-Ý0-9]{2,7})\)"), 1),
                F.regexp_extract_all("text", F.lit(r"(?<![\pL\pN_])([A-ZÀ-Ý][A-ZÀ-Ý0-9]{2,7})\s*\([^)]{4,}\)"), 1),
                F.regexp_extract_all("text", F.lit(r"(?<![\pL\pN_])([A-ZÀ-Ý][A-ZÀ-Ý0-9]{2,7})\s*[:—-]\s*[\pL\pN_]{4,}"), 1),
            )
        ).alias("acronym"),
    ).distinct()
    known = F.col("acronym").isin(*T.KNOWN_ACRONYMS, *T.EMPHASIS_WORDS) | F.col("acronym").rlike("^[A-ZÀ-Ý][0-9]{2}$")
    glued = F.expr(r"text rlike concat('[a-z]-', acronym)") | F.expr(r"text rlike concat(acronym, '[.][a-z]{2,4}([^a-zA-Z0-9_]|$)')")
    found = first.filter(~known & ~glued).join(spelled, ["deck_id", "acronym"], "left_anti")
    return finding(found, "F10", "A", detail=F.col("acronym"))


# G, H: tables and links


def tables(meta: DataFrame, cells: DataFrame) -> DataFrame:
    """No header row, merged cells, blank rows or columns, no description."""
    key = [*SHAPE, "tbl_ord"]
    merged = F.coalesce("h_merge", F.lit(False)) | F.coalesce("v_merge", F.lit(False))
    merged |= (F.coalesce("grid_span", F.lit(1)) > 1) | (F.coalesce("row_span", F.lit(1)) > 1)
    spans = cells.groupBy(*key).agg(F.count_if(merged).alias("n")).filter("n > 0")
    empty = F.bool_and(T.blank(F.col("text")))
    rows = cells.groupBy(*key, "ri").agg(empty.alias("e")).filter("e").select(*key)
    columns = cells.groupBy(*key, "ci").agg(empty.alias("e")).filter("e").select(*key)
    gaps = rows.unionByName(columns).groupBy(*key).agg(F.count("*").alias("n"))
    return union(
        [
            finding(meta.filter(~F.coalesce("first_row", F.lit(False))), "G01", "E"),
            finding(spans, "G03", "E", F.col("n")),
            finding(gaps, "G04", "A", F.col("n")),
            finding(meta.filter(T.blank(F.col("alt"))), "G05", "A"),
        ]
    )


def link_targets(links: DataFrame, rels: DataFrame) -> DataFrame:
    """links with target: by relationship, else the link's own id, else ''."""
    known = rels.select("deck_id", "slide_no", F.col("rid").alias("link_rid"), "target")
    joined = links.join(known, ["deck_id", "slide_no", "link_rid"], "left")
    return joined.withColumn("target", F.coalesce("target", "link_rid", F.lit("")))


def link_tests() -> list[tuple]:
    """Raw addresses, vague texts."""
    text = T.strip(F.col("text"))
    return [("H01", "A", text.rlike(T.RAW_URL), None, F.col("text")), ("H02", "A", T.vague_link(text), None, F.col("text"))]


def ambiguous_links(rows: DataFrame) -> DataFrame:
    """One text for several targets."""
    text = T.strip(F.col("text"))
    many = rows.filter(text != "").groupBy("deck_id", F.lower(text).alias("text"))
    many = many.agg(F.count_distinct("target").alias("n")).filter("n > 1")
    return finding(many, "H03", "A", F.col("n"), F.col("text"))


def links(rows: DataFrame) -> DataFrame:
    """H01, H02, H03."""
    return union([row_findings(rows, link_tests()), ambiguous_links(rows)])


# I to M: media and what no static look can verify

# Rules that a person or another program has to verify.
ALWAYS_UNVERIFIED = (
    ("J04", "D"), ("K02", "A"), ("K03", "E"), ("K04", "A"), ("L01", "E"), ("L07", "E"),
    ("M01", "—"), ("M02", "—"), ("M03", "—"), ("M04", "—"), ("M05", "—"), ("M06", "—"),
)
SIGN_WINDOW = "janela de libras"


def transition_tests() -> list[tuple]:
    """Transitions that move."""
    moves = F.array_except(F.col("transition_children"), F.array(*[F.lit(x) for x in ("fade", "cut", "sndAc", "extLst")]))
    return [("I06", "A", F.size(moves) > 0, None, F.concat_ws(",", moves))]


def _sign_window() -> Column:
    return (F.col("media_kind") == "video") & (F.lower(F.trim("name")) == SIGN_WINDOW)


def media_tests(columns: list[str]) -> list[tuple]:
    """I07 small targets; I01 videos other than sign windows (unverified)."""
    small = F.col("has_link") & ((F.col("cx") < G.TARGET_LEAST) | (F.col("cy") < G.TARGET_LEAST))
    video = (F.col("media_kind") == "video") & ~F.coalesce(_sign_window(), F.lit(False))
    tests = [("I07", "A", small, F.least("cx", "cy")), ("I01", "E", video, None, None, "unverified")]
    return within(in_scope(columns, groups=True), tests)


def constant_tests() -> list[tuple]:
    """Rules that are unverified for every deck."""
    return [(r, s, F.lit(True), None, None, "unverified") for r, s in ALWAYS_UNVERIFIED]


def media_counts(shapes: DataFrame, decks: DataFrame) -> DataFrame:
    """Unverified I02, J01, J02, by a deck's tracks and sign windows."""
    rows = scope(shapes, groups=True)
    n = rows.groupBy("deck_id").agg(F.count_if(_sign_window()).alias("windows"), F.count_if(F.col("media_kind") == "audio").alias("tracks"))
    counted = decks.select("deck_id").join(n, "deck_id", "left").fillna(0, ["windows", "tracks"])
    tracks, windows = F.col("tracks"), F.col("windows")
    return row_findings(
        counted,
        [
            ("I02", "E", tracks > 0, tracks, None, "unverified"),
            ("J01", "E", windows > 0, windows, None, "unverified"),
            ("J01", "E", windows == 0, None, None, "unverified"),
            ("J02", "A", windows == 0, None, None, "unverified"),
        ],
    )


def media(slides: DataFrame, shapes: DataFrame, decks: DataFrame) -> DataFrame:
    """I06, I07, and unverified I01, I02, J01, J02 and the constant rows."""
    return union(
        [
            row_findings(slides, transition_tests()),
            row_findings(shapes, media_tests(shapes.columns)),
            media_counts(shapes, decks),
            row_findings(decks, constant_tests()),
        ]
    )


# L: facts of exported PDF files

HEADING_TAGS = ("H", "H1", "H2", "H3", "H4", "H5", "H6")


def pdf(files: DataFrame, tags: DataFrame, language: str = "pt") -> DataFrame:
    """L01 to L05, and L06 unverified; files without tags get L01 alone."""
    tagged = F.coalesce("marked", F.lit(False)) & F.coalesce("has_tree", F.lit(False))
    good = files.filter(tagged)
    lang = F.lower(T.strip(F.coalesce("lang", F.lit(""))))
    headings = tags.filter(F.col("type").isin(*HEADING_TAGS)).select("deck_id").distinct()
    th = tags.filter(F.col("type") == "TH").groupBy("deck_id")
    th = th.agg(F.count_if(~F.col("has_a")).alias("n")).filter("n > 0").join(good.select("deck_id"), "deck_id")
    return union(
        [
            row_findings(
                files,
                [
                    ("L01", "E", ~tagged),
                    ("L02", "E", tagged & ~lang.startswith(language), None, F.col("lang")),
                    ("L03", "E", tagged & T.blank(F.col("title"))),
                    ("L03", "E", tagged & ~F.coalesce("display_title", F.lit(False))),
                    ("L06", "A", F.lit(True), None, None, "unverified"),
                ],
            ),
            finding(good.join(headings, "deck_id", "left_anti"), "L04", "E"),
            finding(th, "L05", "E", F.col("n")),
        ]
    )


def validator_failures(failures: DataFrame, most: int = 15) -> DataFrame:
    """The first `most` failures of each file, and one row for the number of the others."""
    order = Window.partitionBy("deck_id").orderBy("ord")
    ranked = failures.withColumn("rn", F.row_number().over(order))
    rest = ranked.filter(F.col("rn") > most).groupBy("deck_id").agg(F.count("*").alias("n"))
    return union(
        [
            finding(ranked.filter(F.col("rn") <= most), "L07", "E", detail=F.col("message")),
            finding(rest, "L07", "E", F.col("n")),
        ]
    )


def tag_histogram(tags: DataFrame, most: int = 12) -> DataFrame:
    """deck_id, type, n, place of the most frequent tags."""
    n = tags.groupBy("deck_id", "type").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("deck_id").orderBy(F.desc("n"), "type"))
    return n.withColumn("place", place).filter(F.col("place") <= most)
