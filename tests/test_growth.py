"""What tasks hold and what is shuffled grows with the rows, not with decks, texts or the number of passes."""

import contextlib
import io
import re

import numpy as np
from pyspark.sql import functions as F

from conforma.functions import text as T
from conforma.operators import design, imports, rules, transform
from conforma.sources import adapters as A
from conforma.sources import session


def plan(df) -> str:
    """The physical plan before it runs."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def boxes(spark, n=400, slides=40):
    rng = np.random.default_rng(n)
    rows = [(f"d{k % 2}", k, o, *(int(v) for v in rng.integers(0, 4, 2))) for k in range(slides) for o in range(n // slides)]
    df = spark.createDataFrame(rows, "deck_id string, slide_no long, shape_ord int, x long, y long")
    columns = {"depth": 0, "decorative": False, "hidden": False, "cx": 10, "cy": 10, "tag": "sp"}
    return rows, df.withColumns({k: F.lit(v) for k, v in columns.items()} | {"media_kind": F.lit(None).cast("string")})


def test_reading_order_groups_by_slides(spark):
    """C02 as a sort of each slide says; no window, whose rows a join has dealt by deck."""
    rows, df = boxes(spark, 120)
    decks = spark.createDataFrame([("d0", 24), ("d1", 12)], "deck_id string, slide_h long")
    found = rules.reading_order(df, decks)
    want = set()
    for k in {r[1] for r in rows}:
        own = [r[2:] for r in rows if r[1] == k]
        band = 2 if k % 2 == 0 else 1
        by_row, by_col = sorted(own, key=lambda r: (r[2] // band, r[1], r[0])), sorted(own, key=lambda r: (r[1], r[2], r[0]))
        if by_row != own and not (by_col == own and len({r[1] for r in own}) >= 2):
            want.add((k, len(own)))
    assert {(r.slide_no, r.value) for r in found.collect()} == want and 0 < len(want) < 40
    assert "Window" not in plan(found)


def test_text_overflow_joins_lengths(spark):
    _, df = boxes(spark)
    texts = df.withColumns({"text": F.expr("repeat('a', int(x) + 90)"), "first_size": F.lit(None).cast("int"), "line_pct": F.lit(None).cast("int")})
    lines = plan(design.text_overflow(df, texts)).split("\n")
    dealt = [below for line, below in zip(lines, lines[1:]) if "Exchange hashpartitioning" in line]
    assert any("length#" in x for x in dealt) and not any(re.search(r"(?<!char_length\()text#", x) for x in dealt)


def test_media_order_sorts_once(spark):
    rows, df = boxes(spark)
    df = df.withColumns({"ph_type": F.when(F.col("x") == 3, "title"), "media_kind": F.when(F.col("y") == 0, "audio")})
    found = transform.media_after_title(df)
    assert plan(found).count("Sort [") == 1
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.slide_no, r.new_ord)):
        got.setdefault(r.slide_no, []).append(r.shape_ord)
    for k, order in got.items():
        own = [r for r in rows if r[1] == k]
        first = next((r[2] for r in own if r[3] == 3), None)
        ahead = [o for _, _, o, x, y in own if first is not None and (x == 3 or (o < first and y != 0))]
        media = [o for _, _, o, x, y in own if o not in ahead and y == 0]
        rest = [o for _, _, o, x, y in own if o not in ahead and o not in media]
        assert order == (ahead + media + rest if first is not None else [r[2] for r in own])


def deck(spark):
    """slides, shapes, paragraphs and cells of a deck: a title, a text, a table and a picture on every slide."""
    _, df = boxes(spark, 40, 10)
    tag = F.element_at(F.array(*[F.lit(x) for x in ("sp", "sp", "graphicFrame", "pic")]), F.col("shape_ord") + 1)
    title = F.when(F.col("shape_ord") == 0, "title")
    shapes = df.withColumns({"tag": tag, "ph_type": title, "has_table": F.col("shape_ord") == 2, "alt": F.lit("a curve"), "name": F.lit("n"), "text": F.lit(" head ")})
    flat = shapes.filter("shape_ord < 2").withColumns({"cell_ri": F.lit(None).cast("int"), "cell_ci": F.lit(None).cast("int"), "bullet": F.lit("buChar")})
    texts = flat.withColumn("para_ord", F.explode(F.array(F.lit(1), F.lit(0)))).withColumn("text", F.format_string(" p%d ", "para_ord"))
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("ri"), F.lit(j).alias("ci")) for i in (1, 0) for j in (1, 0)])).alias("g")
    cells = shapes.filter("has_table").select("deck_id", "slide_no", "shape_ord", grid, F.lit(0).alias("tbl_ord"), F.lit(True).alias("first_row"))
    cells = cells.select("*", "g.*", F.format_string("c%d%d", "g.ri", "g.ci").alias("text")).drop("g")
    slides = shapes.select("deck_id", "slide_no").distinct().withColumn("notes", F.when(F.col("slide_no") == 3, " said \n\nmore"))
    inside = cells.select("*", F.col("ri").alias("cell_ri"), F.col("ci").alias("cell_ci"), F.lit(0).alias("para_ord")).drop("ri", "ci", "first_row", "tbl_ord")
    return slides, shapes, texts, cells, inside.withColumn("depth", F.lit(0))


def test_reading_deals_rows_once(spark):
    """One shuffle for the rows of slides, one for decks' totals and slides; lines as before."""
    slides, shapes, texts, cells, _ = deck(spark)
    lines = transform.reading(slides, shapes, texts, cells)
    assert plan(lines).count("Exchange") <= 7
    got = [(r.ord, r.sub, r.line) for r in lines.filter("slide_no = 3").orderBy("ord", "sub").collect()]
    head = [(-1, 0, "Slide 3 de 5: head"), (1, 0, "marcador, p0"), (1, 1, "marcador, p1")]
    assert got == [*head, (2, 1, "c00: c10, c01: c11"), (3, 0, "imagem, a curve"), (1 << 30, 0, " said "), (1 << 30, 2, "more")]
    told = {r.deck_id: r for r in transform.transcript(lines).collect()}
    assert told["d1"].lines == 5 * 5 + 2 and told["d1"].transcript.split("\n")[5:12] == [x[2] for x in got]


def test_items_are_dealt_to_parts_by_the_tables_size(spark):
    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    parts = A.PARTS_OF_SPLIT * items.rdd.getNumPartitions()
    assert A.shapes(items).rdd.getNumPartitions() == parts


def test_imports_deal_rows_once(spark):
    slides, shapes, texts, cells, inside = deck(spark)
    script, notices = imports.import_decks(slides, shapes, texts.unionByName(inside, allowMissingColumns=True), cells)
    assert max(plan(x).count("Exchange") for x in (script, notices)) <= 4
    row = script.filter("slide_no = 3").first()
    assert (row.title, row.content, row.figure.alt, row.table.header, row.table.rows) == ("p0 p1", ["p0", "p1"], "a curve", ["c00", "c01"], [["c10", "c11"]])
    assert row.notes == "said \n\nmore" and notices.count() == 0


def test_blank_texts_are_told_by_their_first_characters(spark):
    """Trimmed on the left alone, so that a long text isn't read to its end; blanks of all kinds count."""
    texts = [None, "", " \t\r\n", "  　", " a ", "a" + " " * 50, "​"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.blank(F.col("t")).alias("blank"))
    assert [r.blank for r in rows.orderBy("i").collect()] == [True, True, True, True, False, False, False]
    assert "ltrim(" in plan(rows)


def test_imports_gather_what_lists_take(spark):
    """Other rows are left behind below the aggregate, whose input is sorted once more."""
    slides, shapes, texts, cells, inside = deck(spark)
    script, _ = imports.import_decks(slides, shapes, texts.unionByName(inside, allowMissingColumns=True), cells)
    lines = plan(script).split("\n")
    partial = next(i for i, x in enumerate(lines) if "ObjectHashAggregate" in x and "partial_" in x)
    window = next(i for i, x in enumerate(lines) if "Window [" in x)
    assert any("Filter " in x and "title_ord" in x for x in lines[partial:window])


def test_imports_are_dealt_by_size(spark, tmp_path, monkeypatch):
    tables = []
    for i, rows in enumerate(deck(spark)):
        rows.write.parquet(str(tmp_path / str(i)))
        tables.append(spark.read.parquet(str(tmp_path / str(i))))
    slides, shapes, texts, cells, inside = tables
    size = lambda t: sum(f.stat().st_size for f in (tmp_path / str(t)).glob("*.parquet"))
    read = size(0) + size(1) + size(2) + size(3) + size(4)
    paragraphs = texts.unionByName(inside, allowMissingColumns=True)
    for parts in (3, 9):
        monkeypatch.setattr(session, "PART_BYTES", -(-read // parts))
        script, _ = imports.import_decks(slides, shapes, paragraphs, cells)
        assert f", {parts}), REPARTITION_BY_NUM" in plan(script)
        assert script.count() == 10
    assert session.parts_by_size(spark.createDataFrame([(1,)], "i int")) is None


def test_imports_of_odd_rows(spark):
    """Shapes that come twice, as one kind or two; blank texts in titles and bodies; null keys and texts; slides without shapes."""
    key = "deck_id string, slide_no long, shape_ord int, "
    n = None
    shapes = [
        ("d", 1, 0, "sp", "title", n, False, " t ", "title's"), ("d", 1, 1, "pic", n, n, False, "foto.png", "p"), ("d", 1, 1, "pic", n, n, False, "foto.png", "p"),
        ("d", 1, 2, "pic", n, n, False, "a", "x"), ("d", 1, 2, "sp", n, n, False, "b", "y"), ("d", 1, 3, "pic", n, "video", False, "m", "z"),
        ("d", 2, 0, "graphicFrame", n, n, True, n, "t"), ("d", 2, 1, "pic", n, n, False, n, n), (n, 3, 0, "pic", n, n, False, " the curve ", ""),
    ]
    shapes = spark.createDataFrame(shapes, key + "tag string, ph_type string, media_kind string, has_table boolean, alt string, name string")
    shapes = shapes.withColumns({"depth": F.lit(0), "decorative": F.lit(False), "hidden": F.lit(False)})
    texts = [
        ("d", 1, 0, n, n, 2, " c "), ("d", 1, 0, n, n, 0, "a"), ("d", 1, 0, n, n, 1, " "), ("d", 1, 2, n, n, 0, "body"), ("d", 1, 2, n, n, 0, "body"), ("d", 1, 2, n, n, 1, n),
        ("d", 1, 1, n, n, 0, "in a picture"), ("d", 1, 9, n, n, 0, "of no shape"), ("d", 2, 0, 0, 0, 0, ""), ("d", 2, 0, 0, 1, 0, n), ("d", 2, 0, 1, 0, 1, "y"), ("d", 2, 0, 1, 0, 0, " x "),
        (n, 3, 5, n, n, 0, "of no shape"),
    ]
    texts = spark.createDataFrame(texts, key + "cell_ri int, cell_ci int, para_ord int, text string").withColumn("depth", F.lit(0))
    marks = spark.createDataFrame([("d", 2, 0, n), ("d", 2, 0, n)], key + "first_row boolean")
    slides = spark.createDataFrame([("d", 1, " said "), ("d", 2, " "), (n, 3, n), ("e", 4, n)], "deck_id string, slide_no long, notes string")
    script, notices = imports.import_decks(slides, shapes, texts, marks)
    got = {r.slide_no: r for r in script.collect()}
    assert {k: (r.deck_id, r.notes) for k, r in got.items()} == {1: ("d", "said"), 2: ("d", None), 3: (None, None), 4: ("e", None)}
    assert (got[1].title, got[1].content) == ("a  c", ["body", "body"])
    assert got[1].figure.name == "p" and "'foto.png'" in got[1].figure.alt and got[1].table is None
    assert (got[2].table.header, got[2].table.rows) == (["x y"], []) and got[2].figure.name == "Figura" and got[2].figure.alt.startswith("[FALTA")
    assert (got[3].figure.name, got[3].figure.alt, got[3].content) == ("Figura", "the curve", [])
    assert got[4].figure is None and got[4].content == [] and got[4].title.startswith("[FALTA")
    told = {(r.slide_no, r.cause): r.n for r in notices.collect()}
    assert told == {(1, "media"): 1, (1, "generic_alt"): 2, (1, "figures"): 2, (2, "title"): 1, (2, "alt"): 1, (2, "header"): 1, (3, "title"): 1, (4, "title"): 1}
