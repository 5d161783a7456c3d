"""Decks back to scripts: what a deck's slides say as script slides, with markers for what is still to be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.session import parts_by_size
from .resolve import is_title
from .rules import scope
from .transform import MISSING, PK

# Descriptions that say nothing, and the names of versions in a document's title.
EMPTY_DESCRIPTION = r"(?i)^(imagem|figura|picture|image|foto)\s*\d*$|\.(png|jpe?g|gif|webp)$"
VERSION_NAMES = {"libras": "Libras como primeira língua", "leitura_facil": "leitura fácil"}
PLAIN_THEME = "Modo padrão"

KEY = [*PK, "shape_ord"]


def missing(what: str, *values: Column) -> Column:
    return F.format_string(MISSING % what, *values)


def quoted(text: Column) -> Column:
    """In single quotes; in double ones if it has single ones only."""
    mark = F.when(text.contains("'") & ~text.contains('"'), F.lit('"')).otherwise(F.lit("'"))
    return F.concat(mark, text, mark)


def kinds(shapes: DataFrame) -> DataFrame:
    """shapes that are seen, outside groups, with what they become: title, media, figure, table or text."""
    kind = F.when(is_title(F.col("ph_type")), "title").when(F.col("media_kind").isNotNull(), "media").when(F.col("tag") == "pic", "figure")
    kind = kind.when((F.col("tag") == "graphicFrame") & F.col("has_table"), "table").otherwise("text")
    return scope(shapes, decorative=False, hidden=False).withColumn("becomes", kind)


def filled_rows(cells: Column) -> Column:
    """The rows (arrays of texts) of a table that have a text. cells: cell_ri, cell_ci, para_ord, t; the paragraphs
    of a cell are joined with blanks."""
    cells = F.array_sort(cells)

    def row(number: Column) -> Column:
        own = F.filter(cells, lambda c: c["cell_ri"] == number)
        places = F.array_distinct(F.transform(own, lambda c: c["cell_ci"]))
        return F.transform(places, lambda i: T.strip(F.array_join(F.transform(F.filter(own, lambda c: c["cell_ci"].eqNullSafe(i)), lambda c: c["t"]), " ")))

    rows = F.transform(F.array_distinct(F.transform(cells, lambda c: c["cell_ri"])), row)
    return F.filter(rows, lambda r: F.exists(r, lambda t: t != ""))


def import_decks(slides: DataFrame, shapes: DataFrame, paragraphs: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(script, notices) of decks' slides.

    script: deck_id, slide_no, title, content, figure (name, file, alt, long_description), table (name, alt,
    header, rows), notes. Decorative and hidden shapes and what lies in groups are left out; of several titles the last one
    counts, of several figures and tables the first one. notices: deck_id, slide_no, cause (media, title, alt,
    generic_alt, figures, header) and n, how often.

    Slides without shapes are kept; null texts are empty.
    """
    # text: a shape's description, a paragraph, or a slide's notes
    names = {"becomes": "string", "name": "string", "text": "string", "para_ord": "int", "cell_ri": "int", "cell_ci": "int", "first_row": "boolean"}

    def part(rows: DataFrame, kind: str, **columns: Column) -> DataFrame:
        own = [columns.get(c, F.lit(None)).cast(k).alias(c) for c, k in names.items()]
        ord_ = F.col("shape_ord") if "shape_ord" in rows.columns else F.lit(None).cast("int")
        return rows.select(*PK, ord_.alias("shape_ord"), F.lit(kind).alias("kind"), *own)

    figure = F.col("becomes") == "figure"  # the least of the names, so what comes twice and isn't one each time is none below
    own = {"name": F.when(figure, F.col("name")), "text": F.when(figure, T.strip(F.coalesce("alt", F.lit(""))))}
    rows = part(kinds(shapes), "shape", becomes=F.col("becomes"), **own)
    own = {c: F.col(c) for c in ("para_ord", "cell_ri", "cell_ci")}
    rows = rows.unionByName(part(scope(paragraphs), "text", text=T.strip(F.coalesce("text", F.lit(""))), **own))
    rows = rows.unionByName(part(cells, "mark", first_row=F.col("first_row")))
    rows = rows.unionByName(part(slides, "slide", text=F.nullif(T.strip(F.coalesce("notes", F.lit(""))), F.lit(""))))

    # all rows of a slide are dealt together once and sorted once, in parts that don't grow with the tables
    kind, becomes, text = (F.col(c) for c in ("kind", "becomes", "text"))
    of_shape, of_slide = Window.partitionBy(*KEY), Window.partitionBy(*PK)
    parts = parts_by_size(rows)
    rows = rows.repartition(*([parts] if parts else []), *PK).withColumns({"becomes": F.max("becomes").over(of_shape), "first_row": F.bool_or("first_row").over(of_shape)})
    rows = rows.withColumns(
        {
            "title_ord": F.max(F.when(becomes == "title", F.col("shape_ord"))).over(of_slide),
            "table_ord": F.min(F.when(becomes == "table", F.col("shape_ord"))).over(of_slide),
        }
    )
    number = F.col("slide_no").cast("string")
    shape = kind == "shape"
    figure = shape & (becomes == "figure")
    generic = figure & text.rlike(EMPTY_DESCRIPTION)
    told = F.when(text == "", missing("texto alternativo da figura do slide %s", number))
    told = told.when(generic, missing("texto alternativo real, o atual é %s", quoted(F.substring(text, 1, 30)))).otherwise(text)
    picture = F.struct(
        F.coalesce(F.nullif("name", F.lit("")), F.lit("Figura")).alias("name"),
        F.lit(MISSING % "caminho do arquivo da figura, por modo de cor").alias("file"),
        told.alias("alt"),
        missing("descrição longa da figura do slide %s", number).alias("long_description"),
    )
    plain, celled = ((kind == "text") & c for c in (F.col("cell_ri").isNull(), F.col("cell_ri").isNotNull()))
    # what a slide's list doesn't take is left behind before its rows are gathered
    head = plain & (F.col("shape_ord") == F.col("title_ord"))
    body = plain & (becomes == "text") & (text != "")
    cell = celled & (F.col("shape_ord") == F.col("table_ord"))
    counted = shape & becomes.isin("media", "figure", "table")
    rows = rows.filter((kind == "slide") | counted | head | body | cell).groupBy(*PK).agg(
        F.bool_or(kind == "slide").alias("listed"),
        F.max(F.when(kind == "slide", text)).alias("notes"),
        F.min_by(F.when(figure, picture), F.when(figure, F.col("shape_ord"))).alias("figure"),
        F.count_if(shape & (becomes == "media")).alias("media"),
        F.count_if(figure).alias("figures"),
        F.count_if(figure & (text == "")).alias("alt"),
        F.count_if(generic).alias("generic_alt"),
        F.count_if(shape & (becomes == "table") & ~F.coalesce("first_row", F.lit(False))).alias("header"),
        F.collect_list(F.when(head, F.struct("para_ord", text.alias("t")))).alias("title"),
        F.collect_list(F.when(body, F.struct("shape_ord", "para_ord", text.alias("t")))).alias("body"),
        F.collect_list(F.when(cell, F.struct("cell_ri", "cell_ci", "para_ord", text.alias("t")))).alias("cells"),
        F.max("table_ord").alias("table_ord"),
    )
    rows = rows.filter("listed").withColumns(
        {
            "title": T.strip(F.array_join(F.transform(F.array_sort("title"), lambda p: p["t"]), " ")),
            "content": F.transform(F.array_sort("body"), lambda p: p["t"]),
            "rs": filled_rows(F.col("cells")),
        }
    )
    table = F.struct(
        F.lit(MISSING % "nome da tabela").alias("name"),
        missing("o que a tabela mostra, no slide %s", number).alias("alt"),
        F.coalesce(F.get("rs", F.lit(0)), F.array().cast("array<string>")).alias("header"),
        F.slice("rs", 2, F.greatest(F.size("rs") - 1, F.lit(0))).alias("rows"),
    )
    rows = rows.withColumn("table", F.when(F.col("table_ord").isNotNull(), table))
    untitled = F.coalesce("title", F.lit("")) == ""
    title = F.when(untitled, missing("título do slide %s", number)).otherwise(F.col("title"))
    content = F.coalesce("content", F.array().cast("array<string>"))
    script = rows.select(*PK, title.alias("title"), content.alias("content"), "figure", "table", "notes")
    counts = {"media": F.col("media"), "title": untitled.cast("long"), "alt": F.col("alt"), "generic_alt": F.col("generic_alt")}
    counts |= {"figures": F.when(F.col("figures") > 1, F.col("figures")), "header": F.col("header")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("cause"), n.cast("long").alias("n")) for k, n in counts.items()])).alias("e")
    return script, rows.select(*PK, each).select(*PK, "e.*").filter("n > 0")


def import_headers(decks: DataFrame) -> DataFrame:
    """deck_id, title, author, language of the script of a deck."""

    def given(column: str, otherwise: str) -> Column:
        return F.coalesce(F.nullif(T.strip(F.col(column)), F.lit("")), F.lit(otherwise)).alias(column)

    return decks.select("deck_id", given("title", MISSING % "título da apresentação"), given("author", MISSING % "autor"), given("language", "pt-BR"))


def document_title(title: Column, profile: Column, theme: Column) -> Column:
    """The title that a reader is told on opening: with the version, unless it is the complete one, and the theme,
    unless it is the plain one or null."""
    names = F.create_map(*[F.lit(x) for kv in VERSION_NAMES.items() for x in kv])
    version = F.when(profile != "completo", F.concat(F.lit("versão "), F.coalesce(names[profile], profile)))
    return F.concat_ws(" — ", title, version, F.when(theme != PLAIN_THEME, F.lower(theme)))
