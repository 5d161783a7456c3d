"""Adapters that shape the plain tables as decks, so that the rules have rows to look at.

documents: a source is a deck, a document a slide, a line a paragraph, the first line its title.
pages: a page is a deck of one slide; links are taken from the markup. lineitem: an order is a slide,
an item a shape whose box is integer arithmetic on its keys. part: a part is a run with two colours.
conversations: two neighbouring conversations are versions of one package, a turn is a slide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import grid as G


PARTS_OF_SPLIT = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(documents: DataFrame) -> DataFrame:
    rows = documents.select(
        F.col("source").alias("deck_id"),
        F.col("doc_id").alias("slide_no"),
        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("para_ord", "text"),
    )
    return rows.select(
        "*",
        F.lit(0).alias("shape_ord"),
        F.lit(0).alias("depth"),
        F.lit(None).cast("int").alias("cell_ri"),
        F.lit(None).cast("string").alias("bullet"),
        (F.col("para_ord") == 0).alias("titled"),
    )


def document_slides(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("source").alias("deck_id"), F.col("doc_id").alias("slide_no"))


def title_shapes(documents: DataFrame) -> DataFrame:
    """The first line of every document as its slide's title."""
    return documents.select(
        F.col("source").alias("deck_id"),
        F.col("doc_id").alias("slide_no"),
        F.lit(0).alias("shape_ord"),
        F.lit(0).alias("depth"),
        F.lit("title").alias("ph_type"),
        F.split(F.coalesce("text", F.lit("")), "\n")[0].alias("text"),
    )


def alt_shapes(documents: DataFrame) -> DataFrame:
    """Lines as descriptions of pictures; every seventh is decorative."""
    rows = paragraphs(documents)
    return rows.select(
        "deck_id",
        "slide_no",
        F.col("para_ord").alias("shape_ord"),
        "depth",
        F.lit("pic").alias("tag"),
        F.lit(False).alias("is_ph"),
        F.lit("").alias("text"),
        F.col("text").alias("alt"),
        (F.pmod("para_ord", F.lit(7)) == 6).alias("decorative"),
        F.lit(None).cast("string").alias("content_uri"),
    )


def shapes(lineitem: DataFrame, *more: str) -> DataFrame:
    """Boxes of all items, in the order of their dates, with more columns of the items. An order's items
    are numbered over all their columns, as keys repeat. Items are dealt by their order to PARTS_OF_SPLIT parts for each
    split of the table, so that what a task sorts doesn't grow with the table."""
    lineitem = lineitem.repartition(PARTS_OF_SPLIT * lineitem.rdd.getNumPartitions(), "l_orderkey")
    order = Window.partitionBy("l_orderkey").orderBy(
        "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    q = F.col("l_quantity").cast("long")
    return lineitem.select(
        F.concat(F.lit("d"), F.pmod("l_orderkey", F.lit(97)).cast("string")).alias("deck_id"),
        F.col("l_orderkey").alias("slide_no"),
        (F.row_number().over(order) - 1).alias("shape_ord"),
        F.lit(0).alias("depth"),
        F.when(F.pmod("l_partkey", F.lit(3)) == 0, "pic").otherwise("sp").alias("tag"),
        F.concat(F.lit("Shape "), F.pmod("l_suppkey", F.lit(5)).cast("string")).alias("name"),
        (F.pmod("l_suppkey", F.lit(6)) == 0).alias("decorative"),
        F.lit(False).alias("hidden"),
        F.lit(None).cast("string").alias("media_kind"),
        F.when(F.col("l_linenumber") == 1, "title").otherwise("body").alias("ph_type"),
        F.lit(True).alias("is_ph"),
        (F.pmod(F.col("l_partkey") * 7919, F.lit(10_000)) * 1000).alias("x"),
        (F.pmod(F.col("l_suppkey") * 6101 + F.col("l_partkey"), F.lit(6000)) * 1000).alias("y"),
        (q * 120_000 + 100_000).alias("cx"),
        (F.pmod(F.col("l_partkey"), F.lit(40)) * 100_000 + 150_000).alias("cy"),
        (F.col("l_linestatus") == "O").alias("has_link"),
        F.pmod(q, F.lit(10)).alias("n_children"),
        F.when(F.col("l_returnflag") == "R", "Totals of the year").otherwise("").alias("alt"),
        *more,
    )


def shape_decks(shapes_: DataFrame) -> DataFrame:
    return shapes_.select("deck_id").distinct().select(
        "deck_id", F.lit(G.WIDTH).alias("slide_w"), F.lit(G.HEIGHT).alias("slide_h")
    )


def shape_slides(shapes_: DataFrame) -> DataFrame:
    """Slides with one of three layout names."""
    layout = F.element_at(F.array(F.lit("Conteudo"), F.lit("Capa"), F.lit("Conteudo libras")), (F.pmod("slide_no", F.lit(3)) + 1).cast("int"))
    return shapes_.select("deck_id", "slide_no").distinct().withColumn("layout_name", layout)


def colour_runs(part: DataFrame) -> DataFrame:
    def colour(mul: int, add: int):
        return F.lpad(F.hex(F.pmod(F.col("p_partkey") * mul + add, F.lit(16_777_216)).cast("long")), 6, "0")

    return part.select(
        F.col("p_brand").alias("deck_id"),
        F.col("p_partkey").alias("slide_no"),
        F.lit(0).alias("shape_ord"),
        F.lit(0).alias("depth"),
        F.lit(False).alias("decorative"),
        F.col("p_name").alias("text"),
        F.when(F.pmod("p_partkey", F.lit(50)) == 0, "000000").otherwise(colour(7_654_321, 0)).alias("fg"),
        F.when(F.pmod("p_partkey", F.lit(25)) == 0, "FFFFFF").when(F.pmod("p_partkey", F.lit(31)) != 0, colour(1_234_567, 99)).alias("bg"),
        F.when(F.pmod("p_partkey", F.lit(31)) == 0, F.when(F.pmod("p_partkey", F.lit(2)) == 0, "gradient fill").otherwise("no theme")).alias("reason"),
        (F.col("p_size").cast("long") * 60).alias("size"),
        (F.pmod("p_partkey", F.lit(3)) == 0).alias("bold"),
    )


def cells(lineitem: DataFrame) -> DataFrame:
    """An order as a table: a row for each item, three columns, some blank."""
    rows = shapes(lineitem).select("deck_id", "slide_no", F.col("shape_ord").alias("ri"), "x", "y", "decorative")
    texts = F.array(
        F.when(F.col("decorative"), "").otherwise(F.col("x").cast("string")),
        F.when(F.pmod("slide_no", F.lit(11)) == 0, " ").otherwise(F.col("y").cast("string")),
        F.when(F.col("decorative"), "").otherwise("x"),
    )
    out = rows.select("deck_id", "slide_no", "ri", F.posexplode(texts).alias("ci", "text"))
    span = F.when((F.pmod("slide_no", F.lit(13)) == 0) & (F.col("ci") == 0), 2).otherwise(1)
    return out.select(
        "*", F.lit(0).alias("shape_ord"), F.lit(0).alias("tbl_ord"), span.alias("grid_span"), F.lit(1).alias("row_span"),
        F.lit(False).alias("h_merge"), F.lit(False).alias("v_merge"),
    )


def cell_tables(cells_: DataFrame) -> DataFrame:
    rows = cells_.select("deck_id", "slide_no", "shape_ord", "tbl_ord").distinct()
    return rows.select(
        "*", (F.pmod("slide_no", F.lit(5)) != 0).alias("first_row"), F.when(F.pmod("slide_no", F.lit(4)) == 0, "").otherwise("t").alias("alt")
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Links of all pages, as one deck for each host; deck order is page and place."""
    found = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">([^<]*)</a>'), 0)
    rows = pages.select(F.lit("site").alias("deck_id"), F.col("page_id").alias("slide_no"), F.explode(found).alias("a"))
    return rows.select(
        "deck_id",
        "slide_no",
        F.regexp_extract("a", r'<a href="([^"]*)">', 1).alias("target"),
        F.regexp_extract("a", r">([^<]*)</a>", 1).alias("text"),
    )


def page_items(pages: DataFrame) -> DataFrame:
    """List items of all pages as paragraphs that begin with a dash; some have a native bullet, too."""
    found = F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">([^<]*)</a>'), 1)
    rows = pages.select(F.lit("site").alias("deck_id"), F.col("page_id").alias("slide_no"), F.posexplode(found).alias("para_ord", "t"))
    return rows.select(
        "deck_id", "slide_no", "para_ord", F.lit(0).alias("shape_ord"), F.lit(0).alias("depth"), F.lit(None).cast("int").alias("cell_ri"),
        F.concat(F.lit("- "), "t").alias("text"), F.when(F.char_length("t") % 3 == 0, "buChar").alias("bullet"),
    )


def page_decks(pages: DataFrame) -> DataFrame:
    lang = F.nullif(F.regexp_extract("html", r'<html[^>]*lang="([^"]*)"', 1), F.lit(""))
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return pages.select(
        F.col("page_id").cast("string").alias("deck_id"),
        title.alias("title"),
        lang.alias("language"),
        F.when(F.col("html").contains('class="ad"'), " User ").otherwise(F.regexp_extract("html", '<a href="[^"]*">([^<]*)</a>', 1)).alias("author"),
        F.when(F.pmod("page_id", F.lit(10)) == 0, title).otherwise(F.concat(F.lit("deck "), F.col("page_id").cast("string"))).alias("stem"),
        (F.char_length(title) * 4).alias("slide_w"),
        (F.char_length("url") % 8 * 9).alias("slide_h"),
    )


def page_tags(pages: DataFrame) -> DataFrame:
    """Opening tags of a page's markup as the tags of an exported file."""
    tags = F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), 1)
    rows = pages.select(F.col("page_id").cast("string").alias("deck_id"), F.posexplode(tags).alias("ord", "type"))
    kind = F.upper("type")
    return rows.select("deck_id", "ord", F.when(kind == "LI", "TH").otherwise(kind).alias("type"), (F.pmod("ord", F.lit(2)) == 0).alias("has_a"))


def page_files(pages: DataFrame) -> DataFrame:
    decks = page_decks(pages)
    n = F.col("deck_id").cast("long")
    return decks.select(
        "deck_id", F.col("language").alias("lang"), F.when(F.pmod(n, F.lit(7)) == 0, "").otherwise(F.col("title")).alias("title"),
        (F.pmod(n, F.lit(9)) != 0).alias("marked"), F.lit(True).alias("has_tree"), (F.pmod(n, F.lit(3)) != 0).alias("display_title"),
    )


def turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").alias("deck_id"), F.col("turn").alias("slide_no"), "role", "text")


def versions(conversations: DataFrame, profiles: bool = False) -> DataFrame:
    """Conversations 2k and 2k + 1 as a package's versions, of one profile or of two."""
    n = conversations.groupBy("conv_id").agg(F.count("*").alias("slides"))
    odd = F.pmod("conv_id", F.lit(2)) == 1
    return n.select(
        F.floor(F.col("conv_id") / 2).alias("package_id"),
        (F.when(odd, "libras").otherwise("completo") if profiles else F.lit("completo")).alias("profile"),
        F.pmod("conv_id", F.lit(2)).alias("file_ord"),
        F.col("conv_id").alias("deck_id"),
        F.when(F.pmod("conv_id", F.lit(3)) == 0, "Libras").otherwise("Aula").alias("title"),
        "slides",
    )


def turn_texts(conversations: DataFrame) -> DataFrame:
    """deck_id, slide_no, texts: a turn's first five words, odd conversations in turns of three without
    the last."""
    n = F.when((F.pmod("conv_id", F.lit(2)) == 1) & (F.pmod("turn", F.lit(3)) == 0), 4).otherwise(5)
    words = F.split("text", " ")
    rows = conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    return rows.select(F.col("conv_id").alias("deck_id"), F.col("turn").alias("slide_no"), F.slice(words, F.lit(1), n).alias("texts"))


def turn_resources(conversations: DataFrame) -> DataFrame:
    kind = F.when(F.char_length("text") % 3 == 0, "audio").when(F.char_length("text") % 3 == 1, "video").otherwise("figure")
    rows = conversations.select(F.col("conv_id").alias("deck_id"), F.col("turn").alias("slide_no"), kind.alias("kind"))
    return rows.groupBy("deck_id", "slide_no", "kind").agg(F.count("*").alias("n"))


def turn_keys(conversations: DataFrame) -> DataFrame:
    """deck_id, slide_no, key_message: the first word of a turn; none in turns of four."""
    rows = conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    word = F.lower(F.split("text", " ")[0])
    return rows.select(
        F.col("conv_id").alias("deck_id"), F.col("turn").alias("slide_no"),
        F.when(F.pmod("turn", F.lit(4)) == 3, "").otherwise(word).alias("key_message"),
    )
