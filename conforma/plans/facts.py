"""More registered queries: rules on runs, media, geometry and packages, resolvers, readings, transforms.

Like those in `queries`, each applies an operator to whole tables shaped by adapters, with its SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grid as G
from ..functions import text as T
from ..operators import design, imports, package, report, resolve, rules, transform
from ..sources import adapters as A
from .queries import PARA, SHAPES, _found, _in, _shapes, _t, query


def _items(spark, sf, *more: str):
    return A.shapes(_t(spark, sf, "lineitem"), *more)


def _chosen(column, *values: str):
    """values[column mod their number]."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(column, F.lit(len(values))) + 1).cast("int"))


# A, B


@query(
    f"""
WITH {PARA}, r AS (SELECT p.deck_id, p.slide_no, p.para_ord, p.text, coalesce(nullif(d.lang, ''), 'absent') AS lang FROM para p JOIN documents d ON d.doc_id = p.slide_no AND d.source = p.deck_id WHERE t <> ''),
g AS (SELECT * FROM r WHERE NOT starts_with(lower(lang), 'en')),
f AS (SELECT *, count(*) OVER (PARTITION BY deck_id, lang) AS n, row_number() OVER (PARTITION BY deck_id, lang ORDER BY slide_no, para_ord) AS rn FROM g),
s AS (SELECT deck_id, lang, string_agg(slide_no, ', ' ORDER BY slide_no) AS slides FROM (SELECT *, row_number() OVER (PARTITION BY deck_id, lang ORDER BY slide_no) AS k FROM (SELECT DISTINCT deck_id, lang, slide_no FROM g)) WHERE k <= 12 GROUP BY ALL)
SELECT deck_id, 'A03' AS rule, 'E' AS severity, CAST(n AS DOUBLE) AS value, lang || ': ' || left(text, 40) || '; slides ' || slides AS detail FROM f JOIN s USING (deck_id, lang) WHERE rn = 1"""
)
def a_run_language(spark, sf):
    docs = _t(spark, sf, "documents")
    langs = docs.select(F.col("source").alias("deck_id"), F.col("doc_id").alias("slide_no"), "lang")
    runs = A.paragraphs(docs).withColumn("run_ord", F.lit(0)).join(langs, ["deck_id", "slide_no"])
    return _found(rules.run_language(runs, "en"), "deck_id", "rule", "severity", "value", "detail")


@query(
    f"""
WITH {PARA}, ttl AS (SELECT deck_id, slide_no FROM para WHERE para_ord = 0 AND length(t) <= 60)
SELECT source AS deck_id, 'B01' AS rule, doc_id AS slide_no FROM documents d WHERE NOT EXISTS (SELECT 1 FROM ttl WHERE ttl.deck_id = d.source AND ttl.slide_no = d.doc_id)"""
)
def b_untitled(spark, sf):
    """First lines of up to 60 characters are titles; other documents have none."""
    docs = _t(spark, sf, "documents")
    shapes = A.title_shapes(docs).filter(F.char_length(T.strip(F.col("text"))) <= 60)
    found = rules.titles(A.document_slides(docs), shapes).filter("rule = 'B01'")
    return _found(found, "deck_id", "rule", "slide_no")


@query(
    f"""
WITH {PARA} SELECT deck_id, 'B05' AS rule, slide_no, CAST(para_ord AS INTEGER) AS shape_ord, left(text, 50) AS detail FROM para WHERE t <> '' AND length(text) < 40"""
)
def b_loose_text(spark, sf):
    """Lines as boxes; those of 40 characters or more are placeholders."""
    rows = A.paragraphs(_t(spark, sf, "documents")).withColumn("shape_ord", F.col("para_ord"))
    rows = rows.withColumns({"tag": F.lit("sp"), "is_ph": F.char_length("text") >= 40})
    return _found(rules.loose_text(rows), "deck_id", "rule", "slide_no", "shape_ord", "detail")


@query(
    """
SELECT 'c' || (o_custkey % 100) AS deck_id, 'B06' AS rule, o_orderkey AS slide_no FROM orders WHERE o_orderstatus IN ('F', 'P')"""
)
def b_blank_layout(spark, sf):
    layout = F.when(F.col("o_orderstatus") == "F", "Em branco").when(F.col("o_orderstatus") == "P", " BLANK ").otherwise("Conteudo")
    slides = _t(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.pmod("o_custkey", F.lit(100)).cast("string")).alias("deck_id"), F.col("o_orderkey").alias("slide_no"), layout.alias("layout_name")
    )
    return _found(rules.blank_layout(slides), "deck_id", "rule", "slide_no")


@query(
    """
WITH s AS (SELECT 'n' || s_nationkey AS deck_id, CASE WHEN s_acctbal < 2000 THEN ' ' WHEN s_acctbal > 6000 THEN 'Section ' || (s_suppkey % 3) ELSE 'Group ' || (s_suppkey % 4) END AS name FROM supplier)
SELECT deck_id, 'B07' AS rule, CAST(NULL AS DOUBLE) AS value, name AS detail FROM s WHERE name = ' ' OR starts_with(name, 'Section')
UNION ALL SELECT deck_id, 'B08', CAST(count(*) AS DOUBLE), lower(trim(name)) FROM s GROUP BY deck_id, lower(trim(name)) HAVING count(*) > 1"""
)
def b_sections(spark, sf):
    k = F.col("s_suppkey")
    name = F.when(F.col("s_acctbal") < 2000, " ").when(F.col("s_acctbal") > 6000, F.concat(F.lit("Section "), (k % 3).cast("string")))
    table = _t(spark, sf, "supplier").select(
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("deck_id"), name.otherwise(F.concat(F.lit("Group "), (k % 4).cast("string"))).alias("name")
    )
    return _found(rules.sections(table), "deck_id", "rule", "value", "detail")


# D


@query(
    f"""
WITH {SHAPES}, c AS (SELECT *, CASE WHEN l_partkey % 3 = 1 THEN 'graphicFrame' ELSE tag END AS tag2, l_tax > 0.04 AS chart FROM shp),
k AS (SELECT * FROM c WHERE tag2 IN ('pic', 'graphicFrame')), mute AS (SELECT o_orderkey AS slide_no FROM orders WHERE o_orderpriority = '5-LOW')
SELECT deck_id, 'D11' AS rule, 'fail' AS verdict, slide_no, CAST(shape_ord AS INTEGER) AS shape_ord FROM k WHERE decorative AND alt <> ''
UNION ALL SELECT deck_id, 'D01', 'fail', slide_no, CAST(shape_ord AS INTEGER) FROM k WHERE NOT decorative AND alt = ''
UNION ALL SELECT deck_id, 'D07', 'unverified', slide_no, CAST(shape_ord AS INTEGER) FROM k WHERE NOT decorative AND alt <> '' AND tag2 = 'graphicFrame' AND chart AND slide_no IN (SELECT slide_no FROM mute)"""
)
def d_dense_objects(spark, sf):
    """Some items are charts; the notes of orders of low priority say nothing about them."""
    rows = _items(spark, sf, "l_partkey", "l_tax")
    frame = F.pmod("l_partkey", F.lit(3)) == 1
    uri = F.when(frame, F.when(F.col("l_tax") > 0.04, "http://s/2006/chart").otherwise("http://s/2006/table"))
    rows = rows.withColumns({"tag": F.when(frame, "graphicFrame").otherwise(F.col("tag")), "content_uri": uri, "text": F.lit("")})
    notes = F.when(F.col("o_orderpriority") == "5-LOW", " \n ").otherwise("said")
    deck = F.concat(F.lit("d"), F.pmod("o_orderkey", F.lit(97)).cast("string"))
    slides = _t(spark, sf, "orders").select(deck.alias("deck_id"), F.col("o_orderkey").alias("slide_no"), notes.alias("notes"))
    return _found(rules.alt_text(rows, slides), "deck_id", "rule", "verdict", "slide_no", "shape_ord")


# F

_RUNS = f"""
rn AS (SELECT p_brand AS deck_id, p_partkey AS slide_no, p_name AS text, ['Arial', 'Times New Roman', '+mj-lt', 'Comic Sans MS', '', ' Calibri '][(p_size % 6) + 1] AS typeface,
  CASE WHEN p_size % 11 <> 0 THEN p_size * 100 END AS size, p_type = 'ECONOMY' AS titled, ends_with(p_brand, '1') AS i, ['sng', 'none', NULL][(p_size % 3) + 1] AS u, p_partkey % 2 = 0 AS has_link FROM part WHERE trim(p_name) <> '')
SELECT deck_id, 'F01' AS rule, 'fail' AS verdict, slide_no, CAST(NULL AS DOUBLE) AS value, typeface AS detail FROM rn WHERE trim(typeface) <> '' AND NOT starts_with(typeface, '+') AND lower(trim(typeface)) NOT IN {_in(T.SANS_SAFE)}
UNION ALL SELECT deck_id, 'F02', 'unverified', slide_no, NULL, NULL FROM rn WHERE size IS NULL
UNION ALL SELECT deck_id, 'F02', 'fail', slide_no, size / 100.0, NULL FROM rn WHERE NOT titled AND size < 1800
UNION ALL SELECT deck_id, 'F03', 'fail', slide_no, size / 100.0, NULL FROM rn WHERE titled AND size < 3200
UNION ALL SELECT deck_id, 'F06', 'fail', slide_no, NULL, left(text, 30) FROM rn WHERE i
UNION ALL SELECT deck_id, 'F06', 'fail', slide_no, NULL, left(text, 30) FROM rn WHERE coalesce(u, 'none') <> 'none' AND NOT has_link"""


@query(f"WITH {_RUNS}")
def f_runs(spark, sf):
    """Parts as runs: typeface and size by p_size, titles by p_type, italics by brand."""
    size = F.col("p_size")
    runs = _t(spark, sf, "part").select(
        F.col("p_brand").alias("deck_id"), F.col("p_partkey").alias("slide_no"), F.lit(0).alias("depth"), F.col("p_name").alias("text"),
        _chosen(size, "Arial", "Times New Roman", "+mj-lt", "Comic Sans MS", "", " Calibri ").alias("typeface"),
        F.when(size % 11 != 0, size * 100).alias("size"), (F.col("p_type") == "ECONOMY").alias("titled"), F.col("p_brand").endswith("1").alias("i"),
        F.when(size % 3 == 0, "sng").when(size % 3 == 1, "none").alias("u"), (F.pmod("p_partkey", F.lit(2)) == 0).alias("has_link"),
    )
    return _found(rules.run_setting(runs), "deck_id", "rule", "verdict", "slide_no", "value", "detail")


@query(
    """
WITH p AS (SELECT 'd' || (l_orderkey % 97) AS deck_id, l_orderkey AS slide_no, l_linenumber AS shape_ord, CASE WHEN l_returnflag = 'R' THEN 'just' ELSE 'l' END AS algn, CAST(l_quantity AS BIGINT) * 5000 AS line_pct,
  l_linenumber = 1 AS titled, l_linestatus = 'O' AS free, l_tax > 0.06 AS large FROM lineitem)
SELECT deck_id, 'F04' AS rule, slide_no, shape_ord, CAST(NULL AS DOUBLE) AS value FROM p WHERE algn = 'just'
UNION ALL SELECT deck_id, 'F05', slide_no, shape_ord, line_pct / 100000.0 FROM p WHERE (NOT titled AND free AND NOT large AND line_pct < 150000) OR (titled AND line_pct < 90000)"""
)
def f_paragraphs(spark, sf):
    rows = _t(spark, sf, "lineitem").select(
        F.concat(F.lit("d"), F.pmod("l_orderkey", F.lit(97)).cast("string")).alias("deck_id"), F.col("l_orderkey").alias("slide_no"), F.col("l_linenumber").alias("shape_ord"),
        F.lit(0).alias("depth"), F.col("l_returnflag").alias("text"), F.when(F.col("l_returnflag") == "R", "just").otherwise("l").alias("algn"),
        (F.col("l_quantity").cast("long") * 5000).alias("line_pct"), (F.col("l_linenumber") == 1).alias("titled"),
        F.when(F.col("l_linestatus") != "O", 0).alias("cell_ri"), F.when(F.col("l_tax") > 0.06, 4400).alias("max_size"),
    )
    return _found(rules.paragraph_setting(rows), "deck_id", "rule", "slide_no", "shape_ord", "value")


@query(
    """
WITH p AS (SELECT p_brand AS deck_id, p_partkey AS slide_no, CASE WHEN p_size > 40 THEN upper(p_name) ELSE p_name END || ' ' || p_type AS text, ['all', 'none', 'small', NULL][(p_size % 4) + 1] AS caps FROM part),
w AS (SELECT *, regexp_extract_all(text, '[A-Za-zÀ-ÿ]{2,}') AS ws FROM p)
SELECT deck_id, 'F06' AS rule, slide_no, left(text, 40) AS detail FROM w WHERE len(ws) >= 3 AND len(list_filter(ws, lambda x: x = upper(x) AND x <> lower(x))) = len(ws)
UNION ALL SELECT deck_id, 'F06', slide_no, caps FROM w WHERE caps IN ('all', 'small')"""
)
def f_inherited_capitals(spark, sf):
    size = F.col("p_size")
    rows = _t(spark, sf, "part").select(
        F.col("p_brand").alias("deck_id"), F.col("p_partkey").alias("slide_no"), F.lit(0).alias("depth"),
        F.concat_ws(" ", F.when(size > 40, F.upper("p_name")).otherwise(F.col("p_name")), "p_type").alias("text"),
        F.when(size % 4 == 0, "all").when(size % 4 == 1, "none").when(size % 4 == 2, "small").alias("caps"),
    )
    return _found(rules.shouted(rows), "deck_id", "rule", "slide_no", "detail")


# H, I, L


@query(
    """
WITH a AS (SELECT page_id AS slide_no, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>')) AS a FROM pages),
l AS (SELECT slide_no, regexp_extract(a, '<a href="([^"]*)">', 1) AS rid FROM a)
SELECT 'site' AS deck_id, slide_no, rid, CASE WHEN length(rid) % 2 = 0 THEN 'https://example.org' || rid ELSE rid END AS target, count(*) AS n FROM l GROUP BY ALL"""
)
def h_link_targets(spark, sf):
    """A link's address is its relationship's id; relationships of even length lead elsewhere."""
    found = A.page_links(_t(spark, sf, "pages")).withColumnRenamed("target", "link_rid")
    rels = found.filter(F.char_length("link_rid") % 2 == 0).select("deck_id", "slide_no", F.col("link_rid").alias("rid")).distinct()
    rels = rels.withColumn("target", F.concat(F.lit("https://example.org"), "rid"))
    rows = rules.link_targets(found, rels)
    return rows.groupBy("deck_id", "slide_no", F.col("link_rid").alias("rid"), "target").agg(F.count("*").alias("n"))


_MEDIA = f"""
{SHAPES}, md AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 'audio' WHEN 'R' THEN 'video' END AS media, l_linenumber = 7 AS sign FROM shp),
ct AS (SELECT deck_id, count(*) FILTER (media = 'video' AND sign) AS w, count(*) FILTER (media = 'audio') AS a FROM md GROUP BY 1)
SELECT DISTINCT 'd' || (o_orderkey % 97) AS deck_id, 'I06' AS rule, 'A' AS severity, 'fail' AS verdict, o_orderkey AS slide_no, -1 AS shape_ord, CAST(NULL AS DOUBLE) AS value, 'push' AS detail FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT deck_id, 'I07', 'A', 'fail', slide_no, CAST(shape_ord AS INTEGER), CAST(least(cx, cy) AS DOUBLE), NULL FROM md WHERE has_link AND (cx < {G.TARGET_LEAST} OR cy < {G.TARGET_LEAST})
UNION ALL SELECT deck_id, 'I01', 'E', 'unverified', slide_no, CAST(shape_ord AS INTEGER), NULL, NULL FROM md WHERE media = 'video' AND NOT sign
UNION ALL SELECT deck_id, 'I02', 'E', 'unverified', -1, -1, CAST(a AS DOUBLE), NULL FROM ct WHERE a > 0
UNION ALL SELECT deck_id, 'J01', 'E', 'unverified', -1, -1, CAST(w AS DOUBLE), NULL FROM ct WHERE w > 0
UNION ALL SELECT deck_id, 'J01', 'E', 'unverified', -1, -1, NULL, NULL FROM ct WHERE w = 0
UNION ALL SELECT deck_id, 'J02', 'A', 'unverified', -1, -1, NULL, NULL FROM ct WHERE w = 0
UNION ALL SELECT deck_id, rule, severity, 'unverified', -1, -1, NULL, NULL FROM ct CROSS JOIN (VALUES {", ".join(str(x) for x in rules.ALWAYS_UNVERIFIED)}) AS always(rule, severity)"""


@query(f"WITH {_MEDIA}")
def i_media(spark, sf):
    """Items as audio and video; the seventh line's video is the sign window. Urgent orders are pushed in."""
    s = _items(spark, sf, "l_returnflag", "l_linenumber")
    kind = F.when(F.col("l_returnflag") == "A", "audio").when(F.col("l_returnflag") == "R", "video")
    s = s.withColumns({"media_kind": kind, "name": F.when(F.col("l_linenumber") == 7, " Janela de LIBRAS ").otherwise(F.col("name"))})
    moves = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("push"))).otherwise(F.array(F.lit("fade")))
    deck = F.concat(F.lit("d"), F.pmod("o_orderkey", F.lit(97)).cast("string"))
    slides = _t(spark, sf, "orders").select(deck.alias("deck_id"), F.col("o_orderkey").alias("slide_no"), moves.alias("transition_children"))
    return _found(rules.media(slides, s, A.shape_decks(s)), "deck_id", "rule", "severity", "verdict", "slide_no", "shape_ord", "value", "detail")


@query(
    """
WITH f AS (SELECT 'f' || (page_id % 5) AS deck_id, url, row_number() OVER (PARTITION BY page_id % 5 ORDER BY page_id) AS rn FROM pages)
SELECT deck_id, 'L07' AS rule, CAST(NULL AS DOUBLE) AS value, url AS detail FROM f WHERE rn <= 15
UNION ALL SELECT deck_id, 'L07', CAST(count(*) AS DOUBLE), NULL FROM f WHERE rn > 15 GROUP BY deck_id"""
)
def l_validator(spark, sf):
    rows = _t(spark, sf, "pages").select(
        F.concat(F.lit("f"), F.pmod("page_id", F.lit(5)).cast("string")).alias("deck_id"), F.col("page_id").alias("ord"), F.col("url").alias("message")
    )
    return _found(rules.validator_failures(rows), "deck_id", "rule", "value", "detail")


# N


@query(
    f"""
WITH {SHAPES}, p AS (SELECT *, CASE WHEN l_suppkey % 4 <> 0 THEN cx END AS nw, cy + l_linenumber * 2000 AS nh FROM shp WHERE tag = 'pic'),
o AS (SELECT *, abs(CAST(cx AS DOUBLE) / CAST(cy AS DOUBLE) - CAST(nw AS DOUBLE) / CAST(nh AS DOUBLE)) / (CAST(nw AS DOUBLE) / CAST(nh AS DOUBLE)) AS off FROM p)
SELECT deck_id, 'N01' AS rule, 'fail' AS verdict, slide_no, CAST(shape_ord AS INTEGER) AS shape_ord, round(off, 6) AS value FROM o WHERE off > 1e-2
UNION ALL SELECT deck_id, 'N01', 'unverified', slide_no, CAST(shape_ord AS INTEGER), NULL FROM o WHERE nw IS NULL"""
)
def n_distorted(spark, sf):
    rows = _items(spark, sf, "l_suppkey", "l_linenumber")
    native = {"native_w": F.when(F.pmod("l_suppkey", F.lit(4)) != 0, F.col("cx")), "native_h": F.col("cy") + F.col("l_linenumber") * 2000}
    return _found(design.distorted(rows.withColumns(native)), "deck_id", "rule", "verdict", "slide_no", "shape_ord", "value")


@query(
    f"""
WITH {SHAPES}, n AS (SELECT deck_id, slide_no, count(DISTINCT nullif(q % 9, 0)) AS sizes, count(DISTINCT l_partkey % 8) AS colours FROM useful GROUP BY ALL)
SELECT deck_id, 'N08' AS rule, slide_no, CAST(sizes AS DOUBLE) AS value, 'sizes' AS detail FROM n WHERE sizes > 4
UNION ALL SELECT deck_id, 'N08', slide_no, CAST(colours AS DOUBLE), 'colours' FROM n WHERE colours > 4"""
)
def n_variety(spark, sf):
    rows = _items(spark, sf, "l_quantity", "l_partkey", "l_returnflag")
    runs = rows.withColumns({"sz": F.col("l_quantity").cast("long") % 9, "literal_colour": F.pmod("l_partkey", F.lit(8)).cast("string"), "text": F.col("l_returnflag")})
    return _found(design.variety(runs), "deck_id", "rule", "slide_no", "value", "detail")


@query(
    f"""
WITH {SHAPES} SELECT deck_id, 'N09' AS rule, slide_no, CAST(shape_ord AS INTEGER) AS shape_ord, CASE l_returnflag WHEN 'A' THEN 'all' ELSE 'small' END AS detail FROM shp WHERE l_returnflag IN ('A', 'N') AND l_linestatus = 'F'"""
)
def n_inherited_caps(spark, sf):
    """Capitals come through the chain run, paragraph, layout, master, text style."""
    rows = _items(spark, sf, "l_returnflag", "l_linestatus")
    none = F.lit(None).cast("string")
    flag = F.col("l_returnflag")
    chain = {"run_cap": none, "para_cap": F.when(flag == "R", "none"), "layout_cap": F.when(flag == "A", "all").when(flag == "N", "other")}
    chain |= {"master_cap": F.when(flag == "N", "small"), "text_cap": F.lit("all"), "text": F.when(F.col("l_linestatus") == "O", " ").otherwise("x")}
    return _found(design.inherited_caps(resolve.caps(rows.withColumns(chain))), "deck_id", "rule", "slide_no", "shape_ord", "detail")


@query(
    f"""
WITH {SHAPES}, b AS (SELECT *, 8 * q * 5 AS len, CASE WHEN l_partkey % 4 = 0 THEN 18e0 ELSE (l_partkey % 4) * 10e0 END AS pt, CASE WHEN l_suppkey % 3 = 0 THEN 1e0 ELSE 1.5e0 END AS sp FROM useful WHERE tag = 'sp'),
c AS (SELECT *, greatest(8, CAST(trunc(cx / 360000e0 / (pt * (3528e-5 * 5e-1))) AS BIGINT)) AS per FROM b),
n AS (SELECT *, greatest(1, ceil(len / CAST(per AS DOUBLE))) * pt * 3528e-5 * sp * 12e-1 AS need FROM c)
SELECT deck_id, 'N12' AS rule, slide_no, CAST(shape_ord AS INTEGER) AS shape_ord, round(need, 6) AS value FROM n WHERE need > cy / 360000e0 * 125e-2"""
)
def n_text_overflow(spark, sf):
    rows = _items(spark, sf, "l_quantity", "l_partkey", "l_suppkey")
    size, pct = F.pmod("l_partkey", F.lit(4)) * 1000, F.when(F.pmod("l_suppkey", F.lit(3)) != 0, 150000)
    texts = rows.withColumns({"text": F.expr("repeat('palavra.', int(l_quantity) * 5)"), "first_size": size, "line_pct": pct})
    return _found(design.text_overflow(rows, texts), "deck_id", "rule", "slide_no", "shape_ord", "value")


# O


@query(
    """
WITH l AS (SELECT CAST(s_nationkey AS VARCHAR) AS package_id, CASE WHEN s_acctbal > 7000 THEN 'LEIA-ME.md' ELSE s_name END AS name FROM supplier)
SELECT CAST(n_nationkey AS VARCHAR) AS package_id, 'O03' AS rule, 'A' AS severity FROM nation WHERE CAST(n_nationkey AS VARCHAR) NOT IN (SELECT package_id FROM l WHERE name = 'LEIA-ME.md')"""
)
def o_declaration(spark, sf):
    name = F.when(F.col("s_acctbal") > 7000, "LEIA-ME.md").otherwise(F.col("s_name"))
    listing = _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("package_id"), name.alias("name"))
    found = package.declared(_t(spark, sf, "nation").select(F.col("n_nationkey").alias("package_id")), listing)
    return found.select("package_id", "rule", "severity")


_NOTES = """
nt AS (SELECT conv_id AS deck_id, turn AS slide_no, role, text, CASE WHEN turn % 2 = 0 THEN coalesce(text, '') || chr(10) || '  [chave]  ' || role || chr(10) || 'end' ELSE coalesce(text, '') END AS notes FROM conversations)"""


@query(
    f"""
WITH {_NOTES}, l AS (SELECT *, list_filter(list_transform(string_split(notes, chr(10)), lambda x: trim(x)), lambda x: starts_with(x, '[chave]')) AS ks,
  list_filter(string_split(notes, chr(10)), lambda x: NOT starts_with(trim(x), '[chave]')) AS rest FROM nt)
SELECT deck_id, slide_no, CASE WHEN len(ks) > 0 THEN trim(substr(ks[1], 8)) ELSE '' END AS key_message, length(trim(array_to_string(rest, chr(10)))) AS said,
  CASE role WHEN 'user' THEN 'libras' WHEN 'assistant' THEN 'leitura_facil' ELSE 'completo' END AS profile FROM l"""
)
def o_notes(spark, sf):
    """Key messages, what else the notes say, and profiles of file names."""
    c = _t(spark, sf, "conversations")
    text = F.coalesce("text", F.lit(""))
    notes = F.when(F.col("turn") % 2 == 0, F.concat(text, F.lit("\n  [chave]  "), "role", F.lit("\nend"))).otherwise(text)
    name = F.when(F.col("role") == "user", "Aula-LIBRAS.pptx").when(F.col("role") == "assistant", "Aula-Leitura-Facil.pptx").otherwise("Aula.pptx")
    return c.select(
        F.col("conv_id").alias("deck_id"), F.col("turn").alias("slide_no"), package.key_message(notes).alias("key_message"),
        F.char_length(package.notes_without_key(notes)).cast("long").alias("said"), package.profile_of(name).alias("profile"),
    )


@query(
    f"""
WITH {SHAPES}, e AS (SELECT deck_id, slide_no, shape_ord AS o, -1 AS p, '[alt] ' || alt AS t FROM shp WHERE NOT decorative AND alt <> ''
  UNION ALL SELECT deck_id, slide_no, shape_ord, 0, name FROM shp WHERE NOT decorative
  UNION ALL SELECT DISTINCT 'd' || (o_orderkey % 97), o_orderkey, 1073741824, 0, '[notas] ' || o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'),
g AS (SELECT deck_id, slide_no, string_agg(t, '|' ORDER BY o, p) AS texts FROM e GROUP BY ALL)
SELECT 'd' || (o_orderkey % 97) AS deck_id, o_orderkey AS slide_no, coalesce(texts, '') AS texts FROM orders LEFT JOIN g ON g.slide_no = o_orderkey"""
)
def o_slide_texts(spark, sf):
    """What is read or heard on an order's slide: its items' names and descriptions, its priority as notes."""
    s = _shapes(spark, sf)
    paragraphs = s.withColumns({"text": F.col("name"), "para_ord": F.lit(0)})
    notes = F.when(F.col("o_orderpriority") == "5-LOW", "[chave] x").otherwise(F.col("o_orderpriority"))
    deck = F.concat(F.lit("d"), F.pmod("o_orderkey", F.lit(97)).cast("string"))
    slides = _t(spark, sf, "orders").select(deck.alias("deck_id"), F.col("o_orderkey").alias("slide_no"), notes.alias("notes"))
    found = package.slide_texts(s, paragraphs, slides)
    return found.select("deck_id", "slide_no", F.array_join("texts", "|").alias("texts"))


@query(
    f"""
WITH {SHAPES}, k AS (SELECT deck_id, slide_no, CASE WHEN l_returnflag = 'A' THEN ['audio', 'ole'][(l_linenumber % 2) + 1] WHEN tag = 'pic' THEN 'figure' WHEN l_suppkey % 2 = 0 THEN 'table' END AS k FROM shp)
SELECT deck_id, slide_no, CASE k WHEN 'ole' THEN 'media' ELSE k END AS kind, count(*) AS n FROM k WHERE k IS NOT NULL GROUP BY ALL"""
)
def o_resources(spark, sf):
    s = _items(spark, sf, "l_returnflag", "l_linenumber", "l_suppkey")
    kind = F.when(F.col("l_returnflag") == "A", F.when(F.col("l_linenumber") % 2 == 0, "audio").otherwise("ole"))
    tag = F.when(F.col("tag") == "sp", "graphicFrame").otherwise(F.col("tag"))
    return package.resources(s.withColumns({"media_kind": kind, "tag": tag, "has_table": F.pmod("l_suppkey", F.lit(2)) == 0}))


# Reports


@query(
    """
SELECT CAST(page_id AS VARCHAR) AS deck_id, unnest(['A01', 'A02', 'A04', 'A05', 'A06']) AS rule FROM pages"""
)
def report_evaluated(spark, sf):
    return report.evaluated(A.page_decks(_t(spark, sf, "pages")), ["A06", "A01", "A02", "A04", "A05", "A01"])


@query(
    f"""
WITH {SHAPES} SELECT slide_no, CAST(shape_ord AS INTEGER) AS shape_ord, 'slide ' || slide_no || ' · ' || CASE WHEN l_linenumber = 2 THEN tag ELSE name END || CASE WHEN alt = '' THEN '' ELSE ' · ' || alt END AS label FROM shp"""
)
def report_labels(spark, sf):
    s = _items(spark, sf, "l_linenumber")
    name = F.when(F.col("l_linenumber") == 2, "").otherwise(F.col("name"))
    return s.select("slide_no", "shape_ord", report.label(F.col("slide_no").cast("string"), name, F.col("tag"), F.col("alt")).alias("label"))


@query(
    """
WITH d AS (SELECT CAST(page_id AS VARCHAR) AS deck_id, page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, coalesce(regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1), '') AS lang FROM pages),
f AS (SELECT deck_id, 'A01' AS rule, trim(title) AS detail FROM d WHERE trim(title) = '' OR (page_id % 10 = 0 AND trim(title) = title) UNION ALL SELECT deck_id, 'A02', lang FROM d WHERE NOT starts_with(lower(trim(lang)), 'en'))
SELECT deck_id, '| rule | severity | verdict | slide | detail |' || chr(10) || '| - | - | - | - | - |' || chr(10) ||
  string_agg('| ' || rule || ' | E | fail |  | ' || replace(detail, '|', '\\|') || ' |', chr(10) ORDER BY rule) AS markdown FROM f GROUP BY deck_id"""
)
def report_markdown(spark, sf):
    found = rules.metadata(A.page_decks(_t(spark, sf, "pages")), "en")
    return report.as_markdown(found.filter("severity = 'E'"))


# Resolvers

_LEVELS = """
lv AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, CAST(l_quantity AS BIGINT) AS q, l_linestatus = 'O' AS ph FROM lineitem)"""


@query(
    f"""
WITH {_LEVELS}, c AS (SELECT *, nullif(q % 3, 0) AS s1, CASE WHEN l_returnflag = 'A' THEN q % 2 END AS s2, CASE WHEN l_linenumber = 1 THEN 44 END AS s3,
  CASE WHEN l_partkey % 3 = 0 THEN 28 END AS s4, CASE WHEN l_partkey % 3 = 1 THEN 24 END AS s5, CASE WHEN l_suppkey % 2 = 0 THEN 20 END AS s6, CASE WHEN l_suppkey % 5 <> 0 THEN 18 END AS s7 FROM lv)
SELECT l_orderkey, coalesce(s1, nullif(s2, 0), s3, CASE WHEN ph THEN coalesce(s4, s5, s6) END, s7, -1) AS size,
  CASE WHEN s1 IS NOT NULL THEN 'run' WHEN nullif(s2, 0) IS NOT NULL THEN 'paragraph' WHEN s3 IS NOT NULL THEN 'shape' WHEN ph AND s4 IS NOT NULL THEN 'layout' WHEN ph AND s5 IS NOT NULL THEN 'master'
    WHEN ph AND s6 IS NOT NULL THEN 'text style' WHEN s7 IS NOT NULL THEN 'default' ELSE 'unresolved' END AS origin, count(*) AS n FROM c GROUP BY ALL"""
)
def resolve_sizes(spark, sf):
    c = F.col
    q, flag = c("l_quantity").cast("long"), c("l_returnflag")
    rows = _t(spark, sf, "lineitem").select(
        "l_orderkey", (c("l_linestatus") == "O").alias("is_ph"), (q % 3).alias("sz"), F.when(flag == "A", q % 2).alias("para_sz"), F.when(c("l_linenumber") == 1, 44).alias("shape_sz"),
        F.when(F.pmod("l_partkey", F.lit(3)) == 0, 28).alias("layout_sz"), F.when(F.pmod("l_partkey", F.lit(3)) == 1, 24).alias("master_sz"),
        F.when(F.pmod("l_suppkey", F.lit(2)) == 0, 20).alias("text_sz"), F.when(F.pmod("l_suppkey", F.lit(5)) != 0, 18).alias("default_sz"),
    )
    found = resolve.font_size(rows)
    return found.groupBy("l_orderkey", F.coalesce("size", F.lit(-1)).alias("size"), c("size_origin").alias("origin")).agg(F.count("*").alias("n"))


@query(
    f"""
WITH {SHAPES}, b AS (SELECT deck_id, slide_no, shape_ord, l_linestatus = 'O' AS ph, CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 2 WHEN l_linestatus = 'O' THEN 3 ELSE 4 END AS k, x, y, cx, cy FROM shp)
SELECT deck_id, slide_no, CAST(shape_ord AS INTEGER) AS shape_ord, ['slide', 'layout', 'master', 'unresolved'][k] AS box_origin, CASE k WHEN 1 THEN x WHEN 2 THEN 10 WHEN 3 THEN 20 ELSE -1 END AS x, CASE k WHEN 1 THEN cy WHEN 2 THEN 13 WHEN 3 THEN 23 ELSE -1 END AS cy FROM b"""
)
def resolve_boxes(spark, sf):
    rows = _items(spark, sf, "l_returnflag", "l_linestatus")
    flag = F.col("l_returnflag")

    def fixed(*v: int):
        return F.struct(*[F.lit(k).cast("long").alias(n) for n, k in zip(("x", "y", "cx", "cy"), v, strict=True)])

    rows = rows.withColumns({
        "own": F.when(flag == "A", F.struct("x", "y", "cx", "cy")), "is_ph": F.col("l_linestatus") == "O", "layout_box": F.when(flag == "R", fixed(10, 11, 12, 13)), "master_box": fixed(20, 21, 22, 23),
    })
    found = resolve.box(rows.drop("x", "y", "cx", "cy"))
    return found.select("deck_id", "slide_no", "shape_ord", "box_origin", *[F.coalesce(F.col(c), F.lit(-1)).alias(c) for c in ("x", "cy")])


_PH = """
sh AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, CASE l_returnflag WHEN 'A' THEN 'title' WHEN 'N' THEN 'body' ELSE 'pic' END AS ty, CAST(l_partkey % 6 AS VARCHAR) AS ix FROM lineitem),
ph AS (SELECT n_nationkey AS o, CASE n_regionkey WHEN 0 THEN 'ctrTitle' WHEN 1 THEN 'body' WHEN 2 THEN 'pic' ELSE 'ftr' END AS ty, CAST(n_nationkey % 9 AS VARCHAR) AS ix, n_name AS style FROM nation)"""


@query(
    f"""
WITH {_PH}, m AS (SELECT sh.*, ph.o, ph.style, CASE WHEN sh.ix = ph.ix OR (sh.ty = 'title' AND ph.ty = 'ctrTitle') THEN 0 ELSE 1 END AS far FROM sh JOIN ph ON sh.ix = ph.ix OR (sh.ty = 'title' AND ph.ty = 'ctrTitle') OR sh.ty = ph.ty),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_returnflag, ix ORDER BY far, o) AS rn FROM m)
SELECT style, CASE ty WHEN 'title' THEN 'title' WHEN 'body' THEN 'body' ELSE 'other' END AS bucket, count(*) AS n FROM r WHERE rn = 1 GROUP BY ALL"""
)
def resolve_placeholders(spark, sf):
    """Items find the nation that stands for their layout's placeholder."""
    flag, region = F.col("l_returnflag"), F.col("n_regionkey")
    kind = F.when(flag == "A", "title").when(flag == "N", "body").otherwise("pic")
    rows = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", kind.alias("ph_type"), F.pmod("l_partkey", F.lit(6)).cast("string").alias("ph_idx")).distinct()
    key = F.concat_ws("/", "l_linenumber", "l_returnflag", "ph_idx")
    rows = rows.select(F.lit("d").alias("deck_id"), F.lit("layout").alias("part"), F.col("l_orderkey").alias("slide_no"), key.alias("shape_ord"), "ph_type", "ph_idx")
    of = F.when(region == 0, "ctrTitle").when(region == 1, "body").when(region == 2, "pic").otherwise("ftr")
    places = _t(spark, sf, "nation").select(
        F.lit("d").alias("deck_id"), F.lit("layout").alias("part"), of.alias("ph_type"), F.pmod("n_nationkey", F.lit(9)).cast("string").alias("ph_idx"),
        F.col("n_nationkey").alias("ph_ord"), F.col("n_name").alias("style"),
    )
    found = resolve.match_placeholder(rows, places).join(rows.select("slide_no", "shape_ord", "ph_type"), ["slide_no", "shape_ord"])
    return found.groupBy("style", resolve.style_bucket(F.col("ph_type")).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    """
WITH c AS (SELECT l_orderkey AS slide_no, ['tx1', 'bg1', 'accent1', 'phClr'][(l_partkey % 4) + 1] AS alias FROM lineitem),
k AS (SELECT *, CASE alias WHEN 'tx1' THEN CASE WHEN slide_no % 10 = 0 THEN 'lt1' WHEN slide_no % 3 = 0 THEN 'dk2' ELSE 'dk1' END WHEN 'bg1' THEN 'lt1' WHEN 'accent1' THEN 'accent1' END AS slot FROM c)
SELECT alias, coalesce(slot, '-') AS slot, coalesce(CASE slot WHEN 'dk1' THEN '000000' WHEN 'dk2' THEN '222222' WHEN 'lt1' THEN 'FFFFFF' END, '-') AS hex, count(*) AS n FROM k GROUP BY ALL"""
)
def resolve_theme_colours(spark, sf):
    """Aliases by the master's map, the layout's on slides of three, the slide's own on slides of ten."""
    lines = _t(spark, sf, "lineitem").select(F.lit("d").alias("deck_id"), F.col("l_orderkey").alias("slide_no"), _chosen(F.col("l_partkey"), "tx1", "bg1", "accent1", "phClr").alias("alias"))
    slides = lines.select("deck_id", "slide_no").distinct()
    n = F.col("slide_no")
    own = [("master", "tx1", "dk1", F.lit(True)), ("master", "bg1", "lt1", F.lit(True)), ("layout", "tx1", "dk2", n % 3 == 0), ("slide", "tx1", "lt1", n % 10 == 0)]
    maps = slides.select("deck_id", "slide_no", F.explode(F.array_compact(F.array(*[F.when(when, F.struct(F.lit(level).alias("level"), F.lit(a).alias("alias"), F.lit(s).alias("slot"))) for level, a, s, when in own]))).alias("m"))
    schemes = spark.createDataFrame([("d", "dk1", "000000"), ("d", "dk2", "222222"), ("d", "lt1", "FFFFFF")], "deck_id string, slot string, hex string")
    found = resolve.theme_colour(lines, maps.select("deck_id", "slide_no", "m.*"), schemes)
    return found.groupBy("alias", *[F.coalesce(c, F.lit("-")).alias(c) for c in ("slot", "hex")]).agg(F.count("*").alias("n"))


@query(
    """
SELECT o_orderkey AS slide_no, CASE o_orderstatus WHEN 'F' THEN 'AAAAAA' WHEN 'P' THEN 'BBBBBB' ELSE CASE WHEN o_orderpriority = '5-LOW' THEN 'FFFFFF' ELSE 'CCCCCC' END END AS bg,
  CASE o_orderstatus WHEN 'F' THEN 'slide' WHEN 'P' THEN 'layout' ELSE CASE WHEN o_orderpriority = '5-LOW' THEN 'theme' ELSE 'master' END END AS bg_origin FROM orders"""
)
def resolve_backgrounds(spark, sf):
    status = F.col("o_orderstatus")
    slides = _t(spark, sf, "orders").select(
        F.col("o_orderkey").alias("slide_no"), F.when(status == "F", "AAAAAA").alias("slide_bg"), F.when(status == "P", "BBBBBB").alias("layout_bg"),
        F.when(F.col("o_orderpriority") != "5-LOW", "CCCCCC").alias("master_bg"), F.lit("FFFFFF").alias("light1"),
    )
    return resolve.background(slides).select("slide_no", "bg", "bg_origin")


@query(
    """
WITH b AS (SELECT p_partkey, (p_size * 37 + 1)::BIGINT AS w, (p_partkey % 900 + 1)::BIGINT AS h FROM part), s AS (SELECT *, least(1000e0 / w, 700e0 / h) AS k FROM b),
f AS (SELECT p_partkey, CAST(trunc(w * k) AS BIGINT) AS w, CAST(trunc(h * k) AS BIGINT) AS h FROM s)
SELECT p_partkey, w, h, (1000 - w) // 2 AS dx, (700 - h) // 2 AS dy FROM f"""
)
def grid_fit(spark, sf):
    part = _t(spark, sf, "part")
    w, h = (F.col("p_size") * 37 + 1).cast("long"), (F.pmod("p_partkey", F.lit(900)) + 1).cast("long")
    return part.select("p_partkey", G.fit(w, h, F.lit(1000), F.lit(700)).alias("f")).select("p_partkey", "f.*")


# Readings and transforms


@query(
    f"""
WITH {PARA} SELECT deck_id, slide_no, string_agg(CASE WHEN regexp_matches(t, '[.!?:]$') THEN t ELSE t || '.' END, ' ' ORDER BY para_ord) AS text FROM para WHERE t <> '' GROUP BY ALL"""
)
def slide_sentences(spark, sf):
    rows = A.paragraphs(_t(spark, sf, "documents"))
    return transform.slide_text(rows.withColumns({"decorative": F.lit(False), "hidden": F.lit(False)}))


_READING = f"""
{SHAPES}, tt AS (SELECT slide_no, count(*) OVER (PARTITION BY deck_id) AS total, deck_id FROM (SELECT DISTINCT deck_id, slide_no FROM shp)),
hd AS (SELECT slide_no, min(shape_ord) AS o, arg_min(CASE WHEN l_returnflag = 'R' THEN '' ELSE name END, shape_ord) AS t FROM shp WHERE titled GROUP BY 1),
rd AS (SELECT tt.deck_id, tt.slide_no, -1::BIGINT AS ord, 0::BIGINT AS sub, 'Slide ' || tt.slide_no || ' de ' || total || ': ' || coalesce(nullif(t, ''), 'SEM TITULO') AS line FROM tt LEFT JOIN hd USING (slide_no)),
bd AS (SELECT s.* FROM useful s LEFT JOIN hd ON hd.slide_no = s.slide_no WHERE hd.o IS NULL OR hd.o <> s.shape_ord),
al AS (SELECT * FROM rd
  UNION ALL SELECT deck_id, slide_no, shape_ord, 0, CASE WHEN q % 2 = 0 THEN 'marcador, ' ELSE '' END || name FROM bd WHERE l_suppkey % 7 <> 0 AND l_returnflag <> 'R'
  UNION ALL SELECT deck_id, slide_no, shape_ord, 0, CASE tag WHEN 'pic' THEN 'imagem' ELSE 'objeto' END || ', ' || alt FROM bd WHERE l_suppkey % 7 <> 0 AND l_returnflag = 'R'
  UNION ALL SELECT deck_id, slide_no, shape_ord, 1, CASE WHEN has_link THEN 'k: ' ELSE '' END || coalesce(nullif(CAST(q AS VARCHAR), '7'), 'vazio') || ', ' || CASE WHEN has_link THEN 'v: ' ELSE '' END || l_returnflag FROM bd WHERE l_suppkey % 7 = 0
  UNION ALL SELECT deck_id, slide_no, shape_ord, 0, 'k, v' FROM bd WHERE l_suppkey % 7 = 0 AND NOT has_link)"""


def _reading(spark, sf):
    """Every seventh supplier's item is a table with or without a header row; other texts are names."""
    s = _items(spark, sf, "l_returnflag", "l_suppkey", "l_quantity")
    q = F.col("l_quantity").cast("long")
    silent = F.col("l_returnflag") == "R"
    s = s.withColumns({"has_table": F.pmod("l_suppkey", F.lit(7)) == 0, "text": F.when(silent, "").otherwise(F.col("name"))})
    texts = s.withColumns({"para_ord": F.lit(0), "cell_ri": F.lit(None).cast("int"), "bullet": F.when(q % 2 == 0, "buChar")})
    pairs = F.array(F.array(F.lit("k"), F.lit("v")), F.array(F.when(q == 7, " ").otherwise(q.cast("string")), F.col("l_returnflag")))
    cells = s.filter("has_table").select("deck_id", "slide_no", "shape_ord", F.col("has_link").alias("first_row"), F.posexplode(pairs).alias("ri", "cs"))
    cells = cells.select("deck_id", "slide_no", "shape_ord", "first_row", "ri", F.lit(0).alias("tbl_ord"), F.posexplode("cs").alias("ci", "text"))
    slides = s.select("deck_id", "slide_no").distinct().withColumn("notes", F.lit(None).cast("string"))
    return transform.reading(slides, s, texts, cells)


@query(f"WITH {_READING} SELECT deck_id, slide_no, CAST(ord AS INTEGER) AS ord, CAST(sub AS INTEGER) AS sub, line FROM al")
def reading_lines(spark, sf):
    return _reading(spark, sf)


@query(f"WITH {_READING} SELECT deck_id, string_agg(line, chr(10) ORDER BY slide_no, ord, sub, line) AS transcript, CAST(count(*) AS INTEGER) AS lines FROM al GROUP BY deck_id")
def reading_transcript(spark, sf):
    return transform.transcript(_reading(spark, sf))


@query(
    """
WITH c AS (SELECT conv_id AS deck_id, turn AS slide_no, role, text, CASE WHEN turn % 2 = 0 THEN 'x' || chr(10) || 'Descrição da figura:  ' || role || chr(10) || ' two ' ELSE 'none' END AS notes, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT deck_id, slide_no, 'Slide ' || slide_no || ' de ' || n || '. ' || CASE WHEN role = 'user' THEN role ELSE 'Sem título' END || '.' || CASE WHEN text <> '' THEN ' ' || text ELSE '' END || CASE WHEN slide_no % 2 = 0 THEN ' Descrição da figura. ' || role || ' two' ELSE '' END AS script FROM c"""
)
def audio_scripts(spark, sf):
    c = _t(spark, sf, "conversations").withColumnsRenamed({"conv_id": "deck_id", "turn": "slide_no"})
    notes = F.when(F.col("slide_no") % 2 == 0, F.concat(F.lit("x\nDescrição da figura:  "), "role", F.lit("\n two "))).otherwise("none")
    slides = c.select("deck_id", "slide_no", notes.alias("notes"))
    titles = c.filter("role = 'user'").select("deck_id", "slide_no", F.col("role").alias("text"))
    return transform.audio_script(slides, c.select("deck_id", "slide_no", "text"), titles)


_WORDS = "len(list_filter(regexp_split_to_array(text, '[\\s\\x{a0}]+'), lambda w: w <> ''))"


@query(
    f"""
SELECT conv_id, turn, round(greatest(12e0, {_WORDS} * 18e-1 + 8e0), 6) AS seconds FROM conversations"""
)
def sign_durations(spark, sf):
    c = _t(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.round(transform.sign_seconds(F.col("text")), 6).alias("seconds"))


_FPS = "CASE event_id % 4 WHEN 0 THEN '30000/1001' WHEN 1 THEN (user_id % 60) || '/' || (user_id % 5) WHEN 2 THEN '25' ELSE '10/1' END"


def _frames(spark, sf):
    e = F.col("event_id")
    u = F.col("user_id")
    fraction = F.when(e % 4 == 0, "30000/1001").when(e % 4 == 1, F.concat_ws("/", (u % 60).cast("string"), (u % 5).cast("string"))).when(e % 4 == 2, "25").otherwise("10/1")
    return _t(spark, sf, "events").select("event_id", F.col("event_type").alias("deck_id"), transform.frame_rate(fraction).alias("fps"))


@query(
    f"""
WITH f AS (SELECT event_id, string_split({_FPS}, '/') AS p FROM events)
SELECT event_id, round(coalesce(CAST(p[1] AS DOUBLE) / nullif(CAST(coalesce(p[2], '1') AS DOUBLE), 0), -1), 6) AS fps FROM f"""
)
def frame_rates(spark, sf):
    return _frames(spark, sf).select("event_id", F.round(F.coalesce("fps", F.lit(-1.0)), 6).alias("fps"))


@query(
    f"""
WITH f AS (SELECT event_type AS deck_id, string_split({_FPS}, '/') AS p FROM events)
SELECT deck_id, count(*) FILTER (CAST(p[1] AS DOUBLE) / nullif(CAST(coalesce(p[2], '1') AS DOUBLE), 0) < 15) AS n FROM f GROUP BY deck_id"""
)
def slow_videos(spark, sf):
    return transform.slow_videos(_frames(spark, sf))


@query(
    """
SELECT o_orderpriority AS deck_id, CAST(o_orderkey AS VARCHAR) AS slide_id FROM orders WHERE o_orderstatus = 'F'"""
)
def section_slides(spark, sf):
    """Orders as slides of sections by status, one row of ids for each hundred customers."""
    o = _t(spark, sf, "orders").select(F.col("o_orderpriority").alias("deck_id"), F.col("o_orderkey").cast("string").alias("slide_id"), "o_orderstatus", "o_custkey")
    name = F.when(F.col("o_orderstatus") == "F", "Anexos").otherwise("Corpo")
    sections = o.groupBy("deck_id", name.alias("name"), F.floor(F.col("o_custkey") / 100)).agg(F.collect_list("slide_id").alias("slide_ids"))
    return transform.section_slides(o.select("deck_id", "slide_id"), sections, "ANEXOS")


@query(
    f"""
WITH {SHAPES}, t AS (SELECT *, min(shape_ord) FILTER (titled) OVER (PARTITION BY slide_no) AS o FROM shp),
r AS (SELECT *, l_returnflag = 'A' AS md, CASE WHEN o IS NULL THEN 1 WHEN shape_ord < o AND l_returnflag <> 'A' THEN 0 WHEN titled THEN 0 WHEN l_returnflag = 'A' THEN 1 ELSE 2 END AS k FROM t)
SELECT deck_id, slide_no, CAST(shape_ord AS INTEGER) AS shape_ord, CAST(row_number() OVER (PARTITION BY slide_no ORDER BY k, shape_ord) - 1 AS INTEGER) AS new_ord FROM r"""
)
def media_order(spark, sf):
    s = _items(spark, sf, "l_returnflag")
    s = s.withColumn("media_kind", F.when(F.col("l_returnflag") == "A", "audio"))
    return transform.media_after_title(s).select("deck_id", "slide_no", "shape_ord", "new_ord")


@query(
    """
WITH d AS (SELECT source AS deck_id, doc_id AS slide_no, string_split(coalesce(text, ''), chr(10)) AS ls, ['conteudo', 'destaque', 'cartoes', 'comparacao', 'capa'][(doc_id % 5) + 1] AS ty FROM documents),
p AS (SELECT *, CASE WHEN slide_no % 3 = 0 THEN ls[1] ELSE '' END AS key, len(ls) > 1 AS own FROM d)
SELECT deck_id, slide_no, CASE WHEN ty IN ('cartoes', 'comparacao', 'destaque') THEN 'conteudo' ELSE ty END AS type, CASE WHEN slide_no % 2 = 0 THEN 'own' ELSE ls[1] END AS title,
  CASE WHEN ty = 'capa' THEN array_to_string(ls, chr(10)) WHEN own THEN ls[2] WHEN key <> '' THEN key ELSE '-' END AS content, CASE WHEN ty <> 'capa' AND NOT own AND key = '' THEN 'no key message' ELSE '-' END AS error FROM p"""
)
def profile_projection(spark, sf):
    docs = _t(spark, sf, "documents")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    n = F.col("doc_id")
    slides = docs.select(
        F.col("source").alias("deck_id"), n.alias("slide_no"), _chosen(n, "conteudo", "destaque", "cartoes", "comparacao", "capa").alias("type"), lines[0].alias("title"), lines.alias("content"),
        F.when(n % 3 == 0, lines[0]).alias("key_message"), F.when(n % 2 == 0, "own").otherwise("").alias("own_title"), F.slice(lines, 2, 1).alias("own_content"),
    )
    found = transform.project_profile(slides, "libras")
    return found.select("deck_id", "slide_no", "type", "title", F.coalesce(F.array_join("content", "\n"), F.lit("-")).alias("content"), F.coalesce("error", F.lit("-")).alias("error"))


@query(
    """
WITH l AS (SELECT source AS deck_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
SELECT deck_id, CAST(count(*) FILTER (length(line) % 4 = 0) AS BIGINT) AS n FROM l GROUP BY deck_id"""
)
def missing_texts(spark, sf):
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.when(F.char_length(x) % 4 == 0, transform.MISSING % "texto").otherwise(x))
    rows = _t(spark, sf, "documents").select(F.col("source").alias("deck_id"), lines.alias("content"))
    return transform.count_missing(rows, key="deck_id").withColumn("n", F.col("n").cast("long"))


@query(
    f"""
WITH {PARA}, l AS (SELECT slide_no AS doc_id, para_ord, CASE WHEN length(text) % 5 = 0 AND t <> '' THEN t END AS h0, regexp_replace(t, '^[-*+•]\\s+', '') AS t FROM para),
r AS (SELECT doc_id, para_ord, nullif(trim(regexp_replace(h0, '\\s*#*$', '')), '') AS h, t FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para_ord) AS rn FROM r WHERE h IS NOT NULL OR t <> ''),
o AS (SELECT *, h IS NOT NULL OR rn = 1 AS opens FROM k), b AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY para_ord) AS block FROM o),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, block) AS n, row_number() OVER (PARTITION BY doc_id, block ORDER BY para_ord) - 1 AS pos, first_value(coalesce(h, left(t, 60))) OVER (PARTITION BY doc_id, block ORDER BY para_ord) AS title FROM b)
SELECT doc_id, CAST(block AS BIGINT) AS block, title, CAST(pos AS INTEGER) AS pos, CASE WHEN opens THEN '-' ELSE t END AS text FROM n WHERE NOT opens OR n = 1"""
)
def text_blocks(spark, sf):
    """Lines of a length that five divides are headings."""
    p = A.paragraphs(_t(spark, sf, "documents"))
    bare = T.strip(F.col("text"))
    line = F.when((F.char_length("text") % 5 == 0) & (bare != ""), F.concat(F.lit("## "), bare)).otherwise(F.regexp_replace("text", "^#", "."))
    lines = p.select(F.col("slide_no").alias("doc_id"), F.col("para_ord").alias("line_no"), line.alias("line"))
    found = transform.text_blocks(lines)
    return found.select("doc_id", "block", "title", "pos", F.coalesce("text", F.lit("-")).alias("text"))


_IMPORTED = f"""
{SHAPES}, kd AS (SELECT *, CASE WHEN l_suppkey % 5 = 0 THEN 'foto.png' ELSE alt END AS told, CASE WHEN titled THEN 'title' WHEN l_suppkey % 11 = 0 THEN 'media'
  WHEN l_suppkey % 7 = 0 THEN 'table' WHEN tag = 'pic' THEN 'figure' ELSE 'text' END AS b FROM useful),
sl AS (SELECT DISTINCT deck_id, slide_no FROM shp),
tt AS (SELECT slide_no, arg_max(name || ' ' || l_returnflag, shape_ord) AS title FROM kd WHERE b = 'title' GROUP BY 1),
bo AS (SELECT slide_no, string_agg(name || '|' || l_returnflag, '|' ORDER BY shape_ord) AS content FROM kd WHERE b = 'text' GROUP BY 1),
fg AS (SELECT slide_no, count(*) AS n, count(*) FILTER (told = '') AS bare, count(*) FILTER (told = 'foto.png') AS generic, arg_min(CASE told WHEN '' THEN
  '[FALTA: texto alternativo da figura do slide ' || slide_no || ']' WHEN 'foto.png' THEN '[FALTA: texto alternativo real, o atual é ''foto.png'']' ELSE told END, shape_ord) AS alt FROM kd WHERE b = 'figure' GROUP BY 1),
tb AS (SELECT slide_no, arg_min(CASE WHEN q % 7 = 0 THEN q || '|' || l_returnflag ELSE 'k|v' END, shape_ord) AS header, arg_min(CASE WHEN q % 7 = 0 THEN 0 ELSE 1 END, shape_ord) AS n_rows,
  count(*) FILTER (NOT has_link) AS bare FROM kd WHERE b = 'table' GROUP BY 1),
md AS (SELECT slide_no, count(*) AS n FROM kd WHERE b = 'media' GROUP BY 1)"""


def _imported(spark, sf):
    """Every seventh supplier's item is a table, whose first row may be empty; every eleventh's is a video."""
    s = _items(spark, sf, "l_returnflag", "l_suppkey", "l_quantity")
    q, has_table = F.col("l_quantity").cast("long"), F.pmod("l_suppkey", F.lit(7)) == 0
    s = s.withColumns({
        "has_table": has_table, "tag": F.when(has_table, "graphicFrame").otherwise(F.col("tag")),
        "media_kind": F.when(F.pmod("l_suppkey", F.lit(11)) == 0, "video"),
        "alt": F.when(F.pmod("l_suppkey", F.lit(5)) == 0, " foto.png").otherwise(F.col("alt")),
    })
    key = ["deck_id", "slide_no", "shape_ord"]
    none, state = F.lit(None).cast("int"), ["depth", "decorative", "hidden"]
    flag = F.concat(F.lit(" "), F.col("l_returnflag"), F.lit(" "))
    texts = s.select(*key, *state, none.alias("cell_ri"), none.alias("cell_ci"), F.posexplode(F.array("name", flag, F.lit(" "))).alias("para_ord", "text"))
    head = F.when(q % 7 == 0, F.array(F.lit(""), F.lit(" "))).otherwise(F.array(F.lit("k"), F.lit("v")))
    grid = s.filter("has_table").select(*key, *state, F.posexplode(F.array(head, F.array(q.cast("string"), flag))).alias("cell_ri", "cs"))
    grid = grid.select(*key, *state, "cell_ri", F.posexplode("cs").alias("cell_ci", "text")).withColumn("para_ord", F.col("cell_ri") * 2 + F.col("cell_ci"))
    cells = s.filter("has_table").select(*key, F.col("has_link").alias("first_row"))
    slides = s.select("deck_id", "slide_no").distinct().withColumn("notes", F.when(F.col("slide_no") % 2 == 0, " n "))
    return imports.import_decks(slides, s, texts.unionByName(grid), cells)


@query(
    f"""
WITH {_IMPORTED} SELECT deck_id, slide_no, coalesce(title, '[FALTA: título do slide ' || slide_no || ']') AS title, coalesce(content, '') AS content, coalesce(fg.alt, '-') AS alt,
  coalesce(header, '-') AS header, CAST(coalesce(n_rows, -1) AS BIGINT) AS n_rows, CASE WHEN slide_no % 2 = 0 THEN 'n' ELSE '-' END AS notes
FROM sl LEFT JOIN tt USING (slide_no) LEFT JOIN bo USING (slide_no) LEFT JOIN fg USING (slide_no) LEFT JOIN tb USING (slide_no)"""
)
def import_deck_slides(spark, sf):
    script, _ = _imported(spark, sf)
    return script.select(
        "deck_id", "slide_no", "title", F.array_join("content", "|").alias("content"), F.coalesce("figure.alt", F.lit("-")).alias("alt"),
        F.coalesce(F.array_join("table.header", "|"), F.lit("-")).alias("header"), F.when(F.col("table").isNull(), -1).otherwise(F.size("table.rows")).cast("long").alias("n_rows"),
        F.coalesce("notes", F.lit("-")).alias("notes"),
    )


@query(
    f"""
WITH {_IMPORTED}, al AS (SELECT deck_id, slide_no, 'media' AS cause, md.n FROM sl JOIN md USING (slide_no) UNION ALL SELECT deck_id, slide_no, 'title', 1 FROM sl ANTI JOIN tt USING (slide_no)
  UNION ALL SELECT deck_id, slide_no, 'alt', bare FROM sl JOIN fg USING (slide_no) UNION ALL SELECT deck_id, slide_no, 'generic_alt', generic FROM sl JOIN fg USING (slide_no)
  UNION ALL SELECT deck_id, slide_no, 'figures', fg.n FROM sl JOIN fg USING (slide_no) WHERE fg.n > 1 UNION ALL SELECT deck_id, slide_no, 'header', bare FROM sl JOIN tb USING (slide_no))
SELECT deck_id, slide_no, cause, CAST(n AS BIGINT) AS n FROM al WHERE n > 0"""
)
def import_deck_notices(spark, sf):
    return _imported(spark, sf)[1]


@query(
    """
SELECT doc_id, coalesce(source, '') || CASE doc_id % 3 WHEN 1 THEN ' — versão Libras como primeira língua' WHEN 2 THEN ' — versão leitura fácil' ELSE '' END
  || CASE doc_id % 4 WHEN 1 THEN ' — alto contraste' WHEN 2 THEN ' — modo escuro' ELSE '' END AS title FROM documents"""
)
def document_titles(spark, sf):
    docs = _t(spark, sf, "documents")
    profile = _chosen(F.col("doc_id"), "completo", "libras", "leitura_facil")
    theme = F.when(F.col("doc_id") % 4 != 3, _chosen(F.col("doc_id"), "Modo padrão", "Alto contraste", "Modo escuro", ""))
    return docs.select("doc_id", imports.document_title(F.coalesce("source", F.lit("")), profile, theme).alias("title"))


@query(
    """
WITH b AS (SELECT p_partkey, p_size % 9 + 1 AS lines, p_size % 14 + 1 AS rows, 1512000 + (p_partkey % 40) * 100000 AS y FROM part),
r AS (SELECT *, 6444000 - y AS room, greatest(378000, least(630000, (6444000 - y) // rows)) AS rh FROM b), h AS (SELECT *, rh * rows AS height FROM r),
p AS (SELECT *, y + CASE WHEN height < room THEN (room - height) // 3 ELSE 0 END AS place FROM h)
SELECT p_partkey, CAST(greatest(3421440, least(4752000, 936000 + lines * 540000)) AS BIGINT) AS card, CAST(rh AS BIGINT) AS row_height, CAST(height AS BIGINT) AS height, CAST(place AS BIGINT) AS y,
  place + height <= 6444000 AS fits, CAST(CASE WHEN place + height > 6444000 THEN greatest(1, room // 378000 - 1) ELSE -1 END AS BIGINT) AS most FROM p"""
)
def grid_heights(spark, sf):
    y = F.pmod("p_partkey", F.lit(40)) * 100_000 + G.CONTENT_Y
    part = _t(spark, sf, "part").select("p_partkey", G.card_height(F.col("p_size") % 9 + 1).alias("card"), G.table_box(y, F.col("p_size") % 14 + 1).alias("t"))
    return part.select("p_partkey", "card", "t.*").withColumn("most", F.coalesce("most", F.lit(-1).cast("long")))
