"""Registered queries over whole catalogues, trees and nested values, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grid as G
from ..functions import text as T
from ..operators import audit, catalogue, package, report, resolve, rules, transform, trees
from ..sources import adapters as A
from ..sources import scripts, sql
from .queries import _CAPS, _RES, _VERSIONS, PARA, REGISTRY, _found, _in, _lum, _t, query

# All rules of single rows. The adapter's choices are integer arithmetic on keys, so that every rule has rows.

_ALTS = ("", "  ", "foto.png", "Image of a cat", "palavra " * 25, "Total anual das vendas", "descricao gerada automaticamente", "voce nao viu", "ok")
_TEXTS = ("", "click here", "https://a.example/b", "Um texto qualquer")


def _catalogue_tables(spark, sf):
    item = _t(spark, sf, "lineitem")
    rows = A.shapes(item, "l_partkey", "l_suppkey", "l_quantity", "l_linenumber")
    part, supplier, line = (F.col(c) for c in ("l_partkey", "l_suppkey", "l_linenumber"))

    def of(column, values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(column, F.lit(len(values))) + 1).cast("int"))

    known = F.pmod(part, F.lit(11)) != 0
    shapes = rows.withColumns(
        {
            "x": F.expr("x div 2 * 3"),
            "is_ph": F.pmod(part, F.lit(4)) != 0,
            "text": of(supplier, _TEXTS),
            "alt": of(F.col("l_quantity").cast("long"), _ALTS),
            "content_uri": F.when(F.pmod(part, F.lit(5)) == 0, "http://s/2006/chart"),
            "native_w": F.when(known, (F.pmod(part, F.lit(7)) + 1) * 100),
            "native_h": F.when(known, F.lit(400)),
            "caps": F.when(F.pmod(supplier, F.lit(9)) == 0, "all"),
            "media_kind": F.when(F.pmod(part, F.lit(13)) == 0, "video"),
            "link_rid": F.when(F.pmod(line, F.lit(2)) == 0, "r1"),
            "hidden": F.pmod(supplier, F.lit(8)) == 0,
            "slide_w": F.lit(G.WIDTH),
            "slide_h": F.lit(G.HEIGHT),
        }
    )
    order = _t(spark, sf, "orders")
    key = F.col("o_orderkey")
    slides = order.select(
        F.concat(F.lit("d"), F.pmod(key, F.lit(97)).cast("string")).alias("deck_id"), key.alias("slide_no"),
        F.when(key % 3 == 0, " Blank ").otherwise("Conteudo").alias("layout_name"), F.when(key % 2 == 0, "said").otherwise("").alias("notes"),
        F.when(key % 5 == 0, F.array(F.lit("push"))).otherwise(F.array(F.lit("fade"))).alias("transition_children"),
    )
    paragraphs = A.paragraphs(_t(spark, sf, "documents"))
    n = F.col("para_ord")
    paragraphs = paragraphs.withColumns(
        {
            "text": F.when(n % 9 == 8, F.concat(F.lit("- "), "text")).otherwise(F.col("text")),
            "algn": F.when(n % 7 == 3, "just"),
            "line_pct": (80_000 + n % 8 * 20_000).cast("long"),
            "max_size": F.when(n % 5 == 0, 4400),
            "caps": F.when(n % 11 == 5, "small"),
        }
    )
    size, key = F.col("p_size"), F.col("p_partkey")
    part = _t(spark, sf, "part")
    more = part.select(
        key.alias("slide_no"), of(size, ("Arial", "Times New Roman", "+mj-lt", " Calibri ")).alias("typeface"), (key % 10 == 0).alias("titled"),
        (key % 6 == 0).alias("i"), F.when(key % 8 == 0, "sng").alias("u"), (key % 16 == 0).alias("has_link"), F.when(key % 4 == 1, "r2").alias("link_rid"),
    )
    runs = A.colour_runs(part).join(more, "slide_no")
    return {"deck": A.page_decks(_t(spark, sf, "pages")), "slide": slides, "shape": shapes, "paragraph": paragraphs, "run": runs}


def _pick(column: str, values: tuple[str, ...]) -> str:
    return f"{list(values)!r}[({column} % {len(values)}) + 1]"


def _cases(tests: list[tuple[str, str, str, str, str]]) -> str:
    """tests: rule, severity, condition, value, verdict."""
    made = (
        f"CASE WHEN {c} THEN {{'rule': '{r}', 'severity': '{s}', 'verdict': '{v}', 'value': CAST({x} AS DOUBLE)}} END" for r, s, c, x, v in tests
    )
    return "unnest(list_filter([" + ",\n  ".join(made) + "], lambda x: x IS NOT NULL)) AS f"


_STRIP = r"regexp_replace({0}, '^[\s\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\s\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')"
_USEFUL = "NOT decorative AND NOT hidden"
_TITLED = "ph_type = 'title'"
_OWN = "NOT decorative AND trim(alt) <> ''"
_LINK = "link_rid IS NOT NULL AND trim(text) <> ''"
_HREF = [
    ("H01", "A", f"{_LINK} AND regexp_matches(text, '(?i)^\\s*(https?://|www\\.)')", "NULL", "fail"),
    ("H02", "A", f"{_LINK} AND trim(lower(text), ' .:;!?') IN {_in(T.VAGUE_LINK)}", "NULL", "fail"),
]
_SHAPE_TESTS = [
    ("B05", "E", "tag = 'sp' AND NOT is_ph AND trim(text) <> ''", "NULL", "fail"),
    ("C04", "A", "NOT decorative AND n_children > 5 AND trim(alt) = ''", "n_children", "fail"),
    ("C05", "A", "regexp_matches(trim(name), '(?i)^shape\\s*\\d+$')", "NULL", "fail"),
    ("C06", "A", f"NOT decorative AND NOT {_TITLED} AND (x + cx <= 0 OR y + cy <= 0 OR x >= {G.WIDTH} OR y >= {G.HEIGHT})", "NULL", "fail"),
    *[
        (r, s, f"(tag = 'pic' OR (tag = 'sp' AND NOT is_ph AND trim(text) = '')) AND {c}", x, v)
        for r, s, c, x, v in (
            ("D11", "E", "decorative AND trim(alt) <> ''", "length(alt)", "fail"),
            ("D01", "E", "NOT decorative AND alt = ''", "length(alt)", "fail"),
            ("D02", "E", "NOT decorative AND alt <> '' AND trim(alt) = ''", "length(alt)", "fail"),
            ("D03", "E", f"{_OWN} AND (regexp_matches(alt, '(?i)\\.(png|jpe?g|gif)\\s*$') OR (bare <> '' AND (bare IN {_in(T.GENERIC_ALT)} OR length(bare) <= 3)))", "length(alt)", "fail"),
            ("D04", "A", f"{_OWN} AND regexp_matches(alt, '(?i)^(imagem|foto|image)\\s+(de|do|of)\\s')", "length(alt)", "fail"),
            ("D05", "E", f"{_OWN} AND regexp_matches(alt, '(?i)descri[cç][aã]o gerada automaticamente')", "length(alt)", "fail"),
            ("D06", "A", f"{_OWN} AND length(alt) > 150", "length(alt)", "fail"),
            ("D08", "A", f"{_OWN} AND list_has_any(regexp_extract_all(lower(alt), '[a-zà-ÿ]+'), {list(T.NEEDS_ACCENT)})", "length(alt)", "fail"),
            ("D07", "E", f"{_OWN} AND l_partkey % 5 = 0 AND slide_no % 2 <> 0", "NULL", "unverified"),
        )
    ],
    ("I07", "A", f"has_link AND (cx < {G.TARGET_LEAST} OR cy < {G.TARGET_LEAST})", "least(cx, cy)", "fail"),
    ("I01", "E", "l_partkey % 13 = 0", "NULL", "unverified"),
    ("N01", "E", "tag = 'pic' AND off > 1e-2", "round(off, 6)", "fail"),
    ("N01", "E", "tag = 'pic' AND nw IS NULL", "NULL", "unverified"),
    (
        "N02", "E", f"{_USEFUL} AND (y + cy > {G.FOOTER_Y + G.TOLERANCE} OR x < {G.MARGIN - G.TOLERANCE} OR y < {G.MARGIN - G.TOLERANCE} "
        f"OR x + cx > {G.WIDTH - G.MARGIN + G.TOLERANCE})", "y + cy", "fail",
    ),
    ("N09", "E", "NOT hidden AND l_suppkey % 9 = 0 AND trim(text) <> ''", "NULL", "fail"),
    ("N10", "A", f"{_USEFUL} AND tag = 'pic' AND l_partkey % 13 <> 0 AND least(cx, cy) < {G.FIGURE_LEAST}", "least(cx, cy)", "fail"),
    *_HREF,
]
_WORDS = "regexp_extract_all(text, '[A-Za-zÀ-ÿ]{2,}')"
_PARAGRAPH_TESTS = [
    ("B09", "A", "regexp_matches(t, '^[-*•·]\\s+\\S')", "NULL", "fail"),
    ("F07", "A", "length(t) > 80", "length(t)", "fail"),
    ("F06", "A", "t <> '' AND len(ws) >= 3 AND len(list_filter(ws, lambda w: w = upper(w) AND w <> lower(w) AND NOT contains(w, 'ß'))) = len(ws)", "NULL", "fail"),
    ("F06", "A", "t <> '' AND para_ord % 11 = 5", "NULL", "fail"),
    ("F04", "E", "t <> '' AND para_ord % 7 = 3", "NULL", "fail"),
    ("F05", "A", "t <> '' AND ((para_ord > 0 AND para_ord % 5 <> 0 AND pct < 150000) OR (para_ord = 0 AND pct < 90000))", "pct / 100000.0", "fail"),
]
_RUN_TESTS = [
    ("E01", "E", "ratio + 0.005 < 4.5 AND NOT big", "round(ratio, 6)", "fail"),
    ("E02", "E", "ratio + 0.005 < 3.0 AND big", "round(ratio, 6)", "fail"),
    ("E03", "D", "NOT big AND ratio + 0.005 >= 4.5 AND ratio < 7.0", "round(ratio, 6)", "fail"),
    ("E08", "A", "fg = '000000' AND bg = 'FFFFFF'", "round(ratio, 6)", "fail"),
    ("E09", "A", "bg IS NULL AND k % 2 = 0", "NULL", "unverified"),
    ("E01", "A", "bg IS NULL AND k % 2 <> 0", "NULL", "unverified"),
    ("F01", "A", f"NOT starts_with(face, '+') AND lower(trim(face)) NOT IN {_in(T.SANS_SAFE)}", "NULL", "fail"),
    ("F02", "E", "k % 10 <> 0 AND size < 1800", "size / 100.0", "fail"),
    ("F03", "A", "k % 10 = 0 AND size < 3200", "size / 100.0", "fail"),
    ("F06", "A", "k % 6 = 0", "NULL", "fail"),
    ("F06", "A", "k % 8 = 0 AND k % 16 <> 0", "NULL", "fail"),
    *[(r, s, c.replace("link_rid IS NOT NULL", "k % 4 = 1"), x, v) for r, s, c, x, v in _HREF],
]


def _metadata_sql() -> str:
    always = ", ".join(str(x) for x in rules.ALWAYS_UNVERIFIED)
    _, sql = REGISTRY["a_metadata"]
    # a_metadata's SQL has no value column: A06's is the page's ratio
    return f"""
SELECT deck_id, rule, severity, 'fail' AS verdict, CAST(-1 AS BIGINT) AS slide_no, -1 AS shape_ord, -1 AS para_ord,
  CASE WHEN rule = 'A06' THEN round(CAST(length(regexp_extract(html, '<title>([^<]*)</title>', 1)) * 4 AS DOUBLE) / CAST(length(url) % 8 * 9 AS DOUBLE), 6) END AS value
FROM ({sql}) m JOIN pages p ON CAST(p.page_id AS VARCHAR) = m.deck_id
UNION ALL SELECT CAST(page_id AS VARCHAR), rule, severity, 'unverified', -1, -1, -1, NULL FROM pages, (VALUES {always}) AS always(rule, severity)"""


_CATALOGUE = f"""
WITH s0 AS (SELECT 'd' || (l_orderkey % 97) AS deck_id, l_orderkey AS slide_no,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS INTEGER) AS shape_ord,
  CASE WHEN l_partkey % 3 = 0 THEN 'pic' ELSE 'sp' END AS tag, 'Shape ' || (l_suppkey % 5) AS name, l_suppkey % 6 = 0 AS decorative,
  l_suppkey % 8 = 0 AS hidden, CASE WHEN l_linenumber = 1 THEN 'title' ELSE 'body' END AS ph_type, l_partkey % 4 <> 0 AS is_ph,
  ((l_partkey * 7919) % 10000) * 1500 AS x, ((l_suppkey * 6101 + l_partkey) % 6000) * 1000 AS y, CAST(l_quantity AS BIGINT) * 120000 + 100000 AS cx,
  (l_partkey % 40) * 100000 + 150000 AS cy, CAST(l_quantity AS BIGINT) % 10 AS n_children, l_linestatus = 'O' AS has_link,
  {_pick("l_suppkey", _TEXTS)} AS text, {_pick("CAST(l_quantity AS BIGINT)", _ALTS)} AS alt, CASE WHEN l_linenumber % 2 = 0 THEN 'r1' END AS link_rid,
  CASE WHEN l_partkey % 11 <> 0 THEN (l_partkey % 7 + 1) * 100 END AS nw, l_partkey, l_suppkey FROM lineitem),
s1 AS (SELECT *, regexp_replace(lower({_STRIP.format("alt")}), '[.:;!? ]+$', '') AS bare,
  abs(CAST(cx AS DOUBLE) / CAST(cy AS DOUBLE) - CAST(nw AS DOUBLE) / 400e0) / (CAST(nw AS DOUBLE) / 400e0) AS off FROM s0),
s2 AS (SELECT deck_id, slide_no, shape_ord, {_cases(_SHAPE_TESTS)} FROM s1),
p0 AS (SELECT source AS deck_id, doc_id AS slide_no, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
p1 AS (SELECT deck_id, slide_no, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS para_ord FROM p0),
p2 AS (SELECT * EXCLUDE (line), CASE WHEN para_ord % 9 = 8 THEN '- ' || line ELSE line END AS text, 80000 + para_ord % 8 * 20000 AS pct FROM p1),
p3 AS (SELECT *, {_STRIP.format("text")} AS t, {_WORDS} AS ws FROM p2), p4 AS (SELECT deck_id, slide_no, para_ord, {_cases(_PARAGRAPH_TESTS)} FROM p3),
r0 AS (SELECT p_brand AS deck_id, p_partkey AS k, p_name AS text, p_size * 60 AS size, {_pick("p_size", ("Arial", "Times New Roman", "+mj-lt", " Calibri "))} AS face,
  CASE WHEN p_partkey % 50 = 0 THEN '000000' ELSE upper(printf('%06x', (p_partkey * 7654321) % 16777216)) END AS fg,
  CASE WHEN p_partkey % 25 = 0 THEN 'FFFFFF' WHEN p_partkey % 31 <> 0 THEN upper(printf('%06x', (p_partkey * 1234567 + 99) % 16777216)) END AS bg,
  p_size * 60 >= 1800 OR (p_partkey % 3 = 0 AND p_size * 60 >= 1400) AS big FROM part WHERE trim(p_name) <> ''),
r1 AS (SELECT *, {_lum("fg")} AS a, CASE WHEN bg IS NOT NULL THEN {_lum("bg")} END AS b FROM r0),
r2 AS (SELECT *, CASE WHEN b IS NOT NULL THEN (greatest(a, b) + 0.05) / (least(a, b) + 0.05) END AS ratio FROM r1),
r3 AS (SELECT deck_id, k, {_cases(_RUN_TESTS)} FROM r2),
o0 AS (SELECT 'd' || (o_orderkey % 97) AS deck_id, o_orderkey AS slide_no, {_cases([("B06", "A", "o_orderkey % 3 = 0", "NULL", "fail"), ("I06", "A", "o_orderkey % 5 = 0", "NULL", "fail")])} FROM orders)
SELECT deck_id, f.rule, f.severity, f.verdict, slide_no, shape_ord, -1 AS para_ord, f.value FROM s2
UNION ALL SELECT deck_id, f.rule, f.severity, f.verdict, slide_no, 0, para_ord, f.value FROM p4
UNION ALL SELECT deck_id, f.rule, f.severity, f.verdict, k, 0, -1, f.value FROM r3
UNION ALL SELECT deck_id, f.rule, f.severity, f.verdict, slide_no, -1, -1, f.value FROM o0
UNION ALL {_metadata_sql()}"""


@query(_CATALOGUE)
def catalogue_rows(spark, sf):
    """Every rule of single rows on items (shapes), lines (paragraphs), parts (runs), orders (slides) and pages (decks)."""
    found = catalogue.row_rules(_catalogue_tables(spark, sf), "en")
    return _found(found, "deck_id", "rule", "severity", "verdict", "slide_no", "shape_ord", "para_ord", "value")


# Trees

_VOID = ("meta", "br")
_TREE = f"""
tk0 AS (SELECT CAST(page_id AS VARCHAR) AS deck_id, regexp_extract_all(html, '</?[a-zA-Z][a-zA-Z0-9]*') AS ts FROM pages),
tk1 AS (SELECT deck_id, unnest(ts) AS k, CAST(generate_subscripts(ts, 1) - 1 AS INTEGER) AS ord FROM tk0),
tk2 AS (SELECT deck_id, ord, upper(regexp_replace(k, '^</?', '')) AS type, CASE WHEN starts_with(k, '</') THEN -1 WHEN lower(k[2:]) IN {_in(_VOID)} THEN 0 ELSE 1 END AS step FROM tk1),
tk3 AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY deck_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS level FROM tk2),
tk4 AS (SELECT * FROM tk3 WHERE step >= 0), holders AS (SELECT deck_id, ord AS holder, level + 1 AS at FROM tk4 WHERE step = 1),
nodes AS MATERIALIZED (SELECT c.deck_id, c.ord AS node, c.type, h.holder AS parent FROM tk4 c ASOF LEFT JOIN holders h ON h.deck_id = c.deck_id AND h.at = c.level AND c.ord > h.holder),
tree AS (SELECT deck_id, node, type, 0 AS depth, [node] AS path FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.deck_id, n.node, n.type, t.depth + 1, list_append(t.path, n.node) FROM tree t JOIN nodes n ON n.deck_id = t.deck_id AND n.parent = t.node WHERE t.depth < {trees.MAX_DEPTH})"""


@query(
    f"""
WITH RECURSIVE {_TREE} SELECT deck_id, node, type, depth, CAST(row_number() OVER (PARTITION BY deck_id ORDER BY path) - 1 AS INTEGER) AS place FROM tree"""
)
def l_tag_tree(spark, sf):
    """The elements of pages as the tags of exported files, depth first."""
    tokens = F.regexp_extract_all("html", F.lit("(</?[a-zA-Z][a-zA-Z0-9]*)"), 1)
    rows = _t(spark, sf, "pages").select(F.col("page_id").cast("string").alias("deck_id"), F.posexplode(tokens).alias("ord", "k"))
    name = F.regexp_replace("k", "^</?", "")
    step = F.when(F.col("k").startswith("</"), -1).when(F.lower(name).isin(*_VOID), 0).otherwise(1)
    nodes = trees.parents(rows.select("deck_id", "ord", F.upper(name).alias("type"), step.alias("step")), ["deck_id"])
    return trees.tag_tree(nodes.withColumn("node", F.col("ord")))


# Reports and scripts of unknown nesting: conversations, whose turns are rules or slides, in three layouts


def _reports(spark, sf):
    n = F.char_length("text")
    said = [
        F.when(n % 2 == 0, "FAILED").otherwise("PASSED").alias("ruleStatus"),
        F.lit("ISO 14289-1").alias("specification"),
        F.when(n % 5 != 0, n % 5).alias("failedChecks"),
        F.col("role").alias("description"),
    ]
    test = (n % 7).alias("testNumber")
    flat = F.struct(*said, F.concat(F.lit("7."), "turn").alias("clause"), F.struct(test).alias("ruleId"))
    deep = F.struct(*said, F.struct(F.concat(F.lit("7."), "turn").alias("clause"), test).alias("ruleId"), F.array(F.struct(F.lit("failed").alias("status"))).alias("checks"))
    rows = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(flat).alias("flat"), F.collect_list(deep).alias("deep"))
    inner = F.struct(F.struct(F.struct(F.col("flat").alias("ruleSummaries")).alias("details")).alias("validationResult"))
    layouts = [
        F.to_json(F.struct(F.struct(F.array(inner).alias("jobs")).alias("report"))),
        F.to_json(F.col("deep")),
        F.to_json(F.struct(F.lit("PASSED").alias("ruleStatus"), F.create_map(F.lit("a b"), F.struct(F.array("flat", "flat").alias("x"))).alias("jobs"))),
    ]
    json = F.when(F.col("conv_id") % 3 == 0, layouts[0]).when(F.col("conv_id") % 3 == 1, layouts[1]).otherwise(layouts[2])
    return rows.select(F.col("conv_id").alias("deck_id"), json.alias("json"))


@query(
    """
WITH c AS (SELECT conv_id AS deck_id, 'ISO 14289-1 7.' || turn || '-' || (length(text) % 7) AS rule, CASE WHEN length(text) % 5 = 0 THEN 1 ELSE length(text) % 5 END AS n, role AS description
  FROM conversations WHERE length(text) % 2 = 0)
SELECT deck_id, rule, CAST(n AS BIGINT) AS n, description FROM c UNION ALL SELECT deck_id, rule, CAST(n AS BIGINT), description FROM c WHERE deck_id % 3 = 2"""
)
def l_failed_nodes(spark, sf):
    """Failures at any depth of three layouts of reports; the third holds each twice."""
    return trees.failed_nodes(_reports(spark, sf)).select("deck_id", "rule", "n", "description")


@query(
    """
WITH c AS (SELECT conv_id, turn, length(text) AS n FROM conversations)
SELECT conv_id AS deck_id, CAST(sum((n % 2 = 0)::INT + (n % 3 = 0)::INT + (n % 5 = 0)::INT * 2 + (n % 7 = 0)::INT + (n % 11 = 0)::INT) AS BIGINT) AS n FROM c GROUP BY 1"""
)
def script_markers(spark, sf):
    """Markers in titles, lines, cards (two each), figures and cells of scripts."""
    n, mark = F.char_length("text"), F.lit("[FALTA: texto]")

    def left(k: int):
        return F.when(n % k == 0, mark).otherwise("escrito [FALTA: não]")

    card = F.struct(left(5).alias("titulo"), F.array(F.lit("x"), left(5)).alias("texto"))
    slide = F.struct(
        left(2).alias("titulo"), F.array(left(3), F.lit("linha")).alias("conteudo"), F.array(card).alias("cartoes"),
        F.struct(left(7).alias("alt")).alias("figura"), F.struct(F.array(F.array(F.lit("a"), left(11))).alias("linhas")).alias("tabela"),
    )
    rows = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(slide).alias("slides"))
    scripts = rows.select(F.col("conv_id").alias("deck_id"), F.to_json(F.struct("slides")).alias("json"))
    return trees.missing_markers(scripts)


# Themes by master

_SLOT_NAMES = ("dk1", "lt1", "dk2", "lt2", "accent1")


@query(
    f"""
WITH n AS (SELECT 'm' || (n_nationkey // 5) AS part, {list(_SLOT_NAMES)!r}[n_nationkey % 5 + 1] AS slot, upper(printf('%06x', n_nationkey * 654321 % 16777216)) AS hex FROM nation),
o AS (SELECT o_orderkey AS slide_no, CASE WHEN o_orderkey % 11 <> 0 THEN 'm' || (o_orderkey % 7) END AS master, ['tx1', 'bg1', 'accent1', 'lt2', 'accent6'][o_custkey % 5 + 1] AS alias FROM orders),
s AS (SELECT *, CASE alias WHEN 'tx1' THEN CASE WHEN slide_no % 3 = 0 THEN 'dk2' ELSE 'dk1' END WHEN 'bg1' THEN 'lt1' ELSE alias END AS slot,
  CASE WHEN master IN ('m0', 'm1', 'm2', 'm3') THEN master ELSE 'm4' END AS held FROM o)
SELECT coalesce(master, '-') AS master, alias, s.slot, coalesce(hex, '-') AS hex, count(*) AS n FROM s LEFT JOIN n ON n.part = held AND n.slot = s.slot GROUP BY ALL"""
)
def resolve_master_themes(spark, sf):
    """Nations as the themes of five masters, the last of which is the deck's; orders as slides of eight masters or none."""
    k, key = F.col("n_nationkey"), F.col("o_orderkey")
    part = F.when(k < 20, F.concat(F.lit("m"), F.floor(k / 5).cast("string")))
    slot = F.element_at(F.array(*[F.lit(s) for s in _SLOT_NAMES]), (k % 5 + 1).cast("int"))
    hexes = F.lpad(F.hex((k.cast("long") * 654321) % 16777216), 6, "0")
    schemes = _t(spark, sf, "nation").select(F.lit("d").alias("deck_id"), part.alias("part"), slot.alias("slot"), hexes.alias("hex"))
    alias = F.element_at(F.array(*[F.lit(s) for s in ("tx1", "bg1", "accent1", "lt2", "accent6")]), (F.col("o_custkey") % 5 + 1).cast("int"))
    master = F.when(key % 11 != 0, F.concat(F.lit("m"), (key % 7).cast("string")))
    slides = _t(spark, sf, "orders").select(F.lit("d").alias("deck_id"), key.alias("slide_no"), master.alias("master_part"), alias.alias("alias"))
    own = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(a).alias("alias"), F.lit(s).alias("slot")) for level, a, s in (("master", "tx1", "dk1"), ("master", "bg1", "lt1"))])
    layout = F.when(F.col("slide_no") % 3 == 0, F.array(F.struct(F.lit("layout").alias("level"), F.lit("tx1").alias("alias"), F.lit("dk2").alias("slot"))))
    maps = slides.select("deck_id", "slide_no", F.explode(F.concat(own, F.coalesce(layout, F.slice(own, 1, 0)))).alias("m")).select("deck_id", "slide_no", "m.*")
    found = resolve.theme_colour(slides, maps, resolve.schemes_by_master(schemes, slides))
    return found.groupBy(F.coalesce("master_part", F.lit("-")).alias("master"), "alias", "slot", F.coalesce("hex", F.lit("-")).alias("hex")).agg(F.count("*").alias("n"))


# Scripts as YAML


@query(
    """
WITH d AS (SELECT source AS deck_id, doc_id AS slide_no, string_split(text, chr(10)) AS ls, CASE WHEN doc_id % 3 = 0 THEN lang END AS notes FROM documents),
l AS (SELECT deck_id, slide_no, list_concat(['- tipo: "conteudo"', '  titulo: ' || CAST(to_json(ls[1]) AS VARCHAR)], list_filter([CASE WHEN notes IS NOT NULL THEN '  notas: ' || CAST(to_json(notes) AS VARCHAR) END], lambda x: x IS NOT NULL),
  CASE WHEN len(ls) > 1 THEN list_concat(['  conteudo:'], list_transform(ls[2:], lambda x: '  - ' || CAST(to_json(x) AS VARCHAR))) ELSE ['  conteudo: []'] END) AS ys FROM d WHERE ls IS NOT NULL)
SELECT deck_id, slide_no, CAST(generate_subscripts(ys, 1) - 1 AS INTEGER) AS place, unnest(ys) AS line FROM l
UNION ALL SELECT deck_id, 0, CAST(generate_subscripts(hs, 1) - 1 AS INTEGER), unnest(hs) FROM (SELECT DISTINCT source AS deck_id, ['apresentacao:', '  titulo: ' || CAST(to_json(source) AS VARCHAR), 'slides:'] AS hs FROM documents)"""
)
def script_yaml(spark, sf):
    """Documents as the slides of a source's script, written as YAML."""
    docs = _t(spark, sf, "documents").filter("text is not null")
    lines = F.split("text", "\n")
    slides = docs.select(
        F.col("source").alias("deck_id"), F.col("doc_id").alias("slide_no"), F.lit("conteudo").alias("type"), lines[0].alias("title"),
        F.slice(lines, 2, 1 << 30).alias("content"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("notes"),
    )
    headers = _t(spark, sf, "documents").select(F.col("source").alias("deck_id"), F.col("source").alias("titulo")).distinct()
    return scripts.yaml_lines(headers, slides)


# The same rules in Spark SQL


@query(REGISTRY["e_contrast"][1])
def e_contrast_sql(spark, sf):
    """The contrast rules written in SQL with the library's functions."""
    sql.register(spark)
    sql.register_tables(spark, {"run": A.colour_runs(_t(spark, sf, "part"))})
    return spark.sql(
        """
WITH r AS (SELECT deck_id, slide_no, fg, bg, reason, contrast_ratio(fg, bg) AS ratio, contrast_rule(fg, bg, size, bold) AS rule FROM conforma_run WHERE NOT decorative AND NOT blank_text(text))
SELECT deck_id, rule, if(rule = 'E03', 'D', 'E') AS severity, 'fail' AS verdict, slide_no, round(ratio, 6) AS value FROM r WHERE rule IS NOT NULL
UNION ALL SELECT deck_id, 'E08', 'A', 'fail', slide_no, round(ratio, 6) FROM r WHERE fg = '000000' AND bg = 'FFFFFF'
UNION ALL SELECT deck_id, if(reason RLIKE 'gradient|picture|pattern', 'E09', 'E01'), 'A', 'unverified', slide_no, NULL FROM r WHERE ratio IS NULL"""
    )


_BARE = "regexp_replace(lower(t), '[.:;!? ]+$', '')"


@query(
    f"""
WITH {PARA}, caps AS ({_CAPS}), c AS (SELECT deck_id, count(*) AS n FROM caps GROUP BY 1),
l AS (SELECT deck_id, count(*) FILTER (t = '') AS blank, count(*) FILTER (regexp_matches(t, '^[-*•·]\\s+\\S')) AS bullets, count(*) FILTER (regexp_matches(text, '(?i)^\\s*(https?://|www\\.)')) AS addresses,
  count(*) FILTER ({_BARE} <> '' AND ({_BARE} IN {_in(T.GENERIC_ALT)} OR length({_BARE}) <= 3)) AS generic, count(*) FILTER (list_has_any(regexp_extract_all(lower(text), '[a-zà-ÿ]+'), {list(T.NEEDS_ACCENT)})) AS accents FROM para GROUP BY 1)
SELECT deck_id, blank, coalesce(n, 0) AS capitals, bullets, addresses, generic, accents FROM l LEFT JOIN c USING (deck_id)"""
)
def text_predicates_sql(spark, sf):
    """The text predicates, called from SQL on all lines."""
    sql.register(spark)
    sql.register_tables(spark, {"paragraph": A.paragraphs(_t(spark, sf, "documents"))})
    return spark.sql(
        """
SELECT deck_id, count_if(blank_text(text)) AS blank, count_if(NOT blank_text(text) AND all_caps(text)) AS capitals, count_if(typed_bullet(text)) AS bullets,
  count_if(raw_address(text)) AS addresses, count_if(generic_alt(text)) AS generic, count_if(lacks_accent(text)) AS accents FROM conforma_paragraph GROUP BY deck_id"""
    )


# Reports


@query(
    """
WITH d AS (SELECT CAST(page_id AS VARCHAR) AS deck_id, page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, coalesce(regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1), '') AS lang FROM pages),
f AS (SELECT deck_id, 'A01' AS rule, trim(title) AS detail FROM d WHERE trim(title) = '' OR (page_id % 10 = 0 AND trim(title) = title) UNION ALL SELECT deck_id, 'A02', nullif(lang, '') FROM d WHERE NOT starts_with(lower(trim(lang)), 'en')),
g AS (SELECT deck_id, count(*) AS n, string_agg('{"rule":"' || rule || '","severity":"E","verdict":"fail"' || coalesce(',"detail":' || CAST(to_json(detail) AS VARCHAR), '') || '}', ',' ORDER BY rule) AS fs FROM f GROUP BY 1)
SELECT deck_id, '{"deck_id":"' || deck_id || '","summary":{"errors":' || coalesce(n, 0) || ',"warnings":0,"hints":0,"unverified":0},"evaluated":["A01","A02"]' || coalesce(',"findings":[' || fs || ']', '') || '}' AS json FROM d LEFT JOIN g USING (deck_id)"""
)
def report_json(spark, sf):
    decks = A.page_decks(_t(spark, sf, "pages"))
    found = rules.metadata(decks, "en").filter("rule in ('A01', 'A02')")
    return report.as_json(found, report.evaluated(decks, ["A01", "A02"]))


@query(
    f"""
WITH {_VERSIONS}, {_RES}, n AS (SELECT deck_id, sum(n) FILTER (kind = 'audio') AS a, sum(n) FILTER (kind = 'video') AS w FROM rs GROUP BY 1)
SELECT package_id, CASE WHEN file_ord = 1 THEN 'libras' ELSE 'completo' END AS profile, count(*) AS versions, CAST(sum(coalesce(a, 0)) AS BIGINT) AS audio, CAST(sum(coalesce(w, 0)) AS BIGINT) AS video
FROM v LEFT JOIN n USING (deck_id) GROUP BY ALL"""
)
def package_media(spark, sf):
    c = _t(spark, sf, "conversations")
    return package.media_table(A.versions(c, profiles=True), A.turn_resources(c))


@query(
    """
WITH f AS (SELECT s_suppkey // 2 AS package_id, s_suppkey AS deck_id FROM supplier WHERE s_acctbal > 0), o AS (SELECT package_id, min(deck_id) AS deck_id FROM f GROUP BY 1 HAVING count(*) = 1)
SELECT CAST(package_id AS VARCHAR) AS package_id, CAST(deck_id AS VARCHAR) AS deck_id, unnest(['O01', 'O02']) AS rule, 'unverified' AS verdict FROM o"""
)
def o_single_files(spark, sf):
    """Suppliers in pairs as the files of a package; those without credit are missing."""
    files = _t(spark, sf, "supplier").filter("s_acctbal > 0").select(F.expr("s_suppkey div 2").alias("package_id"), F.col("s_suppkey").alias("deck_id"))
    return package.alone(files).select("package_id", "deck_id", "rule", "verdict")


# Colours and weights that runs inherit

_CHAIN = f"""
c0 AS (SELECT l_orderkey AS slide_no, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS q, l_partkey AS p, l_suppkey AS s, l_orderkey % 3 = 0 AS ph FROM lineitem),
c1 AS (SELECT *, CASE WHEN q % 5 = 0 THEN '110000' WHEN q % 7 = 0 THEN '220000' WHEN p % 6 = 0 THEN '330000' WHEN s % 5 = 0 THEN '440000' WHEN ph AND p % 4 = 0 THEN '550000'
  WHEN ph AND p % 4 = 1 THEN '660000' WHEN ph AND p % 4 = 2 THEN '770000' WHEN s % 2 = 0 THEN '880000' ELSE '1A1A1A' END AS fg,
  CASE WHEN q % 8 = 0 THEN 'EE0000' WHEN q % 9 = 0 THEN NULL WHEN s % 7 = 0 THEN 'DD0000' WHEN slide_no % 5 = 0 THEN 'CC0000' WHEN slide_no % 7 = 0 THEN 'BB0000' WHEN slide_no % 2 = 0 THEN 'AA0000' ELSE 'FAFAFA' END AS bg FROM c0)"""


@query(
    f"""
WITH {_CHAIN} SELECT fg, coalesce(bg, '-') AS bg, q % 3 = 0 AND NOT q % 2 = 0 AS bold, coalesce(CASE WHEN bg IS NULL THEN 'table style' END, '-') AS reason, count(*) AS n FROM c1 GROUP BY ALL"""
)
def resolve_run_colours(spark, sf):
    """Text and background of runs: own, paragraph's, shape's, style's, placeholder's, deck's, theme's; cell's, shape's,
    slide's, layout's, master's, theme's. A table style's fill is no single colour."""
    key = ["deck_id", "slide_no", "shape_ord"]
    q, p, s, order = F.col("l_quantity").cast("long"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    kind = "struct<hex: string, alias: string, mods: array<struct<name: string, val: int>>, reason: string>"

    def colour(when, value: str, field: str = "hex"):
        return F.when(when, F.from_json(F.lit(f'{{"{field}": "{value}"}}'), kind))

    def level(when, value: str):
        return F.when(when, F.struct(F.array(F.lit(None).cast("long")).alias("sz"), F.array(F.lit(None).cast("string")).alias("cap"), F.array(colour(when, value)).alias("colour")))

    item = _t(spark, sf, "lineitem").withColumn("__ord", F.monotonically_increasing_id())
    ids = [F.lit("d").alias("deck_id"), order.alias("slide_no"), F.col("__ord").alias("shape_ord")]
    shapes = item.select(
        *ids, (order % 3 == 0).alias("is_ph"), colour(s % 7 == 0, "DD0000").alias("fill"), colour(s % 5 == 0, "440000").alias("style_colour"), level(p % 6 == 0, "330000").alias("levels"),
        level(p % 4 == 0, "550000").alias("layout_levels"), level(p % 4 == 1, "660000").alias("master_levels"), level(p % 4 == 2, "770000").alias("text_levels"), level(s % 2 == 0, "880000").alias("default_levels"),
    )
    none = F.lit(None)
    runs = item.select(
        *ids, F.lit(0).alias("lvl"), none.cast("long").alias("sz"), none.cast("long").alias("para_sz"), colour(q % 5 == 0, "110000").alias("colour"), colour(q % 7 == 0, "220000").alias("para_colour"),
        F.coalesce(colour(q % 8 == 0, "EE0000"), colour(q % 9 == 0, "table style", "reason")).alias("cell_fill"), F.when(q % 3 == 0, F.when(q % 2 == 0, False).otherwise(True)).alias("bold"),
    )
    orders = item.select(order.alias("slide_no")).distinct()
    n = F.col("slide_no")
    slides = orders.select(F.lit("d").alias("deck_id"), "slide_no", *[colour(n % k == 0, v).alias(f"{c}_bg") for c, k, v in (("slide", 5, "CC0000"), ("layout", 7, "BB0000"), ("master", 2, "AA0000"))])
    palette = orders.select(F.lit("d").alias("deck_id"), "slide_no", F.create_map(F.lit("tx1"), F.lit("1A1A1A"), F.lit("bg1"), F.lit("FAFAFA")).alias("palette"))
    found = audit.resolved_runs(runs, shapes, slides, palette)
    return found.groupBy("fg", F.coalesce("bg", F.lit("-")).alias("bg"), "bold", F.coalesce("reason", F.lit("-")).alias("reason")).agg(F.count("*").alias("n"))


# Texts as slides


@query(
    rf"""
WITH RECURSIVE {PARA}, l AS (SELECT slide_no AS doc_id, para_ord, nullif(trim(regexp_extract(text, '^#{{1,6}}\s+(.+?)\s*#*$', 1)), '') AS h, regexp_replace(t, '^[-*+•]\s+', '') AS t FROM para),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para_ord) AS rn FROM l WHERE h IS NOT NULL OR t <> ''), o AS (SELECT *, h IS NOT NULL OR rn = 1 AS opens FROM k),
b AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY para_ord) AS block FROM o),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, block) AS n, row_number() OVER (PARTITION BY doc_id, block ORDER BY para_ord) - 1 AS pos, first_value(coalesce(h, left(t, 60))) OVER (PARTITION BY doc_id, block ORDER BY para_ord) AS title FROM b),
bl AS MATERIALIZED (SELECT doc_id, CAST(block AS BIGINT) AS block, title, pos, CASE WHEN NOT opens THEN t END AS text FROM n WHERE NOT opens OR n = 1),
cut AS (SELECT doc_id, block, title, pos, 0 AS k, CAST(NULL AS VARCHAR) AS line, text AS rest FROM bl
  UNION ALL SELECT doc_id, block, title, pos, k + 1, CASE WHEN c < 20 THEN rest ELSE trim(left(rest, c + 1)) END, CASE WHEN c < 20 THEN NULL ELSE trim(substr(rest, c + 2)) END FROM (
    SELECT *, CASE WHEN length(rest) <= 80 THEN -1 WHEN contains(head, '. ') AND length(regexp_extract(head, '(?s)^(.*)\. ', 1)) >= 20 THEN length(regexp_extract(head, '(?s)^(.*)\. ', 1))
      WHEN contains(head, ' ') THEN length(regexp_extract(head, '(?s)^(.*) ', 1)) ELSE -1 END AS c FROM (SELECT *, left(rest, 80) AS head FROM cut WHERE rest <> ''))),
ln AS (SELECT doc_id, block, title, pos, k, line FROM cut WHERE k > 0 OR rest IS NULL),
ch AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, block ORDER BY pos, k) - 1) // 6 AS chunk FROM ln),
gr AS (SELECT doc_id, block, title, chunk, list(line ORDER BY pos, k) FILTER (line IS NOT NULL) AS ls, count(*) OVER (PARTITION BY doc_id, block) AS n FROM ch GROUP BY doc_id, block, title, chunk),
sl AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block, chunk) + 1 AS slide_no, CASE WHEN n > 1 THEN title || ' (' || (chunk + 1) || ' de ' || n || ')' ELSE title END AS title, coalesce(ls, ['[FALTA: conteúdo deste slide]']) AS ls
  FROM gr WHERE NOT (block = 1 AND ls IS NULL)
  UNION ALL SELECT doc_id, 1, min(title), ['[FALTA: subtítulo, autor e contexto]'] FROM bl WHERE block = 1 GROUP BY doc_id)
SELECT doc_id, CAST(slide_no AS BIGINT) AS slide_no, title, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS place, unnest(ls) AS line FROM sl"""
)
def import_slide_lines(spark, sf):
    """Documents as text files, cut into slides of six short lines."""
    p = A.paragraphs(_t(spark, sf, "documents"))
    lines = p.select(F.col("slide_no").alias("doc_id"), F.col("para_ord").alias("line_no"), F.col("text").alias("line"))
    slides = transform.import_slides(transform.text_blocks(lines))
    return slides.select("doc_id", "slide_no", "title", F.posexplode("content").alias("place", "line"))
