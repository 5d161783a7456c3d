"""The registered queries: each applies operators to adapters' rows; SQL for the same rows beside it.

All take whole tables. Ratios are rounded to six decimals, so that engines' last digits don't count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grid as G
from ..functions import text as T
from ..operators import design, package, report, rules, transform
from ..sources import adapters as A
from ..sources.adapters import table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None, ints: tuple[str, ...] = ()):
    """ints: integer columns that may be null in sql; -1 stands for null, as in the query itself."""
    if sql and ints:
        sql = f"SELECT * REPLACE ({', '.join(f'coalesce({c}, -1) AS {c}' for c in ints)}) FROM ({sql})"

    def add(f: Query) -> Query:
        REGISTRY[f.__name__] = f, sql
        return f

    return add


def _t(spark, sf, name):
    return table(spark, sf, name)


def _found(df: DataFrame, *columns: str) -> DataFrame:
    """The columns of findings that a query returns: values rounded, -1 for keys that are null."""
    cols = columns or ("deck_id", "rule", "severity", "verdict", "slide_no", "para_ord", "value")
    keys = ("slide_no", "shape_ord", "para_ord")
    return df.select(
        *[
            F.round("value", 6).alias("value")
            if c == "value"
            else F.coalesce(F.col(c), F.lit(-1)).alias(c)
            if c in keys
            else F.col(c)
            for c in cols
        ]
    )


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


# SQL pieces

STRIP = r"regexp_replace(text, '^[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')"
PARA = f"""
para0 AS (SELECT source AS deck_id, doc_id AS slide_no, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
para1 AS (SELECT deck_id, slide_no, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS para_ord FROM para0),
para AS (SELECT *, {STRIP} AS t FROM para1)"""
SHAPES = f"""
shp AS (SELECT 'd' || (l_orderkey % 97) AS deck_id, l_orderkey AS slide_no,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS shape_ord,
  CASE WHEN l_partkey % 3 = 0 THEN 'pic' ELSE 'sp' END AS tag,
  'Shape ' || (l_suppkey % 5) AS name, l_suppkey % 6 = 0 AS decorative, l_linenumber = 1 AS titled,
  ((l_partkey * 7919) % 10000) * 1000 AS x, ((l_suppkey * 6101 + l_partkey) % 6000) * 1000 AS y,
  CAST(l_quantity AS BIGINT) * 120000 + 100000 AS cx, (l_partkey % 40) * 100000 + 150000 AS cy,
  CAST(l_quantity AS BIGINT) % 10 AS n_children, CASE WHEN l_returnflag = 'R' THEN 'Totals of the year' ELSE '' END AS alt,
  l_linestatus = 'O' AS has_link, l_returnflag, l_linestatus, l_tax, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
lay AS (SELECT DISTINCT deck_id, slide_no, ['Conteudo', 'Capa', 'Conteudo libras'][(slide_no % 3) + 1] AS layout FROM shp),
useful AS (SELECT * FROM shp WHERE NOT decorative)"""


def _shapes(spark, sf):
    return A.shapes(_t(spark, sf, "lineitem"))


# A, B


@query(
    """
WITH d AS (SELECT CAST(page_id AS VARCHAR) AS deck_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url,
  trim(CASE WHEN contains(html, 'class="ad"') THEN ' User ' ELSE regexp_extract(html, '<a href="[^"]*">([^<]*)</a>', 1) END) AS author,
  coalesce(regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1), '') AS lang, page_id FROM pages),
e AS (SELECT *, CASE WHEN page_id % 10 = 0 THEN title ELSE 'deck ' || page_id END AS stem FROM d)
SELECT deck_id, 'A01' AS rule, 'E' AS severity FROM e WHERE trim(title) = '' OR lower(trim(title)) = lower(stem)
UNION ALL SELECT deck_id, 'A02', 'E' FROM e WHERE NOT starts_with(lower(trim(lang)), 'en')
UNION ALL SELECT deck_id, 'A04', 'A' FROM e WHERE lower(author) IN ('', 'user')
UNION ALL SELECT deck_id, 'A05', 'A' FROM e WHERE regexp_matches(trim(stem), '(?i)^(apresenta[cç][aã]o|presentation|slide|deck|documento)\\s*\\d*$')
UNION ALL SELECT deck_id, 'A06', 'D' FROM e WHERE length(url) % 8 > 0 AND abs(CAST(length(title) * 4 AS DOUBLE) / CAST(length(url) % 8 * 9 AS DOUBLE) - 16e0 / 9e0) > 2e-2"""
)
def a_metadata(spark, sf):
    return _found(rules.metadata(A.page_decks(_t(spark, sf, "pages")), "en"), "deck_id", "rule", "severity")


@query(
    f"""
WITH {PARA}, ttl AS (SELECT deck_id, slide_no, t FROM para WHERE para_ord = 0)
SELECT deck_id, 'B02' AS rule, slide_no, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS detail FROM ttl WHERE t = ''
UNION ALL SELECT deck_id, 'B03', min(slide_no), CAST(count(*) AS DOUBLE), lower(t) FROM ttl WHERE t <> '' GROUP BY deck_id, lower(t) HAVING count(*) > 1"""
)
def b_titles(spark, sf):
    docs = _t(spark, sf, "documents")
    found = rules.titles(A.document_slides(docs), A.title_shapes(docs))
    return _found(found, "deck_id", "rule", "slide_no", "value", "detail")


@query(
    """
WITH l AS (SELECT page_id AS slide_no, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS ts FROM pages),
u AS (SELECT slide_no, unnest(ts) AS t, generate_subscripts(ts, 1) - 1 AS para_ord FROM l)
SELECT 'site' AS deck_id, 'B09' AS rule, slide_no, CAST(para_ord AS INTEGER) AS para_ord FROM u WHERE regexp_matches('- ' || t, '^[-*•·]\\s+\\S') AND length(t) % 3 <> 0"""
)
def b_typed_bullets(spark, sf):
    found = rules.typed_bullets(A.page_items(_t(spark, sf, "pages")))
    return _found(found, "deck_id", "rule", "slide_no", "para_ord")


# C, D

_RANKS = """
rk AS (SELECT *, row_number() OVER (PARTITION BY deck_id, slide_no ORDER BY shape_ord) AS rt,
  row_number() OVER (PARTITION BY deck_id, slide_no ORDER BY y // 571500, x, shape_ord) AS rr,
  row_number() OVER (PARTITION BY deck_id, slide_no ORDER BY x, y, shape_ord) AS rc FROM useful),
rg AS (SELECT deck_id, slide_no, count(*) AS n, bool_or(rt <> rr) AS off_row, bool_or(rt <> rc) AS off_col,
  count(DISTINCT x) AS lefts FROM rk GROUP BY deck_id, slide_no)"""


@query(
    f"""
WITH {SHAPES}, {_RANKS}
SELECT deck_id, 'C02' AS rule, slide_no, CAST(n AS DOUBLE) AS value FROM rg WHERE n > 1 AND off_row AND NOT (NOT off_col AND lefts >= 2)"""
)
def c_reading_order(spark, sf):
    s = _shapes(spark, sf)
    return _found(rules.reading_order(s, A.shape_decks(s)), "deck_id", "rule", "slide_no", "value")


@query(
    f"""
WITH {SHAPES}, f AS (SELECT deck_id, slide_no, arg_min(titled, shape_ord) AS first_titled, bool_or(titled) AS has, min(shape_ord) AS o FROM useful GROUP BY ALL)
SELECT deck_id, 'C01' AS rule, slide_no, CAST(o AS INTEGER) AS shape_ord FROM f WHERE has AND NOT first_titled"""
)
def c_title_first(spark, sf):
    return _found(rules.title_first(_shapes(spark, sf)), "deck_id", "rule", "slide_no", "shape_ord")


@query(
    f"""
WITH {SHAPES}
SELECT deck_id, 'C04' AS rule, slide_no, CAST(shape_ord AS INTEGER) AS shape_ord FROM shp WHERE NOT decorative AND n_children > 5 AND alt = ''
UNION ALL SELECT deck_id, 'C05', slide_no, CAST(shape_ord AS INTEGER) FROM shp WHERE regexp_matches(trim(name), '(?i)^shape\\s*\\d+$')
UNION ALL SELECT deck_id, 'C06', slide_no, CAST(shape_ord AS INTEGER) FROM shp WHERE NOT decorative AND NOT titled
  AND (x + cx <= 0 OR y + cy <= 0 OR x >= {G.WIDTH} OR y >= {G.HEIGHT})"""
)
def c_objects(spark, sf):
    s = _shapes(spark, sf)
    return _found(rules.objects(s, A.shape_decks(s)), "deck_id", "rule", "slide_no", "shape_ord")


@query(
    f"""
WITH {PARA}, a AS (SELECT deck_id, slide_no, para_ord AS o, text, t, para_ord % 7 = 6 AS dec,
  regexp_replace(lower(t), '[.:;!? ]+$', '') AS bare FROM para),
h AS (SELECT *, CASE WHEN dec AND t <> '' THEN ['D11E'] WHEN dec THEN [] WHEN text = '' THEN ['D01E'] WHEN t = '' THEN ['D02E']
 ELSE list_filter([
  CASE WHEN regexp_matches(text, '(?i)\\.(png|jpe?g|gif|bmp|svg|emf|wmf|tiff?|webp|pdf|mp4|mp3|wav)\\s*$') OR (bare <> '' AND (bare IN {_in(T.GENERIC_ALT)} OR length(bare) <= 3)) THEN 'D03E' END,
  CASE WHEN regexp_matches(text, '(?i)^\\s*(uma?\\s+)?(imagem|foto(grafia)?|figura|gr[aá]fico|ilustra[cç][aã]o|captura de tela|screenshot|picture|image|photo|chart)\\s+(de|do|da|dos|das|que|com|showing|of)([^\\pL\\pN_]|$)') THEN 'D04A' END,
  CASE WHEN regexp_matches(text, '(?i)(descri[cç][aã]o gerada automaticamente|generated by ai|conte[uú]do gerado por ia|ai[- ]generated|automatically generated)') THEN 'D05E' END,
  CASE WHEN length(text) > 150 THEN 'D06A' END,
  CASE WHEN list_has_any(regexp_extract_all(lower(text), '[a-zà-ÿ]+'), {list(T.NEEDS_ACCENT)}) THEN 'D08A' END], lambda x: x IS NOT NULL) END AS hits FROM a),
u AS (SELECT deck_id, slide_no, o, text, unnest(hits) AS hit FROM h)
SELECT deck_id, left(hit, 3) AS rule, right(hit, 1) AS severity, slide_no, CAST(o AS INTEGER) AS shape_ord, CAST(length(text) AS DOUBLE) AS value FROM u"""
)
def d_alt_text(spark, sf):
    docs = _t(spark, sf, "documents")
    slides = A.document_slides(docs).withColumn("notes", F.lit("x"))
    return _found(rules.alt_text(A.alt_shapes(docs), slides), "deck_id", "rule", "severity", "slide_no", "shape_ord", "value")


# E


def _channel(c: str, i: int) -> str:
    x = f"(('0x' || substr({c}, {1 + 2 * i}, 2))::INT / 255.0)"
    return f"CASE WHEN {x} <= 0.03928 THEN {x} / 12.92 ELSE pow(({x} + 0.055) / 1.055, 2.4) END"


def _lum(c: str) -> str:
    return f"(0.2126 * ({_channel(c, 0)}) + 0.7152 * ({_channel(c, 1)}) + 0.0722 * ({_channel(c, 2)}))"


@query(
    f"""
WITH r AS (SELECT p_brand AS deck_id, p_partkey AS slide_no, p_name,
  CASE WHEN p_partkey % 50 = 0 THEN '000000' ELSE upper(printf('%06x', (p_partkey * 7654321) % 16777216)) END AS fg,
  CASE WHEN p_partkey % 25 = 0 THEN 'FFFFFF' WHEN p_partkey % 31 <> 0 THEN upper(printf('%06x', (p_partkey * 1234567 + 99) % 16777216)) END AS bg,
  CASE WHEN p_partkey % 31 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'g' ELSE 'n' END END AS reason,
  p_size * 60 >= 1800 OR (p_partkey % 3 = 0 AND p_size * 60 >= 1400) AS big FROM part WHERE trim(p_name) <> ''),
l AS (SELECT *, {_lum("fg")} AS a, CASE WHEN bg IS NOT NULL THEN {_lum("bg")} END AS b FROM r),
q AS (SELECT *, (greatest(a, b) + 0.05) / (least(a, b) + 0.05) AS ratio FROM l WHERE bg IS NOT NULL),
k AS (SELECT *, CASE WHEN ratio + 0.005 < CASE WHEN big THEN 3.0 ELSE 4.5 END THEN CASE WHEN big THEN 'E02' ELSE 'E01' END
  WHEN NOT big AND ratio < 7.0 THEN 'E03' END AS rule FROM q)
SELECT deck_id, rule, CASE WHEN rule = 'E03' THEN 'D' ELSE 'E' END AS severity, 'fail' AS verdict, slide_no, round(ratio, 6) AS value FROM k WHERE rule IS NOT NULL
UNION ALL SELECT deck_id, 'E08', 'A', 'fail', slide_no, round(ratio, 6) FROM q WHERE fg = '000000' AND bg = 'FFFFFF'
UNION ALL SELECT deck_id, CASE WHEN reason = 'g' THEN 'E09' ELSE 'E01' END, 'A', 'unverified', slide_no, NULL FROM r WHERE bg IS NULL"""
)
def e_contrast(spark, sf):
    found = rules.contrast(A.colour_runs(_t(spark, sf, "part")))
    return _found(found, "deck_id", "rule", "severity", "verdict", "slide_no", "value")


# F

_LONG = f"""
SELECT deck_id, 'F07' AS rule, slide_no, CAST(NULL AS INTEGER) AS para_ord, CAST(count(*) AS DOUBLE) AS value FROM para
  WHERE t <> '' AND para_ord > 0 GROUP BY deck_id, slide_no HAVING count(*) > {rules.PARAGRAPHS_MOST}
UNION ALL SELECT deck_id, 'F07', slide_no, CAST(para_ord AS INTEGER), CAST(length(t) AS DOUBLE) FROM para WHERE length(t) > {rules.LINE_MOST}"""
_CAPS = """
SELECT deck_id, 'F06' AS rule, slide_no, CAST(para_ord AS INTEGER) AS para_ord, CAST(NULL AS DOUBLE) AS value
FROM (SELECT *, regexp_extract_all(t, '[A-Za-zÀ-ÿ]{2,}') AS ws FROM para)
WHERE len(ws) >= 3 AND len(list_filter(ws, lambda w: w = upper(w) AND w <> lower(w) AND NOT contains(w, 'ß'))) = len(ws)"""


@query(f"WITH {PARA} {_LONG}", ints=('para_ord',))
def f_long_lines(spark, sf):
    found = rules.crowded(A.paragraphs(_t(spark, sf, "documents")))
    return _found(found, "deck_id", "rule", "slide_no", "para_ord", "value")


@query(f"WITH {PARA} {_CAPS}", ints=('para_ord',))
def f_capitals(spark, sf):
    found = rules.shouted(A.paragraphs(_t(spark, sf, "documents")))
    return _found(found, "deck_id", "rule", "slide_no", "para_ord", "value")


@query(
    f"""
WITH {PARA}, w AS (SELECT deck_id, slide_no, para_ord, text, regexp_extract_all(text, '[\\pL\\pN_]+') AS ws FROM para),
a AS (SELECT deck_id, slide_no, para_ord, text, list_filter(ws, lambda x: regexp_full_match(x, '[A-ZÀ-Ý][A-ZÀ-Ý0-9]{{2,7}}')) AS acs FROM w),
u AS (SELECT deck_id, slide_no, para_ord, text, unnest(acs) AS acronym, generate_subscripts(acs, 1) AS k FROM a),
f AS (SELECT *, row_number() OVER (PARTITION BY deck_id, acronym ORDER BY slide_no, para_ord, k) AS rn FROM u),
s AS (SELECT DISTINCT deck_id, unnest(list_concat(regexp_extract_all(text, '\\(([A-ZÀ-Ý][A-ZÀ-Ý0-9]{{2,7}})\\)', 1), list_concat(
  regexp_extract_all(text, '(?:^|[^\\pL\\pN_])([A-ZÀ-Ý][A-ZÀ-Ý0-9]{{2,7}})\\s*\\([^)]{{4,}}\\)', 1),
  regexp_extract_all(text, '(?:^|[^\\pL\\pN_])([A-ZÀ-Ý][A-ZÀ-Ý0-9]{{2,7}})\\s*[:—-]\\s*[\\pL\\pN_]{{4,}}', 1)))) AS acronym FROM para)
SELECT deck_id, 'F10' AS rule, slide_no, CAST(para_ord AS INTEGER) AS para_ord, acronym AS detail FROM f
WHERE rn = 1 AND acronym NOT IN {_in((*T.KNOWN_ACRONYMS, *T.EMPHASIS_WORDS))} AND NOT regexp_full_match(acronym, '[A-ZÀ-Ý][0-9]{{2}}')
  AND NOT regexp_matches(text, '[a-z]-' || acronym) AND NOT regexp_matches(text, acronym || '[.][a-z]{{2,4}}([^a-zA-Z0-9_]|$)')
  AND NOT EXISTS (SELECT 1 FROM s WHERE s.deck_id = f.deck_id AND s.acronym = f.acronym)"""
)
def f_acronyms(spark, sf):
    found = rules.unexplained_acronyms(A.paragraphs(_t(spark, sf, "documents")))
    return _found(found, "deck_id", "rule", "slide_no", "para_ord", "detail")


# G, H, I, L

_CELLS = f"""
{SHAPES}, c0 AS (SELECT deck_id, slide_no, shape_ord AS ri, [CASE WHEN decorative THEN '' ELSE CAST(x AS VARCHAR) END,
  CASE WHEN slide_no % 11 = 0 THEN ' ' ELSE CAST(y AS VARCHAR) END, CASE WHEN decorative THEN '' ELSE 'x' END] AS ts FROM shp),
cl AS (SELECT deck_id, slide_no, ri, unnest(ts) AS text, generate_subscripts(ts, 1) - 1 AS ci FROM c0)"""


@query(
    f"""
WITH {_CELLS}, tb AS (SELECT DISTINCT deck_id, slide_no FROM shp),
gr AS (SELECT deck_id, slide_no FROM cl GROUP BY deck_id, slide_no, ri HAVING bool_and(trim(text) = '')),
gc AS (SELECT deck_id, slide_no FROM cl GROUP BY deck_id, slide_no, ci HAVING bool_and(trim(text) = ''))
SELECT deck_id, 'G01' AS rule, slide_no, CAST(NULL AS DOUBLE) AS value FROM tb WHERE slide_no % 5 = 0
UNION ALL SELECT deck_id, 'G03', slide_no, CAST(count(*) AS DOUBLE) FROM cl WHERE slide_no % 13 = 0 AND ci = 0 GROUP BY deck_id, slide_no
UNION ALL SELECT deck_id, 'G04', slide_no, CAST(count(*) AS DOUBLE) FROM (SELECT * FROM gr UNION ALL SELECT * FROM gc) GROUP BY deck_id, slide_no
UNION ALL SELECT deck_id, 'G05', slide_no, NULL FROM tb WHERE slide_no % 4 = 0"""
)
def g_tables(spark, sf):
    cells = A.cells(_t(spark, sf, "lineitem"))
    return _found(rules.tables(A.cell_tables(cells), cells), "deck_id", "rule", "slide_no", "value")


@query(
    f"""
WITH a AS (SELECT page_id AS slide_no, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>')) AS a FROM pages),
l AS (SELECT slide_no, regexp_extract(a, '<a href="([^"]*)">', 1) AS target, trim(regexp_extract(a, '>([^<]*)</a>', 1)) AS text FROM a)
SELECT 'site' AS deck_id, 'H01' AS rule, slide_no, CAST(NULL AS DOUBLE) AS value, text AS detail FROM l WHERE regexp_matches(text, '(?i)^\\s*(https?://|www\\.)')
UNION ALL SELECT 'site', 'H02', slide_no, NULL, text FROM l WHERE trim(lower(text), ' .:;!?') IN {_in(T.VAGUE_LINK)}
UNION ALL SELECT 'site', 'H03', NULL, CAST(count(DISTINCT target) AS DOUBLE), lower(text) FROM l WHERE text <> '' GROUP BY lower(text) HAVING count(DISTINCT target) > 1""",
    ints=('slide_no',),
)
def h_links(spark, sf):
    found = rules.links(A.page_links(_t(spark, sf, "pages")))
    return _found(found, "deck_id", "rule", "slide_no", "value", "detail")


@query(
    f"""
WITH {SHAPES} SELECT deck_id, 'I07' AS rule, slide_no, CAST(shape_ord AS INTEGER) AS shape_ord, CAST(least(cx, cy) AS DOUBLE) AS value
FROM shp WHERE has_link AND (cx < {G.TARGET_LEAST} OR cy < {G.TARGET_LEAST})"""
)
def i_small_targets(spark, sf):
    s = _shapes(spark, sf)
    slides = A.shape_slides(s).withColumn("transition_children", F.array(F.lit("fade")))
    found = rules.media(slides, s, A.shape_decks(s)).filter("rule = 'I07'")
    return _found(found, "deck_id", "rule", "slide_no", "shape_ord", "value")


_TAGS = """
tg0 AS (SELECT page_id, CAST(page_id AS VARCHAR) AS deck_id, regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1) AS ts FROM pages),
tg1 AS (SELECT deck_id, unnest(ts) AS k, generate_subscripts(ts, 1) - 1 AS ord FROM tg0),
tg AS (SELECT deck_id, ord, CASE WHEN upper(k) = 'LI' THEN 'TH' ELSE upper(k) END AS type, ord % 2 = 0 AS has_a FROM tg1)"""


@query(
    f"""
WITH {_TAGS}, n AS (SELECT deck_id, type, count(*) AS n FROM tg GROUP BY ALL),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY deck_id ORDER BY n DESC, type) AS INTEGER) AS place FROM n)
SELECT * FROM p WHERE place <= 12"""
)
def l_tag_histogram(spark, sf):
    return rules.tag_histogram(A.page_tags(_t(spark, sf, "pages")))


@query(
    f"""
WITH {_TAGS}, f AS (SELECT page_id, CAST(page_id AS VARCHAR) AS deck_id, coalesce(regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1), '') AS lang,
  CASE WHEN page_id % 7 = 0 THEN '' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title FROM pages), g AS (SELECT * FROM f WHERE page_id % 9 <> 0)
SELECT deck_id, 'L01' AS rule, 'fail' AS verdict, CAST(NULL AS DOUBLE) AS value FROM f WHERE page_id % 9 = 0
UNION ALL SELECT deck_id, 'L02', 'fail', NULL FROM g WHERE NOT starts_with(lower(trim(lang)), 'en')
UNION ALL SELECT deck_id, 'L03', 'fail', NULL FROM g WHERE trim(title) = ''
UNION ALL SELECT deck_id, 'L03', 'fail', NULL FROM g WHERE page_id % 3 = 0
UNION ALL SELECT deck_id, 'L04', 'fail', NULL FROM g WHERE deck_id NOT IN (SELECT deck_id FROM tg WHERE type IN {_in(rules.HEADING_TAGS)})
UNION ALL SELECT deck_id, 'L05', 'fail', CAST(count(*) AS DOUBLE) FROM tg WHERE type = 'TH' AND NOT has_a AND deck_id IN (SELECT deck_id FROM g) GROUP BY deck_id
UNION ALL SELECT deck_id, 'L06', 'unverified', NULL FROM f"""
)
def l_export(spark, sf):
    pages = _t(spark, sf, "pages")
    return _found(rules.pdf(A.page_files(pages), A.page_tags(pages), "en"), "deck_id", "rule", "verdict", "value")


# N


@query(
    f"""
WITH {SHAPES}, m AS (SELECT *, CASE WHEN y + cy > {G.FOOTER_Y + G.TOLERANCE} THEN 'footer'
  WHEN x < {G.MARGIN - G.TOLERANCE} OR y < {G.MARGIN - G.TOLERANCE} OR x + cx > {G.WIDTH - G.MARGIN + G.TOLERANCE} THEN 'margin' END AS detail FROM useful)
SELECT deck_id, 'N02' AS rule, slide_no, CAST(shape_ord AS INTEGER) AS shape_ord, CAST(y + cy AS DOUBLE) AS value, detail FROM m WHERE detail IS NOT NULL"""
)
def n_safe_area(spark, sf):
    return _found(design.outside(_shapes(spark, sf)), "deck_id", "rule", "slide_no", "shape_ord", "value", "detail")


@query(
    f"""
WITH {SHAPES}, p AS (SELECT a.deck_id, a.slide_no, a.shape_ord, b.shape_ord AS other, least(a.cx * a.cy, b.cx * b.cy) AS s,
  greatest(0, least(a.x + a.cx, b.x + b.cx) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.cy, b.y + b.cy) - greatest(a.y, b.y)) AS i
  FROM useful a JOIN useful b ON a.deck_id = b.deck_id AND a.slide_no = b.slide_no AND a.shape_ord < b.shape_ord
  AND a.x + {G.TOLERANCE} < b.x + b.cx AND b.x + {G.TOLERANCE} < a.x + a.cx AND a.y + {G.TOLERANCE} < b.y + b.cy AND b.y + {G.TOLERANCE} < a.y + a.cy)
SELECT deck_id, 'N03' AS rule, slide_no, CAST(shape_ord AS INTEGER) AS shape_ord, round(CAST(i AS DOUBLE) / CAST(s AS DOUBLE), 6) AS value, CAST(other AS VARCHAR) AS detail
FROM p WHERE s > 0 AND CAST(i AS DOUBLE) / CAST(s AS DOUBLE) > 0.10"""
)
def n_overlaps(spark, sf):
    return _found(design.overlapping(_shapes(spark, sf)), "deck_id", "rule", "slide_no", "shape_ord", "value", "detail")


@query(
    f"""
WITH {SHAPES}, {_RANKS},
b0 AS (SELECT *, max(x + cx) OVER (PARTITION BY deck_id, slide_no ORDER BY x, cx, shape_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM useful WHERE NOT titled),
b1 AS (SELECT deck_id, slide_no, sum(CASE WHEN reach IS NULL OR x >= reach - {G.TOLERANCE} THEN 1 ELSE 0 END) AS bands FROM b0 GROUP BY ALL),
tt AS (SELECT deck_id, slide_no, arg_min(rr, shape_ord) FILTER (titled) AS t_rr, arg_min(shape_ord, rr) AS top FROM rk GROUP BY ALL)
SELECT rg.deck_id, 'N04' AS rule, rg.slide_no, CASE WHEN t_rr > 1 THEN CAST(top AS INTEGER) END AS shape_ord, CAST(n AS DOUBLE) AS value,
  CASE WHEN t_rr > 1 THEN 'above title' ELSE 'order' END AS detail
FROM rg LEFT JOIN b1 USING (deck_id, slide_no) LEFT JOIN tt USING (deck_id, slide_no)
WHERE n > 1 AND off_row AND NOT (NOT off_col AND coalesce(bands, 0) >= 2)""",
    ints=('shape_ord',),
)
def n_visual_order(spark, sf):
    return _found(design.visual_order(_shapes(spark, sf)), "deck_id", "rule", "slide_no", "shape_ord", "value", "detail")


@query(
    f"""
WITH {SHAPES}, b AS (SELECT deck_id, slide_no, min(x) AS x0, greatest({G.CONTENT_Y}, min(y)) AS y0, max(x + cx) AS x1, max(y + cy) AS y1 FROM useful WHERE NOT titled GROUP BY ALL),
s AS (SELECT b.deck_id, b.slide_no, 1 - CAST((x1 - x0) * (y1 - y0) AS DOUBLE) / CAST(CASE WHEN contains(lower(layout), 'libras') THEN {G.columns_width(8)} ELSE {G.WIDTH - 2 * G.MARGIN} END * {G.FOOTER_Y - G.CONTENT_Y}::BIGINT AS DOUBLE) AS share
  FROM b JOIN lay USING (deck_id, slide_no) WHERE lower(layout) NOT IN {_in(G.BREATHING_LAYOUTS)})
SELECT deck_id, 'N05' AS rule, slide_no, round(share, 6) AS value FROM s WHERE share > {G.IDLE_MOST}"""
)
def n_idle_area(spark, sf):
    s = _shapes(spark, sf)
    return _found(design.idle(s, A.shape_slides(s)), "deck_id", "rule", "slide_no", "value")


@query(
    f"""
WITH {SHAPES}, d AS (SELECT DISTINCT deck_id, slide_no, x FROM useful), g AS (SELECT *, lead(x) OVER (PARTITION BY deck_id, slide_no ORDER BY x) - x AS gap FROM d)
SELECT deck_id, 'N06' AS rule, slide_no, CAST(arg_min(gap, x) AS DOUBLE) AS value, CAST(min(x) AS VARCHAR) AS detail FROM g WHERE gap BETWEEN 1 AND {3 * G.TOLERANCE} GROUP BY deck_id, slide_no"""
)
def n_near_edges(spark, sf):
    return _found(design.near_edges(_shapes(spark, sf)), "deck_id", "rule", "slide_no", "value", "detail")


@query(
    f"""
WITH {SHAPES} SELECT deck_id, 'N07' AS rule, CAST(count(DISTINCT round_even(y / 360000.0, 1)) AS DOUBLE) AS value, layout AS detail
FROM shp JOIN lay USING (deck_id, slide_no) WHERE titled GROUP BY deck_id, layout HAVING count(DISTINCT round_even(y / 360000.0, 1)) > 1"""
)
def n_title_heights(spark, sf):
    s = _shapes(spark, sf)
    return _found(design.title_heights(s, A.shape_slides(s)), "deck_id", "rule", "value", "detail")


@query(
    f"""
WITH {SHAPES} SELECT deck_id, 'N10' AS rule, slide_no, CAST(shape_ord AS INTEGER) AS shape_ord, CAST(least(cx, cy) AS DOUBLE) AS value
FROM useful WHERE tag = 'pic' AND least(cx, cy) < {G.FIGURE_LEAST}"""
)
def n_small_figures(spark, sf):
    return _found(design.small_figures(_shapes(spark, sf)), "deck_id", "rule", "slide_no", "shape_ord", "value")


@query(
    """
WITH t AS (SELECT o_custkey, count(*) AS total FROM orders GROUP BY 1), f AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)
SELECT 'c' || o_custkey AS deck_id, 'N11' AS rule, CAST(n AS DOUBLE) AS value, o_orderstatus AS detail FROM f JOIN t USING (o_custkey) WHERE total >= 4 AND n >= greatest(4, floor(total * 0.6))"""
)
def n_furniture(spark, sf):
    """A customer's orders as slides that all carry one shape, named by the status."""
    orders = _t(spark, sf, "orders")
    boxes = {c: F.lit(1) for c in ("x", "y", "cx", "cy")} | {"depth": F.lit(0), "decorative": F.lit(True), "hidden": F.lit(False)}
    slides = orders.select(F.concat(F.lit("c"), "o_custkey").alias("deck_id"), F.col("o_orderkey").alias("slide_no"), F.col("o_orderstatus").alias("name"))
    return _found(design.furniture(slides.withColumns(boxes), slides), "deck_id", "rule", "value", "detail")


# O

_VERSIONS = """
v AS (SELECT conv_id // 2 AS package_id, conv_id % 2 AS file_ord, conv_id AS deck_id, count(*) AS slides, CASE WHEN conv_id % 3 = 0 THEN 'Libras' ELSE 'Aula' END AS title FROM conversations GROUP BY conv_id),
pr AS (SELECT b.package_id, a.deck_id AS base_id, b.deck_id, a.slides AS base_slides, b.slides FROM v a JOIN v b ON a.package_id = b.package_id AND a.file_ord = 0 AND b.file_ord = 1),
tx0 AS (SELECT conv_id AS deck_id, turn AS slide_no, min(text) AS text FROM conversations GROUP BY ALL)"""


@query(
    f"""
WITH {_VERSIONS}, tx AS (SELECT deck_id, slide_no, string_split(text, ' ')[1:CASE WHEN deck_id % 2 = 1 AND slide_no % 3 = 0 THEN 4 ELSE 5 END] AS ts FROM tx0),
j AS (SELECT pr.package_id, pr.deck_id, a.slide_no, b.ts AS bt, a.ts AS t FROM pr JOIN tx a ON a.deck_id = pr.deck_id JOIN tx b ON b.deck_id = pr.base_id AND b.slide_no = a.slide_no WHERE pr.slides = pr.base_slides),
d AS (SELECT *, list_filter(bt, lambda x: NOT list_contains(t, x)) AS lost, list_filter(t, lambda x: NOT list_contains(bt, x)) AS extra FROM j WHERE t <> bt)
SELECT CAST(package_id AS VARCHAR) AS package_id, CAST(deck_id AS VARCHAR) AS deck_id, 'O01' AS rule, slide_no, CAST(len(lost) + len(extra) AS DOUBLE) AS value FROM d
UNION ALL SELECT CAST(package_id AS VARCHAR), CAST(deck_id AS VARCHAR), 'O01', NULL, CAST(slides - base_slides AS DOUBLE) FROM pr WHERE slides <> base_slides""",
    ints=('slide_no',),
)
def o_text_parity(spark, sf):
    c = _t(spark, sf, "conversations")
    found = package.text_parity(A.versions(c), A.turn_texts(c))
    return _found(found, "package_id", "deck_id", "rule", "slide_no", "value")


_RES = """
rs AS (SELECT conv_id AS deck_id, turn AS slide_no, CASE length(text) % 3 WHEN 0 THEN 'audio' WHEN 1 THEN 'video' ELSE 'figure' END AS kind, count(*) AS n FROM conversations GROUP BY ALL)"""


@query(
    f"""
WITH {_VERSIONS}, {_RES}, e AS (SELECT * FROM pr WHERE slides = base_slides),
a AS (SELECT e.package_id, e.base_id, e.deck_id, slide_no, kind, n FROM e JOIN rs ON rs.deck_id = e.deck_id),
b AS (SELECT e.package_id, e.base_id, e.deck_id, slide_no, kind, n AS m FROM e JOIN rs ON rs.deck_id = e.base_id),
f AS (SELECT package_id, deck_id, slide_no, kind, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM a FULL JOIN b USING (package_id, base_id, deck_id, slide_no, kind))
SELECT CAST(package_id AS VARCHAR) AS package_id, CAST(deck_id AS VARCHAR) AS deck_id, 'O02' AS rule, slide_no, CAST(n - m AS DOUBLE) AS value, kind AS detail FROM f WHERE n <> m"""
)
def o_resource_parity(spark, sf):
    c = _t(spark, sf, "conversations")
    found = package.resource_parity(A.versions(c), A.turn_resources(c))
    return _found(found, "package_id", "deck_id", "rule", "slide_no", "value", "detail")


@query(
    f"""
WITH {_VERSIONS}, ky AS (SELECT deck_id, slide_no, lower(string_split(text, ' ')[1]) AS k FROM tx0 WHERE slide_no % 4 <> 3 AND text <> ''),
kk AS (SELECT * FROM ky WHERE k <> ''), ot AS (SELECT package_id, base_id, deck_id FROM pr WHERE base_id IN (SELECT deck_id FROM kk)),
l AS (SELECT package_id, ot.deck_id, slide_no, k, 'O04' AS rule FROM ot JOIN kk ON kk.deck_id = ot.base_id WHERE NOT EXISTS (SELECT 1 FROM kk z WHERE z.deck_id = ot.deck_id AND z.k = kk.k)
  UNION ALL SELECT package_id, ot.deck_id, slide_no, k, 'O05' FROM ot JOIN kk ON kk.deck_id = ot.deck_id WHERE NOT EXISTS (SELECT 1 FROM kk z WHERE z.deck_id = ot.base_id AND z.k = kk.k)),
r AS (SELECT *, row_number() OVER (PARTITION BY rule, package_id, deck_id ORDER BY slide_no, k) AS rn FROM l)
SELECT CAST(package_id AS VARCHAR) AS package_id, CAST(deck_id AS VARCHAR) AS deck_id, rule, 'fail' AS verdict, slide_no, k AS detail FROM r WHERE rn <= 6
UNION ALL SELECT DISTINCT CAST(package_id AS VARCHAR), CAST(NULL AS VARCHAR), 'O04', 'unverified', CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM pr WHERE base_id NOT IN (SELECT deck_id FROM kk)""",
    ints=('slide_no',),
)
def o_key_parity(spark, sf):
    c = _t(spark, sf, "conversations")
    found = package.key_parity(A.versions(c, profiles=True), A.turn_keys(c))
    return _found(found, "package_id", "deck_id", "rule", "verdict", "slide_no", "detail")


@query(
    f"""
WITH {_VERSIONS}, {_RES}, n AS (SELECT deck_id, sum(n) FILTER (kind = 'audio') AS a, sum(n) FILTER (kind = 'video') AS w FROM rs GROUP BY 1),
q AS (SELECT v.*, coalesce(a, 0) AS a, coalesce(w, 0) AS w, file_ord = 1 AS sign FROM v LEFT JOIN n USING (deck_id))
SELECT CAST(package_id AS VARCHAR) AS package_id, CAST(deck_id AS VARCHAR) AS deck_id, 'O06' AS rule, CAST(NULL AS DOUBLE) AS value, 'libras' AS detail FROM q WHERE sign AND NOT contains(lower(title), 'libras')
UNION ALL SELECT CAST(package_id AS VARCHAR), CAST(deck_id AS VARCHAR), 'O07', CAST(a AS DOUBLE), 'audio' FROM q WHERE (a > 0) = sign
UNION ALL SELECT CAST(package_id AS VARCHAR), CAST(deck_id AS VARCHAR), 'O07', CAST(w AS DOUBLE), 'windows' FROM q WHERE sign AND w < slides
UNION ALL SELECT CAST(package_id AS VARCHAR), CAST(deck_id AS VARCHAR), 'O07', CAST(w AS DOUBLE), 'undeclared windows' FROM q WHERE NOT sign AND w > 0"""
)
def o_profile_rules(spark, sf):
    c = _t(spark, sf, "conversations")
    v = A.versions(c, profiles=True)
    found = package.title_marks(v).unionByName(package.declared_resources(v, A.turn_resources(c)))
    return _found(found, "package_id", "deck_id", "rule", "value", "detail")


# Reports


def _text_findings(spark, sf) -> DataFrame:
    return rules.text_lines(A.paragraphs(_t(spark, sf, "documents")))


_BOTH = f"fd AS (({_LONG}) UNION ALL ({_CAPS}))"


@query(
    f"""
WITH {PARA}, {_BOTH} SELECT deck_id, CAST(0 AS BIGINT) AS errors, count(*) AS warnings, CAST(0 AS BIGINT) AS hints, CAST(0 AS BIGINT) AS unverified FROM fd GROUP BY deck_id"""
)
def severity_rollup(spark, sf):
    return report.rollup(_text_findings(spark, sf))


@query(
    f"""
WITH {PARA}, {_BOTH} SELECT 'F' AS layer, rule, 'A' AS severity, count(*) AS n FROM fd GROUP BY rule
UNION ALL SELECT 'F', rule, NULL, count(*) FROM fd GROUP BY rule UNION ALL SELECT 'F', NULL, NULL, count(*) FROM fd UNION ALL SELECT NULL, NULL, NULL, count(*) FROM fd"""
)
def corpus_rollup(spark, sf):
    return report.corpus_cube(_text_findings(spark, sf))


@query(
    f"""
WITH {PARA}, {_BOTH} SELECT deck_id, deck_id NOT IN (SELECT deck_id FROM fd) AS gate_open FROM (SELECT DISTINCT source AS deck_id FROM documents)"""
)
def gate(spark, sf):
    decks = A.document_slides(_t(spark, sf, "documents")).select("deck_id").distinct()
    return report.gate(decks, _text_findings(spark, sf))


@query(
    f"""
WITH {PARA}, {_BOTH} SELECT *, CAST(row_number() OVER (PARTITION BY deck_id ORDER BY rule, slide_no, para_ord NULLS FIRST) AS INTEGER) AS place FROM fd""",
    ints=('para_ord',),
)
def report_order(spark, sf):
    found = report.report_order(_text_findings(spark, sf).withColumn("detail", F.lit(None).cast("string")))
    return _found(found, "deck_id", "rule", "slide_no", "para_ord", "value", "place")


# Transforms


@query(
    """
WITH b AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '[\\s\\x{a0}]+'), lambda w: w <> '')) AS n FROM conversations),
d AS (SELECT *, greatest(2000, CAST(round(n * 60000.0 / 145) AS BIGINT)) AS ms FROM b)
SELECT conv_id, turn, CAST(row_number() OVER w AS INTEGER) AS n, CAST(sum(ms) OVER w AS BIGINT) - ms AS start_ms, CAST(sum(ms) OVER w AS BIGINT) AS end_ms FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)"""
)
def srt_clock(spark, sf):
    c = _t(spark, sf, "conversations").select("conv_id", "turn", "text")
    return transform.subtitles(c, "conv_id", "turn").select("conv_id", "turn", "n", "start_ms", "end_ms")


_CLOCK = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


@query(
    f"""
WITH b AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[\\s\\x{{a0}}]+'), lambda w: w <> '') AS ws FROM conversations),
d AS (SELECT conv_id, turn, ws, greatest(2000, CAST(round(len(ws) * 60000.0 / 145) AS BIGINT)) AS ms FROM b),
t AS (SELECT *, row_number() OVER o AS n, CAST(sum(ms) OVER o AS BIGINT) - ms AS a, CAST(sum(ms) OVER o AS BIGINT) AS z FROM d WINDOW o AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
w AS (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM b), c AS (SELECT *, sum(length(w) + 1) OVER (PARTITION BY conv_id, turn ORDER BY k) - 1 AS cum FROM w),
f AS (SELECT conv_id, turn, CASE WHEN max(length(w)) FILTER (k = 1) > 41 THEN 0 ELSE count(*) FILTER (cum <= 42) END AS k1, CASE WHEN max(length(w)) FILTER (k = 1) > 41 THEN 0 ELSE coalesce(max(cum) FILTER (cum <= 42), -1) + 1 END AS base FROM c GROUP BY ALL),
l AS (SELECT conv_id, turn, coalesce(string_agg(w, ' ' ORDER BY k) FILTER (k <= k1), '') || coalesce(chr(10) || string_agg(w, ' ' ORDER BY k) FILTER (k > k1 AND (k = k1 + 1 OR cum - base <= 42)), '') AS txt FROM c JOIN f USING (conv_id, turn) GROUP BY ALL)
SELECT conv_id, string_agg(n || chr(10) || {_CLOCK.format("a")} || ' --> ' || {_CLOCK.format("z")} || chr(10) || coalesce(txt, '') || chr(10), chr(10) ORDER BY n) AS srt FROM t LEFT JOIN l USING (conv_id, turn) GROUP BY conv_id"""
)
def srt_files(spark, sf):
    c = _t(spark, sf, "conversations").select("conv_id", "turn", "text")
    return transform.srt(transform.subtitles(c, "conv_id", "turn"), "conv_id")


@query(
    """
WITH t AS (SELECT doc_id AS key, left(sha256(coalesce(text, '')), 16) AS hash FROM documents)
SELECT key, hash, key % 4 <> 0 AND 40000 + (key % 5) * 10000 >= 51200 AND key % 7 <> 0 AS reused FROM t"""
)
def cache_reuse(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    old = docs.select("key", F.when(F.col("key") % 4 == 0, F.lit("")).otherwise(transform.content_hash(F.col("text"))).alias("hash"))
    files = docs.select("key", (40_000 + F.col("key") % 5 * 10_000).alias("bytes"), F.when(F.col("key") % 7 == 0, 0).otherwise(25).alias("fps"))
    return transform.cache_reuse(docs, old, files)


@query(
    f"""
WITH {PARA}, l AS (SELECT slide_no, deck_id, max(len(list_filter(regexp_split_to_array(text, '[\\s\\x{{a0}}]+'), lambda w: w <> ''))) AS words,
  max(len(list_filter(regexp_split_to_array(text, '[.!?;]+'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) <> ''))) AS sentences, count(*) AS n FROM para GROUP BY ALL),
b AS (SELECT *, CASE WHEN slide_no % 2 = 0 THEN 2 ELSE 3 END AS bp, CASE WHEN slide_no % 2 = 0 THEN 14 ELSE 18 END AS bw FROM l)
SELECT deck_id, slide_no, 'paragraphs' AS cause, CAST(n AS INTEGER) AS value FROM b WHERE n > bp
UNION ALL SELECT deck_id, slide_no, 'words', CAST(words AS INTEGER) FROM b WHERE words > bw
UNION ALL SELECT deck_id, slide_no, 'sentences', CAST(sentences AS INTEGER) FROM b WHERE sentences > 1"""
)
def profile_budget(spark, sf):
    docs = _t(spark, sf, "documents")
    profile = F.when(F.col("doc_id") % 2 == 0, "libras").otherwise("leitura_facil")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = docs.select(F.col("source").alias("deck_id"), F.col("doc_id").alias("slide_no"), profile.alias("profile"), lines.alias("lines"))
    return transform.over_budget(rows)


def _script(spark, sf) -> DataFrame:
    docs = _t(spark, sf, "documents")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    kinds = F.array(*[F.lit(x) for x in ("conteudo", "destaque", "cartoes", "comparacao", "capa")])
    return docs.select(
        F.col("source").alias("deck_id"), F.col("doc_id").alias("slide_no"), F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")).alias("type"),
        F.when(F.col("doc_id") % 17 == 0, "").otherwise(lines[0]).alias("title"), F.slice(lines, 2, 1 << 20).alias("content"),
        F.when(F.col("doc_id") % 3 == 0, "7").alias("number"), (F.col("doc_id") % 2).alias("cards"), (F.col("doc_id") % 4).alias("columns"),
    )


@query(
    f"""
WITH {PARA}, s AS (SELECT deck_id, slide_no, CASE WHEN slide_no % 17 = 0 THEN '' ELSE min(t) FILTER (para_ord = 0) END AS title, count(*) - 1 AS n FROM para GROUP BY deck_id, slide_no),
r AS (SELECT *, row_number() OVER (PARTITION BY deck_id, lower(title) ORDER BY slide_no) AS rn FROM s)
SELECT deck_id, slide_no, 'title missing' AS error FROM r WHERE title = '' UNION ALL SELECT deck_id, slide_no, 'title repeated' FROM r WHERE rn > 1 AND title <> ''
UNION ALL SELECT deck_id, slide_no, 'too many paragraphs' FROM r WHERE n > 6 UNION ALL SELECT deck_id, slide_no, 'number missing' FROM r WHERE slide_no % 5 = 1 AND slide_no % 3 <> 0
UNION ALL SELECT deck_id, slide_no, 'cards missing' FROM r WHERE slide_no % 5 = 2 AND slide_no % 2 = 0 UNION ALL SELECT deck_id, slide_no, 'not two columns' FROM r WHERE slide_no % 5 = 3 AND slide_no % 4 <> 2"""
)
def script_validation(spark, sf):
    return transform.validate_script(_script(spark, sf))


@query(
    f"""
WITH {PARA}, s AS (SELECT deck_id, slide_no, CASE WHEN slide_no % 17 = 0 THEN '' ELSE min(t) FILTER (para_ord = 0) END AS title, count(*) - 1 AS n FROM para GROUP BY deck_id, slide_no),
r AS (SELECT *, row_number() OVER (PARTITION BY deck_id, lower(title) ORDER BY slide_no) AS rn FROM s),
e AS (SELECT deck_id, slide_no, unnest(list_filter([CASE WHEN slide_no % 5 = 2 AND slide_no % 2 = 0 THEN 'cards missing' END, CASE WHEN slide_no % 5 = 3 AND slide_no % 4 <> 2 THEN 'not two columns' END,
  CASE WHEN slide_no % 5 = 1 AND slide_no % 3 <> 0 THEN 'number missing' END, CASE WHEN title = '' THEN 'title missing' END,
  CASE WHEN rn > 1 AND title <> '' THEN 'title repeated' END, CASE WHEN n > 6 THEN 'too many paragraphs' END], lambda x: x IS NOT NULL)) AS error FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY deck_id ORDER BY slide_no, error) AS k FROM e)
SELECT deck_id, slide_no, error FROM k WHERE k = 1"""
)
def script_first_error(spark, sf):
    return transform.first_error(transform.validate_script(_script(spark, sf)))


@query(None)
def import_slides(spark, sf):
    p = A.paragraphs(_t(spark, sf, "documents"))
    lines = p.select(F.col("slide_no").alias("doc_id"), F.col("para_ord").alias("line_no"), F.col("text").alias("line"))
    return transform.import_slides(transform.text_blocks(lines))


@query(
    """
SELECT source AS deck_id, CAST(sum(length(text)) AS BIGINT) AS chars, round(sum(length(text)) / 1000.0 * 0.30, 2) AS dollars FROM documents GROUP BY 1"""
)
def speech_cost(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("source").alias("deck_id"), "text")
    return transform.speech_cost(docs)


@query(
    """
WITH s AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source AS deck_id, CAST(i AS INTEGER) AS slide_no, 'n' || CASE WHEN n > 25 THEN (i - 2) % 25 ELSE i - 1 END AS track FROM s WHERE NOT (n > 25 AND i = 1)"""
)
def track_cycle(spark, sf):
    from pyspark.sql import Window

    docs = _t(spark, sf, "documents")
    slides = docs.select(F.col("source").alias("deck_id"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("slide_no"))
    tracks = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("track_no"))
    tracks = slides.select("deck_id").distinct().crossJoin(tracks)
    return transform.assign_tracks(slides, tracks.withColumn("track", F.concat(F.lit("n"), F.col("track_no").cast("string"))))


@query(
    """
WITH p AS (SELECT unnest(['completo', 'libras', 'leitura_facil', 'outro']) AS profile, unnest(['', '-libras', '-leitura-facil', '']) AS a),
m AS (SELECT unnest(['padrao', 'alto_contraste', 'daltonico']) AS mode, unnest(['-padrao', '-alto-contraste', '-daltonico-seguro']) AS b)
SELECT o_orderkey AS deck_id, profile, mode, a || b AS file_suffix FROM orders, p, m
WHERE (CASE profile WHEN 'completo' THEN o_custkey % 2 = 0 WHEN 'libras' THEN o_custkey % 3 = 0 WHEN 'leitura_facil' THEN o_custkey % 5 <> 0 ELSE false END)
  AND (mode = 'padrao' OR (mode = 'alto_contraste' AND o_orderkey % 3 = 0) OR (mode = 'daltonico' AND o_orderkey % 4 = 0))
  AND (profile <> 'leitura_facil' OR mode = 'padrao' OR o_orderpriority = '1-URGENT')"""
)
def build_set(spark, sf):
    """Orders as requests for the versions of a deck."""
    n, k = F.col("o_orderkey"), F.col("o_custkey")

    def some(**when):
        return F.array_compact(F.array(*[F.when(c, F.lit(x)) for x, c in when.items()]))

    requests = _t(spark, sf, "orders").select(
        n.alias("deck_id"), some(completo=k % 2 == 0, libras=k % 3 == 0, leitura_facil=k % 5 != 0, outro=k % 7 == 0).alias("profiles"),
        some(padrao=F.lit(True), alto_contraste=n % 3 == 0, daltonico=n % 4 == 0).alias("modes"), (F.col("o_orderpriority") == "1-URGENT").alias("every_mode"),
    )
    return package.build_sets(requests)


def queries() -> dict[str, Query]:
    from . import facts, wholes  # noqa: F401  (register their queries)

    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    from . import facts, wholes  # noqa: F401

    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
