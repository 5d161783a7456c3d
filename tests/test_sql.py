"""The functions that SQL can call, against the same expressions as Columns."""

from pyspark.sql import functions as F

from conforma.functions import colour as C
from conforma.functions import text as T
from conforma.operators import report
from conforma.sources import sql

TEXTS = ["", "  \t", "CLIQUE AQUI", "Clique aqui.", "NÃO HÁ NADA", "foto.PNG ", "imagem!", "ok", "voce nao viu", "- item", "-item", "https://a.b", "it's \\ 'quoted'", None]


def test_text_predicates(spark):
    sql.register(spark)
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    text = F.col("text")
    same = {
        "blank_text": T.blank(text), "all_caps": T.all_caps(text), "vague_link": T.vague_link(text), "generic_alt": T.generic_alt(text),
        "file_alt": T.looks_like_file(text), "lacks_accent": T.lacks_accent(text), "typed_bullet": T.strip(text).rlike(T.TYPED_BULLET),
        "raw_address": text.rlike(T.RAW_URL),
    }
    rows = df.select("text", *[c.alias(f"{n}_c") for n, c in same.items()], *[F.expr(f"{n}(text)").alias(n) for n in same]).collect()
    for r in rows:
        for n in same:
            assert r[n] == r[f"{n}_c"], (n, r["text"])
    assert {n for n in same if any(r[n] for r in rows)} == set(same)


def test_contrast(spark):
    sql.register(spark)
    hexes = ["000000", "FFFFFF", "777777", "767676", "12aBcD", "xyz", None, "0000000"]
    df = spark.createDataFrame([(a, b, s, bold) for a in hexes for b in hexes for s, bold in ((1200, None), (1400, True), (1800, False), (None, True))], "fg string, bg string, size long, bold boolean")
    known = lambda c: C.parse_hex(F.when(F.col(c).rlike("^[0-9A-Fa-f]{6}$"), F.col(c)))
    want = C.contrast(known("fg"), known("bg"))
    rows = df.select(F.expr("contrast_ratio(fg, bg)").alias("got"), want.alias("want"), F.expr("large_text(size, bold)").alias("l"), C.large_text(F.col("size"), F.col("bold")).alias("lc")).collect()
    assert all((r.got is None) == (r.want is None) and (r.got is None or abs(r.got - r.want) < 1e-9) and r.l == r.lc for r in rows)


def test_findings_of_a_deck(spark):
    df = spark.createDataFrame([("a'1", 1, "x"), ("b", 2, "y"), ("b", 3, "z")], "deck_id string, slide_no long, text string")
    found = report.finding(df, "B05", "E", detail=F.col("text"))
    assert sql.register_tables(spark, {"slide": df}, found) == ["conforma_slide", "conforma_findings", "findings_of"]
    got = spark.sql("SELECT s.slide_no, f.detail FROM conforma_slide s, LATERAL findings_of(s.deck_id) f WHERE f.slide_no = s.slide_no ORDER BY 1")
    assert [tuple(r) for r in got.collect()] == [(1, "x"), (2, "y"), (3, "z")]
    assert spark.sql("SELECT count(*) FROM findings_of('b') WHERE severity = 'E'").head()[0] == 2
