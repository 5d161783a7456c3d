"""The catalogue: one pass a grain gives what the rules give one by one."""

from collections import Counter

from pyspark.sql import functions as F

from conforma.functions import text as T
from conforma.operators import catalogue, design, report, rules
from conforma.plans import wholes

SF = "/root/testdata/sf0.001"


def one_by_one(t):
    linked = [t[k].filter("link_rid is not null and trim(text) <> ''") for k in ("shape", "run")]
    shapes, slides = t["shape"], t["slide"]
    sizes = shapes.select("deck_id", "slide_w", "slide_h").distinct()
    return report.union(
        [
            rules.metadata(t["deck"], "en"),
            rules.blank_layout(slides),
            rules.loose_text(shapes),
            rules.objects(shapes.drop("slide_w", "slide_h"), sizes),
            rules.alt_text(shapes, slides),
            rules.media(slides, shapes, t["deck"]).filter("rule not in ('I02', 'J01', 'J02')"),
            design.distorted(shapes),
            design.outside(shapes),
            design.inherited_caps(shapes),
            design.small_figures(shapes),
            rules.typed_bullets(t["paragraph"]),
            rules.crowded(t["paragraph"]).filter("para_ord is not null"),
            rules.shouted(t["paragraph"]),
            rules.paragraph_setting(t["paragraph"]),
            rules.contrast(t["run"]),
            rules.run_setting(t["run"]),
            *[rules.links(rows.withColumn("target", rows["link_rid"])).filter("rule <> 'H03'") for rows in linked],
        ]
    )


def test_same_findings_as_the_rules_one_by_one(spark):
    tables = wholes._catalogue_tables(spark, SF)
    got = Counter(map(tuple, catalogue.row_rules(tables, "en").collect()))
    want = Counter(map(tuple, one_by_one(tables).select(*catalogue.row_rules(tables, "en").columns).collect()))
    assert got == want
    seen = {r[1] for r in got}
    named = {rule for grain, t in tables.items() for rule in catalogue.rules_of(grain, t.columns)}
    assert seen == named  # every rule of every table has findings here


def test_each_table_is_scanned_once(spark, tmp_path):
    tables = {}
    for name, rows in wholes._catalogue_tables(spark, SF).items():
        rows.limit(20).write.parquet(str(tmp_path / name))
        tables[name] = spark.read.parquet(str(tmp_path / name))
    plan = catalogue.row_rules(tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == len(tables) + 1  # notes are looked up again for D07's candidates
    assert "Window" not in plan


def test_tables_without_facts_leave_rules_out(spark):
    rows = spark.createDataFrame([("d", 1, 0, "x" * 90)], "deck_id string, slide_no long, shape_ord int, text string")
    assert catalogue.rules_of("paragraph", rows.columns) == ["F06", "F07"]
    assert [r.rule for r in catalogue.row_rules({"paragraph": rows}).collect()] == ["F07"]


def test_evaluated_says_what_each_deck_had(spark):
    key = "deck_id string, slide_no long, shape_ord int"
    shapes = spark.createDataFrame(
        [("a", 1, 0, "pic", 10, 10), ("b", 1, 0, "pic", None, None)], f"{key}, tag string, native_w long, native_h long"
    )
    runs = spark.createDataFrame([("b", 1, 0, "x", "000000", "FFFFFF", None, 18, False)], f"{key}, text string, fg string, bg string, reason string, size int, bold boolean")
    ran = {(r.deck_id, r.rule) for r in catalogue.evaluated({"shape": shapes, "run": runs}).collect()}
    assert ("a", "N01") in ran and ("b", "N01") not in ran
    assert ("b", "E01") in ran and ("a", "E01") not in ran
    assert not {r for _, r in ran} & {"M01", "L07", "J01", "D07"}


def test_conditions_are_compiled(spark, tmp_path):
    """A generator gets conditions that a projection has worked out, and no generated method is too large to be compiled."""
    tables = wholes._catalogue_tables(spark, SF)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for grain in ("deck", "slide", "shape", "paragraph"):
            rows = tables[grain].limit(20)
            rows.write.parquet(str(tmp_path / grain))
            rows = spark.read.parquet(str(tmp_path / grain))
            plan = report.row_findings(catalogue.facts(grain, rows), catalogue.tests(grain, rows.columns))._jdf.queryExecution().executedPlan()
            generated = [x for x in plan.toString().split("\n") if "Generate " in x]
            assert len(generated) == 1 and "posexplode(__holds#" in generated[0]
            parts = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan).iterator()
            while parts.hasNext():
                assert parts.next()._3().maxMethodCodeSize() < 8000  # HotSpot interprets what is larger
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_row_findings_of_odd_rows(spark):
    """Null conditions give nothing; rows that come twice give their findings twice; what a test doesn't tell is null."""
    rows = spark.createDataFrame([("a", 1, 5), ("a", 1, 5), ("b", None, None), (None, 2, 0)], "deck_id string, slide_no int, n int")
    n = F.col("n")
    tests = [("X1", "E", n > 1, n, F.col("deck_id")), ("X1", "A", n < 1, None, None, "unverified"), ("X2", "D", F.lit(True)), ("X3", "A", n.isNull(), None, n)]
    got = Counter(map(tuple, report.row_findings(rows, tests).collect()))
    keys = ((1, None, None), (None, None, None), (2, None, None))
    assert got == Counter(
        {
            ("a", "X1", "E", "fail", *keys[0], 5.0, "a"): 2,
            ("a", "X2", "D", "fail", *keys[0], None, None): 2,
            ("b", "X2", "D", "fail", *keys[1], None, None): 1,
            ("b", "X3", "A", "fail", *keys[1], None, None): 1,
            (None, "X1", "A", "unverified", *keys[2], None, None): 1,
            (None, "X2", "D", "fail", *keys[2], None, None): 1,
        }
    )
    assert report.row_findings(rows.limit(0), tests).count() == 0


def test_capitals_and_accents_in_odd_texts(spark):
    """As words say one by one; a text with a small letter in a word isn't cut into words."""
    texts = {
        None: None, "": False, "AB": False, "AB CD EF": True, "AB CD Ef": False, "AB CD EF g": True, "AB CD EF g1h": True, "ÀÉ ÇÃ ÖÜ": True,
        "ÀÉ ÇÃ öÜ": False, "STRAßE AB CD EF": False, "×÷ AB CD EF": False, "A×B CD EF": True, "AB CD EÿF": False, "AB CD EF 12 жж": True,
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.all_caps(F.col("t")).alias("c"))
    assert {r.t: r.c for r in rows.collect()} == texts
    assert "RLIKE" in rows._jdf.queryExecution().executedPlan().toString()
    texts = {None: None, "": False, "Nao há": True, "não há": False, "PÁGINA pagina": True, "paginador": False}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.lacks_accent(F.col("t")).alias("c"))
    assert {r.t: r.c for r in rows.collect()} == texts
