"""The findings table and what is computed from it.

A finding: deck_id, rule, severity (E, A, D or —), verdict ('fail' or 'unverified'), slide_no, shape_ord,
para_ord, value (the measure that was compared), detail (the text it is about). Rules that ran are kept
apart (`evaluated`), so that nothing unverified counts as passed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import numbered

KEYS = ("deck_id", "slide_no", "shape_ord", "para_ord")
SEVERITY_RANK = {"E": 0, "A": 1, "D": 2, "—": 3}


def finding(
    df: DataFrame,
    rule: str | Column,
    severity: str,
    value: Column | None = None,
    detail: Column | None = None,
    verdict: str = "fail",
) -> DataFrame:
    """Projects rows to findings; keys that df lacks are null."""
    kinds = {"deck_id": "string", "slide_no": "long", "shape_ord": "int", "para_ord": "int"}
    keys = [
        (F.col(k) if k in df.columns else F.lit(None)).cast(kinds[k]).alias(k) for k in KEYS
    ]
    return df.select(
        keys[0],
        (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"),
        F.lit(severity).alias("severity"),
        F.lit(verdict).alias("verdict"),
        *keys[1:],
        (F.lit(None) if value is None else value).cast("double").alias("value"),
        (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
    )


def row_findings(df: DataFrame, tests: list[tuple]) -> DataFrame:
    """The findings of several rules of one grain in one pass over its rows.

    tests: (rule, severity, condition[, value[, detail[, verdict]]]); every condition that holds gives a
    finding.
    """
    tests = [(*test, *[None] * (6 - len(test))) for test in tests]
    number = F.col("__test")

    def named(names: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in names]), number + 1)

    def told(at: int, kind: str) -> Column:
        """The value or detail of the finding's own test."""
        given = [(i, test[at].cast(kind)) for i, test in enumerate(tests) if test[at] is not None]
        return reduce(lambda case, x: case.when(number == x[0], x[1]), given, F.when(F.lit(False), F.lit(None).cast(kind)))

    # The conditions are a projection of their own, which Spark compiles and which works out once what they share; within
    # a generator or a lambda's array they are interpreted. Values and details are worked out for findings alone. The outer
    # form keeps the optimizer from repeating all conditions in a filter on the array's size.
    kinds = {"deck_id": "string", "slide_no": "long", "shape_ord": "int", "para_ord": "int"}
    keys = [(F.col(k) if k in df.columns else F.lit(None)).cast(kinds[k]).alias(k) for k in KEYS]
    rows = df.withColumn("__holds", F.array(*[test[2] for test in tests]))
    rows = rows.select("*", F.posexplode_outer("__holds").alias("__test", "__hold")).filter("__hold")
    rule, severity, verdict = (named(x).alias(n) for n, x in zip(("rule", "severity", "verdict"), zip(*[(t[0], t[1], t[5] or "fail") for t in tests])))
    return rows.select(keys[0], rule, severity, verdict, *keys[1:], told(3, "double").alias("value"), told(4, "string").alias("detail"))


def union(findings: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def evaluated(decks: DataFrame, rules: list[str]) -> DataFrame:
    """deck_id, rule for every rule that ran on a deck."""
    return decks.select("deck_id", F.explode(F.array(*[F.lit(r) for r in sorted(set(rules))])).alias("rule"))


def rollup(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Failures by severity and all unverified, for each group."""
    fail = F.col("verdict") == "fail"
    return findings.groupBy(*(by or ["deck_id"])).agg(
        F.count_if(fail & (F.col("severity") == "E")).alias("errors"),
        F.count_if(fail & (F.col("severity") == "A")).alias("warnings"),
        F.count_if(fail & (F.col("severity") == "D")).alias("hints"),
        F.count_if(~fail).alias("unverified"),
    )


def corpus_cube(findings: DataFrame) -> DataFrame:
    """Counts by deck, layer and rule with all subtotals; a null key is a total."""
    layered = findings.withColumn("layer", F.substring("rule", 1, 1))
    return layered.rollup("layer", "rule", "severity").agg(F.count("*").alias("n"))


def gate(decks: DataFrame, findings: DataFrame) -> DataFrame:
    """deck_id, gate_open: no failure of severity E or A."""
    bad = findings.filter((F.col("verdict") == "fail") & F.col("severity").isin("E", "A"))
    bad = bad.select("deck_id").distinct().withColumn("bad", F.lit(True))
    return decks.join(bad, "deck_id", "left").select("deck_id", F.col("bad").isNull().alias("gate_open"))


def report_order(findings: DataFrame) -> DataFrame:
    """With `place`: the order of a deck's report, by severity, rule and position."""
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])[F.col("severity")]
    order = [F.col("verdict") != "fail", rank, *[F.col(c) for c in ("rule", "slide_no", "shape_ord", "para_ord", "detail")]]
    placed = numbered(findings, ["deck_id"], order)
    return placed.withColumn("place", F.col("place").cast("int"))


def label(slide_no: Column, name: Column, tag: Column, extra: Column) -> Column:
    """'slide n · name · extra'; the tag stands for a missing name."""
    shown = F.coalesce(F.nullif(name, F.lit("")), tag)
    return F.concat_ws(" · ", F.concat(F.lit("slide "), slide_no), shown, F.nullif(extra, F.lit("")))


def as_json(findings: DataFrame, ran: DataFrame) -> DataFrame:
    """deck_id, json: each deck's summary, rules that ran and findings."""
    rows = findings.groupBy("deck_id").agg(
        F.array_sort(F.collect_list(F.struct("rule", "severity", "verdict", "slide_no", "detail"))).alias("findings")
    )
    rules = ran.groupBy("deck_id").agg(F.array_sort(F.collect_set("rule")).alias("evaluated"))
    whole = rules.join(rows, "deck_id", "left").join(rollup(findings), "deck_id", "left")
    summary = F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("errors", "warnings", "hints", "unverified")])
    return whole.select("deck_id", F.to_json(F.struct("deck_id", summary.alias("summary"), "evaluated", "findings")).alias("json"))


HEAD = ("| rule | severity | verdict | slide | detail |", "| - | - | - | - | - |")


def markdown_lines(findings: DataFrame) -> DataFrame:
    """deck_id, place, line: one table of findings a deck, in report order, a row a line (the head at places -1, 0), for
    sinks that write line by line."""
    cell = F.regexp_replace(F.coalesce("detail", F.lit("")), r"([|])", r"\\$1")
    line = F.format_string("| %s | %s | %s | %s | %s |", "rule", "severity", "verdict", F.coalesce(F.col("slide_no").cast("string"), F.lit("")), cell)
    lines = report_order(findings).select("deck_id", F.col("place").cast("long").alias("place"), line.alias("line"))
    head = F.posexplode(F.array(*[F.lit(x) for x in HEAD])).alias("at", "line")
    heads = findings.select("deck_id").distinct().select("deck_id", head)
    return lines.unionByName(heads.select("deck_id", (F.col("at") - 1).cast("long").alias("place"), "line"))


def as_markdown(findings: DataFrame) -> DataFrame:
    """deck_id, markdown: the lines of each deck as one text."""
    lines = F.array_sort(F.collect_list(F.struct("place", "line")))
    text = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    return markdown_lines(findings).groupBy("deck_id").agg(text.alias("markdown"))


def write_text(reports: DataFrame, column: str, path: str) -> None:
    """Text sink: reports as files, partitioned by deck."""
    reports.select("deck_id", F.col(column).alias("value")).write.partitionBy("deck_id").text(path)
