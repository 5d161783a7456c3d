"""Trees of tags, and JSON values of unknown nesting.

Tags find their depth and place by joins that double what each knows of its way up; values are exploded level by level
in recursive SQL. All tasks share a level or round, however deep a tree is; a tree's depth is bounded, its size is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import kept, unlimited_recursion
from . import rules
from .report import finding, union

#: How deep trees are followed; what lies deeper is left out, and so are nodes of a cycle beyond it.
MAX_DEPTH = 60
MARKER = "[FALTA:"


def parents(tags: DataFrame, keys: list[str]) -> DataFrame:
    """Opening tags (ord, type) with parent: the last tag before it that opened one level up.

    tags: keys, ord, type, step (1 opens and stays open, 0 opens and closes at once, -1 closes). A level's
    openings are looked up in a window of their own, so that no tag meets all others of its text.
    """
    before = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    opened = tags.withColumn("level", F.coalesce(F.sum("step").over(before), F.lit(0))).filter("step >= 0")
    own = F.when(F.col("step") > 0, F.struct((F.col("level") + 1).alias("at"), F.col("ord").alias("holder")))
    each = F.explode(F.array_compact(F.array(F.struct(F.col("level").alias("at"), F.lit(None).cast("int").alias("holder")), own))).alias("e")
    rows = opened.select(*keys, "ord", "type", each).select(*keys, "ord", "type", "e.*")
    last = Window.partitionBy(*keys, "at").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("parent", F.last("holder", ignorenulls=True).over(last))
    return found.filter("holder is null").select(*keys, "ord", "type", "parent")


def tag_tree(nodes: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """deck_id, node, type, depth, place: the tags of each file depth first, from 0.

    nodes: deck_id, node, parent (null for roots), ord (order among siblings), type. Nodes that lie deeper than
    max_depth, in a cycle, or below a missing parent are left out. Every node knows the way up to some node above it;
    a round puts that node's way before its own, so that ways double and a depth of 60 takes six joins.
    """
    parent, up = F.col("parent"), F.when(F.col("parent").isNull(), 0).otherwise(1)
    rows = nodes.select("deck_id", "node", "type", parent.alias("top"), F.array("ord").alias("path"), up.alias("depth"))
    reach = 1
    while True:
        rows = kept(rows)
        if reach > max_depth or rows.filter("top is not null").isEmpty():
            break
        above = rows.select("deck_id", F.col("node").alias("top"), F.col("top").alias("next"), F.col("path").alias("way"), F.col("depth").alias("more"))
        joined = rows.filter("top is not null").join(above, ["deck_id", "top"])
        longer = {"path": F.concat("way", "path"), "depth": F.col("depth") + F.col("more"), "top": F.col("next")}
        rows = rows.filter("top is null").unionByName(joined.withColumns(longer).select(*rows.columns))
        reach *= 2
    place = F.row_number().over(Window.partitionBy("deck_id").orderBy("path", "node")) - 1
    found = rows.filter(F.col("top").isNull() & (F.col("depth") <= max_depth))
    return found.select("deck_id", "node", "type", "depth", place.alias("place"))


def walk(texts: DataFrame, json: str = "json", key: str = "deck_id", max_depth: int = MAX_DEPTH) -> DataFrame:
    """deck_id, depth, path (positions), v: every value inside JSON texts, objects and arrays included.

    Positions are those of the parsed value: objects hold their names in alphabetical order. A text that is no JSON
    has no values.
    """
    unlimited_recursion(texts.sparkSession)
    rows = texts.select(F.col(key).alias("deck_id"), F.try_parse_json(json).alias("v")).filter("v is not null")
    return texts.sparkSession.sql(
        f"""
WITH RECURSIVE walk(deck_id, depth, path, v) MAX RECURSION LEVEL {max_depth + 2} AS (
  SELECT deck_id, 0, CAST(array() AS ARRAY<INT>), v FROM {{rows}}
  UNION ALL
  SELECT w.deck_id, w.depth + 1, concat(w.path, array(e.pos)), e.value
  FROM walk w, LATERAL variant_explode(w.v) e WHERE w.depth < {max_depth})
SELECT * FROM walk""",
        rows=rows,
    )


def _said(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", path, kind)


def failed_nodes(reports: DataFrame, json: str = "json", max_depth: int = MAX_DEPTH) -> DataFrame:
    """deck_id, path, rule, n, description: the objects anywhere in a validator's reports that say a rule failed.

    A rule is named by specification, clause and test number; the last two may lie in an object of their own. n is 1
    where a report doesn't count.
    """
    rows = walk(reports, json, max_depth=max_depth).filter(F.coalesce(_said("$.ruleStatus") == "FAILED", F.lit(False)))
    empty = F.lit("")
    clause = F.coalesce(F.nullif(_said("$.clause"), empty), _said("$.ruleId.clause"), empty)
    rule = F.format_string("%s %s-%s", F.coalesce(_said("$.specification"), empty), clause, F.coalesce(_said("$.ruleId.testNumber"), empty))
    n = F.coalesce(_said("$.failedChecks", "bigint"), F.lit(1))
    return rows.select("deck_id", "path", rule.alias("rule"), n.alias("n"), F.coalesce(_said("$.description"), empty).alias("description"))


def validator_findings(reports: DataFrame, json: str = "json", most: int = 15) -> DataFrame:
    """The first failures of each report and the number of the others; unverified where a report is no JSON."""
    message = F.format_string("%s: %d: %s", "rule", "n", F.substring("description", 1, 150))
    failed = failed_nodes(reports, json).select("deck_id", F.col("path").alias("ord"), message.alias("message"))
    unread = reports.filter(F.try_parse_json(json).isNull())
    return union([rules.validator_failures(failed, most), finding(unread, "L07", "E", verdict="unverified")])


def missing_markers(scripts: DataFrame, json: str = "json") -> DataFrame:
    """deck_id, n: texts still to be written, wherever in a script they stand (slides, cards, columns, tables, figures)."""
    text = F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string"))
    found = walk(scripts, json).filter(F.coalesce(text.startswith(MARKER), F.lit(False)))
    counted = found.groupBy("deck_id").agg(F.count("*").alias("n"))
    return scripts.select("deck_id").distinct().join(counted, "deck_id", "left").fillna(0, ["n"])
