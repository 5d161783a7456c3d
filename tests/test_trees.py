"""Tags as trees, and values at any depth of JSON texts, against plain Python."""

import json

import pytest

from conforma.operators import trees

NODES = "deck_id string, node long, parent long, ord int, type string"


def preorder(rows, most):
    children = {}
    for deck, node, parent, order, kind in rows:
        children.setdefault((deck, parent), []).append((order, node, kind))
    out, known = [], {r[0] for r in rows}
    for deck in known:
        place, stack = 0, [(x, 0) for x in sorted(children.get((deck, None), []), reverse=True)]
        while stack:
            (_, node, kind), depth = stack.pop()
            if depth <= most:
                out.append((deck, node, kind, depth, place))
                place += 1
                stack += [(x, depth + 1) for x in sorted(children.get((deck, node), []), reverse=True)]
    return sorted(out)


def test_tag_tree(spark):
    rows = [("a", 1, None, 0, "Document"), ("a", 5, 1, 1, "H1"), ("a", 9, 1, 0, "P"), ("a", 2, 9, 0, "Link"), ("a", 3, None, 1, "Art")]
    rows += [("b", n, n - 1 if n else None, 0, "Sect") for n in range(90)]  # deeper than the bound
    rows += [("c", 1, 2, 0, "P"), ("c", 2, 1, 0, "P"), ("c", 3, 7, 0, "P")]  # a cycle, and a parent that isn't there
    rows += [("d", 0, None, 0, "Root")] + [("d", n, 0, 500 - n, "TR") for n in range(1, 500)]
    for most in (60, 3, 0):
        found = trees.tag_tree(spark.createDataFrame(rows, NODES), most)
        got = sorted(tuple(r) for r in found.select("deck_id", "node", "type", "depth", "place").collect())
        assert got == preorder(rows, most)
    assert trees.tag_tree(spark.createDataFrame([], NODES)).collect() == []


def test_parents_of_tags_that_do_not_close(spark):
    tags = [("<html", 1), ("<p", 1), ("<br", 0), ("<b", 1), ("</b", -1), ("<i", 1), ("</html", -1), ("<u", 1)]
    rows = [("x", i, k.strip("</"), s) for i, (k, s) in enumerate(tags)]
    found = trees.parents(spark.createDataFrame(rows, "deck_id string, ord int, type string, step int"), ["deck_id"])
    assert {(r.ord, r.parent) for r in found.collect()} == {(0, None), (1, 0), (2, 1), (3, 1), (5, 1), (7, 1)}


def plain_walk(value):
    yield value
    for x in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        yield from plain_walk(x)


FAILED = {"ruleStatus": "FAILED", "specification": "ISO 14289-1", "clause": "7.1", "failedChecks": 4, "description": "no lang", "ruleId": {"testNumber": 3}}
REPORTS = [
    {"report": {"jobs": [{"x": [FAILED, {"ruleStatus": "PASSED"}]}]}},
    [[{"ruleStatus": "FAILED", "ruleId": {"clause": "7.2", "testNumber": "5"}}]],
    {"ruleStatus": "FAILED", "clause": "", "inner": FAILED, "deep": [[[[{"a": {"b": FAILED}}]]]]},
    {"ruleStatus": ["FAILED"], "other": "FAILED"},
    7,
    "FAILED",
    {},
]


def test_failed_nodes_at_any_depth(spark):
    rows = [(str(i), json.dumps(r)) for i, r in enumerate(REPORTS)] + [("bad", "{not json"), ("none", None)]
    got = sorted((r.deck_id, r.rule, r.n, r.description) for r in trees.failed_nodes(spark.createDataFrame(rows, "deck_id string, json string")).collect())
    want = []
    for i, report in enumerate(REPORTS):
        for v in plain_walk(report):
            if isinstance(v, dict) and v.get("ruleStatus") == "FAILED":
                own = v.get("ruleId") or {}
                rule = f"{v.get('specification', '')} {v.get('clause') or own.get('clause', '')}-{own.get('testNumber', '')}"
                want.append((str(i), rule, v.get("failedChecks", 1), v.get("description", "")))
    assert got == sorted(want)
    found = trees.validator_findings(spark.createDataFrame(rows, "deck_id string, json string"), most=2)
    kinds = sorted(((r.deck_id, r.verdict, r.value) for r in found.collect()), key=str)
    assert kinds == [("0", "fail", None), ("1", "fail", None), ("2", "fail", 1.0), ("2", "fail", None), ("2", "fail", None), ("bad", "unverified", None), ("none", "unverified", None)]


@pytest.mark.parametrize("depth", [1, 20])
def test_markers_at_any_depth(spark, depth):
    script = {"t": "[FALTA: x]", "n": 3, "u": None}
    for _ in range(depth):
        script = {"a": [script, "[FALTA: y]"], "b": "texto [FALTA: z]", "[FALTA: chave]": True}
    rows = [("s", json.dumps(script)), ("t", json.dumps({"a": "\\u005bFALTA"})), ("u", '["\\u005bFALTA: escaped"]'), ("v", "oops")]
    got = {r.deck_id: r.n for r in trees.missing_markers(spark.createDataFrame(rows, "deck_id string, json string")).collect()}
    assert got == {"s": depth + 1, "t": 0, "u": 1, "v": 0}
