"""The rules' functions for Spark SQL: temporary functions, views of fact tables and a table function over findings.

    register(spark)                            -- contrast_ratio(fg, bg), contrast_rule(...), text predicates
    register_tables(spark, tables, findings)   -- conforma_shape, conforma_run, ..., findings_of(deck)

    SELECT deck_id, contrast_rule(fg, bg, size, bold) AS rule FROM conforma_run WHERE NOT blank_text(text);
    SELECT * FROM findings_of('aula1.pptx') WHERE severity = 'E';

They are SQL expressions, which Catalyst inlines into the plan that uses them; an argument that one uses several times is
bound by a lambda, so that nested calls stay small. Words and patterns are those of functions.text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import text as T

PREFIX = "conforma_"


def _text(value: str) -> str:
    """A SQL string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    for c in "\t\n\x0b\f\r":
        escaped = escaped.replace(c, f"\\u{ord(c):04x}")
    return f"'{escaped}'"


def _listed(words) -> str:
    return ", ".join(map(_text, words))


#: name: (parameters, kind, expression); later ones use earlier ones.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "stripped": ("text STRING", "STRING", f"btrim(text, {_text(T.BLANKS)})"),
    "blank_text": ("text STRING", "BOOLEAN", "coalesce(stripped(text), '') = ''"),
    "hex_luminance": (
        "colour STRING", "DOUBLE",
        "CASE WHEN colour RLIKE '^[0-9A-Fa-f]{6}$' THEN aggregate(transform(array(1, 3, 5), at -> conv(substr(colour, at, 2), 16, 10) / 255.0D), "
        "named_struct('sum', 0.0D, 'k', 1), (s, c) -> named_struct('sum', s.sum + element_at(array(0.2126D, 0.7152D, 0.0722D), s.k) "
        "* if(c <= 0.03928D, c / 12.92D, pow((c + 0.055D) / 1.055D, 2.4D)), 'k', s.k + 1), s -> s.sum) END",
    ),
    "luminance_ratio": (
        "a DOUBLE, b DOUBLE", "DOUBLE",
        "transform(array(named_struct('a', a, 'b', b)), p -> CASE WHEN p.a IS NOT NULL AND p.b IS NOT NULL "
        "THEN (greatest(p.a, p.b) + 0.05D) / (least(p.a, p.b) + 0.05D) END)[0]",
    ),
    "contrast_ratio": ("fg STRING, bg STRING", "DOUBLE", "luminance_ratio(hex_luminance(fg), hex_luminance(bg))"),
    "large_text": ("size BIGINT, bold BOOLEAN", "BOOLEAN", "coalesce(size >= 1800 OR (coalesce(bold, false) AND size >= 1400), false)"),
    "ratio_rule": (
        "ratio DOUBLE, large BOOLEAN", "STRING",
        "transform(array(named_struct('r', ratio, 'l', large)), p -> CASE WHEN p.r + 0.005D < if(p.l, 3.0D, 4.5D) "
        "THEN if(p.l, 'E02', 'E01') WHEN NOT p.l AND p.r < 7.0D THEN 'E03' END)[0]",
    ),
    "contrast_rule": ("fg STRING, bg STRING, size BIGINT, bold BOOLEAN", "STRING", "ratio_rule(contrast_ratio(fg, bg), large_text(size, bold))"),
    "all_caps": (
        "text STRING", "BOOLEAN",
        "size(regexp_extract_all(text, '([A-Za-zÀ-ÿ]{2,})', 1)) >= 3 AND forall(regexp_extract_all(text, '([A-Za-zÀ-ÿ]{2,})', 1), w -> w = upper(w) AND w <> lower(w))",
    ),
    "vague_link": ("text STRING", "BOOLEAN", f"regexp_replace(lower(text), '^[ .:;!?]+|[ .:;!?]+$', '') IN ({_listed(T.VAGUE_LINK)})"),
    "bare_alt": ("alt STRING", "STRING", "regexp_replace(lower(stripped(alt)), '[.:;!? ]+$', '')"),
    "generic_alt": ("alt STRING", "BOOLEAN", f"bare_alt(alt) <> '' AND (bare_alt(alt) IN ({_listed(T.GENERIC_ALT)}) OR char_length(bare_alt(alt)) <= 3)"),
    "file_alt": ("alt STRING", "BOOLEAN", f"alt RLIKE {_text(T.FILE_SUFFIX)}"),
    "lacks_accent": ("text STRING", "BOOLEAN", f"arrays_overlap(regexp_extract_all(lower(text), '([a-zà-ÿ]+)', 1), array({_listed(T.NEEDS_ACCENT)}))"),
    "typed_bullet": ("text STRING", "BOOLEAN", f"stripped(text) RLIKE {_text(T.TYPED_BULLET)}"),
    "raw_address": ("text STRING", "BOOLEAN", f"text RLIKE {_text(T.RAW_URL)}"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL; their names."""
    for name, (parameters, kind, expression) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {expression}")
    return list(FUNCTIONS)


def register_tables(spark: SparkSession, tables: dict[str, DataFrame], findings: DataFrame | None = None) -> list[str]:
    """Makes fact tables views (conforma_ and their names), and findings the table function findings_of(deck)."""
    for name, rows in tables.items():
        rows.createOrReplaceTempView(f"{PREFIX}{name}")
    names = [f"{PREFIX}{name}" for name in tables]
    if findings is None:
        return names
    findings.createOrReplaceTempView(f"{PREFIX}findings")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in findings.schema if f.name != "deck_id")
    columns = ", ".join(f.name for f in findings.schema if f.name != "deck_id")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION findings_of(deck STRING) RETURNS TABLE({kinds}) "
        f"RETURN SELECT {columns} FROM {PREFIX}findings WHERE deck_id = findings_of.deck"
    )
    return [*names, f"{PREFIX}findings", "findings_of"]
