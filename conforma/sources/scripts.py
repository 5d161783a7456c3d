"""Readers of scripts and plain texts: JSON or YAML scripts, Markdown or text files, media manifests."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLIDE = (
    "tipo string, titulo string, conteudo array<string>, notas string, mensagem_chave string, numero string, "
    "cartoes array<struct<titulo string, texto array<string>>>, colunas array<struct<titulo string, texto array<string>>>, "
    "libras struct<titulo string, conteudo array<string>>, facil struct<titulo string, conteudo array<string>>"
)
SCRIPT = f"apresentacao struct<titulo string, autor string, idioma string, assunto string, resumo string>, slides array<struct<{SLIDE}>>"


def read_scripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, slides) of JSON scripts, one file a script; slides numbered from 1."""
    rows = spark.read.schema(SCRIPT).option("multiLine", "true").json(path).select(F.col("_metadata.file_path").alias("deck_id"), "*")
    return _tables(rows)


def read_yaml_scripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, slides, errors) of YAML scripts as read_scripts gives them; errors: deck_id, error of files that are no
    YAML. Needs PyYAML where tasks run."""

    def run(batches):
        import yaml

        for batch in batches:
            out = []
            for text in batch.column(1):
                try:
                    out.append((json.dumps(yaml.safe_load(text.as_py()), default=str), None))
                except yaml.YAMLError as e:
                    out.append((None, str(e)))
            columns = [pa.array(c, pa.string()) for c in zip(*out, strict=True)] if out else [pa.nulls(0, pa.string())] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["deck_id", "script", "error"])

    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("deck_id"), "value")
    rows = raw.mapInArrow(run, "deck_id string, script string, error string")
    parsed = rows.filter("error is null").select("deck_id", F.from_json("script", SCRIPT).alias("s")).select("deck_id", "s.*")
    return *_tables(parsed), rows.filter("error is not null").select("deck_id", "error")


def _tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    headers = rows.select("deck_id", "apresentacao.*")
    slides = rows.select("deck_id", F.posexplode("slides").alias("slide_no", "s"))
    slides = slides.select(
        "deck_id", (F.col("slide_no") + 1).cast("long").alias("slide_no"), F.coalesce("s.tipo", F.lit("conteudo")).alias("type"),
        F.col("s.titulo").alias("title"), F.col("s.conteudo").alias("content"), F.col("s.notas").alias("notes"),
        F.col("s.mensagem_chave").alias("key_message"), F.col("s.numero").alias("number"), F.size("s.cartoes").alias("cards"),
        F.size("s.colunas").alias("columns"), F.col("s.libras").alias("libras"), F.col("s.facil").alias("easy"),
    )
    return headers, slides


# Characters that JSON leaves as they are, but YAML takes for line ends or refuses.
_ODD = "".join(map(chr, [*range(0x7F, 0xA0), 0x2028, 0x2029, 0xFEFF, 0xFFFE, 0xFFFF]))


def quoted(text: Column) -> Column:
    """A text as a double-quoted YAML scalar: JSON's escapes, and \\u for what YAML doesn't take inside quotes."""
    json_ = F.to_json(F.array(text))
    plain = F.substring(json_, 2, F.char_length(json_) - 2)
    escaped = plain
    for c in _ODD:
        escaped = F.replace(escaped, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return F.when(plain.rlike(f"[{_ODD}]"), escaped).otherwise(plain)


NOTICES_SHOWN = 40


def yaml_lines(headers: DataFrame, slides: DataFrame, notices: DataFrame | None = None) -> DataFrame:
    """deck_id, slide_no, place, line: scripts as YAML, in the tables of read_scripts; what is null is left out.

    notices (deck_id, text) become comments at the top, the first NOTICES_SHOWN of each deck. Lines of a deck are in order
    by slide_no (0: the header) and place.
    """

    def entry(indent: str, name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{indent}{name}: "), quoted(value)))

    names = ("titulo", "autor", "idioma", "assunto", "resumo")
    given = [entry("  ", n, F.col(n)) for n in names if n in headers.columns]
    head = F.concat(F.array(F.lit("apresentacao:")), F.array_compact(F.array(*given)), F.array(F.lit("slides:")))
    if notices is not None:
        said = notices.groupBy("deck_id").agg(F.array_sort(F.collect_set("text")).alias("__said"))
        headers = headers.join(said, "deck_id", "left")
        comments = F.transform(F.slice("__said", 1, NOTICES_SHOWN), lambda x: F.concat(F.lit("# "), F.regexp_replace(x, r"\s+", " ")))
        head = F.concat(F.coalesce(comments, F.array().cast("array<string>")), head)
    of_head = headers.select("deck_id", F.lit(0).cast("long").alias("slide_no"), F.posexplode(head).alias("place", "line"))

    fields = {"titulo": "title", "notas": "notes", "mensagem_chave": "key_message", "numero": "number"}
    first = F.concat(F.lit("- tipo: "), quoted(F.coalesce("type", F.lit("conteudo"))))
    given = [entry("  ", n, F.col(c)) for n, c in fields.items() if c in slides.columns]
    content = F.when(F.size("content") > 0, F.concat(F.array(F.lit("  conteudo:")), F.transform("content", lambda x: F.concat(F.lit("  - "), quoted(x)))))
    content = F.when(F.size("content") == 0, F.array(F.lit("  conteudo: []"))).otherwise(content)
    body = F.concat(F.array(first), F.array_compact(F.array(*given)), F.coalesce(content, F.array().cast("array<string>")))
    of_slides = slides.select("deck_id", "slide_no", F.posexplode(body).alias("place", "line"))
    return of_head.unionByName(of_slides)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, line_no, line of Markdown or text files."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), "value")
    return rows.select("doc_id", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """key, slide, text, hash, file, reused, fps, bytes, seconds, size of a media manifest."""
    entry = "slide int, texto string, hash string, arquivo string, reaproveitado boolean, fps double, bytes bigint, segundos double, px string"
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode(F.from_json("value", f"map<string, struct<{entry}>>")).alias("key", "e"))
    return rows.select("key", "e.*")
