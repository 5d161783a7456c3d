"""Layer O: several versions of one deck, by public and palette, compared slide by slide.

Signatures: version(package_id, profile, file_ord, deck_id, name, title, slides) and
slide(package_id, deck_id, slide_no, texts array, key_message, resources map).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .rules import scope

# What each profile carries, the marks of profiles in titles, files that declare a package.
RESOURCES = {
    "completo": (True, False, False, True),
    "libras": (False, True, False, True),
    "leitura_facil": (True, False, False, False),
}
TITLE_MARK = {"libras": "libras", "leitura_facil": "leitura fácil"}
DECLARATIONS = ("leia-me.md", "leia-me.txt", "readme.md", "readme.txt")
KEY_MARK = "[chave]"
SUFFIX = {"padrao": "-padrao", "alto_contraste": "-alto-contraste", "daltonico": "-daltonico-seguro"}
PROFILE_SUFFIX = {"completo": "", "libras": "-libras", "leitura_facil": "-leitura-facil"}

NAMES = ("audio", "per_slide_window", "cover_window", "all_palettes")


def package_finding(df: DataFrame, rule: str, severity: str, value: Column, detail: Column, verdict="fail") -> DataFrame:
    slide = F.col("slide_no") if "slide_no" in df.columns else F.lit(None)
    deck = F.col("deck_id") if "deck_id" in df.columns else F.lit(None)
    return df.select(
        F.col("package_id").cast("string").alias("package_id"),
        deck.cast("string").alias("deck_id"),
        F.lit(rule).alias("rule"),
        F.lit(severity).alias("severity"),
        F.lit(verdict).alias("verdict"),
        slide.cast("long").alias("slide_no"),
        value.cast("double").alias("value"),
        detail.cast("string").alias("detail"),
    )


def profile_of(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.contains("-libras"), "libras")
        .when(low.contains("-leitura-facil"), "leitura_facil")
        .otherwise("completo")
    )


def key_message(notes: Column) -> Column:
    """The text after the mark in the first line of the notes that has it, '' if none has."""
    lines = F.transform(F.split(F.coalesce(notes, F.lit("")), "\r?\n"), lambda x: F.trim(x))
    marked = F.filter(lines, lambda x: x.startswith(KEY_MARK))
    first = F.substring(F.element_at(marked, 1), len(KEY_MARK) + 1, 1 << 20)
    return F.when(F.size(marked) > 0, F.trim(first)).otherwise("")


def notes_without_key(notes: Column) -> Column:
    lines = F.split(F.coalesce(notes, F.lit("")), "\r?\n")
    return F.trim(F.array_join(F.filter(lines, lambda x: ~F.trim(x).startswith(KEY_MARK)), "\n"))


def slide_texts(shapes: DataFrame, paragraphs: DataFrame, slides: DataFrame) -> DataFrame:
    """deck_id, slide_no, texts: what is read or heard on a slide, in order (alt, text, notes)."""
    keys = ["deck_id", "slide_no"]
    shown = scope(shapes, decorative=False)
    alts = shown.filter(~T.blank(F.col("alt"))).select(
        *keys, F.struct("shape_ord", F.lit(-1).alias("p"), F.concat(F.lit("[alt] "), T.strip(F.col("alt"))).alias("t")).alias("e")
    )
    texts = scope(paragraphs, decorative=False).filter(~T.blank(F.col("text"))).select(
        *keys, F.struct("shape_ord", F.col("para_ord").alias("p"), T.strip(F.col("text")).alias("t")).alias("e")
    )
    said = notes_without_key(F.col("notes"))
    notes = slides.filter(said != "").select(
        *keys, F.struct(F.lit(1 << 30).alias("shape_ord"), F.lit(0).alias("p"), F.concat(F.lit("[notas] "), said).alias("t")).alias("e")
    )
    every = alts.unionByName(texts).unionByName(notes).groupBy(*keys).agg(F.array_sort(F.collect_list("e")).alias("es"))
    every = every.select(*keys, F.transform("es", lambda e: e["t"]).alias("texts"))
    empty = F.coalesce("texts", F.array().cast("array<string>"))
    return slides.select(*keys).join(every, keys, "left").select(*keys, empty.alias("texts"))


def resources(shapes: DataFrame) -> DataFrame:
    """deck_id, slide_no, kind, n: audio, video, other media, figures and tables."""
    kind = (
        F.when(F.col("media_kind").isin("audio", "video"), F.col("media_kind"))
        .when(F.col("media_kind").isNotNull(), "media")
        .when(F.col("tag") == "pic", "figure")
        .when((F.col("tag") == "graphicFrame") & F.col("has_table"), "table")
    )
    rows = scope(shapes).withColumn("kind", kind).filter("kind is not null")
    return rows.groupBy("deck_id", "slide_no", "kind").agg(F.count("*").alias("n"))


def pairs(versions: DataFrame) -> DataFrame:
    """package_id, profile, base_id, deck_id, same: each version with the first of its profile."""
    first = Window.partitionBy("package_id", "profile").orderBy("file_ord")
    held = versions.withColumns(
        {"base_id": F.first("deck_id").over(first), "base_slides": F.first("slides").over(first)}
    )
    held = held.filter(F.col("deck_id") != F.col("base_id"))
    return held.withColumn("same", F.col("slides") == F.col("base_slides"))


def missing(a: Column, b: Column) -> Column:
    """Items of a that b lacks, repeats kept."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def text_parity(versions: DataFrame, texts: DataFrame) -> DataFrame:
    """Numbers of slides differ, or else slides whose ordered texts differ."""
    held = pairs(versions)
    counts = held.filter("not same")
    own = held.filter("same").select("package_id", "base_id", "deck_id").join(texts, "deck_id")
    base = texts.select(F.col("deck_id").alias("base_id"), "slide_no", F.col("texts").alias("base_texts"))
    both = own.join(base, ["base_id", "slide_no"]).filter(~F.col("texts").eqNullSafe(F.col("base_texts")))
    lost, extra = missing(F.col("base_texts"), F.col("texts")), missing(F.col("texts"), F.col("base_texts"))
    both = both.withColumns({"lost": lost, "extra": extra})
    shown = F.when(F.size("lost") + F.size("extra") == 0, "order").otherwise(
        F.concat(
            F.lit("-"), F.array_join(F.slice("lost", 1, 3), " | "), F.lit(" +"), F.array_join(F.slice("extra", 1, 3), " | ")
        )
    )
    return package_finding(counts, "O01", "E", F.col("slides") - F.col("base_slides"), F.lit("slides")).unionByName(
        package_finding(both, "O01", "E", F.size("lost") + F.size("extra"), shown)
    )


def alone(versions: DataFrame) -> DataFrame:
    """O01, O02 unverified: packages of one file have nothing to be compared with."""
    one = versions.groupBy("package_id").agg(F.count("*").alias("n"), F.min("deck_id").alias("deck_id")).filter("n = 1")
    rows = [package_finding(one, rule, "E", F.lit(None), F.lit("one file"), "unverified") for rule in ("O01", "O02")]
    return rows[0].unionByName(rows[1])


def resource_parity(versions: DataFrame, counts: DataFrame) -> DataFrame:
    """Numbers of a kind of resource differ on a slide (absent: 0)."""
    held = pairs(versions).filter("same").select("package_id", "base_id", "deck_id")
    own = held.join(counts, "deck_id").select("package_id", "base_id", "deck_id", "slide_no", "kind", "n")
    base = held.join(counts.withColumnRenamed("deck_id", "base_id"), "base_id")
    base = base.select("package_id", "base_id", "deck_id", "slide_no", "kind", F.col("n").alias("m"))
    both = own.join(base, ["package_id", "base_id", "deck_id", "slide_no", "kind"], "full_outer").fillna(0, ["n", "m"])
    return package_finding(both.filter("n <> m"), "O02", "E", F.col("n") - F.col("m"), F.col("kind"))


def declared(packages: DataFrame, listing: DataFrame) -> DataFrame:
    """Packages (package_id) whose folder listing (package_id, name) has no declaration."""
    named = listing.filter(F.lower("name").isin(*DECLARATIONS)).select("package_id")
    return package_finding(packages.join(named, "package_id", "left_anti"), "O03", "A", F.lit(None), F.lit(None))


def key_parity(versions: DataFrame, keys: DataFrame, most: int = 6) -> DataFrame:
    """Key messages that another profile's first version lacks, or has alone.

    keys: deck_id, slide_no, key_message. The base is the profile 'completo', or else the first by
    name. Without any key message O04 is unverified.
    """
    order = Window.partitionBy("package_id", "profile").orderBy("file_ord")
    first = versions.withColumn("rn", F.row_number().over(order)).filter("rn = 1")
    rank = F.struct(F.when(F.col("profile") == "completo", 0).otherwise(1), F.col("profile"))
    base = first.groupBy("package_id").agg(F.min_by("deck_id", rank).alias("base_id"), F.count("*").alias("profiles"))
    others = first.join(base.filter("profiles > 1"), "package_id").filter(F.col("deck_id") != F.col("base_id"))
    others = others.select("package_id", "base_id", "deck_id")
    said = keys.filter(F.col("key_message") != "").select("deck_id", "slide_no", "key_message")
    known = said.select(F.col("deck_id").alias("base_id")).distinct()
    mute = others.join(known, "base_id", "left_anti").select("package_id").distinct()
    others = others.join(known, "base_id", "left_semi")
    of_base = others.join(said.withColumnRenamed("deck_id", "base_id"), "base_id")
    of_other = others.join(said, "deck_id")

    def top(df: DataFrame, rule: str) -> DataFrame:
        w = Window.partitionBy("package_id", "deck_id").orderBy("slide_no", "key_message")
        kept = df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most)
        return package_finding(kept, rule, "E", F.lit(None), F.col("key_message"))

    on = ["package_id", "base_id", "deck_id", "key_message"]
    return (
        top(of_base.join(of_other.select(*on), on, "left_anti"), "O04")
        .unionByName(top(of_other.join(of_base.select(*on), on, "left_anti"), "O05"))
        .unionByName(package_finding(mute, "O04", "E", F.lit(None), F.lit(None), "unverified"))
    )


def title_marks(versions: DataFrame) -> DataFrame:
    """A version for a public whose document title doesn't say so."""
    mark = F.create_map(*[F.lit(x) for kv in TITLE_MARK.items() for x in kv])[F.col("profile")]
    title = F.lower(F.coalesce("title", F.lit("")))
    bad = versions.filter(mark.isNotNull() & ~title.contains(mark))
    return package_finding(bad, "O06", "A", F.lit(None), F.col("profile"))


def resource_plan(spark) -> DataFrame:
    rows = [(p, *v) for p, v in RESOURCES.items()]
    return spark.createDataFrame(rows, "profile string, " + ", ".join(f"{n} boolean" for n in NAMES))


def declared_resources(versions: DataFrame, counts: DataFrame) -> DataFrame:
    """Audio or sign windows that differ from what the profile declares."""
    n = counts.groupBy("deck_id").agg(
        F.sum(F.when(F.col("kind") == "audio", F.col("n"))).alias("audio_n"),
        F.sum(F.when(F.col("kind") == "video", F.col("n"))).alias("video_n"),
    )
    rows = versions.join(n, "deck_id", "left").fillna(0, ["audio_n", "video_n"])
    rows = rows.join(resource_plan(versions.sparkSession), "profile")
    off = rows.filter((F.col("audio_n") > 0) != F.col("audio"))
    few = rows.filter(F.col("per_slide_window") & (F.col("video_n") < F.col("slides")))
    odd = rows.filter(~F.col("per_slide_window") & (F.col("video_n") > 0) & ~F.col("cover_window"))
    return (
        package_finding(off, "O07", "A", F.col("audio_n"), F.lit("audio"))
        .unionByName(package_finding(few, "O07", "A", F.col("video_n"), F.lit("windows")))
        .unionByName(package_finding(odd, "O07", "A", F.col("video_n"), F.lit("undeclared windows")))
    )


def build_sets(requests: DataFrame) -> DataFrame:
    """requests (other columns, profiles, modes, every_mode) with profile, mode, file_suffix instead: a row for each version
    to build. Other palettes than the standard one only for profiles that declare them, unless every_mode."""

    def known(values: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])

    all_palettes = F.col("profile").isin(*[p for p, v in RESOURCES.items() if v[NAMES.index("all_palettes")]])
    rows = requests.withColumn("profile", F.explode(F.array_distinct("profiles"))).withColumn("mode", F.explode(F.array_distinct("modes")))
    rows = rows.filter(F.col("profile").isin(*RESOURCES) & (all_palettes | F.col("every_mode") | (F.col("mode") == "padrao")))
    suffix = F.concat(known(PROFILE_SUFFIX)[F.col("profile")], known(SUFFIX)[F.col("mode")])
    return rows.withColumn("file_suffix", suffix).drop("profiles", "modes", "every_mode")


def build_set(spark, profiles: list[str], modes: list[str], every_mode: bool = False) -> DataFrame:
    """profile, mode, file_suffix of the versions of one request."""
    asked = "profiles array<string>, modes array<string>, every_mode boolean"
    return build_sets(spark.createDataFrame([(profiles, modes, every_mode)], asked))


def media_table(versions: DataFrame, counts: DataFrame) -> DataFrame:
    """package_id, profile, versions, audio, video: the package report's table."""
    n = counts.filter(F.col("kind").isin("audio", "video")).groupBy("deck_id").pivot("kind", ["audio", "video"]).sum("n")
    rows = versions.join(n, "deck_id", "left").fillna(0, ["audio", "video"])
    return rows.groupBy("package_id", "profile").agg(
        F.count("*").alias("versions"), F.sum("audio").alias("audio"), F.sum("video").alias("video")
    )
