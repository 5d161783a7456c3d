"""Derived texts and tables: readings, transcripts, subtitles, imports, profiles, validation, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ordering import numbered
from .resolve import is_title
from .rules import in_scope, scope

PK = ["deck_id", "slide_no"]

# Rates and limits.
WORDS_PER_MINUTE = 145
LEAST_BLOCK_MS = 2000
SUBTITLE_WIDTH, SUBTITLE_LINES = 42, 2
SIGN_SECONDS_PER_WORD, SIGN_SLACK, SIGN_LEAST = 1.8, 8.0, 12.0
SPEECH_DOLLARS_PER_1000 = 0.30
LINE_MOST, PARAGRAPHS_MOST, CUT_LEAST = 80, 6, 20
LEAST_VIDEO_BYTES, LEAST_FPS = 50 * 1024, 15
BUDGETS = {"libras": (2, 14, 1), "leitura_facil": (3, 18, 1)}
PLAIN_TYPES = ("capa", "secao", "citacao")
MISSING = "[FALTA: %s]"
ANNOUNCED = {"pic": "imagem", "graphicFrame": "objeto", "grpSp": "grupo", "cxnSp": "conector"}


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), T.BLANK + "+"), lambda w: w != "")


def closed(text: Column) -> Column:
    """With a full stop unless it ends in a mark."""
    return F.when(text.rlike(r"[.!?:]$"), text).otherwise(F.concat(text, F.lit(".")))


def slide_text(paragraphs: DataFrame) -> DataFrame:
    """deck_id, slide_no, text: a slide's visible paragraphs as sentences, in order."""
    rows = scope(paragraphs, decorative=False, hidden=False, cells=False).filter(~T.blank(F.col("text")))
    part = F.struct("shape_ord", "para_ord", closed(T.strip(F.col("text"))).alias("t"))
    grouped = rows.groupBy(*PK).agg(F.array_sort(F.collect_list(part)).alias("ps"))
    return grouped.select(*PK, F.array_join(F.transform("ps", lambda p: p["t"]), " ").alias("text"))


# Subtitles


def clock(ms: Column) -> Column:
    """Milliseconds as hh:mm:ss,mmm."""
    s = F.floor(ms / 1000)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(
        two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s % 3600 / 60)), F.lit(":"), two(s % 60), F.lit(","),
        F.lpad((ms % 1000).cast("string"), 3, "0"),
    )


def wrapped(words: Column, width: int = SUBTITLE_WIDTH, most: int = SUBTITLE_LINES) -> Column:
    """The first lines of words filled up to a width; what finds no line is dropped."""
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("now"))

    def step(acc: Column, w: Column) -> Column:
        fits = F.char_length(acc["now"]) + F.char_length(w) + 1 <= width
        grown = F.struct(acc["lines"].alias("lines"), F.trim(F.concat(acc["now"], F.lit(" "), w)).alias("now"))
        broken = F.struct(F.concat(acc["lines"], F.array(acc["now"])).alias("lines"), w.alias("now"))
        return F.when(F.size(acc["lines"]) >= most, acc).when(fits, grown).otherwise(broken)

    done = lambda a: F.when(
        (a["now"] != "") & (F.size(a["lines"]) < most), F.concat(a["lines"], F.array(a["now"]))
    ).otherwise(F.slice(a["lines"], 1, most))
    return F.aggregate(words, start, step, done)


def subtitles(blocks: DataFrame, key: str = "deck_id", order: str = "slide_no") -> DataFrame:
    """key, order, n, start_ms, end_ms, lines, dropped_words of text blocks: each lasts as its words take
    to say (145 a minute, 2 s at least) and begins where the one before ends."""
    rows = blocks.withColumn("__w", word_list(F.col("text")))
    took = F.greatest(F.lit(LEAST_BLOCK_MS), F.round(F.size("__w") * 60000.0 / WORDS_PER_MINUTE).cast("long"))
    rows = rows.withColumns({"__ms": took, "lines": wrapped(F.col("__w"))})
    shown = F.aggregate("lines", F.lit(0), lambda a, x: a + F.size(F.filter(F.split(x, " "), lambda y: y != "")))
    rows = rows.select(key, order, "__ms", "lines", (F.size("__w") - shown).alias("dropped_words"))
    timed = numbered(rows, [key], [F.col(order)], "n", {"end_ms": F.col("__ms")})
    start = (F.col("end_ms") - F.col("__ms")).alias("start_ms")
    return timed.select(key, order, F.col("n").cast("int").alias("n"), start, "end_ms", "lines", "dropped_words")


def srt(timed: DataFrame, key: str = "deck_id") -> DataFrame:
    """key, srt: the subtitle file of each key."""
    block = F.concat_ws("\n", F.col("n").cast("string"), F.concat(clock(F.col("start_ms")), F.lit(" --> "), clock(F.col("end_ms"))), F.array_join("lines", "\n"), F.lit(""))
    rows = timed.select(key, F.struct("n", block.alias("b")).alias("s")).groupBy(key)
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["b"]), "\n").alias("srt"))


def sign_seconds(text: Column) -> Column:
    return F.greatest(F.lit(SIGN_LEAST), F.size(word_list(text)) * SIGN_SECONDS_PER_WORD + SIGN_SLACK)


def speech_cost(texts: DataFrame, key: str = "deck_id") -> DataFrame:
    """key, chars, dollars of speaking all texts."""
    n = texts.groupBy(key).agg(F.sum(F.char_length("text")).alias("chars"))
    return n.withColumn("dollars", F.round(F.col("chars") / 1000 * SPEECH_DOLLARS_PER_1000, 2))


# Content cache


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def cache_reuse(texts: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """key, hash, reused: equal hash in the manifest (key, hash), and a file (key, bytes, fps) that is
    large enough and moves."""
    rows = texts.select("key", content_hash(F.col("text")).alias("hash"))
    old = manifest.select("key", F.col("hash").alias("old"))
    joined = rows.join(old, "key", "left").join(files.select("key", "bytes", "fps"), "key", "left")
    good = (F.col("hash") == F.col("old")) & (F.col("bytes") >= LEAST_VIDEO_BYTES) & (F.col("fps") > 0)
    return joined.select("key", "hash", F.coalesce(good, F.lit(False)).alias("reused"))


def frame_rate(fraction: Column) -> Column:
    """'30000/1001' as a number; null without a denominator."""
    parts = F.split(fraction, "/")
    return parts[0].cast("double") / F.nullif(F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).cast("double"), F.lit(0.0))


def slow_videos(videos: DataFrame) -> DataFrame:
    """deck_id, n of videos below 15 frames a second."""
    return videos.groupBy("deck_id").agg(F.count_if(F.col("fps") < LEAST_FPS).alias("n"))


# Readings


def with_total(slides: DataFrame) -> DataFrame:
    """slides with total, the number of slides of their deck."""
    n = slides.groupBy(F.col("deck_id").alias("__deck")).agg(F.count("*").alias("total"))
    return slides.join(n, F.col("deck_id").eqNullSafe(F.col("__deck"))).drop("__deck")


def reading(slides: DataFrame, shapes: DataFrame, paragraphs: DataFrame, cells: DataFrame) -> DataFrame:
    """deck_id, slide_no, ord, sub, line: what a screen reader announces, in order.

    Title first; then texts (bullets named), tables with their headers, other shapes by description;
    notes last. Decorative and hidden shapes are silent.
    """
    key = [*PK, "shape_ord"]
    kinds = {"tbl_ord": "int", "ri": "int", "ci": "int", "text": "string", "title": "string", "shown": "boolean", "has_table": "boolean"}
    kinds |= {"first_row": "boolean", "total": "long"}

    def part(rows: DataFrame, kind: str, **columns: Column) -> DataFrame:
        own = [columns.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]
        ord_ = F.col("shape_ord") if "shape_ord" in rows.columns else F.lit(None).cast("int")
        return rows.select(*PK, ord_.alias("shape_ord"), F.lit(kind).alias("kind"), *own)

    name = F.coalesce(F.create_map(*[F.lit(x) for kv in ANNOUNCED.items() for x in kv])[F.col("tag")], F.lit("objeto"))
    alt = F.when(T.blank(F.col("alt")), "SEM TEXTO ALTERNATIVO").otherwise(T.strip(F.col("alt")))
    title = F.when(is_title(F.col("ph_type")), F.coalesce(T.strip(F.col("text")), F.lit("")))
    shown = in_scope(shapes.columns, decorative=False, hidden=False)
    rows = part(scope(shapes), "shape", text=F.concat_ws(", ", name, alt), title=title, shown=shown, has_table=F.col("has_table"))
    mark = F.when(F.col("bullet").isin("buChar", "buAutoNum"), "marcador, ").otherwise("")
    texts = scope(paragraphs, cells=False).filter(~T.blank(F.col("text")))
    rows = rows.unionByName(part(texts, "text", ri=F.col("para_ord"), text=F.concat(mark, T.strip(F.col("text")))))
    own = {c: F.col(c) for c in ("tbl_ord", "ri", "ci", "first_row")}
    rows = rows.unionByName(part(cells, "cell", text=T.strip(F.coalesce("text", F.lit(""))), **own))
    rows = rows.unionByName(part(with_total(slides), "slide", total=F.col("total")))

    # all rows of a slide are dealt together once and sorted once, by the longest key
    kind, over = F.col("kind"), Window.partitionBy
    heading = F.coalesce((F.col("ri") == 0) & F.col("first_row"), F.lit(False))
    of_shape = over(*key)
    rows = rows.repartition(*PK).withColumn("h", F.max(F.when((kind == "cell") & heading, F.col("text"))).over(over(*key, "tbl_ord", "ci")))
    rows = rows.withColumns(
        {
            "shown": F.bool_or("shown").over(of_shape),
            "has_table": F.bool_or("has_table").over(of_shape),
            "told": F.bool_or(kind == "text").over(of_shape),
        }
    )
    rows = rows.withColumn("t", F.min(F.when(F.col("title").isNotNull(), F.struct("shape_ord", "title"))).over(over(*PK)))
    table = F.col("has_table")
    said = ((kind == "text") & ~table) | ((kind == "shape") & ~table & ~F.col("told")) | ((kind == "cell") & table & ~((F.col("ri") == 0) & F.col("first_row")))
    rows = rows.filter((kind == "slide") | (F.col("shown") & ~F.col("shape_ord").eqNullSafe(F.col("t.shape_ord")) & said))
    value = F.concat_ws(": ", F.nullif("h", F.lit("")), F.when(F.col("text") == "", "vazio").otherwise(F.col("text")))
    first = F.format_string("Slide %d de %d: %s", "slide_no", "total", F.coalesce(F.nullif("t.title", F.lit("")), F.lit("SEM TITULO")))
    line = F.when(kind == "cell", value).when(kind == "slide", first).otherwise(F.col("text"))
    lines = rows.groupBy(*key, "kind", "tbl_ord", "ri").agg(F.array_sort(F.collect_list(F.struct("ci", line.alias("v")))).alias("cs"))
    values = F.transform("cs", lambda c: c["v"])
    sub = F.when(kind == "cell", F.col("tbl_ord") * 10000 + F.col("ri")).otherwise(F.coalesce("ri", F.lit(0)))
    ord_ = F.when(kind == "slide", -1).otherwise(F.col("shape_ord"))
    lines = lines.select(*PK, ord_.alias("ord"), sub.alias("sub"), F.explode(F.when(kind == "cell", F.array(F.array_join(values, ", "))).otherwise(values)).alias("line"))
    notes = slides.filter(~T.blank(F.col("notes"))).select(*PK, F.lit(1 << 30).alias("ord"), F.posexplode(F.split("notes", "\r?\n")).alias("sub", "line"))
    return lines.unionByName(notes.filter(~T.blank(F.col("line"))))


def transcript(lines: DataFrame) -> DataFrame:
    """deck_id, transcript, lines: the announced lines of a deck in order, put together by slides first."""
    of_slide = lines.groupBy(*PK).agg(F.array_sort(F.collect_list(F.struct("ord", "sub", "line"))).alias("ls"))
    said = F.filter(F.transform("ls", lambda x: x["line"]), lambda x: x.isNotNull())
    text = F.when(F.size(said) > 0, F.array_join(said, "\n")).alias("text")
    grouped = of_slide.select(*PK, text, F.size("ls").alias("n")).groupBy("deck_id")
    grouped = grouped.agg(F.array_sort(F.collect_list(F.struct("slide_no", "text"))).alias("ss"), F.sum("n").cast("int").alias("lines"))
    return grouped.select("deck_id", F.array_join(F.transform("ss", lambda x: x["text"]), "\n").alias("transcript"), "lines")


def audio_script(slides: DataFrame, texts: DataFrame, titles: DataFrame) -> DataFrame:
    """deck_id, slide_no, script: 'Slide i de n. title.', the body, and the figure's description from
    the notes. texts: body by slide; titles: title by slide."""
    rows = with_total(slides).join(texts.select(*PK, F.col("text").alias("body")), PK, "left")
    rows = rows.join(titles.select(*PK, F.col("text").alias("title")), PK, "left")
    named = F.coalesce(F.nullif("title", F.lit("")), F.lit("Sem título"))
    figure = F.regexp_extract(F.coalesce("notes", F.lit("")), r"(?s)Descrição da figura:\s*(.+)", 1)
    figure = F.array_join(word_list(figure), " ")
    said = F.when(figure != "", F.concat(F.lit("Descrição da figura. "), figure))
    return rows.select(*PK, F.concat_ws(" ", F.format_string("Slide %d de %d. %s.", "slide_no", "total", named), F.nullif("body", F.lit("")), said).alias("script"))


# Imports and scripts


def text_blocks(lines: DataFrame) -> DataFrame:
    """doc_id, block, title, pos, text of Markdown or plain lines (doc_id, line_no, line).

    A heading opens a block; text before any heading opens one with its first 60 characters; list
    marks go. Rows with pos 0 and null text are blocks without paragraphs.
    """
    heading = F.nullif(F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.+?)\s*#*$", 1)), F.lit(""))
    bare = F.regexp_replace(T.strip(F.col("line")), r"^[-*+•]\s+", "")
    rows = lines.select("doc_id", "line_no", heading.alias("h"), bare.alias("t")).filter("h is not null or t <> ''")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = rows.withColumn("rn", F.row_number().over(w))
    opens = F.col("h").isNotNull() | (F.col("rn") == 1)
    rows = rows.withColumns({"opens": opens, "block": F.sum(opens.cast("int")).over(w)})
    title = F.when(F.col("opens"), F.coalesce("h", F.substring("t", 1, 60)))
    b = Window.partitionBy("doc_id", "block").orderBy("line_no")
    rows = rows.withColumns({"title": F.first(title, ignorenulls=True).over(b), "n": F.count("*").over(Window.partitionBy("doc_id", "block")), "pos": F.row_number().over(b) - 1})
    kept = rows.filter("not opens or n = 1")
    return kept.select("doc_id", "block", "title", "pos", F.when(~F.col("opens"), F.col("t")).alias("text"))


def shortened(text: Column, most: int = LINE_MOST) -> Column:
    """A paragraph as lines of at most `most` characters: cut after the last full stop and blank, or
    else blank, before the limit; not before character 20."""
    start = F.struct(F.array().cast("array<string>").alias("out"), text.alias("rest"), F.lit(False).alias("stuck"))

    def step(acc: Column, _: Column) -> Column:
        head = F.substring(acc["rest"], 1, most)
        stop = F.char_length(F.regexp_extract(head, r"(?s)^(.*)\. ", 1))
        stop = F.when(head.contains(". "), stop).otherwise(-1)
        blank = F.when(head.contains(" "), F.char_length(F.regexp_extract(head, r"(?s)^(.*) ", 1))).otherwise(-1)
        cut = F.when(stop >= CUT_LEAST, stop).otherwise(blank)
        done = (F.char_length(acc["rest"]) <= most) | acc["stuck"]
        part = F.trim(acc["rest"].substr(F.lit(1), cut + 1))
        rest = F.trim(acc["rest"].substr(cut + 2, F.char_length(acc["rest"])))
        stuck = F.struct(acc["out"].alias("out"), acc["rest"].alias("rest"), F.lit(True).alias("stuck"))
        moved = F.struct(F.concat(acc["out"], F.array(part)).alias("out"), rest.alias("rest"), F.lit(False).alias("stuck"))
        return F.when(done, acc).when(cut < CUT_LEAST, stuck).otherwise(moved)

    rounds = F.sequence(F.lit(0), F.floor(F.char_length(text) / CUT_LEAST).cast("int"))
    end = lambda a: F.when(a["rest"] != "", F.concat(a["out"], F.array(a["rest"]))).otherwise(a["out"])
    return F.aggregate(rounds, start, step, end)


def import_slides(blocks: DataFrame) -> DataFrame:
    """doc_id, slide_no, title, content of text blocks: short lines, six to a slide, titles numbered
    '(k de n)' where a block takes several slides; slide 1 is the cover."""
    rows = blocks.select("doc_id", "block", "title", "pos", F.posexplode_outer(shortened(F.col("text"))).alias("k", "line"))
    w = Window.partitionBy("doc_id", "block").orderBy("pos", "k")
    rows = rows.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / PARAGRAPHS_MOST))
    part = F.struct("pos", "k", "line")
    grouped = rows.groupBy("doc_id", "block", "title", "chunk").agg(F.array_sort(F.collect_list(part)).alias("ps"))
    n = F.count("*").over(Window.partitionBy("doc_id", "block"))
    lines = F.filter(F.transform("ps", lambda p: p["line"]), lambda x: x.isNotNull())
    lines = F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit(MISSING % "conteúdo deste slide")))
    rows = grouped.withColumns({"n": n, "content": lines}).filter("not (block = 1 and size(filter(ps, p -> p.line is not null)) = 0)")
    titled = F.when(F.col("n") > 1, F.format_string("%s (%d de %d)", "title", F.col("chunk") + 1, "n")).otherwise(F.col("title"))
    order = Window.partitionBy("doc_id").orderBy("block", "chunk")
    body = rows.select("doc_id", (F.row_number().over(order) + 1).cast("long").alias("slide_no"), titled.alias("title"), "content")
    cover = blocks.filter("block = 1").groupBy("doc_id").agg(F.first("title").alias("title"))
    cover = cover.select("doc_id", F.lit(1).cast("long").alias("slide_no"), "title", F.array(F.lit(MISSING % "subtítulo, autor e contexto")).alias("content"))
    return cover.unionByName(body)


def count_missing(rows: DataFrame, column: str = "content", key: str = "doc_id") -> DataFrame:
    """key, n: texts still to be written."""
    return rows.groupBy(key).agg(F.sum(F.size(F.filter(column, lambda x: x.startswith("[FALTA:")))).alias("n"))


def validate_script(slides: DataFrame) -> DataFrame:
    """deck_id, slide_no, error: a script's slides (type, title, content, number, cards, columns) that the
    builder refuses."""
    title = T.strip(F.coalesce("title", F.lit("")))
    same = Window.partitionBy("deck_id", F.lower(title)).orderBy("slide_no")
    slides = slides.withColumn("__nth", F.row_number().over(same))
    again = F.col("__nth") > 1
    n = F.coalesce(F.size("content"), F.lit(0))
    tests = {
        "title missing": title == "",
        "title repeated": again & (title != ""),
        "too many paragraphs": n > PARAGRAPHS_MOST,
        "number missing": (F.col("type") == "destaque") & F.col("number").isNull(),
        "cards missing": (F.col("type") == "cartoes") & (F.coalesce("cards", F.lit(0)) == 0),
        "not two columns": (F.col("type") == "comparacao") & (F.coalesce("columns", F.lit(0)) != 2),
    }
    found = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in tests.items()]))
    return slides.select("deck_id", "slide_no", F.explode(found).alias("error"))


def first_error(errors: DataFrame) -> DataFrame:
    """deck_id, slide_no, error: the error at which a script is refused."""
    first = errors.groupBy("deck_id").agg(F.min(F.struct("slide_no", "error")).alias("e"))
    return first.select("deck_id", "e.slide_no", "e.error")


def over_budget(lines: DataFrame, budgets: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """deck_id, slide_no, cause, value: slides (profile, lines) beyond their profile's paragraphs, words a
    line or sentences a line."""
    plan = [(k, *v) for k, v in (budgets or BUDGETS).items()]
    b = lines.sparkSession.createDataFrame(plan, "profile string, paragraphs int, words int, sentences int")
    rows = lines.join(b, "profile")
    if "type" in rows.columns:
        rows = rows.filter(~F.coalesce(F.col("type").isin(*PLAIN_TYPES), F.lit(False)))
    n = F.size("lines")
    words = F.array_max(F.transform("lines", lambda x: F.size(word_list(x))))
    sentences = F.array_max(F.transform("lines", lambda x: F.size(F.filter(F.split(x, "[.!?;]+"), lambda s: ~T.blank(s)))))
    tests = F.array(
        F.when(n > F.col("paragraphs"), F.struct(F.lit("paragraphs").alias("cause"), n.alias("value"))),
        F.when(words > F.col("words"), F.struct(F.lit("words").alias("cause"), words.alias("value"))),
        F.when(sentences > F.col("sentences"), F.struct(F.lit("sentences").alias("cause"), sentences.alias("value"))),
    )
    return rows.select("deck_id", "slide_no", F.explode(F.array_compact(tests)).alias("e")).select("deck_id", "slide_no", "e.*")


def project_profile(slides: DataFrame, profile: str) -> DataFrame:
    """Slides for a public: own title and lines if given, else the key message; rich types become plain.

    slides: deck_id, slide_no, type, title, content, key_message, own_title, own_content. With error
    where neither exists.
    """
    plain = F.coalesce(F.col("type").isin(*PLAIN_TYPES), F.lit(False))
    own = F.size(F.coalesce("own_content", F.array().cast("array<string>"))) > 0
    key = F.coalesce("key_message", F.lit(""))
    content = F.when(plain, F.col("content")).when(own, F.col("own_content")).when(key != "", F.array(key))
    kind = F.when(F.col("type").isin("cartoes", "comparacao", "destaque"), "conteudo").otherwise(F.col("type"))
    return slides.select(
        "deck_id",
        "slide_no",
        F.lit(profile).alias("profile"),
        kind.alias("type"),
        F.coalesce(F.nullif("own_title", F.lit("")), F.col("title")).alias("title"),
        content.alias("content"),
        F.when(~plain & ~own & (key == ""), "no key message").alias("error"),
    )


def section_slides(slides: DataFrame, sections: DataFrame, name: str) -> DataFrame:
    """The slides (slide_id) of a named section (deck_id, name, slide_ids)."""
    ids = sections.filter(F.lower("name") == name.lower()).select("deck_id", F.explode("slide_ids").alias("slide_id"))
    return slides.join(ids, ["deck_id", "slide_id"], "left_semi")


def media_after_title(shapes: DataFrame) -> DataFrame:
    """shapes with new_ord: media moved right behind the title, all else in order.

    A place is counted (what goes before, and own rank so far), so that rows are sorted once, by shape_ord.
    """
    rank = F.when(is_title(F.col("ph_type")), 0).when(F.col("media_kind").isNotNull(), 1).otherwise(2)
    order = Window.partitionBy(*PK).orderBy("shape_ord")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.min(F.when(is_title(F.col("ph_type")), F.col("shape_ord"))).over(whole)
    rank = F.when(before.isNull(), 1).when((F.col("shape_ord") < before) & F.col("media_kind").isNull(), 0).otherwise(rank)
    of = [F.count_if(F.col("__rank") == r) for r in range(3)]
    place = F.when(F.col("__rank") == 0, of[0].over(upto)).when(F.col("__rank") == 1, of[0].over(whole) + of[1].over(upto))
    place = place.otherwise(of[0].over(whole) + of[1].over(whole) + of[2].over(upto))
    return shapes.withColumn("__rank", rank).withColumn("new_ord", (place - 1).cast("int")).drop("__rank")


def assign_tracks(slides: DataFrame, tracks: DataFrame) -> DataFrame:
    """deck_id, slide_no, track: tracks (deck_id, track_no from 0, track) in cycles from slide 2 on if there
    are more slides than tracks, else one by one."""
    n = tracks.groupBy("deck_id").agg(F.count("*").alias("n"))
    rows = with_total(slides).join(n, "deck_id")
    more = F.col("total") > F.col("n")
    place = F.when(more, F.pmod(F.col("slide_no") - 2, F.col("n"))).otherwise(F.col("slide_no") - 1)
    rows = rows.filter(~(more & (F.col("slide_no") == 1))).withColumn("track_no", place)
    return rows.join(tracks, ["deck_id", "track_no"]).select("deck_id", "slide_no", "track")
