"""Rules on hand-written decks: planted defects are found, a sound deck has none."""

import io
import zipfile

import pytest

from conforma.functions import colour as C
from conforma.functions import grid as G
from conforma.operators import design, imports, package, report, rules, transform
from conforma.sources import pptx
from pyspark.sql import functions as F

NS = (
    'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
)
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
KIND = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def shape(name, text="", ph="body", tag="sp", alt="", box=None, props="", run="", extra=""):
    x, y, w, h = box or (G.cm(2), G.cm(5), G.cm(28), G.cm(11))
    place = f'<p:nvPr>{f"""<p:ph type="{ph}"/>""" if ph else ""}</p:nvPr>'
    paragraphs = "".join(f'<a:p><a:pPr {props}/><a:r><a:rPr lang="pt-BR" sz="2400" {run}/><a:t>{t}</a:t></a:r></a:p>' for t in text.split("\n"))
    body = f"<p:txBody>{paragraphs}</p:txBody>" if tag == "sp" else extra
    return (
        f'<p:{tag}><p:nvXPr><p:cNvPr id="1" name="{name}" descr="{alt}"/><p:cNvSpPr/>{place}</p:nvXPr>'
        f'<p:spPr><a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="{w}" cy="{h}"/></a:xfrm></p:spPr>{body}</p:{tag}>'
    )


def deck(slides, title="Aula sobre acessibilidade", language="pt-BR", author="Ana"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ids = "".join(f'<p:sldId id="{256 + i}" r:id="rId{i + 1}"/>' for i in range(len(slides)))
        z.writestr("ppt/presentation.xml", f'<p:presentation {NS}><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="{G.WIDTH}" cy="{G.HEIGHT}"/></p:presentation>')
        rel = "".join(f'<Relationship Id="rId{i + 1}" Type="{KIND}/slide" Target="slides/slide{i + 1}.xml"/>' for i in range(len(slides)))
        z.writestr("ppt/_rels/presentation.xml.rels", f'<Relationships xmlns="{RELS}">{rel}</Relationships>')
        z.writestr("docProps/core.xml", f'<c xmlns:dc="d"><dc:title>{title}</dc:title><dc:creator>{author}</dc:creator><dc:language>{language}</dc:language></c>')
        for i, body in enumerate(slides):
            z.writestr(f"ppt/slides/slide{i + 1}.xml", f"<p:sld {NS}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>")
    return out.getvalue()


TITLE_BOX = (G.cm(2), G.cm(1.5), G.cm(28), G.cm(2))


def facts(spark, tmp_path, **files):
    for name, raw in files.items():
        (tmp_path / f"{name}.pptx").write_bytes(raw)
    return pptx.read_decks(spark, str(tmp_path))


def run_rules(t):
    runs = t["run"].withColumn("size", F.col("sz"))
    paragraphs = t["paragraph"].withColumn("max_size", F.lit(2400))
    return report.union(
        [
            rules.metadata(t["deck"]), rules.run_language(t["run"]), rules.titles(t["slide"], t["shape"]), rules.loose_text(t["shape"]),
            rules.typed_bullets(paragraphs), rules.title_first(t["shape"]), rules.reading_order(t["shape"], t["deck"]),
            rules.objects(t["shape"], t["deck"]), rules.alt_text(t["shape"], t["slide"]), rules.crowded(paragraphs), rules.shouted(paragraphs),
            rules.paragraph_setting(paragraphs), rules.run_setting(runs), rules.unexplained_acronyms(paragraphs),
            design.outside(t["shape"]), design.overlapping(t["shape"]), design.visual_order(t["shape"]), design.small_figures(t["shape"]),
        ]
    )


def test_planted_defects_are_found(spark, tmp_path):
    bad = deck(
        [
            shape("Corpo", "- item digitado\nTEXTO TODO MAIUSCULO AQUI", props='algn="just"', run='i="1"') + shape("Titulo", "Resultados", "title", box=TITLE_BOX),
            shape("Titulo", "Resultados", "title", box=TITLE_BOX) + shape("Rectangle 3", "solto", None) + shape("Foto", tag="pic", ph=None, alt="imagem.png", box=(G.cm(3), G.cm(6), G.cm(2), G.cm(2))),
            shape("Corpo", "Uma linha " + "muito " * 20 + "longa sobre QWXZ") + shape("Foto", tag="pic", ph=None, box=(G.WIDTH + 5, 0, 9, 9)),
        ],
        title="", language="en-US", author="user",
    )
    found = {r.rule for r in run_rules(facts(spark, tmp_path, ruim=bad)).filter("verdict = 'fail'").select("rule").distinct().collect()}
    assert {"A01", "A02", "A04", "B01", "B03", "B05", "B09", "C01", "C05", "C06", "D01", "D03", "F04", "F06", "F07", "F10", "N02", "N03", "N04", "N10"} <= found


def test_sound_deck_has_no_failures(spark, tmp_path):
    good = deck(
        [
            shape("Titulo", "Abertura", "title", box=TITLE_BOX, run='b="1"').replace('sz="2400"', 'sz="3400"') + shape("Corpo", "Frase curta.\nOutra frase."),
            shape("Titulo", "Resumo", "title", box=TITLE_BOX).replace('sz="2400"', 'sz="3400"') + shape("Corpo", "Mais uma frase."),
        ]
    )
    assert run_rules(facts(spark, tmp_path, bom=good)).filter("verdict = 'fail'").collect() == []


def test_broken_file_is_an_error_row(spark, tmp_path):
    t = facts(spark, tmp_path, quebrado=b"no zip")
    assert t["deck"].count() == 0 and t["error"].count() == 1


@pytest.mark.parametrize("a, b, ratio", [("1A1A1A", "FAF7F2", 16.29), ("1A1A1A", "F5F5F0", 15.91), ("000000", "FFFFFF", 21.0), ("FFFFFF", "FFFFFF", 1.0)])
def test_contrast(spark, a, b, ratio):
    got = spark.range(1).select(C.contrast(C.parse_hex(F.lit(a)), C.parse_hex(F.lit(b))).alias("r")).head().r
    assert round(got, 2) == ratio


def test_colour_modifiers(spark):
    mods = F.array(F.struct(F.lit("lumMod").alias("name"), F.lit(50000).alias("val")))
    df = spark.range(1).select(
        C.to_hex(C.modified(C.parse_hex(F.lit("#8080FF")), mods)).alias("half"), C.to_hex(C.shade(C.parse_hex(F.lit("FFFFFF")), F.lit(0.0))).alias("black"),
        C.to_hex(C.tint(C.parse_hex(F.lit("000000")), F.lit(0.0))).alias("white"), C.parse_hex(F.lit("xyz")).alias("none"), C.to_hex(C.preset(F.lit("green"))).alias("green"),
    ).head()
    assert (df.half, df.black, df.white, df.none, df.green) == ("0000C0", "000000", "FFFFFF", None, "008000")


def test_contrast_findings(spark):
    rows = [("d", 1, 0, 0, False, "t", "CCCCCC", "FFFFFF", None, 1600, False), ("d", 2, 0, 0, False, "t", "999999", "FFFFFF", None, 2000, False),
            ("d", 3, 0, 0, False, "t", "000000", "FFFFFF", None, 2000, False), ("d", 4, 0, 0, False, "t", None, "FFFFFF", "picture fill", 2000, False)]
    df = spark.createDataFrame(rows, "deck_id string, slide_no long, shape_ord int, depth int, decorative boolean, text string, fg string, bg string, reason string, size int, bold boolean")
    assert sorted((r.rule, r.slide_no) for r in rules.contrast(df).collect()) == [("E01", 1), ("E02", 2), ("E08", 3), ("E09", 4)]


def test_overlap_needs_a_tenth(spark):
    rows = [("d", 1, 0, 0, 0, 10), ("d", 1, 1, 5, 0, 10), ("d", 1, 2, 100, 0, 10), ("d", 2, 0, 0, 0, 10)]
    df = spark.createDataFrame([(*r[:3], 0, False, False, r[3] * 10**6, r[4], r[5] * 10**6, 10**6) for r in rows], "deck_id string, slide_no long, shape_ord int, depth int, decorative boolean, hidden boolean, x long, y long, cx long, cy long")
    assert [(r.slide_no, r.shape_ord, r.detail, r.value) for r in design.overlapping(df).collect()] == [(1, 0, "1", 0.5)]


def test_parity_of_versions(spark):
    v = spark.createDataFrame([("p", "completo", 0, "a", "Aula", 2), ("p", "completo", 1, "b", "Aula", 2), ("p", "libras", 0, "c", "Aula", 2)], "package_id string, profile string, file_ord int, deck_id string, title string, slides int")
    t = spark.createDataFrame([("a", 1, ["x", "y"]), ("b", 1, ["y", "x"]), ("a", 2, ["z"]), ("b", 2, ["z"])], "deck_id string, slide_no int, texts array<string>")
    assert [(r.slide_no, r.detail) for r in package.text_parity(v, t).collect()] == [(1, "order")]
    keys = spark.createDataFrame([("a", 1, "m1"), ("a", 2, "m2"), ("c", 1, "m1"), ("c", 2, "m3")], "deck_id string, slide_no int, key_message string")
    assert sorted((r.rule, r.detail) for r in package.key_parity(v, keys).collect()) == [("O04", "m2"), ("O05", "m3")]
    counts = spark.createDataFrame([("a", 1, "audio", 1)], "deck_id string, slide_no int, kind string, n int")
    assert sorted(r.deck_id for r in package.declared_resources(v, counts).collect()) == ["b", "c"]
    assert [(r.rule, r.detail) for r in package.resource_parity(v, counts).collect()] == [("O02", "audio")]
    assert [r.deck_id for r in package.title_marks(v).collect()] == ["c"]
    one = spark.createDataFrame([("q", "completo", 0, "e", "Aula", 2)], v.schema).unionByName(v)
    assert sorted((r.package_id, r.rule, r.verdict) for r in package.alone(one).collect()) == [("q", "O01", "unverified"), ("q", "O02", "unverified")]


def test_key_message_and_hash(spark):
    r = spark.range(1).select(package.key_message(F.lit("a\n [chave] tudo claro \nb")).alias("k"), package.notes_without_key(F.lit("a\n[chave] x\nb")).alias("n"), transform.content_hash(F.lit("abc")).alias("h"), transform.frame_rate(F.lit("30000/1001")).alias("f")).head()
    assert (r.k, r.n, r.h) == ("tudo claro", "a\nb", "ba7816bf8f01cfea") and round(r.f, 2) == 29.97


def test_reading_and_transcript(spark, tmp_path):
    t = facts(spark, tmp_path, a=deck([shape("Titulo", "Abertura", "title", box=TITLE_BOX) + shape("Corpo", "Um.\nDois.") + shape("Foto", tag="pic", ph=None, alt="Gato")]))
    lines = transform.reading(t["slide"], t["shape"], t["paragraph"], t["table_cell"])
    assert transform.transcript(lines).head().transcript == "Slide 1 de 1: Abertura\nUm.\nDois.\nimagem, Gato"
    assert transform.slide_text(t["paragraph"]).head().text == "Abertura. Um. Dois."


def test_profiles(spark):
    df = spark.createDataFrame([("d", 1, "cartoes", "T", ["a"], "m", None, None), ("d", 2, None, "U", ["a"], None, "Curto", ["b"]), ("d", 3, None, "V", ["a"], None, None, None)], "deck_id string, slide_no int, type string, title string, content array<string>, key_message string, own_title string, own_content array<string>")
    got = [(r.type, r.title, r.content, r.error) for r in transform.project_profile(df, "libras").orderBy("slide_no").collect()]
    assert got == [("conteudo", "T", ["m"], None), (None, "Curto", ["b"], None), (None, "V", None, "no key message")]


def test_report_outputs(spark):
    rows = [("d", "B01", "E", "fail", 1, None, None, None, "a|b"), ("d", "F07", "A", "fail", 2, None, None, 1.0, "c"), ("e", "M01", "—", "unverified", None, None, None, None, None)]
    f = spark.createDataFrame(rows, "deck_id string, rule string, severity string, verdict string, slide_no long, shape_ord int, para_ord int, value double, detail string")
    decks = spark.createDataFrame([("d",), ("e",)], "deck_id string")
    assert {r.deck_id: r.gate_open for r in report.gate(decks, f).collect()} == {"d": False, "e": True}
    assert "| B01 | E | fail | 1 | a\\|b |" in {r.deck_id: r.markdown for r in report.as_markdown(f).collect()}["d"]
    assert '"errors":1' in {r.deck_id: r.json for r in report.as_json(f, report.evaluated(decks, ["B01"])).collect()}["d"]


def test_stream(spark, tmp_path):
    from conforma.streaming import drop_folder

    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").write.parquet(str(tmp_path / "in"))
    docs = drop_folder.read_documents(spark, str(tmp_path / "in"))
    drop_folder.audit_stream(docs, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    from conforma.plans import queries as Q

    want = Q._text_findings(spark, "/root/testdata/sf0.001").count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want


def test_deck_becomes_a_script(spark, tmp_path):
    def cell(*texts):
        return "<a:tc><a:txBody>" + "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in texts) + "</a:txBody></a:tc>"

    grid = f'<a:tbl><a:tblPr/><a:tr>{cell(" ")}{cell("")}</a:tr><a:tr>{cell("Ano")}{cell("Total ", "geral")}</a:tr><a:tr>{cell("2024")}{cell("7")}</a:tr></a:tbl>'
    t = facts(spark, tmp_path, aula=deck([
        shape("Titulo", "Rascunho", "title") + shape("Titulo", " Linhas\nde ônibus ", "title") + shape("Corpo", "Um.\n \nDois."),
        shape("Foto", tag="pic", ph=None, alt="imagem 3") + shape("", tag="pic", ph=None) + shape("Dados", tag="graphicFrame", ph=None, extra=grid),
        "",
    ], author=" "))
    script, notices = imports.import_decks(t["slide"], t["shape"], t["paragraph"], t["table_cell"])
    a, b, c = script.orderBy("slide_no").collect()
    assert (a.title, a.content, a.figure, a.table, a.notes) == ("Linhas de ônibus", ["Um.", "Dois."], None, None, None)
    assert (b.title, b.content, b.figure.name) == ("[FALTA: título do slide 2]", [], "Foto")
    assert b.figure.alt == "[FALTA: texto alternativo real, o atual é 'imagem 3']"
    assert (b.table.header, b.table.rows) == (["Ano", "Total geral"], [["2024", "7"]])
    assert (c.title, c.content) == ("[FALTA: título do slide 3]", [])
    got = {(r.slide_no, r.cause): r.n for r in notices.collect()}
    assert got == {(2, "title"): 1, (2, "generic_alt"): 1, (2, "alt"): 1, (2, "figures"): 2, (2, "header"): 1, (3, "title"): 1}
    head = imports.import_headers(t["deck"]).head()
    assert (head.title, head.author, head.language) == ("Aula sobre acessibilidade", "[FALTA: autor]", "pt-BR")


def test_yaml_scripts_equal_json_ones(spark, tmp_path):
    import json

    yaml = pytest.importorskip("yaml")
    from conforma.sources import scripts

    script = {"apresentacao": {"titulo": "Aula", "autor": "Ana"}, "slides": [{"titulo": "Um", "conteudo": ["a: b", "c"]}, {"tipo": "capa", "numero": "7"}]}
    for kind, text in (("json", json.dumps(script)), ("yaml", yaml.safe_dump(script))):
        (tmp_path / kind).mkdir()
        (tmp_path / kind / "s").write_text(text)
    (tmp_path / "yaml" / "broken").write_text("a: [")
    *got, errors = scripts.read_yaml_scripts(spark, str(tmp_path / "yaml"))
    for a, b in zip(got, scripts.read_scripts(spark, str(tmp_path / "json")), strict=True):
        a, b = ([r.asDict(True) | {"deck_id": None} for r in x.orderBy(x.columns[1]).collect()] for x in (a, b))
        assert a == b and a
    assert [r.deck_id.rpartition("/")[2] for r in errors.collect()] == ["broken"]


def test_lines_and_manifests_are_read_whole(spark, tmp_path):
    import json

    from conforma.sources import scripts

    (tmp_path / "a.md").write_text("# Um\r\n\ntexto\n")
    got = [(r.line_no, r.line) for r in scripts.read_lines(spark, str(tmp_path / "a.md")).orderBy("line_no").collect()]
    assert got == [(0, "# Um"), (1, ""), (2, "texto"), (3, "")]
    (tmp_path / "m.json").write_text(json.dumps({"slide_1": {"slide": 1, "texto": "oi", "reaproveitado": True}, "slide_2": {"slide": 2, "texto": "fim"}}, indent=2))
    got = {r.key: r for r in scripts.read_manifest(spark, str(tmp_path / "m.json")).collect()}
    assert (got["slide_1"].slide, got["slide_1"].texto, got["slide_2"].texto) == (1, "oi", "fim")
