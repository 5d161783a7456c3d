"""A deck with a trap for each of 37 rules, and a sound one, through the whole audit: readers, resolvers, rules, report."""

import io
import json
import struct
import zipfile

import pytest
from test_audit import MAP, NS, holder, rels, solid

from conforma.functions import grid as G
from conforma.operators import audit, report
from conforma.sources import pptx

# The rules that the deck of traps must fail.
TRAPS = (
    "A01 A02 A03 A04 B01 B03 B05 B06 B09 C01 C02 C05 D01 D03 D04 D05 D06 D08 D11 E01 E02 E08 F01 F02 F04 F06 G01 G03 G04 G05 H01 H02 I07 "
    "N01 N02 N04 N09"
).split()


def frame(x, y, cx, cy, kind="a"):
    return f'<{kind}:xfrm><a:off x="{G.cm(x)}" y="{G.cm(y)}"/><a:ext cx="{G.cm(cx)}" cy="{G.cm(cy)}"/></{kind}:xfrm>'


def named(name, alt="", ph=None, decorative=False):
    mark = '<a:extLst><a:ext><adec:decorative xmlns:adec="d" val="1"/></a:ext></a:extLst>' if decorative else ""
    place = f'<p:ph type="{ph}"/>' if ph else ""
    return f'<p:nvXPr><p:cNvPr id="1" name="{name}" descr="{alt}">{mark}</p:cNvPr><p:nvPr>{place}</p:nvPr></p:nvXPr>'


def run(text, size=None, lang="pt-BR", colour="", more="", link=""):
    click = f'<a:hlinkClick r:id="{link}"/>' if link else ""
    sz = f'sz="{size}"' if size else ""
    return f'<a:r><a:rPr lang="{lang}" {sz} {more}>{solid("srgbClr", colour) if colour else ""}{click}</a:rPr><a:t>{text}</a:t></a:r>'


def box(name, *paragraphs, at=None, ph=None, fill="", decorative=False):
    """paragraphs: runs, or (properties, runs)."""
    body = "".join(f"<a:p><a:pPr {p[0]}/>{p[1]}</a:p>" if isinstance(p, tuple) else f"<a:p>{p}</a:p>" for p in paragraphs)
    return f"<p:sp>{named(name, ph=ph, decorative=decorative)}<p:spPr>{frame(*at) if at else ''}{fill}</p:spPr><p:txBody>{body}</p:txBody></p:sp>"


def picture(name, at, alt="", decorative=False):
    return f'<p:pic>{named(name, alt, decorative=decorative)}<p:blipFill><a:blip r:embed="img"/></p:blipFill><p:spPr>{frame(*at)}</p:spPr></p:pic>'


def table(name, rows, at, alt="", first=True, fills=(), merged=False, size=2000):
    def cell(ri, ci, text):
        span = 'gridSpan="2"' if merged and (ri, ci) == (0, 0) else ""
        colour = fills[min(ri, 1)] if fills else ("000000", "FFFFFF")
        return f'<a:tc {span}><a:txBody><a:p>{run(text, size, colour=colour[0]) if text else ""}</a:p></a:txBody><a:tcPr>{solid("srgbClr", colour[1])}</a:tcPr></a:tc>'

    body = "".join(f'<a:tr>{"".join(cell(i, j, t) for j, t in enumerate(r))}</a:tr>' for i, r in enumerate(rows))
    head = 'firstRow="1"' if first else ""
    return (
        f'<p:graphicFrame>{named(name, alt)}{frame(*at, kind="p")}<a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/table">'
        f"<a:tbl><a:tblPr {head}/>{body}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    )


def notes(text):
    return f'<p:notes {NS}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type="body"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:notes>'


def deck(slides, title, author, language, dark="1A1A1A", light="FAF7F2"):
    """slides: (layout's name, shapes, notes). Layouts: Conteudo; Blank; Secao, whose title is in capitals."""
    out = io.BytesIO()
    layouts = {"Conteudo": holder("title", 1.5), "Blank": "", "Secao": holder("title", 9, '<a:lvl1pPr><a:defRPr cap="all"/></a:lvl1pPr>')}
    size = '<a:lvl1pPr><a:defRPr sz="{}"/></a:lvl1pPr>'
    with zipfile.ZipFile(out, "w") as z:
        ids = "".join(f'<p:sldId id="{256 + i}" r:id="r{i + 1}"/>' for i in range(len(slides)))
        z.writestr("ppt/presentation.xml", f'<p:presentation {NS}><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="{G.WIDTH}" cy="{G.HEIGHT}"/></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", rels(("theme", "theme/theme1.xml"), *[("slide", f"slides/slide{i}.xml") for i in range(len(slides))]))
        z.writestr("docProps/core.xml", f'<c xmlns:dc="d"><dc:title>{title}</dc:title><dc:creator>{author}</dc:creator><dc:language>{language}</dc:language></c>')
        colours = "".join(f'<a:{n}><a:srgbClr val="{v}"/></a:{n}>' for n, v in (("dk1", dark), ("lt1", light)))
        z.writestr("ppt/theme/theme1.xml", f"<a:theme {NS}><a:themeElements><a:clrScheme>{colours}</a:clrScheme></a:themeElements></a:theme>")
        z.writestr(
            "ppt/slideMasters/m.xml",
            f"<p:sldMaster {NS}><p:cSld><p:spTree>{holder('title', 1.5)}{holder('body', 5)}</p:spTree></p:cSld><p:clrMap {MAP}/>"
            f"<p:txStyles><p:titleStyle>{size.format(3600)}</p:titleStyle><p:bodyStyle>{size.format(2400)}</p:bodyStyle></p:txStyles></p:sldMaster>",
        )
        for name, body in layouts.items():
            z.writestr(f"ppt/slideLayouts/{name}.xml", f'<p:sldLayout {NS}><p:cSld name="{name}"><p:spTree>{body}</p:spTree></p:cSld></p:sldLayout>')
            z.writestr(f"ppt/slideLayouts/_rels/{name}.xml.rels", rels(("slideMaster", "../slideMasters/m.xml")))
        z.writestr("ppt/media/a.png", b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", 300, 200))
        for i, (name, body, said) in enumerate(slides):
            z.writestr(f"ppt/slides/slide{i}.xml", f"<p:sld {NS}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>")
            held = [("slideLayout", f"../slideLayouts/{name}.xml")] + ([("notesSlide", f"../notesSlides/n{i}.xml")] if said else [])
            more = '<Relationship Id="img" Type="x/image" Target="../media/a.png"/>'
            more += "".join(f'<Relationship Id="{k}" Type="x/hyperlink" Target="{t}" TargetMode="External"/>' for k, t in (("w3", "https://www.w3.org/"), ("ex", "https://e.org/p")))
            z.writestr(f"ppt/slides/_rels/slide{i}.xml.rels", rels(*held).replace("</Relationships>", f"{more}</Relationships>"))
            if said:
                z.writestr(f"ppt/notesSlides/n{i}.xml", notes(said))
    return out.getvalue()


def traps():
    english = {"lang": "en-US"}
    first = box("Titulo", run("Resultados", **english), ph="title") + box(
        "Corpo", run("- item digitado com hifen", **english), run("TEXTO INTEIRO EM CAIXA ALTA"),
        ('algn="just"', run("Texto pequeno e justificado", 1200, more='i="1"').replace("</a:rPr>", '<a:latin typeface="Times New Roman"/></a:rPr>')), ph="body",
    ) + picture("Foto", (22, 5, 9, 6))
    second = (
        box("TextBox 3", run("Bloco de texto solto", 2000), at=(2, 6, 15, 3)) + picture("Foto", (20, 4, 9, 6), "grafico1.png")
        + picture("Outra", (20, 11, 9, 6), "Imagem de um grafico. Descricao gerada automaticamente") + box("Titulo", run("Resultados"), ph="title", at=(2, 1.5, 28, 3))
    )
    third = (
        box("Solto", run("Slide sem titulo nenhum", 2000), at=(2, 2, 15, 2)) + picture("Foto", (2, 5, 9, 6), "Descricao muito longa " + "que passa dos limites " * 7)
        + picture("Enfeite", (13, 5, 9, 6), "isto nao deveria estar aqui", decorative=True) + box("Claro", run("Texto grande claro", 2000, colour="CCCCCC"), at=(2, 12, 12, 2))
        + box("Cinza", run("Texto normal cinza", 1600, colour="999999"), at=(2, 14.5, 12, 2)) + box("Puro", run("Preto sobre branco", 2000, colour="000000"), at=(17, 12, 12, 2))
    )
    grid = [["Mes", "Meta", "", "Real"], ["Jan", "100", "", "92"], ["Fev", "110", "", "97"]]
    fourth = (
        box("Titulo", run("Tabela e links"), ph="title") + table("Valores", grid, (2, 5, 20, 6), first=False, merged=True)
        + box("Endereco", run("https://www.w3.org/TR/", 2000, link="w3"), at=(2, 12, 15, 1.5)) + box("Vago", run("clique aqui", 2000, link="ex"), at=(2, 14, 15, 1.5))
        + box("Alvo", run("x", 2000, link="ex"), at=(0.5, 0.5, 0.4, 0.4))
    )
    fifth = (
        box("Titulo", run("Uma secao", 3600), ph="title") + box("Apoio", run("Este apoio fica acima do titulo"), ph="body", at=(2, 2, 20, 3))
        + picture("Esticada", (24, 2, 5, 10), "Um gato dorme no sofá da sala") + box("Baixo", run("Este bloco entra no rodape", 2000), at=(2, 17, 20, 2))
    )
    layouts = ["Conteudo", "Conteudo", "Blank", "Conteudo", "Secao"]
    return deck([(n, s, "") for n, s in zip(layouts, (first, second, third, fourth, fifth), strict=True)], "", "Usuario do Windows", "", "000000", "FFFFFF")


def control():
    title = (1.4, 1.4, 31.07, 2.2)
    bar = box("Faixa do rodapé", at=(0, 18.05, 33.87, 1), fill=solid("srgbClr", "0072B2"), decorative=True)
    first = (
        bar + box("Título do slide 1", run("Por que a estrutura vem antes", 3400, more='b="1"'), ph="title", at=title)
        + box("Argumento", run("O leitor de tela segue a hierarquia", 2400), run("O marcador carrega sentido, a caixa solta não", 2400), ph="body", at=(1.4, 4.2, 12, 13.2))
        + picture("Diagrama", (14.6, 4.7, 17.7, 11.8), "Hierarquia de três níveis, do título às notas do orador")
    )
    cells = [["Camada", "Cobertura"], ["Texto alternativo", "Presença"], ["Tipografia", "Nenhuma"], ["Composição", "Nenhuma"]]
    second = (
        bar + box("Título do slide 2", run("O que o verificador não enxerga", 3400, more='b="1"'), ph="title", at=title)
        + box("Referência", run("Diretrizes de acesso do consórcio", 2400, link="w3", more='u="sng"'), ph="body", at=(1.4, 4.2, 31.07, 1.5))
        + table("Cobertura", cells, (1.4, 6.4, 31.07, 11), "O que o verificador cobre e o que fica de fora", fills=(("FFFFFF", "0072B2"), ("1A1A1A", "FFFFFF")))
    )
    said = "Descrição da figura: três blocos empilhados."
    return deck([("Conteudo", first, said), ("Conteudo", second, "")], "Acessibilidade estrutural", "Ana", "pt-BR")


@pytest.fixture(scope="module")
def findings(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("traps")
    (path / "in").mkdir()
    (path / "in" / "armadilhas.pptx").write_bytes(traps())
    (path / "in" / "controle.pptx").write_bytes(control())
    decks = pptx.read_decks(spark, str(path / "in"), str(path / "rows"))
    assert decks["error"].count() == 0
    found, ran = audit.reports(decks, str(path / "resolved"))
    found.write.parquet(str(path / "found"))
    ran.write.parquet(str(path / "ran"))
    return spark.read.parquet(str(path / "found")), spark.read.parquet(str(path / "ran")), decks


def test_every_trap_is_found(findings):
    found, _, _ = findings
    failed = {r.rule for r in found.filter("verdict = 'fail' and deck_id like '%armadilhas%'").collect()}
    assert set(TRAPS) - failed == set()


def test_the_sound_deck_fails_nothing(findings):
    found, _, _ = findings
    assert [(r.rule, r.slide_no, r.detail) for r in found.filter("verdict = 'fail' and deck_id like '%controle%'").collect()] == []


def test_gate_evaluated_rules_and_json(findings):
    found, ran, decks = findings
    gates = {r.deck_id.rpartition("/")[2]: r.gate_open for r in report.gate(decks["deck"], found).collect()}
    assert gates == {"armadilhas.pptx": False, "controle.pptx": True}
    of = {}
    for r in ran.collect():
        of.setdefault(r.deck_id.rpartition("/")[2], set()).add(r.rule)
    assert set(TRAPS) <= of["armadilhas.pptx"]
    assert not {"L01", "L07", "M01", "J01"} & of["controle.pptx"]
    reports = {r.deck_id.rpartition("/")[2]: json.loads(r.json) for r in report.as_json(found, ran).collect()}
    own = reports["armadilhas.pptx"]
    n = found.filter("verdict = 'fail' and severity = 'E' and deck_id like '%armadilhas%'").count()
    assert own["summary"]["errors"] == n and set(own["evaluated"]) == of["armadilhas.pptx"]
    assert len(own["findings"]) == found.filter("deck_id like '%armadilhas%'").count()
