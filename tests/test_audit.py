"""The audit of whole decks: inherited sizes, colours, boxes and capitals."""

import io
import struct
import zipfile

from conforma.functions import grid as G
from conforma.operators import audit
from conforma.sources import pptx

NS = (
    'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
)
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
KIND = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
MAP = 'bg1="lt1" tx1="dk1" bg2="lt2" tx2="dk2" accent1="accent1"'


def rels(*pairs):
    return f'<Relationships xmlns="{RELS}">' + "".join(f'<Relationship Id="r{i}" Type="{KIND}/{k}" Target="{t}"/>' for i, (k, t) in enumerate(pairs)) + "</Relationships>"


def holder(kind, y, levels="", idx=""):
    idx = f'idx="{idx}"' if idx else ""
    return (
        f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="{kind}"/><p:nvPr><p:ph type="{kind}" {idx}/></p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="{G.cm(2)}" y="{G.cm(y)}"/>'
        f'<a:ext cx="{G.cm(28)}" cy="{G.cm(3)}"/></a:xfrm></p:spPr><p:txBody><a:lstStyle>{levels}</a:lstStyle></p:txBody></p:sp>'
    )


def said(name, text, kind, run="", fill="", extra=""):
    return (
        f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="{name}"/><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:spPr>{fill}</p:spPr>'
        f'<p:txBody><a:p><a:r><a:rPr lang="pt-BR" {run}>{extra}</a:rPr><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    )


def solid(kind, value, inside=""):
    return f'<a:solidFill><a:{kind} val="{value}">{inside}</a:{kind}></a:solidFill>'


def deck(slides, body_level='<a:lvl1pPr><a:defRPr sz="2400"/></a:lvl1pPr>', title_cap=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ids = "".join(f'<p:sldId id="{256 + i}" r:id="r{i + 1}"/>' for i in range(len(slides)))
        z.writestr("ppt/presentation.xml", f'<p:presentation {NS}><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="{G.WIDTH}" cy="{G.HEIGHT}"/></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", rels(("theme", "theme/theme1.xml"), *[("slide", f"slides/slide{i}.xml") for i in range(len(slides))]))
        z.writestr("docProps/core.xml", '<c xmlns:dc="d"><dc:title>Aula de teste</dc:title><dc:creator>Ana</dc:creator><dc:language>pt-BR</dc:language></c>')
        colours = "".join(f'<a:{n}><a:srgbClr val="{v}"/></a:{n}>' for n, v in (("dk1", "1A1A1A"), ("lt1", "FAFAFA"), ("accent1", "DDDDDD")))
        z.writestr("ppt/theme/theme1.xml", f"<a:theme {NS}><a:themeElements><a:clrScheme>{colours}</a:clrScheme></a:themeElements></a:theme>")
        cap = f'<a:lvl1pPr><a:defRPr sz="3600" {title_cap}/></a:lvl1pPr>'
        z.writestr(
            "ppt/slideMasters/m.xml",
            f"<p:sldMaster {NS}><p:cSld><p:spTree>{holder('title', 1.5)}{holder('body', 5)}</p:spTree></p:cSld><p:clrMap {MAP}/>"
            f"<p:txStyles><p:titleStyle>{cap}</p:titleStyle><p:bodyStyle>{body_level}</p:bodyStyle></p:txStyles></p:sldMaster>",
        )
        z.writestr("ppt/slideLayouts/l.xml", f'<p:sldLayout {NS}><p:cSld name="Conteudo"><p:spTree>{holder("title", 1.5)}</p:spTree></p:cSld></p:sldLayout>')
        z.writestr("ppt/slideLayouts/_rels/l.xml.rels", rels(("slideMaster", "../slideMasters/m.xml")))
        z.writestr("ppt/media/a.png", b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", 200, 100))
        for i, body in enumerate(slides):
            z.writestr(f"ppt/slides/slide{i}.xml", f"<p:sld {NS}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>")
            z.writestr(f"ppt/slides/_rels/slide{i}.xml.rels", rels(("slideLayout", "../slideLayouts/l.xml"), ("image", "../media/a.png")))
    return out.getvalue()


PICTURE = (
    '<p:pic><p:nvPicPr><p:cNvPr id="1" name="Gato" descr="Um gato dorme no sofá"/><p:nvPr/></p:nvPicPr><p:blipFill><a:blip r:embed="r1"/></p:blipFill>'
    f'<p:spPr><a:xfrm><a:off x="{G.cm(2)}" y="{G.cm(9)}"/><a:ext cx="{G.cm(16)}" cy="{G.cm(8)}"/></a:xfrm></p:spPr></p:pic>'
)


def found(spark, tmp_path, raw):
    (tmp_path / "d.pptx").write_bytes(raw)
    decks = pptx.read_decks(spark, str(tmp_path), str(tmp_path / "rows"))
    assert decks["error"].count() == 0
    rows = audit.audit(decks, str(tmp_path / 'resolved')).filter("verdict = 'fail' or rule in ('E01', 'E09', 'F02', 'N01')").collect()
    return decks, {(r.rule, r.slide_no, r.verdict) for r in rows}


def test_inherited_defects(spark, tmp_path):
    pale = solid("schemeClr", "accent1")
    half = solid("schemeClr", "tx1", '<a:lumMod val="50000"/><a:lumOff val="50000"/>')
    slides = [
        said("Titulo", "Abertura", "title") + said("Corpo", "Texto pálido", "body", extra=pale),
        said("Titulo", "Fundo", "title") + said("Corpo", "Texto escuro", "body", fill=solid("srgbClr", "222222")),
        said("Titulo", "Gradiente", "title") + said("Corpo", "Texto", "body", fill="<a:gradFill/>"),
        said("Titulo", "Meio", "title") + said("Corpo", "Texto", "body", extra=half) + PICTURE,
    ]
    _, got = found(spark, tmp_path, deck(slides, '<a:lvl1pPr><a:defRPr sz="1600"/></a:lvl1pPr>', 'cap="all"'))
    assert {("E01", 1, "fail"), ("E01", 2, "fail"), ("E09", 3, "unverified"), ("F02", 1, "fail"), ("N09", 1, "fail"), ("F06", 1, "fail")} <= got
    assert not {r for r in got if r[0] in ("N01", "F03") or (r[0], r[1]) == ("E01", 4) and r[2] == "unverified"}
    boxes = {(r.slide_no, r.name): (r.y, r.box_origin) for r in spark.read.parquet(str(tmp_path / "resolved" / "shapes")).collect()}
    assert boxes[1, "Titulo"] == (G.cm(1.5), "layout") and boxes[1, "Corpo"] == (G.cm(5), "master")


def test_sound_deck(spark, tmp_path):
    _, got = found(spark, tmp_path, deck([said("Titulo", "Abertura", "title") + said("Corpo", "Frase curta.", "body")]))
    assert {r for r in got if r[0] not in ("N05", "F05")} == set()


def test_stretched_picture(spark, tmp_path):
    raw = deck([said("Titulo", "Abertura", "title") + PICTURE.replace(str(G.cm(8)), str(G.cm(7)))])
    assert ("N01", 1, "fail") in found(spark, tmp_path, raw)[1]


def with_second_master(raw):
    """The deck with slide 2 on a layout of a second master, whose theme is dark."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(raw)) as old, zipfile.ZipFile(out, "w") as z:
        for name in old.namelist():
            text = old.read(name)
            if name == "ppt/slides/_rels/slide1.xml.rels":
                text = text.replace(b"slideLayouts/l.xml", b"slideLayouts/l2.xml")
            z.writestr(name, text)
        for part in ("slideMasters/m.xml", "slideLayouts/l.xml"):
            z.writestr(f"ppt/{part.replace('.xml', '2.xml')}", old.read(f"ppt/{part}"))
        z.writestr("ppt/slideLayouts/_rels/l2.xml.rels", rels(("slideMaster", "../slideMasters/m2.xml")))
        z.writestr("ppt/slideMasters/_rels/m.xml.rels", rels(("theme", "../theme/theme1.xml")))
        z.writestr("ppt/slideMasters/_rels/m2.xml.rels", rels(("theme", "../theme/theme2.xml")))
        system = '<a:lt1><a:sysClr val="windowText"/></a:lt1>'
        z.writestr("ppt/theme/theme2.xml", f'<a:theme {NS}><a:themeElements><a:clrScheme><a:dk1><a:srgbClr val="F5F5F5"/></a:dk1>{system}<a:accent1><a:srgbClr val="222222"/></a:accent1></a:clrScheme></a:themeElements></a:theme>')
    return out.getvalue()


def test_each_master_has_its_theme(spark, tmp_path):
    pale = solid("schemeClr", "accent1")
    slides = [said("Titulo", f"Pagina {n}", "title") + said("Corpo", "Um texto", "body", extra=pale) for n in "ab"]
    found(spark, tmp_path, with_second_master(deck(slides)))
    runs = {(r.slide_no, r.text): (r.fg, r.bg) for r in spark.read.parquet(str(tmp_path / "resolved" / "runs")).collect()}
    assert runs == {
        (1, "Pagina a"): ("1A1A1A", "FAFAFA"), (1, "Um texto"): ("DDDDDD", "FAFAFA"),
        (2, "Pagina b"): ("F5F5F5", "000000"), (2, "Um texto"): ("222222", "000000"),
    }


def test_malformed_number_is_an_error_row(spark, tmp_path):
    (tmp_path / "d.pptx").write_bytes(deck([said("Titulo", "Abertura", "title", run='sz="x"')]))
    tables = pptx.read_decks(spark, str(tmp_path))
    assert tables["error"].count() == 1 and tables["run"].count() == 0
