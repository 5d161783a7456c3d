"""Slide decks (.pptx) as fact tables: each file is parsed once, by one task, into rows with ordinals.

Reading order is the order of the shape tree, across tags, so files are walked in Python; everything
after that is relational. Values that a slide inherits are left null and resolved by joins
(operators.resolve).
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SHAPE_TAGS = ("sp", "pic", "graphicFrame", "grpSp", "cxnSp")

KEY = "deck_id string, slide_no long, shape_ord int"
#: A colour as written: a literal or a theme's alias, its modifiers, or the reason why it has no single value.
COLOUR = "struct<hex: string, alias: string, mods: array<struct<name: string, val: int>>, reason: string>"
#: What levels 1 to 9 of a list style set.
LEVELS = f"struct<sz: array<long>, cap: array<string>, colour: array<{COLOUR}>>"
SCHEMAS = {
    "deck": "deck_id string, stem string, title string, language string, author string, slide_w long, slide_h long, n_slides int",
    "slide": "deck_id string, slide_no long, layout_name string, notes string, transition_children array<string>, "
    f"layout_part string, master_part string, slide_bg {COLOUR}, layout_bg {COLOUR}, master_bg {COLOUR}",
    "style": f"deck_id string, part string, scope string, ph_type string, ph_idx string, ph_ord int, levels {LEVELS}, x long, y long, cx long, cy long",
    "scheme": "deck_id string, part string, slot string, hex string",
    "colour_map": "deck_id string, slide_no long, level string, alias string, slot string",
    "shape": f"{KEY}, depth int, tag string, name string, alt string, decorative boolean, hidden boolean, is_ph boolean, "
    "ph_type string, ph_idx string, x long, y long, cx long, cy long, media_kind string, link_rid string, has_link boolean, "
    "n_children int, has_table boolean, content_uri string, text string, native_w long, native_h long, "
    f"fill {COLOUR}, levels {LEVELS}, style_colour {COLOUR}",
    "paragraph": f"{KEY}, para_ord int, depth int, decorative boolean, hidden boolean, titled boolean, cell_ri int, cell_ci int, "
    "text string, algn string, lvl int, line_pct long, para_sz long, para_cap string, bullet string, first_sz long",
    "run": f"{KEY}, para_ord int, run_ord int, lvl int, para_sz long, colour {COLOUR}, para_colour {COLOUR}, cell_fill {COLOUR}, run_cap string, "
    " depth int, decorative boolean, hidden boolean, titled boolean, cell_ri int, "
    "text string, lang string, sz long, bold boolean, i boolean, u string, typeface string, literal_colour string, has_link boolean, link_rid string",
    "table_cell": f"{KEY}, tbl_ord int, ri int, ci int, text string, grid_span int, row_span int, h_merge boolean, v_merge boolean, first_row boolean",
    "rel": "deck_id string, slide_no long, rid string, target string",
    "section": "deck_id string, sec_ord int, name string, slide_ids array<string>",
}


def _local(el) -> str:
    return el.tag.rpartition("}")[2]


def _flag(value) -> bool:
    return value in ("1", "true")


def _int(value):
    return int(value) if value not in (None, "") else None


def _rels(z: zipfile.ZipFile, part: str) -> list[tuple[str, str, str]]:
    folder, _, name = part.rpartition("/")
    path = f"{folder}/_rels/{name}.rels"
    if path not in z.namelist():
        return []
    return [(r.get("Id"), r.get("Type", "").rpartition("/")[2], r.get("Target")) for r in ET.fromstring(z.read(path))]


def _part(base: str, target: str) -> str:
    at = base.rpartition("/")[0].split("/")
    for step in target.split("/"):
        if step == "..":
            at.pop()
        else:
            at.append(step)
    return target.lstrip("/") if target.startswith("/") else "/".join(at)


def _colour(parent) -> dict | None:
    """The colour of an element's fill: None if it has none of its own."""
    for fill in parent if parent is not None else ():
        reason = {"gradFill": "gradient", "blipFill": "picture fill", "pattFill": "pattern"}.get(_local(fill))
        if reason:
            return dict(reason=reason)
        if _local(fill) == "solidFill":
            return _written(fill)
    return None


def _written(parent) -> dict | None:
    """The first colour below an element, with its modifiers."""
    for c in parent:
        kind, mods = _local(c), [dict(name=_local(m), val=int(m.get("val"))) for m in c if (m.get("val") or "").lstrip("-").isdigit()]
        if kind == "srgbClr":
            return dict(hex=c.get("val"), mods=mods)
        if kind == "sysClr":
            return dict(hex=c.get("lastClr"), mods=mods)
        if kind == "schemeClr":
            return dict(alias=c.get("val"), mods=mods)
        return dict(reason=f"colour written as {kind}")
    return None


def _scheme(z: zipfile.ZipFile, deck: str, part: str | None, theme: str | None):
    """The colours of a theme: that of a master (part), or the presentation's own (part None)."""
    if theme in z.namelist():
        for slot in (c for s in ET.fromstring(z.read(theme)).iter(f"{A}clrScheme") for c in s):
            hexes = (_written(slot) or {}).get("hex")
            if hexes is None and (system := slot.find(f"{A}sysClr")) is not None:
                hexes = "000000" if system.get("val") == "windowText" else "FFFFFF"
            yield "scheme", dict(deck_id=deck, part=part, slot=_local(slot), hex=hexes)


def _levels(styles) -> dict:
    """What a list style sets at its nine levels."""
    at = [styles.find(f"{A}lvl{n}pPr/{A}defRPr") if styles is not None else None for n in range(1, 10)]
    at = [ET.Element("x") if r is None else r for r in at]
    return dict(sz=[_int(r.get("sz")) for r in at], cap=[r.get("cap") for r in at], colour=[_colour(r) for r in at])


def _background(root) -> dict | None:
    bg = root.find(f"{P}cSld/{P}bg")
    if bg is None:
        return None
    own, ref = bg.find(f"{P}bgPr"), bg.find(f"{P}bgRef")
    return _colour(own) if own is not None else _written(ref) if ref is not None else None


def _override(root) -> dict:
    c = root.find(f"{P}clrMapOvr/{A}overrideClrMapping")
    return dict(c.attrib) if c is not None else {}


def _image_size(raw: bytes) -> tuple[int, int] | None:
    """Width and height in pixels of a PNG, GIF or JPEG file, by its header."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", raw[16:24])
    if raw[:4] == b"GIF8":
        return struct.unpack("<HH", raw[6:10])
    at = 2 if raw[:2] == b"\xff\xd8" else len(raw)
    while at + 9 < len(raw) and raw[at] == 0xFF:
        if 0xC0 <= raw[at + 1] <= 0xCF and raw[at + 1] not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", raw[at + 5 : at + 9])
            return width, height
        at += 2 + int.from_bytes(raw[at + 2 : at + 4], "big")
    return None


class _Templates:
    """The layouts and masters of a deck, each read once."""

    def __init__(self, z: zipfile.ZipFile, deck: str):
        self.z, self.deck, self.roots, self.rels, self.fresh = z, deck, {}, {}, []

    def root(self, part: str, scope: str) -> ET.Element:
        if part not in self.roots:
            self.roots[part] = root = ET.fromstring(self.z.read(part))
            self.rels[part] = {kind: _part(part, t) for _, kind, t in _rels(self.z, part)}
            self.fresh += self._styles(root, part, scope)
            if scope == "master":
                self.fresh += _scheme(self.z, self.deck, part, self.rels[part].get("theme"))
        return self.roots[part]

    def _styles(self, root, part: str, scope: str):
        key = dict(deck_id=self.deck, part=part)
        marks = [(sp, ph) for sp in root.iter(f"{P}sp") if (ph := next(sp.iter(f"{P}ph"), None)) is not None]
        for n, (sp, ph) in enumerate(marks):
            off, ext = sp.find(f"{P}spPr/{A}xfrm/{A}off"), sp.find(f"{P}spPr/{A}xfrm/{A}ext")
            box = (None,) * 4 if off is None or ext is None else (off.get("x"), off.get("y"), ext.get("cx"), ext.get("cy"))
            yield "style", dict(
                key, scope=scope, ph_type=ph.get("type", "body"), ph_idx=ph.get("idx"), ph_ord=n, levels=_levels(sp.find(f"{P}txBody/{A}lstStyle")),
                x=_int(box[0]), y=_int(box[1]), cx=_int(box[2]), cy=_int(box[3]),
            )
        for bucket in ("title", "body", "other") if scope == "master" else ():
            yield "style", dict(key, scope="text", ph_type=bucket, levels=_levels(root.find(f"{P}txStyles/{P}{bucket}Style")))


def _text(el) -> str:
    return "".join(t.text or "" for t in el.iter(f"{A}t"))


def parse(name: str, raw: bytes):
    """(kind, row) of everything in a deck; name becomes its id."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    main = "ppt/presentation.xml"
    root = ET.fromstring(z.read(main))
    targets = {i: t for i, _, t in _rels(z, main)}
    size = root.find(f"{P}sldSz")
    core = ET.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else ET.Element("x")
    said = {_local(c): c.text for c in core}
    ids = [s.get(f"{R}id") for s in root.iter(f"{P}sldId")]
    yield "deck", dict(
        deck_id=name, stem=name.rpartition("/")[2].rpartition(".")[0] or name, title=said.get("title"), language=said.get("language"),
        author=said.get("creator"), slide_w=_int(size.get("cx")) if size is not None else None,
        slide_h=_int(size.get("cy")) if size is not None else None, n_slides=len(ids),
    )
    for k, s in enumerate(x for x in root.iter() if _local(x) == "section"):
        yield "section", dict(deck_id=name, sec_ord=k, name=s.get("name"), slide_ids=[i.get("id") for i in s.iter() if _local(i) == "sldId"])
    yield "style", dict(deck_id=name, scope="default", levels=_levels(root.find(f"{P}defaultTextStyle")))
    theme = next((_part(main, t) for _, kind, t in _rels(z, main) if kind == "theme"), None)
    yield from _scheme(z, name, None, theme)
    templates = _Templates(z, name)
    for number, rid in enumerate(ids, 1):
        yield from _slide(z, name, number, _part(main, targets[rid]), templates)
    yield from templates.fresh


def _slide(z: zipfile.ZipFile, deck: str, number: int, part: str, templates: _Templates):
    root = ET.fromstring(z.read(part))
    key = dict(deck_id=deck, slide_no=number)
    layout, notes, layout_part, master_part = "", "", None, None
    bg = dict(slide_bg=_background(root))
    maps = {"slide": _override(root)}
    images = {}
    for rid, kind, target in _rels(z, part):
        yield "rel", dict(key, rid=rid, target=target)
        if kind == "slideLayout":
            layout_part = _part(part, target)
            held = templates.root(layout_part, "layout")
            c = held.find(f"{P}cSld")
            layout = c.get("name", "") if c is not None else ""
            bg["layout_bg"], maps["layout"] = _background(held), _override(held)
            master_part = templates.rels[layout_part].get("slideMaster")
            if master_part:
                held = templates.root(master_part, "master")
                found = held.find(f"{P}clrMap")
                bg["master_bg"], maps["master"] = _background(held), dict(found.attrib) if found is not None else {}
        if kind == "image":
            images[rid] = _part(part, target)
        if kind == "notesSlide":
            body = ET.fromstring(z.read(_part(part, target)))
            notes = "\n".join(_text(p) for sp in body.iter(f"{P}sp") if any(x.get("type") == "body" for x in sp.iter(f"{P}ph")) for p in sp.iter(f"{A}p"))
    moves = [_local(c) for t in root.iter(f"{P}transition") for c in t]
    yield "slide", dict(key, layout_name=layout, notes=notes, transition_children=moves, layout_part=layout_part, master_part=master_part, **bg)
    for level, entries in maps.items():
        for alias, slot in entries.items():
            yield "colour_map", dict(key, level=level, alias=alias, slot=slot)
    sizes = {rid: _image_size(z.read(p)) for rid, p in images.items() if p in z.namelist()}
    count = [0]
    tree = root.find(f"{P}cSld/{P}spTree")
    for el in tree if tree is not None else ():
        yield from _shape(el, key, 0, count, sizes)


def _shape(el, key: dict, depth: int, count: list[int], sizes: dict):
    tag = _local(el)
    if tag not in SHAPE_TAGS:
        return
    key = dict(key, shape_ord=count[0])
    count[0] += 1
    own = next((c for x in el for c in x if _local(c) == "cNvPr"), ET.Element("x"))
    ph = next((x for n in el for x in n.iter(f"{P}ph")), None) if tag != "grpSp" else None
    kind = ph.get("type", "body") if ph is not None else None
    titled = kind in ("title", "ctrTitle")
    decorative = any(_local(x) == "decorative" and _flag(x.get("val")) for x in own.iter())
    state = dict(depth=depth, decorative=decorative, hidden=_flag(own.get("hidden")))
    frame = next((x for x in el.iter() if _local(x) == "xfrm"), None) if tag != "grpSp" else el.find(f"{P}grpSpPr/{A}xfrm")
    off, ext = (frame.find(f"{A}off"), frame.find(f"{A}ext")) if frame is not None else (None, None)
    box = (None,) * 4 if off is None or ext is None else (off.get("x"), off.get("y"), ext.get("cx"), ext.get("cy"))
    media = next((m for x in el.iter() if (m := {"videoFile": "video", "audioFile": "audio"}.get(_local(x)))), None)
    click = own.find(f"{A}hlinkClick")
    link = click.get(f"{R}id") if click is not None else None
    tables = list(el.iter(f"{A}tbl")) if tag == "graphicFrame" else []
    uri = next((x.get("uri") for x in el.iter(f"{A}graphicData")), None)
    body = el.find(f"{P}txBody")
    paragraphs = list(body.findall(f"{A}p")) if body is not None else []
    props, style = el.find(f"{P}spPr"), el.find(f"{P}style")
    fill, painted = _colour(props), props is not None and props.find(f"{A}noFill") is not None
    back, face = (style.find(f"{A}fillRef"), style.find(f"{A}fontRef")) if style is not None else (None, None)
    if fill is None and not painted and back is not None and back.get("idx", "0") != "0":
        fill = _written(back)
    blip = next((b.get(f"{R}embed") for b in el.iter(f"{A}blip")), None) if tag == "pic" else None
    native = sizes.get(blip) or (None, None)
    crop = next(el.iter(f"{A}srcRect"), None) if tag == "pic" else None
    if crop is not None and native[0]:
        left, top, right, bottom = (int(crop.get(c, 0)) / 100000 for c in "ltrb")
        native = round(native[0] * (1 - left - right)), round(native[1] * (1 - top - bottom))
    runs_linked = any(True for p in paragraphs for x in p.iter(f"{A}hlinkClick"))
    yield "shape", dict(
        key, **state, tag=tag, name=own.get("name", ""), alt=own.get("descr", ""), is_ph=ph is not None, ph_type=kind,
        ph_idx=ph.get("idx") if ph is not None else None, x=_int(box[0]), y=_int(box[1]), cx=_int(box[2]), cy=_int(box[3]),
        media_kind=media, link_rid=link, has_link=bool(link) or runs_linked,
        n_children=sum(_local(c) in SHAPE_TAGS for c in el) if tag == "grpSp" else 0, has_table=bool(tables), content_uri=uri,
        text=" ".join(_text(p) for p in paragraphs), native_w=native[0], native_h=native[1], fill=fill,
        levels=_levels(body.find(f"{A}lstStyle") if body is not None else None), style_colour=_written(face) if face is not None else None,
    )
    numbered = [(p, None, None, None) for p in paragraphs]
    for k, table in enumerate(tables):
        first = _flag((table.find(f"{A}tblPr") if table.find(f"{A}tblPr") is not None else ET.Element("x")).get("firstRow"))
        for ri, row in enumerate(table.findall(f"{A}tr")):
            for ci, cell in enumerate(row.findall(f"{A}tc")):
                yield "table_cell", dict(
                    key, tbl_ord=k, ri=ri, ci=ci, text=_text(cell), grid_span=int(cell.get("gridSpan", 1)), row_span=int(cell.get("rowSpan", 1)),
                    h_merge=_flag(cell.get("hMerge")), v_merge=_flag(cell.get("vMerge")), first_row=first,
                )
                painted = _colour(cell.find(f"{A}tcPr")) or dict(reason="table style")
                numbered += [(p, ri, ci, painted) for p in cell.iter(f"{A}p")]
    for n, (p, ri, ci, painted) in enumerate(numbered):
        yield from _paragraph(p, dict(key, para_ord=n, **state, titled=titled, cell_ri=ri), ci, bool(link), painted)
    if tag == "grpSp":
        for child in el:
            yield from _shape(child, {k: v for k, v in key.items() if k != "shape_ord"}, depth + 1, count, sizes)


def _paragraph(p, key: dict, ci, linked: bool, cell_fill: dict | None):
    props = p.find(f"{A}pPr")
    props = ET.Element("x") if props is None else props
    default = props.find(f"{A}defRPr")
    spacing = props.find(f"{A}lnSpc/{A}spcPct")
    default = ET.Element("x") if default is None else default
    lvl, para_sz = int(props.get("lvl", 0)), _int(default.get("sz"))
    first = next((_int(r.get("sz")) for r in p.iter(f"{A}rPr") if r.get("sz")), None)
    yield "paragraph", dict(
        key, cell_ci=ci, text=_text(p), algn=props.get("algn"), lvl=lvl, first_sz=first, para_cap=default.get("cap"),
        line_pct=_int(spacing.get("val")) if spacing is not None else None, para_sz=para_sz,
        bullet=next((_local(c) for c in props if _local(c) in ("buNone", "buChar", "buAutoNum", "buBlip")), None),
    )
    for n, r in enumerate(p.findall(f"{A}r")):
        rp = r.find(f"{A}rPr")
        rp = ET.Element("x") if rp is None else rp
        face, click = rp.find(f"{A}latin"), rp.find(f"{A}hlinkClick")
        colour = next((c.get("val") for c in rp.iter(f"{A}srgbClr")), None)
        yield "run", dict(
            {k: v for k, v in key.items()}, run_ord=n, lvl=lvl, para_sz=para_sz, colour=_colour(rp), para_colour=_colour(default), cell_fill=cell_fill, run_cap=rp.get("cap"),
            text=_text(r), lang=rp.get("lang"), sz=_int(rp.get("sz")),
            bold=_flag(rp.get("b")) if rp.get("b") is not None else None, i=_flag(rp.get("i")), u=rp.get("u"),
            typeface=face.get("typeface") if face is not None else None, literal_colour=colour, has_link=click is not None or linked,
            link_rid=click.get(f"{R}id") if click is not None else None,
        )


def read_decks(spark: SparkSession, path: str, out: str | None = None) -> dict[str, DataFrame]:
    """The fact tables of all decks under path. Files that can't be read give a row of kind 'error'.

    out: a shared folder for the rows, written once and by kind, so that a table reads its kind's files
    only; without it, rows are kept by the executors.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pptx").option("recursiveFileLookup", "true").load(path)

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [(k, json.dumps(r)) for k, r in parse(name, raw)]
                except Exception as e:  # noqa: BLE001 - one malformed file is a row, not the job's end
                    rows = [("error", json.dumps({"deck_id": name, "error": repr(e)}))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["kind", "row"])

    rows = files.select("path", "content").mapInArrow(run, "kind string, row string")
    if out:
        rows.write.partitionBy("kind").parquet(out)
        rows = spark.read.schema("row string, kind string").parquet(out)
    else:
        rows = rows.persist()
    schemas = SCHEMAS | {"error": "deck_id string, error string"}
    return {k: rows.filter(F.col("kind") == k).select(F.from_json("row", s).alias("r")).select("r.*") for k, s in schemas.items()}
