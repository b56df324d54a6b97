"""Blocks (the reader's schema) as word-processing packages: a binary column, or files.

The blocks of a document come together in one Arrow group; a group is one document and never more.
"""

from __future__ import annotations

import io
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.sources.images import probe

WIDTH = 9360  # twips between the margins
WIDTH_POINTS, EMU = 468.0, 12700
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
# Names of the format.
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
NAMESPACES = {
    "xmlns:w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main",
    "xmlns:r": f"{OFFICE}/relationships",
    "xmlns:wp": "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing",
    "xmlns:a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "xmlns:pic": "http://schemas.openxmlformats.org/drawingml/2006/picture",
}
EXTENSIONS = {"image/png": "png", "image/jpeg": "jpeg", "image/gif": "gif", "image/bmp": "bmp", "image/tiff": "tiff"}
ALIGNMENTS = {"Left": "left", "Center": "center", "Right": "right", "Justify": "both"}
HEADINGS = {"Title": ("Title", 56), "Heading1": ("heading 1", 32), "Heading2": ("heading 2", 28), "Heading3": ("heading 3", 24)}
_DROP = {c: None for c in range(32) if c not in (9, 10, 13)} | {c: "\ufffd" for c in (0xFFFE, 0xFFFF, *range(0xD800, 0xE000))}


def text_of(value: str) -> str:
    return escape(value.translate(_DROP), {'"': "&quot;"})


def el(tag: str, attrs: dict | None = None, *inside: str) -> str:
    """An element with escaped attributes; what is inside is markup already."""
    head = tag + "".join(f' {k}="{text_of(str(v))}"' for k, v in (attrs or {}).items())
    body = "".join(inside)
    return f"<{head}>{body}</{tag}>" if body else f"<{head}/>"


def val(tag: str, value) -> str:
    return el(tag, {"w:val": value})


def paragraph(b: dict) -> str:
    """A paragraph; numbered items all share one list, bullets another, and the reader of the file counts."""
    item = b.get("list") or {"kind": "None"}
    listed = item["kind"] != "None"
    props = []
    if b["style"] in HEADINGS:
        props.append(val("w:pStyle", b["style"]))
    elif listed:
        props.append(val("w:pStyle", "ListParagraph"))
    if listed:
        props.append(el("w:numPr", None, val("w:ilvl", min(item["level"], 8)), val("w:numId", 2 if item["kind"] == "Numbered" else 1)))
    if b["alignment"] in ALIGNMENTS:
        props.append(val("w:jc", ALIGNMENTS[b["alignment"]]))
    runs = []
    for r in b["runs"] or []:
        if r["text"]:
            style = ["<w:b/>"] * bool(r["bold"]) + ["<w:i/>"] * bool(r["italic"])
            style += [el("w:rFonts", dict.fromkeys(("w:ascii", "w:hAnsi", "w:cs"), r["font"]))] if r["font"] else []
            style += [val("w:color", r["color"])] if r["color"] else []
            runs.append(el("w:r", None, el("w:rPr", None, *style) if style else "", f'<w:t xml:space="preserve">{text_of(r["text"])}</w:t>'))
    return el("w:p", None, el("w:pPr", None, *props) if props else "", *runs)


def column_widths(weights: list[float], columns: int) -> list[int]:
    total = sum(weights)
    return [int(WIDTH * w / total) for w in weights] if len(weights) == columns and total > 0 else [WIDTH // columns] * columns


class Writer:
    """The parts of one package."""

    def __init__(self, blocks: list[dict], media: dict[str, bytes], mimes: dict[str, str]):
        self.media_bytes, self.mimes, self.media = media, mimes, []
        self.by_parent: dict[tuple, list[dict]] = {}
        for b in sorted(blocks, key=lambda b: (b["part"], b["path"])):
            self.by_parent.setdefault((b["part"], *b["path"][:-1]), []).append(b)

    def blocks(self, *parent) -> str:
        make = {"paragraph": paragraph, "table": self.table, "image": self.image}
        return "".join(make[b["kind"]](b) for b in self.by_parent.get(parent, []))

    def table(self, b: dict) -> str:
        rows: dict[int, list[dict]] = {}
        for c in b["cells"] or []:
            rows.setdefault(c["row"], []).append(c)
        if not rows:
            return ""
        widths = column_widths(b["widths"] or [], max(sum(max(1, c["grid_span"]) for c in r) for r in rows.values()))
        line = {"w:val": "single", "w:sz": 4, "w:color": "999999"}
        sides = ("top", "left", "bottom", "right")
        out = [el("w:tblPr", None, el("w:tblW", {"w:w": WIDTH, "w:type": "dxa"}), el("w:tblBorders", None, *[el(f"w:{s}", line) for s in (*sides, "insideH", "insideV")]))]
        out.append(el("w:tblGrid", None, *[el("w:gridCol", {"w:w": max(1, w)}) for w in widths]))
        for r, cells in sorted(rows.items()):
            made, start = [], 0
            for c in sorted(cells, key=lambda c: c["cell"]):
                span = max(1, c["grid_span"])
                props = [el("w:tcW", {"w:w": max(1, sum(widths[start : start + span])), "w:type": "dxa"})]
                props += [val("w:gridSpan", span)] if span > 1 else []
                props += [val("w:vMerge", "restart")] if c["row_span"] > 1 else ["<w:vMerge/>"] * bool(c["merged"])
                if not all(c[s] for s in sides):
                    props.append(el("w:tcBorders", None, *[el(f"w:{s}", line if c[s] else {"w:val": "nil"}) for s in sides]))
                props += [el("w:shd", {"w:val": "clear", "w:fill": c["shading"]})] if c["shading"] else []
                inside = self.blocks(b["part"], *b["path"], r, c["cell"])
                made.append(el("w:tc", None, el("w:tcPr", None, *props), inside or "<w:p/>"))
                start += span
            head = "<w:trPr><w:tblHeader/></w:trPr>" if any(c["header"] for c in cells) else ""
            out.append(el("w:tr", None, head, *made))
        return el("w:tbl", None, *out) + "<w:p/>"  # a paragraph keeps two tables apart

    def image(self, b: dict) -> str:
        """A picture in a paragraph of its own, no wider than the text; '' if its kind or size is unknown."""
        i = b["image"] or {}
        data, ending = self.media_bytes.get(i.get("target"), b""), EXTENSIONS.get(self.mimes.get(i.get("target"), ""))
        px = (i["px_w"], i["px_h"]) if i.get("px_w") and i.get("px_h") else probe(data)
        w, h = i.get("disp_w") or px[0] * 0.75, i.get("disp_h") or px[1] * 0.75
        if not data or not ending or w <= 0 or h <= 0:
            return ""
        if w > WIDTH_POINTS:
            w, h = WIDTH_POINTS, h * WIDTH_POINTS / w
        n = len(self.media) + 1
        name = f"image{n}.{ending}"
        self.media.append((name, data))
        size = {"cx": int(w * EMU), "cy": int(h * EMU)}
        shape = el("pic:spPr", None, el("a:xfrm", None, el("a:off", {"x": 0, "y": 0}), el("a:ext", size)), el("a:prstGeom", {"prst": "rect"}, "<a:avLst/>"))
        fill = el("pic:blipFill", None, el("a:blip", {"r:embed": f"rIdImg{n}"}), "<a:stretch><a:fillRect/></a:stretch>")
        picture = el("pic:pic", None, el("pic:nvPicPr", None, el("pic:cNvPr", {"id": n, "name": name}), "<pic:cNvPicPr/>"), fill, shape)
        graphic = el("a:graphic", None, el("a:graphicData", {"uri": NAMESPACES["xmlns:pic"]}, picture))
        drawing = el("wp:inline", dict.fromkeys(("distT", "distB", "distL", "distR"), 0), el("wp:extent", size), el("wp:docPr", {"id": n, "name": f"Picture {n}"}), graphic)
        return el("w:p", None, el("w:r", None, el("w:drawing", None, drawing)))

    def package(self) -> bytes:
        body = self.blocks("body")
        running = {p: text for p in ("header", "footer") if (text := self.blocks(p))}
        section = [el(f"w:{p}Reference", {"w:type": "default", "r:id": f"rId_{p}"}) for p in running]
        section += [el("w:pgSz", {"w:w": 12240, "w:h": 15840}), el("w:pgMar", dict.fromkeys(("w:top", "w:right", "w:bottom", "w:left"), 1440))]
        files = {"word/document.xml": el("w:document", NAMESPACES, el("w:body", None, body, el("w:sectPr", None, *section)))}
        for p, text in running.items():
            files[f"word/{p}1.xml"] = el("w:hdr" if p == "header" else "w:ftr", NAMESPACES, text)
        files |= {"word/styles.xml": styles(), "word/numbering.xml": numbering(), "docProps/core.xml": core(), "docProps/app.xml": el("Properties", {"xmlns": f"{OFFICE}/extended-properties"}, el("Application", None, "Folia"))}
        rel = lambda i, kind, target: el("Relationship", {"Id": i, "Type": kind, "Target": target})
        inner = [rel("rId1", f"{OFFICE}/relationships/styles", "styles.xml"), rel("rId2", f"{OFFICE}/relationships/numbering", "numbering.xml")]
        inner += [rel(f"rId_{p}", f"{OFFICE}/relationships/{p}", f"{p}1.xml") for p in running]
        inner += [rel(f"rIdImg{n}", f"{OFFICE}/relationships/image", f"media/{name}") for n, (name, _) in enumerate(self.media, 1)]
        files["word/_rels/document.xml.rels"] = el("Relationships", {"xmlns": f"{PACKAGE}/relationships"}, *inner)
        outer = [rel("rId1", f"{OFFICE}/relationships/officeDocument", "word/document.xml"), rel("rId2", f"{PACKAGE}/relationships/metadata/core-properties", "docProps/core.xml"), rel("rId3", f"{OFFICE}/relationships/extended-properties", "docProps/app.xml")]
        files["_rels/.rels"] = el("Relationships", {"xmlns": f"{PACKAGE}/relationships"}, *outer)
        files["[Content_Types].xml"] = self.content_types(running)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as z:
            for name in sorted(files, key=lambda n: (n != "[Content_Types].xml", n)):
                z.writestr(zipfile.ZipInfo(name), HEAD + files[name], zipfile.ZIP_DEFLATED)
            for name, data in self.media:
                z.writestr(zipfile.ZipInfo(f"word/media/{name}"), data, zipfile.ZIP_DEFLATED)
        return out.getvalue()

    def content_types(self, running: dict[str, str]) -> str:
        word = "application/vnd.openxmlformats-officedocument.wordprocessingml"
        kinds = {"word/document.xml": f"{word}.document.main+xml", "word/styles.xml": f"{word}.styles+xml", "word/numbering.xml": f"{word}.numbering+xml"}
        kinds |= {f"word/{p}1.xml": f"{word}.{p}+xml" for p in running}
        kinds |= {"docProps/core.xml": "application/vnd.openxmlformats-package.core-properties+xml", "docProps/app.xml": "application/vnd.openxmlformats-officedocument.extended-properties+xml"}
        endings = {"rels": "application/vnd.openxmlformats-package.relationships+xml", "xml": "application/xml"}
        endings |= {e: m for m, e in EXTENSIONS.items() if any(name.endswith(f".{e}") for name, _ in self.media)}
        return el("Types", {"xmlns": f"{PACKAGE}/content-types"}, *[el("Default", {"Extension": e, "ContentType": m}) for e, m in endings.items()], *[el("Override", {"PartName": f"/{n}", "ContentType": k}) for n, k in kinds.items()])


def styles() -> str:
    normal = el("w:style", {"w:type": "paragraph", "w:default": 1, "w:styleId": "Normal"}, val("w:name", "Normal"))
    heads = [el("w:style", {"w:type": "paragraph", "w:styleId": s}, val("w:name", n), val("w:basedOn", "Normal"), el("w:rPr", None, "<w:b/>", val("w:sz", z))) for s, (n, z) in HEADINGS.items()]
    listed = el("w:style", {"w:type": "paragraph", "w:styleId": "ListParagraph"}, val("w:name", "List Paragraph"), val("w:basedOn", "Normal"))
    return el("w:styles", {"xmlns:w": NAMESPACES["xmlns:w"]}, normal, *heads, listed)


def numbering() -> str:
    """A list of bullets and a list of numbers, of nine levels each."""
    out = []
    for k in range(2):
        levels = []
        for n in range(9):
            mark = [val("w:numFmt", "decimal"), val("w:lvlText", f"%{n + 1}.")] if k else [val("w:numFmt", "bullet"), val("w:lvlText", ("\uf0b7", "o", "\uf0a7")[n % 3])]
            font = "" if k else el("w:rPr", None, el("w:rFonts", {"w:ascii": "Symbol", "w:hAnsi": "Symbol", "w:hint": "default"}))
            levels.append(el("w:lvl", {"w:ilvl": n}, val("w:start", 1), *mark, val("w:lvlJc", "left"), el("w:pPr", None, el("w:ind", {"w:left": 720 * (n + 1), "w:hanging": 360})), font))
        out.append(el("w:abstractNum", {"w:abstractNumId": k}, *levels))
    out += [el("w:num", {"w:numId": k + 1}, val("w:abstractNumId", k)) for k in range(2)]
    return el("w:numbering", {"xmlns:w": NAMESPACES["xmlns:w"]}, *out)


def core() -> str:
    return el("cp:coreProperties", {"xmlns:cp": f"{PACKAGE}/metadata/core-properties", "xmlns:dc": "http://purl.org/dc/elements/1.1/"}, el("dc:creator", None, "Folia"), el("cp:revision", None, "1"))


def packages(blocks: DataFrame, media: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """Packages from blocks: doc, content. media (doc, name, bytes, mime) holds the pictures; without it there are none. A document without blocks isn't there."""
    kind = blocks.schema[doc]
    columns = ["part", "path", "kind", "style", "alignment", "list", "runs", "widths", "cells", "image"]

    def make(table: pa.Table, pictures: pa.Table | None) -> Iterator[pa.Table] | pa.Table:
        rows = [r for r in table.to_pylist() if r["kind"]]
        media_rows = pictures.to_pylist() if pictures is not None else []
        content = Writer(rows, {m["name"]: m["bytes"] for m in media_rows}, {m["name"]: m["mime"] for m in media_rows}).package() if rows else None
        keys = table.column(doc).slice(0, 1) if rows else table.column(doc).slice(0, 0)
        return pa.Table.from_arrays([keys, pa.array([content] if rows else [], pa.binary())], names=[doc, "content"])

    schema = T.StructType([kind, T.StructField("content", T.BinaryType())])
    own = blocks.select(doc, *columns).groupBy(doc)
    if media is None:
        return own.applyInArrow(lambda t: make(t, None), schema)
    return own.cogroup(media.select(doc, "name", "bytes", "mime").groupBy(doc)).applyInArrow(make, schema)


def save(df: DataFrame, folder: str, name: str, content: str = "content") -> DataFrame:
    """Writes each row's content to folder/name, whole or not at all: under another name first, then renamed. Returns name, path, bytes (an action writes).

    folder is one that all executors reach.
    """

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for b in batches:
            rows = []
            for n, data in zip(b.column(name).to_pylist(), b.column(content).to_pylist(), strict=True):
                if n is None or data is None:
                    continue
                final = posixpath.join(base, posixpath.basename(n))
                part = f"{final}.{uuid.uuid4().hex}.part"
                with fs.open_output_stream(part) as f:
                    f.write(data)
                fs.move(part, final)
                rows.append((n, final, len(data)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["name", "path", "bytes"])

    return df.select(F.col(name).cast("string").alias(name), content).mapInArrow(run, "name string, path string, bytes long")
