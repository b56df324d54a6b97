"""Word-processing packages (DOCX) as tables.

Each package is unzipped once, into rows of parts or of blocks. A block is a paragraph, a table or a picture in one order per
part; cells nest by path, as a struct can't hold itself: the path of a block in a cell is the table's path, row, cell and
the block's number there.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia import functions as fn

from .images import probe
from .xml import MarkupError, Node, parse

BLOCK = (
    "part string, path array<int>, kind string, style string, alignment string, list struct<kind:string,level:int,num_id:int>, "
    "runs array<struct<text:string,bold:boolean,italic:boolean,color:string,font:string>>, widths array<double>, "
    "cells array<struct<row:int,cell:int,start:int,grid_span:int,row_span:int,merged:boolean,header:boolean,shading:string,top:boolean,bottom:boolean,left:boolean,right:boolean>>, "
    "image struct<target:string,px_w:int,px_h:int,disp_w:double,disp_h:double>"
)
_INT = re.compile(r"\s*([+-]?[0-9]+)")
_PASS = {"w:hyperlink", "w:smartTag", "w:ins", "w:sdt", "w:sdtContent", "w:bdo"}
_TEXT = {"w:tab": "\t", "w:br": " ", "w:cr": " ", "w:sym": " ", "w:noBreakHyphen": "-"}


def _int(node: Node | None, name: str, fallback: int) -> int:
    m = _INT.match(node.attrs.get(name, "")) if node is not None else None
    return int(m[1]) if m else fallback


def _value(node: Node | None, *path: str, name: str = "w:val") -> str | None:
    for tag in path:
        node = node.child(tag) if node is not None else None
    return node.attrs.get(name) if node is not None else None


def _on(node: Node | None, otherwise: bool) -> bool:
    return otherwise if node is None else node.attrs.get("w:val") not in ("0", "false", "off")


def color(raw: str) -> str:
    digits = re.sub("[^0-9A-Fa-f]", "", raw).upper()
    return digits if len(digits) == 6 and digits != "000000" else ""


def style_of(style_id: str | None) -> str:
    key = re.sub("[^a-z0-9]", "", (style_id or "").lower())
    m = re.fullmatch("heading(?:20)?([123])", key)
    return "Title" if key == "title" else "Heading2" if key == "subtitle" else f"Heading{m[1]}" if m else "Normal"


ALIGNMENTS = {"center": "Center", "right": "Right", "end": "Right", "both": "Justify", "distribute": "Justify", "left": "Left", "start": "Left"}


class Package:
    """The parts of a package; a part that is missing or broken is empty."""

    def __init__(self, content: bytes | None):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content or b""))
            self.names = {i.filename: i for i in self.zip.infolist()}
        except (zipfile.BadZipFile, OSError, ValueError):
            self.zip, self.names = None, {}

    def part(self, name: str) -> bytes:
        try:
            return self.zip.read(self.names[name]) if name in self.names else b""
        except (zipfile.BadZipFile, OSError, zlib.error, NotImplementedError, RuntimeError, EOFError):
            return b""

    def roots(self, name: str) -> list[Node]:
        try:
            return parse(self.part(name).decode("utf-8", "replace"))
        except MarkupError:
            return []

    def relationships(self) -> dict[str, str]:
        return {r.attrs["Id"]: r.attrs["Target"] for root in self.roots("word/_rels/document.xml.rels")[:1] for r in root.all("Relationship") if {"Id", "Target"} <= r.attrs.keys()}

    def numbering(self) -> dict[tuple[int, int], bool]:
        """Whether a list's level is numbered, where that is known."""
        levels: dict[int, dict[int, bool]] = {}
        out = {}
        for root in self.roots("word/numbering.xml")[:1]:
            for a in root.all("w:abstractNum"):
                own = levels.setdefault(_int(a, "w:abstractNumId", -1), {})
                for lvl in a.all("w:lvl"):
                    own[_int(lvl, "w:ilvl", 0)] = (_value(lvl, "w:numFmt") or "bullet") not in ("bullet", "none")
            for n in root.all("w:num"):
                ref = n.child("w:abstractNumId")
                for level, numbered in levels.get(_int(ref, "w:val", -1), {}).items():
                    out[_int(n, "w:numId", -1), level] = numbered
        return out


def part_name(target: str) -> str:
    target = target[3:] if target.startswith("../") else target
    return target[1:] if target.startswith("/") else target if target.startswith("word/") else f"word/{target}"


class _Reader:
    """Blocks of one package."""

    def __init__(self, package: Package):
        self.package, self.rels, self.numbering = package, package.relationships(), package.numbering()

    def body(self, node: Node, part: str, path: tuple[int, ...], out: list[dict], tables: bool = True) -> None:
        """The paragraphs and tables that stand directly under a node; pictures follow their paragraph."""
        n = 0
        for c in node.children:
            if c.tag == "w:p":
                for block in self.paragraph(c):
                    out.append({"part": part, "path": [*path, n], **block})
                    n += 1
            elif c.tag == "w:tbl" and tables:
                n += self.table(c, part, (*path, n), out)

    def paragraph(self, p: Node) -> list[dict]:
        props = p.child("w:pPr")
        style = style_of(_value(props, "w:pStyle"))
        runs: list[dict] = []
        pictures: list[dict] = []
        self.runs(p, style != "Normal", runs, pictures)
        num = props.child("w:numPr") if props is not None else None
        num_id, level = (_int(num.child("w:numId"), "w:val", 0), max(0, _int(num.child("w:ilvl"), "w:val", 0))) if num is not None else (0, 0)
        item = {"kind": "None", "level": 0, "num_id": 0}
        if num_id > 0:
            item = {"kind": "Numbered" if self.numbering.get((num_id, level)) else "Bullet", "level": level, "num_id": num_id}
        own = [{"kind": "paragraph", "style": style, "alignment": ALIGNMENTS.get(_value(props, "w:jc") or "", "Default"), "list": item, "runs": runs}] if runs else []
        return own + pictures

    def runs(self, node: Node, bold: bool, runs: list[dict], pictures: list[dict]) -> None:
        for c in node.children:
            if c.tag in _PASS:
                self.runs(c, bold, runs, pictures)
            elif c.tag == "w:r":
                props = c.child("w:rPr") or Node()
                style = {"bold": _on(props.child("w:b"), bold), "italic": _on(props.child("w:i"), False), "color": color(_value(props, "w:color") or ""), "font": _value(props, "w:rFonts", name="w:ascii") or ""}
                for x in c.children:
                    text = x.all_text() if x.tag == "w:t" else _TEXT.get(x.tag, "")
                    if text and runs and all(runs[-1][k] == v for k, v in style.items()):
                        runs[-1]["text"] += text
                    elif text:
                        runs.append({"text": text, **style})
                    elif x.tag in ("w:drawing", "w:pict", "w:object") and (picture := self.picture(x)):
                        pictures.append(picture)

    def picture(self, node: Node) -> dict | None:
        ids = [b.attrs.get("r:embed") or b.attrs.get("r:link") for b in node.all("a:blip")] + [v.attrs.get("r:id") for v in node.all("v:imagedata")]
        target = self.rels.get(next((i for i in ids if i), ""))
        if target is None or not (content := self.package.part(part_name(target))):
            return None
        w, h = probe(content)
        size = next(iter([*node.all("wp:extent"), *node.all("a:ext")]), None)
        cx, cy = _int(size, "cx", 0), _int(size, "cy", 0)
        shown = cx > 0 and cy > 0
        return {"kind": "image", "image": {"target": part_name(target), "px_w": w, "px_h": h, "disp_w": cx / fn.geometry.EMU if shown else 0.0, "disp_h": cy / fn.geometry.EMU if shown else 0.0}}

    def table(self, tbl: Node, part: str, path: tuple[int, ...], out: list[dict]) -> int:
        """Adds a table, then what its cells hold; 0 if it has no cells. A cell merged into one above is empty and lengthens that one."""
        grid = tbl.child("w:tblGrid")
        widths = [float(max(1, _int(c, "w:w", 1))) for c in (grid.children if grid is not None else []) if c.tag == "w:gridCol"]
        cells: list[dict] = []
        inner: list[dict] = []
        above: dict[int, dict] = {}
        rows = [r for r in ([c for c in tr.children if c.tag == "w:tc"] + [tr] for tr in tbl.children if tr.tag == "w:tr") if len(r) > 1]
        for r, (*tcs, tr) in enumerate(rows):
            start = 0
            head = tr.child("w:trPr")
            for k, tc in enumerate(tcs):
                props = tc.child("w:tcPr") or Node()
                borders, merge = props.child("w:tcBorders"), props.child("w:vMerge")
                span = max(1, _int(props.child("w:gridSpan"), "w:val", 1))
                edges = {e: _value(borders, f"w:{e}") != "nil" for e in ("top", "bottom", "left", "right")}
                merged = merge is not None and merge.attrs.get("w:val") != "restart" and start in above
                cell = {"row": r, "cell": k, "start": start, "grid_span": span, "row_span": 1, "merged": merged, "header": head is not None and head.child("w:tblHeader") is not None, "shading": color(_value(props, "w:shd", name="w:fill") or ""), **edges}
                if merged:
                    above[start]["row_span"] += 1
                else:
                    above[start] = cell
                    self.body(tc, part, (*path, r, k), inner)
                cells.append(cell)
                start += span
        if not cells:
            return 0
        widest = max(sum(c["grid_span"] for c in cells if c["row"] == r) for r in range(len(rows)))
        out.append({"part": part, "path": list(path), "kind": "table", "widths": widths if len(widths) == widest else [], "cells": cells})
        out.extend(inner)
        return 1


def read_package(content: bytes | None) -> tuple[list[dict], str | None]:
    """Blocks of body, header and footer, and what is wrong (None if nothing)."""
    package = Package(content)
    if not package.part("word/document.xml"):
        return [], "not a package with a document"
    try:
        roots = parse(package.part("word/document.xml").decode("utf-8", "replace"))
    except MarkupError as e:
        return [], f"document: {e}"
    document = next((r for r in roots if r.tag == "w:document"), None)
    if document is None:
        return [], "document has no root"
    reader = _Reader(package)
    blocks: list[dict] = []
    reader.body(document.child("w:body") or document, "body", (), blocks)
    found: set[str] = set()
    for section in document.all("w:sectPr"):
        for c in section.children:
            part = {"w:headerReference": "header", "w:footerReference": "footer"}.get(c.tag)
            target = reader.rels.get(c.attrs.get("r:id", ""))
            if part is None or part in found or target is None or c.attrs.get("w:type", "default") != "default":
                continue
            running: list[dict] = []
            for root in package.roots(target if target.startswith("word/") else f"word/{target}")[:1]:
                reader.body(root, part, (), running, tables=False)
            running = [b for b in running if b["kind"] == "paragraph"]
            if running:
                found.add(part)
                blocks.extend(running)
    last = max((b["path"][0] for b in blocks if b["part"] == "body" and len(b["path"]) == 1 and (b["kind"] != "paragraph" or "".join(r["text"] for r in b["runs"]).strip(" \t\n\v\f\r"))), default=-1)
    return [b for b in blocks if b["part"] != "body" or b["path"][0] <= last], None


def blocks(files: DataFrame, content: str = "content", doc: str = "doc_id") -> DataFrame:
    """Blocks of packages in document order: doc, seq, part, path, kind, style, alignment, list, runs, widths, cells, image, error.

    A file that is no package gives one row with its error; the rest of the job goes on. Ordinals of numbered items are list_ordinals' work.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    made = T.StructType([T.StructField("seq", T.IntegerType()), *T._parse_datatype_string(BLOCK).fields, T.StructField("error", T.StringType())])
    arrow = to_arrow_schema(made)

    def run(batches):
        for b in batches:
            index, flat = [], []
            for k, c in enumerate(b.column(content).to_pylist()):
                found, error = read_package(c)
                rows = [{**r, "seq": i} for i, r in enumerate(found)] if error is None else [{"error": error}]
                flat += rows
                index += [k] * len(rows)
            yield pa.RecordBatch.from_arrays([b.column(doc).take(pa.array(index, pa.int32())), *[pa.array([r.get(f.name) for r in flat], f.type) for f in arrow]], names=[doc, *arrow.names])

    return files.select(doc, content).mapInArrow(run, T.StructType([files.schema[doc], *made.fields]))


def ordinals(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Blocks with `ordinal`, the number of numbered list items, counted over the body and on through header and footer."""
    from folia.operators.windows import list_ordinals

    flat = blocks.withColumns({"num_id": F.coalesce("list.num_id", F.lit(0)), "level": F.coalesce("list.level", F.lit(0)), "numbered": F.coalesce(F.col("list.kind") == "Numbered", F.lit(False))})
    return list_ordinals(flat, [doc], ["seq"]).drop("num_id", "level", "numbered")


def parts(files: DataFrame, content: str = "content", doc: str = "doc_id") -> DataFrame:
    """All parts of packages: doc, name, bytes."""

    def run(batches):
        for b in batches:
            index, names, data = [], [], []
            for k, c in enumerate(b.column(content).to_pylist()):
                package = Package(c)
                for name in package.names:
                    index.append(k)
                    names.append(name)
                    data.append(package.part(name))
            yield pa.RecordBatch.from_arrays([b.column(doc).take(pa.array(index, pa.int32())), pa.array(names, pa.string()), pa.array(data, pa.binary())], names=[doc, "name", "bytes"])

    return files.select(doc, content).mapInArrow(run, T.StructType([files.schema[doc], T.StructField("name", T.StringType()), T.StructField("bytes", T.BinaryType())]))


def files(spark, path: str, glob: str = "*.docx") -> DataFrame:
    """Files of a folder: doc_id (the path), content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("doc_id"), "content")
