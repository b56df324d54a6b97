"""Functions, operators, sources and sinks on small hand-made inputs, with boundary constants on both sides and tie rules."""

import struct
import zipfile
import zlib
from io import BytesIO

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folia import functions as fn
from folia.operators import aggregates, folds, joins, windows
from folia.sinks import docx, pdf
from folia.sources import fonts, images, layout, ooxml, xml


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_text_functions(spark):
    one = lambda c, *v: values(spark, [(x,) for x in v], "c string", c(F.col("c")))
    assert one(fn.blank, "", " \t\n", "\u00a0", "a ") == [True, True, False, False]
    assert one(fn.mask_digits, "Page 10") == ["Page ##"]
    assert one(fn.normal_color, "#c0392b", "000000", "auto", "12345") == ["C0392B", "", "", ""]
    assert one(fn.percent_color, "rgb(86.665344%, 89.802551%, 94.116211%)", "none", "rgb(1%, 2%)") == ["DDE5F0", "", ""]
    assert one(fn.font_family, "BAAAAA+LiberationSerif-Bold", "DejaVuSansMono", "TimesNewRomanPSMT", "serif", "ABCDEF+") == ["Liberation Serif", "DejaVu Sans Mono", "Times New Roman", "", "ABCDEF+"]
    assert one(lambda c: fn.int_attr(c, 7), "12abc", " -3", "", "x", None) == [12, -3, 7, 7, 7]
    assert one(lambda c: fn.float_attr(c, 1.5), "2.5pt", ".5", "e5") == [2.5, 0.5, 1.5]
    assert one(fn.flag_on, None, "1", "0", "off", "false") == [True, True, False, False, False]
    assert one(fn.style_from_id, "Heading_20_1", "heading2", "Subtitle", "Title", "Heading4") == ["Heading1", "Heading2", "Heading2", "Title", "Normal"]
    assert one(fn.escape_xml, 'a<b>&"\x01\uffff') == ["a&lt;b&gt;&amp;&quot;\ufffd"]
    assert one(fn.unescape_xml, "&amp;lt; &unknown; &lt;") == ["&lt; &unknown; <"]
    assert one(lambda c: fn.strip_marker(c)["rest"], "• a", "-b", "12) c", "1234. d", "\uf0b7 e") == ["a", "-b", "c", "1234. d", "e"]
    assert one(fn.part_path, "media/a.png", "../x.png", "/word/b") == ["word/media/a.png", "x.png", "word/b"]
    assert one(lambda c: fn.join_lines(F.split(c, "\\|")), "a-|b", "-|b", "a|b") == ["a-b", "- b", "a b"]
    assert one(lambda c: fn.hex_component(c, 1), "00ff00", "xyz") == [1.0, 0.0]
    number = lambda *v: values(spark, [(x,) for x in v], "c double", fn.format_number(F.col("c")))
    assert number(1.0, 2.5, 0.0004, -0.125, 100.0) == ["1", "2.5", "0", "-0.125", "100"]


def test_run_markers(spark):
    run = lambda *texts: ([(t, False, False, "", "") for t in texts],)
    df = spark.createDataFrame([run("\uf0b7", "  Point"), run("1. x", "y"), run("plain")], "runs array<struct<text:string,bold:boolean,italic:boolean,color:string,font:string>>")
    out = [r[0] for r in df.select(fn.strip_run_marker(F.col("runs"))).collect()]
    assert [(o.kind, o.ordinal, "".join(r.text for r in o.runs)) for o in out] == [("Bullet", 0, "Point"), ("Numbered", 1, "xy"), ("None", 0, "plain")]


@pytest.mark.parametrize("ratio,lines,style", [(1.09, 1, "Normal"), (1.10, 1, "Heading3"), (1.22, 1, "Heading2"), (1.40, 3, "Heading1"), (1.70, 1, "Title"), (1.70, 4, "Normal")])
def test_style_boundaries(spark, ratio, lines, style):
    assert values(spark, [(ratio * 100, lines)], "s double, n int", fn.style_for_size(F.col("s"), F.lit(100.0), F.col("n"))) == [style]


def test_axis_and_margin(spark):
    rows = [(0.0, 0.0, 0.6, 5.0), (0.0, 0.0, 0.7, 5.0), (0.0, 0.0, 5.0, 0.5), (0.0, 0.0, 0.5, 1.0)]
    assert values(spark, rows, "a double, b double, c double, d double", fn.axis_aligned(*map(F.col, "abcd"))) == ["V", None, "H", None]
    assert values(spark, [(84.1, 90.0), (84.2, 90.0), (700.0, 757.9)], "t double, b double", fn.in_margin(F.col("t"), F.col("b"), F.lit(842.0))) == ["header", None, "footer"]


def test_anchor_is_not_the_row_before(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (0, 10, 20, 30)], "k int, v double")
    assert [(r.center, r.n) for r in folds.cluster_by_anchor(df, ["k"], "v").orderBy("cluster_no").collect()] == [(5.0, 2), (25.0, 2)]
    drift = folds.cluster_by_drift(spark.createDataFrame([(1, float(v)) for v in (0, 4, 6, 11)], "k int, v double"), ["k"], "v")
    assert [r.pos for r in drift.orderBy("pos_no").collect()] == [4.0, 11.0]


def test_lines_and_cells(spark):
    frags = [(1, 0, 0.0, 10.0, 10.0), (1, 1, 5.9, 10.0, 30.0), (1, 2, 18.0, 5.0, 1.0), (1, 3, 21.0, 5.0, 1.0)]
    df = spark.createDataFrame(frags, "p int, no long, top double, height double, left double")
    assert {r.no: r.line_no for r in folds.anchored_lines(df, ["p"], "no").collect()} == {0: 0, 1: 0, 2: 1, 3: 2}
    cells = spark.createDataFrame([(1, 0, 0.0, 10.0, 20.0), (1, 1, 22.0, 30.0, 20.0), (1, 2, 42.1, 50.0, 20.0)], "p int, no int, left double, right double, size double")
    assert [r.cell for r in windows.gap_cells(cells, ["p"], ["no"], "left", "right", "size").orderBy("no").collect()] == [0, 0, 1]


def test_list_counters(spark):
    rows = [(1, i, num, level, on) for i, (num, level, on) in enumerate([(1, 0, True), (1, 1, True), (1, 1, True), (1, 0, False), (1, 1, True), (1, 0, True), (1, 1, True), (2, 1, True), (0, 0, True), (1, 2, True), (1, 1, True), (1, 2, True)])]
    df = spark.createDataFrame(rows, "d int, seq int, num_id int, level int, numbered boolean")
    assert [r.ordinal for r in windows.list_ordinals(df, ["d"], ["seq"]).orderBy("seq").collect()] == [1, 1, 2, 0, 3, 2, 1, 1, 0, 1, 2, 1]


def test_body_size_ties(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 12.0), ("b", 10.3)], "d string, s double")
    assert {r.d: r.body_size for r in aggregates.body_size(df, ["d"], "s").collect()} == {"a": 10.0, "b": 10.5}


def test_nearest_tie_is_the_last(spark):
    points = spark.createDataFrame([(1, 20.0), (2, 24.0), (3, 24.1)], "k int, pos double")
    anchors = spark.createDataFrame([(0, 10.0), (1, 30.0)], "idx int, x double")
    anchors = anchors.where("x < 20").union(spark.createDataFrame([(1, 30.0)], "idx int, x double"))
    assert {r.k: r.idx for r in joins.nearest(points, anchors, [], "pos", "x", "idx").collect()} == {1: 1, 2: 1, 3: 1}


def rules(*segments):
    return pd.DataFrame([{"horizontal": h, "pos": float(p), "a": float(a), "b": float(b)} for h, p, a, b in segments])


def test_grid_spans():
    """Two columns, two rows; the top row is one cell."""
    g = folds.grid_cells(rules((True, 0, 0, 100), (True, 20, 0, 100), (True, 40, 0, 100), (False, 0, 0, 40), (False, 50, 20, 40), (False, 100, 0, 40)))
    assert g[["r", "c", "row_span", "col_span"]].values.tolist() == [[0, 0, 1, 2], [1, 0, 1, 1], [1, 1, 1, 1]]
    assert g[["b_top", "b_bottom", "b_left", "b_right"]].values.all()
    assert folds.grid_cells(rules((True, 0, 0, 9), (True, 9, 0, 9), (False, 0, 0, 9), (False, 9, 0, 9))).empty  # a box


def test_row_spans_and_components(spark):
    g = folds.grid_cells(rules((True, 0, 0, 100), (True, 20, 50, 100), (True, 40, 0, 100), (False, 0, 0, 40), (False, 50, 0, 40), (False, 100, 0, 40)))
    assert g[["r", "c", "row_span", "col_span"]].values.tolist() == [[0, 0, 2, 1], [0, 1, 1, 1], [1, 1, 1, 1]]
    two = [(1, i, h, float(p), float(a), float(b)) for i, (h, p, a, b) in enumerate([(True, 0, 0, 10), (False, 12, 0, 10), (False, 13, 100, 110), (True, 101, 14, 30)])]
    df = spark.createDataFrame(two, "page int, seg_no long, horizontal boolean, pos double, a double, b double")
    assert [r.component for r in folds.components(df, ["page"]).orderBy("seg_no").collect()] == [0, 0, 2, 2]
    assert folds.ruled_grids(folds.components(df, ["page"]).join(df, ["page", "seg_no"]), ["page"]).count() == 0


def test_grids_in_batches(spark):
    """Many grids reach Python in one batch, are handed on in several, and keep their keys, null ones too."""
    rows = []
    for page in (None, *range(1, 3000)):
        top = 10.0 * (page or 0)
        rows += [(page, 7, h, p, a, b) for h, p, a, b in [(True, top, 0.0, 100.0), (True, top + 20, 0.0, 100.0), (False, 0.0, top, top + 20), (False, 50.0, top, top + 20), (False, 100.0, top, top + 20)]]
    rows += [(5000, 7, True, 0.0, 0.0, 9.0), (5000, 7, False, 0.0, 0.0, 9.0), (5000, 7, False, 9.0, 0.0, 9.0), (5000, 7, False, 30.0, 0.0, 9.0)]  # one horizontal rule
    df = spark.createDataFrame(rows, "page int, component long, horizontal boolean, pos double, a double, b double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    grids = folds.ruled_grids(df, ["page"])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [f.simpleString() for f in grids.schema][:3] == ["page:int", "component:bigint", "r:int"]
    assert "FlatMapGroups" not in grids._jdf.queryExecution().executedPlan().toString()
    got = {(g.page, g.component, g.r, g.c, g.row_span, g.col_span, g.left, g.top, g.b_left) for g in grids.collect()}
    assert got == {(p, 7, 0, c, 1, 1, 50.0 * c, 10.0 * (p or 0), True) for p in (None, *range(1, 3000)) for c in (0, 1)}


def test_large_grid_with_short_rules():
    """300 by 40 cells, each edge a rule of its own, in little time; one edge is missing."""
    edges = [(True, 20 * i, 50 * c, 50 * c + 50) for i in range(301) for c in range(40)] + [(False, 50 * k, 20 * r, 20 * r + 20) for k in range(41) for r in range(300) if (k, r) != (3, 7)]
    g = folds.grid_cells(rules(*edges))
    assert len(g) == 300 * 40 - 1 and g[g.col_span > 1][["r", "c", "col_span", "row_span"]].values.tolist() == [[7, 2, 2, 1]]


def test_page_breaks(spark):
    df = spark.createDataFrame([(1, i, h) for i, h in enumerate([30.0, 30.0, 1.0, 99.0, 5.0])], "d int, no int, h double")
    assert [(r.page, r.used) for r in folds.page_breaks(df, ["d"], ["no"], "h", 60.0).orderBy("no").collect()] == [(0, 0.0), (0, 30.0), (1, 0.0), (2, 0.0), (3, 0.0)]


def test_markup():
    root = xml.parse("<?xml?><!-- c --><a x='1' y=\"&lt;\"><b>t&amp;lt;</wrong>u<c/></a>")[0]
    assert root.attrs == {"x": "1", "y": "<"} and root.all_text() == "t&lt;u" and [c.tag for c in root.children] == ["b", "", "c"]
    for bad in ("<a>", "text", "<a", "<!-- "):
        with pytest.raises(xml.MarkupError):
            xml.parse(bad)
    page = xml.read_page("<ul><li>a<li>b</ul><p>c<br>d</b></p><script>x<y</script>", frozenset(["br"]))
    assert [n.tag for n in page] == ["ul", "p", "script"] and page[1].all_text() == "cd"


def test_node_rows(spark):
    df = spark.createDataFrame([(1, "<a><b k='v'>x</b></a>"), (2, "<a>"), (3, None)], "id int, m string")
    rows = xml.node_rows(df, "m", ["id"]).collect()
    assert [(r.id, r.node_id, r.parent_id, r.tag, r.text) for r in rows if r.id == 1] == [(1, 0, None, "a", ""), (1, 1, 0, "b", ""), (1, 2, 1, "", "x")]
    assert [r.error is not None for r in rows if r.id == 2] == [True] and not [r for r in rows if r.id == 3]


DUMP = """<pdf2xml><page width="600" height="800"><fontspec id="0" size="12" color="#c0392b" family="ABCDEF+DejaVuSans-Bold"/>
<text left="10" top="5" width="50" height="12" font="0">a <b>b <i>c</i></b></text><text left="1" top="2" font="0">  </text><image left="1" top="9" width="3" height="4" src="x.JPG"/></page>
<page><text left="7x" top="8" width="9" height="10" font="0">again</text></page></pdf2xml>"""


def test_layout_dump(spark):
    pages = layout.pages(spark.createDataFrame([(1, DUMP), (2, "<broken"), (3, None)], "doc_id int, xml string"), "xml")
    assert [(r.doc_id, r.page_no, r.width, r.height) for r in pages.collect()] == [(1, 0, 600.0, 800.0), (1, 1, 595.0, 842.0)]
    one, two = layout.fragments(pages).orderBy("page_no").collect()
    assert (one.size, one.color, one.family, one.text) == (12.0, "C0392B", "DejaVu Sans", "a b c")
    assert [(r.text, r.bold, r.italic) for r in one.runs] == [("a ", False, False), ("b ", True, False), ("c", True, True)]
    assert (two.size, two.color, two.left) == (11.0, "", 7.0)
    assert layout.fragments(pages, font_scope="document").where("page_no = 1").first().size == 12.0
    assert layout.images(pages).first().mime == "image/jpeg"


SVG = """<svg><defs><path d="M 0 0 L 9 9" stroke="rgb(0%,0%,0%)"/></defs><path fill="none" stroke="rgb(60%, 60%, 60%)" d="M 10 10 L 110 10" transform="matrix(1,0,0,-1,0,800)"/>
<path stroke="rgb(0%,0%,0%)" d="M 0 0 L 50 50"/><path fill="rgb(100%, 0%, 50%)" d="M 1 1 L 5 1 L 5 9 L 1 9 Z"/><path fill="rgb(1%,1%,1%)" d="M 0 0 L 0.5 9"/></svg>"""


def test_vectors(spark):
    v = layout.vectors(spark.createDataFrame([(1, SVG, 800.0), (2, None, None)], "doc_id int, svg string, h double"), "svg", "h", ["doc_id"])
    assert [(r.horizontal, r.pos, r.a, r.b, r.color) for r in layout.rules(v, ["doc_id"]).collect()] == [(True, 790.0, 10.0, 110.0, "999999")]
    assert [(r.x, r.y, r.w, r.h, r.color) for r in layout.shades(v, ["doc_id"]).collect()] == [(1.0, 1.0, 4.0, 8.0, "FF007F")]


def png(w, h, kind, pixels, filters=None, extra=b""):
    n = images.CHANNELS[kind]
    raw = b"".join(bytes([0]) + bytes(pixels[y * w * n : (y + 1) * w * n]) for y in range(h)) if filters is None else filters
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def filtered(rows, step):
    """Scan lines under each of the five filters in turn."""
    out, above = b"", [0] * len(rows[0])
    for y, row in enumerate(rows):
        line = []
        for x, v in enumerate(row):
            a, b, c = (row[x - step] if x >= step else 0), above[x], (above[x - step] if x >= step else 0)
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, min((a, b, c), key=lambda q: (abs(p - q), [a, b, c].index(q)))][y % 5]
            line.append((v - guess) & 255)
        out += bytes([y % 5, *line])
        above = row
    return out


def test_png():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 256, (10, 18)).tolist()
    e = images.decode_png(png(6, 10, 2, None, filtered(rows, 3)))
    assert zlib.decompress(e.data) == bytes(v for r in rows for v in r) and e.mask is None and e.space == "DeviceRGB"
    e = images.decode_png(png(2, 1, 6, [1, 2, 3, 255, 4, 5, 6, 0]))
    assert zlib.decompress(e.data) == bytes([1, 2, 3, 4, 5, 6]) and zlib.decompress(e.mask) == bytes([255, 0])
    assert images.decode_png(png(2, 1, 6, [1, 2, 3, 255, 4, 5, 6, 255])).mask is None
    assert images.probe(png(6, 10, 2, None, filtered(rows, 3))) == (6, 10) and images.probe(b"nothing") == (0, 0)
    assert images.decode_png(png(6, 10, 2, None, b"\0")) is None
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08\0\x28\0\x3c\x03" + bytes(12)
    assert images.probe(jpeg) == (60, 40) and images.encode_for_pdf(jpeg).filter == "DCTDecode"
    assert images.encode_for_pdf(jpeg.replace(b"\0\x28\0\x3c\x03", b"\0\x28\0\x3c\x04")) is None


def run(text, bold=False, italic=False, color="", font=""):
    return {"text": text, "bold": bold, "italic": italic, "color": color, "font": font}


def para(path, *runs, style="Normal", alignment="Default", item=("None", 0, 0), part="body"):
    return {"part": part, "path": path, "kind": "paragraph", "style": style, "alignment": alignment, "list": dict(zip(("kind", "level", "num_id"), item, strict=True)), "runs": list(runs)}


def cell(row, k, start, grid_span=1, row_span=1, merged=False, header=False, shading="", **edges):
    return {"row": row, "cell": k, "start": start, "grid_span": grid_span, "row_span": row_span, "merged": merged, "header": header, "shading": shading, **dict.fromkeys(("top", "bottom", "left", "right"), True), **edges}


PICTURE = png(4, 2, 2, list(range(24)))


def rich():
    blocks = [
        para([0], run("Title of all"), style="Title", alignment="Center"), para([1], run("This is "), run("bold", bold=True), run(", "), run("both", True, True), run(". Árvíztűrő tükörfúrógép <&>", color="C0392B", font="Noto Sans")),
        para([2], run("point"), item=("Bullet", 0, 1)), para([3], run("inner"), item=("Bullet", 1, 1)), para([4], run("first"), item=("Numbered", 0, 2)), para([5], run("second"), item=("Numbered", 0, 2), alignment="Justify"),
        {"part": "body", "path": [6], "kind": "table", "widths": [3.0, 1.5, 1.5], "cells": [cell(0, 0, 0, header=True), cell(0, 1, 1, 2, header=True, shading="DDE5F0"), cell(1, 0, 0, row_span=2), cell(1, 1, 1, right=False), cell(1, 2, 2), cell(2, 0, 0, merged=True), cell(2, 1, 1), cell(2, 2, 2)]},
        para([6, 0, 0, 0], run("Subject")), para([6, 0, 1, 0], run("When")), para([6, 1, 0, 0], run("Tall")), para([6, 1, 1, 0], run("B/03")), para([6, 2, 2, 0], run("last")),
        {"part": "body", "path": [8], "kind": "image", "image": {"target": "word/media/p.png", "px_w": 4, "px_h": 2, "disp_w": 0.0, "disp_h": 0.0}},
        para([9], run("The end."), alignment="Right"), para([0], run("top line"), part="header", alignment="Center"), para([0], run("bottom line"), part="footer"),
    ]
    return [{"doc_id": "d", "seq": k, **b} for k, b in enumerate(blocks)]


@pytest.fixture(scope="module")
def rich_blocks(spark):
    return spark.createDataFrame(rich(), f"doc_id string, seq int, {ooxml.BLOCK}")


@pytest.fixture(scope="module")
def media(spark):
    return spark.createDataFrame([("d", "word/media/p.png", bytearray(PICTURE), "image/png")], "doc_id string, name string, bytes binary, mime string")


def test_docx_round_trip(spark, rich_blocks, media):
    files = docx.packages(rich_blocks, media)
    content = bytes(files.first().content)
    names = set(zipfile.ZipFile(BytesIO(content)).namelist())
    assert {"[Content_Types].xml", "_rels/.rels", "word/document.xml", "word/header1.xml", "word/footer1.xml", "word/media/image1.png", "word/numbering.xml", "word/styles.xml"} <= names
    back = [r.asDict(True) for r in ooxml.ordinals(ooxml.blocks(files)).orderBy("seq").collect()]
    assert all(b["error"] is None for b in back)
    texts = lambda bs: ["".join(r["text"] for r in b["runs"]) for b in bs if b["kind"] == "paragraph"]
    assert texts(back) == texts(rich())
    paras = [b for b in back if b["kind"] == "paragraph"]
    assert [b["style"] for b in paras[:2]] == ["Title", "Normal"] and paras[0]["alignment"] == "Center" and paras[5]["alignment"] == "Justify"
    assert [(b["list"]["kind"], b["list"]["level"], b["ordinal"]) for b in paras[2:6]] == [("Bullet", 0, 0), ("Bullet", 1, 0), ("Numbered", 0, 1), ("Numbered", 0, 2)]
    assert [(r["text"], r["bold"], r["italic"]) for r in paras[1]["runs"]][:4] == [("This is ", False, False), ("bold", True, False), (", ", False, False), ("both", True, True)]
    assert paras[1]["runs"][-1]["color"] == "C0392B" and paras[1]["runs"][-1]["font"] == "Noto Sans"
    table = next(b for b in back if b["kind"] == "table")
    want = next(b for b in rich() if b["kind"] == "table")
    assert table["cells"] == want["cells"] and table["widths"] == [4680.0, 2340.0, 2340.0]
    image = next(b for b in back if b["kind"] == "image")["image"]
    assert (image["px_w"], image["px_h"], image["disp_w"], image["disp_h"]) == (4, 2, 3.0, 1.5)
    assert {b["part"] for b in paras[-2:]} == {"header", "footer"}
    parts = {r.name: bytes(r.bytes) for r in ooxml.parts(files).collect()}
    assert parts["word/media/image1.png"] == PICTURE


def test_docx_faults(spark):
    df = spark.createDataFrame([("a", bytearray(b"no package")), ("b", None)], "doc_id string, content binary")
    assert [r.error for r in ooxml.blocks(df).collect()] == ["not a package with a document"] * 2


def package(document, **parts):
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document><w:body>{document}</w:body></w:document>")
        for name, data in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), data)
    return out.getvalue()


def test_docx_marks():
    blocks, error = ooxml.read_package(package("<w:p><w:pPr><w:pStyle w:val='Heading_20_2'/></w:pPr><w:r><w:t>H</w:t></w:r><w:r><w:rPr><w:b w:val='0'/></w:rPr><w:t>x</w:t><w:tab/><w:br/></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:ins><w:hyperlink><w:r><w:t>in</w:t></w:r></w:hyperlink></w:ins></w:p><w:sdt><w:p><w:r><w:t>skipped</w:t></w:r></w:p></w:sdt><w:p><w:r><w:t> </w:t></w:r></w:p>"))
    assert error is None and len(blocks) == 1
    assert [(r["text"], r["bold"]) for r in blocks[0]["runs"]] == [("H", True), ("x\t ", False), ("in", True)]
    table, _ = ooxml.read_package(package("<w:tbl><w:tblGrid><w:gridCol w:w='5'/></w:tblGrid><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"))
    assert table[0]["widths"] == [] and [c["merged"] for c in table[0]["cells"]] == [False, False]


def objects(data):
    """Offsets of the objects from the file's table, each checked to point at its object."""
    at = int(data.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    lines = data[at:].split(b"\n")
    assert lines[0] == b"xref"
    n = int(lines[1].split()[1])
    for k in range(1, n):
        offset = int(lines[2 + k][:10])
        assert data[offset:].startswith(b"%d 0 obj" % k)
    return n


@pytest.mark.skipif(fonts.find("Regular") is None, reason="no font")
def test_pdf(spark, rich_blocks, media):
    numbered = ooxml.ordinals(rich_blocks)
    row = pdf.files(numbered, media).first()
    data = bytes(row.content)
    assert data.startswith(b"%PDF-1.7") and row.pages == 1 and objects(data) > 15 and b"/Subtype /Image" in data
    placed = pdf.placed(numbered, media).collect()
    texts = [r.text.strip() for r in placed if r.kind == "text"]
    assert {"Title of all", "•", "◦", "1.", "2.", "Tall", "top line", "bottom line"} <= set(texts)
    assert sum(r.kind == "image" for r in placed) == 1 and sum(r.kind == "fill" for r in placed) == 2
    assert sum(r.kind == "rule" for r in placed) == 8 * 4 - 1
    title = next(r for r in placed if r.text == "Title of all")
    assert title.x == pytest.approx((pdf.WIDTH - title.w) / 2) and title.face == "Bold"
    end = next(r for r in placed if r.text == "The end.")
    assert end.x + end.w == pytest.approx(pdf.WIDTH - pdf.MARGIN)


@pytest.mark.skipif(fonts.find("Regular") is None, reason="no font")
def test_wrap_and_pages(spark):
    lines = pdf.wrap([run("aa bb"), run("cc", bold=True), run(" " + "w" * 200)], 100.0, 11.0)
    assert ["".join(p.text for p in ln) for ln in lines][0].startswith("aa bbcc") and len(lines) > 10
    assert all(pdf.line_width(ln, 11.0) <= 101 for ln in lines)
    assert pdf.wrap([], 100.0, 11.0) == [[]]
    rows = [{"doc_id": "d", "seq": k, **para([k], run(f"paragraph {k}"))} for k in range(90)]
    rows += [{"doc_id": "d", "seq": 90, **para([0], run("head"), part="header")}]
    df = spark.createDataFrame(rows, f"doc_id string, seq int, {ooxml.BLOCK}")
    placed = pdf.placed(df)
    assert pdf.files(df).first().pages == 3
    assert placed.where("text = 'head'").count() == 3


@pytest.mark.skipif(fonts.find("Regular") is None, reason="no font")
def test_font_subset():
    font = fonts.faces()["Regular"]
    glyphs = {font.glyph(c) for c in "Aé"}
    small = font.subset(glyphs)
    assert len(small) < len(font.data) // 4 and small[:4] == b"\0\1\0\0"
    assert font.components(font.glyph("é")) and font.glyph("\U0010fffe") == 0 and font.advance(1 << 17) == 0.5
    with pytest.raises(ValueError):
        fonts.Font(b"OTTO" + bytes(20))


def test_catalogue_matches(spark):
    """A sample of the catalogue against DuckDB on the smallest tables."""
    import duckdb

    from folia import catalog
    from tests.conftest import SF

    db = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("running_text_safe", "list_ordinals", "line_grouping", "nearest_column", "segment_components", "interleave_by_position", "list_marker_strip"):
        df = catalog.queries()[name](spark, SF)
        want = db.sql(catalog.oracle_sql()[name])
        columns = sorted(df.columns)
        assert columns == sorted(want.columns)
        order = [want.columns.index(c) for c in columns]
        got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
        assert got and got == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str), name
