"""Whole conversions: a layout dump with drawings to blocks, a package, and pages."""

import pytest

from folia.plans import assemble
from folia.sinks import docx, pdf
from folia.sources import fonts, layout, ooxml


def text(left, top, width, words, height=12, font="0"):
    return f'<text left="{left}" top="{top}" width="{width}" height="{height}" font="{font}">{words}</text>'


def page(n, body):
    declared = '<fontspec id="0" size="11" color="#000000" family="Arial"/><fontspec id="1" size="22" color="#c0392b" family="Arial"/>'
    return f'<page width="600" height="800">{declared}{text(50, 20, 100, "Report head")}{body}{text(50, 770, 50, f"Page {n}")}</page>'


def dump():
    first = text(50, 100, 200, "<b>Big title</b>", 24, "1") + text(50, 140, 490, "This line is full and goes on to") + text(50, 154, 100, "the next one.") + text(50, 190, 60, "\u2022 first point")
    first += text(50, 230, 50, "<b>Name</b>") + text(200, 230, 50, "<b>Age</b>") + text(50, 246, 50, "Ann") + text(202, 246, 20, "7")
    first += '<image left="60" top="300" width="90" height="40" src="a.png"/>' + text(60, 402, 30, "cell A") + text(160, 402, 30, "cell B") + text(60, 424, 60, "wide below")
    second = text(50, 100, 490, "Another page with enough text") + text(50, 114, 20, "end.")
    return f"<pdf2xml>{page(1, first)}{page(2, second)}</pdf2xml>"


def drawing():
    lines = [(50, 400, 250, 400), (50, 420, 250, 420), (50, 440, 250, 440), (50, 400, 50, 440), (150, 400, 150, 420), (250, 400, 250, 440)]
    strokes = "".join(f'<path stroke="rgb(60%,60%,60%)" d="M {a} {b} L {c} {d}"/>' for a, b, c, d in lines)
    return f'<svg>{strokes}<path fill="rgb(100%,0%,0%)" d="M 50 400 L 150 400 L 150 420 L 50 420 Z"/></svg>'


def test_dump_to_documents(spark):
    pages = layout.pages(spark.createDataFrame([("a", dump())], "doc_id string, x string"), "x")
    key = ["doc_id", "page_no"]
    vectors = layout.vectors(spark.createDataFrame([("a", 0, drawing(), 800.0)], "doc_id string, page_no int, svg string, h double"), "svg", "h", key)
    blocks = assemble.blocks(pages, layout.fragments(pages), layout.images(pages), layout.rules(vectors, key), layout.shades(vectors, key))
    rows = blocks.orderBy("part", "path").collect()
    said = lambda r: "".join(x.text for x in r.runs or [])
    body = [r for r in rows if r.part == "body" and len(r.path) == 1]
    assert [(r.kind, said(r)) for r in body] == [
        ("paragraph", "Big title"), ("paragraph", "This line is full and goes on to the next one."), ("paragraph", "first point"), ("table", ""), ("image", ""), ("table", ""), ("paragraph", "Another page with enough text end."),
    ]
    assert (body[0].style, body[0].runs[0].bold, body[0].runs[0].color) == ("Title", True, "C0392B") and body[2].list.kind == "Bullet"
    assert body[3].widths == [151.0, 339.0] and [c.header for c in body[3].cells] == [True, True, False, False]
    assert body[5].widths == [100.0, 100.0] and [(c.grid_span, c.shading) for c in body[5].cells] == [(1, "FF0000"), (1, ""), (2, "")]
    assert [(r.path[1:], said(r)) for r in rows if r.part == "body" and len(r.path) > 1] == [
        ([0, 0, 0], "Name"), ([0, 1, 0], "Age"), ([1, 0, 0], "Ann"), ([1, 1, 0], "7"), ([0, 0, 0], "cell A"), ([0, 1, 0], "cell B"), ([1, 0, 0], "wide below"),
    ]
    assert [(r.part, said(r)) for r in rows if r.part != "body"] == [("footer", "Page 1"), ("header", "Report head")]
    back, error = ooxml.read_package(bytes(docx.packages(blocks).first().content))
    assert error is None and sum(b["kind"] == "table" for b in back) == 2
    if fonts.find("Regular"):
        assert pdf.files(blocks).first().pages == 1


def test_packages_to_pages(spark):
    import io
    import zipfile

    from folia.plans import convert

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<w:document><w:body><w:p><w:r><w:t>Some words</w:t></w:r></w:p></w:body></w:document>")
    files = spark.createDataFrame([("good", bytearray(out.getvalue())), ("bad", bytearray(b"%PDF-1.4"))], "doc_id string, content binary")
    if not fonts.find("Regular"):
        pytest.skip("no font")
    got = {r.doc_id: r for r in convert.packages_to_pages(files).collect()}
    assert got["good"].status == "ok" and bytes(got["good"].content).startswith(b"%PDF-1.7") and got["bad"].content is None and got["bad"].status != "ok"


def test_external_programs():
    from folia.sources import external

    assert external.run(["python3", "-c", "print(1)"]).output == b"1\n"
    assert external.run(["no-such-program"]).code == 127
    assert external.run(["python3", "-c", "import time; time.sleep(9)"], timeout=0.5).code == 124
    if not external.available("pdftohtml"):
        assert external.dump_pdf(b"%PDF")[0] == "no program"


def test_stream_of_packages(spark, tmp_path):
    import zipfile

    from folia import streaming

    (tmp_path / "in").mkdir()
    for k in range(2):
        with zipfile.ZipFile(tmp_path / "in" / f"{k}.docx", "w") as z:
            z.writestr("word/document.xml", f"<w:document><w:body><w:p><w:r><w:t>document {k}</w:t></w:r></w:p></w:body></w:document>")
    query = streaming.blocks_of_new_files(spark, str(tmp_path / "in"), files_per_batch=1).writeStream.format("memory").queryName("stream_blocks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(r.runs[0].text for r in spark.table("stream_blocks").collect()) == ["document 0", "document 1"]
