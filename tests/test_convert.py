"""Pictures and recognised text on the way from pages to packages, built documents, and the command line."""

import os
import stat
import subprocess
import sys
import zipfile
import zlib
from io import BytesIO

import pytest

from folia.plans import build, convert
from folia.sinks import docx, pdf
from folia.sources import external, fonts, ooxml
from folia.sources.ooxml import read_package

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def png(w, h):
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + b"\x10\x20\x30" * w for _ in range(h)))) + chunk(b"IEND", b"")


DUMP = """<pdf2xml><page width="595" height="842"><fontspec id="0" size="11" family="Arial" color="#000000"/>
<text top="100" left="50" width="300" height="12" font="0">Before the picture</text><image top="200" left="50" width="60" height="40" src="/tmp/x/out-1_1.png"/>
<text top="400" left="50" width="300" height="12" font="0">After the picture</text></page></pdf2xml>"""
BARE = '<pdf2xml><page width="595" height="842"><image top="0" left="0" width="595" height="842" src="out-1_1.png"/></page></pdf2xml>'


def test_pictures_come_along(spark):
    rows = [("a", DUMP, [""], [{"name": "out-1_1.png", "bytes": bytearray(png(6, 4))}]), ("b", BARE, [""], [{"name": "out-1_1.png", "bytes": bytearray(png(6, 4))}])]
    dumps = spark.createDataFrame(rows, "doc_id string, xml string, drawings array<string>, media array<struct<name:string,bytes:binary>>")
    got = {r.doc_id: r for r in convert.dumps_to_packages(dumps).collect()}
    assert got["a"].status == "ok" and got["b"].status == external.NO_TEXT and got["b"].content is None
    found, error = read_package(bytes(got["a"].content))
    assert error is None and [b["kind"] for b in found] == ["paragraph", "image", "paragraph"]
    with zipfile.ZipFile(BytesIO(bytes(got["a"].content))) as z:
        assert z.read("word/media/image1.png") == png(6, 4)


def test_recognised_lines(spark):
    lines = ["", "  First line\r", "\tgoes on with a hy-", "phen.", " ", "", "-", "x", " ", ""]
    df = spark.createDataFrame([("s", n, x) for n, x in enumerate(lines)] + [("none", None, None), ("blank", 0, "  ")], "doc_id string, line_no int, line string")
    got = {r.doc_id: bytes(r.content) for r in convert.lines_to_packages(df).collect()}
    assert set(got) == {"s"}
    assert ["".join(r["text"] for r in b["runs"]) for b in read_package(got["s"])[0]] == ["First line goes on with a hy-phen.", "- x  "]


def program(folder, name, body):
    path = folder / name
    path.write_text(f"#!{sys.executable}\nimport sys\nfrom pathlib import Path\n{body}\n")
    path.chmod(path.stat().st_mode | stat.S_IEXEC)


def test_stand_in_programs(tmp_path, monkeypatch):
    """Dumps, drawings, pictures and recognition as the real programs give them."""
    program(tmp_path, "pdftohtml", f"out = Path(sys.argv[-1]); Path(f'{{out}}.xml').write_text({DUMP!r}); Path(f'{{out}}-1_1.png').write_bytes({png(2, 2)!r})")
    program(tmp_path, "pdftocairo", "Path(sys.argv[-1]).write_text('<svg/>')")
    program(tmp_path, "pdftoppm", "[Path(f'{sys.argv[-1]}-{k}.png').write_bytes(b'') for k in (2, 1)]")
    program(tmp_path, "tesseract", "sys.exit(1) if 'hun+eng' in sys.argv else print('page', Path(sys.argv[1]).stem[-1])")
    monkeypatch.setenv("PATH", f"{tmp_path}:/usr/bin:/bin")
    status, dump, drawings, media = external.dump_pdf(b"%PDF")
    assert (status, dump, drawings) == ("ok", DUMP, ["<svg/>"]) and media == [{"name": "out-1_1.png", "bytes": png(2, 2)}]
    assert external.recognize(b"%PDF") == ("ok", ["page 1", "", "", "page 2", "", ""])


def rich() -> build.Document:
    d = build.Document()
    d.paragraph("Title of it", "Title").paragraph("First chapter", "Heading1")
    d.paragraph([build.run("This is "), build.run("bold", bold=True), build.run(", "), build.run("red", color="C0392B")])
    d.paragraph("one", listed="Bullet").paragraph("deeper", listed="Bullet", level=1).paragraph("first", listed="Numbered", ordinal=1).paragraph("second", listed="Numbered", ordinal=2)
    d.table([["Subject", "Day", "Room"], [build.Cell([[build.run("Both")]], grid_span=2, shading="DDE5F0"), build.Cell([[build.run("A"), build.run("12", bold=True)]], row_span=2)], ["x", "y"]], [3, 1.5, 1.5], header=True)
    d.picture(png(6, 4), "image/png").paragraph("Head", part="header").paragraph("The end.")
    return d


def test_built_documents(spark):
    blocks, media = build.blocks(spark, {"d": rich(), "empty": build.Document().paragraph("")})
    made = {r.doc_id: bytes(r.content) for r in docx.packages(blocks, media).collect()}
    found, error = read_package(made["d"])
    assert error is None and [b["kind"] for b in found if b["part"] == "body" and len(b["path"]) == 1] == ["paragraph"] * 7 + ["table", "image", "paragraph"]
    assert [r["text"] for r in found[2]["runs"]] == ["This is ", "bold", ", ", "red"] and found[2]["runs"][3]["color"] == "C0392B"
    table = next(b for b in found if b["kind"] == "table")
    assert [(c["row"], c["start"], c["grid_span"], c["row_span"], c["merged"], c["header"], c["shading"]) for c in table["cells"]] == [
        (0, 0, 1, 1, False, True, ""), (0, 1, 1, 1, False, True, ""), (0, 2, 1, 1, False, True, ""), (1, 0, 2, 1, False, False, "DDE5F0"), (1, 2, 1, 2, False, False, ""),
        (2, 0, 1, 1, False, False, ""), (2, 1, 1, 1, False, False, ""), (2, 2, 1, 1, True, False, ""),
    ]
    files = docx.packages(blocks, media)
    assert [r.ordinal for r in ooxml.ordinals(ooxml.blocks(files.where("doc_id = 'd'"))).orderBy("seq").collect() if r.list and r.list.kind == "Numbered"] == [1, 2]
    if fonts.find("Regular"):
        assert {r.doc_id: r.pages for r in pdf.files(blocks, media).collect()}["d"] == 1


def test_command_line(spark, tmp_path):
    from folia.__main__ import main

    assert main([]) == 2 and main(["a.docx"]) == 2 and main(["a.txt", "b.pdf"]) == 2
    blocks, media = build.blocks(spark, {"d": rich()})
    (tmp_path / "in.docx").write_bytes(bytes(docx.packages(blocks, media).first().content))
    (tmp_path / "fake.docx").write_bytes(b"no package")
    call = lambda name: subprocess.run([sys.executable, "-m", "folia", str(tmp_path / name), str(tmp_path / "out.pdf")], cwd=ROOT, capture_output=True, timeout=300, check=False)
    assert call("fake.docx").returncode == 1 and not (tmp_path / "out.pdf").exists()
    if not fonts.find("Regular"):
        pytest.skip("no font")
    assert call("in.docx").returncode == 0 and (tmp_path / "out.pdf").read_bytes().startswith(b"%PDF-1.7")
