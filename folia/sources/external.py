"""External programs in tasks: layout dumps of PDFs, drawings of their pages, and text recognition, where the programs are installed.

A program gets a list of arguments, never a shell's line, and a time limit. A document that fails has a status; others go on.
"""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

NO_TEXT = "NO_TEXT_EXTRACTED"
DPI = 300


@dataclass
class Result:
    code: int
    output: bytes


def run(args: list[str], folder: str | None = None, timeout: float = 300.0) -> Result:
    """A program's exit code and output; 127 if it isn't there, 124 if it takes too long. What it says on the error stream goes."""
    try:
        done = subprocess.run(args, cwd=folder, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, stdin=subprocess.DEVNULL, timeout=timeout, check=False)
    except FileNotFoundError:
        return Result(127, b"")
    except subprocess.TimeoutExpired:
        return Result(124, b"")
    return Result(done.returncode, done.stdout)


def available(program: str) -> bool:
    return shutil.which(program) is not None


PICTURES = (".png", ".jpg", ".jpeg")


def dump_pdf(content: bytes | None, programs: dict[str, str] | None = None) -> tuple[str, str, list[str], list[dict]]:
    """status, layout dump, a drawing for each page ('' where there is none), and the pictures that the dump names. Statuses: ok, no program, failed, NO_TEXT_EXTRACTED."""
    tool = {"dump": "pdftohtml", "draw": "pdftocairo"} | (programs or {})
    if not available(tool["dump"]):
        return "no program", "", [], []
    with tempfile.TemporaryDirectory(prefix="folia-pdf-") as folder:
        source = Path(folder, "in.pdf")
        source.write_bytes(content or b"")
        done = run([tool["dump"], "-xml", "-zoom", "1", "-nodrm", str(source), str(Path(folder, "out"))], folder)
        dump = Path(folder, "out.xml").read_text("utf-8", "replace") if Path(folder, "out.xml").is_file() else ""
        if done.code and not dump:
            return "failed", "", [], []
        drawings = []
        for n in range(1, dump.count("<page ") + 1):
            target = Path(folder, f"page{n}.svg")
            drawn = run([tool["draw"], "-svg", "-f", str(n), "-l", str(n), str(source), str(target)], folder) if available(tool["draw"]) else Result(127, b"")
            drawings.append(target.read_text("utf-8", "replace") if not drawn.code and target.is_file() else "")
        pictures = [{"name": f.name, "bytes": f.read_bytes()} for f in sorted(Path(folder).iterdir()) if f.suffix.lower() in PICTURES]
        return ("ok" if "<text " in dump else NO_TEXT), dump, drawings, pictures


def recognize(content: bytes | None, languages: tuple[str, ...] = ("hun+eng", "hun", "eng")) -> tuple[str, list[str]]:
    """status and the lines that text recognition reads, a blank one between pages; the first language set that the program knows."""
    if not (available("pdftoppm") and available("tesseract")):
        return "no program", []
    with tempfile.TemporaryDirectory(prefix="folia-ocr-") as folder:
        source = Path(folder, "in.pdf")
        source.write_bytes(content or b"")
        if run(["pdftoppm", "-r", str(DPI), "-png", str(source), str(Path(folder, "p"))], folder).code:
            return "failed", []
        lines: list[str] = []
        for image in sorted(Path(folder).glob("p*.png")):
            for choice in (*languages, None):
                done = run(["tesseract", str(image), "stdout", *(["-l", choice] if choice else [])], folder)
                if not done.code:
                    lines += [*done.output.decode("utf-8", "replace").replace("\r", "").split("\n"), ""]
                    break
        return ("ok" if any(x.strip() for x in lines) else NO_TEXT), lines


def dumps(files: DataFrame, content: str = "content", doc: str = "doc_id") -> DataFrame:
    """doc, status, xml, drawings, media (pictures by name) of PDFs: what the layout source reads."""
    schema = T.StructType([files.schema[doc], *T._parse_datatype_string("status string, xml string, drawings array<string>, media array<struct<name:string,bytes:binary>>").fields])
    kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.struct([("name", pa.string()), ("bytes", pa.binary())])))

    def each(batches):
        for b in batches:
            rows = [dump_pdf(x) for x in b.column(content).to_pylist()]
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(doc), *made], names=schema.names)

    return files.select(doc, content).mapInArrow(each, schema)


def recognized(files: DataFrame, content: str = "content", doc: str = "doc_id") -> DataFrame:
    """doc, status, line_no, line of scanned PDFs: what windows.blank_separated and join_lines make paragraphs of. A document without lines has one row, its line null."""
    schema = T.StructType([files.schema[doc], *T._parse_datatype_string("status string, line_no int, line string").fields])

    def each(batches):
        for b in batches:
            index, out = [], []
            for k, x in enumerate(b.column(content).to_pylist()):
                status, lines = recognize(x)
                found = [(status, n, s) for n, s in enumerate(lines)] or [(status, None, None)]
                index += [k] * len(found)
                out += found
            made = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(doc).take(pa.array(index, pa.int32())), *made], names=schema.names)

    return files.select(doc, content).mapInArrow(each, schema)
