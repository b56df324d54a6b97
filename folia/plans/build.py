"""Documents built block by block, as rows that the sinks read."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from folia.sources.images import probe
from folia.sources.ooxml import BLOCK

PLAIN = {"kind": "None", "level": 0, "num_id": 0}


def run(text: str, bold: bool = False, italic: bool = False, color: str = "", font: str = "") -> dict:
    return {"text": text, "bold": bold, "italic": italic, "color": color, "font": font}


@dataclass
class Cell:
    """A table's cell: paragraphs of runs, how many columns and rows it spans, its colour."""

    paragraphs: list[list[dict]]
    grid_span: int = 1
    row_span: int = 1
    shading: str = ""
    borders: tuple[bool, bool, bool, bool] = (True, True, True, True)  # top, bottom, left, right


@dataclass
class Document:
    """The blocks of one document, in the order in which they are added."""

    rows: list[dict] = field(default_factory=list)
    media: list[tuple[str, bytes, str]] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)

    def _add(self, part: str, path: tuple[int, ...] | None, **block) -> int:
        n = self.counts.get(part, 0)
        if path is None:
            path, self.counts[part] = (n,), n + 1
        empty = {"style": None, "alignment": None, "list": None, "runs": None, "widths": None, "cells": None, "image": None}
        self.rows.append({**empty, "part": part, "path": list(path), "ordinal": 0, **block})
        return path[0]

    def paragraph(self, content: str | list[dict], style: str = "Normal", alignment: str = "Default", listed: str = "None", level: int = 0, ordinal: int = 0, part: str = "body", path: tuple[int, ...] | None = None) -> Document:
        """Adds a paragraph; listed is Bullet or Numbered for list items, part is body, header or footer."""
        runs = ([run(content)] if content else []) if isinstance(content, str) else content
        number = {"Bullet": 1, "Numbered": 2}.get(listed, 0)
        self._add(part, path, kind="paragraph", style=style, alignment=alignment, list={"kind": listed, "level": level, "num_id": number} if number else PLAIN, runs=runs, ordinal=ordinal)
        return self

    def table(self, rows: list[list[Cell | str]], widths: list[float] | None = None, header: bool = False) -> Document:
        """Adds a table. A cell that spans rows stands in the first of them only; widths are weights, equal ones if there are none."""
        cells, texts, below = [], [], {}  # below: rows that a column still has to skip, by column
        for r, row in enumerate(rows):
            start, given, entries = 0, iter(row), []
            while True:
                if below.get(start, (0, 0))[0]:
                    left, span = below[start]
                    below[start] = (left - 1, span)
                    entries.append((start, span, 1, True, None))
                    start += span
                    continue
                cell = next(given, None)
                if cell is None:
                    break
                cell = Cell([[run(cell)]]) if isinstance(cell, str) else cell
                entries.append((start, cell.grid_span, cell.row_span, False, cell))
                if cell.row_span > 1:
                    below[start] = (cell.row_span - 1, cell.grid_span)
                start += cell.grid_span
            for n, (at, span, high, merged, cell) in enumerate(entries):
                edges = cell.borders if cell else (True,) * 4
                cells.append({"row": r, "cell": n, "start": at, "grid_span": span, "row_span": high, "merged": merged, "header": header and r == 0, "shading": cell.shading if cell else "", **dict(zip(("top", "bottom", "left", "right"), edges, strict=True))})
                texts += [((r, n, k), p) for k, p in enumerate(cell.paragraphs if cell else [])]
        columns = max((sum(c["grid_span"] for c in cells if c["row"] == r) for r in range(len(rows))), default=0)
        own = self._add("body", None, kind="table", widths=[float(w) for w in widths or [1.0] * columns], cells=cells)
        for path, runs in texts:
            self.paragraph(runs, path=(own, *path))
        return self

    def picture(self, data: bytes, mime: str, width: float = 0.0, height: float = 0.0) -> Document:
        """Adds a picture, of its own size in pixels unless one in points is given."""
        name, (w, h) = f"picture{len(self.media) + 1}", probe(data)
        self.media.append((name, data, mime))
        self._add("body", None, kind="image", image={"target": name, "px_w": w, "px_h": h, "disp_w": width, "disp_h": height})
        return self


def blocks(spark: SparkSession, documents: dict[str, Document]) -> tuple[DataFrame, DataFrame]:
    """Blocks (doc_id, seq, ..., ordinal) and pictures (doc_id, name, bytes, mime) of built documents, for the sinks."""
    rows = [{"doc_id": d, "seq": n, **r} for d, doc in documents.items() for n, r in enumerate(doc.rows)]
    media = [(d, name, bytearray(data), mime) for d, doc in documents.items() for name, data, mime in doc.media]
    return spark.createDataFrame(rows, f"doc_id string, seq int, {BLOCK}, ordinal int"), spark.createDataFrame(media, "doc_id string, name string, bytes binary, mime string")
