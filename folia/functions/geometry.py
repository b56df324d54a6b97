"""Column functions on positions, sizes and lengths; sizes are in points, y grows downward."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["axis_aligned", "bottom", "continues_paragraph", "display_size", "emu_to_points", "in_margin", "points_to_emu", "points_to_twips", "right", "style_for_size", "style_metrics", "touches"]

EMU, TWIPS = 12700.0, 20.0
TOLERANCE = 2.0  # between two rules that count as one edge

# Size, bold, space before and after, leading of each paragraph style.
STYLE_METRICS = {
    "Title": (24.0, True, 6.0, 14.0, 1.25),
    "Heading1": (18.0, True, 14.0, 7.0, 1.28),
    "Heading2": (15.0, True, 12.0, 6.0, 1.30),
    "Heading3": (13.0, True, 10.0, 5.0, 1.32),
    "Normal": (11.0, False, 0.0, 7.0, 1.42),
}



def right(left: Column, width: Column) -> Column:
    return left + width


def bottom(top: Column, height: Column) -> Column:
    """A line's bottom by its greatest height."""
    return top + height


def emu_to_points(c: Column) -> Column:
    return c / EMU


def points_to_emu(c: Column) -> Column:
    """Cut to whole units."""
    return (c * EMU).cast("long")


def points_to_twips(c: Column) -> Column:
    return (c * TWIPS).cast("long")


def style_for_size(size: Column, body: Column, lines: Column) -> Column:
    """A block's style by its size against the body's; blocks of over three lines are body text."""
    ratio = F.when(body > 0, size / body).otherwise(1.0)
    out = F.when(lines > 3, "Normal")
    for least, style in ((1.70, "Title"), (1.40, "Heading1"), (1.22, "Heading2"), (1.10, "Heading3")):
        out = out.when(ratio >= least, style)
    return out.otherwise("Normal")


def style_metrics(style: Column) -> Column:
    """struct<size, bold, before, after, leading>"""
    row = lambda m: F.struct(*[F.lit(v).alias(k) for k, v in zip(("size", "bold", "before", "after", "leading"), m, strict=True)])
    out = row(STYLE_METRICS["Normal"])
    for name, m in STYLE_METRICS.items():
        out = F.when(style == name, row(m)).otherwise(out)
    return out


def display_size(px_w: Column, px_h: Column, disp_w: Column, disp_h: Column, most_w: float, most_h: float | None = None) -> Column:
    """struct<w, h>: the given size, or 0.75 points a pixel, shrunk in proportion to fit."""
    w, h = F.when(disp_w > 0, disp_w).otherwise(px_w * 0.75), F.when(disp_h > 0, disp_h).otherwise(px_h * 0.75)
    h, w = F.when(w > most_w, h * (most_w / w)).otherwise(h), F.when(w > most_w, F.lit(most_w)).otherwise(w)
    if most_h is not None:
        w, h = F.when(h > most_h, w * (most_h / h)).otherwise(w), F.when(h > most_h, F.lit(most_h)).otherwise(h)
    return F.struct(w.alias("w"), h.alias("h"))


def in_margin(top: Column, bottom: Column, page_height: Column) -> Column:
    """header, footer or null: which margin zone a line lies in."""
    return F.when(top < page_height * 0.10, "header").when(bottom > page_height * 0.90, "footer")


def axis_aligned(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """V, H or null for a segment: straight to 0.6 points, and longer than one."""
    dx, dy = F.abs(x2 - x1), F.abs(y2 - y1)
    return F.when((dx <= 0.6) & (dy > 1.0), "V").when((dy <= 0.6) & (dx > 1.0), "H")


def continues_paragraph(prev: Column, line: Column, left: Column, right: Column) -> Column:
    """Whether a line goes on with the paragraph of the one before: like size, the last line full, no indent, close below, and
    not from a set-in line back to the margin. prev and line are structs of size, x_min, x_max, top, height."""
    width = right - left
    return (
        (F.abs(line["size"] - prev["size"]) <= prev["size"] * 0.12) & (prev["x_max"] >= right - width * 0.10) & (line["x_min"] <= prev["x_min"] + width * 0.02 + 3.0)
        & (line["top"] - (prev["top"] + prev["height"]) <= prev["height"] * 0.9) & ~((prev["x_min"] > left + width * 0.15) & (line["x_min"] < left + width * 0.05))
    )


def touches(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether two segments (structs of horizontal, pos, a, b) meet: in one line and overlapping, or crossing."""
    along = (F.abs(a["pos"] - b["pos"]) <= tolerance) & (a["a"] <= b["b"] + tolerance) & (b["a"] <= a["b"] + tolerance)
    across = (a["pos"] >= b["a"] - tolerance) & (a["pos"] <= b["b"] + tolerance) & (b["pos"] >= a["a"] - tolerance) & (b["pos"] <= a["b"] + tolerance)
    return F.when(a["horizontal"] == b["horizontal"], along).otherwise(across)
