"""Joins by position. Each has the document and page as equality keys, so Catalyst makes a hash or sort-merge join with the rest as its condition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folia.functions import touches


def numbering(items: DataFrame, nums: DataFrame, levels: DataFrame, doc: list[str]) -> DataFrame:
    """Adds whether an item's list level is numbered: num_id to abstract_id to level; false where either is unknown."""
    out = items.join(nums, [*doc, "num_id"], "left").join(levels, [*doc, "abstract_id", "level"], "left")
    return out.withColumn("numbered", F.coalesce("numbered", F.lit(False)))


def nearest(points: DataFrame, anchors: DataFrame, part: list[str], at: str, position: str, index: str, tolerance: float = 14.0) -> DataFrame:
    """Adds the index of the nearest anchor within the tolerance, the last of equals; null if there is none. Columns of points must be a key together.

    Positions meet in bins as wide as the tolerance, so the join is on equality and linear however many anchors there are.
    """
    bin_of = lambda c: F.floor(F.col(c) / tolerance)
    filed = anchors.withColumn("anchor bin", F.explode(F.sequence(bin_of(position) - 1, bin_of(position) + 1)))
    joined = points.withColumn("anchor bin", bin_of(at)).join(filed, [*part, "anchor bin"]).where(F.abs(F.col(position) - F.col(at)) <= tolerance)
    best = joined.groupBy(*points.columns).agg(F.min_by(F.col(index), F.struct(F.abs(F.col(position) - F.col(at)), -F.col(index))).alias(index))
    return points.join(best, points.columns, "left")


def point_in_box(points: DataFrame, boxes: DataFrame, part: list[str], x: str, y: str, order: list[str], tolerance: float = 2.0, key: list[str] | None = None) -> DataFrame:
    """Each point with the first box, by order, that holds it; points outside of all go. boxes: left, right, top, bottom."""
    inside = (F.col(x) >= F.col("left") - tolerance) & (F.col(x) <= F.col("right") + tolerance) & (F.col(y) >= F.col("top") - tolerance) & (F.col(y) <= F.col("bottom") + tolerance)
    joined = points.join(boxes, part).where(inside)
    first = F.row_number().over(Window.partitionBy(*(key or points.columns)).orderBy(*order))
    return joined.withColumn("choice", first).where("choice = 1").drop("choice")


def shade_cells(cells: DataFrame, shades: DataFrame, part: list[str], key: list[str]) -> DataFrame:
    """Adds to each grid cell (left, right, top, bottom) the first non-empty colour drawn over its middle; '' if there is none. shades: shade_no, x, y, w, h, color."""
    mid_x, mid_y = (F.col("left") + F.col("right")) / 2, (F.col("top") + F.col("bottom")) / 2
    over = (mid_x >= F.col("x")) & (mid_x <= F.col("x") + F.col("w")) & (mid_y >= F.col("y")) & (mid_y <= F.col("y") + F.col("h")) & (F.col("color") != "")
    hit = cells.join(shades, part).where(over).groupBy(*part, *key).agg(F.min_by("color", "shade_no").alias("shading"))
    return cells.join(hit, [*part, *key], "left").withColumn("shading", F.coalesce("shading", F.lit("")))


def lines_in_boxes(lines: DataFrame, boxes: DataFrame, part: list[str], tolerance: float = 2.0) -> DataFrame:
    """Lines whose height lies inside a box and whose width meets it. lines: top, height, x_min, x_max; boxes: b_left, b_right, b_top, b_bottom."""
    inside = (F.col("top") >= F.col("b_top") - tolerance) & (F.col("top") + F.col("height") <= F.col("b_bottom") + tolerance)
    meets = (F.col("x_max") >= F.col("b_left") - tolerance) & (F.col("x_min") <= F.col("b_right") + tolerance)
    return lines.join(boxes, part).where(inside & meets)


def touching(segments: DataFrame, part: list[str], key: str = "seg_no") -> DataFrame:
    """Pairs (i, j), i < j, of segments of one page that meet. segments: key, horizontal, pos, a, b."""
    one = segments.select(*part, F.col(key).alias("i"), F.struct("horizontal", "pos", "a", "b").alias("p"))
    two = segments.select(*part, F.col(key).alias("j"), F.struct("horizontal", "pos", "a", "b").alias("q"))
    return one.join(two, part).where((F.col("i") < F.col("j")) & touches(F.col("p"), F.col("q"))).select(*part, "i", "j")


def covered_edges(edges: DataFrame, segments: DataFrame, part: list[str], tolerance: float = 2.0) -> DataFrame:
    """Edges (pos, a, b) along which one drawn segment runs from end to end."""
    drawn = segments.select(*part, F.col("pos").alias("s_pos"), F.col("a").alias("s_a"), F.col("b").alias("s_b"))
    e = edges.alias("e")
    cond = [F.col(f"e.{p}") == drawn[p] for p in part] + [
        F.abs(F.col("s_pos") - F.col("e.pos")) <= tolerance, F.col("s_a") <= F.col("e.a") + tolerance, F.col("s_b") >= F.col("e.b") - tolerance
    ]
    return e.join(drawn, cond, "left_semi")


def without(lines: DataFrame, consumed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that no consumed key names."""
    return lines.join(consumed.select(*keys).distinct(), keys, "left_anti")


def spans_without(spans: DataFrame, consumed: DataFrame, part: list[str], first: str = "first", last: str = "last", line: str = "line_no") -> DataFrame:
    """Line intervals that hold no consumed line: an interval is as many lines, and these join on equality."""
    own = [*part, first, last]
    lines = spans.select(*own).distinct().withColumn(line, F.explode(F.when(F.col(first) <= F.col(last), F.sequence(F.col(first).cast("long"), F.col(last).cast("long")))))
    taken = consumed.select(*part, F.col(line).cast("long").alias(line)).distinct()
    return spans.join(lines.join(taken, [*part, line], "left_semi").select(*own).distinct(), own, "left_anti")


def interleave(blocks: DataFrame, images: DataFrame, part: list[str], block: str = "block_no", image: str = "image_no") -> DataFrame:
    """Blocks and images of a page in order: an image comes before the first block that lies no higher, or at the end. Both have top.

    Returns part, seq (from 1), kind, block, image.
    """
    placed = blocks.select(*part, F.col(block).alias("slot"), F.lit(1).alias("late"), F.col("top"), F.lit("block").alias("kind"), F.col(block), F.lit(None).cast("long").alias(image))
    held = images.select(*part, F.col("top").alias("image top"), F.col(image)).join(blocks.select(*part, "top", F.col(block).alias("own")), part, "left")
    slot = held.groupBy(*part, image, "image top").agg(F.min(F.when(F.col("top") >= F.col("image top"), F.col("own"))).alias("slot"))
    put = slot.select(*part, F.coalesce("slot", F.lit(1 << 40)).alias("slot"), F.lit(0).alias("late"), F.col("image top").alias("top"), F.lit("image").alias("kind"), F.lit(None).cast("long").alias(block), F.col(image))
    both = placed.unionByName(put)
    order = Window.partitionBy(*part).orderBy("slot", "late", F.when(F.col("kind") == "image", F.col("top")), image)
    return both.withColumn("seq", F.row_number().over(order)).select(*part, "seq", "kind", block, image)


def stamp(pages: DataFrame, running: DataFrame, doc: list[str]) -> DataFrame:
    """The running text of a document on each of its pages."""
    return pages.join(running, doc)


def advances(texts: DataFrame, cmap: DataFrame, widths: DataFrame, key: list[str], text: str, size: str) -> DataFrame:
    """Width of texts by characters: code point to glyph (0 if unmapped) to advance (half an em if unknown). cmap and widths are a font's tables, of 65,536 glyphs at most."""
    chars = texts.select(*key, size, F.explode(F.split(text, "")).alias("char")).where("char <> ''")
    mapped = chars.join(F.broadcast(cmap), "char", "left").withColumn("glyph", F.coalesce("glyph", F.lit(0)))
    wide = mapped.join(F.broadcast(widths), "glyph", "left").withColumn("advance", F.coalesce("advance", F.lit(0.5)))
    return wide.groupBy(*key).agg(F.sum(F.col("advance") * F.col(size)).alias("width"))


def reachable(roots: DataFrame, parts: DataFrame, own: list[str], node: str, part: str, depth: int) -> DataFrame:
    """What roots are made of, over at most so many steps: own, node, each once, the roots included. roots: own, node; parts: node, part."""
    steps = parts.select(F.col(node).alias("step from"), F.col(part).alias("step to"))
    found = newest = roots.select(*own, node).distinct()
    for _ in range(depth):
        newest = newest.join(steps, F.col(node) == F.col("step from")).select(*own, F.col("step to").alias(node)).distinct()
        found = found.union(newest)
    return found.distinct()
