"""Steps that look at the row before, or at sums of the rows before: windows over a document's or a page's rows.

Every order must be total; partitions are documents or pages, so one shuffle by document serves a chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.functions import continues_paragraph, join_lines
from folia.plans.settle import settle


def islands(df: DataFrame, part: list[str], order: list[str], boundary, to: str = "island") -> DataFrame:
    """Numbers stretches of rows from 0. boundary(prev) says whether a row begins one, given a function that gives a column's value in the row before; the first row always does."""
    w = Window.partitionBy(*part).orderBy(*order)
    flag = boundary(lambda c: F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    flagged = df.withColumn("begins island", F.when(first, 0).otherwise(F.when(F.coalesce(flag, F.lit(False)), 1).otherwise(0)))
    return flagged.withColumn(to, F.sum("begins island").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("begins island")


def gap_cells(df: DataFrame, part: list[str], order: list[str], left: str, right: str, size: str, to: str = "cell") -> DataFrame:
    """Fragments of a line to cells: a new cell where the gap before exceeds 0.6 of the font size and 6 points."""
    return islands(df, part, order, lambda prev: F.col(left) - prev(right) > F.greatest(F.col(size) * 0.6, F.lit(6.0)), to)


def coalesce_runs(df: DataFrame, part: list[str], order: list[str], style: list[str], text: str = "text") -> DataFrame:
    """Joins neighbouring runs of equal style; empty runs don't count. Returns part, run_no, style, text, n_runs."""
    full = df.where(F.col(text) != "")
    changed = lambda prev: ~F.struct(*style).eqNullSafe(prev(F.struct(*style)))
    numbered = islands(full, part, order, changed, "run_no")
    sorted_text = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("joined text"))))
    return numbered.groupBy(*part, "run_no", *style).agg(F.array_join(F.transform(sorted_text, lambda x: x["joined text"]), "").alias(text), F.count("*").alias("n_runs"))


def table_spans(lines: DataFrame, part: list[str], order: str, cells: str, top: str, height: str) -> DataFrame:
    """Stretches of two or more lines of two or more cells that lie close: part, first, last, n_lines."""
    many = F.col(cells) >= 2
    begins = lambda prev: ~many | ~(prev(cells) >= 2) | (F.col(top) - (prev(top) + prev(height)) > prev(height) * 1.6)
    spans = islands(lines, part, [order], begins, "span").where(many)
    return spans.groupBy(*part, "span").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n_lines")).where("n_lines >= 2").drop("span")


def paragraphs(lines: DataFrame, part: list[str], order: str, left: str = "left_edge", right: str = "right_edge", to: str = "para_no") -> DataFrame:
    """Lines (size, x_min, x_max, top, height, the page's edges) to paragraphs; lines removed before break nothing unless their number is missing from order and `order` has gaps."""
    row = F.struct("size", "x_min", "x_max", "top", "height", F.col(order).alias("no"))
    goes_on = lambda prev: continues_paragraph(prev(row), row, F.col(left), F.col(right)) & (prev(row)["no"] == F.col(order) - 1)
    return islands(lines, part, [order], lambda prev: ~goes_on(prev), to)


def list_ordinals(df: DataFrame, part: list[str], order: list[str], num: str = "num_id", level: str = "level", numbered: str = "numbered", levels: int = 9, to: str = "ordinal") -> DataFrame:
    """Counts numbered items by list and level; an item of a lower level of the list starts the deeper counts anew. Other rows get 0.

    Only numbered items of lists (num > 0) count or reset; levels are from 0 and beyond the last count as the last.
    """
    counts = F.col(numbered) & (F.col(num) > 0)
    deep = F.least(F.col(level), F.lit(levels - 1))
    w = Window.partitionBy(*part, num, "counts").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("counts", F.coalesce(counts, F.lit(False)))
    resets = F.lit(0).cast("long")
    for k in range(1, levels):
        resets = F.when(deep == k, F.sum(F.when(deep < k, 1).otherwise(0)).over(w)).otherwise(resets)
    out = out.withColumn("resets", resets).withColumn("own level", deep)
    own = Window.partitionBy(*part, num, "counts", "own level", "resets").orderBy(*order)
    return out.withColumn(to, F.when(F.col("counts"), F.row_number().over(own)).otherwise(0)).drop("counts", "resets", "own level")


def merge_origins(df: DataFrame, part: list[str], column: str, row: str, continues: str, to: str = "origin") -> DataFrame:
    """The row of the cell that a vertically merged cell belongs to: the last that doesn't continue; a continuation without one is its own."""
    w = Window.partitionBy(*part, column).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(to, F.coalesce(F.last(F.when(~F.col(continues), F.col(row)), ignorenulls=True).over(w), F.col(row)))


def starts_before(df: DataFrame, part: list[str], order: list[str], size: str, to: str = "start") -> DataFrame:
    """The sum of the sizes before each row: column starts of spanning cells, offsets of objects, places of pieces in a line."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(to, F.coalesce(F.sum(size).over(w), F.lit(0)))


def starts_overall(df: DataFrame, order: list[str], size: str, to: str = "start") -> DataFrame:
    """As starts_before over the whole frame, by range partitions and the sums of those before; written, so that every step sees the same partitions."""
    placed = settle(df.repartitionByRange(*order).withColumn("range part", F.spark_partition_id()), "starts")
    sums = placed.groupBy("range part").agg(F.sum(size).alias("part size"), F.lit(0).alias("all"))  # a row for each partition
    before = starts_before(sums, ["all"], ["range part"], "part size", "part start").select("range part", "part start")
    own = starts_before(placed, ["range part"], order, size, to).join(F.broadcast(before), "range part")
    return own.withColumn(to, F.col(to) + F.col("part start")).select(*df.columns, to)


def places(df: DataFrame, part: list[str], order: list[str], to: str = "place") -> DataFrame:
    """Each row's number from 0 within its part, by range partitions and the counts of those before: no part, however large, is in one task. Null is a part too."""
    placed = settle(starts_overall(df.withColumn("one row", F.lit(1)), [*part, *order], "one row", "place overall").drop("one row"), "places")
    first = placed.groupBy(*[F.col(p).alias(f"first {p}") for p in part]).agg(F.min("place overall").alias("first place"))
    same = [F.col(p).eqNullSafe(F.col(f"first {p}")) for p in part]
    return placed.join(first, same).withColumn(to, F.col("place overall") - F.col("first place")).select(*df.columns, to)


def consecutive_ranges(df: DataFrame, part: list[str], value: str) -> DataFrame:
    """Distinct integers as ranges: part, first, last, n."""
    own = places(df.select(*part, value).distinct(), part, [value]).withColumn("range", F.col(value) - F.col("place"))
    return own.groupBy(*part, "range").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n")).drop("range")


def batches(df: DataFrame, part: list[str], order: list[str], size: int, to: str = "batch") -> DataFrame:
    """Numbers batches of so many rows from 0."""
    return places(df, part, order).withColumn(to, F.floor(F.col("place") / size).cast("long")).drop("place")


def cell_paragraphs(df: DataFrame, part: list[str], order: list[str], top: str, to: str = "para_no") -> DataFrame:
    """Pieces of text of a table cell: a new paragraph where the top moves by more than a point."""
    return islands(df, part, order, lambda prev: F.abs(F.col(top) - prev(top)) > 1, to)


def blank_separated(df: DataFrame, part: list[str], order: list[str], text: str, to: str = "para_no") -> DataFrame:
    """Recognised lines: blank ones end a paragraph and go."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    empty = F.col(text).rlike(r"^[ \t\n\x0B\f\r]*$")
    out = df.withColumn("blanks", F.sum(F.when(empty, 1).otherwise(0)).over(w)).where(~empty)
    return islands(out, part, order, lambda prev: F.col("blanks") != prev("blanks"), to).drop("blanks")


def recognized_paragraphs(df: DataFrame, part: list[str], order: str, text: str) -> DataFrame:
    """Recognised lines to paragraphs: part, para_no, text. Blank lines part them, spaces and tabs before a line and returns after it go, and a
    space joins lines unless what stands so far ends in a hyphen."""
    clean = F.regexp_replace(F.regexp_replace(text, r"\r+$", ""), r"^[ \t]+", "")
    numbered = blank_separated(df.withColumn(text, clean), part, [order], text)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("line text")))), lambda x: x["line text"])
    return numbered.groupBy(*part, "para_no").agg(join_lines(lines).alias("text"))


def trim_trailing(df: DataFrame, part: list[str], order: str, keep: Column) -> DataFrame:
    """Drops rows after the last that keep holds for."""
    last = F.max(F.when(keep, F.col(order))).over(Window.partitionBy(*part))
    return df.withColumn("last kept", last).where(F.col(order) <= F.col("last kept")).drop("last kept")


def page_edges(df: DataFrame, part: list[str], left: str = "x_min", right: str = "x_max") -> DataFrame:
    """The text column of a page from all of its lines: left_edge, right_edge, column_width (at least 1)."""
    w = Window.partitionBy(*part)
    out = df.withColumn("left_edge", F.min(left).over(w)).withColumn("right_edge", F.max(right).over(w))
    return out.withColumn("column_width", F.greatest(F.col("right_edge") - F.col("left_edge"), F.lit(1.0)))


def width_shares(df: DataFrame, part: list[str], width: str, total: float, to: str = "share") -> DataFrame:
    """Each column's part of a table's width by its weight."""
    return df.withColumn(to, F.col(width) / F.sum(width).over(Window.partitionBy(*part)) * total)
