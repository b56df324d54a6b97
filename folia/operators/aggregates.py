"""Aggregations over documents, pages and tables. Sums are partial before the shuffle; nothing gathers a group's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.functions import in_margin, mask_digits
from folia.plans.settle import settle


def body_size(lines: DataFrame, part: list[str], size: str) -> DataFrame:
    """A document's body size: the commonest size of its lines in half points, the smallest of equals, 11 if there are none."""
    half = F.round(F.col(size) * 2).cast("long")
    return lines.groupBy(*part).agg((F.coalesce(F.mode(half, True) / 2.0, F.lit(11.0))).alias("body_size"))


def line_extents(fragments: DataFrame, part: list[str]) -> DataFrame:
    """Lines from their fragments (left, width, top, height, size)."""
    return fragments.groupBy(*part).agg(
        F.min("top").alias("top"), F.max("height").alias("height"), F.max("size").alias("size"), F.min("left").alias("x_min"), F.max(F.col("left") + F.col("width")).alias("x_max")
    )


def margin_lines(lines: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """Lines in a margin zone: doc, page, line_no, zone, at (whole points), masked (the text without its digits). lines: doc, page, line_no, top, bottom, page_height, text."""
    zoned = lines.withColumn("zone", in_margin(F.col("top"), F.col("bottom"), F.col("page_height"))).where("zone IS NOT NULL")
    return zoned.select(doc, page, "line_no", "zone", F.round("top").cast("long").alias("at"), mask_digits(F.col(text)).alias("masked"))


def _buckets(margin: DataFrame, totals: DataFrame, doc: str, page: str, rule: Column | None) -> DataFrame:
    pages = totals.groupBy(doc).agg(F.count("*").alias("pages"))
    found = margin.groupBy(doc, "zone", "at", "masked").agg(F.countDistinct(page).alias("n_pages"), F.min(page).alias("first_page"))
    enough = (F.col("n_pages") >= 2) & (F.col("n_pages") >= F.expr("pages DIV 2")) if rule is None else rule
    return found.join(pages, doc).where(enough).select(doc, "zone", "at", "masked", "n_pages", "first_page")


def running_text(lines: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text", rule: Column | None = None) -> DataFrame:
    """Buckets of lines in a margin zone that recur at one height on at least half of a document's pages, digits aside, and on two.

    lines: doc, page, line_no, top, bottom, page_height, text. Returns doc, zone, at, masked, n_pages, first_page. rule
    replaces the condition on n_pages and pages.
    """
    return _buckets(margin_lines(lines, doc, page, text), lines.select(doc, page).distinct(), doc, page, rule)


def safe_running_text(lines: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text", rule: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The buckets that empty no page, and the lines in them (doc, page, line_no, zone, at, masked).

    Where all lines of a page would go with one zone's buckets, each bucket that touches the page stays in the text everywhere.
    lines are read twice, so they should be a written table; the few lines of the margins and what is found in them are written.
    """
    key = [doc, "zone", "at", "masked"]
    totals = settle(lines.groupBy(doc, page).agg(F.count("*").alias("n_lines")), "page-lines")
    margin = settle(margin_lines(lines, doc, page, text), "margin")
    buckets = settle(_buckets(margin, totals, doc, page, rule), "buckets")
    hits = settle(margin.join(buckets.select(*key), key), "hits")
    emptied = hits.groupBy(doc, page, "zone").agg(F.countDistinct("line_no").alias("n_hit")).join(totals, [doc, page]).where("n_hit >= n_lines").select(doc, page, "zone")
    rejected = settle(hits.join(emptied, [doc, page, "zone"], "left_semi").select(*key).distinct(), "rejected")
    return buckets.join(rejected, key, "left_anti"), hits.join(rejected, key, "left_anti")


def alignment(lines: DataFrame, part: list[str], order: str) -> DataFrame:
    """A paragraph's alignment from its lines (x_min, x_max, left_edge, right_edge): centred, right, justified or default."""
    width = F.col("right_edge") - F.col("left_edge")
    lg, rg = F.col("x_min") - F.col("left_edge"), F.col("right_edge") - F.col("x_max")
    centred = (lg >= width * 0.05) & (F.abs(lg - rg) <= width * 0.06)
    right = (lg >= width * 0.05) & (rg <= 3.0)
    # all lines but the last must be full: the count of those that aren't, without the last
    ragged = F.abs(rg) > 1.0
    last = F.max_by(ragged.cast("int"), F.col(order))
    stats = lines.groupBy(*part).agg(
        F.max(width).alias("w"), F.bool_and(centred).alias("c"), F.bool_and(right).alias("r"), F.count("*").alias("n"), (F.sum(ragged.cast("int")) - last).alias("ragged")
    )
    kind = F.when(F.col("w") <= 20, "Default").when(F.col("c"), "Center").when(F.col("r"), "Right").when((F.col("n") > 1) & (F.col("ragged") == 0), "Justify").otherwise("Default")
    return stats.select(*part, kind.alias("alignment"))


def header_rows(runs: DataFrame, part: list[str], row: str) -> DataFrame:
    """Whether a table's first row is a header: it has text, and all of it is bold. runs: row, text, bold."""
    full = ~F.col("text").rlike(r"^[ \t\n\x0B\f\r]*$")
    return runs.where(F.col(row) == 0).groupBy(*part).agg((F.bool_or(full) & F.coalesce(F.bool_and(F.when(full, F.col("bold"))), F.lit(True))).alias("is_header"))


def widest_row(cells: DataFrame, part: list[str], row: str, span: str) -> DataFrame:
    """A table's number of columns: the most that a row's spans sum to."""
    rows = cells.groupBy(*part, row).agg(F.sum(F.greatest(F.col(span), F.lit(1))).alias("n"))
    return rows.groupBy(*part).agg(F.max("n").alias("n_columns"))


def row_heights(cells: DataFrame, part: list[str], height: str, merged: str) -> DataFrame:
    """A row's height: 16 at least, and that of its highest cell that isn't merged into one above."""
    return cells.groupBy(*part).agg(F.greatest(F.lit(16.0), F.coalesce(F.max(F.when(~F.col(merged), F.col(height))), F.lit(0.0))).alias("row_height"))


def rule_color(rules: DataFrame, part: list[str], color: str = "color") -> DataFrame:
    """The commonest colour of a grid's rules, the smallest of equals; grey by default."""
    return rules.groupBy(*part).agg(F.mode(F.when(F.col(color) == "", "999999").otherwise(F.col(color)), True).alias("rule_color"))


def has_text(blocks: DataFrame, part: list[str], text: str) -> DataFrame:
    """Whether any text of a document isn't blank."""
    return blocks.groupBy(*part).agg(F.coalesce(F.bool_or(~F.col(text).rlike(r"^[ \t\n\x0B\f\r]*$")), F.lit(False)).alias("has_text"))


def media_flags(parts: DataFrame, part: list[str], mime: str = "mime") -> DataFrame:
    """Which kinds of pictures a document has."""
    return parts.groupBy(*part).agg(*[F.coalesce(F.bool_or(F.col(mime) == f"image/{k}"), F.lit(False)).alias(f"has_{k}") for k in ("png", "jpeg", "gif", "bmp")])


def glyph_set(texts: DataFrame, part: list[str], text: str) -> DataFrame:
    """Distinct characters of a face's texts: part, char."""
    return texts.select(*part, F.explode(F.split(text, "")).alias("char")).where("char <> ''").distinct()
