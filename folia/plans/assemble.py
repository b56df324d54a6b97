"""From positioned fragments to blocks: lines, cells, running text, ruled and aligned tables, paragraphs, pictures, in reading order.

All steps but the grids' are relational; they share the partitioning by document. Document-wide are the body size and the
running text; everything else is by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia import functions as fn
from folia.operators import aggregates, folds, joins, windows

from .settle import settle

RUNS = "array<struct<text:string,bold:boolean,italic:boolean,color:string,font:string>>"
CELLS = f"array<struct<left:double,right:double,runs:{RUNS}>>"
TABLE_CELLS = (
    "array<struct<row:int,cell:int,start:int,grid_span:int,row_span:int,merged:boolean,header:boolean,shading:string,top:boolean,bottom:boolean,left:boolean,right:boolean>>"
)
KEY = ["doc_id", "page_no"]


def _last(a: Column) -> Column:
    return F.get(a, F.size(a) - 1)


def _but_last(a: Column) -> Column:
    return F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))


def append_runs(runs: Column, more: Column) -> Column:
    """Runs with more after them; neighbours of one style join, empty ones go."""

    def step(s, r):
        joined = F.concat(_but_last(s), F.array(_last(s).withField("text", F.concat(_last(s)["text"], r["text"])))).cast(RUNS)
        return F.when(r["text"] == "", s).when((F.size(s) > 0) & fn.same_style(_last(s), r), joined).otherwise(F.concat(s, F.array(r)).cast(RUNS))

    return F.aggregate(more, runs.cast(RUNS), step)


def spaced(runs: Column) -> Column:
    """Runs with a space after the last."""
    return F.when(F.size(runs) > 0, F.concat(_but_last(runs), F.array(_last(runs).withField("text", F.concat(_last(runs)["text"], F.lit(" "))))).cast(RUNS)).otherwise(runs.cast(RUNS))


def no_runs() -> Column:
    return F.array().cast(RUNS)


def lines(fragments: DataFrame) -> DataFrame:
    """Lines of pages: top, height, size, x_min, x_max, cells (left, right, runs), n_cells, runs, text. fragments as layout.fragments gives them."""
    numbers = folds.anchored_lines(fragments, KEY, "frag_no")
    placed = fragments.join(numbers, [*KEY, "frag_no"])
    extents = aggregates.line_extents(placed, [*KEY, "line_no"])
    parts = placed.groupBy(*KEY, "line_no").agg(F.array_sort(F.collect_list(F.struct("left", "frag_no", (F.col("left") + F.col("width")).alias("right"), F.col("runs").cast(RUNS).alias("runs")))).alias("parts"))

    def step(s, f):
        last = _last(s)
        fresh = F.concat(s, F.array(F.struct(f["left"].alias("left"), f["right"].alias("right"), f["runs"].alias("runs")))).cast(CELLS)
        touching = fn.run_text(last["runs"]).rlike(r"[ \t\n\x0B\f\r]$") | fn.run_text(f["runs"]).rlike(r"^[ \t\n\x0B\f\r]")
        before = F.when((f["left"] - last["right"] > F.col("size") * 0.2) & ~touching, spaced(last["runs"])).otherwise(last["runs"])
        grown = F.concat(_but_last(s), F.array(F.struct(last["left"].alias("left"), f["right"].alias("right"), append_runs(before, f["runs"]).alias("runs")))).cast(CELLS)
        return F.when((F.size(s) == 0) | (f["left"] - last["right"] > F.greatest(F.col("size") * 0.6, F.lit(6.0))), fresh).otherwise(grown)

    out = extents.join(parts, [*KEY, "line_no"]).withColumn("cells", F.aggregate("parts", F.array().cast(CELLS), step)).drop("parts")
    joined = F.aggregate("cells", no_runs(), lambda s, c: append_runs(spaced(s), c["runs"]))
    return out.withColumn("n_cells", F.size("cells")).withColumn("runs", joined).withColumn("text", fn.run_text(F.col("runs")))


def running(lines: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Running text: paragraphs (doc_id, part, n, runs) in byte order of position and masked text, and the keys of the lines that it takes."""
    sized = lines.join(pages.select(*KEY, F.col("height").alias("page_height")), KEY).withColumn("bottom", F.col("top") + F.col("height"))
    _, hits = aggregates.safe_running_text(sized)
    first = hits.join(lines.select(*KEY, "line_no", "runs"), [*KEY, "line_no"]).groupBy("doc_id", "zone", "at", "masked").agg(F.min_by("runs", F.struct("page_no", "line_no")).alias("runs"))
    order = Window.partitionBy("doc_id", "zone").orderBy(F.concat(F.col("at").cast("string"), F.lit("|"), F.col("masked")))
    return first.select("doc_id", F.col("zone").alias("part"), (F.row_number().over(order) - 1).alias("n"), "runs"), hits.select(*KEY, "line_no").distinct()


def ruled_tables(lines: DataFrame, rules: DataFrame, shades: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Tables drawn with rules (KEY, first, last, top, widths, cells, texts) and the lines in them (KEY, line_no)."""
    merged = folds.merge_rules(rules.select(*KEY, "horizontal", "pos", "a", "b"), [*KEY, "horizontal"])
    order = Window.partitionBy(*KEY).orderBy(F.desc("horizontal"), "rule_no")
    segments = merged.withColumn("seg_no", F.row_number().over(order).cast("long")).drop("rule_no")
    grouped = segments.join(folds.components(segments, KEY), [*KEY, "seg_no"])
    cells = settle(folds.ruled_grids(settle(grouped, "segments"), KEY), "grids")
    if shades is not None:
        cells = joins.shade_cells(cells, shades, KEY, ["component", "r", "c"])
    else:
        cells = cells.withColumn("shading", F.lit(""))
    own = [*KEY, "component"]
    boxes = cells.groupBy(*own).agg(F.min("left").alias("b_left"), F.max("right").alias("b_right"), F.min("top").alias("b_top"), F.max("bottom").alias("b_bottom"))
    inside = joins.lines_in_boxes(lines, boxes, KEY)
    pieces = inside.select(*own, "line_no", F.col("top").alias("line_top"), (F.col("top") + F.col("height") / 2).alias("y"), F.posexplode("cells").alias("piece", "p"))
    pieces = pieces.select(*own, "line_no", "line_top", "y", "piece", ((F.col("p.left") + F.col("p.right")) / 2).alias("x"), F.col("p.runs").alias("runs"))
    put = joins.point_in_box(pieces, cells.select(*own, "r", "c", "left", "right", "top", "bottom"), own, "x", "y", ["r", "c"], key=[*own, "line_no", "piece"])
    put = windows.cell_paragraphs(settle(put, "pieces"), [*own, "r", "c"], ["line_top", "line_no", "piece"], "line_top")
    text = F.array_sort(F.collect_list(F.struct("line_no", "piece", "runs")))
    paras = put.groupBy(*own, "r", "c", "para_no").agg(F.aggregate(text, no_runs(), lambda s, x: append_runs(spaced(s), x["runs"])).alias("runs"))
    texts = paras.groupBy(*own).agg(F.collect_list(F.struct("r", "c", "para_no", "runs")).alias("texts"))
    # a first row whose text is all bold is a header
    bold = paras.select(*own, "r", F.explode("runs").alias("x")).where("r = 0")
    heads = aggregates.header_rows(bold.select(*own, F.col("r").alias("row"), "x.text", "x.bold"), own, "row")
    rows = folds.padded_rows(cells, own)
    number = F.row_number().over(Window.partitionBy(*own, "row").orderBy("c")) - 1
    rows = rows.withColumn("cell", number).join(heads, own, "left")
    entry = F.struct(
        F.col("row"), F.col("cell"), F.col("c").alias("start"), F.col("col_span").alias("grid_span"), F.when(F.col("placeholder"), 1).otherwise(F.col("row_span")).alias("row_span"), F.col("placeholder").alias("merged"),
        ((F.col("row") == 0) & F.coalesce("is_header", F.lit(False))).alias("header"), F.col("shading"), F.col("b_top").alias("top"), F.col("b_bottom").alias("bottom"), F.col("b_left").alias("left"), F.col("b_right").alias("right"),
    )
    tables = rows.groupBy(*own).agg(F.array_sort(F.collect_list(entry)).cast(TABLE_CELLS).alias("cells"), F.sort_array(F.collect_set(F.struct(F.col("left").alias("x"), F.col("right").alias("w")))).alias("xs"))
    edges = cells.groupBy(*own).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.array("left", "right"))))).alias("edges"))
    spans = inside.groupBy(*own).agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.min_by("top", "line_no").alias("top"))
    widths = F.transform(F.slice("edges", 2, F.size("edges")), lambda e, i: e - F.get(F.col("edges"), i))
    out = tables.drop("xs").join(edges, own).join(spans, own).join(texts, own, "left").withColumn("widths", widths)
    return out.select(*KEY, "first", "last", "top", "widths", "cells", "texts"), inside.select(*KEY, "line_no").distinct()


def aligned_tables(lines: DataFrame, taken: DataFrame) -> DataFrame:
    """Tables by alignment alone: KEY, first, last, top, widths, cells, texts. lines carry right_edge; taken are lines that other blocks have."""
    spans = joins.spans_without(windows.table_spans(lines, KEY, "line_no", "n_cells", "top", "height"), taken, KEY)
    inside = lines.join(spans, KEY).where(F.col("line_no").between(F.col("first"), F.col("last")))
    own = [*KEY, "first"]
    pieces = inside.select(*own, "last", "line_no", "right_edge", F.posexplode("cells").alias("piece", "p")).select(*own, "last", "line_no", "right_edge", "piece", F.col("p.left").alias("left"), F.col("p.runs").alias("runs"))
    columns = folds.cluster_by_anchor(pieces, own, "left").withColumnRenamed("cluster_no", "col")
    many = columns.groupBy(*own).agg(F.count("*").alias("n_cols"), F.sort_array(F.collect_list("center")).alias("centers")).where("n_cols >= 2")
    near = joins.nearest(pieces.select(*own, "line_no", "piece", "left"), columns.select(*own, "col", "center"), own, "left", "center", "col").select(*own, "line_no", "piece", "col")
    put = pieces.join(near, [*own, "line_no", "piece"]).join(many, own).withColumn("r", F.col("line_no") - F.col("first"))
    text = F.array_sort(F.collect_list(F.struct("piece", "runs")))
    cells = put.groupBy(*own, "r", F.col("col").alias("c")).agg(F.aggregate(text, no_runs(), lambda s, x: append_runs(spaced(s), x["runs"])).alias("runs"))
    bold = cells.select(*own, "r", F.explode("runs").alias("x"))
    heads = aggregates.header_rows(bold.select(*own, F.col("r").alias("row"), "x.text", "x.bold"), own, "row")
    texts = cells.groupBy(*own).agg(F.collect_list(F.struct(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.lit(0).cast("long").alias("para_no"), "runs")).alias("texts"))
    base = inside.groupBy(*own).agg(F.max("last").alias("last"), F.min_by("top", "line_no").alias("top"), F.max("right_edge").alias("right_edge")).join(many, own).join(texts, own).join(heads, own, "left")
    widths = F.transform("centers", lambda x, i: F.greatest(F.lit(1.0), F.coalesce(F.get(F.col("centers"), i + 1), F.col("right_edge")) - x))
    row = lambda r: F.transform(
        F.sequence(F.lit(0), F.col("n_cols").cast("int") - 1),
        lambda c: F.struct(
            r.alias("row"), c.alias("cell"), c.alias("start"), F.lit(1).alias("grid_span"), F.lit(1).alias("row_span"), F.lit(False).alias("merged"), ((r == 0) & F.coalesce("is_header", F.lit(False))).alias("header"), F.lit("").alias("shading"),
            *[F.lit(True).alias(e) for e in ("top", "bottom", "left", "right")],
        ),
    )
    grid = F.flatten(F.transform(F.sequence(F.lit(0), (F.col("last") - F.col("first")).cast("int")), row)).cast(TABLE_CELLS)
    return base.select(*KEY, "first", "last", "top", widths.alias("widths"), grid.alias("cells"), "texts")


def paragraphs(lines: DataFrame, body: DataFrame) -> DataFrame:
    """Paragraphs of the remaining lines: KEY, first, top, style, alignment, list, runs. lines carry the page's edges; body is body_size's."""
    flow = windows.paragraphs(lines, KEY, "line_no")
    own = [*KEY, "para_no"]
    aligned = aggregates.alignment(flow, own, "line_no")

    def step(s, x):
        hyphen = (F.octet_length(fn.run_text(s)) > 1) & fn.run_text(s).endswith("-")
        return append_runs(F.when(hyphen, s.cast(RUNS)).otherwise(spaced(s)), x["runs"])

    text = F.array_sort(F.collect_list(F.struct("line_no", F.col("runs").cast(RUNS).alias("runs"))))
    paras = flow.groupBy(*own).agg(F.min("line_no").alias("first"), F.min_by("top", "line_no").alias("top"), F.avg("size").alias("size"), F.count("*").alias("n"), F.aggregate(text, no_runs(), step).alias("runs"))
    styled = paras.join(aligned, own).join(body, "doc_id", "left").withColumn("style", fn.style_for_size(F.col("size"), F.coalesce("body_size", F.lit(11.0)), F.col("n")))
    item = F.when(F.col("style") == "Normal", fn.strip_run_marker(F.col("runs")))
    out = styled.withColumn("item", item).where(fn.visible(F.col("runs")))
    listed = F.struct(F.coalesce("item.kind", F.lit("None")).alias("kind"), F.lit(0).alias("level"), F.coalesce("item.ordinal", F.lit(0)).alias("ordinal"))
    return out.select(*KEY, "first", "top", "style", "alignment", listed.alias("list"), F.coalesce(F.col("item.runs").cast(RUNS), F.col("runs").cast(RUNS)).alias("runs"))


def blocks(pages: DataFrame, fragments: DataFrame, images: DataFrame | None = None, rules: DataFrame | None = None, shades: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """Blocks of documents in reading order: doc_id, part, path, kind, style, alignment, list, ordinal, runs, widths, cells, image (the sinks' schema).

    pages: KEY, width, height; fragments, images, rules and shades as the layout source gives them. A drawn table goes before
    one found by alignment. Text beside a drawn table, between its first and last line, stays; with compat it goes.
    """
    all_lines = settle(lines(fragments), "lines")
    header_footer, gone = (settle(x, "running") for x in running(all_lines, pages))
    body = aggregates.body_size(all_lines, ["doc_id"], "size")
    free = joins.without(windows.page_edges(all_lines, KEY), gone, [*KEY, "line_no"])
    tables = []
    if rules is not None:
        ruled, inside = (settle(x, "ruled") for x in ruled_tables(all_lines, settle(rules, "rules"), shades))
        if compat:
            between = all_lines.select(*KEY, "line_no").join(ruled.select(*KEY, "first", "last"), KEY).where(F.col("line_no").between(F.col("first"), F.col("last"))).select(*KEY, "line_no")
            inside = inside.union(between).distinct()
        tables.append(ruled)
        free = joins.without(free, inside, [*KEY, "line_no"])
        taken = inside.union(gone)
    else:
        taken = gone
    free = settle(free, "free")
    aligned = settle(aligned_tables(free, taken), "aligned")
    in_tables = free.select(*KEY, "line_no").join(aligned.select(*KEY, "first", "last"), KEY).where(F.col("line_no").between(F.col("first"), F.col("last"))).select(*KEY, "line_no")
    tables.append(aligned)
    paras = paragraphs(joins.without(free, in_tables, [*KEY, "line_no"]), body)
    void = lambda kind: F.lit(None).cast(kind)
    listed = "struct<kind:string,level:int,ordinal:int>"
    texts = "array<struct<r:int,c:int,para_no:bigint,runs:" + RUNS + ">>"
    made = paras.select(*KEY, "first", "top", F.lit("paragraph").alias("kind"), "style", "alignment", F.col("list").cast(listed).alias("list"), "runs", void("array<double>").alias("widths"), void(TABLE_CELLS).alias("cells"), void(texts).alias("texts"))
    for t in tables:
        made = made.unionByName(t.select(*KEY, "first", "top", F.lit("table").alias("kind"), void("string").alias("style"), void("string").alias("alignment"), void(listed).alias("list"), void(RUNS).alias("runs"), "widths", "cells", F.col("texts").cast(texts).alias("texts")))
    numbered = settle(made.withColumn("block_no", F.row_number().over(Window.partitionBy(*KEY).orderBy("first", "kind")).cast("long")), "blocks")
    if images is not None:
        order = joins.interleave(numbered, images.select(*KEY, "image_no", "top").withColumn("image_no", F.col("image_no").cast("long")), KEY)
        pictures = images.select(*KEY, F.col("image_no").cast("long").alias("image_no"), F.struct(F.col("src").alias("target"), F.lit(0).alias("px_w"), F.lit(0).alias("px_h"), F.col("width").alias("disp_w"), F.col("height").alias("disp_h")).alias("image"))
        numbered = order.drop("kind").join(numbered, [*KEY, "block_no"], "left").join(pictures, [*KEY, "image_no"], "left").withColumn("kind", F.coalesce("kind", F.lit("image")))
    else:
        numbered = numbered.withColumn("seq", F.col("block_no")).withColumn("image", void("struct<target:string,px_w:int,px_h:int,disp_w:double,disp_h:double>"))
    place = (F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "seq")) - 1).cast("int")
    top = numbered.withColumn("n", place)
    columns = ["doc_id", "part", "path", "kind", "style", "alignment", "list", "ordinal", "runs", "widths", "cells", "image"]
    item = F.when(F.col("list").isNotNull(), F.struct(F.col("list.kind").alias("kind"), F.col("list.level").alias("level"), F.lit(0).alias("num_id")))
    body_rows = top.select("doc_id", F.lit("body").alias("part"), F.array("n").alias("path"), "kind", "style", "alignment", item.alias("list"), F.coalesce("list.ordinal", F.lit(0)).alias("ordinal"), "runs", "widths", "cells", "image")
    plain = F.struct(F.lit("None").alias("kind"), F.lit(0).alias("level"), F.lit(0).alias("num_id"))
    cell_text = top.where("kind = 'table'").select("doc_id", "n", "cells", F.explode("texts").alias("x"))
    cell_no = F.element_at(F.filter("cells", lambda c: (c["row"] == F.col("x.r")) & (c["start"] == F.col("x.c"))), 1)["cell"]
    inner = cell_text.select(
        "doc_id", F.lit("body").alias("part"), F.array("n", F.col("x.r"), cell_no, F.col("x.para_no").cast("int")).alias("path"), F.lit("paragraph").alias("kind"), F.lit("Normal").alias("style"), F.lit("Default").alias("alignment"), plain.alias("list"), F.lit(0).alias("ordinal"),
        F.col("x.runs").alias("runs"), void("array<double>").alias("widths"), void(TABLE_CELLS).alias("cells"), void("struct<target:string,px_w:int,px_h:int,disp_w:double,disp_h:double>").alias("image"),
    )
    around = header_footer.select(
        "doc_id", "part", F.array(F.col("n")).alias("path"), F.lit("paragraph").alias("kind"), F.lit("Normal").alias("style"), F.lit("Default").alias("alignment"), plain.alias("list"), F.lit(0).alias("ordinal"),
        F.col("runs").cast(RUNS).alias("runs"), void("array<double>").alias("widths"), void(TABLE_CELLS).alias("cells"), void("struct<target:string,px_w:int,px_h:int,disp_w:double,disp_h:double>").alias("image"),
    )
    return body_rows.select(*columns).unionByName(inner.select(*columns)).unionByName(around.select(*columns))
