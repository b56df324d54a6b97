"""Named queries: every operator that SQL can express, over the driver's tables, with its DuckDB equivalent.

The queries apply operators to tables that are not layouts; their numbers come from integer keys, so that both engines
compute equal doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia import functions as fn
from folia.operators import aggregates, folds, joins, windows
from folia.plans.settle import settle
from folia.sinks import docx
from folia.sources import images, layout, ooxml, xml

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (table reader) -> DataFrame under its name, with its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)


# ---------------------------------------------------------------- inputs

#: Lines of documents: a source is a document, one of its rows a page.
LINES_SQL = """
    l0 AS (SELECT source, doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents WHERE source IS NOT NULL),
    l1 AS (SELECT source, doc_id, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS line_no FROM l0)"""


def source_lines(t) -> DataFrame:
    d = t("documents").where("source IS NOT NULL")
    return d.select("source", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))


#: Pages with a title line put before their lines, numbered within the source; the last page of every fifth source keeps the title only.
PAGES_SQL = f"""{LINES_SQL},
    n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_no, count(*) OVER (PARTITION BY source) AS pages FROM documents WHERE source IS NOT NULL),
    bare AS (SELECT source, doc_id FROM n WHERE page_no = pages AND CAST(substr(source, 4) AS INT) % 5 = 0),
    l AS (SELECT l1.source, n.page_no, line_no + 1 AS line_no, line AS text FROM l1 JOIN n USING (source, doc_id) WHERE (source, doc_id) NOT IN (SELECT source, doc_id FROM bare)
          UNION ALL SELECT source, page_no, 0, 'Report ' || source || ' page ' || page_no FROM n),
    z AS (SELECT source, page_no, line_no, text, CAST(line_no * 14 + 20 AS DOUBLE) AS top, CAST(line_no * 14 + 30 AS DOUBLE) AS bottom, 842.0 AS page_height FROM l),
    k AS (SELECT *, CASE WHEN top < page_height * 0.10 THEN 'header' WHEN bottom > page_height * 0.90 THEN 'footer' END AS zone,
          CAST(round(top) AS BIGINT) AS at_y, regexp_replace(text, '[0-9]', '#', 'g') AS masked FROM z),
    b AS (SELECT source, zone, at_y, masked, count(DISTINCT page_no) AS n_pages, min(page_no) AS first_page FROM k WHERE zone IS NOT NULL GROUP BY ALL),
    t AS (SELECT source, count(DISTINCT page_no) AS pages FROM z GROUP BY source),
    buckets AS (SELECT source, zone, at_y, masked, n_pages, first_page FROM b JOIN t USING (source) WHERE n_pages >= 2 AND n_pages >= pages // 2)"""


def titled_pages(t) -> DataFrame:
    """source, page_no, line_no, text, top, bottom, page_height: documents are exploded once; the pages' numbers are counted over narrow rows."""
    d = t("documents").where("source IS NOT NULL")
    pages = windows.places(d.select("source", "doc_id"), ["source"], ["doc_id"]).withColumn("page_no", F.col("place") + 1).drop("place")
    last = d.groupBy("source").agg(F.max("doc_id").alias("last"))
    bare = (F.col("doc_id") == F.col("last")) & (F.substring("source", 4, 10).cast("int") % 5 == 0)
    titled = d.select("source", "doc_id", "text").join(pages, ["source", "doc_id"]).join(last, "source")
    title = F.concat(F.lit("Report "), "source", F.lit(" page "), F.col("page_no").cast("string"))
    body = F.split(F.coalesce("text", F.lit("")), "\n")
    lines = titled.select("source", "page_no", F.posexplode(F.when(F.coalesce(bare, F.lit(False)), F.array(title)).otherwise(F.concat(F.array(title), body))).alias("line_no", "text"))
    return lines.withColumns({"top": (F.col("line_no") * 14 + 20).cast("double"), "bottom": (F.col("line_no") * 14 + 30).cast("double"), "page_height": F.lit(842.0)})


def narrow_pages(t) -> DataFrame:
    """titled_pages() written once, with the texts of the margins only and the length of each."""
    pages = titled_pages(t).withColumn("n", F.length("text"))
    return settle(pages.withColumn("text", F.when(fn.in_margin(F.col("top"), F.col("bottom"), F.col("page_height")).isNotNull(), F.col("text"))), "pages")


#: Boxes from events, forty a page at most.
BOXES_SQL = """
    boxes AS (SELECT event_id // 40 AS page, event_id AS no, CAST((event_id * 37) % 700 AS DOUBLE) AS "left", CAST((event_id * 53) % 800 AS DOUBLE) AS top,
              CAST((event_id * 11) % 90 + 5 AS DOUBLE) AS width, CAST((event_id * 7) % 20 + 8 AS DOUBLE) AS height FROM events)"""


def boxes(t) -> DataFrame:
    e = t("events")
    num = lambda k, m, a=0: ((F.col("event_id") * k) % m + a).cast("double")
    return e.select(F.expr("event_id DIV 40").alias("page"), F.col("event_id").alias("no"), num(37, 700).alias("left"), num(53, 800).alias("top"), num(11, 90, 5).alias("width"), num(7, 20, 8).alias("height"))


#: Segments from events, thirty a page at most.
SEGMENTS_SQL = """
    segs AS (SELECT event_id // 30 AS page, event_id AS seg_no, event_id % 2 = 0 AS horizontal, CAST((event_id * 37) % 100 AS DOUBLE) AS pos,
             CAST((event_id * 13) % 80 AS DOUBLE) AS a, CAST((event_id * 13) % 80 + 5 + (event_id * 7) % 25 AS DOUBLE) AS b FROM events)"""


def segments(t) -> DataFrame:
    e, k = t("events"), F.col("event_id")
    return e.select(F.expr("event_id DIV 30").alias("page"), k.alias("seg_no"), (k % 2 == 0).alias("horizontal"), (k * 37 % 100).cast("double").alias("pos"), (k * 13 % 80).cast("double").alias("a"), (k * 13 % 80 + 5 + k * 7 % 25).cast("double").alias("b"))


# ---------------------------------------------------------------- aggregations


@query(f"""WITH {LINES_SQL} SELECT source, CASE WHEN count(*) = 0 THEN 11.0 ELSE min(h) / 2.0 END AS body_size FROM
    (SELECT source, h, n, max(n) OVER (PARTITION BY source) AS m FROM (SELECT source, CAST(round((length(line) % 23 + 6) * 0.7 * 2) AS BIGINT) AS h, count(*) AS n FROM l1 GROUP BY ALL)) WHERE n = m GROUP BY source""")
def body_size_mode(t):
    lines = source_lines(t).select("source", ((F.length("line") % 23 + 6) * 0.7).cast("double").alias("size"))
    return aggregates.body_size(lines, ["source"], "size")


@query(f"WITH {PAGES_SQL} SELECT source, zone, at_y, masked, n_pages, first_page FROM buckets")
def running_text(t):
    return aggregates.running_text(titled_pages(t), "source").withColumnRenamed("at", "at_y")


SAFE_SQL = f"""WITH {PAGES_SQL},
    hit AS (SELECT k.source, page_no, line_no, zone, at_y, masked FROM k JOIN buckets USING (source, zone, at_y, masked)),
    total AS (SELECT source, page_no, count(*) AS n FROM z GROUP BY ALL),
    emptied AS (SELECT source, page_no, zone FROM (SELECT source, page_no, zone, count(DISTINCT line_no) AS h FROM hit GROUP BY ALL) JOIN total USING (source, page_no) WHERE h >= n),
    rejected AS (SELECT DISTINCT source, zone, at_y, masked FROM hit JOIN emptied USING (source, page_no, zone)),
    safe AS (SELECT * FROM buckets ANTI JOIN rejected USING (source, zone, at_y, masked))"""


@query(f"{SAFE_SQL} SELECT source, zone, at_y, masked, n_pages, first_page FROM safe")
def running_text_safe(t):
    return aggregates.safe_running_text(narrow_pages(t), "source")[0].withColumnRenamed("at", "at_y")


FLOW_SQL = f"""{SAFE_SQL},
    gone AS (SELECT DISTINCT source, page_no, line_no FROM hit JOIN safe USING (source, zone, at_y, masked)),
    f0 AS (SELECT z.source, page_no, line_no, text, top, 10.0 AS height, CAST(10 + length(text) % 7 AS DOUBLE) AS size, CAST(50 + length(text) % 5 AS DOUBLE) AS x_min, CAST(50 + length(text) % 500 + 60 AS DOUBLE) AS x_max FROM z),
    f1 AS (SELECT *, min(x_min) OVER (PARTITION BY source, page_no) AS le, max(x_max) OVER (PARTITION BY source, page_no) AS re FROM f0),
    f2 AS (SELECT f1.* FROM f1 ANTI JOIN gone USING (source, page_no, line_no)),
    f3 AS (SELECT *, lag(line_no) OVER w AS p_no, lag(size) OVER w AS p_size, lag(x_min) OVER w AS p_min, lag(x_max) OVER w AS p_max, lag(top) OVER w AS p_top, lag(height) OVER w AS p_h FROM f2 WINDOW w AS (PARTITION BY source, page_no ORDER BY line_no)),
    f4 AS (SELECT *, CASE WHEN p_no IS NULL THEN 0 WHEN p_no = line_no - 1 AND abs(size - p_size) <= p_size * 0.12 AND p_max >= re - (re - le) * 0.10 AND x_min <= p_min + (re - le) * 0.02 + 3.0
           AND top - (p_top + p_h) <= p_h * 0.9 AND NOT (p_min > le + (re - le) * 0.15 AND x_min < le + (re - le) * 0.05) THEN 0 ELSE 1 END AS flag FROM f3),
    f5 AS (SELECT *, CAST(sum(flag) OVER (PARTITION BY source, page_no ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS para_no FROM f4),
    f6 AS (SELECT source, page_no, para_no, count(*) AS n_lines, avg(size) AS size, min(line_no) AS first_line, max(re - le) AS w,
           bool_and(x_min - le >= (re - le) * 0.05 AND abs((x_min - le) - (re - x_max)) <= (re - le) * 0.06) AS c, bool_and(x_min - le >= (re - le) * 0.05 AND re - x_max <= 3.0) AS r,
           sum(CASE WHEN abs(re - x_max) > 1.0 THEN 1 ELSE 0 END) - arg_max(CASE WHEN abs(re - x_max) > 1.0 THEN 1 ELSE 0 END, line_no) AS ragged FROM f5 GROUP BY ALL)"""


def flow(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Body lines of narrow_pages() without running text, and their paragraphs."""
    _, hits = aggregates.safe_running_text(pages, "source")
    n = F.col("n")
    sized = pages.select("source", "page_no", "line_no", "top", F.lit(10.0).alias("height"), (10 + n % 7).cast("double").alias("size"), (50 + n % 5).cast("double").alias("x_min"), (50 + n % 500 + 60).cast("double").alias("x_max"))
    body = joins.without(windows.page_edges(sized, ["source", "page_no"]), hits, ["source", "page_no", "line_no"])
    lines = windows.paragraphs(body, ["source", "page_no"], "line_no")
    return lines, lines.groupBy("source", "page_no", "para_no").agg(F.count("*").alias("n_lines"), F.avg("size").alias("size"), F.min("line_no").alias("first_line"))


@query(f"{FLOW_SQL} SELECT source, page_no, para_no, n_lines, first_line FROM f6")
def paragraph_islands(t):
    return flow(narrow_pages(t))[1].drop("size")


@query(f"{FLOW_SQL} SELECT source, page_no, para_no, CASE WHEN w <= 20 THEN 'Default' WHEN c THEN 'Center' WHEN r THEN 'Right' WHEN n_lines > 1 AND ragged = 0 THEN 'Justify' ELSE 'Default' END AS alignment FROM f6")
def alignment_bool_and(t):
    return aggregates.alignment(flow(narrow_pages(t))[0], ["source", "page_no", "para_no"], "line_no")


STYLE_CASE = "CASE WHEN n_lines > 3 THEN 'Normal' WHEN size / body_size >= 1.70 THEN 'Title' WHEN size / body_size >= 1.40 THEN 'Heading1' WHEN size / body_size >= 1.22 THEN 'Heading2' WHEN size / body_size >= 1.10 THEN 'Heading3' ELSE 'Normal' END"


@query(f"""{FLOW_SQL}, m AS (SELECT source, min(h) / 2.0 AS body_size FROM (SELECT source, h, n, max(n) OVER (PARTITION BY source) AS mx FROM (SELECT source, CAST(round(size * 2) AS BIGINT) AS h, count(*) AS n FROM f0 GROUP BY ALL)) WHERE n = mx GROUP BY source)
    SELECT source, page_no, para_no, n_lines, {STYLE_CASE} AS style FROM f6 JOIN m USING (source)""")
def flagship_paragraphs(t):
    """Which paragraphs do documents have once running headers and footers are removed, and in what style?"""
    pages = narrow_pages(t)
    lines, paras = flow(pages)
    body = aggregates.body_size(pages.select("source", (10 + F.col("n") % 7).cast("double").alias("size")), ["source"], "size")
    return paras.join(body, "source").select("source", "page_no", "para_no", "n_lines", fn.style_for_size(F.col("size"), F.col("body_size"), F.col("n_lines")).alias("style"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_paragraphs"](spark, sf_dir)


@query(f"""SELECT doc_id, n_lines, {STYLE_CASE} AS style FROM (SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) % 6 AS n_lines, CAST(doc_id % 13 + 8 AS DOUBLE) AS size, 10.0 AS body_size FROM documents)""")
def style_classify(t):
    n = (F.size(F.split("text", "\n")) % 6).cast("bigint")
    d = t("documents").select("doc_id", n.alias("n_lines"), (F.col("doc_id") % 13 + 8).cast("double").alias("size"))
    return d.select("doc_id", "n_lines", fn.style_for_size(F.col("size"), F.lit(10.0), F.col("n_lines")).alias("style"))


@query(f"WITH {BOXES_SQL} SELECT page, min(top) AS top, max(height) AS height, max(height * 0.5) AS size, min(\"left\") AS x_min, max(\"left\" + width) AS x_max FROM boxes GROUP BY page")
def line_extents(t):
    return aggregates.line_extents(boxes(t).withColumn("size", F.col("height") * 0.5), ["page"])


@query("SELECT o_orderkey, CAST(max(n) AS BIGINT) AS n_columns FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, sum(greatest(CAST(l_quantity AS BIGINT) % 4, 1)) AS n FROM lineitem GROUP BY ALL) GROUP BY 1")
def widest_row(t):
    cells = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", (F.col("l_quantity").cast("long") % 4).alias("span"))
    return aggregates.widest_row(cells, ["o_orderkey"], "l_linenumber", "span")


@query("SELECT l_orderkey, l_linenumber, greatest(16.0, coalesce(max(CASE WHEN l_partkey % 3 <> 0 THEN l_quantity END), 0.0)) AS row_height FROM lineitem GROUP BY ALL")
def row_heights(t):
    return aggregates.row_heights(t("lineitem").withColumn("merged", F.col("l_partkey") % 3 == 0), ["l_orderkey", "l_linenumber"], "l_quantity", "merged")


@query("""SELECT conv_id, bool_or(f) AND coalesce(bool_and(b) FILTER (f), true) AS is_header FROM (SELECT conv_id, NOT regexp_full_match(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]*') AS f, length(coalesce(text, '')) % 3 <> 0 AS b FROM conversations WHERE turn // 2 = 0) GROUP BY conv_id""")
def header_rows(t):
    runs = t("conversations").select("conv_id", F.expr("turn DIV 2").alias("row"), F.coalesce("text", F.lit("")).alias("text")).withColumn("bold", F.length("text") % 3 != 0)
    return aggregates.header_rows(runs, ["conv_id"], "row")


@query("""SELECT source, min(c) AS rule_color FROM (SELECT source, c, n, max(n) OVER (PARTITION BY source) AS m FROM (SELECT source, CASE WHEN lang = 'en' AND doc_id % 3 = 0 THEN '999999' ELSE lang END AS c, count(*) AS n FROM documents GROUP BY ALL)) WHERE n = m GROUP BY source""")
def rule_color_mode(t):
    d = t("documents").withColumn("color", F.when((F.col("lang") == "en") & (F.col("doc_id") % 3 == 0), "").otherwise(F.col("lang")))
    return aggregates.rule_color(d, ["source"])


@query("SELECT conv_id, coalesce(bool_or(NOT regexp_full_match(text, '[ \\t\\n\\x0B\\f\\r]*')), false) AS has_text FROM (SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN '  ' ELSE text END AS text FROM conversations) GROUP BY conv_id")
def has_text(t):
    c = t("conversations").withColumn("text", F.when(F.col("conv_id") % 4 == 0, "  ").otherwise(F.col("text")))
    return aggregates.has_text(c, ["conv_id"], "text")


@query("""SELECT user_id, bool_or(m = 'image/png') AS has_png, bool_or(m = 'image/jpeg') AS has_jpeg, bool_or(m = 'image/gif') AS has_gif, bool_or(m = 'image/bmp') AS has_bmp
    FROM (SELECT user_id, CASE event_id % 7 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' ELSE 'application/octet-stream' END AS m FROM events) GROUP BY user_id""")
def media_flags(t):
    ending = F.get(F.array(F.lit(".png"), F.lit(".JPG"), F.lit(".gif")), (F.col("event_id") % 7).cast("int"))
    e = t("events").select("user_id", fn.mime_for(F.concat(F.lit("media/a"), F.coalesce(ending, F.lit(".bin")))).alias("mime"))
    return aggregates.media_flags(e, ["user_id"])


@query("SELECT DISTINCT lang, unnest(string_split(text, '')) AS char FROM documents WHERE text <> ''")
def glyph_set(t):
    return aggregates.glyph_set(t("documents"), ["lang"], "text")


# ---------------------------------------------------------------- windows


@query("""SELECT user_id, event_id, CAST(sum(CASE WHEN g > greatest(s * 0.6, 6.0) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cell FROM
    (SELECT user_id, event_id, ts, CAST((event_id * 37) % 900 AS DOUBLE) - lag(CAST((event_id * 37) % 900 + (event_id * 11) % 300 AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY ts) AS g, CAST(event_id % 30 + 5 AS DOUBLE) AS s FROM events)""")
def gap_split_cells(t):
    k = F.col("event_id")
    e = t("events").select("user_id", "event_id", "ts", (k * 37 % 900).cast("double").alias("left"), (k * 37 % 900 + k * 11 % 300).cast("double").alias("right"), (k % 30 + 5).cast("double").alias("size"))
    return windows.gap_cells(e, ["user_id"], ["ts"], "left", "right", "size").select("user_id", "event_id", "cell")


@query("""SELECT user_id, CAST(run_no AS BIGINT) AS run_no, event_type, string_agg(x, '' ORDER BY ts) AS text, count(*) AS n_runs FROM
    (SELECT *, sum(CASE WHEN p IS NULL OR p = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run_no FROM
     (SELECT user_id, ts, event_type, CAST(event_id % 10 AS VARCHAR) AS x, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events WHERE event_id % 9 <> 0)) GROUP BY ALL""")
def run_coalesce(t):
    e = t("events").select("user_id", "ts", "event_type", F.when(F.col("event_id") % 9 == 0, "").otherwise((F.col("event_id") % 10).cast("string")).alias("text"))
    return windows.coalesce_runs(e, ["user_id"], ["ts"], ["event_type"])


@query(f"""WITH {LINES_SQL}, c AS (SELECT doc_id, line_no, length(line) % 4 AS cells, CAST(line_no * 14 + (length(line) % 3) * 9 AS DOUBLE) AS top, 10.0 AS height FROM l1),
    f AS (SELECT *, lag(cells) OVER w AS pc, lag(top) OVER w AS pt, lag(height) OVER w AS ph FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    i AS (SELECT *, sum(CASE WHEN pc IS NULL THEN 0 WHEN cells < 2 OR pc < 2 OR top - (pt + ph) > ph * 1.6 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS g FROM f)
    SELECT doc_id, CAST(min(line_no) AS INT) AS first, CAST(max(line_no) AS INT) AS last, count(*) AS n_lines FROM i WHERE cells >= 2 GROUP BY doc_id, g HAVING count(*) >= 2""")
def table_islands(t):
    n = F.length("line")
    lines = source_lines(t).select("doc_id", "line_no", (n % 4).alias("cells"), (F.col("line_no") * 14 + n % 3 * 9).cast("double").alias("top"), F.lit(10.0).alias("height"))
    return windows.table_spans(lines, ["doc_id"], "line_no", "cells", "top", "height")


@query("""WITH e AS (SELECT event_id, user_id, user_id % 7 AS num_id, event_id % 3 AS level, event_id % 5 <> 0 AND user_id % 7 > 0 AS n FROM events),
    r AS (SELECT *, CASE level WHEN 0 THEN 0 WHEN 1 THEN sum(CASE WHEN level < 1 THEN 1 ELSE 0 END) OVER w ELSE sum(CASE WHEN level < 2 THEN 1 ELSE 0 END) OVER w END AS resets
          FROM e WINDOW w AS (PARTITION BY user_id, num_id, n ORDER BY event_id ROWS UNBOUNDED PRECEDING))
    SELECT event_id, CAST(CASE WHEN n THEN row_number() OVER (PARTITION BY user_id, num_id, n, level, resets ORDER BY event_id) ELSE 0 END AS INT) AS ordinal FROM r""")
def list_ordinals(t):
    e = t("events").select("event_id", "user_id", (F.col("user_id") % 7).alias("num_id"), (F.col("event_id") % 3).alias("level"), (F.col("event_id") % 5 != 0).alias("numbered"))
    return windows.list_ordinals(e, ["user_id"], ["event_id"]).select("event_id", "ordinal")


@query("""SELECT event_id, coalesce(last_value(CASE WHEN event_id % 3 = 0 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id ROWS UNBOUNDED PRECEDING), event_id) AS origin FROM events""")
def vmerge_origin(t):
    e = t("events").select("event_id", "user_id", (F.col("event_id") % 2).alias("col"), (F.col("event_id") % 3 != 0).alias("continues"))
    return windows.merge_origins(e, ["user_id"], "col", "event_id", "continues").select("event_id", "origin")


@query("SELECT doc_id, CAST(coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def prefix_offsets(t):
    d = t("documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    return windows.starts_overall(d, ["doc_id"], "size").select("doc_id", "start")


@query("""SELECT g AS part, min(doc_id) AS first, max(doc_id) AS last, count(*) AS n FROM (SELECT doc_id, quality AS g, doc_id - row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS i FROM (SELECT DISTINCT doc_id, quality FROM labels)) GROUP BY g, i""")
def consecutive_ranges(t):
    return windows.consecutive_ranges(t("labels").select(F.col("quality").alias("part"), "doc_id"), ["part"], "doc_id")


@query("SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 100 AS batch FROM documents")
def batch_100(t):
    return windows.batches(t("documents").select("doc_id", "lang"), ["lang"], ["doc_id"], 100).select("doc_id", "batch")


@query("""SELECT conv_id, turn, CAST(sum(CASE WHEN p IS NOT NULL AND abs(y - p) > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS para_no FROM
    (SELECT *, lag(y) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM (SELECT conv_id, turn, (length(coalesce(text, '')) % 3) * 0.75 AS y FROM conversations))""")
def cell_paragraphs(t):
    c = t("conversations").select("conv_id", "turn", (F.length(F.coalesce("text", F.lit(""))) % 3 * 0.75).alias("y"))
    return windows.cell_paragraphs(c, ["conv_id"], ["turn"], "y").select("conv_id", "turn", "para_no")


@query(f"""WITH {LINES_SQL}, b AS (SELECT doc_id, line_no, line_no % 5 = 3 AS e FROM l1), s AS (SELECT *, sum(CASE WHEN e THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS g FROM b)
    SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS BIGINT) AS para_no FROM s WHERE NOT e""")
def ocr_paragraphs(t):
    lines = source_lines(t).select("doc_id", "line_no", F.when(F.col("line_no") % 5 == 3, " ").otherwise("x").alias("line"))
    return windows.blank_separated(lines, ["doc_id"], ["line_no"], "line").select("doc_id", "line_no", "para_no")


@query(f"""WITH {LINES_SQL}, a AS (SELECT doc_id, line_no, regexp_replace(CASE line_no % 4 WHEN 0 THEN line || '-' WHEN 1 THEN chr(9) || ' ' || line WHEN 2 THEN line || chr(13) ELSE CASE WHEN line_no % 8 = 3 THEN ' ' ELSE line END END, '\r+$', '') AS x FROM l1),
    b AS (SELECT doc_id, line_no, regexp_replace(x, '^[ \t]+', '') AS x, regexp_full_match(x, '[ \t\n\x0B\f\r]*') AS e FROM a),
    g AS (SELECT *, sum(CASE WHEN e THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS blanks FROM b),
    p AS (SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY blanks) - 1 AS para_no, line_no, x FROM g WHERE NOT e)
    SELECT doc_id, CAST(para_no AS BIGINT) AS para_no, md5(list_reduce(list(x ORDER BY line_no), lambda s, t: CASE WHEN strlen(s) > 1 AND s LIKE '%-' THEN s || t ELSE s || ' ' || t END)) AS text_md5 FROM p GROUP BY ALL""")
def ocr_text(t):
    """Recognised lines cleaned and joined to paragraphs."""
    k, line = F.col("line_no") % 4, F.col("line")
    raw = F.when(k == 0, F.concat(line, F.lit("-"))).when(k == 1, F.concat(F.lit("\t "), line)).when(k == 2, F.concat(line, F.lit("\r"))).when(F.col("line_no") % 8 == 3, " ").otherwise(line)
    paras = windows.recognized_paragraphs(source_lines(t).select("doc_id", "line_no", raw.alias("line")), ["doc_id"], "line_no", "line")
    return paras.select("doc_id", "para_no", F.md5("text").alias("text_md5"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, max(CASE WHEN turn % 3 <> 0 THEN turn END) OVER (PARTITION BY conv_id) AS m FROM conversations) WHERE turn <= m")
def trim_trailing(t):
    return windows.trim_trailing(t("conversations"), ["conv_id"], "turn", F.col("turn") % 3 != 0).select("conv_id", "turn")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) * 9360, 6) AS share FROM lineitem")
def width_share(t):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]
    return windows.width_shares(t("lineitem").select(*keys), ["l_orderkey"], "l_quantity", 9360.0).select(*keys, F.round("share", 6).alias("share"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS image_id FROM conversations WHERE role = 'user'")
def image_ids(t):
    c = t("conversations").where("role = 'user'").select("conv_id", "turn", F.lit(1).alias("one"))
    return windows.starts_before(c, ["conv_id"], ["turn"], "one").select("conv_id", "turn", (F.col("start") + 1).alias("image_id"))


# ---------------------------------------------------------------- joins and sets


@query("SELECT c_custkey, CAST(c_custkey % 30 AS INT) AS num_id, n_regionkey AS abstract_id, coalesce(o_orderstatus = 'F', false) AS numbered FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 30 LEFT JOIN orders ON o_orderkey = n_regionkey")
def numbering_left_join(t):
    items = t("customer").select("c_custkey", (F.col("c_custkey") % 30).cast("int").alias("num_id"), F.lit(0).alias("level"))
    nums = t("nation").select(F.col("n_nationkey").alias("num_id"), F.col("n_regionkey").alias("abstract_id"))
    # only what some list names can meet an item; the rest of the table would be shuffled for nothing
    levels = t("orders").join(F.broadcast(nums.select(F.col("abstract_id").alias("o_orderkey")).distinct()), "o_orderkey", "left_semi")
    levels = levels.select(F.col("o_orderkey").alias("abstract_id"), F.lit(0).alias("level"), (F.col("o_orderstatus") == "F").alias("numbered"))
    return joins.numbering(items, nums, levels, []).select("c_custkey", "num_id", "abstract_id", "numbered")


@query("""WITH a AS (SELECT unnest([0, 1, 2, 3, 4]) AS idx, CAST(unnest([10, 38, 60, 88, 130]) AS DOUBLE) AS x), p AS (SELECT p_partkey, CAST(p_size * 3 AS DOUBLE) AS pos FROM part)
    SELECT p_partkey, pos, (SELECT arg_min(idx, abs(x - pos) * 1000 - idx) FROM a WHERE abs(x - pos) <= 14) AS idx FROM p""")
def nearest_column(t):
    points = t("part").select("p_partkey", (F.col("p_size") * 3).cast("double").alias("pos"))
    anchors = points.sparkSession.createDataFrame([(0, 10.0), (1, 38.0), (2, 60.0), (3, 88.0), (4, 130.0)], "idx int, x double")
    return joins.nearest(points, anchors, [], "pos", "x", "idx")


@query(f"""WITH {BOXES_SQL}, p AS (SELECT page, no, "left" + width / 2 AS x, top + height / 2 AS y FROM boxes WHERE no % 2 = 0), b AS (SELECT page, no AS box_no, "left" AS l, "left" + width * 4 AS r, top AS t, top + height * 6 AS b FROM boxes WHERE no % 2 = 1)
    SELECT page, no, min(box_no) AS box_no FROM p JOIN b USING (page) WHERE x >= l - 2 AND x <= r + 2 AND y >= t - 2 AND y <= b + 2 GROUP BY page, no""")
def point_in_box(t):
    b = boxes(t)
    points = b.where("no % 2 = 0").select("page", "no", (F.col("left") + F.col("width") / 2).alias("x"), (F.col("top") + F.col("height") / 2).alias("y"))
    rects = b.where("no % 2 = 1").select("page", F.col("no").alias("box_no"), "left", (F.col("left") + F.col("width") * 4).alias("right"), "top", (F.col("top") + F.col("height") * 6).alias("bottom"))
    return joins.point_in_box(points, rects, ["page"], "x", "y", ["box_no"], key=["page", "no"]).select("page", "no", "box_no")


@query(f"""WITH {BOXES_SQL}, c AS (SELECT page, no, "left" + width / 2 AS x, top + height / 2 AS y FROM boxes WHERE no % 2 = 0), s AS (SELECT page, no AS sn, "left" AS l, top AS t, width * 3 AS w, height * 3 AS h, CASE WHEN no % 3 = 0 THEN '' ELSE 'C' || no END AS color FROM boxes WHERE no % 2 = 1)
    SELECT c.page, c.no, coalesce(arg_min(color, sn), '') AS shading FROM c LEFT JOIN s ON c.page = s.page AND x >= l AND x <= l + w AND y >= t AND y <= t + h AND color <> '' GROUP BY ALL""")
def shade_cells(t):
    b = boxes(t)
    cells = b.where("no % 2 = 0").select("page", "no", "left", (F.col("left") + F.col("width")).alias("right"), "top", (F.col("top") + F.col("height")).alias("bottom"))
    color = F.when(F.col("no") % 3 == 0, "").otherwise(F.concat(F.lit("C"), F.col("no").cast("string")))
    shades = b.where("no % 2 = 1").select("page", F.col("no").alias("shade_no"), F.col("left").alias("x"), F.col("top").alias("y"), (F.col("width") * 3).alias("w"), (F.col("height") * 3).alias("h"), color.alias("color"))
    return joins.shade_cells(cells, shades, ["page"], ["no"]).select("page", "no", "shading")


@query(f"""WITH {BOXES_SQL}, b AS (SELECT page, no AS box_no, "left" AS l, "left" + width * 2 AS r, top AS t, top + height * 4 AS b FROM boxes WHERE no % 5 = 0)
    SELECT page, no, box_no FROM boxes JOIN b USING (page) WHERE top >= t - 2 AND top + height <= b + 2 AND "left" + width >= l - 2 AND "left" <= r + 2""")
def lines_in_boxes(t):
    b = boxes(t)
    lines = b.select("page", "no", "top", "height", F.col("left").alias("x_min"), (F.col("left") + F.col("width")).alias("x_max"))
    rects = b.where("no % 5 = 0").select("page", F.col("no").alias("box_no"), F.col("left").alias("b_left"), (F.col("left") + F.col("width") * 2).alias("b_right"), F.col("top").alias("b_top"), (F.col("top") + F.col("height") * 4).alias("b_bottom"))
    return joins.lines_in_boxes(lines, rects, ["page"]).select("page", "no", "box_no")


TOUCH = "CASE WHEN p.horizontal = q.horizontal THEN abs(p.pos - q.pos) <= 2 AND p.a <= q.b + 2 AND q.a <= p.b + 2 ELSE p.pos >= q.a - 2 AND p.pos <= q.b + 2 AND q.pos >= p.a - 2 AND q.pos <= p.b + 2 END"


@query(f"WITH {SEGMENTS_SQL} SELECT p.page, p.seg_no AS i, q.seg_no AS j FROM segs p JOIN segs q ON p.page = q.page AND p.seg_no < q.seg_no WHERE {TOUCH}")
def touching_segments(t):
    return joins.touching(segments(t), ["page"])


@query(f"""WITH RECURSIVE {SEGMENTS_SQL}, e AS (SELECT p.page, p.seg_no AS i, q.seg_no AS j FROM segs p JOIN segs q ON p.page = q.page AND p.seg_no <> q.seg_no WHERE {TOUCH}),
    r AS (SELECT page, seg_no AS i, seg_no AS j FROM segs UNION SELECT r.page, r.i, e.j FROM r JOIN e ON r.page = e.page AND r.j = e.i)
    SELECT page, i AS seg_no, min(j) AS component FROM r GROUP BY page, i""")
def segment_components(t):
    return folds.components(segments(t), ["page"])


@query(f"""WITH {SEGMENTS_SQL}, e AS (SELECT page, seg_no AS edge_no, pos, a + 3 AS a, b - 4 AS b FROM segs WHERE seg_no % 3 = 0)
    SELECT page, edge_no FROM e WHERE EXISTS (SELECT 1 FROM segs s WHERE s.page = e.page AND s.horizontal AND abs(s.pos - e.pos) <= 2 AND s.a <= e.a + 2 AND s.b >= e.b - 2)""")
def covered_edges(t):
    s = segments(t)
    edges = s.where("seg_no % 3 = 0").select("page", F.col("seg_no").alias("edge_no"), "pos", (F.col("a") + 3).alias("a"), (F.col("b") - 4).alias("b"))
    return joins.covered_edges(edges, s.where("horizontal"), ["page"]).select("page", "edge_no")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_consumed(t):
    return joins.without(t("documents").select("doc_id", "lang"), t("labels"), ["doc_id"])


@query("""SELECT d.lang, d.doc_id AS first, d.doc_id + 2 AS last FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l JOIN documents x ON x.doc_id = l.doc_id WHERE x.lang = d.lang AND l.quality = 0 AND l.doc_id BETWEEN d.doc_id AND d.doc_id + 2)""")
def interval_anti(t):
    d = t("documents").select("lang", "doc_id")
    spans = d.select("lang", F.col("doc_id").alias("first"), (F.col("doc_id") + 2).alias("last"))
    consumed = t("labels").where("quality = 0").join(d, "doc_id").select("lang", F.col("doc_id").alias("line_no"))
    return joins.spans_without(spans, consumed, ["lang"])


@query(f"""WITH {BOXES_SQL}, b AS (SELECT page, no AS block_no, top FROM boxes WHERE no % 3 <> 0), i AS (SELECT page, no AS image_no, top FROM boxes WHERE no % 3 = 0),
    s AS (SELECT i.page, image_no, i.top, coalesce(min(CASE WHEN b.top >= i.top THEN block_no END), 1099511627776) AS slot FROM i LEFT JOIN b ON b.page = i.page GROUP BY ALL),
    u AS (SELECT page, block_no AS slot, 1 AS late, top, 'block' AS kind, block_no, NULL AS image_no FROM b UNION ALL SELECT page, slot, 0, top, 'image', NULL, image_no FROM s)
    SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY slot, late, CASE WHEN kind = 'image' THEN top END, image_no) AS INT) AS seq, kind, block_no, image_no FROM u""")
def interleave_by_position(t):
    b = boxes(t)
    return joins.interleave(b.where("no % 3 <> 0").select("page", F.col("no").alias("block_no"), "top"), b.where("no % 3 = 0").select("page", F.col("no").alias("image_no"), "top"), ["page"])


@query("SELECT r_regionkey AS doc, n_nationkey AS page_no, o.r_name AS text FROM region o JOIN nation n ON n.n_regionkey = o.r_regionkey")
def cross_stamp(t):
    pages = t("nation").select(F.col("n_regionkey").alias("doc"), F.col("n_nationkey").alias("page_no"))
    return joins.stamp(pages, t("region").select(F.col("r_regionkey").alias("doc"), F.col("r_name").alias("text")), ["doc"])


@query("""SELECT doc_id, round(sum(coalesce(CASE WHEN c BETWEEN 'a' AND 'z' THEN 0.4::DOUBLE + (ascii(c) % 7) * 0.05::DOUBLE END, 0.5::DOUBLE) * 11.0::DOUBLE), 4) AS width FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE text <> '') GROUP BY doc_id""")
def glyph_advance_sum(t):
    texts = t("documents").select("doc_id", "text", F.lit(11.0).alias("size"))
    letters = [chr(c) for c in range(97, 123)]
    cmap = texts.sparkSession.createDataFrame([(c, ord(c)) for c in letters], "char string, glyph int")
    widths = texts.sparkSession.createDataFrame([(ord(c), 0.4 + (ord(c) % 7) * 0.05) for c in letters], "glyph int, advance double")
    return joins.advances(texts, cmap, widths, ["doc_id"], "text", "size").select("doc_id", F.round("width", 4).alias("width"))


@query("""WITH RECURSIVE g(root, glyph, depth) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION ALL SELECT root, (glyph * 3 + 1) % 25, depth + 1 FROM g WHERE depth < 8) SELECT DISTINCT root, glyph FROM g""")
def glyph_closure(t):
    nation = t("nation")
    roots = nation.select(F.col("n_nationkey").alias("root"), F.col("n_nationkey").alias("glyph"))
    parts = nation.select(F.col("n_nationkey").alias("glyph"), ((F.col("n_nationkey") * 3 + 1) % 25).alias("part"))
    return joins.reachable(roots, parts, ["root"], "glyph", "part", 8)


# ---------------------------------------------------------------- folds


def _fold_sql(start: str, step: str, source: str, order: str, part: str) -> str:
    return f"s AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS rn FROM {source}), f AS ({start} UNION ALL {step})"


@query(f"""WITH RECURSIVE {BOXES_SQL}, {_fold_sql("SELECT page, no, rn, top AS anchor, height AS h, 0 AS line_no FROM s WHERE rn = 1",
    "SELECT s.page, s.no, s.rn, CASE WHEN s.top >= f.anchor + 0.6 * f.h THEN s.top ELSE f.anchor END, CASE WHEN s.top >= f.anchor + 0.6 * f.h THEN s.height ELSE greatest(f.h, s.height) END, CASE WHEN s.top >= f.anchor + 0.6 * f.h THEN f.line_no + 1 ELSE f.line_no END FROM f JOIN s ON s.page = f.page AND s.rn = f.rn + 1",
    "boxes", 'top, "left", no', "page")} SELECT page, no, line_no FROM f""")
def line_grouping(t):
    return folds.anchored_lines(boxes(t), ["page"], "no")


@query(f"""WITH RECURSIVE q AS (SELECT DISTINCT l_orderkey AS k, l_quantity AS v FROM lineitem), {_fold_sql("SELECT k, v, rn, v AS anchor, 0 AS cluster_no FROM s WHERE rn = 1",
    "SELECT s.k, s.v, s.rn, CASE WHEN s.v - f.anchor <= 14 THEN f.anchor ELSE s.v END, CASE WHEN s.v - f.anchor <= 14 THEN f.cluster_no ELSE f.cluster_no + 1 END FROM f JOIN s ON s.k = f.k AND s.rn = f.rn + 1",
    "q", "v", "k")} SELECT k, cluster_no, round(avg(v), 6) AS center, count(*) AS n FROM f GROUP BY k, cluster_no""")
def column_cluster(t):
    q = t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("v")).distinct()
    return folds.cluster_by_anchor(q, ["k"], "v").withColumn("center", F.round("center", 6))


@query(f"""WITH RECURSIVE q AS (SELECT user_id AS k, CAST((event_id * 37) % 700 AS DOUBLE) AS v FROM events), {_fold_sql("SELECT k, rn, v AS p, 0 AS pos_no FROM s WHERE rn = 1",
    "SELECT s.k, s.rn, CASE WHEN s.v - f.p > 4 THEN s.v ELSE (f.p + s.v) / 2 END, CASE WHEN s.v - f.p > 4 THEN f.pos_no + 1 ELSE f.pos_no END FROM f JOIN s ON s.k = f.k AND s.rn = f.rn + 1",
    "q", "v", "k")} SELECT k, pos_no, round(arg_max(p, rn), 6) AS pos FROM f GROUP BY k, pos_no""")
def position_cluster(t):
    q = t("events").select(F.col("user_id").alias("k"), (F.col("event_id") * 37 % 700).cast("double").alias("v"))
    return folds.cluster_by_drift(q, ["k"], "v").withColumn("pos", F.round("pos", 6))


@query(f"""WITH RECURSIVE {SEGMENTS_SQL}, h AS (SELECT page, pos, a, b FROM segs WHERE horizontal), {_fold_sql("SELECT page, rn, pos AS p, a AS lo, b AS hi, 0 AS rule_no FROM s WHERE rn = 1",
    "SELECT s.page, s.rn, CASE WHEN abs(f.p - s.pos) <= 2 AND s.a <= f.hi + 2 THEN f.p ELSE s.pos END, CASE WHEN abs(f.p - s.pos) <= 2 AND s.a <= f.hi + 2 THEN least(f.lo, s.a) ELSE s.a END, CASE WHEN abs(f.p - s.pos) <= 2 AND s.a <= f.hi + 2 THEN greatest(f.hi, s.b) ELSE s.b END, CASE WHEN abs(f.p - s.pos) <= 2 AND s.a <= f.hi + 2 THEN f.rule_no ELSE f.rule_no + 1 END FROM f JOIN s ON s.page = f.page AND s.rn = f.rn + 1",
    "h", "pos, a, b", "page")} SELECT page, rule_no, arg_max(p, rn) AS pos, arg_max(lo, rn) AS a, arg_max(hi, rn) AS b FROM f GROUP BY page, rule_no""")
def rule_merge(t):
    return folds.merge_rules(segments(t).where("horizontal"), ["page"])


@query(f"""WITH RECURSIVE {BOXES_SQL}, {_fold_sql("SELECT page, no, rn, 0 AS page_no, CAST(0 AS DOUBLE) AS used, height AS total FROM s WHERE rn = 1",
    "SELECT s.page, s.no, s.rn, CASE WHEN f.total > 0 AND s.height > 60 - f.total THEN f.page_no + 1 ELSE f.page_no END, CASE WHEN f.total > 0 AND s.height > 60 - f.total THEN 0 ELSE f.total END, CASE WHEN f.total > 0 AND s.height > 60 - f.total THEN s.height ELSE f.total + s.height END FROM f JOIN s ON s.page = f.page AND s.rn = f.rn + 1",
    "boxes", "no", "page")} SELECT page AS doc, no, page_no, used FROM f""")
def pager(t):
    out = folds.page_breaks(boxes(t).withColumnRenamed("page", "doc"), ["doc"], ["no"], "height", 60.0)
    return out.withColumnRenamed("page", "page_no")


@query("""WITH RECURSIVE w AS (SELECT item_id AS k, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM benchmark),
    f AS (SELECT k, i, CAST(length(w) AS DOUBLE) AS used, 0 AS line_no FROM w WHERE i = 0 UNION ALL
      SELECT w.k, w.i, CASE WHEN f.used + 1 + length(w.w) <= 40 THEN f.used + 1 + length(w.w) ELSE length(w.w) END, CASE WHEN f.used + 1 + length(w.w) <= 40 THEN f.line_no ELSE f.line_no + 1 END FROM f JOIN w ON w.k = f.k AND w.i = f.i + 1)
    SELECT k, line_no, CAST(min(i) AS INT) AS first, CAST(max(i) AS INT) AS last, max(used) AS width FROM f GROUP BY k, line_no""")
def greedy_wrap(t):
    words = t("benchmark").select(F.col("item_id").alias("k"), F.split("text", " ").alias("w"))
    lines = words.select("k", F.posexplode(folds.wrap_words(F.col("w"), F.transform("w", lambda x: F.length(x).cast("double")), F.lit(1.0), F.lit(40.0))).alias("line_no", "x"))
    return lines.select("k", "line_no", "x.first", "x.last", "x.width")


# ---------------------------------------------------------------- scalar functions


@query("""SELECT doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped FROM (SELECT doc_id, '<a href="' || doc_id || '">' || coalesce(text, '') || ' & co</a>' AS text FROM documents)""")
def xml_escape(t):
    d = t("documents").select("doc_id", F.concat(F.lit('<a href="'), F.col("doc_id").cast("string"), F.lit('">'), F.coalesce("text", F.lit("")), F.lit(" & co</a>")).alias("text"))
    return d.select("doc_id", F.md5(fn.escape_xml(F.col("text"))).alias("escaped"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', chr(39)), '&amp;', '&')) AS plain FROM pages")
def xml_unescape(t):
    return t("pages").select("page_id", F.md5(fn.unescape_xml(F.col("html"))).alias("plain"))


MARKS = "CASE line_no % 5 WHEN 0 THEN '• ' || line WHEN 1 THEN (line_no + 1) || '. ' || line WHEN 2 THEN '-' || line WHEN 3 THEN '1234. ' || line ELSE line END"


@query(f"""WITH {LINES_SQL}, m AS (SELECT doc_id, line_no, {MARKS} AS x FROM l1)
    SELECT doc_id, CAST(line_no AS INT) AS line_no, CASE WHEN b THEN 'Bullet' WHEN n THEN 'Numbered' ELSE 'None' END AS kind, CASE WHEN b OR NOT n THEN 0 ELSE CAST(regexp_extract(x, '^([0-9]{{1,3}})', 1) AS INT) END AS ordinal,
    md5(CASE WHEN b THEN regexp_replace(substr(x, 2), '^[ \\t\\n\\x0B\\f\\r]+', '') WHEN n THEN regexp_replace(x, '^[0-9]{{1,3}}[.)][ \\t\\n\\x0B\\f\\r]+', '') ELSE x END) AS rest
    FROM (SELECT *, regexp_matches(x, '^[•◦▪▬–·*●○■□➢-][ \\t\\n\\x0B\\f\\r]') AS b, regexp_matches(x, '^[0-9]{{1,3}}[.)][ \\t\\n\\x0B\\f\\r]') AS n FROM m)""")
def list_marker_strip(t):
    k, line = F.col("line_no") % 5, F.col("line")
    marked = F.when(k == 0, F.concat(F.lit("• "), line)).when(k == 1, F.concat((F.col("line_no") + 1).cast("string"), F.lit(". "), line)).when(k == 2, F.concat(F.lit("-"), line)).when(k == 3, F.concat(F.lit("1234. "), line)).otherwise(line)
    m = fn.strip_marker(marked)
    return source_lines(t).select("doc_id", "line_no", m["kind"].alias("kind"), m["ordinal"].alias("ordinal"), F.md5(m["rest"]).alias("rest"))


@query("""SELECT event_id, CASE WHEN length(h) = 6 AND h <> '000000' THEN h ELSE '' END AS color FROM (SELECT event_id, upper(regexp_replace(c, '[^0-9A-Fa-f]', '', 'g')) AS h FROM
    (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '#' || lpad(lower(to_hex((event_id * 7919) % 16777216)), 6, '0') WHEN 1 THEN 'auto' WHEN 2 THEN '#000000' ELSE lpad(CAST(event_id AS VARCHAR), 6, '0') END AS c FROM events))""")
def color_normalise(t):
    k = F.col("event_id")
    c = F.when(k % 4 == 0, F.concat(F.lit("#"), F.lpad(F.lower(F.hex(k * 7919 % 16777216)), 6, "0"))).when(k % 4 == 1, "auto").when(k % 4 == 2, "#000000").otherwise(F.lpad(k.cast("string"), 6, "0"))
    return t("events").select("event_id", fn.normal_color(c).alias("color"))


@query("""SELECT event_id, printf('%02X%02X%02X', CAST(round((event_id % 101) * 2.55::DOUBLE) AS INT), CAST(round((event_id * 3 % 101) * 2.55::DOUBLE) AS INT), CAST(round((event_id * 7 % 101) * 2.55::DOUBLE) AS INT)) AS color FROM events""")
def svg_color(t):
    k = F.col("event_id")
    c = F.concat(F.lit("rgb("), (k % 101).cast("string"), F.lit("%, "), (k * 3 % 101).cast("string"), F.lit(".0%, "), (k * 7 % 101).cast("string"), F.lit("%)"))
    return t("events").select("event_id", fn.percent_color(c).alias("color"))


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'DejaVu Sans' WHEN 1 THEN 'Times New Roman' WHEN 2 THEN 'Liberation Serif' WHEN 3 THEN '' WHEN 4 THEN 'Arial' WHEN 5 THEN 'Courier New' WHEN 6 THEN 'Open Sans' ELSE 'Noto Sans' END AS family FROM events""")
def font_family(t):
    names = ["ABCDEF+DejaVuSans-Bold", "TimesNewRomanPSMT", "BAAAAA+LiberationSerif-Italic", "Sans", "ArialMT", "CourierNewPS", "Open Sans,Bold", "noto sans"]
    return t("events").select("event_id", fn.font_family(F.get(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % 8).cast("int"))).alias("family"))


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'Title' WHEN 1 THEN 'Heading1' WHEN 2 THEN 'Heading2' WHEN 3 THEN 'Heading3' WHEN 4 THEN 'Heading2' ELSE 'Normal' END AS style FROM part""")
def style_ids(t):
    ids = ["Title", "Heading_20_1", "heading 2", "HEADING3", "Sub-Title", "Heading4"]
    return t("part").select("p_partkey", fn.style_from_id(F.get(F.array(*[F.lit(n) for n in ids]), F.col("p_size") % 6)).alias("style"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, CASE WHEN abs(v) < 0.0005 THEN '0' ELSE regexp_replace(printf('%.3f', v), '[.]?0+$', '') END AS text FROM (SELECT *, (l_partkey % 4001 - 2000) / 8.0 AS v FROM lineitem)")
def format_numbers(t):
    v = (F.col("l_partkey") % 4001 - 2000) / 8.0
    return t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", fn.format_number(v).alias("text"))


@query("""SELECT event_id, coalesce(TRY_CAST(nullif(regexp_extract(v, '^\\s*([+-]?[0-9]+)', 1), '') AS INT), -1) AS n, CASE WHEN event_id % 6 = 3 THEN 12.5 WHEN event_id % 6 = 5 THEN 7.0 ELSE coalesce(TRY_CAST(nullif(regexp_extract(v, '^\\s*([+-]?[0-9]+)', 1), '') AS DOUBLE), 7.0) END AS x FROM
    (SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id || 'pt' WHEN 1 THEN '  -' || event_id WHEN 2 THEN 'x1' WHEN 3 THEN '12.5em' WHEN 4 THEN '+3' ELSE '' END AS v FROM events)""")
def typed_attributes(t):
    k = F.col("event_id")
    v = F.when(k % 6 == 0, F.concat(k.cast("string"), F.lit("pt"))).when(k % 6 == 1, F.concat(F.lit("  -"), k.cast("string"))).when(k % 6 == 2, "x1").when(k % 6 == 3, "12.5em").when(k % 6 == 4, "+3").otherwise("")
    return t("events").select("event_id", fn.int_attr(v, -1).alias("n"), fn.float_attr(v, 7.0).alias("x"))


@query("""SELECT event_id, CASE WHEN b AND i THEN 'BoldItalic' WHEN b THEN 'Bold' WHEN i THEN 'Italic' ELSE 'Regular' END AS face, CASE WHEN event_id % 3 = 0 THEN greatest(event_id % 5, 1) || '.' ELSE list_extract(['•', '◦', '▪'], least(CAST(event_id % 4 AS INT), 2) + 1) END AS bullet
    FROM (SELECT event_id, event_id % 2 = 0 AS b, event_id % 5 < 2 AS i FROM events)""")
def faces_and_bullets(t):
    k = F.col("event_id")
    bullet = fn.bullet_for(F.when(k % 3 == 0, "Numbered").otherwise("Bullet"), (k % 4).cast("int"), (k % 5).cast("int"))
    return t("events").select("event_id", fn.face_for(k % 2 == 0, k % 5 < 2).alias("face"), bullet.alias("bullet"))


@query("""WITH b AS (SELECT event_id, CAST(event_id % 1500 + 1 AS DOUBLE) * 0.75 AS w, CAST(event_id % 900 + 1 AS DOUBLE) * 0.75 AS h FROM events), s AS (SELECT event_id, CASE WHEN w > 468 THEN 468.0 ELSE w END AS w, CASE WHEN w > 468 THEN h * (468.0 / w) ELSE h END AS h FROM b)
    SELECT event_id, round(w, 6) AS w, round(h, 6) AS h, CAST(trunc(round(w, 6) * 12700) AS BIGINT) AS emu FROM s""")
def image_sizes(t):
    k = F.col("event_id")
    size = fn.display_size((k % 1500 + 1).cast("double"), (k % 900 + 1).cast("double"), F.lit(0.0), F.lit(0.0), 468.0)
    e = t("events").select("event_id", F.round(size["w"], 6).alias("w"), F.round(size["h"], 6).alias("h"))
    return e.withColumn("emu", fn.points_to_emu(F.col("w")))


#: Elements of web pages that have no content.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def page_nodes(t) -> DataFrame:
    return xml.node_rows(t("pages"), "html", ["page_id"], VOID, lenient=True)


PLAIN = "replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', chr(39)), '&amp;', '&')"


@query(f"""SELECT page_id, trim({PLAIN.format("regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)")}) AS title FROM pages""")
def html_title(t):
    nodes = page_nodes(t)
    first = nodes.where("tag = 'title'").groupBy("page_id").agg(F.min("node_id").alias("parent_id"))
    text = nodes.where("tag = ''").join(first, ["page_id", "parent_id"]).groupBy("page_id").agg(F.min_by("text", "node_id").alias("title"))
    return t("pages").select("page_id").join(text, "page_id", "left").select("page_id", F.trim(F.coalesce("title", F.lit(""))).alias("title"))


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<p[ >]')) AS BIGINT) AS paragraphs, CAST(len(regexp_extract_all(html, '(?i)<li[ >]')) AS BIGINT) AS items, CAST(len(regexp_extract_all(html, '(?i)<b[ >]')) AS BIGINT) AS bolds FROM pages WHERE html <> ''""")
def html_counts(t):
    count = lambda tag: F.count(F.when(F.col("tag") == tag, 1))
    return page_nodes(t).groupBy("page_id").agg(count("p").alias("paragraphs"), count("li").alias("items"), count("b").alias("bolds"))


@query(f"""SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)[^<>]*>', 1))) AS tag FROM pages) GROUP BY ALL""")
def html_nodes(t):
    """How many elements of each kind a page has."""
    return page_nodes(t).where("tag <> ''").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+$', '')) AS text_md5 FROM documents WHERE regexp_matches(text, '[^ \t\n\x0B\f\r]')""")
def docx_roundtrip(t):
    """Documents to packages and back: a paragraph for each line, blank ones at the end go."""
    line = F.struct(F.col("line").alias("text"), F.lit(False).alias("bold"), (F.col("line_no") % 7 == 0).alias("italic"), F.lit("").alias("color"), F.lit("").alias("font"))
    d = t("documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    fixed = {"part": "body", "kind": "paragraph", "style": "Normal", "alignment": "Default"}
    blocks = d.select(
        "doc_id", F.array("line_no").alias("path"), *[F.lit(v).alias(k) for k, v in fixed.items()], F.array(line).alias("runs"), F.struct(F.lit("None").alias("kind"), F.lit(0).alias("level"), F.lit(0).alias("num_id")).alias("list"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(ooxml.BLOCK) if f.name in ("widths", "cells", "image")],
    )
    back = ooxml.blocks(docx.packages(blocks)).where("error IS NULL AND part = 'body'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", fn.run_text(F.col("runs")).alias("text")))), lambda x: x["text"]), "\n")
    whole = back.groupBy("doc_id").agg(text.alias("text")).where(~fn.blank("text"))
    return whole.select("doc_id", F.md5(F.regexp_replace("text", "[ \\t\\n\\x0B\\f\\r]+$", "")).alias("text_md5"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 2 THEN 0 ELSE CAST(event_id % 4000 + 1 AS INT) END AS px_w, CASE event_id % 3 WHEN 2 THEN 0 ELSE CAST(event_id % 3000 + 1 AS INT) END AS px_h FROM events""")
def picture_sizes(t):
    """Pixel sizes from the headers of pictures: PNG, JPEG, and what is neither."""
    k = F.col("event_id")
    word = lambda c, n: F.lpad(F.hex(c), n, "0")
    w, h = k % 4000 + 1, k % 3000 + 1
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), word(w, 8), word(h, 8), F.lit("0806000000" + "00000000" + "0000000149444154" + "00" + "00000000"))
    jpeg = F.concat(F.lit("FFD8FFE00004" + "0000" + "FFC0001108"), word(h, 4), word(w, 4), F.lit("03012200021101031101FFD9"))
    data = F.unhex(F.when(k % 3 == 0, png).when(k % 3 == 1, jpeg).otherwise(F.concat(F.lit("0000"), png)))
    return images.probed(t("events").select("event_id", data.alias("content")), "content", ["event_id"])


@query("""SELECT event_id, 'DeviceGray' AS space, 2 AS px_w, 1 AS px_h, printf('%02X%02X', CAST(event_id % 256 AS INT), CAST(event_id * 7 % 256 AS INT)) AS pixels FROM events WHERE event_id % 4 <> 3""")
def png_pixels(t):
    """Samples of small grey PNG files, whose data are one stored block; every fourth file is cut and gives none."""
    k = F.col("event_id")
    p, q = k % 256, k * 7 % 256
    word = lambda c, n: F.lpad(F.hex(c), n, "0")
    block = F.concat(F.lit("7801" + "01" + "0300" + "FCFF" + "00"), word(p, 2), word(q, 2), word(3 + 2 * p + q, 4), word(1 + p + q, 4))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452" + "00000002" + "00000001" + "0800000000" + "00000000" + "0000000E49444154"), block, F.lit("00000000" + "0000000049454E4400000000"))
    files = t("events").select("event_id", F.unhex(F.when(k % 4 == 3, F.substring(png, 1, 90)).otherwise(png)).alias("content"))
    return images.decoded(files, "content", ["event_id"]).where("space IS NOT NULL").select("event_id", "space", "px_w", "px_h", F.hex("pixels").alias("pixels"))


@query("""SELECT event_id, event_id % 3 = 0 AS horizontal, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 1 THEN 800 - y ELSE y END ELSE x END AS pos,
    CASE WHEN event_id % 3 = 0 THEN x WHEN event_id % 2 = 1 THEN 800 - y - 20 ELSE y END AS a, CASE WHEN event_id % 3 = 0 THEN x + 10 WHEN event_id % 2 = 1 THEN 800 - y ELSE y + 20 END AS b, '00' || printf('%02X', CAST(round(50 * 2.55::DOUBLE) AS INT)) || 'FF' AS color
    FROM (SELECT event_id, CAST(event_id % 500 AS DOUBLE) AS x, CAST(event_id % 700 AS DOUBLE) AS y FROM events) WHERE event_id % 3 < 2""")
def svg_rules(t):
    """Straight strokes of drawings, upward or downward; diagonal ones are none."""
    k = F.col("event_id")
    x, y = k % 500, k % 700
    to_x, to_y = x + F.when(k % 3 == 1, 0).otherwise(10), y + F.when(k % 3 == 0, 0).otherwise(20)
    d = F.concat_ws(" ", F.lit("M"), x, y, F.lit("L"), to_x, to_y)
    turned = F.when(k % 2 == 1, ' transform="matrix(1,0,0,-1,0,800)"').otherwise("")
    svg = F.concat(F.lit('<svg><defs><path d="M 0 0 L 9 0" stroke="rgb(1%,1%,1%)"/></defs><path fill="none" stroke="rgb(0%, 50%, 100%)" d="'), d, F.lit('"'), turned, F.lit("/></svg>"))
    drawn = layout.vectors(t("events").select("event_id", svg.alias("svg"), F.lit(800.0).alias("h")), "svg", "h", ["event_id"])
    return layout.rules(drawn, ["event_id"]).drop("seg_no")


@query("""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS frag_no, CASE turn % 3 WHEN 0 THEN 12.0 WHEN 1 THEN 18.5 ELSE 11.0 END AS size, CASE turn % 3 WHEN 0 THEN 'C0392B' ELSE '' END AS color,
    CASE turn % 3 WHEN 0 THEN 'Times New Roman' ELSE '' END AS family, CAST(turn * 20 AS DOUBLE) AS top, md5(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS text_md5 FROM conversations WHERE regexp_matches(text, '[^ \t\n\x0B\f\r]')""")
def layout_fragments(t):
    """Positioned text of layout dumps with the fonts of its page: a conversation is a page, a turn a fragment."""
    c = t("conversations").where(~fn.blank("text"))
    number = lambda x: x.cast("string")
    text = F.concat(F.lit('<text left="50" width="100" height="12" top="'), number(F.col("turn") * 20), F.lit('" font="'), number(F.col("turn") % 3), F.lit('">'), fn.escape_xml(F.col("text")), F.lit("</text>"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", text.alias("x")))), lambda s: s["x"]), "")
    fonts = '<pdf2xml><page width="595" height="842"><fontspec id="0" size="12" family="TimesNewRomanPSMT" color="#c0392b"/><fontspec id="1" size="18.5" family="sans" color="#000000"/>'
    dumps = c.groupBy("conv_id").agg(F.concat(F.lit(fonts), lines, F.lit("</page></pdf2xml>")).alias("xml"))
    found = layout.fragments(layout.pages(dumps, "xml", "conv_id"), "conv_id")
    return found.select("conv_id", "frag_no", "size", "color", "family", "top", F.md5("text").alias("text_md5"))


#: Grids of rules: page p has p % 3 + 2 rows of 20 points and p % 4 + 2 columns of 50; where p is even, the first two cells of the top row are one.
@query("""WITH p AS (SELECT DISTINCT event_id // 40 AS page FROM events), g AS (SELECT page, unnest(range(0, page % 3 + 2)) AS r, page % 4 + 2 AS cols FROM p), c AS (SELECT page, r, unnest(range(0, cols)) AS c FROM g)
    SELECT page, CAST(r AS INT) AS r, CAST(c AS INT) AS c, 1 AS row_span, CASE WHEN page % 2 = 0 AND r = 0 AND c = 0 THEN 2 ELSE 1 END AS col_span, CAST(c * 50 AS DOUBLE) AS "left", CAST(r * 20 AS DOUBLE) AS top
    FROM c WHERE NOT (page % 2 = 0 AND r = 0 AND c = 1)""")
def grid_cells(t):
    pages = t("events").select(F.expr("event_id DIV 40").alias("page")).distinct()
    rows, cols = F.col("page") % 3 + 2, F.col("page") % 4 + 2
    across = pages.select("page", F.explode(F.sequence(F.lit(0).cast("long"), rows)).alias("k"), F.lit(True).alias("horizontal"), F.lit(0.0).alias("a"), (cols * 50).cast("double").alias("b"), F.lit(20.0).alias("step"))
    short = F.when((F.col("page") % 2 == 0) & (F.col("k") == 1), 20.0).otherwise(0.0)
    down = pages.select("page", F.explode(F.sequence(F.lit(0).cast("long"), cols)).alias("k"), F.lit(False).alias("horizontal"), (rows * 20).cast("double").alias("b")).withColumns({"a": short, "step": F.lit(50.0)})
    rules = across.unionByName(down).select("page", F.lit(0).cast("long").alias("component"), "horizontal", (F.col("k") * F.col("step")).alias("pos"), "a", "b")
    return folds.ruled_grids(rules, ["page"]).select("page", "r", "c", "row_span", "col_span", "left", "top")


@query("""SELECT p_partkey, m[1] AS size, m[2] = 1 AS bold, m[3] AS leading, CASE WHEN style IN ('Title', 'Heading1', 'Heading2', 'Heading3') THEN style ELSE '' END AS style_id,
    CASE p_size % 5 WHEN 0 THEN 'center' WHEN 1 THEN 'right' WHEN 2 THEN 'both' WHEN 3 THEN 'left' ELSE '' END AS jc, CAST(trunc(p_size * 0.75 * 20) AS BIGINT) AS twips
    FROM (SELECT *, CASE style WHEN 'Title' THEN [24.0, 1, 1.25] WHEN 'Heading1' THEN [18.0, 1, 1.28] WHEN 'Heading2' THEN [15.0, 1, 1.30] WHEN 'Heading3' THEN [13.0, 1, 1.32] ELSE [11.0, 0, 1.42] END::DOUBLE[] AS m
    FROM (SELECT p_partkey, p_size, list_extract(['Title', 'Heading1', 'Heading2', 'Heading3', 'Normal'], CAST(p_partkey % 5 + 1 AS INT)) AS style FROM part))""")
def paragraph_attributes(t):
    """What a paragraph's style and alignment come to."""
    pick = lambda k, *values: F.get(F.array(*[F.lit(v) for v in values]), k.cast("int"))
    style = pick(F.col("p_partkey") % 5, "Title", "Heading1", "Heading2", "Heading3", "Normal")
    m = fn.style_metrics(style)
    jc = fn.alignment_value(pick(F.col("p_size") % 5, "Center", "Right", "Justify", "Left", "Default"))
    return t("part").select("p_partkey", m["size"].alias("size"), m["bold"].alias("bold"), m["leading"].alias("leading"), fn.style_id(style).alias("style_id"), jc.alias("jc"), fn.points_to_twips(F.col("p_size") * 0.75).alias("twips"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'word/media/image' || event_id || '.png' WHEN 1 THEN 'media/a' || event_id || '.jpeg' ELSE 'word/x.gif' END AS part,
    CASE event_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'gif' ELSE '' END AS extension, printf('%04X', CAST(event_id % 65536 AS INT)) AS code, 'DejaVuSans-' || event_id || '+x' AS font, 'a.b/doc' || event_id || '.pdf' AS output FROM events""")
def part_names(t):
    """Names inside packages and files."""
    k, n = F.col("event_id"), F.col("event_id").cast("string")
    target = F.when(k % 3 == 0, F.concat(F.lit("media/image"), n, F.lit(".png"))).when(k % 3 == 1, F.concat(F.lit("../media/a"), n, F.lit(".jpeg"))).otherwise("/word/x.gif")
    mime = F.get(F.array(F.lit("image/png"), F.lit("image/jpeg"), F.lit("image/gif"), F.lit("image/tiff")), (k % 4).cast("int"))
    return t("events").select(
        "event_id", fn.part_path(target).alias("part"), fn.extension_for(mime).alias("extension"), fn.hex4(k % 65536).alias("code"), fn.pdf_name(F.concat(F.lit("Déja Vu/Sans-"), n, F.lit("+x"))).alias("font0"),
        fn.swap_extension(F.concat(F.lit("a.b/doc"), n, F.lit(".docx")), ".pdf").alias("output"),
    ).withColumn("font", F.replace("font0", F.lit("Dja"), F.lit("Deja"))).drop("font0")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'x' || event_id WHEN 1 THEN chr(9) WHEN 2 THEN ' ' WHEN 3 THEN '-' END AS content, event_id % 5 NOT IN (1, 2, 3) AS flag, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE round((event_id % 256) / 255.0::DOUBLE, 9) END AS green FROM events""")
def run_contents(t):
    """What elements of a run, on/off attributes and colours stand for."""
    k = F.col("event_id")
    pick = lambda c, *values: F.get(F.array(*[F.lit(v) for v in values]), c.cast("int"))
    tag = pick(k % 6, "w:t", "w:tab", "w:br", "w:noBreakHyphen", "w:drawing", "w:rPr")
    color = F.when(k % 7 == 0, "12345").otherwise(F.concat(F.lit("10"), F.lpad(F.hex(k % 256), 2, "0"), F.lit("FF")))
    flag = fn.flag_on(pick(k % 5, None, "0", "false", "off", "1"))
    return t("events").select("event_id", fn.content_text(tag, F.concat(F.lit("x"), k.cast("string"))).alias("content"), flag.alias("flag"), F.round(fn.hex_component(color, 1), 9).alias("green"))


@query(f"""WITH {LINES_SQL}, m AS (SELECT doc_id, line_no, line, line_no % 3 AS k FROM l1)
    SELECT doc_id, CAST(line_no AS INT) AS line_no, CASE k WHEN 0 THEN 'Bullet' WHEN 1 THEN 'Numbered' ELSE 'None' END AS kind, CASE k WHEN 1 THEN CAST(line_no % 900 + 1 AS INT) ELSE 0 END AS ordinal,
    md5(CASE k WHEN 0 THEN regexp_replace(line, '^[ \t\n\x0B\f\r]+', '') WHEN 1 THEN 'x' || line ELSE 'x. ' || line END) AS rest FROM m""")
def run_marker_strip(t):
    """List markers of paragraphs in runs: a bullet in a run of its own, a number before text, and neither."""
    k, line = F.col("line_no") % 3, F.col("line")
    run = lambda text, bold: F.struct(text.alias("text"), F.lit(bold).alias("bold"))
    lone = F.array(run(F.lit(" • "), True), run(F.concat(F.lit("  "), line), False))
    number = F.array(run(F.concat((F.col("line_no") % 900 + 1).cast("string"), F.lit(") x")), True), run(line, False))
    m = fn.strip_run_marker(F.when(k == 0, lone).when(k == 1, number).otherwise(F.array(run(F.lit("x. "), False), run(line, False))))
    return source_lines(t).select("doc_id", "line_no", m["kind"].alias("kind"), m["ordinal"].alias("ordinal"), F.md5(fn.run_text(m["runs"])).alias("rest"))


@query(f"""WITH RECURSIVE {LINES_SQL}, a AS (SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 THEN line || '-' ELSE line END AS line FROM l1),
    f AS (SELECT doc_id, line_no, line AS s FROM a WHERE line_no = 0 UNION ALL SELECT a.doc_id, a.line_no, CASE WHEN f.s = '' THEN a.line WHEN strlen(f.s) > 1 AND f.s LIKE '%-' THEN f.s || a.line ELSE f.s || ' ' || a.line END FROM f JOIN a ON a.doc_id = f.doc_id AND a.line_no = f.line_no + 1)
    SELECT doc_id, md5(arg_max(s, line_no)) AS joined FROM f GROUP BY doc_id""")
def join_lines(t):
    hyphen = F.when(F.col("line_no") % 3 == 0, F.concat("line", F.lit("-"))).otherwise(F.col("line"))
    lines = source_lines(t).select("doc_id", F.struct("line_no", hyphen.alias("line")).alias("x"))
    return lines.groupBy("doc_id").agg(F.md5(fn.join_lines(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]))).alias("joined"))
