"""Line deduplication over a suffix array of line IDs.

Lines that occur once end every repeated run, so only the others get IDs. Prefix doubling ranks the runs of 1, 2, 4, ... lines at
every position: pairs of ranks are counted, sorted over range partitions and numbered, and pairs that occur once drop out. Equal
ranks at depth h are an interval of the suffix array whose longest common prefix is h lines or more; a run of any k lines is named by
two overlapping ranks of the depth below k. A repeated run of enough words is found by its least windows: the shortest run of
enough words from each line on, and the shortest up to each line. Windows seen earlier in the corpus cover just the later
copies of all maximal repeated runs of enough words, and these lines go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_table, materialize, session

#: Words that a repeated run needs for its later copies to go.
MIN_WORDS = 50
#: Bits of a line's number inside its document; more where a document has more lines.
LINE_BITS = 24


def numbered(df: DataFrame, order: list[str], to: str, tag: str) -> DataFrame:
    """Adds each row's place in the order over the whole frame, by range partitions and the counts of those before; written."""
    spark = session(df)
    schema = T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])

    def run(batches):
        part, done = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(done, done + b.num_rows))], names=[*b.schema.names, "part", "place"])
            done += b.num_rows

    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), tag)
    before, total = [], 0
    for r in sorted(placed.groupBy("part").count().collect()):  # a row for each partition
        before.append((r["part"], total))
        total += r["count"]
    starts = spark.createDataFrame(before, "part int, before long")
    return placed.join(F.broadcast(starts), "part").select(*df.columns, (F.col("before") + F.col("place")).alias(to))


def _row_key(text: str, id_col: str) -> list[Column]:
    """A row's 128-bit key from its id and text."""
    parts = (F.col(id_col).cast("string"), F.coalesce(F.col(text), F.lit("")))
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit("other"), *parts).alias("k2")]


class _Runs:
    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        self.made.append(out := materialize(df, f"lines-{tag}"))
        return out

    def close(self) -> None:
        for table in self.made:
            drop_table(table)


def repeated_lines(docs: DataFrame, text: str, id_col: str, min_words: int) -> DataFrame:
    """k1, k2 (a row's key) and dead (numbers from 0 of the lines that are later copies, in order), for the rows that have such lines."""
    t = _Runs()
    lines = docs.where(F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("id"), *_row_key(text, id_col), F.posexplode(F.split(text, "\n")).alias("line", "s"))
    lines = lines.select("id", "k1", "k2", "line", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit("other"), "s").alias("h2"), F.regexp_count("s", F.lit(r"[^\x20\x09-\x0D]++")).alias("w"))
    lines = t.keep(lines, "all")
    often = t.keep(lines.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"), "often")
    common = t.keep(lines.join(often, ["h1", "h2"]).dropDuplicates(["k1", "k2", "line"]), "common")
    rows = numbered(common.select("id", "k1", "k2").distinct(), ["id", "k1", "k2"], "row", "lines-rows")
    rows = t.keep(rows.select("row", "k1", "k2"), "rows")
    bits = max(LINE_BITS, int(common.agg(F.max("line")).first()[0] or 0).bit_length() + 1)  # a line after the last stays in its row
    pos = F.shiftleft(F.col("row"), bits) + F.col("line")
    common = t.keep(common.join(rows, ["k1", "k2"]).select(pos.alias("pos"), "row", "line", "w", "h1", "h2"), "pos")

    # windows: from and to the lines of each unbroken stretch
    order = Window.partitionBy("row").orderBy("line")
    flat = common.select("pos", "row", "line", "w").withColumn("stretch", F.col("line") - F.row_number().over(order))
    own = Window.partitionBy("row", "stretch")
    upto = F.sum("w").over(own.orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    flat = flat.withColumn("upto", upto).withColumn("ahead", F.col("upto") - F.col("w")).withColumn("all", F.max("upto").over(own))
    stop = F.max("line").over(own.orderBy("ahead").rangeBetween(0, min_words - 1))
    start = F.min("line").over(own.orderBy("upto").rangeBetween(1 - min_words, 0))
    flat = flat.withColumn("stop", F.when(F.col("all") - F.col("ahead") >= min_words, stop)).withColumn("start", F.when(F.col("upto") >= min_words, start))
    both = flat.select(F.explode(F.array(F.struct(F.col("pos").alias("p"), (F.col("stop") - F.col("line") + 1).alias("k")), F.struct((F.col("pos") - F.col("line") + F.col("start")).alias("p"), (F.col("line") - F.col("start") + 1).alias("k")))).alias("x"))
    windows = t.keep(both.select("x.p", "x.k").where("k IS NOT NULL").distinct(), "windows")
    longest = windows.agg(F.max("k")).first()[0] or 0

    # prefix doubling: ranks at depths 1, 2, 4, ...
    level, depth, pairs = 0, 1, common.select("pos", F.col("h1").alias("a"), F.col("h2").alias("b"))
    ranks: list[DataFrame] = []
    while depth <= longest:
        found = t.keep(pairs, "pairs") if level else pairs
        counted = found.groupBy("a", "b").count().where("count > 1").select("a", "b")
        named = t.keep(numbered(counted, ["a", "b"], "rank", "lines-sorted"), "ranked")
        ranks.append(t.keep(found.join(named, ["a", "b"]).select("pos", "rank"), "depth"))
        after = ranks[-1].select((F.col("pos") - depth).alias("pos"), F.col("rank").alias("b"))
        pairs = ranks[-1].select("pos", F.col("rank").alias("a")).join(after, "pos")
        level, depth = level + 1, depth * 2

    copies = None
    for j, r in enumerate(ranks):  # windows of 2**j to 2**(j + 1) - 1 lines
        mine = windows.where((F.col("k") >= 1 << j) & (F.col("k") < 2 << j))
        left = r.select(F.col("pos").alias("p"), F.col("rank").alias("a"))
        right = r.select(F.col("pos").alias("q"), F.col("rank").alias("b"))
        part = mine.join(left, "p").withColumn("q", F.col("p") + F.col("k") - (1 << j)).join(right, "q").select("p", "k", "a", "b")
        copies = part if copies is None else copies.union(part)
    if copies is None:
        out = materialize(rows.select("k1", "k2", F.array().cast("array<int>").alias("dead")).where("false"), "lines-dead")
        t.close()
        return out
    copies = t.keep(copies, "copies")
    first = t.keep(copies.groupBy("k", "a", "b").agg(F.min("p").alias("first")), "first")
    later = copies.join(first, ["k", "a", "b"]).where("p > first").groupBy("p").agg(F.max("k").alias("k"))
    reach = F.max(F.col("pos") + F.col("k")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    covered = common.select("pos", "row", "line").join(later.withColumnRenamed("p", "pos"), "pos", "left").withColumn("reach", reach).where("reach > pos")
    dead = covered.groupBy("row").agg(F.array_sort(F.collect_list("line")).alias("dead")).join(rows, "row").select("k1", "k2", "dead")
    dead = materialize(dead, "lines-dead")
    t.close()
    return dead


def dedup_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS, to: str = "dead_lines") -> DataFrame:
    """Deletes the later copies of repeated line runs of at least min_words words, over the whole table.

    Lines lie between "\\n"; a run is consecutive lines of one document; a copy is later if it begins further on in the order of
    ids (null first), rows of one id in a fixed order of their texts, and lines. A run may overlap its own copy: of a line
    repeated on and on the first stays. Returns the columns of docs with the remaining lines as text, and `to`: the numbers
    from 0 of the deleted lines (empty if none). No row is dropped, and null texts stay null. Rows equal in id and text count as one
    document and are cut alike. A column named like `to` is replaced.
    """
    session(docs)
    dead = repeated_lines(docs, text, id_col, min_words).select(F.col("k1").alias("join k1"), F.col("k2").alias("join k2"), F.col("dead").alias("join dead"))
    k1, k2 = _row_key(text, id_col)
    dead = dead.hint("merge")  # it grows with the table: never broadcast, and the plan is the same at every size
    names = [c for c in docs.columns if c != to]
    joined = docs.select(*names, k1.alias("row k1"), k2.alias("row k2")).join(dead, (F.col("row k1") == F.col("join k1")) & (F.col("row k2") == F.col("join k2")), "left")
    gone = F.col("join dead")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda s, i: ~F.array_contains(gone, i)), "\n")
    return joined.select(*[F.when(gone.isNull(), F.col(c)).otherwise(left).alias(c) if c == text else F.col(c) for c in names], F.coalesce(gone, F.array().cast("array<int>")).alias(to))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines of every document, those deleted, and the text that is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # the lines of the whole text are those left and those deleted; a text without any line left is empty, as one empty line is
    out = dedup_lines(docs)
    gone = F.size("dead_lines").cast("long")
    left = F.when(F.col("text").isNull(), 0).when((F.col("text") == "") & (gone > 0), 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1)
    return out.select("doc_id", left.cast("long").alias("n_left"), gone.alias("n_deleted"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def oracle(min_words: int = MIN_WORDS) -> str:
    """DuckDB SQL for op9_line_dedup: every pair of equal lines, maximal runs along the diagonals of pairs, their later lines."""
    return f"""
    WITH d AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN CAST([] AS VARCHAR[]) ELSE string_split(text, chr(10)) END AS s FROM documents),
    l AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) - 1 AS n FROM d),
    w AS (SELECT *, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS words FROM l),
    p AS (SELECT a.doc_id AS da, b.doc_id AS db, b.n AS n, b.n - a.n AS diagonal, b.words AS words
          FROM w a JOIN w b ON a.x = b.x AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.n < b.n)),
    i AS (SELECT *, n - row_number() OVER (PARTITION BY da, db, diagonal ORDER BY n) AS island FROM p),
    r AS (SELECT db, n, sum(words) OVER (PARTITION BY da, db, diagonal, island) AS total FROM i),
    dead AS (SELECT DISTINCT db AS doc_id, n FROM r WHERE total >= {min_words}),
    k AS (SELECT l.doc_id, l.n, l.x, dead.n IS NOT NULL AS gone FROM l LEFT JOIN dead ON l.doc_id = dead.doc_id AND l.n = dead.n),
    g AS (SELECT doc_id, count(*) FILTER (NOT gone) AS n_left, count(*) FILTER (gone) AS n_deleted, string_agg(x, chr(10) ORDER BY n) FILTER (NOT gone) AS t FROM k GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(CASE WHEN coalesce(t, '') = '' AND n_deleted > 0 THEN 0 ELSE n_left END, 0) AS BIGINT) AS n_left,
      CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted, md5(coalesce(t, '')) AS text_md5
    FROM d LEFT JOIN g USING (doc_id)"""
