"""Steps that compare a row with an anchor or a running value of its group: folds over a page's sorted rows, in the JVM.

A page's rows are bounded by the page. Steps over a page's graph of rules use Arrow: groups for what meets, batches of grids for cells.
"""

from __future__ import annotations

import bisect
import itertools

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sorted(df: DataFrame, part: list[str], *columns) -> DataFrame:
    return df.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))


def anchored_lines(fragments: DataFrame, part: list[str], key: str, top: str = "top", height: str = "height") -> DataFrame:
    """Fragments in order of (top, left, key) to lines: a new line where the top is 0.6 of the line's height so far below its first fragment's top.

    Returns part, key, line_no. The order is total, where tops that differ by a point at most would count as equal otherwise.
    """
    rows = _sorted(fragments, part, F.col(top).cast("double").alias("top"), F.col("left").cast("double").alias("left"), F.col(key).alias("key"), F.col(height).cast("double").alias("height"))
    start = "named_struct('no', -1, 'top', 0D, 'height', 0D, 'out', CAST(array() AS array<struct<key:bigint,no:int>>))"
    step = """(s, r) -> CASE WHEN s.no < 0 OR r.top >= s.top + 0.6D * s.height
        THEN named_struct('no', s.no + 1, 'top', r.top, 'height', r.height, 'out', concat(s.out, array(named_struct('key', CAST(r.key AS BIGINT), 'no', s.no + 1))))
        ELSE named_struct('no', s.no, 'top', s.top, 'height', greatest(s.height, r.height), 'out', concat(s.out, array(named_struct('key', CAST(r.key AS BIGINT), 'no', s.no)))) END"""
    return rows.select(*part, F.explode(F.expr(f"aggregate(rows, {start}, {step}, s -> s.out)")).alias("x")).select(*part, F.col("x.key").alias(key), F.col("x.no").alias("line_no"))


def cluster_by_anchor(df: DataFrame, part: list[str], value: str, tolerance: float = 14.0) -> DataFrame:
    """Sorted values to clusters that reach up to the tolerance from their first: part, cluster_no, center (mean), n."""
    rows = df.groupBy(*part).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("rows"))
    start = "named_struct('first', CAST(NULL AS DOUBLE), 'sum', 0D, 'n', 0L, 'out', CAST(array() AS array<struct<sum:double,n:bigint>>))"
    closed = "CASE WHEN s.n = 0 THEN s.out ELSE concat(s.out, array(named_struct('sum', s.sum, 'n', s.n))) END"
    step = f"""(s, v) -> CASE WHEN s.first IS NOT NULL AND v - s.first <= {tolerance}D
        THEN named_struct('first', s.first, 'sum', s.sum + v, 'n', s.n + 1, 'out', s.out)
        ELSE named_struct('first', v, 'sum', v, 'n', 1L, 'out', {closed}) END"""
    folded = rows.select(*part, F.posexplode(F.expr(f"aggregate(rows, {start}, {step}, s -> {closed})")).alias("cluster_no", "x"))
    return folded.select(*part, "cluster_no", (F.col("x.sum") / F.col("x.n")).alias("center"), F.col("x.n").alias("n"))


def cluster_by_drift(df: DataFrame, part: list[str], value: str, tolerance: float = 4.0) -> DataFrame:
    """Sorted positions to positions: each within the tolerance of the last moves it half way to itself. Returns part, pos_no, pos."""
    rows = df.groupBy(*part).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("rows"))
    step = f"""(s, v) -> CASE WHEN size(s) = 0 OR v - s[size(s) - 1] > {tolerance}D THEN concat(s, array(v))
        ELSE concat(slice(s, 1, size(s) - 1), array((s[size(s) - 1] + v) / 2)) END"""
    return rows.select(*part, F.posexplode(F.expr(f"aggregate(rows, CAST(array() AS array<double>), {step})")).alias("pos_no", "pos"))


def merge_rules(df: DataFrame, part: list[str], tolerance: float = 2.0) -> DataFrame:
    """Segments (pos, a, b) in order to rules: one that lies within the tolerance of the last and begins before its end widens it. Returns part, rule_no, pos, a, b."""
    rows = _sorted(df, part, *[F.col(c).cast("double").alias(c) for c in ("pos", "a", "b")])
    last = "s[size(s) - 1]"
    step = f"""(s, r) -> CASE WHEN size(s) > 0 AND abs({last}.pos - r.pos) <= {tolerance}D AND r.a <= {last}.b + {tolerance}D
        THEN concat(slice(s, 1, size(s) - 1), array(named_struct('pos', {last}.pos, 'a', least({last}.a, r.a), 'b', greatest({last}.b, r.b))))
        ELSE concat(s, array(r)) END"""
    folded = F.expr(f"aggregate(rows, CAST(array() AS array<struct<pos:double,a:double,b:double>>), {step})")
    return rows.select(*part, F.posexplode(folded).alias("rule_no", "x")).select(*part, "rule_no", "x.pos", "x.a", "x.b")


def page_breaks(df: DataFrame, part: list[str], order: list[str], height: str, room: float) -> DataFrame:
    """Blocks to pages of so much room: a new page where a block doesn't fit and the page isn't empty. Returns part, order, page, used (before the block)."""
    rows = _sorted(df, part, *order, F.col(height).cast("double").alias("block height"))
    kind = df.select(*order).schema
    fields = ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in kind)
    out = f"array<struct<{fields},page:int,used:double>>"
    put = lambda page, used: "named_struct(" + ", ".join(f"'{f.name}', r.`{f.name}`" for f in kind) + f", 'page', {page}, 'used', {used})"
    step = f"""(s, r) -> CASE WHEN s.used > 0D AND r.`block height` > {room}D - s.used
        THEN named_struct('page', s.page + 1, 'used', r.`block height`, 'out', concat(s.out, array({put('s.page + 1', '0D')})))
        ELSE named_struct('page', s.page, 'used', s.used + r.`block height`, 'out', concat(s.out, array({put('s.page', 's.used')}))) END"""
    folded = F.expr(f"aggregate(rows, named_struct('page', 0, 'used', 0D, 'out', CAST(array() AS {out})), {step}, s -> s.out)")
    return rows.select(*part, F.explode(folded).alias("x")).select(*part, *[F.col(f"x.{c}").alias(c) for c in order], "x.page", "x.used")


def wrap_words(words: Column, widths: Column, space: Column, width: Column) -> Column:
    """Lines of words that fit a width, greedily: array of struct<first, last, width>, word numbers from 0. A word wider than the line stands alone."""
    zipped = F.zip_with(words, widths, lambda w, x: F.struct(x.cast("double").alias("w")))
    start = F.struct(F.lit(-1).alias("i"), F.array().cast("array<struct<first:int,last:int,width:double>>").alias("out"))

    def step(s, r):
        i = s["i"] + 1
        last = F.get(s["out"], F.size(s["out"]) - 1)
        fits = (F.size(s["out"]) > 0) & (last["width"] + space + r["w"] <= width)
        grown = F.concat(F.slice(s["out"], 1, F.greatest(F.size(s["out"]) - 1, F.lit(0))), F.array(F.struct(last["first"].alias("first"), i.alias("last"), (last["width"] + space + r["w"]).alias("width"))))
        fresh = F.concat(s["out"], F.array(F.struct(i.alias("first"), i.alias("last"), r["w"].alias("width"))))
        return F.struct(i.alias("i"), F.when(F.coalesce(fits, F.lit(False)), grown).otherwise(fresh).alias("out"))

    return F.aggregate(zipped, start, step, lambda s: s["out"])


def components(segments: DataFrame, part: list[str], tolerance: float = 2.0, key: str = "seg_no") -> DataFrame:
    """Groups of a page's segments that meet directly or through others: part, key, component (the least key). segments: key, horizontal, pos, a, b."""
    kinds = {f.name: f.dataType.simpleString() for f in segments.select(*part, key).schema}
    schema = ", ".join(f"`{k}` {v}" for k, v in kinds.items()) + ", component long"

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(key)
        horizontal, pos, a, b = (page[c].to_numpy() for c in ("horizontal", "pos", "a", "b"))
        label = list(range(len(page)))

        def root(i: int) -> int:
            while label[i] != i:
                label[i] = label[label[i]]
                i = label[i]
            return i

        for i in range(len(page)):
            same = horizontal[i + 1 :] == horizontal[i]
            along = (abs(pos[i + 1 :] - pos[i]) <= tolerance) & (a[i + 1 :] <= b[i] + tolerance) & (a[i] <= b[i + 1 :] + tolerance)
            across = (pos[i] >= a[i + 1 :] - tolerance) & (pos[i] <= b[i + 1 :] + tolerance) & (pos[i + 1 :] >= a[i] - tolerance) & (pos[i + 1 :] <= b[i] + tolerance)
            for j in ((same & along) | (~same & across)).nonzero()[0] + i + 1:
                x, y = root(i), root(int(j))
                label[max(x, y)] = min(x, y)
        keys = page[key].to_numpy()
        return page[[*part, key]].assign(component=[int(keys[root(i)]) for i in range(len(page))])

    return segments.select(*part, key, "horizontal", "pos", "a", "b").groupBy(*part).applyInPandas(run, schema)


GRID_SCHEMA = "r int, c int, row_span int, col_span int, left double, right double, top double, bottom double, b_top boolean, b_bottom boolean, b_left boolean, b_right boolean"
#: Cells handed on at once.
GRID_ROWS = 50_000


def _cells(horizontal, pos, a, b, tolerance: float = 2.0, drift: float = 4.0) -> list[tuple]:
    """Rows of GRID_SCHEMA for one grid of rules; none unless there are two cells."""
    sides: dict[bool, list[tuple]] = {True: [], False: []}
    for h, *rule in zip(horizontal, pos, a, b, strict=True):
        sides[h].append(tuple(rule))

    def positions(side: list[tuple]) -> list[float]:
        out: list[float] = []
        for v in sorted(p for p, _, _ in side):
            if out and v - out[-1] <= drift:
                out[-1] = (out[-1] + v) / 2
            else:
                out.append(float(v))
        return out

    ys, xs = positions(sides[True]), positions(sides[False])
    n_rows, n_cols = len(ys) - 1, len(xs) - 1
    if n_rows < 1 or n_cols < 1:
        return []

    def drawn(side: list[tuple], places: list[float], steps: list[float]) -> list[list[bool]]:
        """For each place, along which steps one rule runs from end to end: of those that begin early enough, the one that reaches farthest."""
        side = sorted(rule for rule in side if rule[0] == rule[0] and rule[1] == rule[1] and rule[2] == rule[2])
        out = []
        for at in places:
            low = bisect.bisect_left(side, (at - 2 * tolerance,))
            high = bisect.bisect_right(side, (at + 2 * tolerance,))
            near = sorted((start, stop) for p, start, stop in side[low:high] if abs(p - at) <= tolerance)
            starts, reach = [start for start, _ in near], list(itertools.accumulate((stop for _, stop in near), max))
            begun = [bisect.bisect_right(starts, x + tolerance) for x in steps[:-1]]
            out.append([k > 0 and reach[k - 1] >= x - tolerance for k, x in zip(begun, steps[1:], strict=True)])
        return out

    across, down = drawn(sides[True], ys, xs), drawn(sides[False], xs, ys)
    taken: set[tuple[int, int]] = set()
    out = []
    for r in range(n_rows):
        for c in range(n_cols):
            if (r, c) in taken:
                continue
            wide = next((k for k in range(c + 1, n_cols) if down[k][r]), n_cols) - c
            high = next((i for i in range(r + 1, n_rows) if any(across[i][c : c + wide])), n_rows) - r
            if high > 1 or wide > 1:
                taken.update((r + i, c + k) for i in range(high) for k in range(wide))
            out.append((r, c, high, wide, xs[c], xs[c + wide], ys[r], ys[r + high], across[r][c], across[r + high][c], down[c][r], down[c + wide][r]))
    return out if len(out) > 1 else []


def grid_cells(rules: pd.DataFrame, tolerance: float = 2.0, drift: float = 4.0) -> pd.DataFrame:
    """The cells of one grid of rules (horizontal, pos, a, b): a cell spans on where no rule parts it from the next. Empty unless there are two cells."""
    cells = _cells(*(rules[c].tolist() for c in ("horizontal", "pos", "a", "b")), tolerance, drift)
    return pd.DataFrame(cells, columns=[x.split(" ")[0] for x in GRID_SCHEMA.split(", ")])


def ruled_grids(segments: DataFrame, part: list[str], grid: str = "component") -> DataFrame:
    """Cells of every grid: components with two horizontal and two vertical rules at least. segments: grid, horizontal, pos, a, b.

    Rules meet in a list for each grid, and a task takes many grids from one Arrow batch. Rules are few bytes and much work, so they
    are dealt to all shuffle partitions, which are not joined again by size.
    """
    own, spark = [*part, grid], segments.sparkSession
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.select(*own).schema)
    rule = F.struct("horizontal", *[F.col(c).cast("double").alias(c) for c in ("pos", "a", "b")])
    dealt = segments.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *own)
    ruled = dealt.groupBy(*own).agg(F.collect_list(rule).alias("grid rules"), F.count_if("horizontal").alias("rules across"), F.count_if(~F.col("horizontal")).alias("rules down"))
    ruled = ruled.where((F.col("rules across") >= 2) & (F.col("rules down") >= 2)).select(*own, "grid rules")
    names = [x.split(" ") for x in GRID_SCHEMA.split(", ")]
    types = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}

    def run(batches):
        for batch in batches:
            lists = batch.column("grid rules")
            flat, ends = lists.flatten(), (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            horizontal = flat.field("horizontal").to_pylist()
            pos, a, b = (flat.field(c).to_numpy(zero_copy_only=False).tolist() for c in ("pos", "a", "b"))
            index: list[int] = []
            out: list[tuple] = []
            for i in range(batch.num_rows):
                s = slice(ends[i], ends[i + 1])
                cells = _cells(horizontal[s], pos[s], a[s], b[s])
                index += [i] * len(cells)
                out += cells
                if out and (len(out) >= GRID_ROWS or i == batch.num_rows - 1):
                    columns = [pa.array(v, types[kind]) for v, (_, kind) in zip(zip(*out, strict=True), names, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(index)) for c in own), *columns], names=[*own, *(n for n, _ in names)])
                    index, out = [], []

    return ruled.mapInArrow(run, f"{kinds}, {GRID_SCHEMA}")


def padded_rows(cells: DataFrame, part: list[str]) -> DataFrame:
    """Grid cells by row: a cell that spans rows has a placeholder in each further one."""
    return cells.withColumn("row", F.explode(F.sequence(F.col("r"), F.col("r") + F.col("row_span") - 1))).withColumn("placeholder", F.col("row") != F.col("r"))
