"""Queries on tables with rows beyond the bounds that once cut them, against DuckDB on all rows."""

import random

import pytest

EVENTS = [*range(100), *range(3950, 4100), *range(5950, 6100), *range(99_000, 99_100)]


def tables(folder):
    rng = random.Random(5)
    texts = [None, "", "é", "ab-\n\ncd", "one two-\nthree\n-\nfour\n"]
    documents = [(k, rng.choice(texts), "en", f"src{k % 3}") for k in (*range(20), *range(290, 310), *range(1990, 2010), *range(9_000, 9_020))]
    rng.shuffle(documents)
    return {
        "events": ("event_id long, user_id long", [(k, rng.randrange(6)) for k in EVENTS]),
        "lineitem": ("l_orderkey long, l_quantity double", [(k, float(rng.randrange(1, 51))) for k in (*range(9), *range(2990, 3010), 1 << 40) for _ in range(5)]),
        "customer": ("c_custkey long", [(k,) for k in range(60)]),
        "nation": ("n_nationkey int, n_regionkey int", [(k, k % 6) for k in range(25)]),
        "orders": ("o_orderkey long, o_orderstatus string", [(k, "PF"[k % 2 == 0]) for k in (*range(10), 1 << 40)]),
        "documents": ("doc_id long, text string, lang string, source string", documents),
    }


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """A function that gives a query's rows and those of its SQL on all rows."""
    import duckdb

    from folia import catalog

    folder, db = tmp_path_factory.mktemp("whole"), duckdb.connect()
    for name, (schema, rows) in tables(folder).items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")

    def both(name):
        df, want = catalog.queries()[name](spark, str(folder)), db.sql(catalog.oracle_sql()[name])
        columns = sorted(df.columns)
        order = [want.columns.index(c) for c in columns]
        return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str), sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)

    return both


@pytest.mark.parametrize("name", ["line_extents", "point_in_box", "shade_cells", "lines_in_boxes", "interleave_by_position", "line_grouping", "pager"])
def test_boxes_are_of_all_events(whole, name):
    got, want = whole(name)
    assert got and got == want


@pytest.mark.parametrize("name", ["touching_segments", "segment_components", "covered_edges", "rule_merge"])
def test_segments_are_of_all_events(whole, name):
    got, want = whole(name)
    assert got and got == want


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_offsets_are_of_all_documents(spark, whole, coalesce):
    """In one range partition and in several."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, coalesce)
    try:
        got, want = whole("prefix_offsets")
    finally:
        spark.conf.set(name, before)
    assert len(got) == 80 and got == want


@pytest.mark.parametrize("name", ["glyph_advance_sum", "join_lines"])
def test_texts_are_of_all_documents(whole, name):
    got, want = whole(name)
    assert got and got == want


@pytest.mark.parametrize("name", ["column_cluster", "position_cluster", "numbering_left_join"])
def test_clusters_and_numbering_are_of_all_rows(whole, name):
    got, want = whole(name)
    assert got and got == want
