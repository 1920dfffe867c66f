"""Queries that have to cover their whole input, against brute force in Python."""

import datetime

import pytest
from pyspark.sql import functions as F

from grainworks import queries


def saved(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("far", [0, 3])
def test_glyph_rows_of_every_order_in_median_steps(spark, tmp_path, far):
    from grainworks.sources.pdf import virtual_lines

    # with far = 3 the median step is 24, so that a gap is counted in other units than a glyph's width
    rows = [(o, n, (o + n) % 4 if not far else 3 * n % 4 if n < 5 else 3 * (n % 2), o * 7 + n) for o in range(1, 41) for n in range(1, 8) if not far or n > 3]
    d = saved(spark, tmp_path, "lineitem", rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long")
    orders = {}
    for o, n, part, supp in rows:
        orders.setdefault(o, []).append((n * 6.0 + (part % 4 * 6.0 if n > 3 else 0.0), n, chr(97 + supp % 26)))
    want = dict(zip(orders, virtual_lines([[(0, x, 0, 6.0, 1.0, ch) for x, _, ch in sorted(g)] for g in orders.values()])))
    assert {r.l_orderkey: r.line for r in queries.glyph_row_text(spark, d).collect()} == want


def test_ws_tokens_of_every_line(spark, tmp_path):
    texts = ["a b\nc  d e\n\n f", "", "x\r\n\ty z w v u", None, "only"]
    d = saved(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.pos): (r.tokens, r.first, r.ragged) for r in queries.ws_tokens(spark, d).collect()}
    lines = {(i, k): x.split() for i, t in enumerate(texts) if t is not None for k, x in enumerate(t.split("\n"), 1)}
    width = max(map(len, lines.values()))
    assert got == {at: (len(f), f[0] if f else "", len(f) != width) for at, f in lines.items()} | {(3, None): (None, "", None)}


def test_region_fill_by_blocks_of_rows(spark, monkeypatch):
    from grainworks.operators import shape

    cells = [(r, c, "own" if r % 7 == 0 else None) for r in range(300) for c in range(4)]
    regions = [(0, 0, 0, 0, "a"), (60, 200, 1, 2, "b"), (128, 128, 3, 3, "c"), (250, 299, 0, 1, None)]
    want = {(r, c): v or next((x for a, b, e, f, x in regions if a <= r <= b and e <= c <= f), None) for r, c, v in cells}
    made = shape.region_fill(spark.createDataFrame(cells, "row long, col long, value string"), spark.createDataFrame(regions, "r1 long, r2 long, c1 int, c2 int, value string"))
    assert {(r.row, r.col): r.value for r in made.collect()} == want
    assert "NestedLoop" not in made._jdf.queryExecution().executedPlan().toString()
    called = []
    monkeypatch.setattr(shape, "region_fill", lambda *a: called.append(a))
    queries.merge_region_fill(spark, "/root/testdata/sf0.001")
    assert called


def test_rollup_of_all_tables(spark):
    import os

    d = "/root/testdata/sf0.001"
    names = [x.removesuffix(".parquet") for x in os.listdir(d) if x.endswith(".parquet")]
    got = {r.name: r.rows_out for r in queries.report_rollup(spark, d).collect()}
    assert len(names) == 14 and got == {t: spark.read.parquet(f"{d}/{t}.parquet").count() for t in names}


@pytest.mark.parametrize("name", ["csv_read", "csv_stream", "whitespace_read"])
def test_rendered_files_are_sorted_by_many_tasks(spark, tmp_path, monkeypatch, name):
    """No task sorts more than a part; the file, and so every row number, is the same."""
    from grainworks import file_queries

    orders = [(k, k % 7, "OFP"[k % 3], datetime.datetime(2024, 1, 1 + k % 28), f"{k % 5}-LOW") for k in range(3000)]
    orders = orders[1::2] + orders[::2]
    d = saved(spark, tmp_path, "orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string")
    want = sorted(map(tuple, queries.QUERIES[name](spark, d).collect()))
    monkeypatch.setattr(file_queries, "PART_ROWS", 400)
    parts = []
    monkeypatch.setattr(file_queries, "joined", lambda spark, folder, path, f=file_queries.joined: (parts.append(spark.read.text(folder).groupBy(F.input_file_name()).count().agg(F.count("*"), F.max("count")).first()), f(spark, folder, path)))
    assert sorted(map(tuple, queries.QUERIES[name](spark, d).collect())) == want and len(want) == 3001
    assert len(parts) == 1 and parts[0][0] > 5 and parts[0][1] < 1500


def test_rendered_files_never_have_more_parts_than_shuffles_write_straight(spark, tmp_path, monkeypatch):
    from grainworks import file_queries

    monkeypatch.setattr(file_queries, "PART_ROWS", 2)
    parts = []
    monkeypatch.setattr(file_queries, "joined", lambda spark, folder, path, f=file_queries.joined: (parts.append(len([x for x in spark.read.text(folder).inputFiles()])), f(spark, folder, path)))
    rows = spark.range(2000).selectExpr("1999 - id AS k", "CAST(1999 - id AS STRING) AS value")
    folder = file_queries.written(spark, rows, "a.txt")
    assert [r[0] for r in spark.read.text(folder).collect()] == [str(i) for i in range(2000)]
    assert len(parts) == 1 and 100 < parts[0] <= 200
