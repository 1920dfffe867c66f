"""Cases in which an obvious reading of the rules goes wrong, and the reach of scans, configs and folders."""

import json
import os
import sqlite3

import pytest

from grainworks import file_queries
from grainworks.functions import sniff
from grainworks.plans import pipeline
from grainworks.plans.model import ParseError
from tests.test_core import lines, put


def table(spark, path, *a, **k):
    return pipeline.read(spark, path, *a, **k).tables[0]


def test_of_equally_frequent_widths_the_wider_one_wins(spark, tmp_path):
    t = table(spark, put(tmp_path / "a.csv", "a,b\n1,2\n1,2,3\n1,2,3\n"))
    assert t.headers == ["a", "b", "column_3"] and [tuple(r)[1:] for r in t.df.orderBy("_row").collect()] == [(1, 2, None), (1, 2, 3), (1, 2, 3)]


def test_a_header_wider_than_the_rows_keeps_its_names(spark, tmp_path):
    t = table(spark, put(tmp_path / "a.csv", "a,b,c,d\n1,2\n3,4\n5,6,7\n"))
    assert t.headers == ["a", "b", "c", "d"] and [tuple(r)[1:] for r in t.df.orderBy("_row").collect()] == [(1, 2, None, None), (3, 4, None, None), (5, 6, None, None)]


def test_an_extension_of_the_json_family_outweighs_the_content(spark, tmp_path):
    assert sniff.detect(b"a,b\n1,2\n3,4\n", "x.json")[0] == "json" and sniff.detect(b"a,b\n1,2\n3,4\n", "x")[0] == "csv"
    with pytest.raises(ParseError):
        pipeline.read(spark, put(tmp_path / "x.json", "a,b\n1,2\n3,4\n"))


def test_equal_scores_go_to_the_later_format(spark, tmp_path):
    pipeline.register("late", None, lambda content, name: 0.6)
    try:
        assert pipeline.detect(put(tmp_path / "x", b"PAR1" + b"\0" * 40), spark)[0] == "late"
    finally:
        pipeline.READERS.pop("late")
        pipeline.SNIFFERS.pop("late")


def test_a_character_cut_by_the_prefix_does_not_end_streaming(spark, tmp_path):
    from grainworks.streaming import clean

    text = "a;b\n" + "x;y\n" * ((clean.PREFIX - 8) // 4) + "é;é\n" * 50
    for shift in ("", "z", "zz"):
        p = put(tmp_path / f"a{shift}.csv", f"a{shift}" + text[1:])
        report = clean.stream_clean(spark, p, str(tmp_path / "o.csv"))
        assert any("stream" in n.message for n in report.notes) and report.rows_in == text.count("\n") - 1
        assert lines(tmp_path / "o.csv")[-2] == "é,é"


def test_text_outside_fixed_columns_is_lost_with_a_warning(spark, tmp_path):
    rows = "\n".join(["aa  bb"] * 220 + ["aaXXbb"] * 3)
    out = pipeline.read(spark, put(tmp_path / "a.txt", rows), "fixed")
    assert out.tables[0].df.count() == 223 and any(n.severity == "warning" and "3 line(s)" in n.message for n in out.report.notes)


def test_whitespace_mode_cuts_rows_to_the_header(spark, tmp_path):
    t = table(spark, put(tmp_path / "a.txt", "a b\n1 2 3\n4\n"), "fixed", {"mode": "whitespace", "has_header": "true"})
    assert t.headers == ["a", "b"] and [tuple(r)[1:] for r in t.df.orderBy("_row").collect()] == [(1, 2), (4, None)]


def test_merged_regions_are_in_sheet_coordinates_and_come_before_the_header(spark, tmp_path):
    import io
    import zipfile

    made = file_queries.xlsx_bytes(["name", "team"], [["Ann", "Blue"], ["Bob", None]], "Report", "end", ["B4:B5"])
    moved = io.BytesIO()  # the same sheet from C3 on
    with zipfile.ZipFile(io.BytesIO(made)) as old, zipfile.ZipFile(moved, "w") as new:
        for name in old.namelist():
            text = old.read(name).decode()
            if "sheet1" in name:
                for r in range(9, 0, -1):
                    text = text.replace(f'r="A{r}"', f'r="C{r + 2}"').replace(f'r="B{r}"', f'r="D{r + 2}"').replace(f'<row r="{r}">', f'<row r="{r + 2}">')
                text = text.replace('ref="B4:B5"', 'ref="D6:D7"')
            new.writestr(name, text)
    for name, content in (("a.xlsx", made), ("b.xlsx", moved.getvalue())):
        t = table(spark, put(tmp_path / name, content))
        assert t.headers == ["name", "team"] and [(r.c0.s, r.c1.s) for r in t.df.orderBy("_row").collect()] == [("Ann", "Blue"), ("Bob", "Blue")]
    titled = file_queries.xlsx_bytes(["name", "team"], [["Ann", "Blue"]], "Report", "end", ["A1:B1"])
    assert table(spark, put(tmp_path / "c.xlsx", titled)).headers == ["Report", "Report_2"]
    assert table(spark, put(tmp_path / "c.xlsx", titled), options={"merge_fill": "false"}).headers == ["name", "team"]


def test_config_of_the_folder_report_folder_and_switches(spark, tmp_path, monkeypatch):
    from grainworks import cli

    monkeypatch.chdir(tmp_path)
    at = lambda name: str(tmp_path / name)
    os.mkdir("in")
    put("in/a.csv", "x,y\n1,2\n")
    put("in/b.json", "{")
    put("grainworks.toml", '[defaults]\noutput_format = "json"\nno_header = true\n')
    assert cli.main(["clean", "--batch", at("in"), "-o", at("out"), "--report-dir", at("reports")], spark) == 0
    assert sorted(os.listdir("out")) == ["a.json"] and os.listdir("reports") == ["a.report.json"]
    assert [list(r) for r in json.load(open("out/a.json"))] == [["column_1", "column_2"]] * 2 and json.load(open("reports/a.report.json"))["rows_out"] == 2
    assert cli.main(["clean", at("in/a.csv"), "-o", at("one.json"), "--has-header"], spark) == 0 and json.load(open("one.json")) == [{"x": 1, "y": 2}]
    assert cli.main(["clean", at("in/a.csv"), "-o", at("parts"), "--output-format", "csv", "--has-header", "--parts"], spark) == 0 and os.path.isdir("parts")
    with pytest.raises(SystemExit):
        cli.main(["clean", "in/a.csv", "--has-header", "--no-header"], spark)
    with pytest.raises(SystemExit):
        cli.main(["clean", "in/a.csv", "--merge-fill", "--no-merge-fill"], spark)
    assert cli.main(["clean", at("in/a.csv"), "--config", at("none.toml")], spark) == 1


def test_filters_and_columns_reach_columnar_scans(spark, tmp_path):
    from grainworks.sources.columnar import plain

    for fmt in ("parquet", "orc"):
        spark.range(1000).selectExpr("id", "cast(id % 7 as int) AS k", "concat('n', id) AS name", "id / 2 AS half").write.format(fmt).save(f"{tmp_path}/{fmt}")
        df = plain(spark.read.format(fmt).load(f"{tmp_path}/{fmt}"))
        plan = df.where("c0 > 990 and c3 < 499").select("c1")._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThan(id,990)" in plan and "LessThan(half" in plan and "name" not in plan.split("ReadSchema")[1].split("\n")[0]
        assert df.where("c0 > 990 and c3 < 499").count() == 7


def test_ndjson_rows_in_order_from_many_partitions(spark, tmp_path, monkeypatch):
    from grainworks.sources import delimited

    monkeypatch.setattr(delimited, "OPEN_COST", 4096)
    rows = [{"a": i, "b": [{"c": j} for j in range(i % 3)]} if i % 2 else {"d": {"e": str(i)}} for i in range(3000)]
    out = pipeline.read(spark, put(tmp_path / "x.ndjson", "\n\n".join(json.dumps(r) for r in rows)), "json", {"array_mode": "explode"})
    assert out.tables[0].df.rdd.getNumPartitions() > 1
    t = out.tables[0]
    assert out.report.detected_format == "ndjson" and out.report.rows_in == 3000
    from grainworks.sources.trees import flatten, json_tree

    want = [row for r in rows for row in flatten(json_tree(json.dumps(r)), explode=True)]
    got = t.df.orderBy("_row").collect()
    assert t.headers == ["a", "b", "b.c", "d.e"] and [r["_row"] for r in got] == list(range(len(want)))
    assert [[None if c is None else next(x for x in (c.b, c.i, c.f, c.s) if x is not None) for c in r[1:]] for r in got] == [[None if w.get(h) is None else w[h][1] for h in t.headers] for w in want]
    with pytest.raises(ParseError):
        pipeline.read(spark, put(tmp_path / "y", '{"a":1}\n{"a":2}\n{"a"\n'), "json")


def test_large_files_are_detected_as_small_ones(spark, tmp_path, monkeypatch):
    cases = {"j": json.dumps([{"a": i, "text": "x" * 20} for i in range(900)]), "c": "a,b\n" + "1,2\n" * 9000, "y": "\n".join(f"- k: {i}\n  v: w" for i in range(2000)), "n": "\n".join('{"a": 1}' for _ in range(4000))}
    small = {k: pipeline.detect(put(tmp_path / k, v), spark) for k, v in cases.items()}
    monkeypatch.setattr(pipeline, "AT_ONCE", 100)
    assert {k: pipeline.detect(str(tmp_path / k), spark) for k in cases} == small
    assert [small[k][0] for k in "jcyn"] == ["json", "csv", "json", "json"]


def test_a_database_in_write_ahead_mode(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "a.db")
    con.executescript("PRAGMA journal_mode=WAL; CREATE TABLE t(a); INSERT INTO t VALUES (1), (2); PRAGMA wal_checkpoint(TRUNCATE);")
    con.close()
    assert [r.c0.i for r in table(spark, str(tmp_path / "a.db")).df.orderBy("_row").collect()] == [1, 2]


def test_row_numbers_beyond_the_bases_of_an_expression(spark, monkeypatch):
    from grainworks.operators import shape

    df = spark.range(0, 900, 1, 30).where("id % 30 <> 7 or id > 500")
    want, n = shape.with_row(df)
    monkeypatch.setattr(shape, "BASES", 3)
    got, _ = shape.with_row(df)
    assert n == df.count() and want.orderBy("_row").collect() == got.orderBy("_row").collect()
    assert [r["_row"] for r in got.orderBy("id").collect()] == list(range(n))


def test_streaming_with_quoted_line_breaks(spark, tmp_path):
    text = 'a,b\n1,"x\ny ""z"""\n2,w,v\n3,"u\n\nt"\n'
    r = pipeline.clean(spark, put(tmp_path / "a.csv", text), str(tmp_path / "o.csv"), stream=True)
    assert "\n".join(lines(tmp_path / "o.csv")) == 'a,b\n1,"x\ny ""z"""\n2,w\n3,"u\n\nt"\n' and r.report.rows_in == 3
    assert sorted(os.listdir(tmp_path)) == ["a.csv", "o.csv"]
    r = pipeline.clean(spark, put(tmp_path / "h.csv", '"a\nb",c\n1,2\n'), str(tmp_path / "o.csv"), stream=True)
    assert "\n".join(lines(tmp_path / "o.csv")) == '"a\nb",c\n1,2\n' and r.report.rows_in == 1
