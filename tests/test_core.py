import json
import os
import sqlite3

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainworks.functions import cells, sniff
from grainworks.operators import shape, validate, vote
from grainworks.plans import pipeline, sinks
from grainworks.plans.model import EngineError, ParseError, SchemaRejected, Table, UnknownFormat
from grainworks.sources import trees


def put(path, text):
    data = text if isinstance(text, bytes) else text.encode()
    with open(path, "wb") as f:
        f.write(data)
    return str(path)


def lines(path):
    with open(path, encoding="utf-8") as f:
        return f.read().split("\n")


def infer_all(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", cells.infer(F.col("t")).alias("c")).orderBy("i").collect()
    return [None if r.c is None else (r.c.k, next(x for x in (r.c.b, r.c.i, r.c.f, r.c.s) if x is not None)) for r in rows]


CASES = {
    "": None, "  ": None, " 42 ": ("int", 42), "00501": ("text", "00501"), "-007": ("text", "-007"), "+007": ("int", 7), "0": ("int", 0), "0.5": ("float", 0.5),
    "9999999999999999999": ("text", "9999999999999999999"), "+9999999999999999999": ("float", 1e19), "-9223372036854775808": ("int", -(2**63)), "1e300": ("float", 1e300),
    "1d": ("text", "1d"), "1f": ("text", "1f"), "5.": ("float", 5.0), ".5": ("float", 0.5), "inf": ("float", float("inf")), "-Infinity": ("float", float("-inf")),
    "t": ("text", "t"), "YES": ("bool", True), "No": ("bool", False), "1_000": ("text", "1_000"), "e5": ("text", "e5"), ".": ("text", "."), "-": ("text", "-"),
}


def test_cell_inference(spark):
    assert infer_all(spark, list(CASES)) == list(CASES.values())
    assert [trees.infer(t) for t in CASES] == list(CASES.values())


def test_double_text(spark):
    values = [30.0, 3756.9, 1e8, 1e-5, 0.1, 100.0, 0.0, -2.5e-7, 1e300, 123456789.125, float("nan"), float("inf"), float("-inf"), 1.5e7, 12345678901234567.0]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, d double").orderBy("i").select(cells.double_text(F.col("d"))).collect()]
    from decimal import Decimal

    want = ["NaN" if v != v else "inf" if v == float("inf") else "-inf" if v == float("-inf") else format(Decimal(repr(v)), "f").removesuffix(".0") for v in values]
    assert got == want


def test_vote_boundaries():
    v = lambda n, i=0, f=0, b=0, d=0: vote.Votes(n, i, f, b, d)
    assert vote.rules("c", v(10, 9, 9)) == ("Text", pytest.approx(0.1)) and vote.rules("c", v(100, 91, 95))[0] == "Integer"
    assert vote.rules("c", v(0)) == ("Text", 0.0) and vote.is_ambiguous("Text", 0.0, v(0))
    assert not vote.is_ambiguous(*vote.rules("c", v(10, 3, 3)), v(10, 3, 3)) and vote.is_ambiguous(*vote.rules("c", v(10, 4, 4)), v(10, 4, 4))


def test_headers():
    assert shape.numbered(["id", "id", "id_2"]) == ["id", "id_2", "id_2"] and shape.unique(["id", "id", "id_2"]) == ["id", "id_2", "id_2_2"]
    assert shape.named(["", " a "]) == ["column_1", "a"] and shape.runs([True, False, False, True, False]) == [(1, 3), (4, 5)]


def test_csv_ragged_and_typed(spark, tmp_path):
    p = put(tmp_path / "a.csv", 'name;age;city;notes\nAnn;30;Paris;"likes; tea"\nBob;41\nEve;x;Rome;n;extra\n\nKim;007;Oslo;ok\n')
    r = pipeline.clean(spark, p, str(tmp_path / "o.csv"))
    assert lines(tmp_path / "o.csv") == ["name,age,city,notes", "Ann,30,Paris,likes; tea", "Bob,41,,", "Eve,x,Rome,n", "Kim,007,Oslo,ok", ""]
    assert r.report.rows_in == 4 and any("2 row(s)" in n.message for n in r.report.notes)


def test_csv_float_column_keeps_whole_numbers_as_text(spark, tmp_path):
    p = put(tmp_path / "a.csv", "amount,day\n10.5,2024-01-02\n20,2024-01-03\n30.25,01.02.2024\n")
    t = pipeline.read(spark, p).tables[0]
    assert [r.c0.k for r in t.df.orderBy("_row").collect()] == ["float", "text", "float"] and sinks.column_plan(t) == ["text", "text"]


def test_csv_encodings_quotes_and_headers(spark, tmp_path):
    assert lines(pipeline.clean(spark, put(tmp_path / "b.csv", b"\xef\xbb\xbfid,id,name\n1,2,x\n"), str(tmp_path / "b.out")).written[0])[0] == "id,id_2,name"
    p = put(tmp_path / "w.csv", "name;city\nRené;Orléans\n".encode("cp1252"))
    r = pipeline.clean(spark, p, str(tmp_path / "w.out"))
    assert lines(tmp_path / "w.out")[1] == "René,Orléans" and any("not UTF-8" in n.message for n in r.report.notes)
    p = put(tmp_path / "m.csv", 'a,b\n1,"two\nlines ""q"""\n2,x\n')
    pipeline.clean(spark, p, str(tmp_path / "m.out"))
    assert "\n".join(lines(tmp_path / "m.out")) == 'a,b\n1,"two\nlines ""q"""\n2,x\n'
    with pytest.raises(ParseError):
        pipeline.read(spark, put(tmp_path / "e.csv", "\n\n"), "csv")


def test_csv_options(spark, tmp_path):
    p = put(tmp_path / "a.txt", "1|2\n3|4\n")
    t = pipeline.read(spark, p, "csv", {"has_header": "no", "delimiter": "|"}).tables[0]
    assert t.headers == ["column_1", "column_2"] and t.df.count() == 2
    r = pipeline.read(spark, p, "csv", {"delimiter": "\\t"}).report
    assert any("not one byte" in n.message for n in r.notes)


def test_cleaning_twice_changes_nothing(spark, tmp_path):
    p = put(tmp_path / "a.csv", 'id, v ,w\n001, 3756.90 ,yes\n2,x,"a,b"\n3,1e-7,NO\n')
    pipeline.clean(spark, p, str(tmp_path / "1.csv"))
    pipeline.clean(spark, str(tmp_path / "1.csv"), str(tmp_path / "2.csv"))
    assert lines(tmp_path / "1.csv") == lines(tmp_path / "2.csv")


def test_streaming_keeps_cells(spark, tmp_path):
    p = put(tmp_path / "a.csv", 'a , b\n3756.90, x\n1\n1,2,3\n"q,r",s\n')
    r = pipeline.clean(spark, p, str(tmp_path / "o.csv"), stream=True)
    assert lines(tmp_path / "o.csv") == ["a,b", "3756.90, x", "1,", "1,2", '"q,r",s', ""] and r.report.rows_in == 4


def test_structured_stream_equals_the_batch(spark, tmp_path):
    from grainworks.streaming.clean import stream_folder

    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.csv", "a;b\n1;2;3\n4\n")
    q = stream_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), ";", ["a", "b"])
    q.awaitTermination(60)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1,2", "4,"]


def test_fixed_and_whitespace(spark, tmp_path):
    p = put(tmp_path / "a.txt", "name   age  city\nAnn    30   Paris\nBob    22   Lyon\n")
    t = pipeline.read(spark, p, "fixed", {"has_header": "true"}).tables[0]
    assert t.headers == ["name", "age", "city"] and [r.c1 for r in t.df.orderBy("_row").collect()] == [30, 22]
    t = pipeline.read(spark, put(tmp_path / "a.log", "a b c\nd e\n"), "fixed", {"mode": "whitespace"})
    assert t.tables[0].headers == ["field_1", "field_2", "field_3"] and any("more or fewer fields" in n.message for n in t.report.notes)


def test_ini_and_env(spark, tmp_path):
    t = pipeline.read(spark, put(tmp_path / "a.ini", "k = 0\n[a]\nhost = h ; c\nport=1\nport = 2\n[b]\nhost='x;y'\n"), "ini").tables[0]
    assert t.headers == ["section", "host", "k", "port"] and [r.c0 for r in t.df.orderBy("_row").collect()] == [None, "a", "b"]
    o = pipeline.read(spark, put(tmp_path / ".env", 'export A="q # r"\nB=2\n'))
    assert o.report.detected_format == "env" and o.tables[0].headers == ["A", "B"]
    with pytest.raises(ParseError):
        pipeline.read(spark, put(tmp_path / "e.ini", "; nothing\n"), "ini")


def test_nested_formats(spark, tmp_path):
    doc = {"items": [{"a": {"b": 1, "c": []}, "t": ["x", 5, None], "n": 12345678901234567890123, "f": 17.00, "s": "007", "y": "yes", "e": {}}, {"a": 2}]}
    o = pipeline.read(spark, put(tmp_path / "a.json", json.dumps(doc)))
    assert o.tables[0].headers == ["a", "a.b", "a.c", "e", "f", "n", "s", "t", "y"]
    r = o.tables[0].df.orderBy("_row").first()
    assert (r.c1.i, r.c2.s, r.c3, r.c4.f, r.c5.s, r.c6.s, r.c7.s, r.c8.b) == (1, "", None, 17.0, "12345678901234567890123", "007", "x; 5; ", True)
    t = pipeline.read(spark, put(tmp_path / "b.json", '[{"o":1,"i":[{"s":1},{"s":2}],"j":[{"k":1},{"k":2}]}]'), options={"array_mode": "explode"}).tables[0]
    assert t.headers == ["i.s", "j.k", "o"] and t.df.count() == 4
    assert pipeline.read(spark, put(tmp_path / "c.json", '[{"i":[{"s":1}]}]')).tables[0].headers == ["i[0].s"]
    x = pipeline.read(spark, put(tmp_path / "a.xml", '<r><p id="1"><n>A</n></p><p id="2"><n>B</n><d>3</d>t</p></r>')).tables[0]
    assert x.headers == ["#text", "@id", "d", "n"]
    y = pipeline.read(spark, put(tmp_path / "a.yaml", "- on: off\n  d: 2024-01-01\n  t: 12:30:45\n  z: 017\n")).tables[0]
    assert y.headers == ["d", "on", "t", "z"] and y.df.first().c1.s == "off"
    with pytest.raises(ParseError):
        pipeline.read(spark, put(tmp_path / "a.ndjson", '{"a":1}\n{bad\n'))
    with pytest.raises(ParseError):
        pipeline.read(spark, put(tmp_path / "deep.json", "[" * 5000 + "]" * 5000))


def test_flatten_rules():
    f = lambda s, **k: trees.flatten(trees.json_tree(s), **k)
    assert f("5") == [{"": ("int", 5)}] and f("[]") == [{"": ("text", "")}] and f("{}") == [{"": None}] and f('[{"x":1}]') == [{"[0].x": ("int", 1)}]
    assert f('{"a":{"b":1},"a.b":2}') == [{"a.b": ("int", 2)}]
    assert trees.records({"b": 1, "c": [2], "a": [3]}) == ([3], "a")


def test_sqlite(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "a.db")
    con.executescript("CREATE TABLE users(id INTEGER, n TEXT, b REAL, x BLOB); INSERT INTO users VALUES (1, '007', 1.5, x'00ff'), (2, NULL, 2, NULL); CREATE TABLE a_b(k);")
    con.close()
    o = pipeline.read(spark, str(tmp_path / "a.db"))
    assert [t.source for t in o.tables] == ["a_b", "users"] and o.tables[1].df.orderBy("_row").first().c3.s == "<blob: 2 bytes>"
    pipeline.clean(spark, str(tmp_path / "a.db"), str(tmp_path / "o.csv"))
    assert lines(tmp_path / "o_users.csv") == ["id,n,b,x", "1,007,1.5,<blob: 2 bytes>", "2,,2,", ""]


def test_columnar(spark, tmp_path):
    df = spark.sql("SELECT 1 AS id, '42' AS s, cast(0.1 AS float) AS f, date'2024-01-02' AS d, cast(1.50 AS decimal(5,2)) AS m, named_struct('a', 1.0D, 'b', true) AS n, array(1, 2) AS l, X'0aff' AS b, timestamp_ntz'2024-01-02 03:04:05' AS t")
    for fmt in ("parquet", "orc"):
        df.coalesce(1).write.format(fmt).save(f"{tmp_path}/{fmt}")
        part = next(f for f in os.listdir(f"{tmp_path}/{fmt}") if f.startswith("part"))
        t = pipeline.read(spark, f"{tmp_path}/{fmt}/{part}").tables[0]
        r = t.df.first()
        assert (r.c0, r.c1.i, r.c2, r.c3, r.c4, r.c5, r.c6, r.c7, r.c8) == (1, 42, 0.1, "2024-01-02", "1.50", "{a: 1.0, b: true}", "[1, 2]", "0aff", "2024-01-02T03:04:05")


def zigzag(n):
    n, out = (n << 1) ^ (n >> 63), b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def avro_bytes(schema, body, n=1):
    head = json.dumps(schema).encode()
    return b"Obj\x01" + zigzag(1) + zigzag(11) + b"avro.schema" + zigzag(len(head)) + head + b"\0" + b"S" * 16 + zigzag(n) + zigzag(len(body)) + body + b"S" * 16


def test_avro(spark, tmp_path):
    schema = {"type": "record", "name": "u", "fields": [{"name": "id", "type": "long"}, {"name": "s", "type": ["null", "string"]}, {"name": "d", "type": {"type": "int", "logicalType": "date"}}, {"name": "f", "type": "float"}, {"name": "b", "type": "bytes"}]}
    body = zigzag(5) + zigzag(1) + zigzag(2) + b"42" + zigzag(19723) + b"\xcd\xcc\xcc\x3d" + zigzag(1) + b"\xff"
    r = pipeline.read(spark, put(tmp_path / "a.avro", avro_bytes(schema, body))).tables[0].df.first()
    assert (r.c0.i, r.c1.s, r.c2.s, r.c3.f, r.c4.s) == (5, "42", "2024-01-01", 0.10000000149011612, "ff")
    assert pipeline.read(spark, put(tmp_path / "b.avro", avro_bytes("long", zigzag(7)))).tables[0].headers == ["value"]
    for bad in (avro_bytes({"type": "fixed", "name": "x", "size": 21743271952}, b""), bytes.fromhex("4F626A01A5EEA47E7B6D3D02"), b"Obj\x01"):
        with pytest.raises(ParseError):
            pipeline.read(spark, put(tmp_path / "c.avro", bad), "avro")


def test_xlsx(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    s = lambda ref, t: f'<c r="{ref}" t="inlineStr"><is><t>{t}</t></is></c>'
    rows = f'<row r="1">{s("A1", "Report")}</row><row r="3">{s("A3", "name")}{s("B3", "score")}{s("C3", "team")}</row><row r="4">{s("A4", "Ann")}<c r="B4"><v>91</v></c>{s("C4", "Blue")}</row><row r="5">{s("A5", "007")}<c r="B5" s="1"><v>46037</v></c></row><row r="6">{s("A6", "end")}</row>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S 1" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>{rows}</sheetData><mergeCells><mergeCell ref="C4:C5"/></mergeCells></worksheet>')
    o = pipeline.read(spark, str(tmp_path / "a.xlsx"))
    got = o.tables[0].df.orderBy("_row").collect()
    assert o.tables[0].headers == ["name", "score", "team"] and len(got) == 2 and got[0].c1.f == 91.0
    assert got[1].c0.s == "007" and got[1].c1.s.startswith("2026-01-15") and got[1].c2.s == "Blue"


def pdf_bytes(rows, font="Courier"):
    text = "BT /F1 10 Tf 12 TL 50 700 Td " + " ".join(f"({r}) Tj T*" for r in rows) + " ET"
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", "<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", f"<< /Length {len(text)} >>\nstream\n{text}\nendstream", f"<< /Type /Font /Subtype /Type1 /BaseFont /{font} >>"]
    return ("%PDF-1.4\n" + "".join(f"{i + 1} 0 obj\n{o}\nendobj\n" for i, o in enumerate(objects)) + "trailer << /Root 1 0 R >>\n%%EOF").encode()


def test_pdf(spark, tmp_path):
    o = pipeline.read(spark, put(tmp_path / "a.pdf", pdf_bytes(["name     age  city", "Alice    30   Paris", "Bob      22   Lyon", "Chris    41   Rome"])))
    assert o.tables[0].headers == ["name", "age", "city"] and [r.c1 for r in o.tables[0].df.orderBy("_row").collect()] == [30, 22, 41]
    with pytest.raises(ParseError):
        pipeline.read(spark, put(tmp_path / "b.pdf", b"%PDF-1.4 nothing"), "pdf")


def test_pdf_cut_loses_nothing():
    from grainworks.sources.pdf import cut, spans

    assert spans(["name           age", "Alice          30", "Christopherson 41", "Bob            22"]) == [(0, 14), (15, 18)]
    assert cut("ab x cd", [(0, 2), (5, 7)]) == ["abx", "cd"]


def test_detection(spark, tmp_path):
    good = {"csv": b"a,b\n1,2\n3,4\n", "json": b'[{"a":1}]', "ini": b"[a]\nk=1\nj=2\n", "fixed": b"aa   bb   cc\ndd   ee   ff\ngg   hh   ii\n", "sqlite": b"SQLite format 3\0" + b"\0" * 100, "parquet": b"PAR1" + b"\0" * 20, "avro": b"Obj\x01" + b"\0" * 9, "pdf": b"%PDF-1.4", "orc": b"x" * 40 + b"\x03ORC\x17", "xlsx": b"PK\x03\x04" + b"\0" * 9}
    for fmt, content in good.items():
        assert sniff.detect(content)[0] == fmt, fmt
    (tmp_path / "d").mkdir()
    for fmt, content in good.items():
        put(tmp_path / "d" / fmt, content)
    found = {r.path.rsplit("/", 1)[-1]: r.format for r in pipeline.detect_files(spark, str(tmp_path / "d")).collect()}
    assert found == {f: f for f in good}
    assert sniff.detect(b"\x00\x01\x02" * 50) is None
    with pytest.raises(UnknownFormat):
        pipeline.read(spark, put(tmp_path / "x.bin", b"\x00\x01" * 9))
    with pytest.raises(UnknownFormat):
        pipeline.read(spark, put(tmp_path / "y.csv", "a,b\n"), "xml")


def test_validation(spark, tmp_path):
    p = put(tmp_path / "a.csv", "id,amount,day\n1,2.5,2024-01-02\n2,oops,\n3,4.5,xx\n4,1.5,1\n")
    rules = validate.Schema.from_json('{"columns":[{"name":"id","type":"integer"},{"name":"amount","type":"float"},{"name":"day","type":"date","nullable":false},{"name":"gone","type":"any"}],"strict":true}')
    got = [(r.row, r.column) for r in validate.issues(pipeline.read(spark, p).tables[0], rules).orderBy("place", "row").collect()]
    assert got == [(None, "gone"), (1, "amount"), (1, "day"), (2, "day"), (3, "day")]
    with pytest.raises(SchemaRejected):
        pipeline.clean(spark, p, str(tmp_path / "o.csv"), schema=rules, on_violation="reject", report_path=str(tmp_path / "r.json"))
    assert not (tmp_path / "o.csv").exists() and json.load(open(tmp_path / "r.json"))["rows_in"] == 4
    with pytest.raises(EngineError):
        validate.Schema.from_json('{"columns":[{"name":"x","type":"odd"}]}')


def test_json_and_parquet_sinks(spark, tmp_path):
    p = put(tmp_path / "a.csv", 'id,ID,v,t\n1,2,1.5,"q""x"\n2,3,2.25,\n')
    pipeline.clean(spark, p, str(tmp_path / "o.json"))
    assert json.load(open(tmp_path / "o.json")) == [{"id": 1, "ID": 2, "v": 1.5, "t": 'q"x'}, {"id": 2, "ID": 3, "v": 2.25, "t": None}]
    pipeline.clean(spark, p, str(tmp_path / "o.parquet"))
    import pyarrow.parquet as pq

    assert [(f.name, str(f.type)) for f in pq.read_schema(tmp_path / "o.parquet")] == [("id", "int64"), ("ID", "int64"), ("v", "double"), ("t", "string")]
    empty = Table(["a"], spark.createDataFrame([], "_row long, c0 string"))
    sinks.write(empty, str(tmp_path / "e.json"))
    assert json.load(open(tmp_path / "e.json")) == []


def test_batch_dry_run_and_cli(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "sub").mkdir()
    put(d / "a.csv", "x,y\n1,2\n")
    put(d / "a.json", '[{"x":1}]')
    put(d / "bad.json", "{")
    results = pipeline.batch(spark, str(d), str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["a_csv.csv", "a_json.csv"] and sum(r.error is not None for r in results) == 1
    assert {r.detected_format: r.files for r in pipeline.rollup(pipeline.reports(spark, results)).collect()}["csv"] == 1
    from grainworks.cli import main

    out = str(tmp_path / "o.csv")
    assert main(["clean", str(d / "a.csv"), "-o", out, "--dry-run"], spark) == 0 and not os.path.exists(out)
    put(tmp_path / "c.toml", '[defaults]\noutput_format = "json"\n')
    assert main(["clean", str(d / "a.csv"), "--config", str(tmp_path / "c.toml"), "--report", str(tmp_path / "r.json")], spark) == 0
    assert os.path.exists(d / "a.clean.json") and main(["detect", str(d / "a.csv")], spark) == 0 and main(["clean", str(d / "bad.json")], spark) == 1
    assert "unchanged" in pipeline.clean(spark, str(d / "a.csv"), str(tmp_path / "out" / "a_csv.csv"), dry_run=True).preview


def test_new_formats_and_resolvers(spark, tmp_path):
    from grainworks.plans.model import Outcome, Report

    pipeline.register("toy", lambda spark, path, name, options, resolver: Outcome([Table(["n"], spark.range(2).selectExpr("id AS _row", "id AS c0"))], Report(name, "toy", 2, 2)), lambda content, name: 0.99 * content.startswith(b"TOY"))
    try:
        assert pipeline.read(spark, put(tmp_path / "a.toy", b"TOY!")).report.detected_format == "toy"
    finally:
        pipeline.READERS.pop("toy")
        pipeline.SNIFFERS.pop("toy")
    t = pipeline.read(spark, put(tmp_path / "a.csv", "v\n1\n2\n"), resolver=lambda name, votes: ("Text", 1.0)).tables[0]
    assert [r.c0 for r in t.df.orderBy("_row").collect()] == ["1", "2"]
    assert vote.http_resolver("http://127.0.0.1:9/none", "k", "m", 0.2)("c", vote.Votes(1, 1, 1, 0, 0)) == ("Text", 0.0)


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.binary(max_size=300), st.sampled_from(["json", "ini", "xlsx", "sqlite", "avro", "pdf"]), st.sampled_from([b"", b"PK\x03\x04", b"Obj\x01", b"%PDF-1.4\n", b"SQLite format 3\0", b"{", b"<a>"]))
def test_readers_never_raise_anything_else(content, fmt, head):
    from grainworks.sources.files import parse

    sniff.detect(head + content, "x")
    try:
        parse(fmt, head + content, "x", {})
    except ValueError:
        pass


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_inferred_text_round_trips(t):
    got = trees.infer(t)
    if got and got[0] == "text":
        assert got[1] == t.strip() and trees.infer(got[1]) == got
