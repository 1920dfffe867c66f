"""Queries over files: rows are rendered as a messy file of some format, which the engine's own reader reads back.

Text files are written to the shared folder and read with ``plans.pipeline.read``.  Binary formats are made and parsed
where the rows are, one file for each block of rows, by the function that the reader runs on a file's bytes.
Every result has a line for each record as the CSV sink writes it; the SQL builds the same lines from the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainworks.plans import pipeline, sinks
from grainworks.plans.model import Outcome, Table
from grainworks.queries import _scratch, _t, query

#: rows of one rendered binary file
FILE_ROWS = 250
#: rows of a rendered text file that one task sorts
PART_ROWS = 250_000
#: most parts: up to so many, Spark's shuffle writes rows straight to files (spark.shuffle.sort.bypassMergeThreshold); beyond, a map
#: task sorts all rows of its split in memory
MOST_PARTS = 200


def written(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """A folder called ``name`` with one text file: ``value`` of ``rows`` in the order of ``k``.

    Parts of about PART_ROWS rows (more where MOST_PARTS would not do) are sorted and written by a task each; the driver appends their bytes to one file.
    """
    base = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    folder, n = f"{base}/{name}", min(MOST_PARTS, max(1, -(-rows.count() // PART_ROWS)))
    rows = rows.select("k", "value")
    dealt = rows.coalesce(1) if n == 1 else rows.repartitionByRange(n, "k")
    dealt.sortWithinPartitions("k").select("value").write.text(folder if n == 1 else f"{base}/parts")
    if n > 1:
        joined(spark, f"{base}/parts", f"{folder}/part-00000.txt")
    return folder


def joined(spark: SparkSession, folder: str, path: str) -> None:
    """The part files of ``folder``, in the order of their names, as one file: a buffer of 1 MiB at a time, wherever Spark can write."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    at = hadoop.fs.Path(folder)
    fs = at.getFileSystem(conf)
    out = fs.create(hadoop.fs.Path(path))
    for part in sorted((s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName()):
        source = fs.open(part)
        hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
        source.close()
    out.close()
    fs.delete(at, True)


def rendered(rows: DataFrame, before: list[str] = (), after: list[str] = ()) -> DataFrame:
    """``rows`` (k, value) between fixed lines."""
    spark, n = rows.sparkSession, len(before)
    fixed = [(i - n - (1 << 40), x) for i, x in enumerate(before)] + [((1 << 40) + i, x) for i, x in enumerate(after)]
    more = spark.createDataFrame(fixed, "k long, value string")
    return rows.select(F.col("k").cast("long").alias("k"), "value").unionByName(more)


def shown(out: Outcome) -> DataFrame:
    """(tab, row, line) of every table; row -1 is the header."""
    made = None
    for i, t in enumerate(out.tables):
        head = t.df.sparkSession.createDataFrame([(i, -1, sinks.csv_header(t.headers))], "tab long, row long, line string")
        body = sinks.csv_lines(t).select(F.lit(i).cast("long").alias("tab"), F.col("_row").cast("long").alias("row"), F.col("value").alias("line"))
        part = head.unionByName(body)
        made = part if made is None else made.unionByName(part)
    return made


def _sql(header: str, line: str, table: str, order: str) -> str:
    return f"""SELECT CAST(0 AS BIGINT) AS tab, CAST(-1 AS BIGINT) AS row, '{header}' AS line
UNION ALL SELECT 0, row_number() OVER (ORDER BY {order}) - 1, {line} FROM {table}"""


# -- text files ---------------------------------------------------------------------------------------------------


@query(_sql("at.key,at.region,codes,e,flag,id,lists[0].x,lists[1].x,name,note", """concat_ws(',', CAST(s_nationkey AS VARCHAR), concat('r', CAST(s_nationkey % 5 AS VARCHAR)), concat('a; ', CAST(s_suppkey AS VARCHAR), '; '), '',
  CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE '007' END, CAST(s_suppkey AS VARCHAR), CAST(s_suppkey AS VARCHAR), '2.5', s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'n' ELSE '' END)""", "supplier", "s_suppkey"))
def json_read(spark, d):
    """A document whose first list holds the records: nested objects, lists, mixed scalars, a field that most records lack."""
    s = _t(spark, d, "supplier")
    body = F.expr("""concat('{"id": ', s_suppkey, ', "name": "', s_name, '", "at": {"key": ', s_nationkey, ', "region": "r', s_nationkey % 5, '"}, "codes": ["a", ', s_suppkey, ', null], "e": {}, "flag": "',
      if(s_suppkey % 2 = 0, 'Yes', '007'), '", "lists": [{"x": ', s_suppkey, '}, {"x": 2.50}]', if(s_suppkey % 3 = 0, ', "note": "n"', ''), '},')""")
    last = '{"id": 0}'
    rows = rendered(s.select(F.col("s_suppkey").alias("k"), body.alias("value")), ['{"rows": ['], [f"{last}]", ', "total": 1}'])
    out = pipeline.read(spark, written(spark, rows, "a.json"), "json")
    return shown(out).where("row < 0 or line not like ',,,,,0,%'")


@query(_sql("id,name,v", "concat_ws(',', CAST(c_custkey AS VARCHAR), c_name, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE '' END)", "customer", "c_custkey"))
def ndjson_read(spark, d):
    line = F.expr("""concat('{"id":', c_custkey, ',"name":"', c_name, '"', if(c_custkey % 2 = 0, concat(',"v":', c_nationkey), ''), '}')""")
    return shown(pipeline.read(spark, written(spark, rendered(_t(spark, d, "customer").select(F.col("c_custkey").alias("k"), line.alias("value"))), "a.ndjson"), "json"))


@query(_sql("@id,dims.h,dims.w,name", "concat_ws(',', CAST(p_partkey AS VARCHAR), '1.5', CAST(p_size AS VARCHAR), p_name)", "part", "p_partkey"))
def xml_read(spark, d):
    line = F.expr("concat('<part id=\"', p_partkey, '\"><name> ', p_name, '</name><dims><w>', p_size, '</w><h>1.5</h></dims></part>')")
    return shown(pipeline.read(spark, written(spark, rendered(_t(spark, d, "part").select(F.col("p_partkey").alias("k"), line.alias("value")), ["<parts>"], ["</parts>"]), "a.xml"), "json"))


@query(_sql("day,id,on,tags", "concat_ws(',', '2024-01-02', CAST(s_suppkey AS VARCHAR), 'off', concat('a; ', CAST(s_nationkey AS VARCHAR)))", "supplier", "s_suppkey"))
def yaml_read(spark, d):
    """Words such as ``off`` and dates are text under the core schema."""
    line = F.expr("concat('- id: ', s_suppkey, '\n  on: off\n  day: 2024-01-02\n  tags: [a, ', s_nationkey, ']')")
    return shown(pipeline.read(spark, written(spark, rendered(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), line.alias("value"))), "a.yaml"), "json"))


@query(_sql("section,key,name,port", """concat_ws(',', concat('s', CAST(s_suppkey AS VARCHAR)), CASE WHEN s_suppkey % 3 = 0 THEN 'a;b' ELSE '' END, s_name, CAST(s_nationkey AS VARCHAR))""", "supplier", "s_suppkey"))
def ini_read(spark, d):
    """Sections with comments, quotes, repeated keys (the last one wins) and a key that most lack."""
    line = F.expr("""concat('[s', s_suppkey, ']\n# note\nname = "', s_name, '" ; said\nport = 1\nport=', s_nationkey, if(s_suppkey % 3 = 0, "\nkey = 'a;b'", ''))""")
    return shown(pipeline.read(spark, written(spark, rendered(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), line.alias("value"))), "a.ini"), "ini"))


@query(_sql("field_1,field_2,field_3", "concat_ws(',', CAST(1000000 + c_custkey AS VARCHAR), c_mktsegment, CAST(c_nationkey AS VARCHAR))", "customer", "c_custkey"))
def fixed_read(spark, d):
    line = F.expr("concat(rpad(1000000 + c_custkey, 9, ' '), rpad(c_mktsegment, 14, ' '), lpad(c_nationkey, 2, ' '))")
    return shown(pipeline.read(spark, written(spark, rendered(_t(spark, d, "customer").select(F.col("c_custkey").alias("k"), line.alias("value"))), "a.txt"), "fixed"))


@query(_sql("key,status,day,day_2", "concat_ws(',', CAST(o_orderkey AS VARCHAR), o_orderstatus, strftime(o_orderdate, '%Y-%m-%d'), CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE '' END)", "orders", "o_orderkey"))
def whitespace_read(spark, d):
    """Runs of spaces and tabs between tokens, some lines with one token less, blank lines in between."""
    line = F.expr("concat('  ', o_orderkey, ' \t ', o_orderstatus, '   ', date_format(o_orderdate, 'yyyy-MM-dd'), if(o_orderkey % 4 = 0, '\tx', ''), if(o_orderkey % 9 = 0, '\n \t', ''))")
    rows = rendered(_t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), line.alias("value")), ["key status day day"])
    return shown(pipeline.read(spark, written(spark, rows, "a.log"), "fixed", {"mode": "whitespace", "has_header": "true"}))


_CSV_LINE = "concat_ws(';', concat(' ', CAST(o_orderkey AS STRING)), concat('\"', o_orderpriority, '; \"\"q\"\"\"'), CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE CAST(o_custkey AS STRING) END, CASE WHEN o_orderkey % 7 = 0 THEN 'extra;more' WHEN o_orderkey % 5 = 0 THEN '00501' ELSE 'yes' END)"


#: the second field as the sink writes it
_SAID = "concat(chr(34), o_orderpriority, '; ', chr(34), chr(34), 'q', chr(34), chr(34), chr(34))"


def _orders_csv(spark, d) -> DataFrame:
    return rendered(_t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.expr(_CSV_LINE).alias("value")), ["﻿id;what; cust ;flag", ""], [""])


@query(_sql("id,what,cust,flag", f"""concat_ws(',', CAST(o_orderkey AS VARCHAR), {_SAID}, CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END,
  CASE WHEN o_orderkey % 7 = 0 THEN 'extra' WHEN o_orderkey % 5 = 0 THEN '00501' ELSE 'true' END)""", "orders", "o_orderkey"))
def csv_read(spark, d):
    """Semicolons, a byte order mark, quotes that hold the delimiter, ragged rows, columns whose values disagree on a type."""
    return shown(pipeline.read(spark, written(spark, _orders_csv(spark, d), "a.csv"), "csv"))


@query(f"""SELECT k, line FROM (SELECT CAST(0 AS BIGINT) AS k, 'id,what,cust,flag' AS line UNION ALL SELECT o_orderkey, concat_ws(',', concat(' ', CAST(o_orderkey AS VARCHAR)), {_SAID},
  CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END, CASE WHEN o_orderkey % 7 = 0 THEN 'extra' WHEN o_orderkey % 5 = 0 THEN '00501' ELSE 'yes' END) FROM orders)""")
def csv_stream(spark, d):
    """The same file in one bounded pass: cells as they are, field counts repaired."""
    from grainworks.streaming.clean import stream_clean

    folder = written(spark, _orders_csv(spark, d), "a.csv")
    path = spark.read.format("binaryFile").load(folder).select("path").first()[0]
    output = f"{folder}.out.csv"
    stream_clean(spark, path, output.removeprefix("file:"))
    lines = spark.read.text(output)
    return lines.select(F.coalesce(F.regexp_extract("value", "^ ([0-9]+),", 1).try_cast("long"), F.lit(0)).alias("k"), F.col("value").alias("line"))


@query(_sql("a,b", "concat(CAST(s_suppkey AS VARCHAR), ',', '\"', s_name, chr(10), 'two \"\"q\"\"\"')", "supplier", "s_suppkey"))
def csv_quoted_breaks(spark, d):
    """Quoted line breaks, which no splittable line scan can hold."""
    line = F.expr("concat(s_suppkey, ',\"', s_name, '\n', 'two \"\"q\"\"\"')")
    return shown(pipeline.read(spark, written(spark, rendered(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), line.alias("value")), ["a,b"]), "a.csv"), "csv"))


# -- columnar files -----------------------------------------------------------------------------------------------


def _columnar(spark, d, fmt: str) -> Outcome:
    p = _t(spark, d, "part").select(F.col("p_partkey").cast("int").alias("key"), F.col("p_name").alias("name"), F.expr("concat('0', p_size)").alias("code"), F.expr("array(p_size, p_size + 1)").alias("sizes"), F.expr("named_struct('b', p_brand, 'n', cast(null as int))").alias("s"), F.expr("cast(p_name as binary)").alias("raw"), F.expr("date_add(date'2024-01-01', cast(p_partkey % 300 as int))").alias("day"), F.expr("p_size % 2 = 0").alias("even"), F.expr("cast(p_size as float) / 4").alias("f"))
    folder = f"{_scratch(spark)}/{uuid.uuid4().hex}/a.{fmt}"
    p.repartitionByRange(3, "key").sortWithinPartitions("key").write.format(fmt).save(folder)
    return pipeline.read(spark, folder, fmt)


_COLUMNAR = """SELECT CAST(p_partkey AS BIGINT) AS key, concat_ws(',', CAST(p_partkey AS VARCHAR), p_name, concat('0', CAST(p_size AS VARCHAR)), concat('"[', CAST(p_size AS VARCHAR), ', ', CAST(p_size + 1 AS VARCHAR), ']"'), concat('"{b: ', p_brand, ', n: }"'), lower(hex(encode(p_name))),
  strftime(DATE '2024-01-01' + CAST(p_partkey % 300 AS INTEGER), '%Y-%m-%d'), CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END, CASE WHEN p_size % 4 = 0 THEN CAST(p_size // 4 AS VARCHAR) ELSE CAST(p_size / 4 AS VARCHAR) END) AS line FROM part"""


def _keyed(out: Outcome) -> DataFrame:
    """Rows of columnar files come in no set order: by key instead of row."""
    return sinks.csv_lines(out.tables[0]).select(F.regexp_extract("value", "^([0-9]+),", 1).cast("long").alias("key"), F.col("value").alias("line"))


@query(_COLUMNAR)
def parquet_read(spark, d):
    return _keyed(_columnar(spark, d, "parquet"))


@query(_COLUMNAR)
def orc_read(spark, d):
    return _keyed(_columnar(spark, d, "orc"))


# -- binary files, one a block of rows ----------------------------------------------------------------------------


def parsed(rows: DataFrame, key: str, make: Callable, fmt: str, filename: str, options: dict | None = None) -> DataFrame:
    """(file, row, line): ``make(records)`` gives the bytes of a file for each FILE_ROWS keys; the reader's cells as a CSV line."""
    columns = [c for c in rows.columns if c != key]

    def run(p):
        import pandas as pd

        from grainworks.sources.files import parse

        got = parse(fmt, make(p.sort_values(key)[[key, *columns]].values.tolist()), filename, options or {})
        out = [(i, r, ",".join(_text(c, got.get("raw", False)) for c in row)) for i, t in enumerate(got["tables"]) for r, row in enumerate([t["headers"], *t["rows"]], -1) if r >= 0]
        heads = [(i, -1, ",".join(t["headers"])) for i, t in enumerate(got["tables"])]
        file = int(p[key].iloc[0]) // FILE_ROWS
        return pd.DataFrame([(file, *x) for x in heads + out], columns=["file", "tab", "row", "line"])

    return rows.groupBy(F.floor(F.col(key) / FILE_ROWS)).applyInPandas(run, "file long, tab long, row long, line string")


def _text(cell, raw: bool) -> str:
    if raw:
        return cell
    return "" if cell is None else "null" if cell[1] is None else ("true" if cell[1] else "false") if cell[0] == "bool" else f"{cell[1]:g}" if cell[0] == "float" else str(cell[1])


def _file_sql(header: str, line: str, table: str, key: str, file: str | None = None, where: str = "true") -> str:
    file = file or f"{key} // {FILE_ROWS}"
    rows = f"SELECT CAST({file} AS BIGINT) AS file, {key} AS k, {line} AS line FROM {table} WHERE {where}"
    return f"""SELECT file, CAST(0 AS BIGINT) AS tab, row_number() OVER (PARTITION BY file ORDER BY k) - 1 AS row, line FROM ({rows})
UNION ALL SELECT DISTINCT CAST({file} AS BIGINT), 0, -1, '{header}' FROM {table}"""


def xlsx_bytes(header: list[str], rows: list[list], title: str, footer: str, merged: list[str], styles: bool = False) -> bytes:
    """A workbook with a title above and a footer below the table; numbers as values, text as inline strings, None left out."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'

    def cell(r: int, c: int, v) -> str:
        ref = f"{chr(65 + c)}{r}"
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, tuple):  # a styled number
            return f'<c r="{ref}" s="1"><v>{v[0]}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'

    sheet = [[title], [], header, *rows, [footer]]
    body = "".join(f'<row r="{i}">' + "".join(cell(i, c, v) for c, v in enumerate(r)) + "</row>" for i, r in enumerate(sheet, 1) if r)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData><mergeCells>{''.join(f'<mergeCell ref="{m}"/>' for m in merged)}</mergeCells></worksheet>")
    return out.getvalue()


@query(_file_sql("id,name,name_2,seg,day,ok", """concat_ws(',', CAST(c_custkey AS VARCHAR), c_name, concat('00', CAST(c_nationkey AS VARCHAR)), concat('m', CAST((row_number() OVER (PARTITION BY c_custkey // 250 ORDER BY c_custkey) - 1) // 5 AS VARCHAR)), '2026-01-15 00:00:00', CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END)""", "customer", "c_custkey"))
def xlsx_read(spark, d):
    """Workbooks with junk around the table, repeated headers, merged cells, dates by style, booleans and codes as text."""

    def make(rows):
        out = [[int(k), name, f"00{nation}", f"m{i // 5}" if i % 5 == 0 else None, (46037,), k % 2 == 0] for i, (k, name, nation) in enumerate(rows)]
        return xlsx_bytes(["id", "name", "name", "seg", "day", "ok"], out, "Customers", "end", [f"D{4 + i}:D{4 + min(i + 5, len(out)) - 1}" for i in range(0, len(out), 5) if len(out) - i > 1])

    c = _t(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("n"))
    return parsed(c, "c_custkey", make, "xlsx", "a.xlsx")


@query(_file_sql("id,name,half,raw,gone", """concat_ws(',', CAST(c_custkey AS VARCHAR), c_name, CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_nationkey // 2 AS VARCHAR) ELSE concat(CAST(c_nationkey // 2 AS VARCHAR), '.5') END, concat('<blob: ', CAST(c_nationkey AS VARCHAR), ' bytes>'), '')""", "customer", "c_custkey"))
def sqlite_read(spark, d):
    """Databases with every storage class; an internal table is left out."""

    def make(rows):
        import sqlite3

        con = sqlite3.connect(":memory:")
        con.execute('CREATE TABLE "c t"(id INTEGER PRIMARY KEY AUTOINCREMENT, name TEXT, half REAL, raw BLOB, gone TEXT)')
        con.executemany('INSERT INTO "c t" VALUES (?, ?, ?, ?, NULL)', [(int(k), name, n / 2, bytes(int(n))) for k, name, n in rows])
        con.commit()
        return con.serialize()

    c = _t(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("n"))
    return parsed(c, "c_custkey", make, "sqlite", "a.db")


_AVRO_SCHEMA = {
    "type": "record", "name": "row",
    "fields": [
        {"name": "id", "type": "long"}, {"name": "name", "type": ["null", "string"]}, {"name": "half", "type": "double"}, {"name": "day", "type": {"type": "int", "logicalType": "date"}},
        {"name": "even", "type": "boolean"}, {"name": "mark", "type": {"type": "fixed", "name": "two", "size": 2}}, {"name": "kind", "type": {"type": "enum", "name": "kinds", "symbols": ["a", "b"]}},
        {"name": "tags", "type": {"type": "array", "items": "string"}},
    ],
}


def avro_bytes(rows: list[list], deflate: bool) -> bytes:
    """An object container file of (id, name, n) rows in blocks of 100."""
    import json
    import struct
    import zlib

    def number(n: int) -> bytes:
        n, out = (n << 1) ^ (n >> 63), b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    text = lambda s: number(len(s)) + s
    meta = {"avro.schema": json.dumps(_AVRO_SCHEMA).encode(), "avro.codec": b"deflate" if deflate else b"null"}
    out = b"Obj\x01" + number(len(meta)) + b"".join(text(k.encode()) + text(v) for k, v in meta.items()) + b"\0" + b"S" * 16
    for i in range(0, len(rows), 100):
        body = b""
        for k, name, n in rows[i : i + 100]:
            k, n = int(k), int(n)
            body += number(k) + (number(0) if k % 3 == 0 else number(1) + text(name.encode())) + struct.pack("<d", n / 2) + number(19723 + n) + bytes([k % 2 == 0]) + bytes([n, 255]) + number(n % 2) + number(2) + text(b"x") + text(b"y") + b"\0"
        if deflate:
            body = (c := zlib.compressobj(9, zlib.DEFLATED, -15)).compress(body) + c.flush()
        out += number(len(rows[i : i + 100])) + text(body) + b"S" * 16
    return out


@query(_file_sql("id,name,half,day,even,mark,kind,tags", """concat_ws(',', CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_nationkey // 2 AS VARCHAR) ELSE concat(CAST(c_nationkey // 2 AS VARCHAR), '.5') END,
  strftime(DATE '2024-01-01' + CAST(c_nationkey AS INTEGER), '%Y-%m-%d'), CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END, concat(lower(lpad(hex(c_nationkey), 2, '0')), 'ff'), CASE WHEN c_nationkey % 2 = 0 THEN 'a' ELSE 'b' END, 'Array([String("x"), String("y")])')""", "customer", "c_custkey"))
def avro_read(spark, d):
    """Container files of both codecs with unions, logical types, enums, fixed and nested values."""
    c = _t(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("n"))
    return parsed(c, "c_custkey", lambda rows: avro_bytes(rows, int(rows[0][0]) // FILE_ROWS % 2 == 1), "avro", "a.avro")


def pdf_bytes(lines: list[str]) -> bytes:
    """One page of text in a fixed-pitch font, 12 points a line."""
    text = f"BT /F1 10 Tf 12 TL 50 {12 * len(lines) + 50} Td " + " ".join(f"({x}) Tj T*" for x in lines) + " ET"
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", "<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", f"<< /Length {len(text)} >>\nstream\n{text}\nendstream", "<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>"]
    return ("%PDF-1.4\n" + "".join(f"{i + 1} 0 obj\n{o}\nendobj\n" for i, o in enumerate(objects)) + "trailer << /Root 1 0 R >>\n%%EOF").encode()


@query(_file_sql("id,segment,nation", "concat_ws(',', CAST(1000000 + c_custkey AS VARCHAR), c_mktsegment, concat('n', CAST(c_nationkey AS VARCHAR)))", "customer", "c_custkey"))
def pdf_read(spark, d):
    """Tables whose columns are told by their alignment."""

    def make(rows):
        return pdf_bytes([f"{'id':<10}{'segment':<14}{'nation'}", *[f"{1000000 + int(k):<10}{seg:<14}n{int(n)}" for k, seg, n in rows]])

    c = _t(spark, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").cast("long").alias("n"))
    return parsed(c, "c_custkey", make, "pdf", "a.pdf")


# -- detection, sinks, batches ------------------------------------------------------------------------------------

_KINDS = ["xlsx", "sqlite", "parquet", "avro", "pdf", "orc", "csv", "json", "ini", "fixed"]


@query("SELECT page_id, CASE page_id % 10 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END AS format FROM pages")
def magic_detect(spark, d):
    """Formats of contents without a telling name, by the engine's scores: leading or trailing bytes, or the shape of the text."""
    k = F.col("page_id") % 10
    body = F.col("html").cast("binary")
    number = F.col("page_id").cast("string")
    text = {6: F.concat_ws("\n", F.concat(number, F.lit(";b;c")), F.lit("1;2;3"), F.lit("4;5;6")), 7: F.concat(F.lit('[{"a": '), number, F.lit("}]")), 8: F.concat(F.lit("[s]\nkey = "), number, F.lit("\nother=2\n")), 9: F.concat_ws("\n", *[F.concat(F.lit(f"{x:<9}"), F.lpad(number, 8, "0"), F.lit(f"  {x}{x}")) for x in ("aa", "bb", "cc")])}
    content = F.when(k == 5, F.concat(body, F.unhex(F.lit("034F524317"))))
    for i, h in enumerate(["504B0304", "53514C69746520666F726D6174203300", "50415231", "4F626A01", "255044462D"]):
        content = content.when(k == i, F.concat(F.unhex(F.lit(h)), body))
    for i, t in text.items():
        content = content.when(k == i, t.cast("binary"))

    def run(batches):
        import pandas as pd

        from grainworks.functions.sniff import detect

        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "format": [(detect(bytes(x)) or (None,))[0] for x in b["content"]]})

    return _t(spark, d, "pages").select("page_id", content.alias("content")).mapInPandas(run, "page_id long, format string")


@query("""SELECT o_orderkey, concat('  {', chr(10), '    "a b": ', CAST(o_custkey AS VARCHAR), ',', chr(10), '    "half": ', CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE concat(CAST(o_custkey AS VARCHAR), '.5') END, ',', chr(10),
  '    "id": "say \\"', o_orderpriority, '\\""', chr(10), '  }') AS value FROM orders""")
def json_sink(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("_row"), F.expr("concat('say \"', o_orderpriority, '\"')").alias("c0"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") + 0.5).cast("double").alias("c1"), F.col("o_custkey").alias("c2"))
    return sinks.json_lines(Table(["id", "half", "a b"], o)).select(F.col("_row").alias("o_orderkey"), "value")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS DOUBLE) + CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 0 END END AS amount, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END AS amount_2, o_orderkey % 2 = 0 AS flag FROM orders""")
def parquet_sink(spark, d):
    """Cells narrowed to one type a column and written as Parquet: whole numbers and fractions to doubles, mixtures to text."""
    from grainworks.functions import cells

    o = _t(spark, d, "orders")
    c = [F.col("o_orderkey").cast("string"), F.expr("CASE WHEN o_orderkey % 3 <> 0 THEN concat(o_custkey, if(o_orderkey % 2 = 0, '.5', '')) END"), F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE string(o_custkey) END"), F.expr("if(o_orderkey % 2 = 0, 'Yes', 'no')")]
    t = Table(["id", "amount", "amount", "flag"], cells.inferred(o.withColumn("_row", F.col("o_orderkey")), {f"c{i}": x for i, x in enumerate(c)}, ["_row"]))
    folder = f"{_scratch(spark)}/{uuid.uuid4().hex}/out.parquet"
    sinks.write(t, folder, folder=True)
    return spark.read.parquet(folder)


@query("""SELECT * FROM (VALUES ('bad.json', NULL, CAST(0 AS BIGINT), CAST(0 AS BIGINT), true), ('n.csv', 'csv', CAST(25 AS BIGINT), CAST(25 AS BIGINT), false), ('n.json', 'json', CAST(5 AS BIGINT), CAST(5 AS BIGINT), false)) x(file, format, rows_in, rows_out, failed)""")
def batch_reports(spark, d):
    """A folder of files, each by itself: two that share a stem and one that is broken."""
    folder = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    local = folder.removeprefix("file:")
    import os

    os.makedirs(f"{local}/in")
    n, r = _t(spark, d, "nation").orderBy("n_nationkey").toPandas(), _t(spark, d, "region").orderBy("r_regionkey").toPandas()  # 25 and 5 rows at every scale
    n[["n_nationkey", "n_name"]].to_csv(f"{local}/in/n.csv", index=False)
    r[["r_regionkey", "r_name"]].to_json(f"{local}/in/n.json", orient="records")
    with open(f"{local}/in/bad.json", "w") as f:
        f.write('{"a": ')
    results = pipeline.batch(spark, f"{local}/in", f"{local}/out", output_format="json")
    assert sorted(os.listdir(f"{local}/out")) == ["n_csv.json", "n_json.json"]
    return pipeline.reports(spark, results).select(F.col("source_file").alias("file"), F.when(F.col("error").isNull(), F.col("detected_format")).alias("format"), "rows_in", "rows_out", F.col("error").isNotNull().alias("failed"))
