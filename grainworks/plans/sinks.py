"""Sinks: CSV, JSON and typed Parquet, as folders of parts or as single files."""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainworks.functions import cells
from grainworks.plans.model import ExportError, Table


def quoted(c: Column, alone: bool = False) -> Column:
    """A CSV field, quoted only where it must be."""
    need = c.rlike('[",\n\r]')
    if alone:
        need = need | (c == "")
    return F.when(need, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_header(headers: list[str]) -> str:
    need = lambda h: bool(re.search('[",\n\r]', h)) or (h == "" and len(headers) == 1)
    return ",".join('"' + h.replace('"', '""') + '"' if need(h) else h for h in headers)


def csv_lines(table: Table) -> DataFrame:
    kinds = {f.name: f.dataType for f in table.df.schema.fields}
    cols = table.columns()
    return table.df.select("_row", F.concat_ws(",", *[quoted(cells.export_text(F.col(c), kinds[c]), len(cols) == 1) for c in cols]).alias("value"))


def json_lines(table: Table) -> DataFrame:
    """One pretty-printed object a row, without the comma between rows; of equal headers the last one's value stays."""
    kinds = {f.name: f.dataType for f in table.df.schema.fields}
    last = dict(zip(table.headers, table.columns()))
    pairs = [F.concat(F.lit("    " + json.dumps(h, ensure_ascii=False) + ": "), cells.json_text(F.col(c), kinds[c])) for h, c in sorted(last.items())]
    body = F.concat(F.lit("  {\n"), F.concat_ws(",\n", *pairs), F.lit("\n  }")) if pairs else F.lit("  {}")
    return table.df.select("_row", body.alias("value"))


def column_plan(table: Table) -> list[str]:
    """int, float, bool or text for each column: one aggregate over the cell columns, none for plain ones."""
    kinds = {f.name: f.dataType for f in table.df.schema.fields}
    mixed = [c for c in table.columns() if cells.is_cell(kinds[c])]
    tests = [e for c in mixed for e in (F.count_if(F.col(c).isNotNull()).alias(f"{c}_n"), *[F.count_if(F.col(c)["k"] == k).alias(f"{c}_{k}") for k in ("int", "float", "bool")])]
    row = table.df.agg(*tests).first() if tests else {}

    def one(c: str) -> str:
        if not cells.is_cell(kinds[c]):
            return {"bigint": "int", "double": "float", "boolean": "bool"}.get(kinds[c].simpleString(), "text")
        n = row[f"{c}_n"]
        return "text" if not n else "int" if row[f"{c}_int"] == n else "float" if row[f"{c}_int"] + row[f"{c}_float"] == n else "bool" if row[f"{c}_bool"] == n else "text"

    return [one(c) for c in table.columns()]


def typed(table: Table) -> DataFrame:
    """Columns narrowed by their plan, under unique header names."""
    from grainworks.operators.shape import unique

    kinds = {f.name: f.dataType for f in table.df.schema.fields}

    def one(c: str, plan: str) -> Column:
        x, t = F.col(c), kinds[c]
        if not cells.is_cell(t):
            return x
        if plan == "float":
            return F.coalesce(x["f"], x["i"].cast("double"))
        return F.when(x.isNotNull(), cells.export_text(x, t)) if plan == "text" else cells.unpacked(x, plan)

    return table.df.select(*[one(c, p).alias(h) for c, p, h in zip(table.columns(), column_plan(table), unique(table.headers))])


def output_format(path: str, given: str | None = None) -> str:
    return given or {".json": "json", ".parquet": "parquet"}.get(os.path.splitext(path)[1].lower(), "csv")


def parts(df: DataFrame, path: str, fmt: str) -> list[str]:
    """Parallel part files in a folder beside ``path``, in row order."""
    folder = f"{path}.parts-{uuid.uuid4().hex[:8]}"
    if fmt == "parquet":
        df.coalesce(1).write.option("compression", "snappy").parquet(folder)
    else:
        df.select("value").write.option("lineSep", "\n" if fmt == "csv" else ",\n").text(folder)
    local = folder.removeprefix("file:")
    return [f"{local}/{f}" for f in sorted(os.listdir(local)) if f.startswith("part-")]


def is_local(path: str) -> bool:
    """On a disk that the driver sees as files."""
    return "://" not in path or path.startswith("file:")


def write(table: Table, path: str, fmt: str | None = None, folder: bool | None = None) -> None:
    """A folder of parts, or one file at ``path``.

    Without ``folder`` being said, a path of a distributed file system gets the folder, which every executor writes its part
    of; only a path on the driver's disk gets one file, joined from parts there.
    """
    folder = not is_local(path) if folder is None else folder
    fmt = output_format(path, fmt)
    if fmt not in ("csv", "json", "parquet"):
        raise ExportError(f"unknown output format '{fmt}'")
    spark = table.df.sparkSession
    case = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")  # headers that differ in case only are different columns
    try:
        df = typed(table) if fmt == "parquet" else csv_lines(table) if fmt == "csv" else json_lines(table)
        if folder:
            (df.write.mode("overwrite").parquet(path) if fmt == "parquet" else df.select("value").write.mode("overwrite").text(path))
            return
        made = parts(df, path, fmt)
        _joined(made, path, fmt, table)
        shutil.rmtree(os.path.dirname(made[0]) if made else f"{path}.none", ignore_errors=True)
    finally:
        spark.conf.set("spark.sql.caseSensitive", case)


def text_lines(table: Table, fmt: str) -> list[str]:
    """The lines of the one file that ``write`` would make, for a preview on the driver."""
    rows = (csv_lines if fmt == "csv" else json_lines)(table).select("value")
    made = [r["value"] for r in rows.toLocalIterator()]
    text = "\n".join([csv_header(table.headers), *made]) if fmt == "csv" else "[\n" + ",\n".join(made) + "\n]" if made else "[]"
    return text.splitlines()


def _joined(made: list[str], path: str, fmt: str, table: Table) -> None:
    if fmt == "parquet":
        shutil.move(made[0], path)
        return
    with open(path, "wb") as out:
        out.write((csv_header(table.headers) + "\n").encode() if fmt == "csv" else b"[\n")
        start = out.tell()
        for p in made:
            with open(p, "rb") as part:
                shutil.copyfileobj(part, out, 1 << 20)
        if fmt == "json":
            if out.tell() > start:
                out.truncate(out.tell() - 2)
                out.seek(0, 2)
                out.write(b"\n]")
            else:
                out.seek(0)
                out.truncate()
                out.write(b"[]")
