"""Whole-file formats: parsed where the file's bytes are read, returned as rows of cells."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from grainworks.functions import cells
from grainworks.operators.vote import Resolver, counted, rules, type_columns
from grainworks.plans.model import Options, Outcome, ParseError, Report, Table
from grainworks.sources import ndjson, xmlscan

SCHEMA = f"kind string, t int, _row long, fields array<{cells.CELL}>, note string"


def parse(fmt: str, content: bytes, filename: str, options: dict) -> dict:
    """The tables of one file; every failure is a ValueError."""
    from grainworks.functions.encoding import lossy
    from grainworks.functions.sniff import json_kind
    from grainworks.sources import avro, ini, pdf, sqlite, trees, xlsx

    try:
        if fmt == "json":
            kind = json_kind(content, filename)
            if kind is None:
                raise ValueError("its content reads as no JSON, XML or YAML")
            return trees.read(kind, lossy(content), options)
        if fmt == "ini":
            return ini.read(lossy(content), filename, options)
        return {"xlsx": xlsx, "sqlite": sqlite, "avro": avro, "pdf": pdf}[fmt].read(content, filename, options)
    except ValueError:
        raise
    except Exception as e:  # noqa: BLE001  a broken file must be an error of this file, whatever a decoder runs into
        raise ValueError(f"the file is corrupt or malformed ({type(e).__name__}: {e})") from None


def arrow_cells(rows: list[list], raw: bool):
    """Rows of cells as an Arrow list column of SCHEMA's ``fields``."""
    import numpy as np
    import pyarrow as pa

    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    flat = [c for r in rows for c in r]
    if raw:
        kinds, values = ["text"] * len(flat), {"text": flat}
        blank = np.zeros(len(flat), bool)
    else:
        kinds = [None if c is None else c[0] for c in flat]
        values = {k: [c[1] if c is not None and c[0] == k else None for c in flat] for k in ("bool", "int", "float", "text")}
        blank = np.array([c is None for c in flat], bool)
    types = {"bool": pa.bool_(), "int": pa.int64(), "float": pa.float64(), "text": pa.string()}
    parts = [pa.array(kinds, pa.string()), *[pa.array(values[k], t) if k in values else pa.nulls(len(flat), t) for k, t in types.items()]]
    cell = pa.StructArray.from_arrays(parts, names=["k", "b", "i", "f", "s"], mask=pa.array(blank))
    return pa.ListArray.from_arrays(pa.array(ends), cell)


def read(spark: SparkSession, path: str, filename: str, options: Options, fmt: str, resolver: Resolver = rules) -> Outcome:
    plain = dict(options)
    if fmt == "json" and ndjson.is_lines(spark, path, filename):
        return ndjson.read(spark, path, filename, options)
    if fmt == "json" and (size := xmlscan.large(spark, path, filename)) and (outcome := xmlscan.read(spark, path, filename, options, size)) is not None:
        return outcome

    def run(batches):
        import pyarrow as pa

        def frame(kind, t, rows, fields, notes):
            n = len(notes)
            return pa.RecordBatch.from_arrays([pa.array([kind] * n), pa.array([t] * n, pa.int32()), pa.array(rows, pa.int64()), fields, pa.array(notes, pa.string())], names=["kind", "t", "_row", "fields", "note"])

        for batch in batches:
            for content in batch.column(0):
                try:
                    got = parse(fmt, content.as_py(), filename, plain)
                except ValueError as e:
                    yield frame("error", 0, [0], arrow_cells([[]], False), [str(e)])
                    continue
                raw = got.get("raw", False)
                meta = {"label": got["label"], "notes": got["notes"], "rows_in": got["rows_in"], "raw": raw, "tables": [{"source": t["source"], "headers": t["headers"], "rows": len(t["rows"])} for t in got["tables"]]}
                yield frame("meta", 0, [0], arrow_cells([[]], False), [json.dumps(meta)])
                for i, t in enumerate(got["tables"]):
                    for k in range(0, len(t["rows"]), 10_000):
                        some = t["rows"][k : k + 10_000]
                        yield frame("row", i, range(k, k + len(some)), arrow_cells(some, raw), [None] * len(some))

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA).persist()
    heads = found.where("kind <> 'row'").select("kind", "note").collect()
    if not heads or heads[0]["kind"] == "error":
        found.unpersist()
        raise ParseError(fmt, heads[0]["note"] if heads else "the file is empty")
    meta = json.loads(heads[0]["note"])
    report = Report(filename, meta["label"], rows_in=meta["rows_in"], rows_out=sum(t["rows"] for t in meta["tables"]))
    for severity, message in meta["notes"]:
        (report.warning if severity == "warning" else report.info)(message)
    tables = []
    for i, t in enumerate(meta["tables"]):
        own, headers = found.where(f"kind = 'row' and t = {i}"), t["headers"]
        cell = [F.get("fields", F.lit(j)) for j in range(len(headers))]
        if meta["raw"]:
            raw = own.select("_row", *[c["s"].alias(f"c{j}") for j, c in enumerate(cell)])
            counts = counted(raw, [f"c{j}" for j in range(len(headers))])
            df = type_columns(raw, headers, counts, report, resolver)
        else:
            df = own.select("_row", *[c.alias(f"c{j}") for j, c in enumerate(cell)])
        tables.append(Table(headers, df, t["source"] or filename))
    return Outcome(tables, report, [found])
