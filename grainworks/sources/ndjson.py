"""NDJSON as a splittable line scan: no task holds more than its part of the file.

One pass collects, partition by partition, the flattened keys and how many rows each partition makes; the second one
turns every record into cells in the order of the headers.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from grainworks.functions import cells
from grainworks.functions.sniff import nonblank
from grainworks.operators import shape
from grainworks.plans.model import Options, Outcome, ParseError, Report, Table

#: lines that decide whether a file without a telling name is NDJSON
LOOK = 20


def is_lines(spark: SparkSession, path: str, filename: str) -> bool:
    """By the name, or, where it tells nothing, two or more first lines that are objects by themselves."""
    name = filename.lower()
    if name.endswith((".ndjson", ".jsonl")):
        return True
    if name.endswith((".json", ".xml", ".yaml", ".yml")):
        return False
    from grainworks.sources.delimited import lines

    some = [r["value"].strip() for r in nonblank(lines(spark, path), "value").limit(LOOK).collect()]
    return len(some) >= 2 and all(x.startswith("{") and _parses(x) for x in some)


def _parses(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def flat(line: str, options: dict) -> list[dict]:
    from grainworks.sources.trees import flatten, json_tree

    try:
        return flatten(json_tree(line), options.get("separator", "."), options.get("array_join_sep", "; "), options.get("array_mode", "join") == "explode")
    except RecursionError:
        raise ValueError("nesting is too deep") from None


def read(spark: SparkSession, path: str, filename: str, options: Options) -> Outcome:
    from grainworks.sources.delimited import lines

    plain = dict(options)
    text = nonblank(lines(spark, path), "value")

    def profile(batches):
        import pandas as pd

        records = rows = 0
        keys: dict[str, int] = {}
        error = None
        for batch in batches:
            for line in batch["value"]:
                try:
                    made = flat(line.strip(), plain)
                except ValueError as e:
                    error = error or str(e)
                    continue
                records, rows = records + 1, rows + len(made)
                for row in made:
                    for k in row:
                        keys[k] = keys.get(k, 0) + 1
        yield pd.DataFrame({"records": [records], "rows": [rows], "error": [error], "keys": [list(keys)], "filled": [sum(keys.values())]})

    seen = text.mapInPandas(profile, "records long, rows long, error string, keys array<string>, filled long").select(F.spark_partition_id().alias("part"), "*")
    found = seen.select("part", "records", "rows", "error", "filled").collect()  # a row a partition
    if bad := next((r["error"] for r in found if r["error"]), None):
        raise ParseError("json", f"a line is no JSON: {bad}")
    headers = sorted(r["k"] for r in seen.select(F.explode("keys").alias("k")).distinct().collect())  # the table's columns
    report = Report(filename, "ndjson", sum(r["records"] for r in found), sum(r["rows"] for r in found))
    report.warning("ndjson support is experimental: flattening follows one simple documented rule")
    if report.rows_out != report.rows_in:
        report.info(f"{report.rows_in} record(s) made {report.rows_out} row(s), one for each list item")
    if sum(r["filled"] for r in found) != report.rows_out * len(headers):
        report.info("not every record has every field; absent ones are null")

    def typed(batches):
        import pyarrow as pa

        from grainworks.sources.files import arrow_cells

        for batch in batches:
            made = [[row.get(h) for h in headers] for line in batch.column(0).to_pylist() for row in flat(line.strip(), plain)]
            yield pa.RecordBatch.from_arrays([arrow_cells(made, False)], names=["fields"])

    rows = shape.ranked(text.mapInArrow(typed, f"fields array<{cells.CELL}>"), {r["part"]: r["rows"] for r in found})
    table = rows.select("_row", *[F.get("fields", F.lit(i)).alias(f"c{i}") for i in range(len(headers))])
    return Outcome([Table(headers, table, filename)], report)
