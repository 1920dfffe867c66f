"""CSV to CSV in bounded memory: data cells as they are, only field counts repaired.

Delimiter, header and width come from the start of the input, which is all that a stream can know.
``stream_clean`` runs over one file, ``stream_folder`` over a growing folder with Structured Streaming.
"""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainworks.functions.sniff import best_delimiter, picked
from grainworks.operators.shape import misfits
from grainworks.plans.model import Options, Report
from grainworks.plans.sinks import csv_header, quoted
from grainworks.sources.delimited import lines, records, tokens

PREFIX = 64 << 10


def _prefix(path: str) -> bytes:
    with open(path.removeprefix("file:"), "rb") as f:
        return f.read(PREFIX).removeprefix(b"\xef\xbb\xbf")


def fitted(fields, width: int):
    """Exactly ``width`` fields: shorter rows get empty ones, longer rows lose the rest."""
    return [F.coalesce(F.get(fields, F.lit(i)), F.lit("")) for i in range(width)]


def rendered(df: DataFrame, delimiter: str, width: int) -> DataFrame:
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    odd = F.col("value").contains('"') & (quotes % 2 == 1)
    fields = df.select(tokens(F.col("value"), delimiter).alias("f"), odd.alias("odd"))
    return fields.select(F.concat_ws(",", *[quoted(c, width == 1) for c in fitted(F.col("f"), width)]).alias("value"), F.size("f").alias("n"), "odd")


def stream_clean(spark: SparkSession, path: str, output: str, options: dict | None = None) -> Report:
    options, name = Options(options or {}), os.path.basename(path)
    head = _prefix(path)
    try:
        text = head.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.start < len(head) - 3 or len(head) < PREFIX - 3:  # a character cut by the end of the prefix is no reason
            return _whole(spark, path, output, options)
        text = head[: e.start].decode("utf-8")
    report = Report(name, "csv")
    given = options.get("delimiter")
    if given is not None and len(given.encode()) != 1:
        report.warning(f"the delimiter '{given}' is not one byte; it is detected instead")
        given = None
    delimiter = given or best_delimiter(picked(text, 30))
    report.info(f"detected delimiter: {delimiter!r}")
    report.info("read as a stream, a record at a time")
    start = records(text, delimiter)
    if not start:
        open(output, "w").close()
        return report
    has_header = options.flag("has_header", True)
    width = len(start[0])
    ids = lines(spark, path).withColumn("id", F.monotonically_increasing_id()).where("value <> ''")
    first = ids.limit(1).first()
    if first["value"].count('"') % 2:
        return _records(path, output, delimiter, width, has_header, report)
    data = ids.where(F.col("id") > first["id"]) if has_header else ids
    rows, misfit, odd = F.count("*"), F.count_if(F.col("n") != width), F.count_if(F.col("odd"))
    # the counts come from the write itself; a quoted line break shows in them as an odd number of quotes
    from pyspark.sql import Observation

    seen = Observation(uuid.uuid4().hex)
    made = rendered(data.select("value"), delimiter, width)
    made = made.observe(seen, rows.alias("rows"), misfit.alias("misfit"), odd.alias("odd"))
    folder = f"{output}.parts-{uuid.uuid4().hex[:8]}"
    made.select("value").write.text(folder)
    if seen.get["odd"]:
        shutil.rmtree(folder)
        return _records(path, output, delimiter, width, has_header, report)
    with open(output, "wb") as out:
        if has_header:
            out.write((csv_header([h.strip() for h in start[0]]) + "\n").encode())
        for p in sorted(os.listdir(folder)):
            if p.startswith("part-"):
                with open(f"{folder}/{p}", "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 20)
    shutil.rmtree(folder)
    report.rows_in = report.rows_out = seen.get["rows"]
    _misfit(report, seen.get["misfit"], width)
    return report


def _misfit(report: Report, n: int, width: int) -> None:
    if n:
        report.warning(misfits(n, width))


def _records(path: str, output: str, delimiter: str, width: int, has_header: bool, report: Report) -> Report:
    """Quoted fields over several lines: one pass, one record in memory at a time."""
    import csv

    n = misfit = 0
    with open(path.removeprefix("file:"), encoding="utf-8-sig", newline="") as f, open(output, "w", encoding="utf-8", newline="") as out:
        for row in csv.reader(f, delimiter=delimiter):
            if not row:
                continue
            if has_header and report.rows_in == 0 and n == 0 and misfit == 0 and not out.tell():
                out.write(csv_header([h.strip() for h in row]) + "\n")
                continue
            n += 1
            misfit += len(row) != width
            out.write(csv_header((row + [""] * width)[:width]) + "\n")
    report.rows_in = report.rows_out = n
    _misfit(report, misfit, width)
    return report


def _whole(spark: SparkSession, path: str, output: str, options: Options) -> Report:
    from grainworks.plans import sinks
    from grainworks.sources import delimited

    outcome = delimited.read(spark, path, os.path.basename(path), options)
    outcome.report.warning("the bytes are not UTF-8; the file was read in full, since only its content tells the encoding")
    sinks.write(outcome.tables[0], output, "csv")
    return outcome.report


def stream_folder(spark: SparkSession, folder: str, output: str, checkpoint: str, delimiter: str, header: list[str], available_now: bool = True):
    """A query that cleans every CSV file that appears in ``folder`` into parts in ``output``; all files share ``header``."""
    source = spark.readStream.text(folder)
    title = delimiter.join(header)
    rows = source.where((F.col("value") != "") & (F.regexp_replace("value", "^﻿", "") != title))
    made = rendered(rows, delimiter, len(header)).select("value")
    writer = made.writeStream.format("text").option("checkpointLocation", checkpoint).option("path", output)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
