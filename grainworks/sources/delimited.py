"""Delimited text: JVM-side tokenising of a splittable line scan, with a per-file fallback for what lines cannot hold.

One job profiles a file: encoding, quotes that span lines, field counts and type votes, grouped by partition so that
row numbers need no shuffle.  The table is then one projection over the same scan.
"""

from __future__ import annotations

import csv
import io
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainworks.functions import cells
from grainworks.functions.encoding import decode
from grainworks.functions.sniff import DELIMITERS, best_delimiter, nonblank
from grainworks.operators import shape
from grainworks.operators.vote import Resolver, counted, rules, tallies, type_columns
from grainworks.plans.model import Options, Outcome, ParseError, Report, Table


#: what opening a file counts as when scans are cut: less than Spark's default, so that a file of a few MB keeps all cores busy
OPEN_COST = 512 << 10


_sessions: dict = {}


def own_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` that nobody changes later: a scan made in it has the same partitions whenever
    it runs, which row numbers by partition rely on.  There is one for each set of settings."""
    settings = {k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql.")}
    key = (spark.sparkContext.applicationId, OPEN_COST, tuple(sorted(settings.items())))
    if key not in _sessions:
        child = spark.newSession()
        for k, v in settings.items():
            if child.conf.isModifiable(k):
                child.conf.set(k, v)
        child.conf.set("spark.sql.files.openCostInBytes", OPEN_COST)
        child.conf.set("spark.sql.codegen.hugeMethodLimit", 8000)  # longer methods are never compiled by the JVM: wide tables are split instead
        _sessions[key] = child
    return _sessions[key]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of a file, without a byte order mark."""
    return own_session(spark).read.text(path).select(F.when(F.col("value").startswith("﻿"), F.substring("value", 2, 2147483647)).otherwise(F.col("value")).alias("value"))


def tokens(line: Column, delimiter: str) -> Column:
    """The fields of one line: a quoted field may hold delimiters and doubled quotes."""
    d = "\\" + delimiter if delimiter in "|" else "\\t" if delimiter == "\t" else delimiter
    plain = F.split(line, re.escape(delimiter) if delimiter in "|.^$*+?()[]{}\\" else delimiter, -1)
    # the delimiter that is put in front makes every field one match
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(rf'{d}("(?:[^"]|"")*"[^{d}]*|[^{d}]*)'), F.lit(1))
    unquote = lambda x: F.when(x.startswith('"'), F.concat(F.replace(F.regexp_extract(x, r'(?s)^"((?:[^"]|"")*)"', 1), F.lit('""'), F.lit('"')), F.regexp_extract(x, r'(?s)^"(?:[^"]|"")*"(.*)$', 1))).otherwise(x)
    return F.when(line.contains('"'), F.transform(found, unquote)).otherwise(plain)


def sample_lines(df: DataFrame, head: list[str], n: int = 30) -> list[str]:
    """Up to ``n`` non-blank lines: all, or the first and the last ones; ``head``: the first ``n`` + 1 lines that are not empty."""
    some = [x for x in head if x.strip()]
    if len(head) <= n:
        return some
    first = -(-n // 2)
    return some[:first] + [r[0] for r in nonblank(df, "value").tail(n - first)]


def chosen_delimiter(options: Options, sample, report: Report) -> str:
    given = options.get("delimiter")
    if given is not None and len(given.encode()) == 1:
        out = given
    else:
        if given is not None:
            report.warning(f"the delimiter '{given}' is not one byte; it is detected instead")
        out = best_delimiter(sample())
    report.info(f"detected delimiter: {out!r}")
    return out


def headers_of(first: list[str], width: int, has_header: bool) -> list[str]:
    names = [x.strip() for x in first] if has_header else []
    return shape.numbered(names + [f"column_{i + 1}" for i in range(len(names), width)])


def read(spark: SparkSession, path: str, filename: str, options: Options, resolver: Resolver = rules) -> Outcome:
    report = Report(filename, "csv")
    text = lines(spark, path)
    ids = text.withColumn("id", F.monotonically_increasing_id()).where("value <> ''")
    start = ids.limit(31).collect()
    if not start:
        raise ParseError("csv", "it holds no records")
    delimiter = chosen_delimiter(options, lambda: sample_lines(text, [r["value"] for r in start]), report)
    has_header = options.flag("has_header", True)
    rows = ids.withColumn("fields", tokens(F.col("value"), delimiter))
    first = next(csv.reader([start[0]["value"]], delimiter=delimiter))
    data = rows.where(F.col("id") > start[0]["id"]) if has_header else rows

    def profile(width: int):
        quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
        seen = data.select("fields", F.shiftright("id", 33).alias("part"), (F.size("fields") == width).alias("fit"), (F.col("value").contains('"') & (quotes % 2 == 1)).alias("odd"), (~F.is_valid_utf8("value")).alias("bad"))
        names = [f"c{i}" for i in range(width)]
        codes = cells.coded(seen, {c: F.get("fields", F.lit(i)) for i, c in enumerate(names)}, ["part", "fit", "odd", "bad"])
        return codes.groupBy("part").agg(F.count("*").alias("n"), *[F.count_if(k).alias(k) for k in ("fit", "odd", "bad")], *[t for c in names for t in tallies(c)]).collect()

    found = profile(len(first))
    if start[0]["value"].count('"') % 2 or sum(r["odd"] for r in found) or sum(r["bad"] for r in found) or "�" in start[0]["value"]:
        return _whole(spark, path, filename, options, report, resolver)
    total, fit = sum(r["n"] for r in found), sum(r["fit"] for r in found)
    width = len(first)
    if 2 * (fit + has_header) <= total + has_header:  # else no other width can be as frequent
        widths = Counter({r["w"]: r["n"] for r in data.groupBy(F.size("fields").alias("w")).agg(F.count("*").alias("n")).collect()})
        widths[len(first)] += has_header
        width = shape.modal_width(widths)
        if width != len(first):
            found = profile(width)
            fit = sum(r["fit"] for r in found)
    headers = headers_of(first, width, has_header)
    if total > fit:
        report.warning(shape.misfits(total - fit, width))
    counts = {k: sum(r[k] for r in found) for r0 in found[:1] for k in r0.asDict() if k[0] == "c"} or {c: 0 for c in _names(width)}
    for c in _names(len(headers)):
        counts.setdefault(c, 0)
    numbered = shape.ranked(data.drop("id"), {r["part"]: r["n"] for r in found})
    raw = numbered.select("_row", *[(F.get("fields", F.lit(i)) if i < width else F.lit(None).cast("string")).alias(f"c{i}") for i in range(len(headers))])
    report.rows_in = report.rows_out = total
    return Outcome([Table(headers, type_columns(raw, headers, counts, report, resolver), filename)], report)


def _names(width: int) -> list[str]:
    return [f"c{i}_{k}" for i in range(width) for k in ("total", "Integer", "Float", "Boolean", "Date", "real")]


def records(text: str, delimiter: str) -> list[list[str]]:
    """All records of a text in memory, quotes over several lines included; blank lines are dropped."""
    csv.field_size_limit(1 << 30)
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r]


def _whole(spark: SparkSession, path: str, filename: str, options: Options, report: Report, resolver: Resolver) -> Outcome:
    """A file that lines cannot represent is tokenised by one task from its bytes."""
    given = options.get("delimiter")

    def parse(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                body, label = decode(bytes(content))
                d = given if given is not None and len(given.encode()) == 1 else best_delimiter(_sampled(body))
                rows = records(body, d)
                for i in range(0, len(rows), 50_000):
                    yield pd.DataFrame({"id": range(i, min(len(rows), i + 50_000)), "fields": rows[i : i + 50_000], "label": label})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "id long, fields array<string>, label string").persist()
    first = rows.where("id = 0").first()
    if first is None:
        raise ParseError("csv", "it holds no records")
    if first["label"] != "UTF-8":
        report.warning(f"the bytes are not UTF-8 and were read as {first['label']}")
    has_header = options.flag("has_header", True)
    widths = Counter({r["w"]: r["n"] for r in rows.groupBy(F.size("fields").alias("w")).agg(F.count("*").alias("n")).collect()})
    width = shape.modal_width(widths)
    headers = headers_of(first["fields"], width, has_header)
    data = rows.where("id > 0") if has_header else rows
    misfit = sum(n for w, n in widths.items() if w != width) - (has_header and len(first["fields"]) != width)
    if misfit:
        report.warning(shape.misfits(misfit, width))
    raw = data.select((F.col("id") - int(has_header)).alias("_row"), *[(F.get("fields", F.lit(i)) if i < width else F.lit(None).cast("string")).alias(f"c{i}") for i in range(len(headers))])
    counts = counted(raw, [f"c{i}" for i in range(len(headers))])
    report.rows_in = report.rows_out = counts["n"]
    return Outcome([Table(headers, type_columns(raw, headers, counts, report, resolver), filename)], report)


def _sampled(text: str, n: int = 30) -> list[str]:
    some = [x for x in text.splitlines() if x.strip()]
    return some if len(some) <= n else some[: -(-n // 2)] + some[len(some) - n // 2 :]


__all__ = ["DELIMITERS", "lines", "read", "records", "sample_lines", "tokens"]
