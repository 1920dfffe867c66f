"""Cleaning: detect, read, check, write; for one file, a folder, or as a bounded stream."""

from __future__ import annotations

import difflib
import os
import re
import shutil
import tempfile
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from grainworks.functions import sniff
from grainworks.operators.validate import Schema, issues
from grainworks.operators.vote import Resolver, rules
from grainworks.plans import sinks
from grainworks.plans.model import EngineError, Options, Outcome, Report, SchemaRejected, UnknownFormat

#: format -> reader(spark, path, filename, options, resolver) -> Outcome; ``register`` adds more
READERS: dict = {}
#: extra formats' scores: format -> score(content, filename)
SNIFFERS: dict = {}


def register(name: str, reader, score) -> None:
    """A new format; of equal scores the one registered last wins."""
    READERS[name], SNIFFERS[name] = reader, score


def _builtin(name: str):
    from grainworks.sources import columnar, delimited, files, lines

    if name == "csv":
        return delimited.read
    if name == "fixed":
        return lines.read
    if name in ("orc", "parquet"):
        return lambda spark, path, filename, options, resolver: columnar.read(spark, path, filename, options, name)
    if name in ("json", "ini", "xlsx", "sqlite", "avro", "pdf"):
        return lambda spark, path, filename, options, resolver: files.read(spark, path, filename, options, name, resolver)
    raise UnknownFormat(f"there is no reader called '{name}'")


def detect_files(spark: SparkSession, path: str):
    """(path, format, score) of every file at ``path``: scored where the bytes are, a row a file."""
    extra = dict(SNIFFERS)

    def score(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for p, content in zip(batch["path"], batch["content"]):
                name = p.rsplit("/", 1)[-1]
                ranked = list(sniff.scores(bytes(content), name).items()) + [(f, s(bytes(content), name)) for f, s in extra.items()]
                best = max(((s, i, f) for i, (f, s) in enumerate(ranked) if s > 0), default=(0.0, 0, None))
                out.append((p, best[2], float(best[0])))
            yield pd.DataFrame(out, columns=["path", "format", "score"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(score, "path string, format string, score double")


#: files up to the first size are read at once to detect their format; larger ones only where a part cannot tell, and no format
#: that must be read as a whole can be read beyond the second one
AT_ONCE, MOST_WHOLE = 64 << 20, 2 << 30


def detect(path: str, spark: SparkSession | None = None) -> tuple[str, float]:
    """The format of one file: from its bytes if it is local, else where Spark can read it."""
    local = path.removeprefix("file:")
    if os.path.exists(local):
        size = os.path.getsize(local)
        with open(local, "rb") as f:
            content = f.read() if size <= AT_ONCE else _sample(f, size)
            if AT_ONCE < size < MOST_WHOLE and sniff.needs_whole(content, os.path.basename(path)):
                f.seek(0)
                content = f.read()
        ranked = list(sniff.scores(content, os.path.basename(path)).items()) + [(n, s(content, os.path.basename(path))) for n, s in SNIFFERS.items()]
        best = max(((s, i, f) for i, (f, s) in enumerate(ranked) if s > 0), default=None)
        if best is None:
            raise UnknownFormat(f"no known format fits {path}")
        return best[2], best[0]
    row = detect_files(spark, path).first()
    if row is None or row["format"] is None:
        raise UnknownFormat(f"no known format fits {path}")
    return row["format"], row["score"]


def _sample(f, size: int) -> bytes:
    third = sniff.SAMPLE // 3
    out = f.read(third)
    f.seek(size // 2 - third // 2)
    out += b"\n" + f.read(third) + b"\n"
    f.seek(size - third)
    return out + f.read(third)


def read(spark: SparkSession, path: str, fmt: str | None = None, options: dict | None = None, resolver: Resolver = rules) -> Outcome:
    """The tables and the report of one file."""
    fmt = fmt or detect(path, spark)[0]
    reader = READERS.get(fmt) or _builtin(fmt)
    return reader(spark, _visible(spark, path), os.path.basename(path), Options(options or {}), resolver)


def _visible(spark: SparkSession, path: str) -> str:
    """Spark's readers skip names that start with a dot or an underscore: such a file is read from a copy."""
    local, name = path.removeprefix("file:"), os.path.basename(path)
    if name[:1] not in (".", "_") or not os.path.isfile(local):
        return path
    base = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file:")
    to = os.path.join(tempfile.mkdtemp(prefix="hidden-", dir=base if os.path.isdir(base) else None), f"x{name}")
    shutil.copyfile(local, to)
    return to


@dataclass
class Result:
    report: Report
    written: list[str] = field(default_factory=list)
    error: str | None = None
    preview: str | None = None


def names(output: str, outcome: Outcome) -> list[str]:
    """One path a table: the output itself, or with the table's name before the extension."""
    if len(outcome.tables) == 1:
        return [output]
    stem, ext = os.path.splitext(output)
    return [f"{stem}_{re.sub(r'[\W_]', '_', t.source or str(i))}{ext}" for i, t in enumerate(outcome.tables)]


def clean(spark: SparkSession, path: str, output: str | None = None, *, fmt: str | None = None, options: dict | None = None, output_format: str | None = None, schema: Schema | None = None, on_violation: str = "warn", report_path: str | None = None, dry_run: bool = False, stream: bool = False, parts: bool | None = None, resolver: Resolver = rules) -> Result:
    """One file from messy bytes to typed tables on disk; ``parts``: a folder of part files instead of one file."""
    stem = os.path.splitext(path)[0]
    output = output or f"{stem}.clean.{output_format or 'csv'}"
    kind = sinks.output_format(output, output_format)
    fallback = None
    if stream:
        fmt = fmt or detect(path, spark)[0]
        if fmt == "csv" and kind == "csv" and schema is None and not dry_run:
            from grainworks.streaming.clean import stream_clean

            result = Result(stream_clean(spark, path, output, options), [output])
            if report_path:
                _write(report_path, result.report.to_json())
            return result
        fallback = "streaming is for CSV to CSV without a schema or a dry run; read in full instead"
    outcome = read(spark, path, fmt, options, resolver)
    if fallback:
        outcome.report.warning(fallback)
    if report_path:
        _write(report_path, outcome.report.to_json())
    result = Result(outcome.report)
    if schema is not None:
        for t in outcome.tables:
            found = issues(t, schema).cache()
            n = found.count()
            for r in found.orderBy("place", "row").limit(20).collect():
                outcome.report.warning(f"schema: {'' if r['row'] is None else f'row {r['row']}, '}column '{r['column']}': {r['message']}")
            found.unpersist()
            if n and on_violation == "reject":
                raise SchemaRejected(f"{path}: {n} schema violation(s); nothing was written")
    shown = []
    for t, to in zip(outcome.tables, names(output, outcome)):
        if dry_run:
            shown.append(preview(t, to, kind))
        else:
            sinks.write(t, to, kind, parts)
            result.written.append(to)
    outcome.release()
    result.preview = "\n".join(shown) if dry_run else None
    return result


def preview(table, path: str, kind: str) -> str:
    """What a write would change: nothing, a line diff, or the first lines of a new file."""
    if kind == "parquet":
        return f"{path}: parquet output has no text preview"
    new = sinks.text_lines(table, kind)
    if not os.path.exists(path):
        return "\n".join([f"{path}: would be created", *new[:6]])
    with open(path, encoding="utf-8", errors="replace") as f:
        old = f.read().splitlines()
    if old == new:
        return f"{path}: unchanged"
    changes = [x for x in difflib.unified_diff(old, new, "old", "new", lineterm="", n=0) if x[0] in "+-" and x[:3] not in ("+++", "---")]
    return "\n".join([f"{path}: {len(changes)} changed line(s)", *changes[:40]])


def _write(path: str, text: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def batch(spark: SparkSession, folder: str, output: str, *, output_format: str = "csv", workers: int = 4, report_dir: str | None = None, **more) -> list[Result]:
    """Every file of a folder, each by itself: a failing file is an error of its own; jobs of several files run side by side.

    ``report_dir`` gets a report for each file that could be read, named after its output.
    """
    for d in (output, report_dir):
        if d:
            os.makedirs(d, exist_ok=True)
    entries = sorted(os.listdir(folder))
    files = [f for f in entries if os.path.isfile(os.path.join(folder, f))]
    stems = Counter(os.path.splitext(f)[0] for f in files)

    def one(name: str) -> Result:
        stem, ext = os.path.splitext(name)
        to = f"{stem}_{ext[1:]}" if stems[stem] > 1 else stem
        try:
            return clean(spark, os.path.join(folder, name), os.path.join(output, f"{to}.{output_format}"), output_format=output_format, report_path=os.path.join(report_dir, f"{to}.report.json") if report_dir else None, **more)
        except EngineError as e:
            return Result(Report(name, "error"), error=str(e))
        except Exception as e:  # noqa: BLE001  one file must not stop the others
            return Result(Report(name, "error"), error=f"{type(e).__name__}: {str(e).splitlines()[0]}")

    with ThreadPoolExecutor(workers) as pool:
        out = list(pool.map(one, files))
    for skipped in set(entries) - set(files):
        out.append(Result(Report(skipped, "folder", notes=[]), error=None))
        out[-1].report.warning("subfolders are not entered")
    return out


def reports(spark: SparkSession, results: list[Result]):
    """Reports as a DataFrame."""
    rows = [(r.report.source_file, r.report.detected_format, r.report.rows_in, r.report.rows_out, [(n.severity, n.message) for n in r.report.notes], r.error) for r in results]
    return spark.createDataFrame(rows, "source_file string, detected_format string, rows_in long, rows_out long, notes array<struct<severity:string,message:string>>, error string")


def rollup(df):
    return df.groupBy("detected_format").agg(F.count("*").alias("files"), F.sum("rows_in").alias("rows_in"), F.sum("rows_out").alias("rows_out"))
