"""Command line: ``python -m grainworks clean INPUT -o OUTPUT`` and ``python -m grainworks detect INPUT``."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import tomllib

from grainworks.plans.model import EngineError

#: read from the working folder where no config is named
CONFIG_FILE = "grainworks.toml"
CONFIG_KEYS = ("delimiter", "format", "output_format", "array_mode", "separator", "array_join_sep", "mode", "sheet", "table", "schema", "on_violation", "report", "report_dir")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="grainworks", description="Turn messy data files into clean typed tables.")
    p.add_argument("--log-format", choices=["text", "json"], default="text")
    p.add_argument("--verbose", action="store_true", help="show every note")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("clean")
    c.add_argument("input", nargs="?")
    c.add_argument("-o", "--output")
    c.add_argument("--batch", metavar="DIR")
    c.add_argument("--config", metavar="TOML")
    c.add_argument("--format")
    c.add_argument("--output-format", choices=["csv", "json", "parquet"])
    c.add_argument("--delimiter")
    header = c.add_mutually_exclusive_group()
    header.add_argument("--no-header", action="store_true", help="CSV: the first record is data")
    header.add_argument("--has-header", action="store_true", help="fixed-width: the first line is a header")
    c.add_argument("--mode", choices=["fixed", "whitespace"])
    c.add_argument("--sheet")
    c.add_argument("--table")
    fill = c.add_mutually_exclusive_group()
    fill.add_argument("--merge-fill", action="store_true", help="Excel: merged regions are filled (the default)")
    fill.add_argument("--no-merge-fill", action="store_true")
    c.add_argument("--array-mode", choices=["join", "explode"])
    c.add_argument("--separator")
    c.add_argument("--array-join-sep")
    c.add_argument("--schema", metavar="JSON")
    c.add_argument("--on-violation", choices=["warn", "reject"])
    c.add_argument("--report", metavar="JSON")
    c.add_argument("--report-dir", metavar="DIR", help="with --batch: a report for each file")
    c.add_argument("--parts", action="store_true", help="write folders of part files")
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--stream", action="store_true")
    d = sub.add_parser("detect")
    d.add_argument("input")
    return p


def merged(args: argparse.Namespace) -> dict:
    """Command line over the config's ``[defaults]``; switches are on if either side turns them on.

    A config that is named must be there; the one in the working folder may be absent.
    """
    found: dict = {}
    config = args.config or (CONFIG_FILE if os.path.exists(CONFIG_FILE) else None)
    if config:
        try:
            with open(config, "rb") as f:
                found = tomllib.load(f).get("defaults", {})
        except (OSError, tomllib.TOMLDecodeError) as e:
            raise EngineError(f"cannot read the config: {e}") from None
    out = {k: getattr(args, k) if getattr(args, k) is not None else found.get(k) for k in CONFIG_KEYS}
    for k in ("no_header", "has_header", "merge_fill", "no_merge_fill", "dry_run", "stream", "parts"):
        out[k] = getattr(args, k) or bool(found.get(k, False))
    # a switch of the command line undoes its opposite in the config
    for on, off in (("has_header", "no_header"), ("merge_fill", "no_merge_fill")):
        out[off] = out[off] and not getattr(args, on)
        out[on] = out[on] and not getattr(args, off)
    return out


def options_of(o: dict) -> dict[str, str]:
    out = {k: o[k] for k in ("delimiter", "array_mode", "separator", "array_join_sep", "mode", "sheet", "table") if o.get(k) is not None}
    if o["no_header"]:
        out["has_header"] = "false"
    elif o["has_header"]:
        out["has_header"] = "true"
    if o["no_merge_fill"]:
        out["merge_fill"] = "false"
    return out


def loggers(kind: str) -> logging.Logger:
    """Information to stdout, warnings and errors to stderr."""
    log = logging.getLogger("grainworks")
    log.handlers.clear()
    log.setLevel(logging.INFO)
    log.propagate = False
    as_json = logging.Formatter()
    as_json.format = lambda r: json.dumps({"level": r.levelname.lower(), "message": r.getMessage()}, ensure_ascii=False)
    for stream, test in ((sys.stdout, lambda r: r.levelno < logging.WARNING), (sys.stderr, lambda r: r.levelno >= logging.WARNING)):
        h = logging.StreamHandler(stream)
        h.addFilter(test)
        h.setFormatter(as_json if kind == "json" else logging.Formatter("%(message)s"))
        log.addHandler(h)
    return log


def show(log: logging.Logger, result, verbose: bool) -> None:
    if result.error:
        log.error("%s: %s", result.report.source_file, result.error)
        return
    log.info(result.report.summary())
    for n in result.report.notes:
        if n.severity == "warning":
            log.warning("  warning: %s", n.message)
        elif verbose:
            log.info("  info: %s", n.message)
    if result.preview:
        log.info(result.preview)


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    log = loggers(args.log_format)
    from pyspark.sql import SparkSession

    from grainworks.operators.validate import Schema
    from grainworks.plans import pipeline

    try:
        spark = spark or SparkSession.builder.appName("grainworks").getOrCreate()
        if args.command == "detect":
            fmt, score = pipeline.detect(args.input, spark)
            log.info("%s (%.2f)", fmt, score)
            return 0
        o = merged(args)
        schema = None
        if o["schema"]:
            with open(o["schema"], encoding="utf-8") as f:
                schema = Schema.from_json(f.read())
        common = {"fmt": o["format"], "options": options_of(o), "schema": schema, "on_violation": o["on_violation"] or "warn", "dry_run": o["dry_run"], "stream": o["stream"], "parts": o["parts"] or None}
        if args.batch:
            results = pipeline.batch(spark, args.batch, args.output or f"{args.batch.rstrip('/')}_clean", output_format=o["output_format"] or "csv", report_dir=o["report_dir"], **common)
            for r in results:
                show(log, r, args.verbose)
            failed = sum(r.error is not None for r in results)
            log.info("batch: %d file(s), %d failed", len(results), failed)
            return 0
        if not args.input:
            raise EngineError("an input file or --batch is needed")
        show(log, pipeline.clean(spark, args.input, args.output, output_format=o["output_format"], report_path=o["report"], **common), args.verbose)
        return 0
    except (EngineError, OSError) as e:
        log.error("error: %s", e)
        return 1
