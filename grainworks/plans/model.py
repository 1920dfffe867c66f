"""Tables, reports and errors."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


class EngineError(Exception):
    """Base of all errors that cleaning a file may raise."""


class UnknownFormat(EngineError):
    pass


class ParseError(EngineError):
    def __init__(self, fmt: str, message: str):
        super().__init__(f"{fmt}: {message}")
        self.format, self.message = fmt, message


class ExportError(EngineError):
    pass


class SchemaRejected(EngineError):
    pass


@dataclass
class Note:
    severity: str
    message: str


@dataclass
class Report:
    source_file: str
    detected_format: str
    rows_in: int = 0
    rows_out: int = 0
    notes: list[Note] = field(default_factory=list)

    def info(self, message: str) -> None:
        self.notes.append(Note("info", message))

    def warning(self, message: str) -> None:
        self.notes.append(Note("warning", message))

    def to_json(self) -> str:
        return json.dumps({"source_file": self.source_file, "detected_format": self.detected_format, "rows_in": self.rows_in, "rows_out": self.rows_out, "notes": [vars(n) for n in self.notes]}, indent=2, ensure_ascii=False)

    def summary(self) -> str:
        state = "warn" if any(n.severity == "warning" for n in self.notes) else "ok"
        return f"[{state}] {self.source_file} -> detected: {self.detected_format}, rows: {self.rows_in} in / {self.rows_out} out, {len(self.notes)} note(s)"


@dataclass
class Table:
    """``df``: ``_row`` and ``c0, c1, ...``, one for each of ``headers``; a column is plain or a cell struct."""

    headers: list[str]
    df: DataFrame
    source: str | None = None

    def columns(self) -> list[str]:
        return [f"c{i}" for i in range(len(self.headers))]


@dataclass
class Outcome:
    """``held``: what was cached while reading; ``release`` it when the tables are no longer needed."""

    tables: list[Table]
    report: Report
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


class Options(dict):
    """String options; keys are case-sensitive."""

    def flag(self, key: str, default: bool) -> bool:
        return {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}.get(self.get(key), default)
