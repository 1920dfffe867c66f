"""Large XML as a splittable scan: the file is cut at ``>``, and no task holds more than a few elements of its part.

A first pass tells for each partition how deep it starts and whether it starts inside a comment, CDATA section, instruction
or attribute value.  Then a partition is cut into pieces of whole elements under the root, each parsed between the document's own
prolog and the root's end tag; what the border of a partition cuts is put together on the driver.  As with NDJSON, one pass
collects keys and counts, the next one makes the cells.
"""

from __future__ import annotations

import json
import re
from itertools import chain

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from grainworks.functions import cells
from grainworks.operators import shape
from grainworks.plans.model import Options, Outcome, ParseError, Report, Table

#: bytes up to which one task parses the file as a whole
AT_ONCE = 16 << 20
#: bytes of elements that are parsed together
PIECE = 1 << 20
#: bytes of an element cut by a partition's border, and of what follows the root; with more, the file is parsed as a whole
FRAGMENT = 4 << 20
#: how many texts up to ``>``, and of how many bytes each, the root's start tag must be in
PROLOG, PROLOG_BYTES = 1024, 64 << 10

_QUOTED = re.compile(rb"""\"[^"]*"|'[^']*'""")
_QUOTE = re.compile(rb"""["']""")


def large(spark: SparkSession, path: str, filename: str) -> int:
    """The size of a file that is XML by its name, or by its first character where the name tells nothing; 0 if one task is to parse it."""
    name = filename.lower()
    if name.endswith((".json", ".yaml", ".yml", ".ndjson", ".jsonl")):
        return 0
    found = spark.read.format("binaryFile").load(path).select("path", "length").take(2)
    if len(found) != 1 or found[0]["length"] <= AT_ONCE or found[0]["path"].lower().endswith((".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")):
        return 0
    if not name.endswith(".xml") and not _tokens(spark, path).select(F.col("value").rlike(r"^\x{FEFF}?\s*<")).first()[0]:
        return 0
    return found[0]["length"]


def _tokens(spark: SparkSession, path: str):
    from grainworks.sources.delimited import own_session

    return own_session(spark).read.option("lineSep", ">").text(path)


def step(t: bytes, mode: bytes) -> tuple[int, bytes]:
    """What the text up to the next ``>`` changes: the depth, and what is still open (``mode``): the end of a comment, CDATA section
    or instruction, or the quote of an attribute value."""
    if not mode:
        at = t.find(b"<")
        if at < 0:
            return 0, b""
        sign = t[at + 1 : at + 2]
        if sign == b"/":
            return -1, b""
        if sign == b"!":
            for begin, end in ((b"<!--", b"--"), (b"<![CDATA[", b"]]")):
                if t.startswith(begin, at):
                    return 0, b"" if t.endswith(end, at + len(begin)) else end
            return 0, b""
        if sign == b"?":
            return 0, b"" if t.endswith(b"?", at + 2) else b"?"
        rest = t[at:]
    elif mode in (b"--", b"]]", b"?"):
        return 0, b"" if t.endswith(mode) else mode
    else:
        end = t.find(mode)
        if end < 0:
            return 0, mode
        rest = t[end + 1 :]
    if (b'"' in rest or b"'" in rest) and (q := _QUOTE.search(_QUOTED.sub(b"", rest))):
        return 0, q[0]
    return 0 if rest.endswith(b"/") else 1, b""


def cut(tokens, depth: int, mode: bytes):
    """(kind, bytes) of one partition: ``head`` up to the first border between elements under the root, ``piece``s of whole elements,
    ``tail`` after the last border; ``middle`` is a partition without a border, ``after`` what starts with the root's end tag."""
    kind = "after" if depth <= 0 else "piece" if depth == 1 and not mode else "head"
    if kind == "piece":
        yield "head", b""
    held, size, whole = [], 0, 0
    for t in tokens:
        if kind == "after":
            held.append(t + b">")
            continue
        change, mode = step(t, mode)
        depth += change
        if depth == 0:
            at = t.rfind(b"</")
            yield kind, b"".join([*held, t[:at]])
            kind, held = "after", [t[at:] + b">"]
            continue
        held.append(t + b">")
        size += len(t) + 1
        if depth == 1 and not mode:
            if kind == "head" or size >= PIECE:
                yield kind, b"".join(held)
                kind, held, size = "piece", [], 0
            whole = len(held)
    if kind == "piece":
        yield "piece", b"".join(held[:whole])
        yield "tail", b"".join(held[whole:])
    else:
        yield "middle" if kind == "head" else "after", b"".join(held)


def kids(content: bytes, prolog: str, root: str) -> dict[str, list]:
    """The elements under the root that ``content`` has, by name."""
    from grainworks.sources.trees import XmlError, xml_root

    if not content.strip():
        return {}
    try:
        return xml_root(f"{prolog}{content.decode('utf-8', 'replace')}</{root}>")["kids"]
    except XmlError as e:
        raise ValueError(f"invalid XML: {e.reason}") from None


def flat(value, options: dict) -> list[dict]:
    from grainworks.sources.trees import flatten

    try:
        return flatten(value, options.get("separator", "."), options.get("array_join_sep", "; "), options.get("array_mode", "join") == "explode")
    except RecursionError:
        raise ValueError("nesting is too deep") from None


def profiled(seen: dict, found: dict[str, list], options: dict) -> None:
    """Adds to ``seen``: records, rows, filled fields, keys and the first error of each name."""
    for name, values in found.items():
        if name.startswith("@"):  # an attribute of the root, once for each piece
            continue
        s = seen.setdefault(name, {"records": 0, "rows": 0, "filled": 0, "keys": {}, "error": None})
        for v in values:
            s["records"] += 1
            try:
                made = flat(v, options)
            except ValueError as e:
                s["error"] = s["error"] or str(e)
                continue
            s["rows"] += len(made)
            for row in made:
                s["filled"] += len(row)
                s["keys"].update(dict.fromkeys(row))


def _prolog(head: list[bytes]) -> tuple[int, str, str] | None:
    """(tokens, text, root) up to the end of the root's start tag; nothing where it is not there or the root is empty."""
    from xml.parsers import expat

    parser, names = expat.ParserCreate("utf-8"), []
    if hasattr(parser, "SetReparseDeferralEnabled"):
        parser.SetReparseDeferralEnabled(False)
    parser.StartElementHandler = lambda name, attributes: names.append(name)
    text = ""
    for i, t in enumerate(head):
        more = t.decode("utf-8", "replace")
        more = (more if i else more.removeprefix("﻿").lstrip()) + ">"
        text += more
        try:
            parser.Parse(more.encode(), False)
        except expat.ExpatError:
            return None
        if names:
            return None if more.endswith("/>") else (i + 1, text, names[0])
    return None


def _part(batches):
    """(partition, its tokens); no partition where there is none."""
    full = (b for b in batches if b.num_rows)
    first = next(full, None)
    if first is None:
        return None, iter(())
    return first.column(0)[0].as_py(), (t for b in chain([first], full) for t in b.column(1).to_pylist())


def _ended(rest: bytes, prolog: str) -> None:
    """An error unless ``rest`` is the root's end tag and what may follow it."""
    from grainworks.sources.trees import XmlError, xml_root

    try:
        xml_root(prolog + rest.decode("utf-8", "replace"))
    except XmlError as e:
        raise ValueError(f"invalid XML: {e.reason}") from None


def read(spark: SparkSession, path: str, filename: str, options: Options, length: int) -> Outcome | None:
    """Nothing where only the whole file can tell: no repeated element under the root, or too long a fragment."""
    plain = dict(options)
    ids = _tokens(spark, path).select(F.monotonically_increasing_id().alias("id"), F.col("value").cast("binary").alias("value"))
    head = ids.select("id", F.substring("value", 1, PROLOG_BYTES + 1).alias("value")).limit(PROLOG).collect()
    opened = _prolog([bytes(r["value"]) for r in head])
    if opened is None or any(len(r["value"]) > PROLOG_BYTES for r in head[: opened[0]]):
        return None
    n, prolog, root = opened
    tokens = ids.where(F.col("id") > head[n - 1]["id"]).select(F.shiftright("id", 33).alias("part"), "value")

    # how deep and inside of what each partition starts
    modes: dict[int, bytes] = {}

    def lex(batches):
        import pyarrow as pa

        part, out = _part(batches)
        depth, mode, size = 0, modes.get(part, b""), 0
        for t in out:
            change, mode = step(t, mode)
            depth += change
            size += len(t) + 1
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": [part], "depth": [depth], "mode": [mode], "size": [size]}, pa.schema({"part": pa.int64(), "depth": pa.int64(), "mode": pa.binary(), "size": pa.int64()}))

    ends: dict[int, tuple[int, bytes, int]] = {}
    again = None
    while again is None or again:
        some = tokens if again is None else tokens.where(F.col("part").isin(again))
        ends |= {r["part"]: (r["depth"], bytes(r["mode"]), r["size"]) for r in some.mapInArrow(lex, "part long, depth long, mode binary, size long").collect()}
        again, mode = [], b""
        for p in sorted(ends):  # a partition was taken to start inside of nothing until the one before it says otherwise
            if modes.get(p, b"") != mode:
                modes[p] = mode
                again.append(p)
            mode = ends[p][1]
    depths, depth = {}, 1
    for p in sorted(ends):
        depths[p] = depth
        depth += ends[p][0]
    if depth:
        raise ParseError("json", "invalid XML: the root is not closed" if depth > 0 else "invalid XML: more end tags than start tags")
    size = sum(len(r["value"]) + 1 for r in head[:n]) + sum(e[2] for e in ends.values())
    closed = size in (length, length - 3)  # Spark's reader may leave out a byte order mark

    def profile(batches):
        import pyarrow as pa

        part, out = _part(batches)
        if part is None:
            return
        seen: dict = {}
        error, made = None, []
        for kind, content in cut(out, depths[part], modes.get(part, b"")):
            if kind == "piece":
                try:
                    profiled(seen, kids(content, prolog, root), plain)
                except ValueError as e:
                    error = error or str(e)
            else:
                made.append((kind, content if len(content) <= FRAGMENT else None))
        seen = {k: s | {"keys": list(s["keys"])} for k, s in seen.items()}
        made.append(("seen", json.dumps([seen, error]).encode()))
        yield pa.RecordBatch.from_pydict({"part": [part] * len(made), "kind": [k for k, _ in made], "content": [c for _, c in made]}, pa.schema({"part": pa.int64(), "kind": pa.string(), "content": pa.binary()}))

    told: dict[int, dict] = {}
    for r in tokens.mapInArrow(profile, "part long, kind string, content binary").collect():
        if r["content"] is None:
            return None
        told.setdefault(r["part"], {})[r["kind"]] = bytes(r["content"])
    across, carried, since, after = {}, [], min(told, default=0), []
    for p in sorted(told):
        carried += [told[p][k] for k in ("head", "middle") if k in told[p]]
        if "head" in told[p]:
            across[since], carried = b"".join(carried), []
        if "tail" in told[p]:
            carried, since = [told[p]["tail"]], p
        if "after" in told[p]:
            after.append(told[p]["after"])
    rest = b"".join(after)
    across = {p: c for p, c in across.items() if c.strip()}
    if max(map(len, [rest, *across.values()])) > FRAGMENT:
        return None
    seen_by: dict[int, dict] = {}
    try:
        _ended(rest if closed else rest[:-1], prolog)
        for p in sorted(told):
            seen, error = json.loads(told[p]["seen"])
            if error:
                raise ValueError(error)
            seen_by[p] = {k: s | {"keys": dict.fromkeys(s["keys"])} for k, s in seen.items()}
            if p in across:
                profiled(seen_by[p], kids(across[p], prolog, root), plain)
    except ValueError as e:
        raise ParseError("json", str(e)) from None
    records: dict[str, int] = {}
    for seen in seen_by.values():
        for k, s in seen.items():
            records[k] = records.get(k, 0) + s["records"]
    key = min((k for k, c in records.items() if c > 1), default=None)
    if key is None:
        return None
    own = {p: seen[key] for p, seen in seen_by.items() if key in seen}
    if bad := next((own[p]["error"] for p in sorted(own) if own[p]["error"]), None):
        raise ParseError("json", bad)
    headers = sorted({k for s in own.values() for k in s["keys"]})
    report = Report(filename, "xml", records[key], sum(s["rows"] for s in own.values()))
    from grainworks.sources.trees import notes_of

    absent = sum(s["filled"] for s in own.values()) != report.rows_out * len(headers)
    for severity, message in notes_of("xml", key, options.get("array_mode", "join") == "explode", report.rows_in, report.rows_out, absent):
        (report.warning if severity == "warning" else report.info)(message)

    def typed(batches):
        import pyarrow as pa

        from grainworks.sources.files import arrow_cells

        part, out = _part(batches)
        if part is None:
            return
        whole = (c for kind, c in cut(out, depths[part], modes.get(part, b"")) if kind == "piece")
        for content in chain(whole, [across[part]] if part in across else []):  # an element belongs to where it starts
            rows = [row for v in kids(content, prolog, root).get(key, []) for row in flat(v, plain)]
            for k in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([arrow_cells([[row.get(h) for h in headers] for row in rows[k : k + 10_000]], False)], names=["fields"])

    rows = shape.ranked(tokens.mapInArrow(typed, f"fields array<{cells.CELL}>"), {p: s["rows"] for p, s in own.items()})
    table = rows.select("_row", *[F.get("fields", F.lit(i)).alias(f"c{i}") for i in range(len(headers))])
    return Outcome([Table(headers, table, filename)], report)
