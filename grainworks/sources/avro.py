"""Avro object container files, decoded without a library."""

from __future__ import annotations

import datetime as dt
import json
import struct
import zlib

MAGIC = b"Obj\x01"
MOST_METADATA, MOST_FIXED = 10_000, 512 << 20


class Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("unexpected end of data")
        self.at += n
        return self.data[self.at - n : self.at]

    def long(self) -> int:
        out = shift = 0
        while True:
            b = self.take(1)[0]
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return (out >> 1) ^ -(out & 1)
            if shift > 63:
                raise ValueError("a number is too long")

    def bytes(self) -> bytes:
        return self.take(self.long())


def read(content: bytes, filename: str, options: dict) -> dict:
    if not content.startswith(MAGIC):
        raise ValueError("missing Avro magic bytes")
    r = Reader(content, 4)
    count, meta = r.long(), {}
    if abs(count) > MOST_METADATA:
        raise ValueError(f"header declares {count} metadata entries, which is not plausible")
    while count:
        if count < 0:
            count = -count
            r.long()
        for _ in range(count):
            key = r.bytes().decode()
            meta[key] = r.bytes()
        count = r.long()
    schema, names = json.loads(meta["avro.schema"]), {}
    if (size := oversized(schema)) is not None:
        raise ValueError(f"schema declares a fixed type of {size} bytes, more than the limit of {MOST_FIXED}")
    codec, sync, rows = meta.get("avro.codec", b"null").decode(), r.take(16), []
    if codec not in ("null", "deflate"):
        raise ValueError(f"codec '{codec}' is not supported")
    record = isinstance(schema, dict) and schema.get("type") == "record"
    headers = [f["name"] for f in schema["fields"]] if record else ["value"]
    while r.at < len(content):
        n, block = r.long(), r.bytes()
        b = Reader(zlib.decompress(block, -15) if codec == "deflate" else block)
        for _ in range(n):
            v = decode(schema, b, names)
            rows.append([cell(f["type"], x, names) for f, x in zip(schema["fields"], v)] if record else [cell(schema, v, names)])
        if r.take(16) != sync:
            raise ValueError("a sync marker does not match")
    if not rows:
        raise ValueError("no records found")
    notes = [("warning", "avro support is experimental")]
    if not record:
        notes.append(("info", "top-level type is not a record; values are in a single 'value' column"))
    return {"label": "avro", "notes": notes, "rows_in": len(rows), "tables": [{"source": None, "headers": headers, "rows": rows}]}


def oversized(schema, most: int = MOST_FIXED) -> int | None:
    """The size of the first fixed type above the limit."""
    if isinstance(schema, dict):
        if schema.get("type") == "fixed" and int(schema.get("size", 0)) > most:
            return int(schema["size"])
        parts = [f.get("type") for f in schema.get("fields", [])] + [schema.get(k) for k in ("items", "values")] + [schema["type"] if isinstance(schema.get("type"), (dict, list)) else None]
    else:
        parts = schema if isinstance(schema, list) else []
    return next((n for p in parts if p is not None and (n := oversized(p, most)) is not None), None)


def resolved(schema, names: dict):
    """The definition behind a name; named types are remembered when they are met."""
    if isinstance(schema, str) and schema in names:
        return names[schema]
    if isinstance(schema, dict) and "name" in schema and schema.get("type") in ("record", "enum", "fixed"):
        names[schema["name"]] = schema
        if "namespace" in schema:
            names[f"{schema['namespace']}.{schema['name']}"] = schema
    return schema


def decode(schema, r: Reader, names: dict):
    schema = resolved(schema, names)
    if isinstance(schema, list):
        i = r.long()
        if not 0 <= i < len(schema):
            raise ValueError("a union branch is out of range")
        return (i, decode(schema[i], r, names))
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (dict, list)):
        return decode(kind, r, names)
    if kind == "null":
        return None
    if kind == "boolean":
        return r.take(1) != b"\0"
    if kind in ("int", "long"):
        return r.long()
    if kind in ("float", "double"):
        return struct.unpack("<f" if kind == "float" else "<d", r.take(4 if kind == "float" else 8))[0]
    if kind == "bytes":
        return r.bytes()
    if kind == "string":
        return r.bytes().decode("utf-8", "replace")
    if kind == "record":
        return [decode(f["type"], r, names) for f in schema["fields"]]
    if kind == "enum":
        return schema["symbols"][r.long()]
    if kind == "fixed":
        return r.take(schema["size"])
    if kind in ("array", "map"):
        out = []
        while n := r.long():
            if n < 0:
                n = -n
                r.long()
            out += [decode(schema["items"], r, names) if kind == "array" else (r.bytes().decode(), decode(schema["values"], r, names)) for _ in range(n)]
        return out
    raise ValueError(f"unknown type {kind!r}")


def cell(schema, v, names: dict):
    schema = resolved(schema, names)
    if isinstance(schema, list):
        return cell(schema[v[0]], v[1], names)
    kind = schema["type"] if isinstance(schema, dict) else schema
    logical = schema.get("logicalType") if isinstance(schema, dict) else None
    if isinstance(kind, (dict, list)):
        return cell(kind, v, names)
    if v is None:
        return None
    if kind == "boolean":
        return "bool", v
    if kind in ("int", "long"):
        return ("int", v) if logical is None else ("text", _when(logical, v))
    if kind in ("float", "double"):
        return "float", v
    if kind in ("bytes", "fixed") and logical is None:
        return "text", v.hex()
    if kind in ("string", "enum"):
        return "text", v
    return "text", shown(schema, v, names)


def _when(logical: str, v: int) -> str:
    epoch = dt.datetime(1970, 1, 1)
    try:
        if logical == "date":
            return (epoch + dt.timedelta(days=v)).date().isoformat()
        if logical.startswith("time-"):
            return f"{v}{'ms' if 'millis' in logical else 'us'} since midnight"
        if "timestamp" in logical:
            t = epoch + (dt.timedelta(milliseconds=v) if "millis" in logical else dt.timedelta(microseconds=v))
            part = "" if not t.microsecond else f".{t.microsecond // 1000:03d}" if t.microsecond % 1000 == 0 else f".{t.microsecond:06d}"
            return t.strftime("%Y-%m-%dT%H:%M:%S") + part + ("" if logical.startswith("local") else "+00:00")
    except OverflowError:
        return f"<timestamp out of range: {v} {'ms' if 'millis' in logical else 'us'}>"
    return str(v)


def shown(schema, v, names: dict) -> str:
    """Nested, decimal and duration values as text."""
    schema = resolved(schema, names)
    if isinstance(schema, list):
        return shown(schema[v[0]], v[1], names)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if kind == "record":
        return "Record([" + ", ".join(f'("{f["name"]}", {shown(f["type"], x, names)})' for f, x in zip(schema["fields"], v)) + "])"
    if kind == "array":
        return "Array([" + ", ".join(shown(schema["items"], x, names) for x in v) + "])"
    if kind == "map":
        return "Map({" + ", ".join(f'"{k}": {shown(schema["values"], x, names)}' for k, x in v) + "})"
    if isinstance(v, bytes):
        if isinstance(schema, dict) and schema.get("logicalType") == "decimal":
            n, scale = int.from_bytes(v, "big", signed=True), int(schema.get("scale", 0))
            digits = str(abs(n)).rjust(scale + 1, "0")
            return ("-" if n < 0 else "") + (f"{digits[:-scale]}.{digits[-scale:]}" if scale else digits)
        return v.hex()
    got = cell(schema, v, names)
    return "Null" if got is None else f'{ {"bool": "Boolean", "int": "Long", "float": "Double"}.get(got[0], "String") }({json.dumps(got[1], ensure_ascii=False)})'
