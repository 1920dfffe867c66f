"""SQLite files through the standard library."""

from __future__ import annotations

import sqlite3


def read(content: bytes, filename: str, options: dict) -> dict:
    notes, tables, only = [], [], options.get("table")
    con = sqlite3.connect(":memory:")
    if content[18:20] == b"\2\2":  # a file of write-ahead mode is read as an ordinary one
        content = content[:18] + b"\1\1" + content[20:]
    try:
        con.deserialize(content)
        con.text_factory = lambda b: b.decode("utf-8", "replace")
        names = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
    except sqlite3.Error as e:
        raise ValueError(str(e)) from None
    notes.append(("info", f"found {len(names)} table(s): {', '.join(names)}"))
    for name in names:
        if only is not None and name != only:
            continue
        try:
            got = con.execute('SELECT * FROM "{}"'.format(name.replace('"', '""')))
            headers, blobs, rows = [d[0] for d in got.description], 0, []
            for r in got:
                blobs += sum(isinstance(v, bytes) for v in r)
                rows.append([_cell(v) for v in r])
        except sqlite3.Error as e:
            notes.append(("warning", f"table '{name}': could not read ({e}), skipped"))
            continue
        if blobs:
            notes.append(("info", f"table '{name}': {blobs} binary value(s) replaced by a placeholder"))
        tables.append({"source": name, "headers": headers, "rows": rows})
    con.close()
    if not tables:
        raise ValueError("none of its tables can be used")
    return {"label": "sqlite", "notes": notes, "rows_in": sum(len(t["rows"]) for t in tables), "tables": tables}


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bytes):
        return "text", f"<blob: {len(v)} bytes>"
    return {int: "int", float: "float"}.get(type(v), "text"), v
