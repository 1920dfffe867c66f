"""JSON, NDJSON, YAML and XML: one tree form, records out of it, and their flattening.

A flattened record is a dict of dotted keys to cells; a cell is (kind, value).  Numbers keep their source text until
they become cells, so oversized integers keep every digit.
"""

from __future__ import annotations

import json
import re
from itertools import product

WHOLE = re.compile(r"-?[0-9]+")
NUMBER = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
DEPTH = 128


class Number(str):
    """A number as it was written."""


def json_tree(text: str):
    return json.loads(text, parse_int=Number, parse_float=Number, parse_constant=_no_constant)


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def ndjson_tree(text: str) -> list:
    return [json_tree(x.strip()) for x in text.split("\n") if x.strip()]


def yaml_tree(text: str):
    """YAML with the core schema only: null, true/false, integers and floats; everything else is text."""
    import yaml

    class Loader(yaml.SafeLoader):
        yaml_implicit_resolvers: dict = {}

    core = [
        ("null", r"~|null|Null|NULL|", "~nN\0"),
        ("bool", r"true|True|TRUE|false|False|FALSE", "tTfF"),
        ("int", r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+", "-+0123456789"),
        ("float", r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)", "-+.0123456789"),
        ("merge", r"<<", "<"),
    ]
    for tag, pattern, first in core:
        Loader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(f"^(?:{pattern})$"), list(first.replace("\0", "")) + ([""] if tag == "null" else []))

    def number(loader, node):
        s = node.value
        if s.lower().lstrip("+-").startswith((".inf", ".nan")):
            return s
        if s.startswith(("0o", "0x")):
            return Number(int(s, 0))
        return Number(s.lstrip("+") if re.fullmatch(r"\+[0-9.].*", s) else s)

    for tag in ("int", "float"):
        Loader.add_constructor(f"tag:yaml.org,2002:{tag}", number)
    Loader.add_constructor("tag:yaml.org,2002:timestamp", lambda loader, node: node.value)
    tree = yaml.load(text, Loader)  # noqa: S506  a subclass of the safe loader
    return _string_keys(tree)


def _string_keys(x):
    if isinstance(x, dict):
        return {k if isinstance(k, str) else "" if k is None else str(k).lower() if isinstance(k, bool) else str(k): _string_keys(v) for k, v in x.items()}
    return [_string_keys(v) for v in x] if isinstance(x, list) else x


def xml_tree(text: str):
    """The root's content: attributes as ``@name``, text beside them as ``#text``, repeated children as a list."""
    return xml_value(xml_root(text))


def xml_value(node: dict):
    said = "".join(node["text"]).strip()
    if not node["kids"]:
        return said or None
    out = {k: v[0] if len(v) == 1 else v for k, v in node["kids"].items()}
    return out | {"#text": said} if said else out


def xml_root(text: str) -> dict:
    """The root as it stands: ``kids``, a list of values for each name, and ``text``."""
    from xml.parsers import expat

    stack: list[dict] = [{"kids": {}, "text": []}]
    roots = []
    parser = expat.ParserCreate()
    parser.buffer_text = True

    def start(name, attributes):
        stack.append({"name": name, "kids": {f"@{k}": [v] for k, v in attributes.items()}, "text": []})

    def end(name):
        done = stack.pop()
        if len(stack) == 1:
            roots.append(done)
        else:
            stack[-1]["kids"].setdefault(name, []).append(xml_value(done))

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda s: stack[-1]["text"].append(s)
    try:
        parser.Parse(text.lstrip(), True)
    except expat.ExpatError as e:
        raise XmlError(f"invalid XML: {e}", expat.ErrorString(e.code)) from None
    if not roots:
        raise ValueError("empty XML document")
    return roots[0]


class XmlError(ValueError):
    """``reason``: the message without a place."""

    def __init__(self, message: str, reason: str):
        super().__init__(message)
        self.reason = reason


TREES = {"json": json_tree, "ndjson": ndjson_tree, "yaml": yaml_tree, "xml": xml_tree}


def records(tree) -> tuple[list, str | None]:
    """(records, key): a list's items; of an object, those of its first list-valued key in sorted order; else the value itself."""
    if isinstance(tree, list):
        return tree, None
    if isinstance(tree, dict):
        for k in sorted(tree):
            if isinstance(tree[k], list):
                return tree[k], k
    return [tree], None


def infer(raw: str) -> tuple[str, object] | None:
    """A cell from text by itself (the rule of ``functions.cells.infer``)."""
    t = raw.strip()
    if not t:
        return None
    if t[0] in "+-.0123456789iInN" and not re.match("-?0[0-9]", t):
        if re.fullmatch("[+-]?[0-9]+", t, re.ASCII) and -(1 << 63) <= int(t) < 1 << 63:
            return "int", int(t)
        if not WHOLE.fullmatch(t) and (NUMBER.fullmatch(t) or re.fullmatch("[+-]?(inf|infinity|nan)", t, re.I | re.A)):
            return "float", float(t)
    word = t.lower() if t.isascii() else t
    if word in ("true", "yes", "false", "no"):
        return "bool", word in ("true", "yes")
    return "text", t


def scalar(x) -> tuple[str, object] | None:
    if x is None:
        return None
    if isinstance(x, bool):
        return "bool", x
    if isinstance(x, Number):
        if WHOLE.fullmatch(x):
            return ("int", int(x)) if -(1 << 63) <= int(x) < 1 << 63 and x != "-0" else ("float", -0.0) if x == "-0" else ("text", str(x))
        return "float", float(x)
    return infer(x)


def shown(x) -> str:
    return "" if x is None else ("true" if x else "false") if isinstance(x, bool) else str(x)


def flatten(x, separator: str = ".", join: str = "; ", explode: bool = False, prefix: str = "", depth: int = 0) -> list[dict]:
    """One dict, or several where lists are exploded: independent lists multiply, later keys win."""
    if depth > DEPTH:
        raise ValueError("nesting is too deep")
    go = lambda v, p: flatten(v, separator, join, explode, p, depth + 1)
    if isinstance(x, dict):
        if not x:
            return [{prefix: None}]
        sides = [go(x[k], f"{prefix}{separator}{k}" if prefix else k) for k in sorted(x)]
        return [{k: v for part in row for k, v in part.items()} for row in product(*sides)]
    if isinstance(x, list):
        if not any(isinstance(v, (dict, list)) for v in x):
            return [{prefix: ("text", join.join(map(shown, x)))}]
        if explode:
            return [row for v in x for row in go(v, prefix)]
        return [{k: v for i, item in enumerate(x) for row in go(item, f"{prefix}[{i}]") for k, v in row.items()}]
    return [{prefix: scalar(x)}]


def read(kind: str, text: str, options: dict) -> dict:
    """Headers, rows of cells and notes of one document."""
    try:
        tree = TREES[kind](text)
    except RecursionError:
        raise ValueError("nesting is too deep") from None
    found, key = records(tree)
    explode = options.get("array_mode", "join") == "explode"
    flat = [row for r in found for row in flatten(r, options.get("separator", "."), options.get("array_join_sep", "; "), explode)]
    headers = sorted({k for row in flat for k in row})
    notes = notes_of(kind, key, explode, len(found), len(flat), any(len(row) != len(headers) for row in flat))
    return {"label": kind, "notes": notes, "rows_in": len(found), "tables": [{"source": None, "headers": headers, "rows": [[row.get(h) for h in headers] for row in flat]}]}


def notes_of(kind: str, key: str | None, explode: bool, records: int, rows: int, absent: bool) -> list[tuple[str, str]]:
    notes = [("warning", f"{kind} support is experimental: flattening follows one simple documented rule")]
    if key is not None:
        notes.append(("info", f"the records are the list under '{key}'"))
    if explode and rows != records:
        notes.append(("info", f"{records} record(s) made {rows} row(s), one for each list item"))
    if absent:
        notes.append(("info", "not every record has every field; absent ones are null"))
    return notes
