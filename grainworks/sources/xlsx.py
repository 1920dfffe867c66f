"""Excel workbooks (.xlsx, .xlsm) and OpenDocument sheets, from their zipped XML."""

from __future__ import annotations

import datetime as dt
import functools
import io
import re
import zipfile
from xml.etree import ElementTree
from xml.parsers import expat

from grainworks.operators.shape import named, numbered
from grainworks.sources.trees import infer

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: names as expat gives them
_C, _VALUE, _T, _ROW, _MERGE = (f"{_M[1:-1]} {x}" for x in ("c", "v", "t", "row", "mergeCell"))
#: built-in number formats that show dates or times (fixed values)
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 45, 46, 47, 50, 51, 52, 53, 54, 55, 56, 57, 58}


_PLACE = re.compile(r"\$?([A-Za-z]+)\$?([0-9]+)")


@functools.lru_cache(4096)
def column(letters: str) -> int:
    col = 0
    for c in letters.upper():
        col = col * 26 + ord(c) - 64
    return col - 1


def place(ref: str) -> tuple[int, int]:
    """(row, column) from 0 of a cell name such as ``BC12``."""
    letters, digits = _PLACE.fullmatch(ref).groups()
    return int(digits) - 1, column(letters)


def moment(serial: float, epoch_1904: bool) -> str:
    base = dt.datetime(1904, 1, 1) if epoch_1904 else dt.datetime(1899, 12, 30)
    t = base + dt.timedelta(seconds=round(serial * 86400))
    return t.strftime("%Y-%m-%d %H:%M:%S")


class Workbook:
    def __init__(self, content: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile as e:
            raise ValueError(f"not a readable workbook: {e}") from None
        names = set(self.zip.namelist())
        book = self._xml("xl/workbook.xml")
        targets = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")} if "xl/_rels/workbook.xml.rels" in names else {}
        self.sheets = []
        for i, s in enumerate(book.iter(f"{_M}sheet")):
            to = targets.get(s.get(f"{_R}id"), f"worksheets/sheet{i + 1}.xml")
            self.sheets.append((s.get("name"), to.lstrip("/") if to.startswith("/") else f"xl/{to}"))
        props = book.find(f"{_M}workbookPr")
        self.epoch_1904 = props is not None and props.get("date1904") in ("1", "true")
        self.strings = ["".join(t.text or "" for t in si.iter(f"{_M}t") if t is not None) for si in self._xml("xl/sharedStrings.xml").iter(f"{_M}si")] if "xl/sharedStrings.xml" in names else []
        self.dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = self._xml("xl/styles.xml")
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_M}numFmt")}
            for x in styles.findall(f"{_M}cellXfs/{_M}xf"):
                n = int(x.get("numFmtId", 0))
                code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(n, ""))
                self.dates.append(n in DATE_FORMATS or bool(re.search("[ymdhs]", code, re.I) and not re.search("[#0?]", code)))

    def _xml(self, name: str):
        try:
            return ElementTree.fromstring(self.zip.read(name))
        except (KeyError, ElementTree.ParseError, zipfile.BadZipFile, RuntimeError) as e:
            raise ValueError(f"{name}: {e}") from None

    def cells(self, path: str) -> tuple[dict, list]:
        """({(row, col): cell}, merged regions), from one pass over the sheet's XML that keeps nothing else."""
        out: dict = {}
        regions: list[tuple] = []
        row = last_row = last_col = -1
        here, kind, style, value, inline, text, open_text = (0, 0), "n", 0, None, [], [], False

        def start(name, attributes):
            nonlocal row, last_row, last_col, here, kind, style, value, inline, text, open_text
            if name == _C:
                ref = attributes.get("r")
                here = place(ref) if ref else (row, last_col + 1)
                last_col = here[1]
                kind, style, value, inline = attributes.get("t", "n"), attributes.get("s"), None, []
            elif name == _VALUE or name == _T:
                text, open_text = [], True
            elif name == _ROW:
                r = attributes.get("r")
                row = int(r) - 1 if r else last_row + 1
                last_row, last_col = row, -1
            elif name == _MERGE:
                a, _, b = attributes.get("ref", "A1").partition(":")
                if b:
                    regions.append((*place(a), *place(b)))

        def end(name):
            nonlocal value, open_text
            if name == _VALUE:
                value, open_text = "".join(text), False
            elif name == _T:
                inline.append("".join(text))
                open_text = False
            elif name == _C:
                got = self._cell(kind, style, value, inline)
                if got is not None:
                    out[here] = got

        def chars(s):
            if open_text:
                text.append(s)

        parser = expat.ParserCreate(namespace_separator=" ")
        parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, chars
        try:
            with self.zip.open(path) as f:
                parser.ParseFile(f)
        except (KeyError, expat.ExpatError, zipfile.BadZipFile, RuntimeError) as e:
            raise ValueError(f"{path}: {e}") from None
        return out, regions

    def _cell(self, kind: str, style: str | None, v: str | None, inline: list[str]):
        if kind == "n" and v is not None:
            if style is not None and (i := int(style)) < len(self.dates) and self.dates[i]:
                return "text", moment(float(v), self.epoch_1904)
            return "float", float(v)
        if kind == "inlineStr":
            return _text("".join(inline))
        if v is None:
            return None
        if kind == "s":
            return _text(self.strings[int(v)])
        if kind == "b":
            return "bool", v.strip() in ("1", "true")
        if kind in ("str", "e"):
            return _text(v) if kind == "str" else ("text", v)
        if kind == "d":
            return "text", v.replace("T", " ")
        return "float", float(v)


def _text(s: str):
    """A string cell; an empty one still counts as populated until it is inferred."""
    return ("string", s)


def final(cell):
    return None if cell is None else infer(cell[1]) if cell[0] == "string" else cell


def heading(cell) -> str:
    if cell is None:
        return ""
    if cell[0] == "float":
        return str(int(cell[1])) if cell[1] == int(cell[1]) and abs(cell[1]) < 1e15 else repr(cell[1])
    return ("true" if cell[1] else "false") if cell[0] == "bool" else str(cell[1]).strip()


def table(name: str, cells: dict, regions: list | None, notes: list) -> dict | None:
    """One sheet: merges filled, junk around the table trimmed, headers named; ``regions`` None means a guess by forward fill."""
    if not cells:
        notes.append(("warning", f"sheet '{name}': empty, skipped"))
        return None
    top, left = min(r for r, _ in cells), min(c for _, c in cells)
    bottom, right = max(r for r, _ in cells), max(c for _, c in cells)
    for r0, c0, r1, c1 in regions or []:
        if (first := cells.get((r0, c0))) is not None:
            for r in range(r0, min(r1, bottom) + 1):
                for c in range(c0, min(c1, right) + 1):
                    cells.setdefault((r, c), first)
    if regions:
        notes.append(("info", f"sheet '{name}': filled {len(regions)} merged region(s) using exact boundaries"))
    grid = [[cells.get((r, c)) for c in range(left, right + 1)] for r in range(top, bottom + 1)]
    filled = [sum(x is not None for x in row) for row in grid]
    need = 2 if max(filled) > 1 else 1
    start = next((i for i, n in enumerate(filled) if n >= need), 0)
    stop = len(grid)
    while need == 2 and stop > start + 1 and filled[stop - 1] <= 1:
        stop -= 1
    if start:
        notes.append(("info", f"sheet '{name}': skipped {start} leading junk row(s) before header"))
    if stop < len(grid):
        notes.append(("info", f"sheet '{name}': trimmed {len(grid) - stop} trailing junk/footer row(s)"))
    body = grid[start:stop]
    if regions is None:
        for c in range(len(body[0])):
            above = None
            for row in body:
                above = row[c] = row[c] if row[c] is not None else above
        notes.append(("info", f"sheet '{name}': forward-filled empty cells left by merged regions (a guess: this file format does not give their boundaries)"))
    return {"source": name, "headers": numbered(named([heading(x) for x in body[0]])), "rows": [[final(x) for x in row] for row in body[1:]]}


def read(content: bytes, filename: str, options: dict) -> dict:
    if content.startswith(b"\xd0\xcf\x11\xe0"):
        raise ValueError("legacy binary workbooks (.xls) cannot be read; save the file as .xlsx")
    fill = {"false": False, "0": False, "no": False}.get(options.get("merge_fill"), True)
    notes, tables, only = [], [], options.get("sheet")
    if b"application/vnd.oasis.opendocument" in content[:200]:
        book, sheets = None, list(_ods(content))
    else:
        book = Workbook(content)
        sheets = book.sheets
    if not sheets:
        raise ValueError("workbook has no sheets")
    notes.append(("info", f"found {len(sheets)} sheet(s): {', '.join(s[0] for s in sheets)}"))
    for name, where in sheets:
        if only is not None and name != only:
            continue
        try:
            cells, regions = book.cells(where) if book else (where, None)
        except (ValueError, KeyError, IndexError, AttributeError) as e:
            notes.append(("warning", f"sheet '{name}': could not read ({e}), skipped"))
            continue
        made = table(name, cells, regions if book and fill else [] if not fill else None, notes)
        if made:
            tables.append(made)
    if not tables:
        raise ValueError("no usable sheets found")
    return {"label": "xlsx", "notes": notes, "rows_in": sum(len(t["rows"]) for t in tables), "tables": tables}


def _ods(content: bytes):
    """(name, cells) of an OpenDocument spreadsheet."""
    t, o, x = (f"{{urn:oasis:names:tc:opendocument:xmlns:{n}:1.0}}" for n in ("table", "office", "text"))
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("content.xml"))
    for sheet in root.iter(f"{t}table"):
        cells, r = {}, 0
        for row in sheet.iter(f"{t}table-row"):
            times, c = min(int(row.get(f"{t}number-rows-repeated", 1)), 1 << 20), 0
            found = []
            for cell in row:
                n = int(cell.get(f"{t}number-columns-repeated", 1))
                kind = cell.get(f"{o}value-type")
                said = "\n".join("".join(p.itertext()) for p in cell.iter(f"{x}p"))
                got = ("float", float(cell.get(f"{o}value"))) if kind in ("float", "percentage", "currency") else ("bool", cell.get(f"{o}boolean-value") == "true") if kind == "boolean" else ("text", cell.get(f"{o}date-value").replace("T", " ")) if kind == "date" else ("string", said) if kind else None
                if got is not None:
                    found += [(c + i, got) for i in range(n)]
                c += n
            if found:
                cells |= {(r + k, i): got for k in range(times) for i, got in found}
            r += times
        yield sheet.get(f"{t}name"), cells
