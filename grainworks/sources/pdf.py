"""Text-based PDF: glyphs with their places, rows from geometry, columns from aligned gaps."""

from __future__ import annotations

import re
import zlib
from statistics import median_high

import numpy as np

from grainworks.operators.shape import named, numbered, runs

GAP_SHARE = 0.85
ROW_TOLERANCE, JUMP = 0.5, 0.8
#: Helvetica advance widths of the characters 32 to 126, in thousandths (fixed values, public font metrics)
HELVETICA = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]

_TOKEN = re.compile(rb"%[^\r\n]*|/[^\s()<>\[\]{}/%]*|<<|>>|\[|\]|\(|<[0-9A-Fa-f\s]*>|[^\s()<>\[\]{}/%]+|[{}]")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    pass


class Ref(tuple):
    pass


class Parser:
    """Tokens and objects of PDF syntax."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def token(self):
        while m := _TOKEN.search(self.data, self.at):
            self.at = m.end()
            t = m[0]
            if t.startswith(b"%"):
                continue
            return self.string() if t == b"(" else t
        return None

    def string(self) -> tuple[bytes]:
        out, depth, i, d = bytearray(), 1, self.at, self.data
        while i < len(d):
            c = d[i : i + 1]
            if c == b"\\":
                if m := re.compile(rb"[0-7]{1,3}").match(d, i + 1):
                    out.append(int(m[0], 8) & 255)
                    i = m.end()
                    continue
                e = d[i + 1 : i + 2]
                if e not in (b"\n", b"\r"):
                    out += _ESCAPES.get(e, e)
                i += 3 if d[i + 1 : i + 3] == b"\r\n" else 2
                continue
            depth += (c == b"(") - (c == b")")
            i += 1
            if not depth:
                break
            out += c
        self.at = i
        return (bytes(out),)

    def value(self, t=None):
        t = self.token() if t is None else t
        if t is None or isinstance(t, tuple):
            return None if t is None else t[0]
        if t == b"<<":
            out = {}
            while (k := self.token()) not in (b">>", None):
                v = self.value()
                if isinstance(k, bytes):
                    out[k[1:].decode("latin-1")] = v
            return out
        if t == b"[":
            out = []
            while (k := self.token()) not in (b"]", None):
                out.append(self.value(k))
            return out
        if t.startswith(b"/"):
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), t[1:]).decode("latin-1"))
        if t.startswith(b"<"):
            digits = re.sub(rb"\s", b"", t[1:-1])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if re.fullmatch(rb"[+-]?\d+", t):
            if m := re.compile(rb"\s+(\d+)\s+R(?![A-Za-z])").match(self.data, self.at):
                self.at = m.end()
                return Ref((int(t), int(m[1])))
            return int(t)
        if re.fullmatch(rb"[+-]?(\d+\.?\d*|\.\d+)", t):
            return float(t)
        return {b"true": True, b"false": False, b"null": None}.get(t, Name("\0" + t.decode("latin-1")))


class Document:
    def __init__(self, content: bytes):
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        for m in re.finditer(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b", content):
            p = Parser(content, m.end())
            number = int(m[1])
            self.objects[number] = v = p.value()
            if isinstance(v, dict) and (s := re.compile(rb"\s*stream\r?\n").match(content, p.at)):
                size = v.get("Length")
                stop = s.end() + size if isinstance(size, int) and content[s.end() + size :].lstrip()[:9] == b"endstream" else content.find(b"endstream", s.end())
                self.streams[number] = content[s.end() : stop if stop >= 0 else len(content)]
        for number in [n for n, v in self.objects.items() if isinstance(v, dict) and v.get("Type") == "ObjStm"]:
            v, body = self.objects[number], self.stream(number)
            head = Parser(body)
            pairs = [(head.value(), head.value()) for _ in range(self.get(v["N"]))]
            for n, at in pairs:
                self.objects.setdefault(n, Parser(body, self.get(v["First"]) + at).value())

    def get(self, v):
        for _ in range(32):
            if not isinstance(v, Ref):
                return v
            v = self.objects.get(v[0])
        return None

    def stream(self, number: int) -> bytes:
        v, body = self.objects[number], self.streams.get(number, b"")
        filters = self.get(v.get("Filter")) or []
        params = self.get(v.get("DecodeParms"))
        for f in filters if isinstance(filters, list) else [filters]:
            if f == "FlateDecode":
                d = zlib.decompressobj()
                body = d.decompress(body, 1 << 28)
            elif f == "ASCIIHexDecode":
                body = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", body).decode())
            else:
                raise ValueError(f"filter {f} is not supported")
        if isinstance(params, dict) and params.get("Predictor", 1) >= 10:
            body = _unpredicted(body, params.get("Columns", 1) * params.get("Colors", 1) * params.get("BitsPerComponent", 8) // 8)
        return body

    def pages(self) -> list[dict]:
        root = next((v for v in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), None)
        out: list[dict] = []

        def walk(node, inherited, depth):
            node = self.get(node)
            if not isinstance(node, dict) or depth > 64:
                return
            own = inherited | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            if node.get("Type") == "Page" or "Kids" not in node:
                out.append(own | node)
            for kid in self.get(node.get("Kids")) or []:
                walk(kid, own, depth + 1)

        if root:
            walk(root.get("Pages"), {}, 0)
        return out


def _unpredicted(data: bytes, width: int) -> bytes:
    out, above = bytearray(), bytes(width)
    for i in range(0, len(data) - width, width + 1):
        kind, row = data[i], bytearray(data[i + 1 : i + 1 + width])
        for j in range(len(row)):
            left, up = (row[j - 1] if j else 0), above[j]
            corner = above[j - 1] if j else 0
            p = left + up - corner
            near = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            row[j] = (row[j] + (0, left, up, (left + up) // 2, near)[min(kind, 4)]) & 255
        out += row
        above = bytes(row)
    return bytes(out)


class Font:
    def __init__(self, doc: Document, spec: dict):
        self.wide = spec.get("Subtype") == "Type0"
        base = str(spec.get("BaseFont", ""))
        self.map = _to_unicode(doc, spec)
        self.first, self.widths = doc.get(spec.get("FirstChar")) or 0, doc.get(spec.get("Widths")) or []
        self.default = 0.6 if "Courier" in base or "Mono" in base else None
        self.cid: dict[int, float] = {}
        if self.wide:
            kid = doc.get((doc.get(spec.get("DescendantFonts")) or [{}])[0]) or {}
            self.default = (doc.get(kid.get("DW")) or 1000) / 1000
            w = doc.get(kid.get("W")) or []
            i = 0
            while i + 1 < len(w):
                nxt = doc.get(w[i + 1])
                if isinstance(nxt, list):
                    self.cid |= {w[i] + k: x / 1000 for k, x in enumerate(nxt)}
                    i += 2
                elif i + 2 < len(w):
                    self.cid |= {c: w[i + 2] / 1000 for c in range(w[i], nxt + 1)}
                    i += 3
                else:
                    break

    def glyphs(self, s: bytes):
        """(text, advance) of each code."""
        codes = [int.from_bytes(s[i : i + 2], "big") for i in range(0, len(s), 2)] if self.wide else s
        for c in codes:
            if self.wide:
                width = self.cid.get(c, self.default)
            elif self.first <= c < self.first + len(self.widths) and isinstance(self.widths[c - self.first], (int, float)):
                width = self.widths[c - self.first] / 1000
            else:
                width = self.default or (HELVETICA[c - 32] / 1000 if 32 <= c < 127 else 0.556)
            yield self.map.get(c) or (chr(c) if self.wide else bytes([c]).decode("cp1252", "replace")), width


def _to_unicode(doc: Document, spec: dict) -> dict[int, str]:
    ref = spec.get("ToUnicode")
    if not isinstance(ref, Ref) or ref[0] not in doc.streams:
        return {}
    text, out = doc.stream(ref[0]), {}
    word = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", text, re.S):
        out |= {int(a, 16): word(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", text, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            low = word(c)
            out |= {int(a, 16) + k: low[:-1] + chr(ord(low[-1]) + k) for k in range(min(65536, int(b, 16) - int(a, 16) + 1))}
    return out


def glyphs(content: bytes) -> list[tuple[int, float, float, float, float, str]]:
    """(page, x, y, font size, width, character); y grows downwards."""
    doc, out = Document(content), []
    for number, page in enumerate(doc.pages()):
        box = [float(doc.get(x)) for x in (doc.get(page.get("MediaBox")) or [0, 0, 612, 792])]
        parts = doc.get(page.get("Contents"))
        refs = parts if isinstance(parts, list) else [page.get("Contents")]
        body = b"\n".join(doc.stream(r[0]) for r in refs if isinstance(r, Ref) and r[0] in doc.streams)
        resources = doc.get(page.get("Resources")) or {}
        specs = doc.get(resources.get("Font")) or {}
        fonts = {k: Font(doc, doc.get(v) or {}) for k, v in specs.items()}
        out += [(number, x, box[3] - y, size, width, ch) for x, y, size, width, ch in _shown(body, fonts)]
    return out


def _shown(body: bytes, fonts: dict[str, Font]):
    p, args = Parser(body), []
    unit = np.eye(3)
    ctm, saved, tm, line = unit, [], unit, unit
    font, size, lead, char, word, scale, rise = Font(Document(b""), {}), 1.0, 0.0, 0.0, 0.0, 1.0, 0.0
    move = lambda x, y: np.array([[1, 0, 0], [0, 1, 0], [x, y, 1.0]])
    matrix = lambda a: np.array([[a[0], a[1], 0], [a[2], a[3], 0], [a[4], a[5], 1.0]])

    def show(s: bytes):
        nonlocal tm
        for ch, width in font.glyphs(s):
            at = tm @ ctm
            place = np.array([0, rise, 1.0]) @ at
            yield float(place[0]), float(place[1]), float(size * np.hypot(at[1, 0], at[1, 1])), float(width), ch
            tm = move((width * size + char + (word if ch == " " else 0)) * scale, 0) @ tm

    while (t := p.token()) is not None:
        v = p.value(t)
        if not (isinstance(v, Name) and v.startswith("\0")):
            args.append(v)
            continue
        op, a = v[1:], args
        args = []
        try:
            if op == "q":
                saved.append((ctm, font, size, lead, char, word, scale, rise))
            elif op == "Q" and saved:
                ctm, font, size, lead, char, word, scale, rise = saved.pop()
            elif op == "cm":
                ctm = matrix(a) @ ctm
            elif op == "BT":
                tm = line = unit
            elif op == "Tf":
                font, size = fonts.get(a[0], font), float(a[1])
            elif op in ("Td", "TD"):
                lead = -a[1] if op == "TD" else lead
                tm = line = move(a[0], a[1]) @ line
            elif op == "Tm":
                tm = line = matrix(a)
            elif op == "T*":
                tm = line = move(0, -lead) @ line
            elif op == "TL":
                lead = a[0]
            elif op == "Tc":
                char = a[0]
            elif op == "Tw":
                word = a[0]
            elif op == "Tz":
                scale = a[0] / 100
            elif op == "Ts":
                rise = a[0]
            elif op == "Tj":
                yield from show(a[0])
            elif op in ("'", '"'):
                word, char = (a[0], a[1]) if op == '"' else (word, char)
                tm = line = move(0, -lead) @ line
                yield from show(a[-1])
            elif op == "TJ":
                for x in a[0]:
                    if isinstance(x, bytes):
                        yield from show(x)
                    elif isinstance(x, (int, float)):
                        tm = move(-x / 1000 * size * scale, 0) @ tm
        except (IndexError, TypeError, ValueError):
            continue


def rows_of(found: list) -> list[list]:
    """Glyphs in rows: a new one where the page changes or y leaves the row's first y by half a median font size."""
    if not found:
        return []
    tolerance = ROW_TOLERANCE * median_high([g[3] for g in found])
    rows: list[list] = []
    for g in sorted(found, key=lambda g: (g[0], g[2])):
        if not rows or g[0] != rows[-1][0][0] or abs(g[2] - rows[-1][0][2]) > tolerance:
            rows.append([])
        rows[-1].append(g)
    return [sorted(r, key=lambda g: g[1]) for r in rows]


def virtual_lines(rows: list[list]) -> list[str]:
    """Each row as text whose spaces stand for its gaps, in units of the median glyph step."""
    inked = [[g for g in r if g[5] != " "] for r in rows]
    steps = [b[1] - a[1] for r in inked for a, b in zip(r, r[1:]) if b[1] - a[1] > 0.01]
    unit = max(median_high(steps) if steps else 5.0, 0.5)
    out = []
    for row in rows:
        said, end, blank = [], None, False
        for _, x, _, size, width, ch in row:
            if ch == " ":
                blank = True
                continue
            if end is not None and (blank or x - end > JUMP * unit):
                said.append(" " * max(1, int((x - end) / unit + 0.5) if x > end else 1))
            said.append(ch)
            end, blank = x + max(width * size, 0.5), False
        out.append("".join(said))
    return out


def spans(lines: list[str], share: float = GAP_SHARE) -> list[tuple[int, int]]:
    longest = max(map(len, lines), default=0)
    filled = np.zeros(longest, np.int64)
    for x in lines:
        filled[[i for i, c in enumerate(x) if not c.isspace()]] += 1
    return runs(((len(lines) - filled) >= share * len(lines)).tolist())


def cut(line: str, found: list[tuple[int, int]]) -> list[str]:
    """One field a span; a character in a gap goes to the span before it, so none is lost."""
    ends, out = [b for _, b in found], [[] for _ in found]
    for i, c in enumerate(line):
        k = next((k for k, (a, b) in enumerate(found) if a <= i < b), None)
        if k is None and not c.isspace():
            k = max((k for k, b in enumerate(ends) if b <= i), default=0)
        if k is not None:
            out[k].append(c)
    return ["".join(x).strip() for x in out]


def read(content: bytes, filename: str, options: dict) -> dict:
    lines = [x for x in virtual_lines(rows_of(glyphs(content))) if x.strip()]
    if len(lines) < 2:
        raise ValueError("not enough text lines to be a table (scanned pages cannot be read)")
    notes = [("warning", "PDF support is experimental: the table is rebuilt from text positions and should be reviewed")]
    counts = [len(spans(lines[k:])) for k in range(min(1, len(lines) - 2) + 1)]
    skip = counts.index(max(counts))
    if skip:
        notes.append(("info", f"skipped {skip} title line(s) before the table"))
    lines = lines[skip:]
    found = spans(lines)
    if len(found) < 2:
        raise ValueError("no table columns could be told apart")
    notes.append(("info", f"{len(found)} column(s) told by gaps that run down the page"))
    rows = [cut(x, found) for x in lines]
    return {"label": "pdf", "notes": notes, "rows_in": len(rows) - 1, "raw": True, "tables": [{"source": None, "headers": numbered(named(rows[0])), "rows": rows[1:]}]}
