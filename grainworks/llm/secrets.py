"""Secret scans: fixed patterns plus a sliding-window Shannon entropy per character class.

Three base patterns (an assignment, an access key id, a long hex run) are found exactly.  Beside them, every
candidate string (a maximal run of one character class: hex, base64 or url-safe, each with a least length, a
window and a threshold of its own) gets the Shannon entropy of each window of fixed size over it.  The counts of
a window are incremental: what has entered up to its end less what has left before its start.  A candidate
whose best window passes its class's threshold is a span of kind ``entropy`` unless the allow-list suppresses it
(digests of known files, uuids, numbers, one repeated character, words).  Letters count as words only on
evidence: enough of their neighbours are pairs that common words are made of.  A hex candidate has upper-case
letters (a run in lower case is a base span, digests too) and at least one letter and one digit.

Defined results: a null or empty text has no spans; spans are in code points, end exclusive; repeated
rows are scanned one by one; extra columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from grainworks.llm.frames import map_rows, map_slices
from grainworks.llm.text import bytes_of

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "entropy")
MASK = "[secret]"
#: windows whose counts are held at a time
RANGE = 8192

#: class -> (characters, least length, window, least entropy in bits per character)
CLASSES = {
    "hex": (b"0123456789ABCDEFabcdef", 24, 24, 3.0),
    "base64": (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 24, 24, 3.9),
    "url": (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-", 28, 28, 4.0),
}
#: lower-case hex digests of well-known contents, which many texts quote: those of the empty file
DIGESTS = {hashlib.new(name, b"").hexdigest().encode() for name in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")}
#: strings that look random and are known to be harmless
ALLOW = [
    re.compile(rb"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),  # a uuid
    re.compile(rb"[0-9+/_-]+"),  # numbers
    re.compile(rb"(.)\1*"),
    re.compile(rb"(?:[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Dd][Uu][Mm][Mm][Yy]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]).*"),
]
#: pairs of letters that are common in English, French, German and Spanish words (fixed values)
PAIRS = set(b"ai al an ar as at be ca ce ch co de di ed ei el em en er es et ge ha he hi ho ic ie il in io is it la le li ll lo ma me mi na nd ne ng ns nt ol om on or os ou pa pe po pr qu ra re ri ro rs se sh si so ss st ta te th ti to tr ue ul un ur us ve wa we wh".split())
#: the least share of such pairs among a word's; of random letters about an eighth are
PAIR_SHARE = 0.3

_LETTER, _NUMBER = re.compile(rb"[A-Fa-f]"), re.compile(rb"[0-9]")
_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: a necessary piece of every assignment: a letter that ends a key name, then optional quote and spaces, then : or =
_LINK = re.compile(rb"""(?:d|t|n|y)["']?\x20*[:=]""", re.IGNORECASE)


def runs(mask: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True of ``least`` or more within one row."""
    step = np.diff(mask.view(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = off[1:-1]
    cut = inner[(inner > 0) & (inner < len(mask))]
    cut = cut[mask[cut] & mask[cut - 1]] if len(cut) else cut
    if len(cut):
        cut = np.unique(cut)
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    long = end - start >= least
    return start[long], end[long]


def best_entropy(s: bytes, window: int) -> float:
    """The largest Shannon entropy (bits per character) of any ``window`` consecutive characters, by incremental counts."""
    n = min(window, len(s))
    if not n:
        return 0.0
    every = np.arange(n + 1)
    weight = np.zeros(n + 1)
    weight[1:] = every[1:] * np.log2(every[1:])
    least = np.inf
    for i in range(0, len(s) - n + 1, RANGE):  # in ranges of windows, so that memory does not follow the string
        _, code = np.unique(np.frombuffer(s[i : i + RANGE + n - 1], np.uint8), return_inverse=True)
        entered = np.zeros((len(code) + 1, int(code.max()) + 1), np.int32)
        entered[np.arange(1, len(code) + 1), code] = 1
        np.cumsum(entered, axis=0, out=entered)
        least = min(least, weight[entered[n:] - entered[:-n]].sum(1).min())
    return max(0.0, float(np.log2(n) - least / n))


def is_wordy(s: bytes) -> bool:
    """Letters, and signs between them, whose neighbouring letters are those of words."""
    if not re.fullmatch(rb"[A-Za-z+/_-]+", s):
        return False
    pairs = [w[i : i + 2] for w in re.findall(rb"[a-z]+", s.lower()) for i in range(len(w) - 1)]
    return sum(p in PAIRS for p in pairs) >= PAIR_SHARE * len(pairs)


def is_allowed(s: bytes) -> bool:
    return s.lower() in DIGESTS or any(p.fullmatch(s) for p in ALLOW) or is_wordy(s)


def _assignments(raw: bytes, off: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, start, end) of every assignment; only texts with a possible link are searched."""
    out: list[tuple[int, int, int]] = []
    places = np.fromiter((m.start() for m in _LINK.finditer(raw)), np.int64)
    for row in np.unique(np.searchsorted(off, places, "right") - 1).tolist():
        a, b = int(off[row]), int(off[row + 1])
        text = raw[a:b]
        out += [(row, a + m.start(), a + m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return out


def _access(raw: bytes, off: np.ndarray) -> list[tuple[int, int, int]]:
    out = []
    if b"AKIA" in raw:
        starts = np.fromiter((m.start() for m in re.finditer(rb"AKIA", raw)), np.int64)
        for row in np.unique(np.searchsorted(off, starts, "right") - 1).tolist():
            a, b = int(off[row]), int(off[row + 1])
            out += [(row, a + m.start(), a + m.end()) for m in ACCESS.finditer(raw[a:b]) if m.end() - m.start() >= 20]
    return out


def spans(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """[row, kind, start, end], sorted by row, start and kind; byte positions."""
    raw = data.tobytes()
    found = [(r, 0, a, b) for r, a, b in _assignments(raw, off)]
    found += [(r, 1, a, b) for r, a, b in _access(raw, off)]
    start, end = runs(_HEX[data], off, 24)
    row = np.searchsorted(off, start, "right") - 1
    found += [(r, 2, a, b) for r, a, b in zip(row.tolist(), start.tolist(), end.tolist())]
    seen: set[tuple[int, int]] = set()
    for name, (chars, least, window, bits) in CLASSES.items():
        mask = np.zeros(256, bool)
        mask[[*chars]] = True
        start, end = runs(mask[data], off, least)
        row = np.searchsorted(off, start, "right") - 1
        for r, a, b in zip(row.tolist(), start.tolist(), end.tolist()):
            s = raw[a:b]
            if name == "hex" and not (_LETTER.search(s) and _NUMBER.search(s)):
                continue
            if (a, b) not in seen and not is_allowed(s) and not re.fullmatch(rb"[0-9a-f]+", s) and best_entropy(s, window) >= bits:
                seen.add((a, b))
                found.append((r, 3, a, b))
    table = np.array(sorted(found, key=lambda x: (x[0], x[2], x[1], x[3])), np.int64).reshape(-1, 4)
    return [table[:, i] for i in range(4)]


def _in_points(data: np.ndarray, off: np.ndarray, row: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
    """Byte positions as code points from the start of their row."""
    if not len(row):
        return [p.copy() for p in places]
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return [before[p] - before[off[row]] for p in places]


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def digests(data: np.ndarray, off: np.ndarray) -> list:
    row, kind, start, end = spans(data, off)
    a, b = _in_points(data, off, row, start, end)
    rows = len(off) - 1
    base: list[list[str]] = [[] for _ in range(rows)]
    every: list[list[str]] = [[] for _ in range(rows)]
    for r, k, x, y in zip(row.tolist(), kind.tolist(), a.tolist(), b.tolist()):
        said = f"{KINDS[k]}:{x}:{y}"
        every[r].append(said)
        if k < 3:
            base[r].append(said)
    counts = [np.bincount(row[kind == k], minlength=rows)[:rows] for k in range(3)]
    return [*counts, [hashlib.sha256(",".join(x).encode()).hexdigest() for x in base], [",".join(x) for x in every]]


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, counts of the base kinds, a digest of the base spans, and all spans as ``kind:start:end``."""

    def run(part):
        return [part.column(0), *digests(*bytes_of(part.column(1)))]

    slim = docs.select(docs[key].cast("long").alias(key), docs[text].alias(text))
    return map_slices(slim, text, run, f"{key} long, {SCHEMA}")


def masked(data: np.ndarray, off: np.ndarray) -> list[str]:
    """The texts with every span (overlapping ones as one) replaced by MASK."""
    row, _, start, end = spans(data, off)
    raw, out, at = data.tobytes(), [], 0
    token = MASK.encode()
    for r in range(len(off) - 1):
        a, b, pieces = int(off[r]), int(off[r + 1]), []
        while at < len(row) and row[at] == r:
            x, y = int(start[at]), int(end[at])
            if x >= a:
                pieces += [raw[a:x], token]
            a, at = max(a, y), at + 1
        out.append(b"".join([*pieces, raw[a:b]]).decode())
    return out


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with all columns, secrets in ``text`` masked; a null text stays null."""

    def run(part, at):
        col = part.column(at)
        new = pa.array(masked(*bytes_of(col)), col.type)
        if col.null_count:
            new = pc.if_else(col.is_valid(), new, pa.scalar(None, col.type))
        return part.set_column(at, part.schema.field(at), new)

    return map_rows(docs, text, run)
