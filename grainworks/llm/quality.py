"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths find the word n-grams that a text holds more than once; the
share of the text's word characters that lie inside them, and inside repeated lines, decides.  All of
it is computed in numpy over slices of an Arrow batch, document by document: no shuffle, no state.

Defined results: a null or empty text has no words, so all counts are 0 and it is rejected
(``n_words < 10``); repeated rows and repeated ids are judged one by one; an empty table gives an
empty table; extra columns are ignored by ``measure`` and kept by ``keep``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from grainworks.llm.frames import map_rows, map_slices
from grainworks.llm.text import Words, bytes_of, covered, mix, points, repeated, rolled, span_hashes

#: n-gram length -> largest share of word characters that may lie inside repeated n-grams of that length
LIMITS = {5: 0.25, 7: 0.22, 10: 0.20}
#: largest share of characters in lines that repeat an earlier line
LINE_LIMIT = 0.30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, dup_ngram_chars long, dup_line_chars long, kept boolean"


def _per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _of_row(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    return mix(hashes ^ mix(row.astype(np.uint64) + np.uint64(1)))


def measures(data: np.ndarray, off: np.ndarray, limits: dict[int, float] = LIMITS, line_limit: float = LINE_LIMIT) -> list[np.ndarray]:
    """The columns of SCHEMA for the texts ``data[off[i]:off[i + 1]]``."""
    words, before = Words(data, off), points(data)
    hashes = words.hashes()
    chars = before[words.end] - before[words.start]
    word_chars = _per_row(chars, words.first)

    def inside(n: int) -> np.ndarray:
        at = words.windows(n)
        many, _ = repeated(_of_row(rolled(hashes, at, n), words.doc[at]))
        return covered(at[many], n, len(words))

    n_repeat, verdict, most = np.zeros(words.rows, np.int64), np.ones(words.rows, bool), np.zeros(words.rows, np.int64)
    for n in sorted({5, *limits}):
        hit = inside(n)
        if n == 5:
            n_repeat = _per_row(hit, words.first)
        if n in limits:
            dup = _per_row(chars * hit, words.first)
            most = np.maximum(most, dup)
            verdict &= dup <= limits[n] * word_chars
    # lines: from a row's start or a newline to the next newline or the row's end
    breaks = np.flatnonzero(data == 10)
    full = np.flatnonzero(np.diff(off) > 0)
    start = np.sort(np.concatenate([off[full], breaks + 1]))
    end = np.sort(np.concatenate([breaks, off[full + 1]]))
    row = np.searchsorted(off, end, "left") - 1  # a line may be empty, but its end lies in or at the end of its row
    row[row < 0] = 0
    worded = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, row = start[worded], end[worded], row[worded]
    _, later = repeated(_of_row(span_hashes(data, start, end), row))
    n_lines = np.bincount(row[later], minlength=words.rows)[: words.rows]
    line_chars = np.bincount(row[later], (before[end] - before[start])[later], minlength=words.rows)[: words.rows].astype(np.int64)
    n_chars = before[off[1:]] - before[off[:-1]]
    verdict &= line_chars <= line_limit * n_chars
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])
    failed = (words.count < 10) | (100 * n_repeat > 20 * words.count)
    return [words.count, word_chars, symbols[off[1:]] - symbols[off[:-1]], n_lines, n_repeat, failed, most, line_chars, verdict & ~failed]


def measure(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and the columns of SCHEMA for every row of ``docs``."""

    def run(part):
        return [part.column(0), *measures(*bytes_of(part.column(1)))]

    slim = docs.select(docs[key].cast("long").alias(key), docs[text].alias(text))
    return map_slices(slim, text, run, f"{key} long, {SCHEMA}")


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""

    def run(part, at):
        return part.filter(pa.array(measures(*bytes_of(part.column(at)))[-1]))

    return map_rows(docs, text, run)
