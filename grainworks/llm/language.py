"""Language ID by string kernels.

A text is the set of hashed byte n-grams (lengths 1 to N) that occur in it (a blended-spectrum presence
kernel).  The kernel of two texts is the cosine of those sets.  A bounded number of labelled texts is drawn
by the smallest keyed hashes within each language; some of them are the Nystrom landmarks, and a
one-versus-rest kernel ridge regression is fitted on the landmarks' feature map.  Scoring is two matrix
products a batch: presence x landmarks, then kernel x weights.

The fit sees ``text`` and ``lang`` of documents whose crc32(doc_id) mod 5 is not 0, at most FIT_EACH texts
a language, fewer above LANGS_IN_FULL languages (documented bound); everything else covers all rows.

Defined results: null texts and texts without letters are ``und`` with score 0; ties go to the first
language in alphabetical order; without any labelled row all texts are ``und``; repeated rows are scored one
by one; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainworks.llm.frames import map_slices
from grainworks.llm.text import bytes_of, lower, slices

GRAMS, BITS = 3, 13
#: labelled texts per language that the fit uses, and landmarks per language
FIT_EACH, LANDMARKS_EACH = 300, 40
#: with more languages than this, each has fewer texts and landmarks, so that their sums stay as they are; one at least
LANGS_IN_FULL = 200
RIDGE = 1e-2
UNKNOWN = "und"


def presence(data: np.ndarray, off: np.ndarray, grams: int = GRAMS, bits: int = BITS) -> np.ndarray:
    """(rows, 2 ** bits) float32: 1 where a hashed n-gram occurs in the row, each row scaled to length 1."""
    rows, slots = len(off) - 1, 1 << bits
    out = np.zeros((rows, slots), np.float32)
    text = lower(data).astype(np.uint32)
    row = np.repeat(np.arange(rows), np.diff(off))
    code = np.zeros(len(text), np.uint32)
    for n in range(1, grams + 1):
        if len(text) < n:
            break
        code = code[: len(text) - n + 1] * np.uint32(257) + text[n - 1 :] + np.uint32(1)
        same = row[: len(code)] == row[n - 1 :]
        slot = ((code * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int64)
        out.reshape(-1)[(row[: len(code)] * slots + slot)[same]] = 1
    size = np.sqrt(out.sum(1, dtype=np.float32))
    return out / np.maximum(size, 1)[:, None]


def labelled(docs: DataFrame, text: str, lang: str, key: str, each: int = FIT_EACH) -> list:
    """At most ``each`` labelled texts of every language outside the held-out fold, those with the smallest hashes of their id."""
    rows = docs.select(docs[key].cast("string").alias("k"), docs[text].alias("text"), docs[lang].alias("lang")).where("text is not null and lang is not null and pmod(crc32(cast(k as binary)), 5) <> 0")
    drawn = rows.withColumn("draw", F.xxhash64("k", F.lit(17)))
    # a threshold on the uniform draw keeps about three times as many as asked for; the exact cut follows
    sizes = drawn.groupBy("lang").agg(F.count("*").alias("n"))
    langs = sizes.count()
    if not langs:
        return []
    each = max(1, min(each, LANGS_IN_FULL * each // langs))
    share = F.least(F.lit(1.0), 3.0 * each / F.col("n"))
    few = drawn.join(F.broadcast(sizes), "lang").where(F.col("draw").cast("double") <= F.lit(float(-(1 << 63))) + share * F.lit(float(1 << 64)))
    return sorted(few.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("draw", "k", "text"))), 1, each).alias("top")).select("lang", F.explode("top").alias("t")).select("lang", "t.draw", "t.k", "t.text").collect(), key=lambda r: (r["lang"], r["draw"], r["k"]))


def fit(rows: list, landmarks_each: int = LANDMARKS_EACH, ridge: float = RIDGE) -> dict | None:
    """Landmarks, weights and language names from labelled rows (lang, text)."""
    if not rows:
        return None
    langs = sorted({r["lang"] for r in rows})
    texts = pa.array([r["text"] for r in rows], pa.large_string())
    x = presence(*bytes_of(texts))
    index = {x: i for i, x in enumerate(langs)}
    y = np.array([index[r["lang"]] for r in rows])
    landmarks_each = max(1, min(landmarks_each, LANGS_IN_FULL * landmarks_each // len(langs)))
    marks = np.concatenate([np.flatnonzero(y == i)[:landmarks_each] for i in range(len(langs))])
    land = x[marks]
    k_mm, k_nm = (land @ land.T).astype(np.float64), (x @ land.T).astype(np.float64)
    values, vectors = np.linalg.eigh(k_mm)
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # K_mm ** -1/2: the Nystrom feature map is K_nm @ root
    z = np.hstack([k_nm @ root, np.ones((len(x), 1))])
    target = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    count = np.bincount(y, minlength=len(langs))
    weight = (len(y) / (len(langs) * count))[y][:, None]  # languages weigh the same
    solved = np.linalg.solve(z.T @ (weight * z) + ridge * len(y) / len(marks) * np.eye(z.shape[1]), z.T @ (weight * target))
    return {"langs": langs, "landmarks": land, "weights": (root @ solved[:-1]).astype(np.float32), "bias": solved[-1].astype(np.float32)}


def classify(model: dict, data: np.ndarray, off: np.ndarray, each: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(index of the language, score from 0 to 1) of every row."""
    best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
    for i in range(0, len(off) - 1, each):
        own = off[i : i + each + 1]
        k = presence(data[own[0] : own[-1]], own - own[0]) @ model["landmarks"].T
        raw = (k @ model["weights"] + model["bias"]).astype(np.float64)
        odds = np.exp(3 * (raw - raw.max(1, keepdims=True)))
        odds /= odds.sum(1, keepdims=True)
        best.append(raw.argmax(1))
        score.append(odds.max(1))
    return np.concatenate(best), np.concatenate(score)


def predict(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """(key, held_out, lang_pred, score) of every row."""
    model = fit(labelled(docs, text, lang, key))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks x slots: of fixed size

    def run(part):
        col = part.column(1)
        col = col.fill_null("") if col.null_count else col
        known = shared.value
        if known is None:
            return [part.column(0), part.column(2), [UNKNOWN] * part.num_rows, [0.0] * part.num_rows]
        best, score = classify(known, *bytes_of(col))
        letters = pc.match_substring_regex(col, r"\p{L}").to_numpy(zero_copy_only=False)
        names = np.array([*known["langs"], UNKNOWN], object)
        return [part.column(0), part.column(2), names[np.where(letters, best, len(names) - 1)].tolist(), np.where(letters, score, 0.0)]

    slim = docs.select(docs[key].cast("long").alias(key), docs[text].alias("text"), F.expr(f"coalesce(pmod(crc32(cast(cast(`{key}` as string) as binary)), 5) = 0, false)").alias("held_out"))
    return map_slices(slim, "text", run, f"`{key}` long, held_out boolean, lang_pred string, score double")
