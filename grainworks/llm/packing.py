"""Best-fit packing: hierarchical residual packing of token pieces into sequences of fixed capacity.

1. Each text is tokenised where it lies; a document longer than a sequence is cut into full pieces, the
   first of which takes the remainder.  Only ids' lengths and checksums leave the stage, written once.
2. Every partition packs its pieces best-fit decreasing: the fullest open sequence that still has room.
3. Nearly full sequences are final.  Underfull ones go up as items of their own, ``FAN`` groups to one,
   and are packed best-fit again, until one group is left.
4. Each round yields a map (sequence -> sequence it went into, offset there); pieces follow it by joins.

After best fit at most one sequence of a group is half empty or emptier, and sequences more than half full never
fit each other.  So a round of ``FAN`` groups can place at most ``FAN`` small sequences, and the emptiest of the others
are the best hosts for them: of each group, as many of its emptiest sequences go up as all rounds to come can fill,
``FAN`` a round.  What stays behind could not have been used, and a round's groups stay of bounded size however large
the table is.

Defined results: a null or empty text is one piece (the end token); repeated rows are packed one by
one; an empty table gives an empty table; ties go by id and piece; extra columns are ignored by ``pack_documents`` and
kept by ``pack`` whatever their names.
"""

from __future__ import annotations

import bisect
import json
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainworks.llm.frames import cut, free, map_slices
from grainworks.llm.text import text_of

CAPACITY = 1024
END = 2
#: a sequence with at least this share of the capacity is final
NEARLY = 0.995
#: groups that a round merges into one
FAN = 64

_coders: dict = {}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def coder(path: str):
    """A fast byte-level BPE over the vocabulary of a tokenizers file: the pair with the lowest id merges first.

    The ids equal those of ``Tokenizer.from_file(path)`` with special strings read as ordinary text (tests compare them).
    """
    if path not in _coders:
        import tiktoken

        model = json.load(open(path, encoding="utf-8"))
        special = {t["content"] for t in model.get("added_tokens", [])}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        _coders[path] = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _coders[path]


def cut_points(n: int, capacity: int) -> list[int]:
    """Starts of a document's pieces: all full but the first."""
    first = n % capacity or min(n, capacity)
    return [0, *range(first, n, capacity)]


def pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document's pieces."""
    path = path or vocabulary()

    def run(part):
        encode = coder(path).encode_ordinary
        rows: list[tuple] = []
        for k, t in zip(part.column(0).to_pylist(), text_of(part.column(1))):
            ids = np.array([*encode(t), end], "<u4")
            starts = cut_points(len(ids), capacity)
            for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                rows.append((k, i, a, b - a, zlib.crc32(ids[a:b].tobytes())))
        return [list(c) for c in zip(*rows)] if rows else [[]] * 5

    slim = docs.select(docs[key].cast("long").alias(key), docs[text].alias(text))
    return map_slices(slim, text, run, f"{key} long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of each item and the fill of each bin; items in the order given."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by room left
    open_rooms: list[int] = []  # rooms with a bin, sorted
    where, offset, fill = [], [], []
    for size in sizes:
        i = bisect.bisect_left(open_rooms, size)
        if i == len(open_rooms):
            b = len(fill)
            fill.append(0)
        else:
            room = open_rooms[i]
            b = rooms[room].pop()
            if not rooms[room]:
                open_rooms.pop(i)
        where.append(b)
        offset.append(fill[b])
        fill[b] += size
        left = capacity - fill[b]
        if left:
            if not rooms[left]:
                bisect.insort(open_rooms, left)
            rooms[left].append(b)
    return where, offset, fill


def _rising(fill: np.ndarray, capacity: int, rounds: int) -> np.ndarray:
    """Which bins go up: of the underfull ones the emptiest, as many as ``rounds`` more rounds can fill."""
    under = np.flatnonzero(fill < NEARLY * capacity)
    return under[np.argsort(fill[under], kind="stable")][: FAN * rounds]


def pack(items: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``items`` (key, piece, length and more) with ``sequence_id`` and ``offset``; reads ``items`` once, so give it a written table."""
    schema = items.schema
    names = schema.fieldNames()
    bin_, place_, fill_, up_ = (free(x, names) for x in ("bin", "place", "fill", "up"))
    groups, rounds = max(1, items.rdd.getNumPartitions()), 1
    while FAN**rounds < groups:
        rounds += 1
    every = rounds

    def local(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, n, made = [], 0, 0

        def done(frames):
            nonlocal made
            p = pd.concat(frames, ignore_index=True).sort_values(["length", key, "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
            where, offset, fill = best_fit(p["length"].tolist(), capacity)
            up = np.zeros(len(fill), bool)
            up[_rising(np.array(fill, np.int64), capacity, every)] = True
            p[bin_], p[place_], p[fill_], p[up_] = np.array(where, np.int64) + (part << 40) + made, offset, np.array(fill)[where], up[where]
            made += len(fill)
            return p

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= 200_000:  # a partition of any size is packed in bounded memory
                yield done(held)
                held, n = [], 0
        if n:
            yield done(held)

    packed = cut(items.mapInPandas(local, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + f", {bin_} long, {place_} long, {fill_} long, {up_} boolean"))
    raised = packed.where(F.col(up_))
    level = raised.select(F.col(bin_).alias("bin"), F.col(fill_).alias("fill")).distinct().withColumn("grp", F.shiftright("bin", 40))
    moves = None
    while rounds:
        rounds -= 1
        left = rounds

        def merge(p):
            p = p.sort_values(["fill", "bin"], ascending=[False, True], kind="stable", ignore_index=True)
            where, offset, fill = best_fit(p["fill"].tolist(), capacity)
            head = p.groupby(pd.Series(where))["bin"].transform("first")
            fill = np.array(fill, np.int64)
            up = np.zeros(len(fill), bool)
            up[_rising(fill, capacity, left)] = True  # noqa: B023  run before the next round
            return pd.DataFrame({"bin": p["bin"], "head": head, "shift": offset, "head_fill": fill[where], "up": up[where], "grp": p["grp"]})

        step = cut(level.withColumn("grp", F.floor(F.col("grp") / FAN)).groupBy("grp").applyInPandas(merge, "bin long, head long, shift long, head_fill long, up boolean, grp long"))
        moved = step.select("bin", "head", "shift")
        if moves is None:
            moves = moved
        else:
            then = moved.select(F.col("bin").alias("b2"), F.col("head").alias("h2"), F.col("shift").alias("s2"))
            moves = moves.join(then, moves["head"] == then["b2"], "left").select("bin", F.coalesce("h2", "head").alias("head"), (F.col("shift") + F.coalesce("s2", F.lit(0))).alias("shift"))
        level = step.where("up").select(F.col("head").alias("bin"), F.col("head_fill").alias("fill"), "grp").distinct()
    to, head_, shift_ = (free(x, names) for x in ("to_bin", "head", "shift"))
    low = raised.join(moves.select(F.col("bin").alias(to), F.col("head").alias(head_), F.col("shift").alias(shift_)), F.col(bin_) == F.col(to), "left")
    out = [F.col(f"`{n}`") for n in names]
    return packed.where(~F.col(up_)).select(*out, F.col(bin_).alias("sequence_id"), F.col(place_).alias("offset")).unionByName(
        low.select(*out, F.coalesce(head_, bin_).alias("sequence_id"), (F.col(place_) + F.coalesce(F.col(shift_), F.lit(0))).alias("offset"))
    )


def pack_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with their places: (key, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(cut(pieces(docs, text, key, path, capacity)), key, capacity)
