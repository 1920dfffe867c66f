"""Substring dedup by super-k-mer partitioning.

A window is ``K`` consecutive words of one document; a word goes if a window that covers it also starts
in a document with a smaller id.  The minimiser of a window is the smallest hash among its M-word runs.

1. *Heat.*  Windows are counted by minimiser slot.  A partition reports the slots that hold many of its windows; those
   with more than a quarter of a bucket's share in all are hot.  There are at most four for each bucket, and their set is
   sent out as one bit a slot, 2 ** MOST_BITS bits at most; every task agrees on it.
2. *Scatter.*  Consecutive windows with one minimiser (a super-k-mer) travel as one packed string of their words to the
   minimiser's bucket, many strings to one compressed block.  Beyond ONE_LEVEL buckets they go to groups of buckets first
   and from there to their own, so that blocks stay large.  Windows of hot slots travel as rows of their own (a 128-bit
   digest of their words) that no bucket has to hold together.
3. *Count.*  A bucket sorts its windows by hash, confirms equal ones on their words, and returns the ranges of words that
   are covered by windows seen under a smaller id.  Hot windows pass through and are settled by an aggregate with map-side
   combining and a join whose skewed partitions Spark splits.
4. *Cut.*  The ranges of a document meet its text again by ``doc_id``.

Defined results: a null or empty text has no words; texts under 13 words lose nothing; rows that share an
id are taken as repeats of one document and get the same result; rows with a null id are returned with
nothing removed; an empty table gives an empty table; extra columns are ignored by ``report`` and kept by
``remove`` whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainworks.llm.frames import cut, free, map_rows, parts
from grainworks.llm.text import Words, bytes_of, chained, mix, slices

K, M = 13, 4
_SALT = np.uint64(0x5851F42D4C957F2D)
SLOT_BITS, MOST_BITS = 16, 24
#: buckets that a task writes to directly
ONE_LEVEL = 4096
#: windows of one slot that a partition need not report: less than a bucket's worth even over 100,000 partitions
FEW = 8
#: compressed input per bucket; a bucket is sorted in one task's memory, at about twenty times this size
BUCKET_BYTES = 5 << 20
#: packed bytes that a task gathers before it sends them on
HELD_BYTES = 24 << 20


def minimisers(words: Words, hashes: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(window starts, the minimiser of each)."""
    at = words.windows(k)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    low = chained(hashes, np.arange(len(hashes) - m + 1), m)
    span, width = k - m + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    return at, low[at]


def joined(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words of a slice joined by single spaces, with each word's start and end there."""
    size = words.end - words.start
    end = np.cumsum(size + 1) - 1
    start = end - size
    if not len(size):
        return b"", start, end
    step = np.zeros(len(words.data) + 1, np.int8)
    step[words.start] += 1
    step[words.end] -= 1
    letters = words.data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    out = np.full(int(end[-1]), 32, np.uint8)
    mask = np.ones(len(out), bool)
    mask[end[:-1]] = False
    out[mask] = letters
    return out.tobytes(), start, end


def _slot(low: np.ndarray, slots: int) -> np.ndarray:
    return (mix(low) & np.uint64(slots - 1)).astype(np.int64)


def _bucket(low: np.ndarray, buckets: int) -> np.ndarray:
    """By other bits than the slot's, so that there may be more buckets than slots."""
    return (mix(low ^ _SALT) % np.uint64(buckets)).astype(np.int64)


def _heat(docs: DataFrame, buckets: int, bits: int, k: int, m: int) -> np.ndarray:
    slots = 1 << bits

    def count(batches):
        total = np.zeros(slots, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*bytes_of(part.column(1)))
                _, low = minimisers(words, words.hashes(), k, m)
                total += np.bincount(_slot(low, slots), minlength=slots)
        some = np.flatnonzero(total > max(FEW, 0.125 * total.sum() / buckets))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(total[some], total.sum()), pa.int64())], names=["slot", "n"])

    counts = cut(docs.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")))
    every = counts.where("slot < 0").first()
    out = np.zeros(slots, bool)
    if every is not None:
        hot = counts.where(f"slot >= 0 and n > {0.25 * every['n'] / buckets}").select("slot").toArrow()  # at most four a bucket
        out[hot.column("slot").to_numpy()] = True
    return out


class _Blocks:
    """Super-k-mers gathered by bucket (in ``groups`` of buckets if those are fewer), and hot windows."""

    def __init__(self, buckets: int, groups: int):
        self.buckets, self.groups, self.size, self.cold, self.hot = buckets, groups, 0, [], []

    def add(self, bucket, doc, start, windows, packed: list[bytes]) -> None:
        self.cold.append((bucket, doc, start, windows, packed))
        self.size += sum(map(len, packed))

    def add_hot(self, doc, start, digest: list[bytes]) -> None:
        if len(digest):
            self.hot.append((doc, start, digest))
            self.size += 16 * len(digest)

    def flush(self, salt: int):
        codec = pa.Codec("zstd", compression_level=3)
        buckets, blocks = [], []

        def put(to, kind, doc, start, windows, own, body):
            raw = np.array([kind, len(doc)], np.int64).tobytes() + doc.astype(np.int64).tobytes() + start.astype(np.int32).tobytes() + windows.astype(np.int32).tobytes() + own.astype(np.int32).tobytes() + body
            buckets.append(to)
            blocks.append(len(raw).to_bytes(8, "little") + codec.compress(raw, asbytes=True))

        if self.cold:
            bucket, doc, start, windows = (np.concatenate([c[i] for c in self.cold]) for i in range(4))
            packed = [x for c in self.cold for x in c[4]]
            group = bucket % self.groups
            order = np.argsort(group, kind="stable")
            edges = np.searchsorted(group[order], np.arange(self.groups + 1))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                at = order[edges[b] : edges[b + 1]]
                # buckets need no mention where a group is one of them
                put(b, 0, doc[at], start[at], windows[at], bucket[at] if self.groups < self.buckets else np.zeros(0), b"\n".join([packed[i] for i in at.tolist()]))
        if self.hot:
            doc, start = (np.concatenate([h[i] for h in self.hot]) for i in range(2))
            digest = b"".join([x for h in self.hot for x in h[2]])
            each = max(1, -(-len(doc) // self.groups), 20_000)  # in runs dealt evenly over the buckets
            for i in range(0, len(doc), each):
                put((salt + i // each) % self.groups, 1, doc[i : i + each], start[i : i + each], np.zeros(0), np.zeros(0), digest[16 * i : 16 * (i + each)])
        self.__init__(self.buckets, self.groups)
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "block"])


def _scatter(hot: np.ndarray, buckets: int, groups: int, k: int, m: int):
    slots = len(hot)

    def run(batches):
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() * 7919
        held = _Blocks(buckets, groups)
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*bytes_of(part.column(1)))
                hashes = words.hashes()
                at, low = minimisers(words, hashes, k, m)
                if not len(at):
                    continue
                ids = np.asarray(part.column(0).to_numpy(zero_copy_only=False), np.int64)
                text, begin, end = joined(words)
                is_hot = hot[_slot(low, slots)]
                if is_hot.any():
                    w = at[is_hot]
                    digest = [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(begin[w].tolist(), end[w + k - 1].tolist())]
                    held.add_hot(ids[words.doc[w]], w - words.first[words.doc[w]], digest)
                    at, low = at[~is_hot], low[~is_hot]
                if len(at):
                    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (low[1:] != low[:-1])]))
                    first, last = at[new], at[np.append(new[1:], len(at)) - 1]
                    row = words.doc[first]
                    packed = [text[a:b] for a, b in zip(begin[first].tolist(), end[last + k - 1].tolist())]
                    held.add(_bucket(low[new], buckets), ids[row], first - words.first[row], last - first + 1, packed)
                if held.size > HELD_BYTES:
                    yield from held.flush(salt)
                    salt += 1
        yield from held.flush(salt)

    return run


def _ranges(doc: np.ndarray, start: np.ndarray, windows: np.ndarray, text: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first word, end) of words to remove, from one bucket's super-k-mers (``text``: one a line)."""
    data = np.frombuffer(text, np.uint8)
    lines = np.concatenate([[0], np.flatnonzero(data == 10) + 1, [len(data) + 1]]).astype(np.int64)
    total = int(windows.sum())
    place_type = np.int32 if len(data) < 1 << 31 else np.int64
    key, a, b = np.empty(total, np.uint64), np.empty(total, place_type), np.empty(total, place_type)
    n = i = 0
    while i < len(doc):  # hashes in slices: their working arrays are larger than the text
        j = max(i + 1, int(np.searchsorted(lines, lines[i] + (2 << 20), "right")) - 1)
        at, to = lines[i], lines[j] - 1
        words = Words(data[at:to], np.append(lines[i:j] - at, to - at))
        w = words.windows(k)
        key[n : n + len(w)] = chained(words.hashes(), w, k)
        a[n : n + len(w)] = words.start[w] + at
        b[n : n + len(w)] = words.end[w + k - 1] + at
        n, i = n + len(w), j
    assert n == total
    row = np.repeat(np.arange(len(doc), dtype=np.int32), windows)
    owner = doc[row]
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    del key
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    size = np.diff(np.append(head, total))
    many = np.repeat(size > 1, size)
    order, group = order[many], np.repeat(np.arange(int((size > 1).sum())), size[size > 1])
    if not len(order):
        z = np.zeros(0, np.int64)
        return z, z, z
    low = np.minimum.reduceat(owner[order], np.flatnonzero(np.diff(group, prepend=-1)))
    spread = low != np.maximum.reduceat(owner[order], np.flatnonzero(np.diff(group, prepend=-1)))
    order, group = order[spread[group]], group[spread[group]]
    if not len(order):
        z = np.zeros(0, np.int64)
        return z, z, z
    # equal hashes are confirmed on the words; a collision would fall into groups of its own
    heads = np.flatnonzero(np.diff(group, prepend=-1))
    lead = np.repeat(order[heads], np.diff(np.append(heads, len(order))))
    al, bl, ah, bh = a[order].tolist(), b[order].tolist(), a[lead].tolist(), b[lead].tolist()
    if not all(text[p:q] == text[r:s] for p, q, r, s in zip(al, bl, ah, bh)):
        seen: dict = {}
        group = np.array([seen.setdefault(text[p:q], len(seen)) for p, q in zip(al, bl)])
        again = np.argsort(group, kind="stable")
        order, group = order[again], group[again]
        heads = np.flatnonzero(np.diff(group, prepend=-1))
    low = np.repeat(np.minimum.reduceat(owner[order], heads), np.diff(np.append(heads, len(order))))
    gone = np.sort(order[owner[order] > low])
    if not len(gone):
        z = np.zeros(0, np.int64)
        return z, z, z
    first_of_row = np.cumsum(windows) - windows
    place = start[row[gone]] + gone - first_of_row[row[gone]]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(gone) != 1) | (row[gone][1:] != row[gone][:-1])]))
    last = np.append(new[1:], len(gone)) - 1
    return owner[gone[new]], place[new], place[last] + k


def _opened(batches, grouped: bool):
    """(kind, doc, start, windows, bucket, body) of every block; all of them are views of its bytes."""
    codec = pa.Codec("zstd")
    for batch in batches:
        for block in batch.column(1):
            block = block.as_py()
            raw = codec.decompress(block[8:], int.from_bytes(block[:8], "little"), asbytes=True)
            kind, n = np.frombuffer(raw, np.int64, 2).tolist()
            doc, start, at = np.frombuffer(raw, np.int64, n, 16), np.frombuffer(raw, np.int32, n, 16 + 8 * n), 16 + 12 * n
            windows = bucket = np.zeros(0, np.int32)
            if not kind:
                windows, at = np.frombuffer(raw, np.int32, n, at), at + 4 * n
                if grouped:
                    bucket, at = np.frombuffer(raw, np.int32, n, at), at + 4 * n
            yield kind, doc, start, windows, bucket, memoryview(raw)[at:]


def _split(buckets: int):
    """The blocks of a group of buckets, block by block for its buckets."""

    def run(batches):
        from pyspark import TaskContext

        salt, held = TaskContext.get().partitionId() * 7919, _Blocks(buckets, buckets)
        for kind, doc, start, windows, bucket, body in _opened(batches, True):
            if kind:
                held.add_hot(doc, start, [bytes(body[i : i + 16]) for i in range(0, len(body), 16)])
            else:
                held.add(bucket, doc, start, windows, bytes(body).split(b"\n"))
            if held.size > HELD_BYTES:
                yield from held.flush(salt)
                salt += 1
        yield from held.flush(salt)

    return run


def _count(k: int):
    def run(batches):
        cold = []
        for kind, doc, start, windows, _, body in _opened(batches, False):
            if kind:
                digest = pa.Array.from_buffers(pa.binary(16), len(doc), [None, pa.py_buffer(body)]).cast(pa.binary())
                yield _out(doc, start, start, digest)
            else:
                cold.append((doc, start, windows, body))
        if cold:
            doc, start, windows = (np.concatenate([c[i] for c in cold]).astype(np.int64) for i in range(3))
            text = b"\n".join([c[3] for c in cold])
            del cold
            made = _ranges(doc, start, windows, text, k)
            yield _out(*made, pa.nulls(len(made[0]), pa.binary()))

    return run


def _out(doc, start, stop, digest) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), digest], names=["id", "start", "stop", "digest"])


def removals(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = K, m: int = M) -> DataFrame:
    """(id, ranges): the word ranges to remove from each document that loses any."""
    slim = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text")).where("id is not null")
    buckets = parts(docs, text, BUCKET_BYTES)
    bits = min(MOST_BITS, max(SLOT_BITS, (64 * buckets - 1).bit_length()))
    hot = _heat(slim, buckets, bits, k, m)
    groups = buckets if buckets <= ONE_LEVEL else int(np.ceil(buckets**0.5))
    sent = slim.mapInArrow(_scatter(hot, buckets, groups, k, m), "bucket int, block binary").repartitionById(groups, "bucket")
    if groups < buckets:
        sent = sent.mapInArrow(_split(buckets), "bucket int, block binary").repartitionById(buckets, "bucket")
    found = cut(sent.mapInArrow(_count(k), "id long, start int, stop int, digest binary"))
    rows = found.where("digest is null").select("id", "start", "stop")
    if hot.any():
        windows = found.where("digest is not null").select("id", "start", "digest")
        # written first, so that the join below reads both sides from plain shuffles and Spark may split its skewed partitions
        firsts = cut(windows.groupBy("digest").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("digest", "low"))
        warm = windows.join(firsts, "digest").where("id > low").select("id", "start", (F.col("start") + k).alias("stop"))
        rows = rows.unionByName(warm)
    return rows.groupBy("id").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))


def _gone(words: Words, ranges) -> np.ndarray:
    """Which words are removed; ``ranges``: a list column of (start, stop) by row."""
    step = np.zeros(len(words) + 1, np.int64)
    counts = ranges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = ranges.flatten()
    base = np.repeat(words.first[:-1], counts)
    low = flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64) + base
    high = flat.field("stop").to_numpy(zero_copy_only=False).astype(np.int64) + base
    step += np.bincount(low, minlength=len(step))[: len(step)] - np.bincount(high, minlength=len(step))[: len(step)]
    return np.cumsum(step[:-1]) > 0


def report(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = K) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of every document."""
    slim = docs.select(docs[key].cast("long").alias("d_id"), docs[text].alias("text"))
    held = slim.join(removals(docs, text, key, k), F.col("d_id") == F.col("id"), "left").select("d_id", "text", "ranges")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*bytes_of(part.column(1)))
                gone = _gone(words, part.column(2))
                raw, begin, end = joined(words)
                total = np.concatenate([[0], np.cumsum(gone)])
                n_gone = total[words.first[1:]] - total[words.first[:-1]]
                digests = []
                for r, lost in enumerate(n_gone.tolist()):
                    i, j = int(words.first[r]), int(words.first[r + 1])
                    if lost:
                        kept = b" ".join([raw[a:b] for a, b, g in zip(begin[i:j].tolist(), end[i:j].tolist(), gone[i:j].tolist()) if not g])
                    else:
                        kept = raw[begin[i] : end[j - 1]] if j > i else b""
                    digests.append(hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.count, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(digests, pa.string())], names=[key, "n_words", "n_removed", "kept_sha256"])

    return held.mapInArrow(run, f"`{key}` long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = K) -> DataFrame:
    """``docs``, all columns, with removed words (and the white space after them) cut out of ``text``."""
    id_, ranges_ = free("removal_id", docs.columns), free("ranges", docs.columns)
    gone = removals(docs, text, key, k).withColumnRenamed("id", id_).withColumnRenamed("ranges", ranges_)
    held = docs.join(gone, docs[key].cast("long") == F.col(id_), "left").drop(id_)

    def run(part, at):
        col, ranges = part.column(at), part.column(part.num_columns - 1)
        if ranges.null_count == len(ranges):
            return part
        words = Words(*bytes_of(col))
        lost = _gone(words, ranges)
        raw, new = words.data.tobytes(), []
        for r in range(words.rows):
            a, b = int(words.off[r]), int(words.off[r + 1])
            p, q = int(words.first[r]), int(words.first[r + 1])
            mine = lost[p:q]
            if mine.any():
                turn = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0))
                edge = np.append(words.start[p:q], b)[turn]
                bounds = [a, *edge.tolist(), b]
                new.append(b"".join([raw[x:y] for x, y in zip(bounds[::2], bounds[1::2])]).decode())
            else:
                new.append(raw[a:b].decode() if col[r].is_valid else None)
        return part.set_column(at, part.schema.field(at), pa.array(new, col.type))

    return map_rows(held, text, run).drop(ranges_)
