"""SentencePiece encoding and decoding with seeded merge-dropout.

The model file gives pieces and scores.  A text gets a leading space; no piece holds a space after another
character, so it falls into independent chunks (spaces, then other characters).  Within a chunk the agenda
takes the best-scored adjacent merge, leftmost first; a candidate is skipped if the keyed hash of (seed,
document id, chunk's place in the document, position, merged piece) falls under the dropout rate.  So every
occurrence of a word is cut by itself, and every run repeats it exactly.

The agenda runs over all chunks of a slice at the same time in numpy, one merge of each chunk a round; very long
chunks use a heap.  The merges of a chunk without dropout are found once and kept: an occurrence of which the hash
drops none of these merges is cut in the same way, since a candidate that was never taken is not missed; all others
run the agenda by themselves.  Characters outside the vocabulary, the visible space character among them, become byte
pieces, so decoding is lossless.

Defined results: a null or empty text has no pieces and decodes to an empty text; repeated rows give equal
pieces; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
from pyspark.sql import DataFrame

from grainworks.llm.frames import map_slices
from grainworks.llm.text import _M1, _M2, bytes_of, mix, span_hashes

DROPOUT, SEED = 0.1, 20
SPACE = "▁"
LONG_CHUNK = 256
RANGE_BYTES = 1 << 20
#: chunks whose merges without dropout are kept in a task (about 200 bytes each)
KEPT_CHUNKS = 150_000
_LOW = (1 << 64) - 1
_NONE = np.int64(1) << np.int64(62)


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """Tables of a BPE model with byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size = n
        self.bytes: list[bytes] = []
        self.byte_id = np.zeros(256, np.int32)
        ids: dict[str, int] = {}
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(p[3:5], 16)
                self.byte_id[b] = i
                self.bytes.append(bytes([b]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                ids[p] = i
                self.bytes.append(p.replace(SPACE, " ").encode())
        order = sorted(ids.values(), key=lambda i: (-sp.get_score(i), i))
        self.rank = np.full(n, n, np.int64)
        self.rank[order] = np.arange(len(order))
        self.char = np.full(0x110000, -1, np.int32)  # a visible space in a text is no space: it goes to byte pieces
        pairs: dict[int, int] = {}
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(" " if p == SPACE else p)] = i
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.pairs = pairs
        length = np.array([len(b) for b in self.bytes])
        self.byte_len, self.byte_at = length, np.cumsum(length) - length
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def merges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each two symbols make, or -1."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.merged[at], -1)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, with its leading space."""
        size = self.byte_len[ids]
        total = int(size.sum())
        at = np.arange(total) + np.repeat(self.byte_at[ids] - (np.cumsum(size) - size), size)
        return self.flat[at].tobytes()


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _skipped(key: np.ndarray, place: np.ndarray, piece: np.ndarray, rate: float) -> np.ndarray:
    """Which candidates the keyed hash drops."""
    h = mix(key ^ mix((place.astype(np.uint64) << np.uint64(20)) | piece.astype(np.uint64)))
    return (h >> np.uint64(11)).astype(np.float64) < rate * float(1 << 53)


def _mix_one(x: int) -> int:
    """``mix`` of one number."""
    x ^= x >> 30
    x = x * int(_M1) & _LOW
    x ^= x >> 27
    x = x * int(_M2) & _LOW
    return x ^ x >> 31


def agenda(m: Model, symbols: list[int], key: int, rate: float) -> list[int]:
    """One chunk by a heap; unknown characters are negative."""
    left, right = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
    now, heap, ranks = list(symbols), [], m.rank
    least = rate * float(1 << 53)

    def push(i: int) -> None:
        j = right[i]
        if j < len(now) and now[i] >= 0 and now[j] >= 0 and (p := m.pairs.get(now[i] << 20 | now[j])) is not None:
            if not (rate and _mix_one(key ^ _mix_one(i << 20 | p)) >> 11 < least):
                heapq.heappush(heap, (int(ranks[p]), i, j, now[i], now[j], p))

    gone = [False] * len(now)
    for i in range(len(now)):
        push(i)
    while heap:
        _, i, j, a, b, p = heapq.heappop(heap)
        if gone[i] or gone[j] or now[i] != a or now[j] != b or right[i] != j:
            continue
        now[i], gone[j], right[i] = p, True, right[j]
        if right[j] < len(now):
            left[right[j]] = i
        if left[i] >= 0:
            push(left[i])
        push(i)
    return [x for x, g in zip(now, gone) if not g]


def segment(m: Model, symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray | None, rate: float, log: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, sizes) after all merges, for many chunks at once; ``log`` gets the (chunk, place, piece) of every merge."""
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    chunk = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    symbols = symbols.astype(np.int64)

    def candidates(i: np.ndarray) -> np.ndarray:
        """rank << 32 | piece of the merge at i with its neighbour, or none."""
        i2 = np.minimum(i + 1, len(symbols) - 1)
        p = np.where((chunk[i] == chunk[i2]) & (i2 > i), m.merges(symbols[i], symbols[i2]), -1)
        ok = p >= 0
        if rate and ok.any():
            ok[ok] = ~_skipped(keys[chunk[i[ok]]], place[i[ok]], p[ok], rate)
        return np.where(ok, m.rank[p] << 32 | p, _NONE)

    best = candidates(np.arange(len(symbols)))
    while len(symbols):
        first = np.flatnonzero(np.diff(chunk, prepend=-1))
        low = np.minimum.reduceat(best, first)
        size = np.diff(np.append(first, len(symbols)))
        live = low < _NONE
        if not live.all():
            out = np.repeat(~live, size)
            done.append((chunk[out], place[out], symbols[out]))
            keep = ~out
            symbols, chunk, place, best = symbols[keep], chunk[keep], place[keep], best[keep]
            low, size = low[live], size[live]
            if not len(symbols):
                break
        hit = np.flatnonzero(best == np.repeat(low, size))
        hit = hit[np.diff(chunk[hit], prepend=-1) != 0]  # the leftmost of equals
        symbols[hit] = best[hit] & 0xFFFFFFFF
        if log is not None:
            log.append((chunk[hit], place[hit], symbols[hit]))
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        at = hit - np.arange(len(hit))
        symbols, chunk, place, best = symbols[keep], chunk[keep], place[keep], best[keep]
        best[at] = candidates(at)
        before = at[at > 0] - 1
        best[before] = candidates(before)
    chunk, place, symbols = (np.concatenate([d[i] for d in done]) if done else np.zeros(0, np.int64) for i in range(3))
    order = np.lexsort((place, chunk))
    return symbols[order], np.bincount(chunk, minlength=len(sizes))


class Ragged:
    """Rows of different lengths in one array."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes, self.starts = flat, sizes, np.cumsum(sizes) - sizes

    def take(self, rows: np.ndarray) -> Ragged:
        size = self.sizes[rows]
        at = np.repeat(self.starts[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return Ragged(self.flat[at], size)

    def and_(self, other: Ragged) -> Ragged:
        return Ragged(np.concatenate([self.flat, other.flat]), np.concatenate([self.sizes, other.sizes]))


class Plain:
    """Chunks by their hash, ascending: their symbols, their pieces without dropout, and the merges that made those."""

    def __init__(self, m: Model):
        none = lambda: Ragged(np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.m, self.hashes, self.symbols, self.pieces, self.merges = m, np.zeros(0, np.uint64), none(), none(), none()

    def rows(self, hashes: np.ndarray, chunks: Ragged) -> tuple[Plain, np.ndarray]:
        """(chunks that hold all of these, the row of each); a chunk whose hash is another one's has row -1."""
        wanted, first = np.unique(hashes, return_index=True)
        new = first[~np.isin(wanted, self.hashes, assume_unique=True)]
        known = self if not len(new) else self._with(hashes[new], chunks.take(new))
        if len(known.hashes) <= KEPT_CHUNKS:
            self.__dict__.update(known.__dict__)
        row = np.searchsorted(known.hashes, hashes)
        same = np.flatnonzero(known.symbols.sizes[row] == chunks.sizes)
        held, own = known.symbols.take(row[same]), chunks.take(same)
        wrong = np.unique(np.repeat(same, own.sizes)[held.flat != own.flat])
        out = np.full(len(row), -1)
        out[same] = row[same]
        out[wrong] = -1
        return known, out

    def _with(self, hashes: np.ndarray, chunks: Ragged) -> Plain:
        log: list = []
        pieces = Ragged(*segment(self.m, chunks.flat, chunks.sizes, None, 0.0, log))
        chunk, place, piece = (np.concatenate([x[i] for x in log]) if log else np.zeros(0, np.int64) for i in range(3))
        order = np.argsort(chunk, kind="stable")
        merges = Ragged((place << 20 | piece)[order], np.bincount(chunk, minlength=len(hashes)))
        out = Plain(self.m)
        by_hash = np.argsort(np.concatenate([self.hashes, hashes]))
        out.hashes = np.concatenate([self.hashes, hashes])[by_hash]
        for name, more in (("symbols", chunks), ("pieces", pieces), ("merges", merges)):
            setattr(out, name, getattr(self, name).and_(more).take(by_hash))
        return out


class Encoder:
    """Encodes slices, every occurrence of a chunk by itself if there is dropout."""

    def __init__(self, m: Model, rate: float, seed: int):
        self.m, self.rate, self.seed, self.plain = m, rate, seed, Plain(m)

    def _short(self, hashes: np.ndarray, chunks: Ragged, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, sizes) of short chunks after all merges."""
        if not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known, row = self.plain.rows(hashes, chunks)
        alone = row < 0
        merges = known.merges.take(np.maximum(row, 0))
        if self.rate:
            of = np.repeat(np.arange(len(row)), merges.sizes)
            lost = _skipped(keys[of], merges.flat >> 20, merges.flat & 0xFFFFF, self.rate)
            alone[of[lost]] = True
        out = known.pieces.take(np.maximum(row, 0))
        if not alone.any():
            return out.flat, out.sizes
        apart = np.flatnonzero(alone)
        own = chunks.take(apart)
        done = Ragged(*segment(self.m, own.flat, own.sizes, keys[apart], self.rate))
        at = np.arange(len(row))
        at[apart] = len(row) + np.arange(len(apart))
        both = out.and_(done).take(at)
        return both.flat, both.sizes

    def encode(self, data: np.ndarray, off: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, row bounds) of texts that already have their leading space; ``docs`` are the rows' ids."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        space = data == 32
        new = space.copy()
        new[1:] &= ~space[:-1]
        new[off[:-1][np.diff(off) > 0]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], n)
        row = np.searchsorted(off, start, "right") - 1
        salt = mix(docs.astype(np.int64).view(np.uint64) + np.uint64(self.seed * 1_000_003 + 1))
        nth = np.arange(len(start)) - np.searchsorted(start, off)[row]
        keys = mix(salt[row] ^ mix(nth.astype(np.uint64)))
        # a long text by ranges of chunks, so that memory is bounded by the range and the longest chunk
        cuts = np.unique(np.append(np.searchsorted(start, np.arange(0, n, RANGE_BYTES)), len(start))).tolist()
        done = [self._segment(data[start[a] : end[b - 1]], end[a:b] - start[a:b], keys[a:b]) for a, b in zip(cuts, cuts[1:])]
        ids, size = (np.concatenate([d[i] for d in done]) for i in range(2))
        ends = np.concatenate([[0], np.cumsum(size)])
        return ids.astype(np.int32), ends[np.searchsorted(start, off)]

    def _segment(self, data: np.ndarray, size: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per chunk) of chunks of these byte sizes, which cover ``data``."""
        m, text = self.m, data.tobytes()
        points = np.frombuffer(text.decode().encode("utf-32-le"), "<u4").astype(np.int64)
        lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        sizes = np.diff(np.concatenate([[0], np.cumsum(lead)])[np.concatenate([[0], np.cumsum(size)])])
        symbols = m.char[points].astype(np.int64)
        symbols[symbols < 0] = -1 - points[symbols < 0]
        short = sizes <= LONG_CHUNK
        inside = np.repeat(short, sizes)
        stop = np.cumsum(size)
        hashes = span_hashes(data, stop - size, stop)
        own, count = self._short(hashes[short], Ragged(symbols[inside], sizes[short]), keys[short])
        counts = np.zeros(len(sizes), np.int64)
        counts[short] = count
        parts = [own]
        if not short.all():
            ends = np.cumsum(sizes)
            parts, done = [], 0
            short_ends = np.concatenate([[0], np.cumsum(count)])
            for c in np.flatnonzero(~short).tolist():
                k = int(short[:c].sum())
                parts.append(own[short_ends[done] : short_ends[k]])
                done = k
                long = np.array(agenda(m, symbols[ends[c] - sizes[c] : ends[c]].tolist(), int(keys[c]), self.rate), np.int64)
                counts[c] = len(long)
                parts.append(long)
            parts.append(own[short_ends[done] :])
        out = np.concatenate(parts)
        return self._bytes(out, counts)

    def _bytes(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters as byte pieces."""
        odd = np.flatnonzero(symbols < 0)
        if not len(odd):
            return symbols, counts
        spelled = [self.m.byte_id[list(chr(-1 - p).encode())] for p in symbols[odd].tolist()]
        width = np.ones(len(symbols), np.int64)
        width[odd] = [len(s) for s in spelled]
        ends = np.cumsum(width)
        out = np.repeat(symbols, width)
        for i, s in zip(odd.tolist(), spelled):
            out[ends[i] - len(s) : ends[i]] = s
        total = np.concatenate([[0], ends])
        bound = np.concatenate([[0], np.cumsum(counts)])
        return out, np.diff(total[bound])


def with_space(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a leading space each; empty ones stay empty."""
    full = np.diff(off) > 0
    grown = np.insert(data, off[:-1][full], 32)
    return grown, off + np.concatenate([[0], np.cumsum(full)])


def encode_texts(texts: list[str], rate: float = 0.0, seed: int = SEED, first: int = 0, path: str | None = None) -> list[list[int]]:
    """The ids of texts as documents ``first``, ``first`` + 1, ..."""
    import pyarrow as pa

    data, off = with_space(*bytes_of(pa.array(texts, pa.large_string())))
    ids, bounds = Encoder(model(path or model_file()), rate, seed).encode(data, off, first + np.arange(len(texts)))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


def decode_ids(ids: list[int], path: str | None = None) -> str:
    return model(path or model_file()).decode(np.array(ids, np.int64))[1:].decode() if ids else ""


SCHEMA = "n_pieces long, ids_crc32 long, lossless boolean"


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", rate: float = DROPOUT, seed: int = SEED, path: str | None = None, ids_out: bool = False) -> DataFrame:
    """(key, n_pieces, ids_crc32, lossless) of every document, and the ids themselves if asked for."""
    path = path or model_file()
    held: dict = {}

    def run(part):
        import pyarrow as pa

        m = model(path)
        if "coder" not in held:
            held["coder"] = Encoder(m, rate, seed)
        raw, raw_off = bytes_of(part.column(1))
        data, off = with_space(raw, raw_off)
        id_col = part.column(0).fill_null(0)
        ids, bounds = held["coder"].encode(data, off, np.asarray(id_col.to_numpy(zero_copy_only=False), np.int64))
        back = np.frombuffer(m.decode(ids), np.uint8)
        ends = np.concatenate([[0], np.cumsum(m.byte_len[ids])])[bounds]
        if len(back) == len(data) and (ends == off).all():
            wrong = np.concatenate([[0], np.cumsum(back != data)])
            same = np.diff(wrong[off]) == 0
        else:
            text, was = back.tobytes(), data.tobytes()
            same = np.array([text[a:b] == was[c:d] for a, b, c, d in zip(ends[:-1].tolist(), ends[1:].tolist(), off[:-1].tolist(), off[1:].tolist())])
        out = ids.astype("<u4").tobytes()
        crc = [zlib.crc32(out[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        more = [pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(ids, pa.int32())).cast(pa.list_(pa.int32()))] if ids_out else []
        return [part.column(0), np.diff(bounds), crc, same, *more]

    slim = docs.select(docs[key].cast("long").alias(key), docs[text].alias(text))
    return map_slices(slim, text, run, f"`{key}` long, {SCHEMA}" + ", ids array<int>" * ids_out)
