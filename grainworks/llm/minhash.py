"""MinHash near-dedup with bottom-k sketches of one hash function.

1. *Sketch.*  One pass over the texts gives each document the size and a 128-bit digest of its set of
   distinct 5-word shingles, and the SKETCH smallest hashes of the set.  Documents with one digest are one
   class (an aggregate with map-side combining); only class representatives go on, so thousands of exact
   copies cost one row.
2. *Hot values.*  Retained values that very many classes share (a passage, a licence, a large group of near
   copies) would make lists of otherwise different texts.  They are counted in two aggregates with map-side
   combining, first among the KEYS smallest values of every class, then among all LOW whole ones of the
   classes that hold any found before.  Their set goes to the tasks as a bitmap; the count above which a
   value is hot doubles until at most MOST_HOT values are, so the bitmap is bounded.  Whether a value is hot
   depends on the value only, so similar texts agree on it.
3. *Inverted lists.*  The KEYS smallest values that are not hot are keys of lists.  Two classes at the
   threshold miss all of them with a probability of about 0.15 ** 12, and of 0.4 ** 12 if only COLD_SHARE
   of their values are not hot.  Classes with less than that are made of shared passages: they also meet
   under BANDS combined keys, each of the BAND retained values that come first in an order of its own.
4. *Links.*  Members of a list are first compared with its smallest member only: a group of near copies
   links up with one pair a member.  A list that still spans several components is compared in full, in
   numpy, without emitting pairs; a list over LIST members or WEIGHT shingles is cut into blocks, and each
   pair of blocks is compared once.
5. *Estimate, then verify.*  The union sketch (the smallest hashes of both sketches together) estimates the
   Jaccard similarity; pairs five standard deviations below the threshold go, the others are confirmed on
   the full sets.  Links make components, and the smallest id of a component stays.

Defined results: null, empty or wordless texts have an empty set and are linked with nothing; texts with
fewer than five words have their whole sequence as the only shingle; rows that share an id are one
document each with its own set and meet under the id; a null id is kept as its own component; ties go to
the smallest id; an empty table gives an empty table; extra columns are ignored by ``groups`` and kept by
``keep_first`` whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainworks.llm.frames import cut, free, map_slices, sent
from grainworks.llm.graph import components
from grainworks.llm.text import Words, bytes_of, chained, lower, mix, slices

SHINGLE, PERCENT = 5, 85
#: values of a sketch (their upper 32 bits), those of them kept whole as possible keys, keys of a class
SKETCH, LOW, KEYS = 128, 64, 12
#: a value in more lists' rows than this is hot; hot values at most (2 MB of them, a bitmap of 16 MB)
HOT, MOST_HOT = 128, 1 << 21
#: with a smaller share of values that are not hot, combined keys are added: how many, and of how many values each
COLD_SHARE, BANDS, BAND = 0.4, 20, 4
#: members, and shingles in all, that one task compares
LIST, WEIGHT = 2048, 1 << 22
_PAD = np.uint32(0xFFFFFFFF)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row bounds): the distinct shingle hashes of each row, ascending."""
    words = Words(lower(data), off)
    hashes = words.hashes()
    at = words.windows(SHINGLE)
    values, rows = chained(hashes, at, SHINGLE), words.doc[at]
    for n in range(1, SHINGLE):  # short texts: the whole sequence
        short = np.flatnonzero(words.count == n)
        if len(short):
            values = np.concatenate([values, chained(hashes, words.first[short], n)])
            rows = np.concatenate([rows, short])
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    if len(values):
        new = np.concatenate([[True], (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])])
        values, rows = values[new], rows[new]
    return values, np.searchsorted(rows, np.arange(words.rows + 1))


def sketches(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(id, n, digest, sketch, tail): the SKETCH smallest hashes' upper 32 bits, ascending, and the LOW smallest ones' lower 32 bits."""

    def run(part):
        values, bounds = shingle_sets(*bytes_of(part.column(1)))
        digest, sketch, tail = [], [], []
        tops, ends = (values >> np.uint64(32)).astype("<u4"), values.astype("<u4")
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            digest.append(xxhash.xxh3_128_digest(values[a:b].tobytes()) if b > a else None)
            sketch.append(tops[a : min(b, a + SKETCH)].tobytes())
            tail.append(ends[a : min(b, a + LOW)].tobytes())
        return [part.column(0), np.diff(bounds), digest, sketch, tail]

    slim = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text"))
    return map_slices(slim, "text", run, "id long, n long, digest binary, sketch binary, tail binary")


def _filled(flat: np.ndarray, size: np.ndarray, width: int, pad) -> np.ndarray:
    out = np.full((len(size), width), pad, flat.dtype)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _matrix(sketch: list[bytes], width: int | None = None) -> np.ndarray:
    """Sketches as rows of SKETCH (or ``width``) values, padded."""
    size = np.array([len(s) // 4 for s in sketch], np.int64)
    return _filled(np.frombuffer(b"".join(sketch), "<u4").astype(np.uint32), size, width or SKETCH, _PAD)


def _values(sketch: list[bytes], tail: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the LOW smallest hashes in full, ascending; which of them there are)."""
    low = _matrix(tail, LOW)
    there = np.arange(LOW) < np.array([len(t) // 4 for t in tail], np.int64)[:, None]
    return _matrix(sketch)[:, :LOW].astype(np.uint64) << np.uint64(32) | low, there


def estimates(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Jaccard similarity of each row of ``x`` with that of ``y`` (or of one row with all): shares of the union sketch.

    Both sketches are complete up to the smaller of their largest values, so every hash up to there is known on both
    sides; a sketch that is not full is the whole set.
    """
    x = np.broadcast_to(x, y.shape)
    reach = np.minimum(x[:, -1], y[:, -1])[:, None]  # the pad, if neither is full
    in_x, in_y = ((z <= reach) & (z < _PAD) for z in (x, y))
    both = np.sort(np.concatenate([np.where(in_x, x, _PAD), np.where(in_y, y, _PAD)], axis=1), axis=1)
    shared = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] < _PAD)).sum(1)
    return shared / np.maximum(1, in_x.sum(1) + in_y.sum(1) - shared)


def estimates_with(row: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``estimates`` of one row with all rows of ``y``, by looking the values up in it."""
    reach = np.minimum(row[-1], y[:, -1])[:, None]
    at = np.minimum(np.searchsorted(row, y), len(row) - 1)
    known = (y <= reach) & (y < _PAD)
    shared = ((row[at] == y) & known).sum(1)
    mine = np.searchsorted(row, reach[:, 0], "right") - np.where(reach[:, 0] == _PAD, (row == _PAD).sum(), 0)
    return shared / np.maximum(1, mine + known.sum(1) - shared)


def least_estimate(percent: int) -> float:
    p = percent / 100
    return p - 5 * (p * (1 - p) / SKETCH) ** 0.5


class Hot:
    """A set of hot values as a bitmap over their hashes; other values fall into it with a probability of 1/64 at most."""

    def __init__(self, values: np.ndarray):
        self.mask = np.uint64((1 << max(16, (64 * len(values) - 1).bit_length())) - 1)
        self.bits = np.zeros((int(self.mask) + 1) // 8, np.uint8)
        at = mix(values) & self.mask
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def holds(self, values: np.ndarray) -> np.ndarray:
        at = mix(values) & self.mask
        return self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1) > 0


def _frequent(classes: DataFrame, width: int, among=None) -> np.ndarray:
    """Values that more than HOT classes hold within their ``width`` smallest; with ``among``, of the classes that hold one of those."""

    def run(batches):
        for batch in batches:
            values, there = _values(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if among is not None:
                there &= (among.value.holds(values) & there).any(1)[:, None]
            value, n = np.unique(values[:, :width][there[:, :width]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n, pa.int64())], names=["value", "n"])

    counts = cut(classes.select("sketch", "tail").mapInArrow(run, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).where(f"n > {HOT}"))
    above = HOT
    while counts.where(f"n > {above}").count() > MOST_HOT:
        above *= 2
    return counts.where(f"n > {above}").select("value").toArrow().column("value").to_numpy().view(np.uint64)  # at most MOST_HOT


def combined(sketch: np.ndarray) -> np.ndarray:
    """(rows, BANDS) keys, each of the BAND values of a row's sketch that come first in an order of its own."""
    out = np.empty((len(sketch), BANDS), np.uint64)
    there, values = sketch < _PAD, sketch.astype(np.uint64)
    for t in range(BANDS):
        order = np.where(there, mix(values ^ mix(np.uint64([t + 1]))), _ALL)
        lead = np.sort(np.partition(order, BAND - 1, axis=1)[:, :BAND], axis=1)
        out[:, t] = chained(lead.reshape(-1), np.arange(len(sketch)) * BAND, BAND) + np.uint64(t)
    return out


def keyed(classes: DataFrame) -> DataFrame:
    """(rep, n, keys): the keys under which a class meets others."""
    context = classes.sparkSession.sparkContext
    found = _frequent(classes, KEYS)
    if len(found):
        found = np.union1d(found, _frequent(classes, LOW, context.broadcast(Hot(found))))
    hot = context.broadcast(Hot(found)) if len(found) else None

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch, tail = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            values, there = _values(sketch, tail)
            cold = there & ~hot.value.holds(values) if hot is not None else there
            own = cold & (np.cumsum(cold, axis=1) <= KEYS)
            row, key = np.nonzero(own)[0], values[own]
            few = np.flatnonzero(cold.sum(1) < COLD_SHARE * there.sum(1))
            if len(few):
                row = np.concatenate([row, np.repeat(few, BANDS)])
                key = np.concatenate([key, combined(_matrix([sketch[i] for i in few.tolist()])).reshape(-1)])
                order = np.argsort(row, kind="stable")
                row, key = row[order], key[order]
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key.view(np.int64)))], names=["rep", "n", "keys"])

    return classes.select("rep", "n", "sketch", "tail").mapInArrow(run, "rep long, n long, keys array<long>")


def _sized(percent: int):
    """The smaller set must reach ``percent`` of the larger one."""
    return F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose union sketch does not rule them out."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("sketch").alias(f"s_{x}"))
    floor = least_estimate(percent)

    def run(batches):
        for batch in batches:
            good = estimates(_matrix(batch.column(2).to_pylist()), _matrix(batch.column(3).to_pylist())) >= floor if batch.num_rows else np.zeros(0, bool)
            yield batch.select([0, 1]).filter(pa.array(good))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _some(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts with a wanted id: where the ids can be sent to the scan, no other text is shuffled."""
    return texts.join(sent(cut(wanted.distinct())), "id", "left_semi")


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; ``texts``: (id, text), one row an id; ``pairs`` are written already."""
    texts = _some(texts, pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t_a", 1 << 20):
                sets = [shingle_sets(*bytes_of(part.column(i))) for i in (2, 3)]
                size = [np.diff(b) for _, b in sets]
                keys = np.sort(np.concatenate([mix(v ^ mix(np.repeat(np.arange(len(s)), s).astype(np.uint64) + np.uint64(1))) for (v, _), s in zip(sets, size)]))
                # the row of a match: look its key up among one side's
                rows = np.repeat(np.arange(len(size[0])), size[0])
                mine = mix(sets[0][0] ^ mix(rows.astype(np.uint64) + np.uint64(1)))
                both = keys[1:][keys[1:] == keys[:-1]]
                order = np.argsort(mine)
                hit = rows[order[np.searchsorted(mine[order], both)]] if len(both) else np.zeros(0, np.int64)
                common = np.bincount(hit, minlength=part.num_rows)
                yield part.select([0, 1]).filter(pa.array(100 * common >= percent * (size[0] + size[1] - common)))

    left, right = (texts.select(F.col("id").alias(x), F.col("text").alias(f"t_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "t_a", "t_b").mapInArrow(run, "a long, b long")


_MEMBER = "key long, i int, j int, mine int, rep long, n long, comp long, keys array<long>, sketch binary"


def _compare(percent: int, exact: bool):
    """Over the members of one list (or of blocks i and j of it): those with a partner, or the links themselves.

    Partners are in different components (of two blocks, one in each), of similar size, and not ruled out by the union sketches; a pair that meets in
    several lists is compared in that of its smallest shared key only.  With ``exact`` the members carry their texts
    (``t``), pairs are confirmed on the full sets, and links (a, b) that join what earlier ones have not are returned: fewer
    than members, however dense the list is.
    """
    floor = least_estimate(percent)
    most = np.iinfo(np.int64).max

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("n").to_numpy(), kind="stable")))
        rep, n, comp, mine = (table.column(c).to_numpy() for c in ("rep", "n", "comp", "mine"))
        a, b, touched = [], [], np.zeros(len(rep), bool)
        if len(rep):
            rows = _matrix(table.column("sketch").to_pylist())
            keys = table.column("keys").combine_chunks()
            size = keys.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            keys = _filled(keys.flatten().to_numpy(zero_copy_only=False), size, int(size.max()), most)
            key, label = table.column("key")[0].as_py(), comp.copy()
            across = table.column("i")[0].as_py() != table.column("j")[0].as_py()
            if exact:
                values, bounds = shingle_sets(*bytes_of(table.column("t").combine_chunks()))
        for i in range(len(rep) - 1):
            j = np.arange(i + 1, int(np.searchsorted(n, n[i] * 100 // percent, "right")))
            j = j[label[j] != label[i]]
            if across:
                j = j[mine[j] != mine[i]]
            if len(j):
                own = np.sort(keys[i])
                at = np.minimum(np.searchsorted(own, keys[j]), len(own) - 1)
                j = j[np.where(own[at] == keys[j], keys[j], most).min(1) == key]
            if len(j):
                j = j[estimates_with(rows[i], rows[j]) >= floor]
            if not len(j):
                continue
            if not exact:
                touched[i] = touched[j] = True
                continue
            held = values[bounds[i] : bounds[i + 1]]
            for k in j.tolist():
                if label[k] != label[i]:
                    shared = len(np.intersect1d(held, values[bounds[k] : bounds[k + 1]], assume_unique=True))
                    if 100 * shared >= percent * (n[i] + n[k] - shared):
                        a.append(min(rep[i], rep[k]))
                        b.append(max(rep[i], rep[k]))
                        label[label == label[k]] = label[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}) if exact else table.filter(pa.array(touched))

    return run


def _remaining(placed: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components; ``placed``: (rep, n, comp, keys)."""
    lists = placed.select(F.explode("keys").alias("key"), "rep", "n", "comp", "keys")
    stats = cut(lists.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key", "size", "weight"))
    # blocks of half the bounds each, so that two of them meet within the bounds
    needed = F.greatest(F.col("size") / LIST, F.col("weight") / WEIGHT)
    blocks = lists.join(stats, "key").withColumn("blocks", F.when(needed <= 1, 1).otherwise(F.ceil(2 * needed)).cast("int"))
    blocks = blocks.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = blocks.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "n", "comp", "keys")
    members = dealt.join(classes.select("rep", "sketch"), "rep").select("key", "i", "j", "mine", "rep", "n", "comp", "keys", "sketch")
    partners = cut(members.groupBy("key", "i", "j").applyInArrow(_compare(percent, False), _MEMBER))
    told = partners.join(_some(texts, partners.select(F.col("rep").alias("id"))), partners["rep"] == F.col("id")).drop("id").withColumnRenamed("text", "t")
    return told.groupBy("key", "i", "j").applyInArrow(_compare(percent, True), "a long, b long").distinct()


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of ``docs``."""
    drawn = cut(sketches(docs, text, key))
    classes = cut(drawn.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("tail").alias("tail")))
    meet = cut(keyed(classes))
    lists = meet.select(F.explode("keys").alias("key"), "rep", "n")
    # written first, so that the join reads both sides from plain shuffles and Spark may split its skewed partitions
    first = cut(lists.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("p"), F.count("*").alias("size")).where("size > 1").select("key", F.col("p.rep").alias("b"), F.col("p.n").alias("n_b")))
    slim = lists.select("key", F.col("rep").alias("a"), F.col("n").alias("n_a"))
    pairs = slim.join(first, "key").where("a > b").where(_sized(percent)).select("a", "b").distinct()
    # one text an id: a class representative's
    texts = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text"))
    links = cut(verified(cut(_estimated(pairs, classes, percent)), texts, percent), "8m")
    near = components(links)
    placed = cut(meet.join(near, F.col("rep") == F.col("id"), "left").select("rep", "n", F.coalesce("component", "rep").alias("comp"), "keys"))
    more = cut(_remaining(placed, classes, texts, percent), "8m")
    if not more.isEmpty():
        near = components(near.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = classes.select("digest", "rep").join(near, F.col("rep") == F.col("id"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    held = drawn.select("id", "n", "digest").join(named, "digest", "left")
    own = F.coalesce("component", "id")
    return held.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, that are the smallest id of their group."""
    name = free("gone", docs.columns)
    gone = groups(docs, text, key, percent).where("not kept").select(F.col(key).alias(name)).distinct()
    return docs.join(sent(cut(gone)), docs[key].cast("long") == F.col(name), "left_anti")
