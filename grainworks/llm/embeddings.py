"""Embedding near-dedup: an exact range join in a metric space.

On unit vectors, cosine >= c is Euclidean distance <= r with r = sqrt(2 - 2c), so the triangle inequality holds.

1. Equal vectors are one class (an aggregate with map-side combining); class representatives go on.
2. Pivots, drawn by hashed id for each length of vectors, cut the space into cells: a vector's home is its
   nearest pivot.  A statistics pass yields each cell's size and radii.
3. A vector also goes to another cell as a guest, but only if no bound rules out a partner there: the cell's
   ring around its pivot, widened by r, or the distance to the plane between both pivots.  A pair of cells
   meets in one of them.
4. A cell's home vectors (queries) and all its vectors (data) are dealt to tiles of bounded bytes, and each pair
   of a query tile and a data tile joins by itself: matrix products screen pairs, those near the threshold are
   decided in double precision.  It returns each vector's number of links there and the smallest member of its
   local component.  So no task holds more than two tiles, however large or dense a cell is.
5. Sums give the links, and a distributed component search over (vector, local smallest) the components.

Vectors of high intrinsic dimension lie at nearly equal distances from all pivots; bounds then rule out little,
and the work approaches all pairs of tiles, which no exact method avoids.  More pivots would then only send each
vector to more cells, so their number is chosen for the data: a bounded sample is dealt with 1, 4, 16, ... times
the least number of pivots, and the cheapest wins.  The choice has no influence on the result.

Defined results: null or zero vectors, those with null or non-finite components and those of another length
than their partner link with nothing; repeated vectors link with each other; rows that share an id are one
vector if equal, and an id with several different vectors stands for all of them (their links add up where it
is the smallest id of each, and they do not link with each other); a null id links with nothing; ties go to the
smallest id; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainworks.llm.frames import cut
from grainworks.llm.graph import components

COSINE = 0.9
#: rows of a tile: an eighth of all vectors of a length, within these bounds of rows (least) and bytes in single precision (most)
TILE_ROWS, TILE_BYTES = 2048, 8 << 20
#: bytes of all pivots in double precision, and vectors of the sample that decides their number
PIVOT_BYTES, SAMPLE = 16 << 20, 1024
#: seconds to deal a row and to compare two components of a pair, of which only the ratio matters
DEAL, MULTIPLY = 5e-6, 8e-11
_SLACK = 1e-5


def _unit(col: pa.Array) -> np.ndarray:
    """Rows scaled to length 1, in double precision; all have one length."""
    x = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ pivots.T)))


def _sized(rows: DataFrame) -> DataFrame:
    return rows.where("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")


def tile_rows(total: int, length: int) -> int:
    return max(1, min(max(TILE_ROWS, -(-total // 8)), TILE_BYTES // (4 * length)))


QUERY, HOME, GUEST = 0, 1, 2


def _join(table: pa.Table, cosine: float) -> pa.Table:
    """A query tile with a data tile: links of the queries, and of guests among the data."""
    v, copies = _unit(table.column("v").combine_chunks()), table.column("copies").to_numpy().astype(np.int64)
    role = table.column("role").to_numpy()
    rep, at = np.unique(table.column("rep").to_numpy(), return_inverse=True)
    single = v.astype(np.float32)
    label, count = np.arange(len(rep)), np.zeros(len(rep), np.int64)
    queries, data = np.flatnonzero(role == QUERY), np.flatnonzero(role != QUERY)
    step = max(1, (4 << 20) // max(1, len(data)))
    for i in range(0, len(queries), step):
        q = queries[i : i + step]
        near = single[q] @ single[data].T >= cosine - _SLACK
        for k in np.flatnonzero(near.any(1)).tolist():
            a = q[k]
            t = data[near[k]]
            t = t[(at[t] != at[a])]
            t = t[v[t] @ v[a] >= cosine]
            if not len(t):
                continue
            count[at[a]] += copies[t].sum()
            np.add.at(count, at[t[role[t] == GUEST]], copies[a])
            own = np.append(label[at[t]], label[at[a]])
            low = own.min()
            if low != own.max():
                label[np.isin(label, np.unique(own))] = low
    out = (count > 0) | (label != np.arange(len(rep)))
    return pa.table({"rep": rep[out], "links": count[out], "root": rep[label[out]]})


_FOUND = "rep long, links long, root long"


def groups(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", cosine: float = COSINE) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``vectors``."""
    rows = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].alias("v"))
    classes = cut(_sized(rows.where("id is not null")).groupBy("v").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("copies")).withColumn("n", F.size("v")))
    sizes = cut(classes.groupBy("n").agg(F.count("*").alias("total")))
    many = F.col("total") > F.least(F.lit(TILE_ROWS), F.greatest(F.lit(1), F.floor(TILE_BYTES / (4 * F.col("n")))))
    # all vectors of a length that fits one tile meet there; the others need pivots
    few = classes.join(sizes.where(~many), "n").select("n", "rep", "copies", "v")
    twice = few.withColumn("role", F.explode(F.array(F.lit(QUERY), F.lit(HOME))))
    found = twice.groupBy("n").applyInArrow(lambda t: _join(t, cosine), _FOUND)
    large = {r["n"]: r["total"] for r in sizes.where(many).collect()}  # a row for each length of more than a tile of vectors
    if large:
        found = found.unionByName(_links(classes.join(F.broadcast(sizes.where(many)), "n"), large, cosine))
    found = cut(found)
    near = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = classes.join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").join(near, F.col("rep") == F.col("id"), "left")
    named = named.select("v", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    good = rows.join(named, "v", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    links = F.when(F.col("id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0)
    return good.select(F.col("id").alias(key), links.cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))


class Cells:
    """The cells of the vectors of one length: pivots, radii around them, and how many tiles their vectors need."""

    def __init__(self, pivots: np.ndarray, r: float):
        self.pivots, self.r, n = pivots, r, len(pivots)
        self.low, self.high = np.full(n, np.inf), np.full(n, -np.inf)
        self.homes, self.guests = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = _distances(x, self.pivots)
        at = d.argmin(1)
        return at, d[np.arange(len(d)), at]

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, whether that is its home) of every cell that each vector goes to."""
        out, cells = [], np.arange(len(self.pivots))
        step = max(1, (2 << 20) // len(cells))
        for i in range(0, len(x), step):
            d = _distances(x[i : i + step], self.pivots)
            at = d.argmin(1)
            own = d[np.arange(len(d)), at][:, None]
            odd = (at[:, None] + cells) % 2 == 1
            meets = np.where(odd, np.maximum(at[:, None], cells), np.minimum(at[:, None], cells)) == cells
            apart = np.maximum(_distances(self.pivots[at], self.pivots), 1e-9)
            go = meets & (d <= self.high + self.r) & (d >= self.low - self.r) & (d - own <= 2 * self.r) & ((d * d - own * own) / (2 * apart) <= self.r)
            go[np.arange(len(d)), at] = True
            row, cell = np.nonzero(go)
            out.append((row + i, cell, cell == at[row]))
        return tuple(np.concatenate(c) for c in zip(*out))

    def tiled(self, rows: int) -> None:
        self.queries = np.maximum(1, -(-self.homes // rows))
        self.data = np.maximum(1, -(-(self.homes + self.guests) // rows))


def chosen(candidates: np.ndarray, sample: np.ndarray, total: int, rows: int, r: float) -> np.ndarray:
    """The first 1, 4, 16, ... times the least number of ``candidates``: as many pivots as make the sample cheapest to join."""
    best, least, n = candidates[:1], np.inf, min(len(candidates), max(1, -(-total // rows)))
    while True:
        cells = Cells(candidates[:n], r)
        at, d = cells.home(sample)
        np.minimum.at(cells.low, at, d)
        np.maximum.at(cells.high, at, d)
        row, _, _ = cells.visits(sample)
        visits = len(row) / max(1, len(sample))
        cost = visits * (DEAL + total / n * candidates.shape[1] * MULTIPLY)
        if cost < least:
            best, least = candidates[:n], cost
        if n == len(candidates):
            return best
        n = min(4 * n, len(candidates))


def _by_length(batch: pa.RecordBatch):
    """(length, places) of the vectors of each length in a batch."""
    n = batch.column(batch.schema.get_field_index("n")).to_numpy(zero_copy_only=False)
    for length in np.unique(n).tolist():
        yield length, np.flatnonzero(n == length)


def _links(classes: DataFrame, large: dict[int, int], cosine: float) -> DataFrame:
    """(rep, links, root) rows, to be summed by rep; ``large``: the number of vectors of each length."""
    spark, r = classes.sparkSession, float(np.sqrt(2 - 2 * cosine)) + 1e-7
    rows = {n: tile_rows(total, n) for n, total in large.items()}
    # pivots to choose from: the square root of the vectors, or one a tile if those are more, within PIVOT_BYTES for all lengths
    wanted = {n: max(-(-total // rows[n]), int(total**0.5)) for n, total in large.items()}
    share = min(1.0, PIVOT_BYTES / sum(8 * n * k for n, k in wanted.items()))
    rates = spark.createDataFrame([(n, (share * k + 4 * (share * k) ** 0.5 + 8) / large[n], (SAMPLE / len(large) + 8) / large[n]) for n, k in wanted.items()], "n int, rate double, also double")
    place = F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1 << 40)) / float(1 << 40)
    drawn = classes.join(F.broadcast(rates), "n").withColumn("place", place).where("place < rate or place > 1 - also").select("n", "v", "place", (F.col("place") < F.col("rate")).alias("pivot")).orderBy("place").toArrow()
    cells: dict[int, Cells] = {}
    for n, total in large.items():
        own = drawn.filter(pa.array(drawn.column("n").to_numpy() == n))
        is_pivot = own.column("pivot").to_numpy(zero_copy_only=False) if own.num_rows else np.zeros(0, bool)
        v = _unit(own.column("v").combine_chunks()) if own.num_rows else np.zeros((0, n))
        pivots = v[is_pivot] if is_pivot.any() else np.eye(1, n)  # any point may be a pivot
        cells[n] = Cells(chosen(pivots, v[~is_pivot], total, rows[n], r), r)
    shared = spark.sparkContext.broadcast(cells)

    def homes(batches):
        for batch in batches:
            for n, at in _by_length(batch):
                for i in range(0, len(at), 4096):
                    cell, d = shared.value[n].home(_unit(batch.column(1).take(pa.array(at[i : i + 4096]))))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), n), pa.int32()), pa.array(cell, pa.int32()), pa.array(d, pa.float64())], names=["n", "cell", "d"])

    for s in classes.select("n", "v").mapInArrow(homes, "n int, cell int, d double").groupBy("n", "cell").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("k")).collect():  # a row a pivot
        c = cells[s["n"]]
        c.low[s["cell"]], c.high[s["cell"]], c.homes[s["cell"]] = s["low"], s["high"], s["k"]
    ringed = spark.sparkContext.broadcast(cells)

    def guests(batches):
        for batch in batches:
            for n, at in _by_length(batch):
                _, cell, home = ringed.value[n].visits(_unit(batch.column(1).take(pa.array(at))))
                k = np.bincount(cell[~home])
                some = np.flatnonzero(k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), n), pa.int32()), pa.array(some, pa.int32()), pa.array(k[some], pa.int64())], names=["n", "cell", "k"])

    for s in classes.select("n", "v").mapInArrow(guests, "n int, cell int, k long").groupBy("n", "cell").agg(F.sum("k").alias("k")).collect():  # a row a pivot
        cells[s["n"]].guests[s["cell"]] = s["k"]
    for n, c in cells.items():
        c.tiled(rows[n])
    final = spark.sparkContext.broadcast(cells)

    def deal(batches):
        for batch in batches:
            for n, at in _by_length(batch):
                own = batch.take(pa.array(at))
                c, rep = final.value[n], own.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                row, cell, home = c.visits(_unit(own.column(3)))
                mixed = (rep[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
                as_query, as_data = (mixed % c.queries[cell].astype(np.uint64)).astype(np.int64), ((mixed >> np.uint64(7)) % c.data[cell].astype(np.uint64)).astype(np.int64)
                # data go to every query tile of the cell; queries, which are at home there, to every data tile
                sent = []
                for take, times, q, d, role in ((np.flatnonzero(home), c.data, as_query, None, QUERY), (np.arange(len(row)), c.queries, None, as_data, HOME)):
                    k = times[cell[take]]
                    where = np.repeat(take, k)
                    every = np.arange(len(where)) - np.repeat(np.cumsum(k) - k, k)
                    sent.append((where, every if q is None else q[where], every if d is None else d[where], np.full(len(where), role) if role == QUERY else np.where(home[where], HOME, GUEST)))
                where, q, d, role = (np.concatenate(x) for x in zip(*sent))
                for i in range(0, len(where), 20_000):
                    part = own.take(pa.array(row[where[i : i + 20_000]]))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cell[where[i : i + 20_000]], pa.int32()), *[pa.array(x[i : i + 20_000], pa.int32()) for x in (q, d, role)], part.column(1), part.column(2), part.column(3)], names=["n", "cell", "q", "d", "role", "rep", "copies", "v"])

    kind = classes.schema["v"].dataType.simpleString()
    dealt = classes.select("n", "rep", "copies", "v").mapInArrow(deal, f"n int, cell int, q int, d int, role int, rep long, copies long, v {kind}")
    return dealt.groupBy("n", "cell", "q", "d").applyInArrow(lambda t: _join(t, cosine), _FOUND)


#: all pairs, for small tables
SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach(id, other) AS (
  SELECT a, b FROM l UNION SELECT reach.id, l.b FROM reach JOIN l ON l.a = reach.other
), low AS (SELECT id, min(other) AS other FROM reach GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(low.other, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(low.other, e.vec_id)) AS kept
FROM e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN low ON low.id = e.vec_id
"""
