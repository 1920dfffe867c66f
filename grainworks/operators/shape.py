"""Row and table shape: widths, headers, spans, fills and trims."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def modal_width(widths: Counter) -> int:
    """The most frequent field count; the widest of equals."""
    return max(widths, key=lambda w: (widths[w], w)) if widths else 0


def misfits(n: int, width: int) -> str:
    return f"{n} row(s) had more or fewer than {width} fields and were cut or filled up"


def numbered(names: list[str]) -> list[str]:
    """Repeated names get ``_2``, ``_3``, ...; a name that is already taken that way may still repeat."""
    seen: Counter = Counter()
    out = []
    for n in names:
        seen[n] += 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def unique(names: list[str]) -> list[str]:
    """Like ``numbered``, until no name repeats."""
    taken: set[str] = set()
    out = []
    for n in names:
        k, new = 2, n
        while new in taken:
            new, k = f"{n}_{k}", k + 1
        taken.add(new)
        out.append(new)
    return out


def named(names: list[str]) -> list[str]:
    """Blank headers become ``column_i``."""
    return [n.strip() or f"column_{i + 1}" for i, n in enumerate(names)]


def fitted(fields: Column, width: int) -> list[Column]:
    """Each of ``width`` fields, NULL where a row is shorter; what is beyond is left out."""
    return [F.get(fields, F.lit(i)).alias(f"c{i}") for i in range(width)]


#: partitions whose bases fit into an expression; more are joined as a table
BASES = 256


def ranked(df: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """``df`` with ``_row`` in front: from 0 without gaps in the order of the partitions, whose row counts are given; no window, no shuffle."""
    marked, base, total = df.withColumn("__id", F.monotonically_increasing_id()), [], 0
    for p in sorted(sizes):
        base.append((p, total))
        total += sizes[p]
    part, rank = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    if len(base) <= BASES:
        start = F.element_at(F.create_map(*[F.lit(x) for pair in base for x in pair]), part) if base else F.lit(0)
        return marked.select((start + rank).cast("long").alias("_row"), *df.columns)
    table = df.sparkSession.createDataFrame(base, "__part long, __base long")  # one row a partition
    return marked.withColumn("__part", part).join(F.broadcast(table), "__part").select((F.col("__base") + rank).cast("long").alias("_row"), *df.columns)


def with_row(df: DataFrame) -> tuple[DataFrame, int]:
    """(``ranked``, number of rows) by one count a partition."""
    marked = df.select(F.shiftright(F.monotonically_increasing_id(), 33).alias("p"))
    sizes = {r["p"]: r["count"] for r in marked.groupBy("p").count().collect()}
    return ranked(df, sizes), sum(sizes.values())


def spans(lines: DataFrame, line: str, share: float = 1.0) -> list[tuple[int, int]]:
    """Maximal runs of character positions that are not gaps; a gap is blank on at least ``share`` of the lines."""
    longest = lines.agg(F.max(F.char_length(line))).first()[0] or 0
    n = lines.count()
    chars = lines.select(F.posexplode(F.split(F.col(line), "")).alias("pos", "ch")).where("ch <> ''")
    filled = {r["pos"]: r["n"] for r in chars.where(~F.col("ch").rlike(r"^\p{IsWhite_Space}$")).groupBy("pos").agg(F.count("*").alias("n")).collect()}
    gaps = [n - filled.get(p, 0) >= share * n for p in range(longest)]
    return runs(gaps)


def runs(gaps: list[bool]) -> list[tuple[int, int]]:
    out, start = [], None
    for p, gap in enumerate([*gaps, True]):
        if gap and start is not None:
            out.append((start, p))
            start = None
        elif not gap and start is None:
            start = p
    return out


def forward_fill(df: DataFrame, columns: list[str], order: str = "_row", by: list[str] = ()) -> DataFrame:
    """The last value above a null, column by column."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*[F.last(c, ignorenulls=True).over(w).alias(c) if c in columns else F.col(c) for c in df.columns])


BLOCK_ROWS = 64


def region_fill(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Empty cells (row, col, value) inside a merged region (r1, c1, r2, c2, value) take the region's value."""
    hit = (F.col("row") >= F.col("r1")) & (F.col("row") <= F.col("r2")) & (F.col("col") >= F.col("c1")) & (F.col("col") <= F.col("c2"))
    fill = regions.withColumnRenamed("value", "fill").where("fill is not null and r1 <= r2")
    # a region is dealt to the blocks of rows that it meets, so that the join has a key
    block = lambda c: F.floor(F.col(c) / BLOCK_ROWS)
    fill = fill.withColumn("block", F.explode(F.sequence(block("r1"), block("r2"))))
    return cells.join(fill, (block("row") == F.col("block")) & hit, "left").groupBy("row", "col").agg(F.first("value").alias("value"), F.first("fill").alias("fill")).select("row", "col", F.coalesce("value", "fill").alias("value"))


def data_rows(populated: DataFrame, most: int) -> tuple[int, int]:
    """(header row, last row) from (row, populated): leading and trailing rows with fewer than two values are junk."""
    need = 2 if most > 1 else 1
    r = populated.agg(F.min(F.when(F.col("populated") >= need, F.col("row"))), F.max(F.when(F.col("populated") >= need, F.col("row")))).first()
    return (r[0] or 0), (r[1] if r[1] is not None else -1)


def safe_suffix(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "_")


def disambiguated_stems(files: DataFrame) -> DataFrame:
    """(path, stem, ext) with ``name``: stems that several files share carry their extension."""
    w = Window.partitionBy("stem")
    return files.withColumn("name", F.when(F.count("*").over(w) > 1, F.concat("stem", F.lit("_"), "ext")).otherwise(F.col("stem")))
