"""ORC and Parquet through Spark's vectorised readers.

``plain`` keeps Spark's column pruning and filter pushdown; ``read`` adds row numbers, under which a filter stays above the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainworks.functions import cells
from grainworks.operators.shape import unique, with_row
from grainworks.plans.model import Options, Outcome, ParseError, Report, Table


def value(c: Column, t: T.DataType) -> Column:
    """A column as a plain one or as cells, by its type."""
    if isinstance(t, T.BooleanType):
        return c
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("bigint")
    if isinstance(t, T.FloatType):
        return c.cast("string").cast("double")  # the shortest decimal, not the widened binary value
    if isinstance(t, T.DoubleType):
        return c
    if isinstance(t, T.StringType):
        return c  # typed value by value in steps of their own, see read
    return shown(c, t)


def shown(c: Column, t: T.DataType) -> Column:
    """Other types as text; nested ones with field names."""
    if isinstance(t, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.regexp_replace(F.date_format(c, ".SSSSSS"), "000$", ""), r"^\.000$", ""), F.lit("Z" if isinstance(t, T.TimestampType) else ""))
    if isinstance(t, T.StructType):
        fields = [F.concat(F.lit(f"{f.name}: "), F.coalesce(shown(c.getField(f.name), f.dataType), F.lit(""))) for f in t.fields]
        return F.when(c.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")))
    if isinstance(t, T.ArrayType):
        return F.when(c.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.coalesce(shown(x, t.elementType), F.lit(""))), ", "), F.lit("]")))
    if isinstance(t, T.MapType):
        pair = lambda e: F.concat(shown(e["key"], t.keyType), F.lit(": "), F.coalesce(shown(e["value"], t.valueType), F.lit("")))
        return F.when(c.isNotNull(), F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(c), pair), ", "), F.lit("}")))
    return c.cast("string")


def read(spark: SparkSession, path: str, filename: str, options: Options, fmt: str) -> Outcome:
    report = Report(filename, fmt)
    report.warning(f"{fmt} support is experimental")
    try:
        df = spark.read.format(fmt).load(path)
    except Exception as e:
        df = _by_arrow(spark, path, fmt, e)
    if not df.columns:
        raise ParseError(fmt, "the file has no columns")
    if fmt == "orc" and df.isEmpty():
        raise ParseError(fmt, "the file has no rows")
    df = df.toDF(*[f"x{i}" for i in range(len(df.columns))]) if len(set(map(str.lower, df.columns))) < len(df.columns) else df
    headers = unique(list(df.columns))
    table, n = with_row(plain(df))
    report.rows_in = report.rows_out = n
    return Outcome([Table(headers, table, filename)], report)


def plain(df: DataFrame) -> DataFrame:
    """``c0``, ``c1``, ... of a columnar table without row numbers: filters on its columns and the choice of columns reach the file scan.

    Text columns become cells beside their ``cI_t`` only where they are used; filter on ``df`` itself to push text conditions down.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    kinds = {c: f.dataType for c, f in zip(names, df.schema.fields)}
    out = df.select(*[value(F.col(f"`{f.name}`"), f.dataType).alias(c) for c, f in zip(names, df.schema.fields)])
    text = [c for c in names if isinstance(kinds[c], T.StringType)]
    return cells.inferred(out, {c: F.col(c) for c in text}, [c for c in names if c not in text]).select(*names) if text else out


def _by_arrow(spark: SparkSession, path: str, fmt: str, why: Exception):
    """Files with types that Spark's reader refuses (times of day, repeated names) through Arrow, if they are Parquet."""
    if fmt != "parquet":
        raise ParseError(fmt, str(why).splitlines()[0]) from None
    import pyarrow as pa
    import pyarrow.parquet as pq

    local = path.removeprefix("file:")
    try:
        table = pq.read_table(local)
    except Exception as e:
        raise ParseError(fmt, str(e).splitlines()[0]) from None
    table = table.rename_columns(unique(table.column_names))
    for i, f in enumerate(table.schema):
        if pa.types.is_time(f.type) or pa.types.is_duration(f.type) or pa.types.is_uint64(f.type):
            table = table.set_column(i, f.name, table.column(i).cast(pa.string()))
    return spark.createDataFrame(table)
