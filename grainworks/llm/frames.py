"""Small helpers shared by the operators: table access, sizes, lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one is set only where there is none (tests)."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def free(name: str, columns: list[str]) -> str:
    """``name``, or it with more underscores if a column is called so (names are compared as Spark does, without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: ids that are sent to every task: 16 MB of a hash table at most
SENT_IDS = 500_000
_CLEAN, _BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxBytesPerBatch"


def cut(df: DataFrame, batch: str | None = None) -> DataFrame:
    """``df`` written to the shared checkpoint folder and reread, so that a lost executor costs no recomputation.

    The shuffle files that it was made from go when it is written: no step needs the disk of the one before.  ``batch``
    bounds the bytes of an Arrow batch while it is made, for stages whose rows are wide.
    """
    spark = df.sparkSession
    shared_folder(spark)
    own = {_CLEAN: "true"} | ({_BATCH: batch} if batch else {})
    before = {name: spark.conf.get(name) for name in own}
    try:
        for name, value in own.items():
            spark.conf.set(name, value)
        return df.select("*").checkpoint(eager=True)  # a plan of its own: it takes the settings when it is made
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def sent(ids: DataFrame) -> DataFrame:
    """Written ids, marked to be sent to every task if they are at most SENT_IDS, so that what they meet is not shuffled."""
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def input_bytes(df: DataFrame, column: str) -> int:
    """The size of the input, used only to choose how many partitions to make: of files their size, else the text's."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 50:  # the optimizer does not know
        size = df.selectExpr(f"coalesce(sum(octet_length(`{column}`)), 0) AS n").first()["n"] // 2
    return size


def parts(df: DataFrame, column: str, bytes_each: int) -> int:
    """Partitions for ``df`` so that each holds about ``bytes_each`` of its (compressed) input."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-input_bytes(df, column) // bytes_each))


def map_slices(df: DataFrame, column: str, fn, schema: str) -> DataFrame:
    """``fn(record batch) -> list of arrays`` over slices of bounded text size, in the order of ``schema``'s columns."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    from grainworks.llm.text import slices

    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for part in slices(batch, column):
                made = fn(part)
                yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) and a.type == f.type else pa.array(a, f.type) for a, f in zip(made, kinds, strict=True)], schema=kinds)

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, column: str, fn) -> DataFrame:
    """``fn(record batch, place of column) -> record batch`` over slices of bounded text size; columns, and any names, stay.

    Python sees columns by place: Spark cannot hand over names with dots.
    """
    from pyspark.sql.types import StructField, StructType

    from grainworks.llm.text import slices

    at = df.columns.index(column)
    names = [f"c{i}" for i in range(len(df.columns))]
    kinds = StructType([StructField(n, f.dataType) for n, f in zip(names, df.schema.fields)])

    def run(batches):
        for batch in batches:
            for part in slices(batch, f"c{at}"):
                yield fn(part, at)

    return df.toDF(*names).mapInArrow(run, kinds).toDF(*df.columns)
