"""A training corpus from ``documents``: quality rules, near-dedup, substring dedup, secret masking, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the
next one's ``docs``.  All but the last return the columns of ``documents``; the last returns one row for each
piece of a document with its place in a training sequence.

Defined results: a null text counts as empty, which the quality rules reject; rows without an id are judged, cut and
packed one by one and are nobody's copy; of rows that share an id and are near copies of an earlier document all go; ties go to
the smallest id; an empty table gives an empty table; extra columns of any name go along to the packing stage.  Texts
are handled in slices of bounded size, so that one very long text costs its own size and no more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from grainworks.llm.frames import shared_folder, table
from grainworks.llm.minhash import keep_first
from grainworks.llm.packing import pack_documents
from grainworks.llm.quality import keep
from grainworks.llm.secrets import redact
from grainworks.llm.substring import remove


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules accept (operator 6)."""
    return keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 3)."""
    return keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has (operator 1)."""
    return remove(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets masked (operator 10)."""
    return redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts packed into sequences (operator 9)."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: The tokeniser of the last stage has no SQL form; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
