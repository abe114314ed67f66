"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import contextlib
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtable.operators.scratch import dropped, dropped_since, mark, scratch, shared_dir, written
from loomtable.operators.skew import salted_join

__all__ = ["ascii_lower", "batches_of", "dropped", "dropped_since", "has", "mark", "packed", "salted_join", "scratch", "shared_dir", "small_batches", "table", "unpacked", "written"]


def ship() -> None:
    """Where executors would not find this package on their path, pickle its functions by value."""
    root = str(Path(__file__).resolve().parents[2])
    known = {os.path.abspath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)} | {os.getcwd()}
    if root not in {os.path.realpath(p) for p in known}:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules["loomtable"])


ship()


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """While this holds, Python workers get Arrow batches of at most so many rows: for steps that run inside, over long rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def has(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


#: Rows of an Arrow batch of whole texts.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """From here on the session sends Python workers batches of at most ``BATCH_ROWS`` rows: batches hold whole texts, and their memory, on both sides, is not part of the heap.  A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def packed(df: DataFrame, text: str) -> DataFrame:
    """All columns but the text as one struct ``row``, and the text as string ``text``: names in ``df`` can't clash with those an operator adds."""
    has(df, text)
    small_batches(df.sparkSession)
    rest = [F.col(f"`{c}`") for c in df.columns if c != text]
    row = F.struct(*rest) if rest else F.struct(F.lit(0).alias("_"))
    return df.select(row.alias("row"), F.col(f"`{text}`").cast("string").alias("text"))


def unpacked(df: DataFrame, columns: list[str], text: str, value: str = "text") -> DataFrame:
    """Undo :func:`packed`: the original columns in their order."""
    return df.select(*[F.col(value).alias(c) if c == text else F.col("row").getField(c).alias(c) for c in columns])


def ascii_lower(column):
    """Lower-cases A-Z alone, as the contracts ask; ``lower`` would change other letters too."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
