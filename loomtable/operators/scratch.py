"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of intermediate tables that this process has written and not deleted yet.
_live: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where it is unset, a temporary folder serves on one machine; a cluster has none that all of it sees, so there it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="loomtable-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name for one run below the shared folder."""
    return f"{shared_dir(spark)}/loomtable/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    Cuts lineage: a lost executor costs a re-read, not a recomputation, and the
    files are visible to every executor.  ``dropped`` deletes it.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    _live.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomtable_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if path in _live:
        _live.remove(path)


def dropped(*frames: DataFrame) -> None:
    """Deletes the tables behind frames that ``written`` gave and that nothing reads any more; others are left alone."""
    for f in frames:
        path = getattr(f, "_loomtable_path", None)
        if path:
            delete(f.sparkSession, path)


def mark() -> int:
    """For ``dropped_since``: how many intermediate tables there are now."""
    return len(_live)


def dropped_since(spark: SparkSession, at: int, *kept: DataFrame) -> None:
    """Deletes the tables written since ``mark`` gave ``at``, but for those behind ``kept``."""
    keep = {getattr(f, "_loomtable_path", None) for f in kept}
    for path in [p for p in _live[at:] if p not in keep]:
        delete(spark, path)
