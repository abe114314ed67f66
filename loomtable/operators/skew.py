"""Joins on keys of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``left`` joined with a smaller ``right``: the rows of one key are dealt over ``salts`` tasks by the columns ``spread``, and each row of ``right`` goes to all of them."""
    a = left.withColumn("_loom_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    b = right.withColumn("_loom_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*on, "_loom_salt"], how).drop("_loom_salt")
