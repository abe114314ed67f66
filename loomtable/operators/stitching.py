"""Stitching and normalising web tables of a site: value cleaning, class prediction, unions of clustered columns, decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtable.functions import text as T
from loomtable.operators import cluster, profile


def cleaned_values(cells: DataFrame, shapes: DataFrame, least: float = 0.5) -> DataFrame:
    """Cells with columns of numbers, dates or bracketed texts normalised: numbers as doubles, dates as yyyy-MM-dd, texts without the bracket; texts lower-case and without a leading number and dot."""
    df = cells.join(shapes.select("table_id", "ci", "numeric", "date", "bracketed"), ["table_id", "ci"], "left")
    t = F.trim("text")
    number, date = T.plain_number(t), T.parsed_date(t)
    plain = F.lower(F.regexp_replace(t, r"^[0-9]+\.\s+", ""))
    out = F.when((F.col("date") > least) & date.isNotNull(), date.cast("string")).when((F.col("numeric") > least) & number.isNotNull(), number.cast("string")).when(F.col("bracketed") > least, F.lower(F.trim(F.regexp_replace(t, r"\s*\([^()]*\)\s*$", "")))).otherwise(plain)
    return df.withColumn("text", F.coalesce(out, F.lit(""))).drop("numeric", "date", "bracketed")


def brackets(cells: DataFrame) -> DataFrame:
    """What stands in a bracket at the end of a cell, as a value of its own (table_id, ri, ci, text)."""
    inner = F.regexp_extract("text", r"\(([^()]*)\)\s*$", 1)
    return cells.withColumn("text", inner).filter("text <> ''")


def class_profile(members: DataFrame) -> DataFrame:
    """(class, key, w): TF-IDF of the tokens of each class's members (class, text)."""
    words = members.select("class", F.explode(F.filter(F.split(F.lower("text"), T.NONWORD), lambda t: t != "")).alias("key"))
    tf = words.groupBy("class", "key").agg(F.count("*").alias("tf"))
    df = tf.groupBy("key").agg(F.count("*").alias("df"))
    n = members.select("class").distinct().agg(F.count("*").alias("n"))
    return tf.join(df, "key").crossJoin(F.broadcast(n)).select("class", "key", (F.col("tf") * F.log((F.col("n") + 1) / F.col("df"))).alias("w"))


def predicted_classes(columns: DataFrame, profiles: DataFrame, least: float = 0.0) -> DataFrame:
    """Best class of each column (id, text): cosine of its token counts with the profiles, if over ``least`` (ties by name)."""
    words = columns.select("id", F.explode(F.filter(F.split(F.lower("text"), T.NONWORD), lambda t: t != "")).alias("key")).groupBy("id", "key").agg(F.count("*").cast("double").alias("c"))
    nc = words.groupBy("id").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("nc"))
    np_ = profiles.groupBy("class").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("np"))
    s = words.join(profiles, "key").groupBy("id", "class").agg(F.sum(F.col("c") * F.col("w")).alias("dot")).join(nc, "id").join(np_, "class").withColumn("score", F.col("dot") / (F.col("nc") * F.col("np")))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "class")
    return s.filter(F.col("score") > least).withColumn("k", F.row_number().over(w)).filter("k = 1").select("id", "class", "score")


def exact_header_matches(headers: DataFrame) -> DataFrame:
    """Pairs of columns (ti, ci, text) of different tables with the same non-empty header."""
    h = headers.filter("text <> ''").withColumn("key", F.lower(F.trim("text")))
    a, b = h.alias("a"), h.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.ti") < F.col("b.ti")))
    return met.select(F.col("a.ti").alias("ti1"), F.col("b.ti").alias("ti2"), F.col("a.ci").alias("ci1"), F.col("b.ci").alias("ci2"), F.lit("head").alias("matcher"), F.lit(1.0).alias("score"))


def stitched(cells: DataFrame, clusters: DataFrame, least_rows: int = 10) -> DataFrame:
    """Unions by cluster (part, table_id, ri, pci, text) of partitions with at least ``least_rows`` rows."""
    out = cluster.stitch(cells, clusters)
    size = out.select("part", "table_id", "ri").distinct().groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") >= least_rows)
    return out.join(size.select("part"), "part", "left_semi")


def key_candidates(df: DataFrame, columns: list[str], size: int = 2, least: float = 0.95) -> DataFrame:
    """Minimal determinants of up to ``size`` columns (det, dep, score): rows with an empty value are left out, as in a key."""
    full = df.filter(" AND ".join(f"`{c}` IS NOT NULL AND trim(CAST(`{c}` AS STRING)) <> ''" for c in columns))
    return profile.dependencies(full, columns, size, 1 - least).withColumn("score", 1 - F.col("g3")).drop("g3")


def class_matches(classes: DataFrame) -> DataFrame:
    """Pairs of columns (ti, ci, class, score) of different tables with the same class; the smaller of both scores."""
    a, b = classes.alias("a"), classes.alias("b")
    met = a.join(b, (F.col("a.class") == F.col("b.class")) & (F.col("a.ti") < F.col("b.ti")))
    return met.select(F.col("a.ti").alias("ti1"), F.col("b.ti").alias("ti2"), F.col("a.ci").alias("ci1"), F.col("b.ci").alias("ci2"), F.lit("class").alias("matcher"), F.least("a.score", "b.score").alias("score"))


def column_codes(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, codes): columns of scored pairs numbered from 0 by table and column (ti, ci, code), and the pairs (code1, code2, score) by these numbers."""
    from loomtable.operators.cells import running

    every = scores.select(F.col("ti1").alias("ti"), F.col("ci1").alias("ci")).union(scores.select("ti2", "ci2")).distinct()
    codes = running(every, {"code": F.lit(1)}, ["ti", "ci"])
    one, two = codes.withColumnsRenamed({"ti": "ti1", "ci": "ci1", "code": "code1"}), codes.withColumnsRenamed({"ti": "ti2", "ci": "ci2", "code": "code2"})
    return scores.join(one, ["ti1", "ci1"]).join(two, ["ti2", "ci2"]).select("code1", "code2", "score"), codes
