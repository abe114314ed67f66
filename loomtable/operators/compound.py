"""Splitting of compound columns: common affixes, and patterns of token classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtable.functions import text as T


def affixes(cells: DataFrame, by: list[str]) -> DataFrame:
    """Common prefix and suffix of all texts of a column.

    That of a set is that of its smallest and largest element, so two minima
    and maxima, partially aggregated, are all that is shuffled.
    """
    ends = cells.groupBy(*by).agg(F.min("text").alias("lo"), F.max("text").alias("hi"), F.min(F.reverse("text")).alias("rlo"), F.max(F.reverse("text")).alias("rhi"), F.count("*").alias("n"), F.count_distinct("text").alias("kinds"))
    prefix = F.substr("lo", F.lit(1), T.common_prefix_length(F.col("lo"), F.col("hi")))
    suffix = F.reverse(F.substr("rlo", F.lit(1), T.common_prefix_length(F.col("rlo"), F.col("rhi"))))
    return ends.select(*by, prefix.alias("prefix"), suffix.alias("suffix"), "n", "kinds")


def strip_affixes(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells with ``rest``: the text without its column's common affixes, where texts differ."""
    found = affixes(cells, by).filter("kinds > 1").drop("n", "kinds")
    df = cells.join(found, by, "left")
    inner = F.expr("substring(text, length(prefix) + 1, length(text) - length(prefix) - length(suffix))")
    return df.withColumn("rest", F.when(F.col("prefix").isNotNull(), inner).otherwise(F.col("text")))


def token_pattern(column):
    """Classes of a text's tokens: D dates and years, N numbers, W words, other characters themselves."""
    p = F.regexp_replace(column, r"[0-9]{4}-[0-9]{2}-[0-9]{2}|\b(1[89]|20)[0-9]{2}\b", "\u0001")
    p = F.regexp_replace(p, r"[0-9]+([.,][0-9]+)*", "\u0002")
    p = F.regexp_replace(p, r"\p{L}+", "\u0003")
    p = F.regexp_replace(p, r"(\x{3})(\s+\x{3})+", "\u0003")
    return F.translate(p, "\u0001\u0002\u0003", "DNW")


def majority_pattern(cells: DataFrame, by: list[str], least: float = 0.5) -> DataFrame:
    """The token pattern of more than ``least`` of a column's distinct texts (of several, the commonest)."""
    kinds = cells.select(*by, "text").distinct().withColumn("pattern", token_pattern(F.col("text")))
    n = kinds.groupBy(*by, "pattern").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "pattern")
    return n.filter(F.col("n") > F.col("total") * least).withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def split_parts(cells: DataFrame, by: list[str], least: float = 0.5) -> DataFrame:
    """Columns with a majority pattern of several classes are split into their parts: part, kind, piece."""
    found = majority_pattern(cells, by, least).select(*by, "pattern")
    df = cells.join(found, by).filter(token_pattern(F.col("text")) == F.col("pattern")).filter(F.length(F.regexp_replace("pattern", "[^DNW]", "")) > 1)
    atom = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]+(?:[.,][0-9]+)*|\p{L}+(?:\s+\p{L}+)*"
    pieces = F.regexp_extract_all("text", F.lit(atom), F.lit(0))
    kinds = F.filter(F.split("pattern", ""), lambda c: c.isin("D", "N", "W"))
    return df.select(*cells.columns, F.posexplode(F.arrays_zip(pieces.alias("piece"), kinds.alias("kind"))).alias("part", "p")).select(*cells.columns, "part", "p.kind", "p.piece")


def template_parts(cells: DataFrame, by: list[str], least: int = 1, most: int = 8) -> DataFrame:
    """Columns whose cells all share some words or marks, split at them: the texts between are the parts (part, piece).

    What is common is counted, not aligned: a token (a word or a mark) of every
    cell of the column is constant.  Columns without one, or with fewer than
    ``least`` or more than ``most`` parts, are left out.
    """
    token = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
    one = cells.select(*by, "text").distinct()
    n = one.groupBy(*by).agg(F.count("*").alias("n"))
    each = one.select(*by, "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(token), F.lit(0)))).alias("token"))
    fixed = each.groupBy(*by, "token").agg(F.count("*").alias("c")).join(n, by).filter("c = n AND n > 1")
    fixed = fixed.groupBy(*by).agg(F.collect_set("token").alias("fixed"))
    df = cells.join(fixed, by)
    # Every token of the cell in order; constants end a part.
    marks = F.regexp_extract_all("text", F.lit(token), F.lit(0))
    cut = F.aggregate(marks, F.array(F.lit("")), lambda s, t: F.when(F.array_contains("fixed", t), F.concat(s, F.array(F.lit("")))).otherwise(
        F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.trim(F.concat_ws(" ", F.element_at(s, -1), t))))
    ))
    parts = df.withColumn("pieces", F.filter(cut, lambda p: p != "")).filter(F.size("pieces").between(least, most)).drop("fixed")
    return parts.select(*cells.columns, F.posexplode("pieces").alias("part", "piece"))
