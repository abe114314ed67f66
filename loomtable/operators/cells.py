"""The canonical relations and the moves between them.

``tables``: one row per table: table_id, head and body as arrays of rows of
text, plus any attributes (pg_title, about_uri ...).  ``cells``: one row per
cell: table_id, section (head or body), ri, ci, text, and links where known.
Almost every operator works on ``cells``, so wide and long tables are dealt
over tasks alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtable.operators.scratch import written

CELLS = "table_id string, section string, ri int, ci int, text string"


def to_cells(tables: DataFrame) -> DataFrame:
    """One row per cell; ragged rows give as many cells as they have."""
    both = tables.select("table_id", F.explode(F.array(F.struct(F.lit("head").alias("section"), F.col("head").alias("rows")), F.struct(F.lit("body").alias("section"), F.col("body").alias("rows")))).alias("s"))
    rows = both.select("table_id", "s.section", F.posexplode("s.rows").alias("ri", "row"))
    return rows.select("table_id", "section", "ri", F.posexplode("row").alias("ci", "text"))


def to_tables(cells: DataFrame) -> DataFrame:
    """table_id, head, body, num_cols, num_rows; missing cells are empty strings."""
    width = cells.groupBy("table_id").agg((F.max("ci") + 1).alias("num_cols"))
    row = cells.groupBy("table_id", "section", "ri").agg(F.map_from_entries(F.collect_list(F.struct("ci", "text"))).alias("at"))
    row = row.join(width, "table_id").withColumn("row", F.transform(F.sequence(F.lit(0), F.col("num_cols") - 1), lambda i: F.coalesce(F.col("at")[i], F.lit(""))))
    rows = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == s, F.struct("ri", "row")))), lambda x: x["row"])
    out = row.groupBy("table_id").agg(rows("head").alias("head"), rows("body").alias("body"), F.first("num_cols").alias("num_cols"))
    return out.withColumn("num_rows", F.size("body"))


def offsets(df: DataFrame, value: str | Column, order: list, out: str, by: list[str] | None = None) -> DataFrame:
    """Exclusive running sum of ``value`` in the given order (0 for the first row); see ``running``."""
    return running(df, {out: value}, order, by)


def running(df: DataFrame, values: dict[str, str | Column], order: list, by: list[str] | None = None) -> DataFrame:
    """Exclusive running sums (0 for the first row) in the given order, one column per value.

    Without ``by`` the order is global.  One window over all rows would put
    them in one task, so the sums are made in two steps: rows are dealt into
    ranges of the order and written once with their range's number, each range
    is summed in its own task, and only the ranges' totals (a few numbers each)
    are summed in sequence.  Both steps read the same written rows: dealing
    them twice would give other ranges each time.
    """
    sums = {out: F.col(v) if isinstance(v, str) else v for out, v in values.items()}
    exclusive = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    if by:
        w = exclusive(Window.partitionBy(*by).orderBy(*order))
        return df.withColumns({out: F.coalesce(F.sum(v).over(w), F.lit(0)) for out, v in sums.items()})
    own = {out: f"_loom_{i}" for i, out in enumerate(sums)}
    dealt = df.withColumns({own[out]: v for out, v in sums.items()}).repartitionByRange(*order).withColumn("_loom_range", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    totals = dealt.groupBy("_loom_range").agg(*[F.sum(c).alias(c) for c in own.values()])
    w = exclusive(Window.orderBy("_loom_range"))
    before = totals.select("_loom_range", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_before") for c in own.values()])
    w = exclusive(Window.partitionBy("_loom_range").orderBy(*order))
    inside = dealt.withColumns({f"{c}_inside": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in own.values()})
    out = inside.join(F.broadcast(before), "_loom_range").withColumns({o: F.col(f"{c}_before") + F.col(f"{c}_inside") for o, c in own.items()})
    return out.drop("_loom_range", *[f"{c}{end}" for c in own.values() for end in ("", "_before", "_inside")])


def number_columns(tables: DataFrame) -> DataFrame:
    """Adds table_index (0, 1, ... by table_id) and col_offset (columns of all tables before)."""
    return running(tables, {"table_index": F.lit(1), "col_offset": "num_cols"}, ["table_id"])


def fold(df: DataFrame, key: list[str], order: list[str], start: Column, step) -> DataFrame:
    """Group by key and fold the rows of a group in the given order: ``step(state, row)``; the rows of one group must fit in a row."""
    rest = [c for c in df.columns if c not in key and c not in order]
    rows = df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("_rows"))
    return rows.select(*key, F.aggregate("_rows", start, step).alias("value"))


def concat(*frames: DataFrame) -> DataFrame:
    """Union by column name; a missing column is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def take(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows of an explicit order."""
    return df.orderBy(*order).limit(n)


def where_all(df: DataFrame, *conditions: str) -> DataFrame:
    """Rows that satisfy every SQL condition."""
    for c in conditions:
        df = df.filter(F.expr(c))
    return df


def with_header(tables: DataFrame) -> DataFrame:
    """Tables with at least one non-empty header cell."""
    return tables.filter(F.exists(F.flatten("head"), lambda c: F.trim(c) != ""))


def linkable(text: Column) -> Column:
    """Cells worth a search: two characters at least, and not a number."""
    return (F.length(text) >= 2) & ~text.rlike(r"^[\p{N}.,%+-]+$")


def columns_of(df: DataFrame, table_id: str, columns: list[str], row: str) -> DataFrame:
    """A flat DataFrame as body cells: row numbers are its ``row`` column, column numbers the position in ``columns``."""
    stacked = F.array(*[F.struct(F.lit(i).alias("ci"), F.lit(c).alias("name"), F.col(c).cast("string").alias("text")) for i, c in enumerate(columns)])
    return df.select(F.lit(table_id).alias("table_id"), F.col(row).alias("ri"), F.explode(stacked).alias("c")).select("table_id", "ri", "c.ci", "c.name", "c.text")


def largest_first(df: DataFrame, size: str, *ties: str) -> DataFrame:
    """Rows by falling size, ties in the order given: a global sort by ranges."""
    return df.orderBy(F.desc(size), *ties)
