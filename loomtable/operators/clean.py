"""Structural cleaning of tables (head and body as arrays of rows) and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_COLUMNS = 100


def _blank(cell: Column) -> Column:
    return F.trim(F.coalesce(cell, F.lit(""))) == ""


def drop_wide(tables: DataFrame, most: int = MAX_COLUMNS) -> DataFrame:
    return tables.filter(F.col("num_cols") < most)


def drop_empty_rows(tables: DataFrame) -> DataFrame:
    """Header and body rows without any text; tables without body rows go."""
    full = lambda rows: F.filter(rows, lambda r: F.exists(r, lambda c: ~_blank(c)))
    out = tables.withColumn("head", full("head")).withColumn("body", full("body"))
    return out.withColumn("num_rows", F.size("body")).filter("num_rows > 0")


def drop_repeated_header(tables: DataFrame) -> DataFrame:
    """First body rows that equal the last header row."""
    same = (F.size("head") > 0) & (F.size("body") > 0) & (F.element_at("head", -1) == F.get("body", F.lit(0)))
    return tables.withColumn("body", F.when(same, F.slice("body", 2, F.greatest(F.size("body") - 1, F.lit(0)))).otherwise(F.col("body"))).withColumn("num_rows", F.size("body"))


def spanning_header_rows(tables: DataFrame) -> DataFrame:
    """Header rows of one repeated text: the bottom one becomes the first body row, the others become captions."""
    spans = lambda r: (F.size(r) > 1) & (F.size(F.array_distinct(r)) == 1) & ~_blank(r[0])
    last = F.element_at("head", -1)
    moves = (F.size("head") > 0) & spans(last)
    above = F.when(moves, F.slice("head", 1, F.greatest(F.size("head") - 1, F.lit(0)))).otherwise(F.col("head"))
    old = F.col("captions") if "captions" in tables.columns else F.array().cast("array<string>")
    return tables.withColumn("captions", F.concat(old, F.transform(F.filter(above, spans), lambda r: r[0]))).withColumn(
        "body", F.when(moves, F.concat(F.array(last), F.col("body"))).otherwise(F.col("body"))
    ).withColumn("head", F.filter(above, lambda r: ~spans(r))).withColumn("num_rows", F.size("body"))


def empty_columns(cells: DataFrame) -> DataFrame:
    """Cells without the columns that hold no text in the body; column numbers close up."""
    used = cells.groupBy("table_id", "ci").agg(F.max((F.col("section") == "body") & ~_blank(F.col("text"))).alias("used")).filter("used")
    used = used.withColumn("new", F.row_number().over(Window.partitionBy("table_id").orderBy("ci")) - 1).drop("used")
    return cells.join(used, ["table_id", "ci"]).withColumn("ci", F.col("new")).drop("new")


def header_period(header: Column) -> Column:
    """Smallest period >= 2 by which a header repeats as a whole, else its length."""
    n = F.size(header)
    fits = F.filter(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda p: (n % p == 0) & (p < n) & F.forall(F.sequence(F.lit(0), n - 1), lambda i: header[i] == header[(i % p).cast("int")]))
    return F.coalesce(F.get(fits, F.lit(0)), n)


def restack(cells: DataFrame) -> DataFrame:
    """Tables whose header is the same columns several times over: the blocks are put below one another."""
    head = cells.filter("section = 'head'").groupBy("table_id", "ri").agg(F.transform(F.array_sort(F.collect_list(F.struct("ci", "text"))), lambda x: x["text"]).alias("row"))
    period = head.groupBy("table_id").agg(F.max(header_period(F.col("row"))).alias("period"))
    size = cells.groupBy("table_id").agg(F.max(F.when(F.col("section") == "body", F.col("ri") + 1)).alias("rows"))
    out = cells.join(period, "table_id", "left").join(size, "table_id")
    p = F.coalesce("period", F.lit(1 << 20))
    block = F.floor(F.col("ci") / p).cast("int")
    out = out.filter((F.col("section") == "body") | (F.col("ci") < p))
    return out.select("table_id", "section", F.when(F.col("section") == "body", block * F.col("rows") + F.col("ri")).otherwise(F.col("ri")).cast("int").alias("ri"), (F.col("ci") % p).cast("int").alias("ci"), "text")


def row_classes(body: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Class of each body row (table_id, ri, texts):

    N ordinary; R, L spanning rows that follow, or precede, every ordinary row;
    F trailing footnotes; H section headers; X the rest.  Only tables of two or
    more columns and rows with some, not all, spanning rows are looked at; all
    rows of others are N.
    """
    w = Window.partitionBy("table_id")
    order = w.orderBy("ri")
    low = F.transform("texts", lambda t: F.lower(t))
    spans = (F.size(F.array_distinct(low)) == 1) & ~_blank(low[0]) & (F.size("texts") >= 2)
    df = body.withColumn("span", spans).withColumn("next", F.lead("span").over(order)).withColumn("prev", F.lag("span").over(order))
    df = df.withColumn("n", F.count("*").over(w)).withColumn("spans", F.count_if("span").over(w)).withColumn("at", F.row_number().over(order))
    mixed = (F.col("n") >= 2) & (F.col("spans") > 0) & (F.col("spans") < F.col("n"))
    plenty = (F.col("n") - F.col("spans")) >= 2
    r_table = plenty & F.min(F.when(~F.col("span"), F.coalesce("next", F.lit(False)))).over(w)
    l_table = plenty & F.min(F.when(~F.col("span"), F.coalesce("prev", F.lit(False)))).over(w)
    df = df.withColumn("mixed", mixed).withColumn("is_r", r_table & F.max(F.when(F.col("at") == F.col("n"), F.col("span"))).over(w)).withColumn("is_l", l_table & F.max(F.when(F.col("at") == 1, F.col("span"))).over(w))
    taken = F.when(~F.col("span"), "N").when(F.col("is_r") & ~F.coalesce("prev", F.lit(True)), "R").when(F.col("is_l") & ~F.coalesce("next", F.lit(True)), "L")
    df = df.withColumn("taken", taken)
    last = F.max(F.when(F.col("taken").isNotNull(), F.col("at"))).over(w)
    foot = F.col("taken").isNull() & (F.col("at") > last) & (F.col("at") > 2)
    head = F.col("taken").isNull() & ~F.coalesce("next", F.lit(True))
    cls = F.when(~F.col("mixed"), "N").when(F.col("taken").isNotNull(), F.col("taken")).when(foot, "F").when(head, "H").otherwise("X")
    return df.select("table_id", "ri", "texts", cls.alias("class"))


def spread_classes(classed: DataFrame) -> DataFrame:
    """Ordinary rows only, with the section header, left and right text that belong to them (empty if none)."""
    order = Window.partitionBy("table_id").orderBy("ri")
    text = F.get("texts", F.lit(0))
    carried = F.last(F.when(F.col("class") == "H", text), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    df = classed.withColumn("subheader", carried)
    df = df.withColumn("left", F.when(F.lag("class").over(order) == "L", F.lag(text).over(order))).withColumn("right", F.when(F.lead("class").over(order) == "R", F.lead(text).over(order)))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return df.filter("class = 'N'").select("table_id", "ri", "texts", blank("subheader"), blank("left"), blank("right"))


def transpose(cells: DataFrame) -> DataFrame:
    """Body cells with rows and columns exchanged."""
    return cells.withColumnsRenamed({"ri": "ci", "ci": "ri"}).select(*cells.columns)


def prefix_rules(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """Cells that begin with a rule's ``find`` lose it and get the rule's ``header`` (longest rule first); others get null.

    Distinct texts are cut to the rules' lengths and joined with the rules on
    equality, so neither side is compared with all of the other.
    """
    known = rules.filter("find <> ''").groupBy("find").agg(F.min("header").alias("header"))
    sizes = known.agg(F.collect_set(F.length("find"))).first()[0]  # distinct lengths of rules: a short list
    if not sizes:
        return cells.withColumn("header", F.lit(None).cast("string"))
    texts = cells.select("text").distinct()
    starts = F.filter(F.transform(F.array(*[F.lit(n) for n in sorted(sizes)]), lambda n: F.when(F.length("text") >= n, F.substr("text", F.lit(1), n))), lambda t: t.isNotNull())
    hit = texts.select("text", F.explode(starts).alias("find")).join(known, "find").groupBy("text").agg(F.max_by(F.struct("find", "header"), F.length("find")).alias("rule"))
    out = cells.join(hit, "text", "left").withColumn("header", F.col("rule.header"))
    return out.withColumn("text", F.when(F.col("rule").isNotNull(), F.expr("substring(text, length(rule.find) + 1)")).otherwise(F.col("text"))).select(*cells.columns, "header")


def context_columns(cells: DataFrame, attributes: DataFrame, fields: list[str]) -> DataFrame:
    """Each field of ``attributes`` (table_id, fields ...) becomes a left column ``_field`` with its value in every body row."""
    n = len(fields)
    moved = cells.withColumn("ci", F.col("ci") + n)
    body = cells.filter("section = 'body'").select("table_id", "ri").distinct().join(attributes, "table_id")
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("ci"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("text")) for i, f in enumerate(fields)]))
    values = body.select("table_id", F.lit("body").alias("section"), "ri", at.alias("c")).select("table_id", "section", "ri", "c.ci", "c.text")
    heads = attributes.select("table_id", F.lit("head").alias("section"), F.lit(0).alias("ri"), F.explode(F.array(*[F.struct(F.lit(i).alias("ci"), F.lit(f"_{f}").alias("text")) for i, f in enumerate(fields)])).alias("c")).select("table_id", "section", "ri", "c.ci", "c.text")
    return moved.unionByName(values).unionByName(heads)


def demote_plain_heads(tables: DataFrame) -> DataFrame:
    """Header rows made of ``<td`` cells only (``head_tags``: the tag of each header cell) become the first body rows, in their order."""
    plain = lambda i: F.forall(F.get("head_tags", i), lambda t: t == "td")
    down = F.filter("head", lambda r, i: plain(i))
    out = tables.withColumn("body", F.concat(down, F.col("body"))).withColumn("head", F.filter("head", lambda r, i: ~F.coalesce(plain(i), F.lit(False))))
    return out.withColumn("head_tags", F.filter("head_tags", lambda t: ~F.forall(t, lambda x: x == "td"))).withColumn("num_rows", F.size("body"))
