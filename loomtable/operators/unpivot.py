"""Header pivots: finding runs of header cells that are values, and turning wide tables long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Header patterns of the standard finders.
NUM_PREFIX = r"^[0-9]{1,4}[^0-9]*$"
NUM_SUFFIX = r"^[^0-9]*[0-9]{1,4}$"


def found_by_pattern(headers: DataFrame, name: str, pattern: str, order: int = 0) -> DataFrame:
    """Header cells (header_id, level, ci, text) that match a pattern: one finder's positions."""
    return headers.filter(F.col("text").rlike(pattern)).select("header_id", F.lit(name).alias("finder"), F.lit(order).alias("finder_order"), "level", "ci")


def found_by_prefix(headers: DataFrame, name: str = "SeqPrefix", order: int = 0) -> DataFrame:
    """Cells that share the row's commonest first token (on a tie the smallest), if it stands more than once."""
    first = F.get(F.split(F.trim("text"), r"\s+"), F.lit(0))
    seen = headers.withColumn("first", first).filter("first <> ''")
    many = seen.groupBy("header_id", "level", "first").agg(F.count("*").alias("n")).filter("n > 1")
    best = many.withColumn("k", F.row_number().over(Window.partitionBy("header_id", "level").orderBy(F.desc("n"), "first"))).filter("k = 1")
    return seen.join(best.select("header_id", "level", "first"), ["header_id", "level", "first"]).select("header_id", F.lit(name).alias("finder"), F.lit(order).alias("finder_order"), "level", "ci")


def found_by_attribute(headers: DataFrame, attributes: DataFrame, name: str = "AttributeContext", order: int = 0) -> DataFrame:
    """Cells whose text equals, ignoring case, some value of a table attribute (value)."""
    values = attributes.select(F.lower("value").alias("key")).distinct()
    return headers.withColumn("key", F.lower("text")).join(values, "key", "left_semi").select("header_id", F.lit(name).alias("finder"), F.lit(order).alias("finder_order"), "level", "ci")


def found_by_rule(headers: DataFrame, id_vars: list[str], value_vars: list[str], name: str = "Rule", order: int = 0) -> DataFrame:
    """The value columns of header rows that hold every listed header."""
    rows = headers.groupBy("header_id", "level").agg(F.collect_set("text").alias("row"))
    need = F.array(*[F.lit(v) for v in [*id_vars, *value_vars]])
    fits = rows.filter(F.size(F.array_except(need, F.col("row"))) == 0).select("header_id", "level")
    return headers.join(fits, ["header_id", "level"], "left_semi").filter(F.col("text").isin(value_vars)).select("header_id", F.lit(name).alias("finder"), F.lit(order).alias("finder_order"), "level", "ci")


def found_by_agent_link(headers: DataFrame, titles: DataFrame, triples: DataFrame, type_props: list[str], attribute_types: list[str], name: str = "AgentLikeHyperlink", order: int = 0) -> DataFrame:
    """Cells (with ``title``) that link to an entity which is nobody's type and has no attribute-like type."""
    linked = headers.join(titles, "title").select("header_id", "level", "ci", "uri")
    as_type = triples.filter(F.col("p").isin(type_props)).select(F.col("o").alias("uri")).distinct()
    attribute = triples.filter(F.col("p").isin(type_props) & F.col("o").isin(attribute_types)).select(F.col("s").alias("uri")).distinct()
    kept = linked.join(as_type, "uri", "left_anti").join(attribute, "uri", "left_anti")
    return kept.select("header_id", F.lit(name).alias("finder"), F.lit(order).alias("finder_order"), "level", "ci")


def islands(df: DataFrame, by: list[str], order: str, changed: Column) -> DataFrame:
    """Numbers runs: a new one where ``changed`` holds."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("island", F.sum(F.coalesce(changed, F.lit(True)).cast("int")).over(w))


def spanned_repeats(headers: DataFrame, order: int = 0) -> DataFrame:
    """Cells below (or above) a spanning cell - adjacent equal texts - that repeat elsewhere in their row."""
    w = Window.partitionBy("header_id", "level").orderBy("ci")
    runs = islands(headers, ["header_id", "level"], "ci", F.col("text") != F.lag("text").over(w))
    span = runs.groupBy("header_id", "level", "island").agg(F.min("ci").alias("lo"), F.max("ci").alias("hi")).filter("hi > lo")
    repeats = headers.withColumn("n", F.count("*").over(Window.partitionBy("header_id", "level", "text"))).filter("n > 1")
    s, r = span.alias("s"), repeats.alias("r")
    met = s.join(r, (F.col("s.header_id") == F.col("r.header_id")) & (F.col("s.level") != F.col("r.level")) & F.col("r.ci").between(F.col("s.lo"), F.col("s.hi")))
    return met.select(F.col("r.header_id"), F.lit("SpannedRepeat").alias("finder"), F.lit(order).alias("finder_order"), F.col("s.level").alias("level"), F.col("r.ci").alias("ci")).distinct()


def longest_runs(found: DataFrame, gap: int = 0) -> DataFrame:
    """Per header, finder and level the longest run of columns (gaps of up to ``gap`` columns allowed), the leftmost on ties: colfrom, colto, cells."""
    w = Window.partitionBy("header_id", "finder", "level").orderBy("ci")
    runs = islands(found, ["header_id", "finder", "level"], "ci", F.col("ci") - F.lag("ci").over(w) > gap + 1)
    size = runs.groupBy("header_id", "finder", "finder_order", "level", "island").agg(F.min("ci").alias("colfrom"), F.max("ci").alias("colto"), F.count("*").alias("cells"))
    best = Window.partitionBy("header_id", "finder", "level").orderBy(F.desc("cells"), "colfrom")
    return size.withColumn("k", F.row_number().over(best)).filter("k = 1").drop("k", "island")


def best_pivot(found: DataFrame, least: int = 2, gap: int = 0) -> DataFrame:
    """One pivot per header: the longest over all finders; on ties the earlier finder, then the lower level."""
    runs = longest_runs(found, gap).filter(F.col("cells") >= least)
    w = Window.partitionBy("header_id").orderBy(F.desc(F.col("colto") - F.col("colfrom")), "finder_order", "level")
    return runs.withColumn("k", F.row_number().over(w)).filter("k = 1").select("header_id", "finder", "level", "colfrom", "colto")


def unpivot_cells(cells: DataFrame, pivots: DataFrame) -> DataFrame:
    """Long form of tables (cells with header_id) that have a pivot: one row per id row and pivoted column.

    Result: table_id, ri, ids (texts of the columns outside the pivot, in
    order), variable (header text), value.  A pivot over the whole header
    leaves no id columns; such tables are left out, as unpivoting them has no
    meaning.
    """
    df = cells.join(pivots, "header_id")
    inside = F.col("ci").between(F.col("colfrom"), F.col("colto"))
    body = df.filter("section = 'body'")
    ids = body.filter(~inside).groupBy("table_id", "ri").agg(F.transform(F.array_sort(F.collect_list(F.struct("ci", "text"))), lambda x: x["text"]).alias("ids"))
    values = body.filter(inside).select("table_id", "ri", "ci", F.coalesce("text", F.lit("")).alias("value"))
    names = df.filter((F.col("section") == "head") & (F.col("ri") == F.col("level")) & inside).select("table_id", "ci", F.col("text").alias("variable"))
    return values.join(ids, ["table_id", "ri"]).join(names, ["table_id", "ci"]).select("table_id", "ri", "ci", "ids", "variable", "value")


def split_header(text: Column, pattern: str) -> tuple[Column, Column]:
    """Variable and value of a header cell by a pattern with two groups; the cell itself and empty where it does not match."""
    fits = text.rlike(pattern)
    return F.when(fits, F.regexp_extract(text, pattern, 1)).otherwise(text), F.when(fits, F.regexp_extract(text, pattern, 2)).otherwise(F.lit(""))


# Header patterns of the configured finders, by name, in the order of their precedence.
STANDARD = {
    "year_first": r"^(1[5-9]|20)[0-9]{2}\b.*$",
    "year_last": r"^.*\b(1[5-9]|20)[0-9]{2}$",
    "number_first": NUM_PREFIX,
    "number_last": NUM_SUFFIX,
    "acronym": r"^[A-Z]{2,4}$",
    "time": r"^[0-9]{1,2}[:.][0-9]{2}([:.][0-9]{2})?( ?[ap]m)?$",
    "round": r"^(?i)(round|week|day|game|match|leg|heat|stage|set) ?[0-9IVX]+$",
    "ordinal": r"^[0-9]+(st|nd|rd|th)$",
    "month": r"^(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?( [0-9]{1,4})?$",
}


def found_by_standard(headers: DataFrame) -> DataFrame:
    """Positions of all configured finders."""
    frames = [found_by_pattern(headers, name, pattern, i) for i, (name, pattern) in enumerate(STANDARD.items())]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def valid_pivots(pivots: DataFrame, headers: DataFrame) -> DataFrame:
    """Pivots that unpivoting has a meaning for: some column stays outside, and the header cells inside are texts, not all of them equal."""
    row = headers.join(pivots, ["header_id", "level"])
    inside = F.col("ci").between(F.col("colfrom"), F.col("colto"))
    fit = row.groupBy("header_id").agg(F.count_if(~inside).alias("ids"), F.count_if(inside & (F.trim("text") == "")).alias("empty"), F.count_distinct(F.when(inside, F.col("text"))).alias("kinds"))
    return pivots.join(fit.filter("ids > 0 AND empty = 0 AND kinds > 1").select("header_id"), "header_id", "left_semi")
