"""Column profiles, keys and (probabilistic) functional dependencies."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtable.functions import text as T


def column_scores(cells: DataFrame) -> DataFrame:
    """Per column (table_id, ci): n, n_distinct, uniqueness, share of numbers, mean length, cover (share of non-empty cells)."""
    full = F.trim(F.coalesce("text", F.lit(""))) != ""
    return cells.groupBy("table_id", "ci").agg(
        F.count("*").alias("n"), F.count_distinct("text").alias("n_distinct"), (F.count_distinct("text") / F.count("*")).alias("uniqueness"),
        F.avg(T.looks_number(F.col("text")).cast("int")).alias("numeric"), F.avg(F.length("text")).alias("mean_length"), F.avg(full.cast("int")).alias("cover"),
    )


def heuristic_key(scores: DataFrame, least: float = 0.9) -> DataFrame:
    """Leftmost of the most unique columns of each table, if its uniqueness exceeds ``least``."""
    w = Window.partitionBy("table_id").orderBy(F.desc("uniqueness"), "ci")
    return scores.withColumn("k", F.row_number().over(w)).filter((F.col("k") == 1) & (F.col("uniqueness") > least)).select("table_id", F.col("ci").alias("key_col"), "uniqueness")


def pair_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """n of each (det, dep, value of det, value of dep): all column pairs of one table in one pass over it, pre-aggregated before the shuffle."""
    pairs = [F.struct(F.lit(a).alias("det"), F.lit(b).alias("dep"), F.col(a).cast("string").alias("v"), F.col(b).cast("string").alias("u")) for a in columns for b in columns if a != b]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").groupBy("det", "dep", "v", "u").agg(F.count("*").alias("n"))


def pfd(counts: DataFrame) -> DataFrame:
    """Per (det, dep): per_tuple ``sum of the largest count of each det value / rows`` and per_value, the mean share of that largest count."""
    m = counts.groupBy("det", "dep", "v").agg(F.max("n").alias("mx"), F.sum("n").alias("s"))
    return m.groupBy("det", "dep").agg((F.sum("mx") / F.sum("s")).alias("per_tuple"), F.avg(F.col("mx") / F.col("s")).alias("per_value"), (1 - F.sum("mx") / F.sum("s")).alias("g3"))


def pfd_key(scores: DataFrame, least: float = 0.9) -> DataFrame:
    """The determinant with the largest harmonic mean of its per-tuple scores (zeros count in the numerator only), if it exceeds ``least``."""
    harm = scores.groupBy("det").agg((F.count("*") / F.sum(F.when(F.col("per_tuple") > 0, 1 / F.col("per_tuple")))).alias("score"))
    return harm.filter(F.col("score") > least).orderBy(F.desc("score"), "det").limit(1)


def dependencies(df: DataFrame, columns: list[str], size: int = 2, most_error: float = 0.05) -> DataFrame:
    """Approximate dependencies (g3 error at most ``most_error``) with minimal determinants of up to ``size`` columns."""
    out, spark = [], df.sparkSession
    for k in range(1, size + 1):
        pairs = []
        for det in combinations(columns, k):
            for dep in columns:
                if dep not in det and not any(d == dep and set(small) < set(det) for small, d, _ in out):
                    pairs.append(F.struct(F.lit(",".join(det)).alias("det"), F.lit(dep).alias("dep"), F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in det]).alias("v"), F.col(dep).cast("string").alias("u")))
        if not pairs:
            continue
        counts = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").groupBy("det", "dep", "v", "u").agg(F.count("*").alias("n"))
        # One row per combination of columns: a few dozen at most.
        out += [(tuple(r["det"].split(",")), r["dep"], float(r["g3"])) for r in pfd(counts).filter(F.col("g3") <= most_error).collect()]
    return spark.createDataFrame([(",".join(d), p, g) for d, p, g in sorted(out)], "det string, dep string, g3 double")


#: Patterns of column shapes.
SHAPES = {
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}|^[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}$",
    "duration": r"^[0-9]{1,3}:[0-9]{2}(:[0-9]{2})?$",
    "numeric": r"^[-+]?[0-9][0-9.,]*$",
    "bracketed": r"\(.+\)\s*$",
}


def shapes(cells: DataFrame) -> DataFrame:
    """Per column the share of its non-empty cells that fit each shape, and of long texts (over 50 characters)."""
    full = cells.filter(F.trim("text") != "")
    return full.groupBy("table_id", "ci").agg(*[F.avg(F.col("text").rlike(p).cast("int")).alias(k) for k, p in SHAPES.items()], F.avg((F.length("text") > 50).cast("int")).alias("longtext"))


def keylike(cells: DataFrame, most_spread: float = 0.5, least_cover: float = 0.9, most_length: float = 50) -> DataFrame:
    """Columns whose cells look like names: well filled, not numeric, short, of even length."""
    full = F.trim(F.coalesce("text", F.lit(""))) != ""
    p = cells.groupBy("table_id", "ci").agg(
        F.avg(full.cast("int")).alias("cover"), F.avg(F.length("text")).alias("mean_length"), F.stddev_pop(F.length("text")).alias("spread"), F.avg(T.looks_number(F.col("text")).cast("int")).alias("numeric")
    )
    return p.filter((F.col("cover") >= least_cover) & (F.col("mean_length") <= most_length) & (F.col("numeric") < 0.5) & (F.col("spread") <= F.col("mean_length") * most_spread))


def types_of_columns(cells: DataFrame, entities: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """Type and score of each column by majority over its distinct texts: dateTime (years), decimal, Thing (cells with an entity), dateTime (dates), string; none if no type covers more than ``least``."""
    kinds = cells.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select("table_id", "ci", "text").distinct()
    if entities is not None:
        known = entities.select("table_id", "ci", "text").distinct().withColumn("thing", F.lit(True))
        kinds = kinds.join(known, ["table_id", "ci", "text"], "left")
    else:
        kinds = kinds.withColumn("thing", F.lit(None).cast("boolean"))
    t = F.col("text")
    kind = F.when(T.is_year(t), "dateTime").when(T.looks_number(t), "decimal").when(F.col("thing"), "Thing").when(T.parsed_date(t).isNotNull(), "dateTime").otherwise("string")
    n = kinds.groupBy("table_id", "ci", kind.alias("type")).agg(F.count("*").alias("n"))
    total = n.withColumn("total", F.sum("n").over(Window.partitionBy("table_id", "ci")))
    return total.filter(F.col("n") > F.col("total") * least).select("table_id", "ci", "type", (F.col("n") / F.col("total")).alias("score"))


def entity_types(cell_entities: DataFrame, types: DataFrame, supertypes: DataFrame, least: float = 0.5, top: int = 1) -> DataFrame:
    """Classes of entity columns: types of a cell's entities and their direct supertypes that cover more than ``least`` of the column's cells with entities; the ``top`` commonest (ties by name)."""
    col = ["table_id", "ci"]
    n = cell_entities.select(*col, "ri").distinct().groupBy(*col).agg(F.count("*").alias("n"))
    direct = cell_entities.join(types, "uri").select(*col, "ri", "type")
    above = direct.join(supertypes, "type").select(*col, "ri", F.col("supertype").alias("type"))
    count = direct.union(above).distinct().groupBy(*col, "type").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*col).orderBy(F.desc("c"), "type")
    return count.join(n, col).filter(F.col("c") > F.col("n") * least).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= top).select(*col, "type", (F.col("c") / F.col("n")).alias("score"))


def surrogates(df: DataFrame, column: str, out: str) -> tuple[DataFrame, DataFrame]:
    """(facts, dimension): a surrogate key (1, 2, ... in the order of values) for each distinct value; facts carry it instead of the value, nulls stay null."""
    from loomtable.operators.cells import offsets

    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    dim = offsets(values, F.lit(1), [column], "_before").select(column, (F.col("_before") + 1).cast("bigint").alias(out))
    return df.join(dim, column, "left").drop(column), dim


def decompose(df: DataFrame, det: list[str], dep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(entity, rest): the projection on a dependency, distinct and with the determinant filled, and the rows without the dependent columns."""
    full = df.select(*det, *dep)
    for c in det:
        full = full.filter(F.col(c).isNotNull())
    return full.distinct(), df.drop(*dep)


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n commonest values with their counts (ties to the smaller value)."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def log_binned_mean(df: DataFrame, rank: str, value: str) -> DataFrame:
    """Mean of a value in bins of a rank that grow tenfold: bin (1, 10, 100, ...), n, mean."""
    bin_ = F.pow(F.lit(10), F.floor(F.log10(rank))).cast("bigint").alias("bin")
    return df.filter(F.col(rank) >= 1).groupBy(bin_).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def ranked(df: DataFrame, column: str) -> DataFrame:
    """(column, n, rank): values by falling count, ties to the smaller value; ranks are summed range by range, so no task holds all values."""
    from loomtable.operators.cells import running

    n = df.groupBy(column).agg(F.count("*").alias("n")).withColumn("_down", -F.col("n"))
    return running(n, {"rank": F.lit(1)}, ["_down", column]).select(column, "n", (F.col("rank") + 1).cast("bigint").alias("rank"))


def known_share(cells: DataFrame, members: DataFrame, least: float = 0.5) -> DataFrame:
    """Columns (table_id, ci) of which more than ``least`` of the distinct texts are members (text), ignoring case: (table_id, ci, share).  Membership is an exact join on the distinct members, to which Spark adds a Bloom filter of its own where that helps."""
    texts = cells.filter("trim(text) <> ''").select("table_id", "ci", F.lower("text").alias("key")).distinct()
    known = members.select(F.lower("text").alias("key")).distinct().withColumn("known", F.lit(1))
    share = texts.join(known, "key", "left").groupBy("table_id", "ci").agg(F.avg(F.coalesce("known", F.lit(0))).alias("share"))
    return share.filter(F.col("share") > least)


def by_fill(cells: DataFrame) -> DataFrame:
    """(table_id, ci, filled, place): columns by falling number of non-empty cells, ties to the left."""
    n = cells.groupBy("table_id", "ci").agg(F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "").alias("filled"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("table_id").orderBy(F.desc("filled"), "ci")))
