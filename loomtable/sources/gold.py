"""Gold standards: tables with entity, class and property annotations as three long relations.

``cell_entities`` (table_id, ci, ri, uri), ``col_classes`` (table_id, ci, uri),
``col_properties`` (table_id, from_ci, to_ci, uri).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtable.functions import text as T
from loomtable.sources.files import read_csv


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z]+$", "")


def _csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    return spark.read.schema(columns).option("escape", '"').csv(path).withColumn("file", stem(F.col("_metadata.file_path")))


def fixed_uri(uri: Column, twice: bool = False, fixes: DataFrame | None = None) -> Column:
    """A repaired DBpedia URI: unquoted (twice where quoted twice), of the right host and path."""
    u = F.try_url_decode(uri)
    u = F.try_url_decode(u) if twice else u
    return F.replace(F.replace(F.coalesce(u, uri), F.lit("dbpedia_org"), F.lit("dbpedia.org")), F.lit("/page/"), F.lit("/resource/"))


def with_fixes(annotations: DataFrame, fixes: DataFrame) -> DataFrame:
    """Annotations with the URIs of a small list (wrong, right) replaced."""
    f = fixes.select(F.col("wrong").alias("uri"), "right")
    return annotations.join(f, "uri", "left").withColumn("uri", F.coalesce("right", "uri")).drop("right")


def t2d(spark: SparkSession, tables: str, entities: str, classes: str, properties: str, twice: bool = False) -> dict[str, DataFrame]:
    """Tables as CSV files; entities per file ``uri,text,row``; classes ``file,label,uri``; properties per file ``uri,header,is key,column``."""
    e = _csv(spark, entities, "uri string, text string, ri int")
    c = spark.read.schema("file string, label string, uri string").option("escape", '"').csv(classes)
    p = _csv(spark, properties, "uri string, header string, is_key boolean, ci int")
    keys = p.filter("is_key").groupBy(F.col("file").alias("table_id")).agg(F.min("ci").alias("key_col"))
    at_key = lambda df: df.withColumnRenamed("file", "table_id").join(keys, "table_id", "left").withColumn("key_col", F.coalesce("key_col", F.lit(0)))
    uri = fixed_uri(F.col("uri"), twice).alias("uri")
    return {
        "tables": read_csv(spark, tables).join(keys, "table_id", "left"), "cell_entities": at_key(e).select("table_id", F.col("key_col").alias("ci"), "ri", uri),
        "col_classes": at_key(c.withColumn("file", F.regexp_replace("file", r"\.(tar\.gz|json|csv)$", ""))).select("table_id", F.col("key_col").alias("ci"), uri),
        "col_properties": at_key(p.filter("NOT is_key")).select("table_id", F.col("key_col").alias("from_ci"), F.col("ci").alias("to_ci"), uri),
    }


def semtab(spark: SparkSession, tables: str, cea: str | None = None, cta: str | None = None, cpa: str | None = None) -> dict[str, DataFrame]:
    """Tables whose first row is the header, the columns that may hold entities (under half number-like cells), and gold or targets: cells ``table,row,col[,uri]`` (row 1 is the first body row), columns, pairs."""
    t = read_csv(spark, tables)
    t = t.withColumn("head", F.slice("body", 1, 1)).withColumn("body", F.slice("body", 2, F.greatest(F.size("body") - 1, F.lit(0)))).withColumn("num_rows", F.size("body"))
    cells = t.select("table_id", F.posexplode("body").alias("ri", "row")).select("table_id", "ri", F.posexplode("row").alias("ci", "text"))
    share = cells.groupBy("table_id", "ci").agg(F.avg(F.col("text").rlike(r"^[\d.,\-+%]+$").cast("int")).alias("numeric"))
    out = {"tables": t, "entity_columns": share.filter("numeric < 0.5").select("table_id", "ci")}
    for name, path, columns in (("cell_entities", cea, "table_id string, ri int, ci int, uri string"), ("col_classes", cta, "table_id string, ci int, uri string"), ("col_properties", cpa, "table_id string, from_ci int, to_ci int, uri string")):
        if path:
            df = spark.read.schema(columns).option("escape", '"').csv(path)
            out[name] = df.withColumn("ri", F.col("ri") - 1) if name == "cell_entities" else df
    return out


def tough_tables(spark: SparkSession, cea: str, cta: str, tables: str, wikidata: bool = False) -> dict[str, DataFrame]:
    """Gold cells ``table,col,row,uris`` (row and column exchanged in the Wikidata part), several URIs separated by spaces; the category is the name's part before the first number."""
    a, b = ("ri", "ci") if wikidata else ("ci", "ri")
    e = spark.read.schema(f"table_id string, {a} int, {b} int, uris string").option("escape", '"').csv(cea)
    c = spark.read.schema("table_id string, ci int, uris string").option("escape", '"').csv(cta)
    each = lambda df: df.withColumn("uri", F.explode(F.split(F.trim("uris"), r"\s+"))).drop("uris")
    t = read_csv(spark, tables)
    return {"tables": t.withColumn("category", F.regexp_extract("table_id", r"^([A-Za-z_]+?)_?[0-9]", 1)), "cell_entities": each(e).withColumn("ri", F.col("ri") - 1), "col_classes": each(c)}


def limaye(spark: SparkSession, tables: str, entities: str) -> dict[str, DataFrame]:
    """Entities ``uri,text,row``: the column is the leftmost whose cell has that text; broken encodings are repaired first."""
    t = read_csv(spark, tables)
    cells = t.select("table_id", F.posexplode("body").alias("ri", "row")).select("table_id", "ri", F.posexplode("row").alias("ci", "text")).withColumn("text", T.repaired(F.col("text")))
    e = _csv(spark, entities, "uri string, text string, ri int").withColumnRenamed("file", "table_id").withColumn("text", T.repaired(F.col("text")))
    hit = e.join(cells, ["table_id", "ri", "text"])
    first = hit.withColumn("k", F.row_number().over(Window.partitionBy("table_id", "ri", "text", "uri").orderBy("ci"))).filter("k = 1")
    return {"tables": t, "cell_entities": first.select("table_id", "ci", "ri", fixed_uri(F.col("uri")).alias("uri"))}
