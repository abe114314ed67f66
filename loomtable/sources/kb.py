"""Knowledge bases from files: triples, labels, statements, statistics, word vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TERM = r'(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z-]+)|\^\^<([^>]*)>)?|(\S+))'
_LINE = r"^\s*<([^>]*)>\s+<([^>]*)>\s+" + _TERM + r"\s*\.\s*$"


def ntriples(spark: SparkSession, *paths: str, languages: list[str] | None = None) -> DataFrame:
    """s, p, o, o_kind (uri or literal), o_datatype, o_lang from N-Triples lines; literals of other languages than those listed are left out."""
    part = lambda i: F.nullif(F.regexp_extract("value", _LINE, i), F.lit(""))
    lines = spark.read.text(list(paths)).filter(F.col("value").rlike(_LINE))
    df = lines.select(part(1).alias("s"), part(2).alias("p"), F.coalesce(part(3), part(7), F.regexp_extract("value", _LINE, 4)).alias("o"), F.when(part(3).isNotNull() | part(7).isNotNull(), "uri").otherwise("literal").alias("o_kind"), part(6).alias("o_datatype"), part(5).alias("o_lang"))
    return df if languages is None else df.filter(F.col("o_lang").isNull() | F.col("o_lang").isin(languages))


#: Label properties and their weight.
LABELS = {"http://www.w3.org/2004/02/skos/core#prefLabel": 1.0, "http://www.w3.org/2000/01/rdf-schema#label": 1.0, "http://schema.org/name": 1.0, "http://xmlns.com/foaf/0.1/name": 1.0, "http://www.w3.org/2004/02/skos/core#altLabel": 0.5}


def labels(triples: DataFrame, weights: dict[str, float] = LABELS) -> DataFrame:
    """uri, txt (lower case), score: a label's largest weight."""
    score = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("p")]
    return triples.filter(F.col("p").isin(list(weights))).select(F.col("s").alias("uri"), F.lower("o").alias("txt"), score.alias("score")).groupBy("uri", "txt").agg(F.max("score").alias("score"))


def wikidata(spark: SparkSession, *paths: str, language: str = "en") -> dict[str, DataFrame]:
    """labels, statements (s, stmt_id, p, o) and qualifiers (stmt_id, qp, qo, literal) from a dump's JSON lines."""
    lines = spark.read.text(list(paths)).select(F.rtrim(F.regexp_replace("value", r",\s*$", "")).alias("v")).filter(F.col("v").startswith("{"))
    snak = "struct<property: string, datavalue: struct<type: string, value: string>>"
    schema = f"id string, labels map<string, struct<value: string>>, aliases map<string, array<struct<value: string>>>, claims map<string, array<struct<id: string, mainsnak: {snak}, qualifiers: map<string, array<{snak}>>>>>"
    doc = lines.select(F.from_json("v", schema).alias("d")).select("d.*").filter("id IS NOT NULL")
    value = lambda v: F.coalesce(F.get_json_object(v["value"], "$.id"), F.get_json_object(v["value"], "$.time"), F.get_json_object(v["value"], "$.amount"), F.get_json_object(v["value"], "$.text"), v["value"])
    main = doc.select("id", F.col("labels")[language]["value"].alias("txt"), F.lit(1.0).alias("score"))
    other = doc.select("id", F.explode(F.col("aliases")[language]).alias("a")).select("id", F.col("a.value").alias("txt"), F.lit(0.5).alias("score"))
    names = main.union(other).filter("txt IS NOT NULL").select(F.col("id").alias("uri"), F.lower("txt").alias("txt"), "score").groupBy("uri", "txt").agg(F.max("score").alias("score"))
    claim = doc.select("id", F.explode("claims").alias("p", "list")).select("id", "p", F.explode("list").alias("c"))
    st = claim.select(F.col("id").alias("s"), F.col("c.id").alias("stmt_id"), "p", value(F.col("c.mainsnak.datavalue")).alias("o")).filter("o IS NOT NULL")
    qu = claim.select(F.col("c.id").alias("stmt_id"), F.explode("c.qualifiers").alias("qp", "list")).select("stmt_id", "qp", F.explode("list").alias("q")).select("stmt_id", "qp", value(F.col("q.datavalue")).alias("qo"), (F.col("q.datavalue.type") != "wikibase-entityid").alias("literal")).filter("qo IS NOT NULL")
    return {"labels": names, "statements": st, "qualifiers": qu}


def class_table(spark: SparkSession, path: str) -> DataFrame:
    """Triples from a class table in CSV: names, URIs, types and type URIs of properties in four header rows; ``{a|b}`` are several values, NULL none."""
    lines = spark.read.option("header", False).option("escape", '"').csv(path)
    head = [list(r) for r in lines.limit(4).collect()]
    cells = F.explode(F.array(*[F.struct(F.lit(head[1][i]).alias("p"), F.lit(head[3][i]).alias("datatype"), F.col(f"`{c}`").alias("v")) for i, c in enumerate(lines.columns) if i]))
    body = lines.filter(~F.col(lines.columns[0]).isin([h[0] for h in head])).select(F.col(lines.columns[0]).alias("s"), cells.alias("c")).select("s", "c.*").filter("v IS NOT NULL AND v <> 'NULL'")
    values = F.explode(F.when(F.col("v").rlike(r"^\{.*\}$"), F.split(F.expr("substring(v, 2, length(v) - 2)"), r"\|")).otherwise(F.array("v")))
    return body.select("s", "p", values.alias("o"), F.when(F.col("datatype").contains("XMLSchema"), F.col("datatype")).alias("o_datatype"))


def spotlight(spark: SparkSession, uri_counts: str, pair_counts: str, totals: str) -> DataFrame:
    """surfaceform, uri, pairs, share: how often a surface form, of all its uses as a link, means an entity; names are URL-decoded."""
    read = lambda path, schema: spark.read.schema(schema).option("sep", "\t").csv(path)
    u = read(uri_counts, "uri string, uricount bigint").withColumn("uri", F.try_url_decode("uri"))
    p = read(pair_counts, "surfaceform string, uri string, paircount bigint").withColumn("uri", F.try_url_decode("uri"))
    t = read(totals, "surfaceform string, surfaceformcount bigint, tokencount bigint").filter("surfaceformcount > 0")
    return p.join(u, "uri").join(t, "surfaceform").select("surfaceform", "uri", F.col("paircount").alias("pairs"), (F.col("paircount") / F.col("surfaceformcount")).alias("share"))


def word_vectors(spark: SparkSession, *paths: str) -> DataFrame:
    """word, vec from lines of a word and its numbers."""
    parts = F.split("value", " ")
    return spark.read.text(list(paths)).select(parts[0].alias("word"), F.transform(F.slice(parts, 2, 100_000), lambda x: x.try_cast("float")).alias("vec")).filter("size(vec) > 0")


def pooled(cells: DataFrame, vectors: DataFrame) -> DataFrame:
    """Column vectors (id, v): per distinct cell (id, text) the sum of its words' vectors, then the mean over the column's cells (cells without known words count as zero), of length one."""
    from loomtable.functions import text as T

    n = cells.select("id", "text").distinct()
    words = n.select("id", F.explode(T.tokens(F.col("text"))).alias("word")).filter(F.length("word") > 1)
    dims = words.join(vectors, "word").select("id", F.posexplode("vec").alias("k", "x")).groupBy("id", "k").agg(F.sum("x").alias("x"))
    count = n.groupBy("id").agg(F.count("*").alias("n"))
    mean = dims.join(count, "id").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", (F.col("x") / F.col("n")).alias("x")))), lambda s: s["x"]).alias("v"))
    return mean.select("id", T.unit(F.col("v")).alias("v")).filter("v IS NOT NULL")


def surface_scores(surfaces: DataFrame) -> DataFrame:
    """(uri, surface, score): the largest score of each surface form, divided by the entity's largest."""
    from pyspark.sql import Window

    best = surfaces.groupBy("uri", "surface").agg(F.max("score").alias("score"))
    return best.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("uri")))


def save_labels(labels: DataFrame, path: str) -> None:
    """A label index: Parquet, sorted by text within files, so exact look-ups prune by statistics."""
    labels.repartitionByRange("txt").sortWithinPartitions("txt").write.mode("overwrite").parquet(path)
