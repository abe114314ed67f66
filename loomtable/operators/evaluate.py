"""Evaluation of annotations: scores, precision-recall curves, triples, novelty, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtable.operators.cells import running


def flagged(gold: DataFrame, pred: DataFrame, key: list[str]) -> DataFrame:
    """Outer join of gold and predicted keys: key, gold, pred (booleans), score (of the prediction, null if there is none)."""
    g = gold.select(*key).distinct().withColumn("gold", F.lit(True))
    p = pred.groupBy(*key).agg(F.max("score").alias("score")) if "score" in pred.columns else pred.select(*key).distinct().withColumn("score", F.lit(1.0))
    both = g.join(p.withColumn("pred", F.lit(True)), key, "full_outer")
    return both.select(*key, F.coalesce("gold", F.lit(False)).alias("gold"), F.coalesce("pred", F.lit(False)).alias("pred"), "score")


def annotated_only(flags: DataFrame, target: list[str]) -> DataFrame:
    """Rows of targets that have any gold."""
    w = Window.partitionBy(*target)
    return flags.withColumn("_any", F.max("gold").over(w)).filter("_any").drop("_any")


def any_annotated(flags: DataFrame, target: list[str]) -> DataFrame:
    """One row per target: correct if any of its predictions is; else wrong if there is one; else missed."""
    t = flags.groupBy(*target).agg(F.max("gold").alias("any_gold"), F.max("pred").alias("any_pred"), F.max(F.col("gold") & F.col("pred")).alias("hit"), F.max("score").alias("score"))
    return t.select(*target, (F.col("hit") | (~F.col("any_pred") & F.col("any_gold"))).alias("gold"), F.col("any_pred").alias("pred"), "score")


def scores(flags: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, support, precision, recall, f1 (0 where undefined)."""
    tp, fp, fn = F.count_if(F.col("gold") & F.col("pred")), F.count_if(~F.col("gold") & F.col("pred")), F.count_if(F.col("gold") & ~F.col("pred"))
    agg = flags.groupBy(*(by or [])).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.count_if("gold").alias("support"))
    return rated(agg)


def rated(counts: DataFrame) -> DataFrame:
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    df = counts.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return df.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def report(flags: DataFrame, category: str) -> DataFrame:
    """Scores over all rows (category null) and of each category, in one pass by grouping sets."""
    tp, fp, fn = F.count_if(F.col("gold") & F.col("pred")), F.count_if(~F.col("gold") & F.col("pred")), F.count_if(F.col("gold") & ~F.col("pred"))
    agg = flags.rollup(category).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.count_if("gold").alias("support"))
    return rated(agg)


def pr_curve(flags: DataFrame) -> DataFrame:
    """(threshold, precision, recall) for each distinct score, falling, and the end point (null, 1, 0).

    Scores are counted first, and running sums over distinct scores are made
    range by range (see ``cells.running``), so no task holds all of them.
    """
    n = flags.filter("pred").groupBy((-F.col("score")).alias("down")).agg(F.count_if("gold").alias("hit"), F.count("*").alias("all"))
    total = flags.agg(F.count_if("gold").alias("support"))
    run = running(n, {"hit_before": "hit", "all_before": "all"}, ["down"]).crossJoin(F.broadcast(total))
    run = run.select((F.lit(0.0) - F.col("down")).alias("score"), (F.col("hit_before") + F.col("hit")).alias("tp"), (F.col("all_before") + F.col("all")).alias("n"), "support")
    points = run.select(F.col("score").alias("threshold"), (F.col("tp") / F.col("n")).alias("precision"), F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0).alias("recall"))
    return points.unionByName(total.select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")))


def triple_id(*cols: str) -> Column:
    """Stable id of a triple."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols]), 256)


def label_triples(cells: DataFrame, entities: DataFrame, prop: str = "rdfs:label") -> DataFrame:
    """(s, p, o, gold, pred, s_score): cell texts as labels of the cells' entities (table_id, ri, ci, uri, gold, pred, score)."""
    return entities.join(cells.select("table_id", "ri", "ci", "text"), ["table_id", "ri", "ci"]).select(F.col("uri").alias("s"), F.lit(prop).alias("p"), F.col("text").alias("o"), "gold", "pred", F.col("score").alias("s_score")).distinct()


def class_triples(entities: DataFrame, classes: DataFrame, prop: str = "rdf:type") -> DataFrame:
    """Entities of a column with the column's classes (table_id, ci, uri, gold, pred): gold if both are, predicted if both are; others are left out."""
    c = classes.select("table_id", "ci", F.col("uri").alias("o"), F.col("gold").alias("cg"), F.col("pred").alias("cp"))
    df = entities.join(c, ["table_id", "ci"]).select(F.col("uri").alias("s"), F.lit(prop).alias("p"), "o", (F.col("gold") & F.col("cg")).alias("gold"), (F.col("pred") & F.col("cp")).alias("pred"))
    return df.filter("gold OR pred").groupBy("s", "p", "o").agg(F.max("gold").alias("gold"), F.max("pred").alias("pred"))


def property_triples(entities: DataFrame, cells: DataFrame, properties: DataFrame) -> DataFrame:
    """Facts that column properties (table_id, from_ci, to_ci, uri) assert: objects are the target cell's entities, or its text where the column has none."""
    p = properties.select("table_id", "from_ci", "to_ci", F.col("uri").alias("p"))
    subj = entities.select("table_id", "ri", F.col("ci").alias("from_ci"), F.col("uri").alias("s"))
    obj = entities.select("table_id", "ri", F.col("ci").alias("to_ci"), F.col("uri").alias("o"))
    linked = entities.select("table_id", F.col("ci").alias("to_ci")).distinct()
    facts = subj.join(p, ["table_id", "from_ci"])
    by_uri = facts.join(obj, ["table_id", "ri", "to_ci"]).select("s", "p", "o", F.lit("uri").alias("kind"))
    text = cells.filter(F.trim("text") != "").select("table_id", "ri", F.col("ci").alias("to_ci"), F.col("text").alias("o"))
    by_text = facts.join(linked, ["table_id", "to_ci"], "left_anti").join(text, ["table_id", "ri", "to_ci"]).select("s", "p", "o", F.lit("literal").alias("kind"))
    return by_uri.union(by_text).distinct()


def novelty(triples: DataFrame, kb: DataFrame) -> DataFrame:
    """Each triple (s, p, o) as ``existing``, ``valnovel`` (the knowledge base has other values) or ``attnovel`` (it has none for s and p)."""
    have = kb.select("s", "p").distinct().withColumn("has_attribute", F.lit(True))
    same = kb.select("s", "p", F.lower("o").alias("key")).distinct().withColumn("has_value", F.lit(True))
    df = triples.withColumn("key", F.lower("o")).join(have, ["s", "p"], "left").join(same, ["s", "p", "key"], "left")
    kind = F.when(F.col("has_value"), "existing").when(F.col("has_attribute"), "valnovel").otherwise("attnovel")
    return df.withColumn("novelty", kind).drop("key", "has_attribute", "has_value")


def novelty_counts(triples: DataFrame) -> DataFrame:
    """tp, fp, fn by novelty, over distinct triples with gold and pred flags."""
    one = triples.groupBy("novelty", triple_id("s", "p", "o").alias("id")).agg(F.max("gold").alias("gold"), F.max("pred").alias("pred"))
    return scores(one, ["novelty"])


def submission(targets: DataFrame, predictions: DataFrame, key: list[str]) -> DataFrame:
    """Every target with its best prediction (uri; ties to the smaller), null if there is none."""
    best = predictions.groupBy(*key).agg(F.min_by("uri", F.struct((-F.col("score")).alias("n"), F.col("uri"))).alias("uri"))
    return targets.select(*key).distinct().join(best, key, "left")


def flat_entities(tables: DataFrame) -> DataFrame:
    """(table_id, ci, ri, uri, score) from ``entities``: column -> row -> URI -> score."""
    col = tables.select("table_id", F.explode("entities").alias("ci", "of"))
    row = col.select("table_id", F.col("ci").cast("int"), F.explode("of").alias("ri", "of"))
    return row.select("table_id", "ci", F.col("ri").cast("int"), F.explode("of").alias("uri", "score"))


def flat_classes(tables: DataFrame) -> DataFrame:
    """(table_id, ci, uri, score) from ``classes``: column -> URI -> score."""
    return tables.select("table_id", F.explode("classes").alias("ci", "of")).select("table_id", F.col("ci").cast("int"), F.explode("of").alias("uri", "score"))


def flat_properties(tables: DataFrame) -> DataFrame:
    """(table_id, from_ci, to_ci, uri, score) from ``properties``: column -> column -> URI -> score."""
    a = tables.select("table_id", F.explode("properties").alias("from_ci", "of"))
    b = a.select("table_id", F.col("from_ci").cast("int"), F.explode("of").alias("to_ci", "of"))
    return b.select("table_id", "from_ci", F.col("to_ci").cast("int"), F.explode("of").alias("uri", "score"))


def overview(tables: DataFrame, entities: DataFrame, classes: DataFrame, properties: DataFrame) -> DataFrame:
    """One row: numbers of tables, of annotations, and means of rows and columns."""
    base = tables.agg(F.count("*").alias("tables"), F.avg("num_rows").alias("rows"), F.avg("num_cols").alias("columns"))
    for name, df in (("entities", entities), ("classes", classes), ("properties", properties)):
        base = base.crossJoin(df.agg(F.count("*").alias(name)))  # one row with one row
    return base
