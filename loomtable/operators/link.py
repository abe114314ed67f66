"""Knowledge base access, entity search, linking, and integration of facts.

A knowledge base is DataFrames: ``triples`` (s, p, o), ``labels`` (uri, txt,
score), ``titles`` (title, uri), ``statements``/``qualifiers``.  Cells to link
are (table_id, ri, ci, text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtable.functions import text as T
from loomtable.operators.cells import linkable
from loomtable.operators.scratch import written


def pattern(triples: DataFrame, s=None, p=None, o=None) -> DataFrame:
    """Triples with the given positions bound."""
    for name, v in (("s", s), ("p", p), ("o", o)):
        if v is not None:
            triples = triples.filter(F.col(name) == v)
    return triples


def about(uris: DataFrame, triples: DataFrame) -> DataFrame:
    """Facts of the entities in ``uris`` (uri)."""
    return triples.join(uris.select(F.col("uri").alias("s")).distinct(), "s", "left_semi")


def refcounts(triples: DataFrame) -> DataFrame:
    """(uri, refs): how often an entity is an object."""
    return triples.groupBy(F.col("o").alias("uri")).agg(F.count("*").alias("refs"))


def lookup(cells: DataFrame, titles: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Cells with ``title``, looked up: distinct titles are resolved once and fanned out; misses of the first index (absent, null or ``-1``) go to the fallback."""
    known = titles.filter(F.col("uri").isNotNull() & (F.col("uri") != "-1")).groupBy("title").agg(F.min("uri").alias("uri"))
    asked = cells.select("title").distinct()
    found = asked.join(known, "title")
    if fallback is not None:
        missed = asked.join(known, "title", "left_anti")
        found = found.unionByName(missed.join(fallback.groupBy("title").agg(F.min("uri").alias("uri")), "title"))
    return cells.join(found, "title", "left")


def search(queries: DataFrame, labels: DataFrame, triples: DataFrame | None = None, k: int = 10, parts: bool = False) -> DataFrame:
    """Candidates of each distinct query text: (text, uri, score, rank).

    A label matches exactly, ignoring case; with ``parts`` the query's parts
    (before and inside brackets, around commas) match too, at 0.9.  The label
    score is weighted by references where ``triples`` are given; ties go to the
    smaller uri.
    """
    q = queries.select("text").distinct()
    keyed = q.select("text", F.lower("text").alias("txt"), F.lit(1.0).alias("weight"))
    if parts:
        more = q.select("text", F.explode(T.query_parts(F.lower("text"))).alias("txt"), F.lit(0.9).alias("weight"))
        keyed = keyed.unionByName(more.filter(F.col("txt") != F.lower("text")))
    hit = keyed.join(labels.select(F.lower("txt").alias("txt"), "uri", F.col("score").alias("label_score")), "txt")
    best = hit.groupBy("text", "uri").agg(F.max(F.col("weight") * F.col("label_score")).alias("score"))
    if triples is not None:
        best = best.join(refcounts(triples), "uri", "left").withColumn("score", F.col("score") * T.refcount_score(F.coalesce("refs", F.lit(0)) + 1)).drop("refs")
    w = Window.partitionBy("text").orderBy(F.desc("score"), "uri")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("text", "uri", "score", "rank")


def majority_class(candidates: DataFrame, types: DataFrame, least: float = 0.5) -> DataFrame:
    """Per column (table_id, ci) the class that most distinct first candidates have, if it covers ``least`` of those with any class (ties by name)."""
    top = candidates.filter("rank = 1").select("table_id", "ci", "uri").distinct().join(types, "uri")
    n = top.groupBy("table_id", "ci").agg(F.count_distinct("uri").alias("n"))
    c = top.groupBy("table_id", "ci", "type").agg(F.count_distinct("uri").alias("c")).join(n, ["table_id", "ci"])
    w = Window.partitionBy("table_id", "ci").orderBy(F.desc("c"), "type")
    return c.filter(F.col("c") >= F.col("n") * least).withColumn("k", F.row_number().over(w)).filter("k = 1").select("table_id", "ci", "type", (F.col("c") / F.col("n")).alias("cover"))


def without_facts(candidates: DataFrame, triples: DataFrame, facts: list[tuple[str, str]]) -> DataFrame:
    """Candidates that have none of the (property, value) facts."""
    for p, v in facts:
        candidates = candidates.join(pattern(triples, p=p, o=v).select(F.col("s").alias("uri")).distinct(), "uri", "left_anti")
    return candidates


def link_first(cells: DataFrame, labels: DataFrame, types: DataFrame, triples: DataFrame, existing: DataFrame | None = None, limit: int = 1, search_limit: int = 10, class_cover: float = 0.5, normalise: bool = False) -> DataFrame:
    """Entities of cells: the best candidates of the column's majority class, or of any where the column has none.

    Cells that already have an entity (``existing``: table_id, ci, ri) are left
    alone.  Returns (table_id, ci, ri, uri, score).
    """
    cell = ["table_id", "ci", "ri"]
    open_ = cells.filter(linkable(F.col("text")))
    if existing is not None:
        open_ = open_.join(existing.select(*cell).distinct(), cell, "left_anti")
    # Written once: the majority class and the choice both read it.
    found = written(open_.join(search(open_, labels, triples, max(search_limit, limit)), "text"), "candidates")
    major = majority_class(found, types, class_cover).select("table_id", "ci", F.col("type").alias("major"))
    of = found.join(major, ["table_id", "ci"], "left")
    fits = of.join(types.withColumnRenamed("type", "major").withColumn("fits", F.lit(True)).distinct(), ["uri", "major"], "left")
    kept = fits.filter(F.col("major").isNull() | F.col("fits"))
    w = Window.partitionBy(*cell).orderBy(F.desc("score"), "uri")
    out = kept.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= limit)
    if normalise:
        out = out.withColumn("score", F.col("score") / F.sum("score").over(Window.partitionBy(*cell)))
    return out.select(*cell, "uri", "score")


def row_pairs(entities: DataFrame) -> DataFrame:
    """Pairs of linked cells of one row: (table_id, ri, c1, c2, e1, e2), c1 <> c2."""
    a, b = entities.alias("a"), entities.alias("b")
    on = (F.col("a.table_id") == F.col("b.table_id")) & (F.col("a.ri") == F.col("b.ri")) & (F.col("a.ci") != F.col("b.ci"))
    return a.join(b, on).select(F.col("a.table_id"), F.col("a.ri"), F.col("a.ci").alias("c1"), F.col("b.ci").alias("c2"), F.col("a.uri").alias("e1"), F.col("b.uri").alias("e2"))


def row_facts(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """Facts of the knowledge base between cells of a row: (table_id, ri, c1, c2, p)."""
    return row_pairs(entities).join(triples.select(F.col("s").alias("e1"), "p", F.col("o").alias("e2")), ["e1", "e2"]).select("table_id", "ri", "c1", "c2", "p").distinct()


def column_properties(facts: DataFrame, rows: DataFrame) -> DataFrame:
    """Per column pair its best supported property: score = rows with the fact / rows of the table (rows: table_id, n); ties by name."""
    n = facts.groupBy("table_id", "c1", "c2", "p").agg(F.count_distinct("ri").alias("c"))
    w = Window.partitionBy("table_id", "c1", "c2").orderBy(F.desc("c"), "p")
    return n.withColumn("k", F.row_number().over(w)).filter("k = 1").join(rows, "table_id").select("table_id", F.col("c1").alias("from_ci"), F.col("c2").alias("to_ci"), F.col("p").alias("uri"), (F.col("c") / F.col("n")).alias("score"))


def salient(entities: DataFrame, triples: DataFrame, cover: float = 0.5) -> DataFrame:
    """The salient property of each column pair: rows with the fact over (uses of the property in the knowledge base + 1), among those that cover enough rows of the target column."""
    facts = row_facts(entities, triples)
    n = facts.groupBy("table_id", "c1", "c2", "p").agg(F.count_distinct("ri").alias("c"))
    to = entities.groupBy("table_id", F.col("ci").alias("c2")).agg(F.count_distinct("ri").alias("rows"))
    uses = triples.groupBy("p").agg(F.count("*").alias("uses"))
    scored = n.join(to, ["table_id", "c2"]).filter(F.col("c") >= F.col("rows") * cover).join(uses, "p").withColumn("salience", F.col("c") / (F.col("uses") + 1))
    w = Window.partitionBy("table_id", "c1", "c2").orderBy(F.desc("salience"), "p")
    return scored.withColumn("k", F.row_number().over(w)).filter("k = 1").select("table_id", "c1", "c2", "p", "c", "salience")


def link_salient(candidates: DataFrame, triples: DataFrame, cover: float = 0.5) -> DataFrame:
    """Candidates (table_id, ri, ci, uri, score) that a salient property connects with another cell of their row."""
    best = salient(candidates, triples, cover)
    pairs = row_pairs(candidates).join(triples.select(F.col("s").alias("e1"), "p", F.col("o").alias("e2")), ["e1", "e2"]).join(best.select("table_id", "c1", "c2", "p"), ["table_id", "c1", "c2", "p"])
    good = pairs.select("table_id", "ri", F.col("c1").alias("ci"), F.col("e1").alias("uri")).union(pairs.select("table_id", "ri", F.col("c2").alias("ci"), F.col("e2").alias("uri"))).distinct()
    return candidates.join(good, ["table_id", "ri", "ci", "uri"], "left_semi")


def nary_facts(entities: DataFrame, literals: DataFrame, statements: DataFrame, qualifiers: DataFrame) -> DataFrame:
    """Statements between two cells of a row whose qualifiers are met by further cells: (table_id, ri, c1, c2, p, qcol, qprop).

    ``statements``: s, stmt_id, p, o; ``qualifiers``: stmt_id, qp, qo, literal
    (whether qo is one).  Entities match by uri, literals (cells: table_id, ri,
    ci, text) by equal text ignoring case, or by number.
    """
    hit = row_pairs(entities).join(statements.select(F.col("s").alias("e1"), "stmt_id", "p", F.col("o").alias("e2")), ["e1", "e2"])
    q = hit.join(qualifiers, "stmt_id")
    by_uri = q.filter("NOT literal").join(entities.select("table_id", "ri", F.col("ci").alias("qcol"), F.col("uri").alias("qo")), ["table_id", "ri", "qo"])
    key = lambda c: F.coalesce(T.plain_number(F.col(c)).cast("string"), F.lower(c))
    by_text = q.filter("literal").withColumn("qkey", key("qo")).join(literals.select("table_id", "ri", F.col("ci").alias("qcol"), key("text").alias("qkey")), ["table_id", "ri", "qkey"])
    out = ["table_id", "ri", "c1", "c2", "p", "qcol", F.col("qp").alias("qprop")]
    return by_uri.select(*out).union(by_text.select(*out)).filter("qcol <> c1 AND qcol <> c2").distinct()


def integrate_nary(nary: DataFrame, rows: DataFrame) -> DataFrame:
    """Properties of a table without a key column: (table_id, from_ci, to_ci, uri, score).

    For every target column the best supported relation wins: first by the
    number of its qualifier columns, then by its rows.
    """
    base = nary.groupBy("table_id", "c1", "c2", "p").agg(F.count_distinct("ri").alias("n"), F.count_distinct("qcol", "qprop").alias("kinds"))
    q = nary.groupBy("table_id", "c1", "c2", "p", "qcol", "qprop").agg(F.count_distinct("ri").alias("qn"))
    w = Window.partitionBy("table_id", "c1", "c2", "p", "qcol").orderBy(F.desc("qn"), "qprop")
    q = q.withColumn("k", F.row_number().over(w)).filter("k = 1").join(base, ["table_id", "c1", "c2", "p"])
    direct = base.select("table_id", F.col("c1").alias("from_ci"), F.col("c2").alias("to_ci"), F.col("p").alias("uri"), F.col("n").alias("c"), "kinds", "n")
    side = q.select("table_id", F.col("c1").alias("from_ci"), F.col("qcol").alias("to_ci"), F.col("qprop").alias("uri"), F.col("qn").alias("c"), "kinds", "n")
    best = Window.partitionBy("table_id", "to_ci").orderBy(F.desc("kinds"), F.desc("n"), "from_ci", "uri")
    won = direct.union(side).withColumn("k", F.row_number().over(best)).filter("k = 1")
    return won.join(rows.withColumnRenamed("n", "total"), "table_id").select("table_id", "from_ci", "to_ci", "uri", (F.col("c") / F.col("total")).alias("score"))


def kb_info(uris: DataFrame, triples: DataFrame, most: int = 10) -> DataFrame:
    """Per entity the numbers of facts and references, and up to ``most`` objects (smallest first)."""
    u = uris.select("uri").distinct()
    out = triples.join(u.withColumnRenamed("uri", "s"), "s", "left_semi")
    w = Window.partitionBy("s").orderBy("p", "o")
    values = out.withColumn("k", F.row_number().over(w)).groupBy(F.col("s").alias("uri")).agg(F.count("*").alias("facts"), F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.col("o")))).alias("objects"))
    return u.join(values, "uri", "left").join(refcounts(triples), "uri", "left").select("uri", F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("refs", F.lit(0)).alias("refs"), "objects")


def pattern_counts(triples: DataFrame, by: list[str]) -> DataFrame:
    """How many triples there are for each value of the given positions (some of s, p, o)."""
    return triples.groupBy(*by).agg(F.count("*").alias("n"))


def label_match(pairs: DataFrame, labels: DataFrame, least: float = 0.0) -> DataFrame:
    """(uri, text, score): the best edit similarity of a text and any label of the entity it is asked about, if over ``least``."""
    one = pairs.select("uri", "text").distinct()
    near = one.join(labels.select("uri", "txt"), "uri").withColumn("score", T.edit_similarity(F.lower("text"), F.lower("txt")))
    return near.groupBy("uri", "text").agg(F.max("score").alias("score")).filter(F.col("score") > least)


def by_fact_count(candidates: DataFrame, triples: DataFrame) -> DataFrame:
    """Candidates (text, uri) with ``facts`` and their place by falling number of facts, ties to the smaller uri."""
    n = triples.groupBy(F.col("s").alias("uri")).agg(F.count("*").alias("facts"))
    df = candidates.join(n, "uri", "left").withColumn("facts", F.coalesce("facts", F.lit(0)))
    return df.withColumn("place", F.row_number().over(Window.partitionBy("text").orderBy(F.desc("facts"), "uri")))


def search_words(queries: DataFrame, labels: DataFrame, refs: DataFrame | None = None, context: DataFrame | None = None, k: int = 10, most_df: int | None = None) -> DataFrame:
    """Candidates by shared words: (text, uri, score, rank).

    A word weighs ``ln(1 + labels / labels with the word)``; a label scores the
    share of both texts' weight that they have in common, doubled where the
    whole label is the query, times the root of its own score; then comes
    ``ln(1 + references)`` at a tenth (refs: uri, refs) and 0.2 for each fact
    value of the entity (context: uri, value) among the query's context words
    (queries: text, context).  Every shared word makes a candidate.  With
    ``most_df`` the search is quicker but no longer whole: words of more labels
    than that only count in the score, but for a query's rarest word.
    """
    words = lambda df, key, text: df.select(*key, F.explode(T.tokens(F.col(text))).alias("word"))
    lab = labels.select("uri", "txt", "score").withColumn("lid", F.xxhash64("uri", "txt"))
    lw = words(lab, ["lid"], "txt").distinct()
    n = labels.agg(F.count("*").alias("labels"))
    weight = lw.groupBy("word").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("word", "df", F.log(1 + F.col("labels") / F.col("df")).alias("w"))
    lw = written(lw.join(weight, "word"), "label-words")
    q = queries.select("text").distinct()
    qw = written(words(q, ["text"], "text").distinct().join(weight, "word"), "query-words")
    asks = qw
    if most_df is not None:
        rarest = Window.partitionBy("text").orderBy("df", "word")
        asks = qw.withColumn("place", F.row_number().over(rarest)).filter((F.col("df") <= most_df) | (F.col("place") == 1))
    met = asks.select("text", "word").join(lw.select("word", "lid"), "word").select("text", "lid").distinct()
    common = met.join(qw.select("text", "word", "w"), "text").join(lw.select("lid", "word"), ["lid", "word"]).groupBy("text", "lid").agg(F.sum("w").alias("common"))
    total = lambda df, key, out: df.groupBy(key).agg(F.sum("w").alias(out))
    s = common.join(total(qw, "text", "qt"), "text").join(total(lw, "lid", "lt"), "lid").join(lab, "lid")
    same = F.when(F.lower("text") == F.lower("txt"), 2.0).otherwise(1.0)
    s = s.withColumn("base", same * F.col("common") / (F.col("qt") + F.col("lt") - F.col("common")) * F.sqrt("score"))
    best = s.groupBy("text", "uri").agg(F.max("base").alias("score"))
    if refs is not None:
        best = best.join(refs, "uri", "left").withColumn("score", F.col("score") + 0.1 * F.log1p(F.coalesce("refs", F.lit(0)))).drop("refs")
    if context is not None:
        asked = queries.select("text", F.explode(T.tokens(F.col("context"))).alias("value")).distinct()
        hits = best.join(asked, "text").join(context.select("uri", F.lower("value").alias("value")).distinct(), ["uri", "value"]).groupBy("text", "uri").agg(F.count("*").alias("hits"))
        best = best.join(hits, ["text", "uri"], "left").withColumn("score", F.col("score") + 0.2 * F.coalesce("hits", F.lit(0))).drop("hits")
    w = Window.partitionBy("text").orderBy(F.desc(F.round("score", 9)), "uri")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("text", "uri", "score", "rank")
