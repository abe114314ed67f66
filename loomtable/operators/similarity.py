"""Column and table similarity: matchers, their blocks, score expressions, alignment.

A matcher gives signatures of columns, a block (candidate table pairs by an
equi join on shared keys, never a cross join) and scores of column pairs.
Columns are (ti, ci); scores are (ti1, ti2, ci1, ci2, matcher, score).
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtable.functions import text as T
from loomtable.operators.scratch import written

PAIR = ["ti1", "ti2", "ci1", "ci2"]


def cell_block(cells: DataFrame) -> DataFrame:
    """Table pairs that share an identical cell (as a token set).

    Cells (ti, ci, text) are first made distinct per table; the rest is an equi
    join on the cell.
    """
    keyed = cells.withColumn("key", F.array_sort(T.tokens(F.col("text")))).filter((F.size("key") > 0) & ~F.exists("key", lambda t: t.startswith("_")))
    one = keyed.select("ti", F.array_join("key", " ").alias("key")).distinct()
    a, b = one.alias("a"), one.alias("b")
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.ti") < F.col("b.ti"))).select(F.col("a.ti").alias("ti1"), F.col("b.ti").alias("ti2")).distinct()


def cell_jaccard(cells: DataFrame, block: DataFrame) -> DataFrame:
    """Best token-set Jaccard of any two cells of two columns."""
    sets = cells.select("ti", "ci", T.tokens(F.col("text")).alias("set")).filter((F.size("set") > 0) & ~F.forall("set", lambda t: t.startswith("_"))).distinct()
    token = sets.withColumn("token", F.explode("set"))
    x, y = token.alias("x"), token.alias("y")
    met = block.join(x, F.col("ti1") == F.col("x.ti")).join(y, (F.col("ti2") == F.col("y.ti")) & (F.col("x.token") == F.col("y.token")))
    pairs = met.select("ti1", "ti2", F.col("x.ci").alias("ci1"), F.col("y.ci").alias("ci2"), F.col("x.set").alias("a"), F.col("y.set").alias("b")).distinct()
    return pairs.groupBy(*PAIR).agg(F.max(T.jaccard(F.col("a"), F.col("b"))).alias("score"))


def shared_token_pairs(left: DataFrame, right: DataFrame, least: float = 0.1) -> DataFrame:
    """Pairs (a, b) of rows (id, text) whose token sets have a Jaccard of at least ``least`` (over 0), with the number of shared tokens.

    Tokens are ordered from rare to common.  Two sets that are alike enough
    share one of the first ``n - ceil(least * n) + 1`` tokens of either, so only
    these are joined: a token that a third of all rows hold is in the prefix of
    rows with nothing rarer alone.  Candidates are verified on the whole sets.
    """
    words = lambda df: df.select("id", F.array_distinct(T.tokens(F.col("text"))).alias("set")).filter("size(set) > 0")
    l, r = words(left), words(right)
    rank = l.unionByName(r).select(F.explode("set").alias("token")).groupBy("token").agg(F.count("*").alias("df"))

    def ordered(df: DataFrame) -> DataFrame:
        seen = df.select("id", F.explode("set").alias("token")).join(rank, "token")
        rows = seen.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("set"))
        n = F.size("set")
        return rows.withColumn("prefix", F.slice("set", 1, n - F.ceil(n * F.lit(least)).cast("int") + 1))

    x = ordered(l).select(F.col("id").alias("a"), F.col("set").alias("sa"), "prefix")
    y = ordered(r).select(F.col("id").alias("b"), F.col("set").alias("sb"), "prefix")
    near = lambda n, m: (n * F.lit(1.0) >= m * F.lit(least)) & (m * F.lit(1.0) >= n * F.lit(least))
    met = x.select("a", F.size("sa").alias("na"), F.explode("prefix").alias("token")).join(y.select("b", F.size("sb").alias("nb"), F.explode("prefix").alias("token")), "token")
    pairs = met.filter(near(F.col("na"), F.col("nb"))).select("a", "b").distinct()
    both = pairs.join(x.drop("prefix"), "a").join(y.drop("prefix"), "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")).cast("bigint"))
    out = both.select("a", "b", "shared", (F.col("shared") / (F.size("sa") + F.size("sb") - F.col("shared"))).alias("jaccard"))
    return out.filter(F.col("jaccard") >= least)


def lsh_shape(slots: int, threshold: float) -> tuple[int, int]:
    """Bands and rows with bands * rows <= slots whose S-curve is steepest nearest the threshold."""
    return min(((b, slots // b) for b in range(1, slots + 1)), key=lambda s: (abs((1 / s[0]) ** (1 / s[1]) - threshold), s[0]))


def lsh_signatures(columns: DataFrame, slots: int = 128) -> DataFrame:
    """MinHash signature of each column's distinct lower-cased texts (id, text); mostly numeric columns are left out.

    Per slot the minimum is an aggregate, partially computed before the
    shuffle, so a column of any length is never gathered.
    """
    plain = F.regexp_replace(F.trim("text"), "[-.,%]", "")
    df = columns.filter("text <> ''").withColumn("num", plain.rlike("^[0-9]+$").cast("int"))
    words = df.withColumn("low", F.lower("text"))
    mins = [F.min(F.xxhash64("low", F.lit(i))).alias(f"m{i}") for i in range(slots)]
    out = words.groupBy("id").agg(F.avg("num").alias("numeric"), *mins).filter("numeric <= 0.5")
    return out.select("id", F.array(*[f"m{i}" for i in range(slots)]).alias("signature"))


def lsh_block(signatures: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs of columns with an equal band."""
    slots = 128
    bands, rows = lsh_shape(slots, threshold)
    band = F.explode(F.array(*[F.struct(F.lit(i).alias("n"), F.xxhash64(F.slice("signature", i * rows + 1, rows)).alias("h")) for i in range(bands)]))
    keyed = signatures.select("id", "signature", band.alias("band")).select("id", "band.n", "band.h")
    a, b = keyed.alias("a"), keyed.alias("b")
    return a.join(b, (F.col("a.n") == F.col("b.n")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def lsh_score(signatures: DataFrame, pairs: DataFrame) -> DataFrame:
    s = signatures
    both = pairs.join(s.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a").join(s.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")
    return both.select("a", "b", T.minhash_estimate(F.col("sa"), F.col("sb")).alias("score"))


#: Queries that are sent to all tasks at once, and vectors of one step of a matrix product.
QUERY_BLOCK, VECTOR_BLOCK = 16_384, 1024


def top_cosine(queries: DataFrame, vectors: DataFrame, n: int, least: float | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """The n most similar other vectors of each query (id, v), exactly: query, id, score, rank; ties to smaller ids.

    Queries pass in blocks of at most ``block``, one after another, so neither
    the driver nor a task ever holds more; vectors are scanned where they lie.
    A task keeps the n best per query and gives them out at its end, so what is
    shuffled is n rows per query and task.  The work is queries times vectors.
    """
    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    schema = "query bigint, id bigint, score double"
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    floor = -np.inf if least is None else least

    def scan(shared):
        def run(batches):
            ids, q = shared.value
            best = [(np.empty(0, np.int64), np.empty(0))] * len(ids)
            for batch in batches:
                for lo in range(0, batch.num_rows, VECTOR_BLOCK):
                    part = batch.slice(lo, VECTOR_BLOCK)
                    vid = part.column("id").to_numpy()
                    m = unit(part.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vid), -1))
                    for at in range(0, len(ids), VECTOR_BLOCK):
                        s = np.round(q[at : at + VECTOR_BLOCK] @ m.T, 9)
                        for i, row in enumerate(s, at):
                            old = best[i][1]
                            good = np.flatnonzero((row > floor) & (row >= (old[-1] if len(old) == n else -np.inf)) & (vid != ids[i]))
                            if len(good):
                                some, score = np.concatenate([best[i][0], vid[good]]), np.concatenate([old, row[good]])
                                order = np.lexsort((some, -score))[:n]
                                best[i] = some[order], score[order]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, [len(b[0]) for b in best])), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best]))], names=["query", "id", "score"]
            )

        return vectors.select(F.col("id").cast("bigint"), F.col("v").cast("array<double>")).mapInArrow(run, schema)

    asked = queries.select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v"))
    parts = math.ceil(asked.count() / block)
    near = spark.createDataFrame([], schema)
    for k in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == k).orderBy("id").collect()  # about ``block`` rows
        if not rows:
            continue
        shared = spark.sparkContext.broadcast((np.array([r["id"] for r in rows]), unit(np.array([r["v"] for r in rows], dtype=float))))
        found = scan(shared)
        if parts > 1:
            found = written(found, "near")
            shared.destroy()
        near = near.unionByName(found)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def sparse_cosine(weights: DataFrame, least: float = 0.0) -> DataFrame:
    """Pairs (a, b, score) of sparse vectors (id, key, w) with a cosine over ``least``.

    With ``least`` over 0 keys are ordered from rare to common, and a vector's
    tail of keys whose joint length is under ``least`` is left out of the
    search: what two vectors share there alone cannot reach it.  Candidates are
    scored on all keys.  With 0 every shared key counts and all are joined.
    """
    norm = weights.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).filter("norm > 0")
    x = weights.join(norm, "id").select("id", "key", (F.col("w") / F.col("norm")).alias("w"))
    if least <= 0:
        a, b = x.alias("a"), x.alias("b")
        met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")))
        return met.groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b")).agg(F.sum(F.col("a.w") * F.col("b.w")).alias("score")).filter(F.col("score") > least)
    rank = x.groupBy("key").agg(F.count("*").alias("df"))
    rows = x.join(rank, "key").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "key", "w"))).alias("keys"))
    tail = F.aggregate(F.reverse("keys"), F.struct(F.lit(0.0).alias("left"), F.lit(0).alias("n")), lambda s, k: F.when(s["left"] + k["w"] * k["w"] < least * least * (1 - 1e-9), F.struct((s["left"] + k["w"] * k["w"]).alias("left"), (s["n"] + 1).alias("n"))).otherwise(
        F.struct(F.lit(2.0).alias("left"), s["n"].alias("n"))
    ), lambda s: s["n"])
    rows = written(rows.select("id", F.transform("keys", lambda k: F.struct(k["key"].alias("key"), k["w"].alias("w"))).alias("keys"), F.transform(F.slice("keys", 1, F.size("keys") - tail), lambda k: k["key"]).alias("prefix")), "sparse")
    head = rows.select("id", F.explode("prefix").alias("key"))
    a, b = head.alias("a"), head.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    side = lambda out: rows.select(F.col("id").alias(out), F.map_from_entries("keys").alias(f"k{out}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    dot = F.aggregate(F.map_entries("ka"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.col("kb")[e["key"]], F.lit(0.0)))
    return both.select("a", "b", dot.alias("score")).filter(F.col("score") > least)


def tfidf(texts: DataFrame, least_df: int = 1, most_df: int | None = None) -> DataFrame:
    """(id, key, w): term count times ``ln(documents / document frequency)``, over token multisets of (id, text)."""
    words = texts.select("id", F.explode(F.filter(F.split(F.lower("text"), T.NONWORD), lambda t: t != "")).alias("key"))
    tf = words.groupBy("id", "key").agg(F.count("*").alias("tf"))
    df = tf.groupBy("key").agg(F.count("*").alias("df")).filter(F.col("df") >= least_df)
    df = df if most_df is None else df.filter(F.col("df") <= most_df)
    n = texts.select("id").distinct().agg(F.count("*").alias("n"))
    return tf.join(df, "key").crossJoin(F.broadcast(n)).select("id", "key", (F.col("tf") * F.log(F.col("n") / F.col("df"))).alias("w"))


def wide_scores(scores: DataFrame, matchers: list[str]) -> DataFrame:
    """One row per column pair, one column per matcher (null: no score); of several scores the largest."""
    return scores.groupBy(*PAIR).agg(*[F.max(F.when(F.col("matcher") == m, F.col("score"))).alias(m) for m in matchers])


def score_expression(text: str, matchers: list[str]) -> Column:
    """A column from an expression over matcher names: ``@max``, ``@min``, ``@mean`` (which skip missing scores), ``@pow``, numbers, ``+ - * /``.  A bare function name applies to all matchers."""
    known = {"max": _greatest, "min": _least, "mean": _mean}
    if text in known:
        return known[text](*[F.col(m) for m in matchers])

    def build(node) -> Column:
        if isinstance(node, ast.Expression):
            return build(node.body)
        if isinstance(node, ast.Name) and node.id in matchers:
            return F.col(node.id)
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float):
            return F.lit(float(node.value))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -build(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            args = [build(a) for a in node.args]
            if node.func.id == "pow" and len(args) == 2:
                return F.pow(*args)
            if node.func.id in known:
                return known[node.func.id](*args)
        raise ValueError(f"not a score expression: {text!r}")

    return build(ast.parse(text.replace("@", ""), mode="eval"))


_OPERATORS = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b}


def _greatest(*cols: Column) -> Column:
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def _least(*cols: Column) -> Column:
    return cols[0] if len(cols) == 1 else F.least(*cols)


def _mean(*cols: Column) -> Column:
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    return total / F.nullif(reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols]), F.lit(0))


def greedy_alignment(scores: DataFrame) -> DataFrame:
    """Per table pair, the sum of column scores taken greedily from the best down, each column once (ties by ci1, ci2)."""
    state = F.struct(F.lit(0.0).alias("t"), F.array().cast("array<int>").alias("a"), F.array().cast("array<int>").alias("b"))
    take = lambda s, x: F.when(F.array_contains(s["a"], x["ci1"]) | F.array_contains(s["b"], x["ci2"]), s).otherwise(
        F.struct((s["t"] - x["n"]).alias("t"), F.array_append(s["a"], x["ci1"]).alias("a"), F.array_append(s["b"], x["ci2"]).alias("b"))
    )
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("n"), F.col("ci1").cast("int").alias("ci1"), F.col("ci2").cast("int").alias("ci2"))))
    return scores.filter("score is not null").groupBy("ti1", "ti2").agg(rows.alias("rows")).select("ti1", "ti2", F.aggregate("rows", state, take, lambda s: s["t"]).alias("total"))


def best_alignment(scores: DataFrame, side: int = 1) -> DataFrame:
    """Per table pair, the mean over the columns of one side of their best score."""
    key = f"ci{side}"
    best = scores.groupBy("ti1", "ti2", key).agg(F.max("score").alias("best"))
    return best.groupBy("ti1", "ti2").agg(F.avg("best").alias("total"))


def normalised(totals: DataFrame, widths: DataFrame, how: str = "jacc") -> DataFrame:
    """Table similarity from aligned totals and table widths (ti, n): ``jacc`` t/(n1+n2-t), ``wide`` t/max, ``narrow`` t/min."""
    df = totals.join(widths.select(F.col("ti").alias("ti1"), F.col("n").alias("n1")), "ti1").join(widths.select(F.col("ti").alias("ti2"), F.col("n").alias("n2")), "ti2")
    t = F.col("total")
    size = {"jacc": F.col("n1") + F.col("n2") - t, "wide": F.greatest("n1", "n2"), "narrow": F.least("n1", "n2")}[how]
    return df.select("ti1", "ti2", (t / size).alias("sim"))


@dataclass(frozen=True)
class Matcher:
    """What a way of comparing columns consists of.

    ``score(cells, block)`` gives (ti1, ti2, ci1, ci2, score); ``block(cells)``
    the table pairs it is asked for (none: those that share a cell); ``source``
    says whether it compares head or body cells.
    """

    score: Callable[[DataFrame, DataFrame], DataFrame]
    block: Callable[[DataFrame], DataFrame] | None = None
    source: str = "body"

    def matches(self, cells: DataFrame) -> DataFrame:
        flat = cells.filter(F.col("section") == self.source).select("ti", "ci", "text").distinct()
        return self.score(flat, (self.block or cell_block)(flat)).select(*PAIR, F.col("score").cast("double").alias("score"))


def block_statistics(block: DataFrame) -> DataFrame:
    """One row about a block: pairs, tables with a partner, mean and deviation of partners per table."""
    n = block.select(F.col("ti1").alias("ti")).union(block.select("ti2")).groupBy("ti").agg(F.count("*").alias("n"))
    return n.agg((F.sum("n") / 2).cast("bigint").alias("pairs"), F.count("*").alias("tables"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("deviation"))


def kept_by(scores: DataFrame, other: DataFrame) -> DataFrame:
    """Column pairs that a second matcher scores over 0."""
    return scores.join(other.filter("score > 0").select(*PAIR), PAIR, "left_semi")


def with_identity(sims: DataFrame, tables: DataFrame) -> DataFrame:
    """Similarities (ti1, ti2, sim) with an edge of 1 from each table (ti) to itself."""
    return sims.select("ti1", "ti2", "sim").unionByName(tables.select(F.col("ti").alias("ti1"), F.col("ti").alias("ti2"), F.lit(1.0).alias("sim")))


#: Types that say nothing about a column.
DULL_TYPES = ("xsd:string",)


def type_vectors(typed: DataFrame, exclude: tuple[str, ...] = DULL_TYPES) -> DataFrame:
    """(id, key, w): how often each type stands in a column (id, type), but for the excluded ones."""
    return typed.filter(~F.col("type").isin(*exclude)).groupBy("id", F.col("type").alias("key")).agg(F.count("*").cast("double").alias("w"))
