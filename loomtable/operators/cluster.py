"""Graphs over tables and columns: components, communities, linkage, unions, stitching."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtable.operators.cells import running
from loomtable.operators.linkage import block_labels, block_pairs, complete_linkage, scored_labels  # noqa: F401
from loomtable.operators.scratch import dropped, dropped_since, mark, written
from loomtable.operators.skew import SALTS, salted_join


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph (src, dst); component is its smallest node.

    Large-star and small-star steps by turns: every node's neighbours are hung
    on the smallest of them, then chains are shortened.  The number of rounds
    grows with the logarithm of the longest chain; the loop ends when a round
    changes no edge, and no sooner.  A node's smallest neighbour is found by a
    partial aggregation and handed out by salted joins, so a node with very
    many neighbours is not one task.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    now = written(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct(), "edges")
    seen = _mark(now)
    while True:
        both = now.select("hi", "lo").union(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        root = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        big = salted_join(both.filter("lo > hi"), root, ["hi"], ["lo"]).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        root = big.groupBy("hi").agg(F.min("lo").alias("m"))
        small = salted_join(big, root, ["hi"], ["lo"]).select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
        after = written(small.filter("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), "edges")
        dropped(now)
        now, before, seen = after, seen, _mark(after)
        if seen == before:
            break
    found = now.groupBy("hi").agg(F.min("lo").alias("component")).withColumnRenamed("hi", "node")
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and an order-free sum of their hashes: equal if nothing has changed."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def louvain_groups(ids: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Modularity communities of one connected graph, as a number per id: moves in the order of ids, then merging, until nothing improves."""
    label = np.arange(len(ids))
    a, b, w = src, dst, weight.astype(float)
    while True:
        n = int(max(a.max(), b.max())) + 1 if len(a) else 0
        near: list[dict[int, float]] = [{} for _ in range(n)]
        own = np.zeros(n)
        for x, y, v in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
            if x == y:
                own[x] += v
            else:
                near[x][y] = near[x].get(y, 0) + v
                near[y][x] = near[y].get(x, 0) + v
        degree = np.array([sum(d.values()) for d in near]) + 2 * own
        total = degree.sum()
        com, weight_of = list(range(n)), degree.copy()
        moved_any = False
        moved = True
        while moved:  # each move raises the modularity, so this ends
            moved = False
            for x in range(n):
                links: dict[int, float] = {}
                for y, v in near[x].items():
                    links[com[y]] = links.get(com[y], 0) + v
                weight_of[com[x]] -= degree[x]
                gain = lambda c: links.get(c, 0) - weight_of[c] * degree[x] / total  # noqa: B023, E731
                best = max(sorted(links), key=lambda c: (gain(c), -c), default=com[x])
                if gain(best) <= gain(com[x]) + 1e-12:
                    best = com[x]
                weight_of[best] += degree[x]
                moved |= best != com[x]
                com[x] = best
            moved_any |= moved
        if not moved_any:
            return label
        _, compact = np.unique(com, return_inverse=True)
        label = compact[label]
        a, b = compact[a], compact[b]


def louvain(edges: DataFrame, exponent: float = 1.0) -> DataFrame:
    """(node, part) by modularity, weights raised to ``exponent``; part is its smallest node.

    No community spans components, so each connected component is one group of
    a grouped map; a component has to fit in one task.
    """
    comp = components(edges)
    both = edges.filter("src <> dst").join(comp.withColumnRenamed("node", "src"), "src").select("component", F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), F.pow("weight", F.lit(exponent)).alias("weight"))

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["src", "dst"])
        ids = np.unique(np.concatenate([pdf["src"], pdf["dst"]]))
        label = louvain_groups(ids, np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"]), pdf["weight"].to_numpy())
        least = pd.Series(ids).groupby(label).min()
        return pd.DataFrame({"node": ids, "part": least[label].to_numpy()})

    found = both.groupBy("component").applyInPandas(run, "node bigint, part bigint")
    alone = comp.select(F.col("node").cast("bigint").alias("node")).join(found, "node", "left")
    return alone.select("node", F.coalesce("part", "node").alias("part"))


def modularity(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: the modularity of a partition of a weighted graph without loops."""
    e = edges.filter("src <> dst").join(parts.select(F.col("node").alias("src"), F.col("part").alias("pa")), "src").join(parts.select(F.col("node").alias("dst"), F.col("part").alias("pb")), "dst")
    degree = e.select("pa", "weight").union(e.select(F.col("pb"), "weight")).groupBy("pa").agg(F.sum("weight").alias("d"))
    inside = e.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("pa") == F.col("pb"), F.col("weight")).otherwise(0)).alias("inside"))
    return inside.crossJoin(degree.agg(F.sum(F.col("d") * F.col("d")).alias("dd"))).select((F.col("inside") / F.col("m") - F.col("dd") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def column_clusters(scores: DataFrame) -> DataFrame:
    """(part, gci, cluster) from column scores within partitions (part, c1, c2, score): complete linkage per partition; clusters numbered by falling size, then smallest column.

    A partition's rows have to fit in one task.  ``block_clusters`` takes columns whose scores are too many for rows.
    """

    def run(pdf):
        import pandas as pd

        ids = np.unique(np.concatenate([pdf["c1"], pdf["c2"]]))
        at = lambda c: np.searchsorted(ids, c)
        out = pd.DataFrame({"gci": ids, "raw": scored_labels(len(ids), at(pdf["c1"]), at(pdf["c2"]), pdf["score"].to_numpy(float))})
        size = out.groupby("raw")["gci"].agg(["size", "min"]).sort_values(["size", "min"], ascending=[False, True])
        rank = {raw: i for i, raw in enumerate(size.index)}
        return pd.DataFrame({"part": pdf["part"].iloc[0], "gci": ids, "cluster": [rank[r] for r in out["raw"]]})

    return scores.groupBy("part").applyInPandas(run, "part bigint, gci bigint, cluster bigint")


def block_clusters(columns: DataFrame, score: Callable[[dict, dict], np.ndarray], links: DataFrame | None = None) -> DataFrame:
    """``column_clusters`` of columns (part, block, gci, and what ``score`` reads) of which all in one block are scored by a function, and others by ``links`` (part, c1, c2, score).

    ``score(x, y)`` gets two dicts of NumPy arrays by column name, those of x
    standing and those of y lying, and returns the matrix of scores; it has to
    be symmetric.  Pairs within blocks are cells in a task, computed when they
    are needed, and never rows; links within a block count for nothing.

    First every block is clustered down to its partition's best link, since no
    merge above it can depend on a link.  A link between two clusters stays if
    all pairs of theirs have one.  Blocks joined by links that stay are then
    finished together, in one task, and the others each alone.
    """
    spark, since = columns.sparkSession, mark()
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number, so that few bytes with much work aren't put together
    links = (links if links is not None else spark.createDataFrame([], "part bigint, c1 bigint, c2 bigint, score double")).filter("c1 <> c2 AND score > 0 AND NOT isnan(score)")
    cut = links.groupBy(F.col("part").alias("_loom_part")).agg(F.max("score").alias("_loom_cut")).withColumn("_loom_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = columns.withColumn("_loom_salt", F.pmod(F.xxhash64("gci"), F.lit(SALTS)).cast("int"))
    cut = salted.join(cut, F.col("part").eqNullSafe(F.col("_loom_part")) & (F.col("_loom_salt") == F.col("_loom_of")), "left").drop("_loom_part", "_loom_salt", "_loom_of")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema)

    def rows(pdf, ids):
        have = {c: pdf[c].to_numpy()[ids] for c in pdf if not c.startswith("_loom_")}
        return lambda x, y: score({c: v[x][:, None] for c, v in have.items()}, {c: v[y][None, :] for c, v in have.items()})

    def first(pdf):
        pdf = pdf.sort_values("gci", ignore_index=True)
        best = pdf.pop("_loom_cut").iloc[0]
        label = block_labels(len(pdf), rows(pdf, slice(None)), best if best == best and best else 0.0)
        return pdf.assign(_loom_root=pdf["gci"].to_numpy()[label], _loom_size=np.bincount(label)[label])

    began = written(cut.repartition(spread, "part", "block").groupBy("part", "block").applyInPandas(first, schema + ", _loom_root bigint, _loom_size bigint"), "blocks")

    end = lambda i: began.select(F.col("part").alias(f"p{i}"), F.col("gci").alias(f"g{i}"), F.struct(F.col("_loom_root").alias("root"), "block", F.col("_loom_size").alias("size")).alias(f"e{i}"))
    pair = links.groupBy("part", F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2")).agg(F.max("score").alias("score"))
    pair = pair.join(end(1), F.col("part").eqNullSafe(F.col("p1")) & (F.col("c1") == F.col("g1"))).join(end(2), F.col("part").eqNullSafe(F.col("p2")) & (F.col("c2") == F.col("g2")))
    pair = pair.filter(~F.col("e1.block").eqNullSafe(F.col("e2.block"))).groupBy("part", F.least("e1", "e2").alias("a"), F.greatest("e1", "e2").alias("b")).agg(F.count("*").alias("n"), F.min("score").alias("score"))
    stay = written(pair.filter("n = a.size * b.size").select(F.struct("part", "a.block").alias("src"), F.struct("part", "b.block").alias("dst"), F.col("a.root").alias("a"), F.col("b.root").alias("b"), "score"), "links")
    joined = components(stay).select("node", F.col("component").alias("_loom_of"))
    with_ = began.withColumn("node", F.struct("part", "block")).join(joined, "node", "left").withColumn("_loom_of", F.coalesce("_loom_of", "node")).select(began["*"], F.col("_loom_of.part").alias("_loom_p"), F.col("_loom_of.block").alias("_loom_b"))
    stay = stay.join(joined, F.col("src") == F.col("node")).select("a", "b", "score", F.col("_loom_of.part").alias("_loom_p"), F.col("_loom_of.block").alias("_loom_b"))

    def second(pdf, links):
        import pandas as pd

        pdf = pdf.sort_values("gci", ignore_index=True)
        ids = pdf["gci"].to_numpy()
        label = np.searchsorted(ids, pdf["_loom_root"].to_numpy())
        if not len(links):
            label = block_labels(len(ids), rows(pdf, slice(None)), 0.0, label)
        else:
            a, b, s = [np.searchsorted(ids, links["a"])], [np.searchsorted(ids, links["b"])], [links["score"].to_numpy()]
            for i in pdf.groupby("block", dropna=False).indices.values():
                i = i[np.argsort(label[i], kind="stable")]
                roots, start = np.unique(label[i], return_index=True)
                of = rows(pdf, i)
                x, y, v = block_pairs(len(i), start, lambda lo, hi, since, of=of: of(slice(lo, hi), slice(since, None)))
                a.append(roots[x]), b.append(roots[y]), s.append(v)
            label = scored_labels(len(ids), np.concatenate(a), np.concatenate(b), np.concatenate(s))[label]
        return pd.DataFrame({"part": pdf["part"], "gci": ids, "root": ids[label]})

    by = ["_loom_p", "_loom_b"]
    ended = with_.repartition(spread, *by).groupBy(*by).cogroup(stay.groupBy(*by)).applyInPandas(second, "part bigint, gci bigint, root bigint")
    ended = written(ended, "linked")
    dropped_since(spark, since, ended)
    rank = F.row_number().over(Window.partitionBy("p").orderBy(F.desc("n"), "r")) - 1
    number = ended.groupBy(F.col("part").alias("p"), F.col("root").alias("r")).agg(F.count("*").alias("n")).select("p", "r", rank.cast("bigint").alias("cluster"))
    return ended.join(number, F.col("part").eqNullSafe(F.col("p")) & (F.col("root") == F.col("r"))).select("part", "gci", "cluster")


def sliced(parts: DataFrame, most: int) -> DataFrame:
    """Partitions of more than ``most`` members cut into slices, in the order of nodes: (node, part, slice)."""
    w = Window.partitionBy("part").orderBy("node")
    return parts.withColumn("slice", F.floor((F.row_number().over(w) - 1) / most))


def header_union(rows: DataFrame, key: str, table: str, n_rows: DataFrame) -> DataFrame:
    """Rows of tables with equal header put below one another: ``union_ri`` is the row number within the union, tables in the order of their id.

    ``n_rows`` has key, table and the number of rows.  These numbers are summed
    over all headers range by range, and a header's first sum is taken off, so
    a header that very many tables share is not one task.
    """
    total = written(running(n_rows, {"_loom_total": "n"}, [key, table]), "union-offsets")
    first = total.groupBy(key).agg(F.min("_loom_total").alias("_loom_first"))
    before = salted_join(total, first, [key], [table]).select(key, table, (F.col("_loom_total") - F.col("_loom_first")).alias("_loom_before"))
    return rows.join(before, [key, table]).withColumn("union_ri", F.col("_loom_before") + F.col("ri")).drop("_loom_before")


def majority_header(cells: DataFrame, by: list[str]) -> DataFrame:
    """The commonest non-empty header text of each group (ties to the smallest text); ``col<i>`` if none."""
    n = cells.filter("text <> ''").groupBy(*by, "text").agg(F.count("*").alias("n"))
    best = n.groupBy(*by).agg(F.min_by("text", F.struct((-F.col("n")).alias("n"), "text")).alias("header"))
    every = cells.select(*by).distinct()
    return every.join(best, by, "left").withColumn("header", F.coalesce("header", F.concat(F.lit("col"), F.col(by[-1]).cast("string"))))


def stitch(cells: DataFrame, clusters: DataFrame) -> DataFrame:
    """Tables of a partition as one wide relation in long form: (part, table_id, ri, pci, text); columns without a cluster are left out, missing cells are empty."""
    at = cells.join(clusters, "gci")
    values = at.groupBy("part", "table_id", "ri", F.col("cluster").alias("pci")).agg(F.min_by("text", "gci").alias("text"))
    width = clusters.select("part", F.col("cluster").alias("pci")).distinct()
    rows = at.select("part", "table_id", "ri").distinct().join(width, "part")
    return rows.join(values, ["part", "table_id", "ri", "pci"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def closure(edges: DataFrame, depth: int) -> DataFrame:
    """(start, node, steps): everything reachable over (src, dst) within ``depth`` steps, with the fewest steps; cycles end by themselves."""
    reach = edges.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.lit(1).alias("steps")).distinct()
    front = reach
    for i in range(2, depth + 1):
        step = front.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        front = step.join(reach, ["start", "node"], "left_anti").withColumn("steps", F.lit(i))
        reach = reach.unionByName(front)
    return reach
