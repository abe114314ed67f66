"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves; a codebook per half is fitted (k-means) on at
most ``MAX_SAMPLE`` vectors, taken by smallest hash; every vector is then
indexed by its pair of nearest centroids.  A codebook has about as many
centroids as the square root of the vectors' number, between ``CODES``' bounds.
A query walks the pairs in order of summed distance with a heap until the pairs
it has seen hold ``candidates`` vectors and a ``share`` of all, and those are
reranked by exact distance on the original vectors.  The share that a recall
needs is a property of the vectors, and falls with finer codebooks: the default,
``0.33 + 11 / centroids``, is for near-isotropic ones, as the test tables hold,
at a recall of 0.9 or more; vectors with real clusters do with ``share=0``.

Of equal vectors only the k + 1 smallest ids can be among anybody's k nearest
(ties go to smaller ids, a query leaves itself out), so only those are
indexed: exact, and a vector that a third of all rows share costs nothing.
The cells of one first-half centroid are dealt into blocks of ``BLOCK`` vectors,
and the queries that visit some of them into blocks of ``QUERY_BLOCK``; pairs of
blocks are dealt by (centroid, block of vectors), so there are as many keys as
blocks of vectors.  A task keeps the k best of each query over all its pairs,
and queries are never broadcast.  Cell sizes (centroids squared numbers, 65,536
at most) and codebooks are.

Defined results: vectors that are null, empty, zero, or hold null or
non-finite components take no part; nor do those whose length is not the
commonest (the smaller on a tie).  Rows repeated whole count once; rows of one
id with different vectors are separate candidates, of which the nearest counts,
and queries of that id share one list.  With fewer than k candidates all are
returned.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtable.llm._shared import has, table, written

K_NEAREST = 10
#: Fewest and most centroids of a half.
CODES = (32, 256)
MAX_SAMPLE = 10_000
CANDIDATES = 100
BLOCK, QUERY_BLOCK = 1024, 64
#: Results that a task holds before it keeps the best of each query.
HELD = 1_000_000
ITERATIONS = 12


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None, :]
    return d.argmin(1), d


def codebook(x: np.ndarray, codes: int, seed: int = 5) -> np.ndarray:
    """Lloyd's k-means from distinct sample rows."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(codes, len(x)), replace=False)].astype(float)
    for _ in range(ITERATIONS):
        at, _ = _nearest(x, centres)
        many = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        full = many > 0
        centres[full] = total[full] / many[full, None]
    return centres


def walk(da: np.ndarray, db: np.ndarray, sizes: list[int], wanted: int) -> list[int]:
    """Cells with vectors in order of da[i] + db[j] until they hold the wanted number: a heap holds the next pair of each centroid i that has begun."""
    oa, ob = np.argsort(da, kind="stable").tolist(), np.argsort(db, kind="stable").tolist()
    a, b = da[oa].tolist(), db[ob].tolist()
    n, last, out, held = len(b), len(a) - 1, [], 0
    heap = [(a[0] + b[0], 0, 0)]
    while heap and held < wanted:
        _, i, j = heap[0]
        cell = oa[i] * n + ob[j]
        if sizes[cell]:
            out.append(cell)
            held += sizes[cell]
        if j + 1 < n:
            heapq.heapreplace(heap, (a[i] + b[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i < last:  # the next centroid begins no earlier than this one
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


def best_of(query: np.ndarray, vid: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query, each id once, ties to smaller ids."""
    order = np.lexsort((d, vid, query))
    query, vid, d = query[order], vid[order], d[order]
    once = np.ones(len(query), bool)
    once[1:] = (query[1:] != query[:-1]) | (vid[1:] != vid[:-1])
    query, vid, d = query[once], vid[once], d[once]
    order = np.lexsort((vid, d, query))
    query, vid, d = query[order], vid[order], d[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    return query[rank < k], vid[rank < k], d[rank < k]


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """vec_id and v (array of double) of the vectors that take part."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda c: c != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).first()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def search(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", k: int = K_NEAREST, codes: int | None = None, candidates: int = CANDIDATES, share: float | None = None, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """Per query and rank: query_id, rank, vec_id, score (Euclidean distance)."""
    has(vectors, id_col, vector)
    has(queries, id_col, vector)
    spark = vectors.sparkSession
    rows = written(usable(vectors, id_col, vector), "vectors")
    asked = written(usable(queries, id_col, vector).distinct(), "queries")
    same = Window.partitionBy("v").orderBy("vec_id")
    indexed = rows.withColumn("copy", F.dense_rank().over(same)).where(F.col("copy") <= k + 1).groupBy("v", "vec_id").agg(F.lit(1))
    indexed = indexed.select("vec_id", "v")
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(max_sample).collect()
    if not sample:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    codes = codes or min(CODES[1], max(CODES[0], round(math.sqrt(rows.count()))))
    x = np.array([r["v"] for r in sample])
    half = x.shape[1] // 2
    books = spark.sparkContext.broadcast((codebook(x[:, :half], codes), codebook(x[:, half:], codes)))
    width = len(books.value[1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = books.value
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column("v"))
                cell = _nearest(m[:, :half], one)[0] * len(two) + _nearest(m[:, half:], two)[0]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell, pa.int64())], names=["vec_id", "v", "cell"])

    cells = written(indexed.mapInArrow(assign, "vec_id bigint, v array<double>, cell bigint"), "index")
    sizes = [0] * (len(books.value[0]) * width)
    for r in cells.groupBy("cell").count().collect():  # centroids squared rows at most
        sizes[r["cell"]] = r["count"]
    held = spark.sparkContext.broadcast(sizes)
    share = 0.33 + 11 / codes if share is None else share
    enough = max(candidates, math.ceil(share * sum(sizes)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = books.value
        for batch in batches:
            for lo in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(lo, QUERY_BLOCK)
                m = _matrix(part.column("v"))
                da, db = _nearest(m[:, :half], one)[1], _nearest(m[:, half:], two)[1]
                at, codes_, others = [], [], []
                for i, (p, q) in enumerate(zip(da, db, strict=True)):
                    by: dict[int, list[int]] = {}
                    for cell in walk(p, q, held.value, enough):
                        by.setdefault(cell // width, []).append(cell % width)
                    at += [i] * len(by)
                    codes_ += by.keys()
                    others += by.values()
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(pa.array(at, pa.int64())), part.column("v").take(pa.array(at, pa.int64())), pa.array(codes_, pa.int32()), pa.array(others, pa.list_(pa.int32()))],
                    names=["query_id", "q", "code", "others"],
                )

    routed = asked.repartition(max(1, -(-asked.count() // QUERY_BLOCK)), "vec_id").mapInArrow(route, "query_id bigint, q array<double>, code int, others array<int>")
    many = [sum(sizes[c * width : (c + 1) * width]) for c in range(len(books.value[0]))]
    blocks_of = F.create_map(*[F.lit(v) for c, n in enumerate(many) for v in (c, max(1, -(-n // BLOCK)))])
    code = F.floor(F.col("cell") / width).cast("int")
    blocks = (
        cells.select(code.alias("code"), F.pmod("cell", F.lit(width)).cast("int").alias("other"), "vec_id", "v")
        .groupBy("code", F.pmod(F.xxhash64("vec_id"), blocks_of[F.col("code")]).cast("int").alias("block")).agg(F.collect_list(F.struct("vec_id", "v", "other")).alias("rows"))
    )
    # A query block holds about QUERY_BLOCK queries, however many come: their number is counted.
    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    asking = routed.groupBy("code", F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("query_id", "q", "others")).alias("asked"))
    asking = asking.select("code", "asked", F.explode(F.sequence(F.lit(0), blocks_of[F.col("code")] - 1)).alias("block"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple] = []
        total = 0

        def kept() -> tuple:
            return best_of(*(np.concatenate(c) for c in zip(*got, strict=True)), k)

        for batch in batches:
            for i in range(batch.num_rows):
                a, r = batch.column("asked")[i].values, batch.column("rows")[i].values
                qid, vid, other = a.field("query_id").to_numpy(), r.field("vec_id").to_numpy(), r.field("other").to_numpy()
                q, v, lists = _matrix(a.field("q")), _matrix(r.field("v")), a.field("others")
                single = len(np.unique(vid)) == len(vid)
                for j in range(len(q)):
                    open_ = np.zeros(width, bool)
                    open_[lists[j].values.to_numpy()] = True
                    at = np.flatnonzero(open_[other] & (vid != qid[j]))
                    d = np.sqrt(((q[j] - v[at]) ** 2).sum(1))
                    if single and len(at) > k:  # all that tie with the k-th stay, for the smaller ids
                        keep = d <= np.partition(d, k - 1)[k - 1]
                        at, d = at[keep], d[keep]
                    got.append((np.full(len(at), qid[j]), vid[at], d))
                    total += len(at)
                if total > HELD:
                    got = [kept()]
                    total = len(got[0][0])
                    if total > HELD // 2:  # very many queries: give out what there is
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in got[0]], names=["query_id", "vec_id", "score"])
                        got, total = [], 0
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in kept()], names=["query_id", "vec_id", "score"])

    # Lists of vectors are far larger than Spark estimates: never let it broadcast them.
    near = asking.join(blocks.hint("merge"), ["code", "block"]).select("asked", "rows").mapInArrow(rank, "query_id bigint, vec_id bigint, score double")
    best = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.pmod("vec_id", F.lit(100)) == 0))
