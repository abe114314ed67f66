"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees on one binned feature at a time are boosted in turn, round after
round, with a small learning rate; their sum is one look-up table per feature.
The pairs of features whose 2-D grid explains most of what remains get a table
each, boosted the same way.  A score is the sigmoid of table entries added up,
for whole batches at once.

Features come from the whole text alone (never from labels, language, source
or id).  The model is fitted on the driver on at most ``MAX_SAMPLE`` labelled
rows (32 floats each), taken by smallest hash of their id, so the sample is
bounded and does not depend on partitioning; all rows are scored, in one scan
without a shuffle.

Defined results: null and empty texts are scored like any other, with all
features 0.  Rows pass one by one, so repeated rows and ids keep their number.
Repeated labels of one id are averaged; null labels are left out.  Without
labels of both classes the model is the constant share of class 1 (0.5 without
any label).  Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtable.llm import _kernel as K
from loomtable.llm._shared import has, packed, table, unpacked

MAX_SAMPLE = 20_000
BINS, GRID = 48, 12
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, PAIRS = 250, 120, 0.08, 3, 6
THRESHOLD = 0.3
FOLDS = 5

FEATURES = [
    "log_words", "mean_word_bytes", "upper_share", "digit_share", "symbol_share", "pipe_share", "bang_share", "wide_share", "distinct_words",
    "repeat_next", "top_word_share", "log_lines", "stop_share", "comma_share", "symbol_runs", "long_words", "short_words", "caps_words",
]

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = ~K.SPACED
_SYMBOL = ~_LETTER & ~_DIGIT & ~_SPACE


def features(offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text, for a chunk of texts."""
    n = len(offsets) - 1
    w = K.Words(offsets, raw, K.SPACED)
    b = raw[int(offsets[0]) : int(offsets[-1])]
    bounds = w.bounds
    size = np.diff(bounds).astype(float)
    words = w.counts().astype(float)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(words, 1)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)

    def count_words(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[w.first[1:]] - total[w.first[:-1]]).astype(float)

    symbol = _SYMBOL[b]
    pair = np.zeros(len(b), bool)
    pair[1:] = symbol[1:] & symbol[:-1]
    pair[bounds[:-1][size > 0]] = False  # a run does not come over from the text before
    length = w.end - w.start
    h = w.hashes()
    text_of = np.repeat(np.arange(n), w.counts())
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (text_of[1:] == text_of[:-1])
    keyed = K.mix(h ^ (text_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, at, many = np.unique(keyed, return_index=True, return_counts=True)
    distinct = np.bincount(text_of[at], minlength=n).astype(float)
    top = np.zeros(n)
    np.maximum.at(top, text_of[at], many.astype(float))
    first = w.start
    capital = (_UPPER[b[first]] & _UPPER[b[np.minimum(first + 1, max(len(b) - 1, 0))]] & (length > 1)) if len(first) else np.zeros(0, bool)
    letters = count(_LETTER[b])
    out = [
        np.log1p(words), count(~_SPACE[b]) * per_word, count(_UPPER[b]) / np.maximum(letters, 1), count(_DIGIT[b]) * per_byte, count(symbol) * per_byte,
        count(b == 124) * per_word, count(b == 33) * per_word, count(b >= 128) * per_byte, distinct * per_word,
        count_words(same) * per_word, top * per_word, np.log1p(count(b == 10)), count(b == 46) * per_word, count(b == 44) * per_word, count(pair) * per_word,
        count_words(length > 14) * per_word, count_words(length <= 3) * per_word, count_words(capital) * per_word,
    ]
    return np.stack(out, axis=1).astype(np.float32)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Best piecewise constant step on ordered bins with sums g (gradient) and h (Hessian): greedy splits, Newton leaf values."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    for _ in range(leaves - 1):
        best, where = 1e-9, None
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi - lo > 1:
                mid = np.arange(lo + 1, hi)
                score = gain(lo, mid) + gain(mid, hi) - gain(lo, hi)
                i = int(np.argmax(score))
                if score[i] > best:
                    best, where = score[i], int(mid[i])
        if where is None:
            break
        cuts = sorted([*cuts, where])
    out = np.empty(len(g))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + 1.0)
    return out


def _tree_of_pair(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two on a grid: the cut of the first axis that, with a cut of the second on either side, explains most."""
    cg, ch = (np.concatenate([np.zeros((1, v.shape[1])), np.cumsum(v, 0)]) for v in (g, h))
    best, step = -1.0, np.zeros_like(g)
    for at in range(1, max(2, len(g))):
        out, explained = np.empty_like(g), 0.0
        for lo, hi in ((0, at), (at, len(g))):
            if lo < hi:
                gs, hs = cg[hi] - cg[lo], ch[hi] - ch[lo] + 2.0
                out[lo:hi] = leaf = _tree(gs, hs, 2)
                explained += float((leaf * gs).sum())
        if explained > best:
            best, step = explained, out
    return step


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """The model as plain arrays: cut points, one table per feature, pair tables, intercept."""
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return {"base": float(np.log(p / (1 - p))), "cuts": [], "tables": [], "coarse": [], "pairs": []}
    n, k = x.shape
    quantiles = lambda v, b: np.unique(np.quantile(v, np.linspace(0, 1, b + 1)[1:-1]))
    cuts = [quantiles(x[:, j], BINS) for j in range(k)]
    coarse = [quantiles(x[:, j], GRID) for j in range(k)]
    bins = [np.searchsorted(cuts[j], x[:, j], side="right") for j in range(k)]
    grid = [np.searchsorted(coarse[j], x[:, j], side="right") for j in range(k)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    p = y.mean()
    base = float(np.log(p / (1 - p)))
    f = np.full(n, base)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for _ in range(ROUNDS):
        for j in range(k):
            q = sigmoid(f)
            step = RATE * _tree(np.bincount(bins[j], y - q, len(tables[j])), np.bincount(bins[j], q * (1 - q), len(tables[j])), LEAVES)
            tables[j] += step
            f += step[bins[j]]
    q = sigmoid(f)
    ranked = []
    for i in range(k):
        for j in range(i + 1, k):
            cell = grid[i] * (len(coarse[j]) + 1) + grid[j]
            g, h = np.bincount(cell, y - q), np.bincount(cell, q * (1 - q))
            ranked.append((-float((g**2 / (h + 5.0)).sum()), i, j))
    pairs = [[i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))] for _, i, j in sorted(ranked)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in pairs:
            q = sigmoid(f)
            cell = grid[i] * t.shape[1] + grid[j]
            g, h = (np.bincount(cell, v, t.size).reshape(t.shape) for v in (y - q, q * (1 - q)))
            step = _tree_of_pair(g, h)
            step *= RATE
            t += step
            f += step[grid[i], grid[j]]
    return {"base": base, "cuts": cuts, "tables": tables, "coarse": coarse, "pairs": pairs}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    f = np.full(len(x), model["base"])
    for j, t in enumerate(model["tables"]):
        f += t[np.searchsorted(model["cuts"][j], x[:, j], side="right")]
    grid = {}
    for i, j, t in model["pairs"]:
        for c in (i, j):
            if c not in grid:
                grid[c] = np.searchsorted(model["coarse"][c], x[:, c], side="right")
        f += t[grid[i], grid[j]]
    return 1 / (1 + np.exp(-f))


def _featured(df: DataFrame, kept: list[str]) -> DataFrame:
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("features", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = K.buffers(batch.column("text"))
            for lo, hi in K.chunks(offsets):
                x = features(offsets[lo : hi + 1], raw)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in kept), lists], names=[*kept, "features"])

    return df.mapInArrow(run, schema)


def fold(column):
    return F.crc32(column.cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", label: str = "quality", max_sample: int = MAX_SAMPLE) -> dict:
    """A model from the labelled rows outside fold 0."""
    has(labels, id_col, label)
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("double").alias("y")).where("id is not null and y is not null")
    known = known.where(fold(F.col("id")) != 0).groupBy("id").agg(F.avg("y").alias("y"))
    order = F.xxhash64(F.col("id").cast("string"))
    known = known.orderBy(order, "id").limit(max_sample)  # at most max_sample small rows: safe to broadcast
    mine = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(known), "id").select("id", "y", "text")
    rows = _featured(mine, ["id", "y"]).orderBy(order, "id", "features").limit(max_sample).collect()
    x = np.array([r["features"] for r in rows], dtype=np.float32).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([float(r["y"] >= 0.5) for r in rows]))


def scored(docs: DataFrame, model: dict, *, text: str = "text") -> DataFrame:
    """``row`` (all columns but the text), ``text``, ``score``."""
    df = packed(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([df.schema["row"], df.schema["text"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = K.buffers(batch.column("text"))
            parts = [score(shared.value, features(offsets[lo : hi + 1], raw)) for lo, hi in K.chunks(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["row", "text", "score"])

    return df.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **how) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    has(docs, id_col, text)
    model = train(docs, labels, id_col=id_col, text=text, **how)
    small = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    df = scored(small, model).select(F.col("row.id").alias("doc_id"), "score")
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return df.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **how) -> DataFrame:
    """The rows of ``docs`` that reach the threshold, columns unchanged."""
    model = train(docs, labels, id_col=id_col, text=text, **how)
    return unpacked(scored(docs, model, text=text).where(F.col("score") >= threshold), docs.columns, text)


def op9(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
