"""Benchmark decontamination.

A hash set of all normalised benchmark windows goes to every task; each task
scans the token windows of its texts against it, verifies every hit by the
words themselves, and marks the words inside.  One pass, no shuffle.  Equal
windows are one entry with the list of their items, so a word that repeats a
thousand times, or a window that many items share, is compared once per place.

The set is broadcast only up to ``max_words`` benchmark words (about 150 bytes
each).  A larger benchmark is dealt into blocks of that size, and the texts
pass the blocks one after another, with a written table between them, so
memory stays bounded at any benchmark size and nothing is left out.

Defined results: a null or empty text has no words and no hits.  Rows are
never joined or regrouped, so repeated rows and repeated ids keep their
number; a repeated benchmark item counts once.  Null benchmark texts have no
windows; a null item_id is named ``null``.  An empty benchmark or table gives
no hits or no rows.  Other columns, whatever their names, pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtable.llm import _kernel as K
from loomtable.llm._shared import has, packed, table, unpacked, written

WINDOW = 8
MAX_WORDS = 1_000_000


def window_set(items: list[tuple[str, str]], window: int = WINDOW) -> dict:
    """Distinct windows of one block of the benchmark, by length: sorted hashes, a place of each window's words, and the items that hold it."""
    w = K.words_of([t for _, t in items])
    h = w.hashes()
    grams, at = w.grams(h, window)
    counts = w.counts()
    parts = [(window, grams, at, np.searchsorted(w.first, at, side="right") - 1)]
    parts += [(int(counts[d]), np.array([w.whole(h, d)], dtype=np.uint64), np.array([w.first[d]]), np.array([d])) for d in np.flatnonzero((counts > 0) & (counts < window))]
    by: dict[int, dict[bytes, tuple[int, int, set]]] = {}
    for size, hashes, firsts, texts in parts:
        seen = by.setdefault(size, {})
        for g, first, text in zip(hashes.tolist(), firsts.tolist(), texts.tolist(), strict=True):
            seen.setdefault(w.text(first, first + size), (g, first, set()))[2].add(items[text][0])
    windows = {}
    for size, seen in by.items():
        rows = sorted(seen.values(), key=lambda r: r[:2])
        hashes = np.array([r[0] for r in rows], dtype=np.uint64)
        # A map of 2^20 bits of low hash bits turns most windows away before the search.
        bits = np.zeros(1 << 20, dtype=bool)
        bits[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        windows[size] = (hashes, np.array([r[1] for r in rows], dtype=np.int64), [sorted(r[2]) for r in rows], np.packbits(bits))
    return {"windows": windows, "bytes": w.bytes, "start": w.start, "end": w.end}


def _same(w: K.Words, at: np.ndarray, known: dict, first: np.ndarray, size: int, step: int = 1 << 16) -> np.ndarray:
    """Whether ``size`` words from each place ``at`` are, byte by byte, those from the benchmark's place ``first``."""
    out = np.zeros(len(at), dtype=bool)
    each = np.arange(size)
    for lo in range(0, len(at), step):
        a, b = at[lo : lo + step, None] + each, first[lo : lo + step, None] + each
        length = w.end[a] - w.start[a]
        fits = np.flatnonzero((length == known["end"][b] - known["start"][b]).all(axis=1))
        if not len(fits):
            continue
        n = length[fits].reshape(-1)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        same = w.bytes[np.repeat(w.start[a[fits]].reshape(-1), n) + inner] == known["bytes"][np.repeat(known["start"][b[fits]].reshape(-1), n) + inner]
        total = length[fits].sum(axis=1)
        out[lo + fits] = np.logical_and.reduceat(same, np.cumsum(total) - total)
    return out


def hits(w: K.Words, known: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per window length the verified words where a window stands, and the window's number."""
    h = w.hashes()
    for size, (hashes, firsts, _, bits) in known["windows"].items():
        grams, at = w.grams(h, size)
        if not len(hashes) or not len(grams):
            continue
        low = (grams & np.uint64((1 << 20) - 1)).astype(np.int64)
        maybe = np.flatnonzero(bits[low >> 3] & (128 >> (low & 7)).astype(np.uint8))
        lo, hi = np.searchsorted(hashes, grams[maybe], "left"), np.searchsorted(hashes, grams[maybe], "right")
        # Windows are distinct, so more than one has a hash only where hashes collide.
        n = hi - lo
        place = np.repeat(at[maybe], n)
        window = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        good = _same(w, place, known, firsts[window], size)
        yield size, place[good], window[good]


def _merged(marks: list[tuple[np.ndarray, np.ndarray]], first: int, last: int) -> list[int]:
    """Flat [first, end) ranges, counted from ``first``, of the words under any of the marks (starts, ends)."""
    step = np.zeros(last - first + 1, dtype=np.int64)
    for starts, ends in marks:
        np.add.at(step, starts - first, 1)
        np.add.at(step, ends - first, -1)
    inside = np.concatenate([[False], np.cumsum(step) > 0])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges.tolist()


def _scan(batches: Iterator[pa.RecordBatch], shared, schema: pa.Schema, clean: bool) -> Iterator[pa.RecordBatch]:
    known = shared.value
    for batch in batches:
        offsets, raw = K.buffers(batch.column("text"))
        n_words: list[np.ndarray] = []
        spans: list[list[int]] = []
        items: list[list[str]] = []
        texts: list[str] = []
        old_spans = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [None] * batch.num_rows
        old_items = batch.column("items").to_pylist() if "items" in batch.schema.names else [None] * batch.num_rows
        for lo, hi in K.chunks(offsets):
            w = K.Words(offsets[lo : hi + 1], raw)
            n_words.append(w.counts())
            marks: dict[int, list] = {}
            names: dict[int, set] = {}
            for size, place, window in hits(w, known):
                text_of = np.searchsorted(w.first, place, side="right") - 1
                for d in np.unique(text_of).tolist():
                    mine = slice(*np.searchsorted(text_of, [d, d + 1]))
                    marks.setdefault(d, []).append((place[mine], place[mine] + size))
                    names.setdefault(d, set()).update(x for k in np.unique(window[mine]).tolist() for x in known["windows"][size][2][k])
            for d in range(hi - lo):
                first, last = int(w.first[d]), int(w.first[d + 1])
                if old_spans[lo + d]:
                    old = np.array(old_spans[lo + d], dtype=np.int64) + first
                    marks.setdefault(d, []).append((old[::2], old[1::2]))
                flat = _merged(marks[d], first, last) if d in marks else []
                merged = list(zip(flat[::2], flat[1::2], strict=True))
                spans.append(flat)
                items.append(sorted(names.get(d, set()) | set(old_items[lo + d] or ())))
                if clean and merged:
                    body = raw[int(offsets[lo + d]) : int(offsets[lo + d + 1])].tobytes()
                    base = int(w.bounds[d])
                    left, kept = 0, []
                    for s, e in merged:
                        kept.append(body[left : int(w.start[first + s]) - base])
                        left = int(w.end[first + e - 1]) - base
                    kept.append(body[left:])
                    texts.append(b"".join(kept).decode("utf-8"))
                elif clean:
                    texts.append(None)
        text = batch.column("text")
        out = {
            "row": batch.column("row"),
            "text": text,
            "n_words": pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.int64())),
            "items": pa.array(items, pa.list_(pa.string())),
        }
        if clean:
            out["cleaned"] = pa.array(texts, pa.string())
        columns = []
        for f in schema:
            c = out[f.name]
            columns.append(c.cast(f.type) if c.type != f.type else c)
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)


def scan(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS, clean: bool = False) -> DataFrame:
    """``row`` (all columns but the text), ``text``, ``n_words``, ``spans`` (flat [first, end) word ranges), ``items`` and, if asked, ``cleaned`` (the text without its hit spans; null where nothing was hit)."""
    has(benchmark, "item_id", "text")
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.length("text") / 2 + 1).alias("n")).first()["n"] or 0
    n_blocks = max(1, int(-(-size // max_words)))
    df = packed(docs, text)
    for k in range(n_blocks):
        mine = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == k)
        known = spark.sparkContext.broadcast(window_set(sorted((r["id"], r["text"]) for r in mine.toLocalIterator()), window))
        fields = [
            df.schema["row"],
            df.schema["text"],
            T.StructField("n_words", T.LongType()),
            T.StructField("spans", T.ArrayType(T.LongType())),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
        last = k == n_blocks - 1
        if last and clean:
            fields.append(T.StructField("cleaned", T.StringType()))
        df = _pass(df, known, T.StructType(fields), clean and last)
        if not last:
            df = written(df, "decontam")
    return df


def _pass(df: DataFrame, known, schema: T.StructType, clean: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            names = [f.name for f in schema]
            fields = []
            for name in names:
                if name in ("row", "text"):
                    fields.append(batch.schema.field(name))
                else:
                    fields.append({"n_words": pa.field("n_words", pa.int64()), "spans": pa.field("spans", pa.list_(pa.int64())), "items": pa.field("items", pa.list_(pa.string())), "cleaned": pa.field("cleaned", pa.string())}[name])
            yield from _scan(iter([batch]), known, pa.schema(fields), clean)

    return df.mapInArrow(run, schema)


def n_hit():
    """Words inside the merged spans."""
    spans = F.col("spans")
    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(spans) / 2 - 1, F.lit(0)).cast("int")), F.lit(0).cast("bigint"), lambda s, i: s + F.coalesce(F.get(spans, i * 2 + 1) - F.get(spans, i * 2), F.lit(0).cast("bigint")))


def report(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, least_items: int = 2, max_words: int = MAX_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    has(docs, id_col, text)
    df = scan(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")), benchmark, window=window, max_words=max_words)
    n_items = F.size("items").cast("bigint")
    return df.select(
        F.col("row.id").alias("doc_id"), "n_words", n_hit().alias("n_hit"), n_items.alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_items >= least_items).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", window: int = WINDOW, mode: str = "documents", max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` without contamination, columns unchanged.  ``mode``: ``documents`` drops every row with a verified hit; ``spans`` cuts the hit words and leaves the rest."""
    df = scan(docs, benchmark, text=text, window=window, max_words=max_words, clean=mode == "spans")
    if mode == "documents":
        return unpacked(df.where(F.size("items") == 0), docs.columns, text)
    if mode == "spans":
        return unpacked(df.withColumn("text", F.coalesce("cleaned", "text")), docs.columns, text)
    raise ValueError(f"mode {mode!r}: documents or spans")


def op4(spark, sf_dir):
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
