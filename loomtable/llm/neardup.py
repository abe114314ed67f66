"""Near-duplicate documents by SetSketch registers.

1. One scan makes, per text, the set of its k-word shingles (as 64-bit
   hashes), a 128-bit digest of the sorted set, and ``REGISTERS`` SetSketch
   registers: for register i every shingle draws an exponential variate of
   rate ``RATE``; the register keeps ``floor(1 - log_b(min))``, truncated to
   [0, Q + 1].  Maxima of registers merge, and equal registers are likelier
   the more alike two sets are.
2. Equal digests are equal sets: they form one class at once, so exact copies
   cost nothing further and are never expanded into pairs.
3. Registers are banded ``BANDS`` x ``ROWS``; classes sharing a band meet in a
   bucket.  With 32 bands of 5, a pair at the threshold (0.85) meets with
   probability 1 - 7e-9 (an equal register has a probability of at least the
   similarity).
4. In each bucket every member is paired with the bucket's leader (the
   smallest by a hash that differs by bucket) only.  The joint maximum-likelihood estimate from the two sketches drops
   pairs far (``MARGIN`` standard errors) below the threshold; the rest are
   verified on the full sets.
5. Connected components of the verified links.  Buckets whose members are all
   in one component are done: further links inside change nothing, so a tight
   group of n copies costs n pairs, not n^2.  The members of the other buckets
   are dealt into blocks of bounded size; each pair of blocks is compared
   exactly, all sets of one against all of the other as one matrix product,
   and only links that join components leave the task.  Pairs of blocks are
   dealt by (bucket, second block), so a bucket of n blocks is n keys of at most
   n pairs each.  No link that could join two components is left untested, and
   no list of document pairs is made.

Components are found by distributed label contraction over written tables;
links, labels and sketches never come to the driver.  Joins on a key that many
rows share (a bucket's leader, a component, a digest) are salted.  A text longer
than ``LONG`` bytes is sketched in pieces whose registers are merged.
Intermediate tables are deleted as soon as nothing reads them.

Defined results: null and empty texts, and texts without words, have an empty
set, are linked with nothing and are their own component.  Rows with equal
text share a component however often they repeat; repeated ids are separate
rows.  A null id stays null, and a component's id is its smallest non-null id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtable.llm import _kernel as K
from loomtable.llm._shared import batches_of, dropped, has, packed, salted_join, small_batches, table, unpacked, written
from loomtable.operators import cluster

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
BASE, RATE, Q = 1.001, 20.0, (1 << 16) - 2
MARGIN = 5.0
#: Members, and shingles, of a block: what one task holds twice of a bucket that is compared in full.
BLOCK, BLOCK_SHINGLES = 128, 60_000
#: A list of wanted rows is sent to all executors up to this length (about 100 bytes each in memory); beyond, a shuffle join does the same.
BROADCAST_IDS = 500_000
#: Leaders of buckets with more members than this are joined by salt.
HOT = 1000
SALTS = 16
#: Bytes of a text that is sketched in pieces, and shingles of one piece's registers.
LONG, PIECE = 4 * K.CHUNK_BYTES, 1 << 20

_FACTORS = (K.mix(np.arange(1000, 1000 + REGISTERS, dtype=np.uint64)) | np.uint64(1)).astype(np.uint64)
SKETCH = "id bigint, mark bigint, n_shingles bigint, digest binary, bands array<bigint>, registers binary"


def shingles(w: K.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of some texts and the bounds of each text's share; a text of fewer than k words, but not none, has one shingle of all its words."""
    h = w.hashes()
    grams, at = w.grams(h, k)
    counts = w.counts()
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        grams = np.concatenate([grams, np.array([w.whole(h, int(d)) for d in short], dtype=np.uint64)])
        at = np.concatenate([at, w.first[short]])
        order = np.argsort(at, kind="stable")
        grams, at = grams[order], at[order]
    return grams, np.searchsorted(at, w.first)


def minima(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Smallest 64-bit value per non-empty text and register."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.empty((len(full), REGISTERS), dtype=np.uint64)
    if len(full):
        starts = bounds[:-1][full]
        line = np.empty_like(grams)
        for i in range(REGISTERS):
            np.multiply(grams, _FACTORS[i], out=line)
            out[:, i] = np.minimum.reduceat(line, starts)
    return out


def long_shingles(raw: np.ndarray, letters: np.ndarray, k: int, size: int = K.CHUNK_BYTES) -> np.ndarray:
    """Shingle hashes of one very long text: words are hashed piece by piece (cut where no word stands), so the temporary arrays stay small."""
    h, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + size)
        while end < len(raw) and letters[K.LOWER[raw[end]]]:
            step = np.flatnonzero(~letters[K.LOWER[raw[end : end + 4096]]])
            end = end + int(step[0]) if len(step) else min(len(raw), end + 4096)
        h.append(K.Words(np.array([at, end]), raw, letters).hashes())
        at = end
    return K.grams_of(np.concatenate(h) if h else np.zeros(0, np.uint64), k)


def merged_minima(grams: np.ndarray, size: int = PIECE) -> np.ndarray:
    """Minima of one text's shingles: those of its pieces, merged."""
    parts = [minima(grams[lo : lo + size], np.array([0, len(grams[lo : lo + size])])) for lo in range(0, len(grams), size)]
    return np.minimum.reduce(parts) if parts else np.empty((0, REGISTERS), dtype=np.uint64)


def registers(low: np.ndarray) -> np.ndarray:
    """Minima of uniform values to truncated, exponentially spaced registers."""
    u = (low.astype(np.float64) + 0.5) * 2.0**-64
    h = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(h) / math.log(BASE)), 0, Q + 1).astype(np.uint16)


def bands(regs: np.ndarray) -> np.ndarray:
    r = regs.astype(np.uint64).reshape(len(regs), BANDS, ROWS)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), r.shape[:2]).copy()
    for j in range(ROWS):
        acc = K.mix(acc * np.uint64(0xD6E8FEB86659FD93) + r[:, :, j] + np.uint64(1))
    return acc.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs from how many registers are larger, smaller and equal, given the set sizes (rows: pairs)."""
    up = (a > b).sum(axis=1)[:, None].astype(float)
    down = (a < b).sum(axis=1)[:, None].astype(float)
    same = REGISTERS - up - down
    u = (na / (na + nb))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 201)[None, :]
    j = grid * np.minimum(u / v, v / u)
    lb = math.log(BASE)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / lb
    pu, pd = p(u - v * j), p(v - u * j)
    with np.errstate(divide="ignore", invalid="ignore"):
        ll = np.where(up > 0, up * np.log(pu), 0) + np.where(down > 0, down * np.log(pd), 0) + np.where(same > 0, same * np.log(np.maximum(1 - pu - pd, 1e-300)), 0)
    best = np.argmax(ll, axis=1)
    return j[np.arange(len(j)), best]


def sketch(docs: DataFrame, id_col: str, text: str, k: int, split: str) -> DataFrame:
    """One row per row of ``docs``: id, set size, digest of the set, band keys, registers (the last three null for empty sets)."""
    letters = K.SPACED if split == "space" else K.ALNUM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = K.buffers(batch.column("text"))
            for lo, hi in K.chunks(offsets):
                grams, bounds = _grams(offsets[lo : hi + 1], raw, letters, k)
                full = np.flatnonzero(np.diff(bounds) > 0)
                regs = registers(merged_minima(grams) if hi - lo == 1 else minima(grams, bounds))
                sizes, digests, sigs = [0] * (hi - lo), [None] * (hi - lo), [None] * (hi - lo)
                for i, d in enumerate(full.tolist()):
                    s = np.unique(grams[bounds[d] : bounds[d + 1]])
                    sizes[d], digests[d], sigs[d] = len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), regs[i].tobytes()
                lens = np.zeros(hi - lo + 1, dtype=np.int32)
                lens[full + 1] = BANDS
                keys = pa.ListArray.from_arrays(pa.array(np.cumsum(lens, dtype=np.int32)), pa.array(bands(regs).reshape(-1) if len(full) else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), batch.column("mark").slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), keys, pa.array(sigs, pa.binary())],
                    names=["id", "mark", "n_shingles", "digest", "bands", "registers"],
                )

    return _read(docs, id_col, text).mapInArrow(run, SKETCH)


def _read(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, mark (a hash of the text: with it, rows of one id are told apart) and text."""
    t = F.col(f"`{text}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.xxhash64(t).alias("mark"), t.alias("text"))


def _grams(offsets: np.ndarray, raw: np.ndarray, letters: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(offsets) == 2 and offsets[1] - offsets[0] > LONG:
        grams = long_shingles(raw[int(offsets[0]) : int(offsets[1])], letters, k)
        return grams, np.array([0, len(grams)])
    return shingles(K.Words(offsets, raw, letters), k)


def _with_ends(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Pairs (a: a leader, b, hot) with ``values`` (node, x) of both ends as xa and xb; a hot leader's pairs are dealt by salt."""
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("b"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    leaders = pairs.groupBy("a").agg(F.max("hot").alias("hot")).join(values.select(F.col("node").alias("a"), F.col("x").alias("xa")), "a")
    leaders = leaders.select("a", "xa", F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), SALTS - 1).otherwise(0))).alias("salt"))
    return pairs.join(values.select(F.col("node").alias("b"), F.col("x").alias("xb")), "b").withColumn("salt", salt).join(leaders, ["a", "salt"]).drop("salt")


def _likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, hot) whose sketches don't rule the threshold out."""
    both = _with_ends(pairs, classes.select("node", F.struct(F.col("n_shingles").alias("n"), F.col("registers").alias("r")).alias("x")))
    both = both.select("a", "b", "hot", F.col("xa.n").alias("na"), F.col("xb.n").alias("nb"), F.col("xa.r").alias("ra"), F.col("xb.r").alias("rb"))
    # Set sizes alone bound the similarity from above.
    both = both.where(F.least("na", "nb") >= F.greatest("na", "nb") * threshold)
    low = threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / REGISTERS)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
                na, nb = (part.column(c).to_numpy().astype(float) for c in ("na", "nb"))
                keep = pa.array(estimate(a, b, na, nb) >= low)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), part.column("hot")], names=["a", "b", "hot"]).filter(keep)

    return both.mapInArrow(run, "a bigint, b bigint, hot boolean")


def _sets(docs: DataFrame, wanted: DataFrame, n_wanted: int, id_col: str, text: str, k: int, split: str) -> DataFrame:
    """(node, set) for the wanted (node, id, mark, digest): texts are read again and shingled, others are filtered out by id and mark before they move."""
    letters = K.SPACED if split == "space" else K.ALNUM

    def run(batches):
        for batch in batches:
            offsets, raw = K.buffers(batch.column("text"))
            for lo, hi in K.chunks(offsets):
                grams, bounds = _grams(offsets[lo : hi + 1], raw, letters, k)
                sets = [np.unique(grams[bounds[d] : bounds[d + 1]]) for d in range(hi - lo)]
                want = batch.column("digest").slice(lo, hi - lo).to_pylist()
                good = [i for i, s in enumerate(sets) if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == want[i]]
                flat = [sets[i].view(np.int64) for i in good]
                bound = np.cumsum([0, *map(len, flat)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(lo, hi - lo).take(pa.array(good, pa.int64())), pa.ListArray.from_arrays(pa.array(bound), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))],
                    names=["node", "set"],
                )

    d = _read(docs, id_col, text)
    small = wanted.select(F.col("id").alias("id_"), F.col("mark").alias("mark_"), "node", "digest")
    small = F.broadcast(small) if n_wanted <= BROADCAST_IDS else small
    got = d.join(small, (d["mark"] == small["mark_"]) & d["id"].eqNullSafe(small["id_"])).select("node", "digest", "text").mapInArrow(run, "node bigint, set array<bigint>")
    return got.dropDuplicates(["node"])


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, name: str, *, id_col: str, text: str, k: int, split: str, percent: int) -> DataFrame:
    """Pairs with the sizes of both sets and their intersection, and whether they are linked: exact, on the full sets."""
    pairs = written(pairs, f"{name}-pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = written(ends.join(classes.select("node", "id", "mark", "digest"), "node"), f"{name}-wanted")
    sets = written(_sets(docs, wanted, wanted.count(), id_col, text, k, split), f"{name}-sets")
    both = _with_ends(pairs, sets.select("node", F.col("set").alias("x")))
    both = both.withColumn("shared", F.size(F.array_intersect("xa", "xb")).cast("bigint")).withColumn("all", F.size("xa") + F.size("xb") - F.col("shared"))
    out = written(both.select("a", "b", "shared", "all", (F.col("shared") * 100 >= F.col("all") * percent).alias("linked")), f"{name}-links")
    dropped(pairs, wanted, sets)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of the links (a, b): comp is the smallest node reachable."""
    return cluster.components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select("node", F.col("component").alias("comp"))


def _joins(percent: int):
    """Over pairs of member blocks: links between components, by exact intersections of all their sets in one matrix product; of these only a spanning forest is returned."""

    def run(batches):
        for batch in batches:
            out: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                sides = []
                for name in ("ma", "mb"):
                    m = batch.column(name)[i].values
                    lists = m.field("set")
                    off = lists.offsets.to_numpy()
                    sides.append((m.field("comp").to_numpy(), np.diff(off), lists.values.to_numpy()[off[0] : off[-1]]))
                (ca, na, va), (cb, nb, vb) = sides
                shared = np.intersect1d(va, vb)
                inter = np.zeros((len(ca), len(cb)), dtype=np.float32)
                for lo in range(0, len(shared), 4096):
                    words = shared[lo : lo + 4096]
                    mats = []
                    for n, v in ((na, va), (nb, vb)):
                        at = np.minimum(np.searchsorted(words, v), len(words) - 1)
                        hit = words[at] == v
                        mat = np.zeros((len(n), len(words)), dtype=np.float32)
                        mat[np.repeat(np.arange(len(n)), n)[hit], at[hit]] = 1
                        mats.append(mat)
                    inter += mats[0] @ mats[1].T
                both = inter.astype(np.int64)
                linked = (100 * both >= percent * (na[:, None] + nb[None, :] - both)) & (ca[:, None] != cb[None, :])
                up: dict[int, int] = {}

                def root(c, up=up):
                    while up.setdefault(c, c) != c:
                        up[c] = c = up[up[c]]
                    return c

                for p, q in zip(*np.nonzero(linked), strict=True):
                    a, b = root(int(ca[p])), root(int(cb[q]))
                    if a != b:
                        up[max(a, b)] = min(a, b)
                        out.append((int(ca[p]), int(cb[q])))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([q for _, q in out], pa.int64())], names=["a", "b"])

    return run


def link_classes(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, split: str = "alnum") -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows have id, n_shingles, digest; classes have node, digest, id (smallest), n_rows and, where linked with another class, comp (a node; else null)."""
    how = {"id_col": id_col, "text": text, "k": k, "split": split, "percent": percent}
    small_batches(docs.sparkSession)
    rows = written(sketch(docs, id_col, text, k, split), "sketch")
    classes = rows.where("n_shingles > 0").groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull(), "id", "mark")).alias("best"), F.count("*").alias("n_rows"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("registers").alias("registers")
    )
    classes = classes.select("digest", F.col("best.id").alias("id"), F.col("best.mark").alias("mark"), "n_rows", "n_shingles", "bands", "registers", F.monotonically_increasing_id().alias("node"))
    classes = written(classes, "classes")
    member = classes.select("node", F.explode("bands").alias("band"))
    # Each bucket has a leader of its own, so the members of a large group meet many different leaders.
    shared = member.groupBy("band").agg(F.min_by("node", F.xxhash64("band", "node")).alias("first"), F.count("*").alias("n")).where("n > 1")
    buckets = written(salted_join(member, shared, ["band"], ["node"]), "buckets")
    star = buckets.where("node <> first").groupBy(F.col("first").alias("a"), F.col("node").alias("b")).agg((F.max("n") > HOT).alias("hot"))
    stars = _verified(docs, _likely(star, classes, percent / 100), classes, "star", **how)
    comp = written(components(stars.where("linked").select("a", "b")), "first-components")
    dropped(stars)
    # Buckets of three or more that still hold several components: pairs that have not met a leader.
    at = buckets.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(classes.select("node", "id", "mark", "digest", F.col("n_shingles").alias("size")), "node")
    at = at.select("node", "band", "comp", "id", "mark", "digest", "size")
    open_ = (
        at.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members"), F.sum("size").alias("total")).where("lo < hi and members > 2")
        .select("band", F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    )
    rest = written(salted_join(at, open_, ["band"], ["node"]), "open")
    dropped(buckets)
    wanted = written(rest.select("node", "id", "mark", "digest").distinct(), "open-wanted")
    sets = written(_sets(docs, wanted, wanted.count(), id_col, text, k, split), "open-sets")
    block = (
        rest.join(sets, "node").groupBy("band", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
        .agg(F.collect_list(F.struct("node", "comp", "set")).alias("members"))
    )
    block = written(block, "open-blocks")
    first = block.select("band", F.col("members").alias("ma"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("block"))
    met = first.join(block.select("band", "block", F.col("members").alias("mb")), ["band", "block"]).select("ma", "mb")
    with batches_of(docs.sparkSession, 16):
        extra = written(met.mapInArrow(_joins(percent), "a bigint, b bigint").distinct(), "open-links")
    dropped(rest, wanted, sets, block)
    if extra.isEmpty():
        final = comp
    else:
        final = written(components(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(extra)), "components")
        dropped(comp)
    dropped(extra)
    done = written(classes.join(final, "node", "left").select("node", "digest", "id", "n_rows", "comp"), "linked")
    dropped(classes, final)
    return rows, done


def groups(docs: DataFrame, **how) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    has(docs, how.get("id_col", "doc_id"), how.get("text", "text"))
    rows, classes = link_classes(docs, **how)
    linked = classes.where("comp IS NOT NULL").select("digest", "id", "comp", "node")
    least = linked.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = salted_join(linked, least, ["comp"], ["node"]).select("digest", "component_id")
    # A class of one row that is linked with none needs no look-up: its component is its own id.
    named = named.unionByName(classes.where("comp IS NULL AND n_rows > 1").select("digest", F.col("id").alias("component_id")))
    out = salted_join(rows.select("id", "n_shingles", "digest", F.monotonically_increasing_id().alias("at")), named, ["digest"], ["at"], "left")
    comp = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id, of repeated ids the first; columns unchanged.

    Rows are matched by a row number given before anything else is done, on a
    written table, so repeated and null ids lose nothing but their copies.
    Rows with an empty set are all kept.
    """
    has(docs, id_col, text)
    # The number is given on a table that is written once, so it means the same row in every later read.
    numbered = written(packed(docs, text).withColumn("number", F.monotonically_increasing_id()), "numbered")
    key = F.col("row").getField(id_col).cast("bigint").alias("key")
    rows, classes = link_classes(numbered, id_col="number", text="text", **how)
    many = classes.where("comp IS NOT NULL OR n_rows > 1").select("digest", F.coalesce("comp", "node").alias("comp"))
    named = salted_join(rows.select("id", "digest"), many, ["digest"], ["id"]).select("id", "comp").join(numbered.select(F.col("number").alias("id"), key), "id")
    named = written(named, "named")
    # min ignores nothing here: a null key sorts last.
    first = named.groupBy("comp").agg(F.min(F.struct(F.col("key").isNull(), "key", "id")).alias("best")).select(F.col("best.id").alias("first"), "comp")
    gone = written(salted_join(named, first, ["comp"], ["id"]).where("id <> first").select(F.col("id").alias("number")), "gone")
    dropped(named, rows, classes)
    small = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return unpacked(numbered.join(small, "number", "left_anti"), docs.columns, text)


def op7(spark, sf_dir):
    return groups(table(spark, sf_dir, "documents"), k=3, percent=85, split="space")
