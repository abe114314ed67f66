"""URL filter: a blocked Bloom filter, then an exact hash join.

Listed URLs are rules (host, path, verdict): a rule fits its host and all
subdomains if the path starts with the rule's; the longest rule wins.  For a
URL every (host suffix, path prefix of a listed length) is a possible key.  A
blocked Bloom filter of the listed hosts and URLs (each key sets one bit in
each of the eight 64-bit words of one block) is tested in the row itself: first
the host suffix, so URLs of hosts that are not listed end there, then its path
prefixes.  Only keys that pass are rows of the exact join on host and path,
which removes false positives; URLs without such a key are never shuffled.

The filter is a packed array of ``BITS_PER_KEY`` bits a key, sent to all
executors; from ``MAX_FILTER`` bytes on it stays at that size, so it passes
more false positives, which the join removes: results never depend on it.
Rules are broadcast to the join only up to ``BROADCAST_RULES`` (counted first:
under 100 MB); beyond, the join is a shuffle join of the keys that passed, salted,
so a host that holds a third of all URLs is spread out.

Defined results: a null URL or one without ``://`` has an empty host and path;
no rule fits an empty host.  Without a fitting rule the verdict is the
method's: ``allow``, as the URL is in no list.  A rule listed with both
verdicts blocks.  Repeated URLs and ids are separate rows.  Null rules are left
out; with no rules every verdict is the method's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtable.llm._shared import ascii_lower, has, salted_join, table, written

BITS_PER_KEY, BLOCK_BITS = 16, 512
MAX_FILTER = 32 << 20
BROADCAST_RULES = 500_000
SALTS = 16


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.when(url.contains("://"), ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def canonical(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL to be listed, in canonical form: without user, default port and the root's dot; unreserved characters without percent escapes; an empty path is ``/``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^.*@", ""), r"\.?(:(80|443)?)?$", "")
    plain = path_of(url)
    for c in "-._~0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
        plain = F.regexp_replace(plain, f"(?i)%{ord(c):02x}", c)
    return host, F.when((plain == "") & (host != ""), "/").otherwise(plain)


def blocks_of(keys: DataFrame, n_blocks: int) -> DataFrame:
    """block, w0..w7 from keys (key): partial ORs, so a few numbers per block are shuffled."""
    h, g = F.xxhash64("key"), F.xxhash64(F.concat("key", F.lit("\0")))
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(g, 6 * i).bitwiseAND(63).cast("int")).alias(f"w{i}") for i in range(8)]
    marked = keys.select(F.pmod(h, F.lit(n_blocks)).alias("block"), *bits)
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])


def packed_filter(keys: DataFrame, n_keys: int, max_bytes: int = MAX_FILTER) -> bytes:
    """The filter's 64-bit words in order: at most ``max_bytes``."""
    n_blocks = max(1, min(-(-n_keys * BITS_PER_KEY // BLOCK_BITS), max_bytes * 8 // BLOCK_BITS))
    words = np.zeros((n_blocks, 8), dtype=np.int64)
    rows = blocks_of(keys, n_blocks).toArrow()
    if rows.num_rows:
        words[rows.column("block").to_numpy()] = np.stack([rows.column(f"w{i}").to_numpy() for i in range(8)], axis=1)
    return words.tobytes()


def passes(words: memoryview, key: str) -> bool:
    """Whether the filter may hold the key.  The hash is the one of Spark's ``xxhash64``."""
    raw = key.encode()
    h, g = xxhash.xxh64_intdigest(raw, 42), xxhash.xxh64_intdigest(raw + b"\0", 42)
    at = ((h - (1 << 64) if h >> 63 else h) % (len(words) // 8)) * 8
    return all(words[at + i] >> ((g >> 6 * i) & 63) & 1 for i in range(8))


def _suffixes(host: str, most: int) -> Iterator[str]:
    """The host and the hosts it is below, of at most ``most`` characters."""
    at = 0
    while at >= 0:
        if 0 < len(host) - at <= most:
            yield host[at:]
        at = host.find(".", at) + 1 or -1


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES, max_filter: int = MAX_FILTER) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict."""
    has(pages, id_col, url)
    has(rules, "host", "path", "verdict")
    spark = pages.sparkSession
    rules = rules.where("host IS NOT NULL AND verdict IS NOT NULL").select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.where("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("ruling"))
    n_rules, longest, sizes = rules.agg(F.count("*"), F.max(F.length("host")), F.collect_set(F.length("path"))).first()  # path lengths: at most a few thousand numbers
    # A listed host is a key of its own, marked by a line break, which no host of a rule's URL can begin with.
    keys = rules.select(F.concat("host", "path").alias("key")).union(rules.select(F.concat(F.lit("\n"), "host").alias("key")))
    shared = spark.sparkContext.broadcast((packed_filter(keys, 2 * n_rules, max_filter), longest or 0, sorted(sizes)))
    u = F.col(f"`{url}`").cast("string")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.coalesce(host_of(u), F.lit("")).alias("host"), F.coalesce(path_of(u), F.lit("")).alias("path"))
    key = T.StructType([T.StructField("suffix", T.StringType()), T.StructField("head", T.StringType())])
    schema = T.StructType([*rows.schema.fields, T.StructField("possible", T.ArrayType(key))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, most, lengths = shared.value
        words = memoryview(raw).cast("Q")
        out = pa.list_(pa.struct([("suffix", pa.string()), ("head", pa.string())]))
        for batch in batches:
            found = []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                hosts = [s for s in _suffixes(host, most) if passes(words, "\n" + s)]
                found.append([{"suffix": s, "head": path[:n]} for s in hosts for n in lengths if n <= len(path) and passes(words, s + path[:n])])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, out)], names=schema.names)

    # Written once: the numbers mean the same rows in both branches below.
    seen = written(rows.mapInArrow(run, schema).withColumn("number", F.monotonically_increasing_id()), "urls")
    none = seen.where("size(possible) = 0").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    passed = seen.where("size(possible) > 0").select("number", "page_id", "host", "path", F.explode("possible").alias("key")).select("number", "page_id", "host", "path", "key.suffix", "key.head")
    exact = rules.select(F.col("host").alias("suffix"), F.col("path").alias("head"), "ruling")
    if n_rules <= broadcast_rules:
        hit = passed.join(F.broadcast(exact), ["suffix", "head"], "left")
    else:
        hit = salted_join(passed, exact, ["suffix", "head"], ["number"], "left", SALTS)
    size = F.when(F.col("ruling").isNotNull(), F.struct(F.length("suffix") + F.length("head"), F.length("suffix"), F.concat("suffix", "head").alias("rule"), F.col("ruling")))
    best = hit.groupBy("number").agg(F.max(F.struct("page_id", "host", "path")).alias("page"), F.max(size).alias("best"))
    return none.unionByName(best.select("page.page_id", "page.host", "page.path", F.col("best.rule").alias("rule"), F.coalesce("best.ruling", F.lit(default)).alias("verdict")))


#: The list of the query: (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op3(spark, sf_dir):
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, verdict)")
    return judge(table(spark, sf_dir, "pages"), rules)
