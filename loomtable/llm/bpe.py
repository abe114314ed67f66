"""Byte-pair encoding and decoding from a public vocabulary file.

A word's symbols stand in a doubly linked list; a priority queue holds every
neighbouring pair that has a merge rank.  The best entry is taken, skipped if
one of its symbols has changed since (a stale entry), and else merged; the two
new neighbouring pairs are queued.  Decoding concatenates the vocabulary
strings of the ids, as the library does for a file without a decoder: joined
by single spaces.

Words repeat, so each task keeps the ids of words it has met, up to
``CACHE_WORDS``; then it starts afresh.  Memory is bounded and the result does
not depend on it.  Rows pass one by one in Arrow batches, without a shuffle.

Defined results: a null text is read as empty; an empty text has no ids and
decodes to the empty string.  Repeated rows keep their number, all other
columns pass through.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtable.llm._shared import has, packed, table

CACHE_WORDS = 200_000
VOCABULARY = "word_bpe_49k.json"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where printable, else the next letter from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Tokenizer:
    """Reads a tokenizers JSON file of a BPE model with a word-end suffix, the normalizers NFC, Replace and Lowercase, and a Split before the merges."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("unk_token"):
            raise ValueError("only plain BPE vocabularies are read")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = dict(model["vocab"])
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {m: (r, m[0] + m[1]) for r, m in enumerate(merges)}
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", ())}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        self.letters = byte_letters()
        self.steps = []
        normal = spec.get("normalizer")
        for step in normal["normalizers"] if normal and normal["type"] == "Sequence" else [normal] if normal else []:
            if step["type"] == "NFC":
                self.steps.append(lambda t: t if t.isascii() else unicodedata.normalize("NFC", t))
            elif step["type"] == "Lowercase":
                self.steps.append(_lower)
            elif step["type"] == "Replace":
                rx = regex.compile(step["pattern"]["Regex"]) if "Regex" in step["pattern"] else regex.compile(regex.escape(step["pattern"]["String"]))
                self.steps.append(lambda t, rx=rx, to=step["content"]: rx.sub(lambda m: to, t))
            else:
                raise ValueError(f"normalizer {step['type']}")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("only a Split that keeps its matches is read")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.known = _Known(self)

    def merge(self, word: str) -> list[int]:
        """Ids of one word, already lower-cased."""
        symbols = [self.letters[b] for b in word.encode("utf-8")]
        symbols[-1] += self.suffix
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks = self.ranks
        queue = []
        for i in range(n - 1):
            got = ranks.get((symbols[i], symbols[i + 1]))
            if got:
                queue.append((got[0], i, symbols[i], symbols[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if j >= n or symbols[i] != left or symbols[j] != right:
                continue  # stale: one of the two was merged meanwhile
            symbols[i], symbols[j] = left + right, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                got = ranks.get((symbols[i], symbols[k]))
                if got:
                    heapq.heappush(queue, (got[0], i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0:
                got = ranks.get((symbols[h], symbols[i]))
                if got:
                    heapq.heappush(queue, (got[0], h, symbols[h], symbols[i]))
        vocab = self.vocab
        return [vocab[s] for s in symbols if s and s in vocab]

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Stretches of ordinary text and special tokens."""
        if self.special is None:
            yield text, None
            return
        at = 0
        for m in self.special.finditer(text):
            if m.start() > at:
                yield text[at : m.start()], None
            yield m[0], self.added[m[0]]
            at = m.end()
        if at < len(text):
            yield text[at:], None

    def pieces(self, text: str) -> list[tuple[bytes, str]]:
        """For each word: its ids as little-endian 32-bit bytes, and its decoded string."""
        known, out = self.known, []
        for part, special in self.parts(text):
            if special is not None:
                out.append(known.of([special]))
                continue
            for step in self.steps:
                part = step(part)
            out += map(known.__getitem__, self.words.findall(part))
        if len(known) > CACHE_WORDS:
            known.clear()
        return out

    def encode(self, text: str) -> list[int]:
        ids = array("I")
        ids.frombytes(b"".join(p[0] for p in self.pieces(text)))
        return ids.tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.strings[i] for i in ids if i in self.strings)


class _Known(dict):
    """Words and what they encode to; a missing one is encoded."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer

    def of(self, ids: list[int]) -> tuple[bytes, str]:
        return array("I", ids).tobytes(), self.tokenizer.decode(ids)

    def __missing__(self, word: str) -> tuple[bytes, str]:
        got = self[word] = self.of(self.tokenizer.merge(word))
        return got


def _lower(text: str) -> str:
    """Lower-cases letter by letter: unlike ``str.lower``, a final sigma is not treated apart."""
    return text.lower() if "Σ" not in text else "".join(map(str.lower, text))


def loaded(content: str, number: str) -> Tokenizer:
    """The tokenizer of a vocabulary, read once per worker process (kept on ``sys``, which outlives a task's own copies of this module)."""
    kept = sys.__dict__.setdefault("_loomtable_tokenizer", {})
    if number not in kept:
        kept.clear()
        kept[number] = Tokenizer(json.loads(content))
    return kept[number]


def encoded(docs: DataFrame, vocabulary: str, *, text: str = "text", ids: bool = True) -> DataFrame:
    """``row``, ``text``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked, the ``ids``."""
    df = packed(docs, text)
    with open(vocabulary, encoding="utf-8") as f:
        content = f.read()
    number = hashlib.sha256(content.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(content)
    schema = T.StructType([df.schema["row"], df.schema["text"]] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(shared.value, number)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists, counts, one, two = [], [], [], []
                for t in part.column("text").to_pylist():
                    pieces = tokenizer.pieces(t or "")
                    raw = b"".join([p[0] for p in pieces])
                    counts.append(len(raw) // 4)
                    one.append(hashlib.sha256(raw).hexdigest())
                    two.append(hashlib.sha256(" ".join([p[1] for p in pieces if p[0]]).encode("utf-8")).hexdigest())
                    if ids:
                        a = array("I")
                        a.frombytes(raw)
                        lists.append(a)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("text"), *([pa.array(lists, pa.list_(pa.int32()))] if ids else []), pa.array(counts, pa.int64()), pa.array(one), pa.array(two)], names=schema.names)

    return df.mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    has(docs, id_col, text)
    small = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return encoded(small, vocabulary, text="text", ids=False).select(F.col("row.id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def tokens(docs: DataFrame, vocabulary: str, *, text: str = "text", digests: bool = False) -> DataFrame:
    """``docs`` with ``token_ids`` added and, if asked, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` (each replacing a column of that name)."""
    df = encoded(docs, vocabulary, text=text)
    added = {"token_ids": "ids"} | ({c: c for c in ("n_tokens", "ids_sha256", "decoded_sha256")} if digests else {})
    rest = [c for c in docs.columns if c not in added]
    return df.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in rest], *[F.col(v).alias(c) for c, v in added.items()])


def op5(spark, sf_dir):
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
