"""License scan by diagonal voting.

Each text's rolling word k-gram hashes (k: 2 for short templates, 3 for long
ones) are joined by Spark with the positions of all template k-grams; a match
is kept if the words themselves are equal, not only their hashes.  A match at
word i of the text and word j of a template votes for diagonal i - j.  Votes
are aggregated by (text, template, diagonal); neighbouring diagonals (words
inserted or left out) are merged into spans whose diagonals drift by
``DRIFT`` words at most (overlapping windows, so no such span is cut); a
merged span is verified: the longest chain of its votes that rises in both text
and template, so that words count in their order and in one stretch of the
text alone, must cover enough of the template.

Templates are a short list, a parameter (``TEMPLATES``); their number is
checked and their grams are broadcast.  Before the join a bitmap of template
hashes drops grams that cannot join: all grams are looked up, and what the map
lets through is a superset, decided by the join.  Votes are the only rows
shuffled.

Base phrases are templates that must match whole, on one diagonal; every place
counts.  Other templates are license notices and bodies: one whose chain covers
at least ``COVER`` of its words, the gram that tells it from others among them,
adds its label; one of fewer than ``SHORT`` words must match whole.

Defined results: a null or empty text has no words, no labels and score 0.
Rows are numbered before the shuffle, so repeated rows and ids stay apart.
The score is the best covered share over all templates, 1 for a base phrase.
Of notices that tie, all labels count.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtable.llm import _kernel as K
from loomtable.llm._shared import has, table

#: Words of a gram in templates of fewer than ``SHORT`` words, and in others.
FEW, MANY, SHORT = 2, 3, 8
COVER = 0.6
#: Diagonals this near are neighbours; a span drifts by so many words at most.
NEAR, DRIFT = 3, 8
#: Words of all templates: their grams are broadcast (about 100 bytes each).
MAX_WORDS = 200_000

#: (label, phrase): must match whole.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

#: Public license texts and notices (label, words a match must hold, text).
NOTICES = [
    ("mit", "free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit", "free of charge",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    ("mit", "mit license", "released under the mit license"),
    ("apache", "the apache license", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    (
        "apache", "the apache license",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    ("apache", "the apache license", "licensed under the apache license version 2 0"),
    ("gpl", "gnu general public", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    (
        "gpl", "gnu general public",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu general public license for more details "
        "you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses",
    ),
    ("gpl", "gnu general public", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general", "licensed under the gnu lesser general public license"),
    ("bsd", "and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (
        "bsd", "and binary forms",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to "
        "the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ),
    ("isc", "purpose with or", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "by nc", "licensed under cc by nc"),
    ("unlicense", "into the public", "this is free and unencumbered software released into the public domain"),
    ("reserved", "rights reserved", "all rights reserved"),
]


class Template(NamedTuple):
    label: str
    text: str
    #: Counts at every place and must match whole.
    base: bool = False
    #: Words that a match must hold; the first gram if empty.
    must: str = ""

    @property
    def size(self) -> int:
        return len(self.text.split())

    @property
    def gram(self) -> int:
        return FEW if self.size < SHORT else MANY


TEMPLATES = [Template(label, text, True) for label, text in PHRASES] + [Template(label, text, False, must) for label, must, text in NOTICES]


def checked(templates: list[Template]) -> list[Template]:
    """Templates in the scan's words; each must have a gram, and hold the gram it must hold."""
    out = []
    for t in templates:
        words = K.words_of([t.text])
        text = words.text(0, len(words)).decode()
        t = t._replace(text=text)
        if t.size < t.gram or t.must and _place(t) < 0:
            raise ValueError(f"a template of too few words, or without {t.must!r}: {text!r}")
        out.append(t)
    if sum(t.size for t in out) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} words of templates")
    return out


def _place(t: Template) -> int:
    """Number of the gram that a match must hold; -1 if there is none in the text."""
    words, k = t.text.split(), t.gram
    must = t.must.split()[:k] if t.must else words[:k]
    return next((i for i in range(len(words) - k + 1) if words[i : i + k] == must), -1)


def template_grams(templates: list[Template]) -> list[tuple[int, int, str, int]]:
    """(template, position, gram, hash)."""
    out = []
    for i, t in enumerate(templates):
        w = K.words_of([t.text])
        grams, at = w.grams(w.hashes(), t.gram)
        out += [(i, int(a), w.text(int(a), int(a) + t.gram).decode(), int(g)) for g, a in zip(grams.view(np.int64).tolist(), at.tolist(), strict=True)]
    return out


def grams(docs: DataFrame, id_col: str, text: str, known: list[int]) -> DataFrame:
    """number, doc_id, n_words, votes: array of (hash, gram, at) of the grams that may be in a template."""
    low_of = lambda g: (g & np.uint64((1 << 20) - 1)).astype(np.int64)
    bits = np.zeros(1 << 20, bool)
    bits[low_of(np.array(known, dtype=np.int64).view(np.uint64))] = True
    packed_bits = np.packbits(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = K.buffers(batch.column("text"))
            for lo, hi in K.chunks(offsets):
                w = K.Words(offsets[lo : hi + 1], raw)
                h = w.hashes()
                places, hashes, sizes = [], [], []
                for k in (FEW, MANY):
                    g, at = w.grams(h, k)
                    low = low_of(g)
                    maybe = np.flatnonzero(packed_bits[low >> 3] & (128 >> (low & 7)).astype(np.uint8))
                    places.append(at[maybe])
                    hashes.append(g[maybe])
                    sizes.append(np.full(len(maybe), k))
                place, g, size = np.concatenate(places), np.concatenate(hashes), np.concatenate(sizes)
                order = np.argsort(place, kind="stable")
                place, g, size = place[order], g[order], size[order]
                text_of = np.searchsorted(w.first, place, side="right") - 1
                bounds = np.searchsorted(text_of, np.arange(hi - lo + 1)).astype(np.int32)
                votes = pa.StructArray.from_arrays(
                    [pa.array(g.view(np.int64)), pa.array([w.text(int(p), int(p + k)).decode() for p, k in zip(place, size, strict=True)], pa.string()), pa.array(place - w.first[text_of])], names=["hash", "gram", "at"]
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("number").slice(lo, hi - lo), batch.column("doc_id").slice(lo, hi - lo), pa.array(w.counts(), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), votes)],
                    names=["number", "doc_id", "n_words", "votes"],
                )

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("number", F.monotonically_increasing_id())
    return rows.mapInArrow(run, "number bigint, doc_id bigint, n_words bigint, votes array<struct<hash: bigint, gram: string, at: bigint>>")


def chain(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest list of (i, j) in which both rise."""
    ends, tails, before = [], [], {}  # ends: smallest last j of a chain of each length
    places = sorted(set(places), key=lambda p: (p[0], -p[1]))
    for n, (_, j) in enumerate(places):
        at = bisect_left(ends, j)
        if at == len(ends):
            ends.append(j)
            tails.append(n)
        else:
            ends[at], tails[at] = j, n
        before[n] = tails[at - 1] if at else None
    out, n = [], tails[-1] if tails else None
    while n is not None:
        out.append(places[n])
        n = before[n]
    return out[::-1]


def verified(places: list[tuple[int, int]], t: Template, must: int) -> tuple[float, int, int] | None:
    """(cover, first word, last word) of a span, if it is one."""
    found = chain(places)
    words = {j + x for _, j in found for x in range(t.gram)}
    if t.base and len(words) < t.size or not t.base and must not in {j for _, j in found}:
        return None
    return len(words) / t.size, found[0][0], found[-1][0] + t.gram - 1


def spans(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", templates: list[Template] | None = None) -> DataFrame:
    """number, doc_id, n_words and one row per verified span: label, base, whole, first, last (words), cover; a row of nulls for each text, so that none is lost."""
    spark = docs.sparkSession
    known = checked(TEMPLATES if templates is None else templates)
    every = template_grams(known)
    voted = grams(docs, id_col, text, [g[3] for g in every])
    # The vote of no template (hash null) keeps each text through the join.
    none = F.array(F.struct(F.lit(None).cast("bigint").alias("hash"), F.lit("").alias("gram"), F.lit(0).cast("bigint").alias("at")))
    votes = voted.select("number", "doc_id", "n_words", F.explode(F.concat(none, "votes")).alias("v")).select("number", "doc_id", "n_words", "v.hash", "v.gram", "v.at")
    hit = votes.join(F.broadcast(_rows(spark, every, "template, j, of, hash")), "hash", "left").where("hash IS NULL OR gram = of")
    diagonal = hit.groupBy("number", "template", (F.col("at") - F.col("j")).alias("diagonal")).agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.collect_set("j")).alias("grams"))
    base = F.coalesce(F.col("template").isin([i for i, t in enumerate(known) if t.base]), F.lit(False))
    # Base phrases stand alone; of notices, neighbouring diagonals are one island, looked at through overlapping windows.
    order = Window.partitionBy("number", "template").orderBy("diagonal")
    new = F.coalesce(base | (F.col("diagonal") - F.lag("diagonal").over(order) > NEAR), F.lit(True)).cast("int")
    island = diagonal.withColumn("island", F.sum(new).over(order)).withColumn("from", F.min("diagonal").over(Window.partitionBy("number", "template", "island")))
    window = F.floor((F.col("diagonal") - F.col("from")) / DRIFT)
    island = island.withColumn("window", F.explode(F.when(window > 0, F.array(window, window - 1)).otherwise(F.array(F.coalesce(window, F.lit(0).cast("bigint"))))))
    span = island.groupBy("number", "template", "island", "window").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list(F.transform("grams", lambda j: F.struct((F.col("diagonal") + j).alias("i"), j.alias("j"))))).alias("places"))
    musts = [_place(t) for t in known]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["label", "base", "whole", "first", "last", "cover"]
        types = [pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.float64()]
        for batch in batches:
            rows, keep = [], []
            templates_ = batch.column("template").to_pylist()
            lists = batch.column("places")
            for n, i in enumerate(templates_):
                if i is None:
                    rows.append((None,) * 6)
                    keep.append(n)
                    continue
                t, places = known[i], lists[n].values
                got = verified(list(zip(places.field("i").to_pylist(), places.field("j").to_pylist(), strict=True)), t, musts[i])
                if got:
                    rows.append((t.label, t.base, t.size < SHORT, got[1], got[2], got[0]))
                    keep.append(n)
            at = pa.array(keep, pa.int64())
            cols = [batch.column(c).take(at) for c in ("number", "doc_id", "n_words")] + [pa.array([r[c] for r in rows], t) for c, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(cols, names=["number", "doc_id", "n_words", *names])

    return span.select("number", "doc_id", "n_words", F.col("template").cast("int"), "places").mapInArrow(run, "number bigint, doc_id bigint, n_words bigint, label string, base boolean, whole boolean, first bigint, last bigint, cover double")


def _rows(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    return spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n == 'of' else 'bigint'}" for n in names.split(", ")))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", cover: float = COVER, templates: list[Template] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    has(docs, id_col, text)
    s = spans(docs, id_col=id_col, text=text, templates=templates)
    joined = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    base = F.coalesce(F.col("base"), F.lit(False))
    fits = base | (F.col("cover") >= F.when(F.col("whole"), F.lit(1.0)).otherwise(F.lit(cover)))
    return s.groupBy("number").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        joined(base).alias("base_labels"), joined(fits).alias("labels"),
        F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
    ).drop("number")


def op2(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
