import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtable.llm import _kernel as K

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")
TEXTS = st.lists(st.text(alphabet="aB1 é,.\n\u0085😀", max_size=30), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_match_the_patterns(texts):
    for table, rx in ((K.ALNUM, ALNUM), (K.SPACED, SPACED)):
        w = K.words_of(texts, table)
        got = [[w.bytes[w.start[i] : w.end[i]].tobytes().decode() for i in range(w.first[d], w.first[d + 1])] for d in range(len(texts))]
        assert got == [rx.findall(t.translate(LOW)) for t in texts]


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_grams_are_runs_within_one_text(texts, k):
    w = K.words_of(texts)
    grams, at = w.grams(w.hashes(), k)
    words = [ALNUM.findall(t.translate(LOW)) for t in texts]
    want = [(w.first[d] + i, tuple(ws[i : i + k])) for d, ws in enumerate(words) for i in range(len(ws) - k + 1)]
    assert [a for a, _ in want] == at.tolist()
    seen = {}
    for (_, run), h in zip(want, grams.tolist(), strict=True):
        assert seen.setdefault(run, h) == h
    assert len(set(seen.values())) == len(seen)


def test_buffers_read_slices_and_nulls():
    column = pa.array(["x", None, "ab", ""])[1:]
    offsets, raw = K.buffers(column)
    w = K.Words(offsets, raw)
    assert w.counts().tolist() == [0, 1, 0]


def test_chunks_cover_all_rows_once():
    offsets = np.array([0, 5, 5, 30, 31])
    parts = list(K.chunks(offsets, 8))
    assert [x for lo, hi in parts for x in range(lo, hi)] == [0, 1, 2, 3]
