"""Texts that come together: each different piece is looked up once, new words are merged in a few calls, ids are those of whole texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docframe.llm import bpe
from docframe.llm.bpe import PieceEncoder, slices, vocabulary_path


@pytest.fixture(scope="module")
def pieces():
    return PieceEncoder(vocabulary_path(), cache_pieces=60)


def whole(p, text):
    return p._tok.encode(text or "", add_special_tokens=False).ids


def ids_of(p, texts):
    return [np.frombuffer(ids, "<u4").tolist() for ids in p.encode(texts)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(list("aZzé ñ\n\t.,'s|*_-$9²½日\0  ")), max_size=40)), max_size=8))
def test_ids_of_texts_that_come_together(pieces, texts):
    assert ids_of(pieces, texts) == [whole(pieces, t) for t in texts]


def test_ids_at_marks(pieces):
    texts = ["it's,we'll.a 3.14 x²,y x½. a_b.c,d www.a-b.org/c?d=e (f) g... h,,i j$$$ k.*** l--m", " a,b", ",a .b", "a", " a", "É,é ß. 日本,語. ﬀ, á, Ω.", "a.\nb.\n\nc,\n\"d", "x" * 3000 + "," + "é" * 700, None, ""]
    assert ids_of(pieces, texts) == [whole(pieces, t) for t in texts]


def test_new_words_are_merged_together():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghéß", k=rng.randint(3, 14))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=200)) + ", " + rng.choice(words) + "." for _ in range(60)]
    p, calls = PieceEncoder(vocabulary_path()), []
    merge, find = p._merge, p._pieces._find
    p._merge = lambda text: calls.append(text) or merge(text)
    p._pieces._find = lambda text: calls.append(text) or find(text)
    got = ids_of(p, texts)
    assert got == [whole(p, t) for t in texts] and len(calls) < 20  # a call a word before
    kept = {w for w in p._pieces if w.isalpha()}
    assert all(len(w) <= bpe.SHORT or sum(t.count(w) for t in texts) > 1 for w in kept)


def test_slices_hold_all_rows(monkeypatch):
    monkeypatch.setattr(bpe, "TEXT_BYTES", 10)
    texts = ["abc", None, "é" * 4, "x" * 50, "", "y", None, "z" * 9, "w"]
    parts = [s.column(1).to_pylist() for s in slices(pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], names=["n", "t"]), 1)]
    assert sum(parts, []) == texts and all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 10 for p in parts)
    assert list(slices(pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.string())], names=["n", "t"]), 1)) == []


def test_a_vocabulary_without_a_line_feed(pieces):
    p = PieceEncoder(vocabulary_path())
    p._feed = None
    assert ids_of(p, ["some words here"]) == [whole(p, "some words here")]
