import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import textkernel as K

TEXT = st.text(alphabet=st.sampled_from(list("aAbBzéÉß \t\n\x0b\x0c\r\x1c\u00a0\u2003-\U0001f600")), max_size=40)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(word):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_equal_the_pattern(texts):
    hashes, first = K.texts_words(pa.array(texts, pa.string()))
    want = [[lower(w) for w in words(t)] for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    seen = {}
    for h, w in zip(hashes.tolist(), flat, strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@settings(deadline=None)
@given(st.lists(TEXT, max_size=6), st.integers(1, 5))
def test_shingles(texts, size):
    hashes, owner = K.shingle_hashes(*K.texts_words(pa.array(texts, pa.string())), size)
    want = []
    for i, t in enumerate(texts):
        w = [lower(x) for x in words(t)]
        want += [(i, tuple(w[k : k + size])) for k in range(len(w) - size + 1)] if len(w) >= size else [(i, tuple(w))] * bool(w)
    assert owner.tolist() == [i for i, _ in want]
    seen = {}
    for h, (_, s) in zip(hashes.tolist(), want, strict=True):
        assert seen.setdefault(s, h) == h
    assert len(set(seen.values())) == len(seen)


def test_chunks_and_slices(monkeypatch):
    texts = ["one two three " * 50, None, "x" * 3000, ""]
    whole = K.texts_words(pa.array(texts))[0]
    monkeypatch.setattr(K, "CHUNK", 64)
    assert (K.texts_words(pa.array(texts))[0] == whole).all()
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = list(K.slices(batch, limit=800))
    assert [x for p in parts for x in p.column("text").to_pylist()] == texts and len(parts) > 1
    assert (np.concatenate([K.texts_words(p.column("text"))[0] for p in parts]) == whole).all()
