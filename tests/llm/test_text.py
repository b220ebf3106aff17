"""Word, piece and hash helpers against plain Python."""

import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestral.llm import text

PATTERN = regex.compile(P.PATTERN)
TEXTS = st.lists(st.one_of(st.text(alphabet="abZ19 .,-é\t\n", max_size=30), st.text(alphabet="''stmdrevlSé1.\n -", max_size=16)), max_size=6)


def layout(texts):
    parts = [t.encode() for t in texts]
    return b"".join(parts), np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_pieces(texts):
    assert all(text.LATIN(t) for t in texts)
    raw, data, offsets = layout(texts)
    start, end, first = text.pieces(data, offsets)
    assert [[raw[a:b].decode() for a, b in zip(start[x:y], end[x:y])] for x, y in zip(first, first[1:])] == [PATTERN.findall(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\x0b\x0c\r é日\x1c", max_size=20), max_size=6))
def test_words(texts):
    raw, data, offsets = layout(texts)
    start, end, first = text.words(data, offsets)
    got = [[raw[a:b] for a, b in zip(start[x:y], end[x:y])] for x, y in zip(first, first[1:])]
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for t in texts]


def test_latin_excludes():
    assert not any(text.LATIN(t) for t in ("don’t", "日本", "a b", "\r", "×", "\x1c", "“"))


def test_hashes():
    rng = np.random.default_rng(2)
    words = [bytes(rng.integers(97, 101, rng.integers(1, 7)).tolist()) for _ in range(3000)] + [b"x" * 1000, b"x" * 999, b"y" * (text.BLOCK + 5), b"z"]
    raw = b" ".join(words)
    data = np.frombuffer(raw, np.uint8)
    start, end, _ = text.words(data, np.array([0, len(data)]))
    h = text.word_hashes(data, start, end)
    by = {}
    for w, x in zip(words, h.tolist()):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)
    roll = text.Rolling(h)
    at = np.arange(2000)
    grams = {}
    for a, x in zip(at.tolist(), roll(at, at + 3).tolist()):
        assert grams.setdefault(tuple(words[a : a + 3]), x) == x
    assert len(set(grams.values())) == len(grams)


def test_generations():
    calls = []

    def many(pieces):
        calls.extend(pieces)
        return text.packed([[len(p), ord(p[0])] for p in pieces])

    table = text.Pieces(many, capacity=5)
    for texts in (["a b c d e f g"], ["a b"], ["x y z q r s", "a"], ["a b x"], [""], []):
        got = table(texts)
        assert got == [np.array([v for p in PATTERN.findall(t) for v in (len(p), ord(p[0]))], "<u4").tobytes() for t in texts]
    assert calls.count("a") == 1


def test_slices():
    batch = pa.RecordBatch.from_arrays([pa.array([None, "a" * 10, "b" * 50, "", "c" * 3])], names=["text"])
    parts = list(text.slices(iter([batch, batch.slice(0, 0)]), limit=20))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist() and len(parts) > 1
    data, offsets = text.strings(batch.column(0).slice(1, 3))
    assert bytes(data) == b"a" * 10 + b"b" * 50 and offsets.tolist() == [0, 10, 60, 60]


def test_colliding_pieces(monkeypatch):
    """Pieces of one hash are told apart by their bytes."""
    real = text.word_hashes
    monkeypatch.setattr(text, "word_hashes", lambda *a: real(*a) & np.uint64(3))
    table = text.Pieces(lambda pieces: text.packed([list(p.encode()) for p in pieces]))
    texts = ["ab cd ef gh ij kl", "ab", "xy zz", "", "ab cd"]
    for _ in range(2):
        assert table(texts) == [np.array(list(t.encode()), "<u4").tobytes() for t in texts]
