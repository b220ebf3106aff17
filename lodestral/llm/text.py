"""Vectorised text helpers: Arrow string columns to NumPy word spans and hashes.

Everything works on the UTF-8 bytes of a batch, so no Python object is made for a
word.  Byte work runs over blocks of at most ``BLOCK`` bytes cut at separators; only
per-word arrays are as long as the batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK = 1 << 19
SLICE_BYTES = 2 << 20

#: ASCII white space: space and U+0009 to U+000D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_P = np.uint64(0x9E3779B97F4A7C55)
_Q = np.uint64(0xD6E8FEB86659FD93)
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in range(n)."""
    key = int(base)
    old = _TABLES.get(key)
    if old is None or len(old[0]) < n:
        inverse = pow(key, -1, 1 << 64)
        size = max(n, 1 << 16)
        up = np.full(size, base, dtype=np.uint64)
        down = np.full(size, inverse, dtype=np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            old = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        if size <= BLOCK + (1 << 16):
            _TABLES[key] = old
    return old[0][:n], old[1][:n]


def strings(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = pc.fill_null(array, "")
    array = array.cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]] if len(array) else data[:0], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        group = np.cumsum(length, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the word offset of each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(start), dtype=np.uint64)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + BLOCK)))
        base = start[a]
        size = int(end[b - 1] - base)
        with np.errstate(over="ignore"):
            if size > BLOCK:  # one word longer than a block
                out[a] = xxhash.xxh64_intdigest(data[start[a] : end[a]].tobytes())
                b = a + 1
            else:
                up, down = _powers(_P, BLOCK)
                total = np.zeros(size + 1, dtype=np.uint64)
                np.cumsum((data[base : base + size].astype(np.uint64) + np.uint64(1)) * up[:size], out=total[1:])
                s, e = start[a:b] - base, end[a:b] - base
                out[a:b] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        a = b
    out = mix(out)
    for i in np.flatnonzero(end - start > 256):  # polynomial hashes of long words are weaker
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    return out


class Rolling:
    """Hashes of word ranges from prefix sums."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        up, self.down = _powers(_Q, n + 1)
        self.total = np.zeros(n + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(hashes * up[:n], out=self.total[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[b] - self.total[a]) * self.down[a] + (b - a).astype(np.uint64))


#: Text of printable ASCII, tabs, line feeds and Latin letters: there every version of
#: Unicode tables gives the same matches of the byte-level pattern.
LATIN = re.compile(r"[\t\n -~À-ÖØ-öø-ÿ]*").fullmatch

_LETTER, _DIGIT, _MARK, _BLANK, _BREAK = range(5)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[[c for c in range(256) if c > 127 or chr(c).isalpha()]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x20] = _BLANK
_CLASS[[0x09, 0x0A]] = _BREAK
#: Letters of contractions.
_ONE, _TWO = [ord(c) for c in "stmd"], [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")]


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches of the byte-level splitting pattern in LATIN texts: start, end, first of each text.

    Runs of letters, digits or marks, each with one blank before it; of longer white space
    the last character stands alone unless it is such a blank; white space that ends a
    text is one match.  An apostrophe that begins a match and a contraction is one with its
    letters ('s 't 'm 'd 're 've 'll).
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _CLASS[data]
    white = kind >= _BLANK
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = np.ones(n, bool)
    # A character begins a match where its class changes, but for a character after a blank.
    begins[1:] = np.where(white[1:], ~white[:-1], (kind[1:] != kind[:-1]) & (kind[:-1] != _BLANK))
    begins[:-1] |= white[:-1] & ~white[1:] & ~edge[1:-1]
    begins[edge[:-1]] = True
    mark = np.flatnonzero(begins & (data == 0x27))
    if len(mark):
        inside = lambda k: (mark + k < n) & ~edge[np.minimum(mark + k, n)]
        one, two = (np.where(inside(k), data[np.minimum(mark + k, n - 1)], 0) for k in (1, 2))
        short = inside(1) & np.isin(one, _ONE)
        long = inside(1) & inside(2) & np.isin(one.astype(np.int64) << 8 | two, _TWO)
        begins[mark[short | long] + 1] = begins[mark[long] + 2] = False
        after = np.append(mark[short] + 2, mark[long] + 3)
        begins[after[after < n]] = True
    start = np.flatnonzero(begins)
    return start, np.append(start[1:], n), np.searchsorted(start, offsets)


class _Runs:
    """Runs of numbers, one after the other in one growing array."""

    def __init__(self, kind):
        self.flat, self.used = np.zeros(1 << 16, kind), 0
        self.begin, self.length, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        m = len(lengths)
        while self.used + len(values) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        while self.n + m > len(self.begin):
            self.begin, self.length = np.append(self.begin, np.zeros_like(self.begin)), np.append(self.length, np.zeros_like(self.length))
        self.flat[self.used : self.used + len(values)] = values
        self.length[self.n : self.n + m] = lengths
        self.begin[self.n : self.n + m] = self.used + np.cumsum(lengths) - lengths
        self.used += len(values)
        self.n += m

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Some runs in a row, and the length of each."""
        n = self.length[places]
        return self.flat[np.repeat(self.begin[places] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


class _Generation:
    """Ids and bytes of pieces by the pieces' hashes: sorted keys, and where each one's runs lie."""

    def __init__(self):
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.bytes = _Runs(np.uint32), _Runs(np.uint8)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 if it isn't known."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.places[at], -1)

    def add(self, hashes: np.ndarray, ids: tuple[np.ndarray, np.ndarray], raw: tuple[np.ndarray, np.ndarray]) -> None:
        n, m = len(self.keys), len(hashes)
        self.ids.add(*ids)
        self.bytes.add(*raw)
        keys, places = np.append(self.keys, hashes), np.append(self.places, np.arange(n, n + m))
        order = np.argsort(keys, kind="stable")  # two sorted runs
        self.keys, self.places = keys[order], places[order]


class Pieces:
    """Ids of LATIN texts, each distinct piece encoded once.

    ``many`` maps pieces to (ids, number of ids of each).  Pieces are looked up by hash; the
    bytes of what was found must give the text again, else the text is encoded piece by
    piece.  Two generations of about ``capacity`` pieces are kept; what is still in use
    moves to the younger.
    """

    def __init__(self, many, capacity: int = 400_000):
        self.many, self.capacity = many, capacity
        self.young, self.old = _Generation(), _Generation()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.young.keys) > self.capacity or self.young.ids.used > 16 * self.capacity:
            self.young, self.old = _Generation(), self.young
        parts = [t.encode() for t in texts]
        raw = b"".join(parts)
        offsets = np.cumsum([0, *map(len, parts)])
        data = np.frombuffer(raw, np.uint8)
        start, end, first = pieces(data, offsets)
        if not len(start):
            return [b""] * len(texts)
        distinct, at, back = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
        absent = np.flatnonzero(self.young.find(distinct) < 0)
        older = self.old.find(distinct[absent])
        moved, fresh = absent[older >= 0], absent[older < 0]
        if len(moved):
            places = older[older >= 0]
            self.young.add(distinct[moved], self.old.ids.gather(places), self.old.bytes.gather(places))
        if len(fresh):
            spans = [raw[a:b] for a, b in zip(start[at[fresh]].tolist(), end[at[fresh]].tolist())]
            self.young.add(distinct[fresh], self.many([x.decode() for x in spans]), (np.frombuffer(b"".join(spans), np.uint8), np.array(list(map(len, spans)))))
        places = self.young.find(distinct)[back]
        ids, n = self.young.ids.gather(places)
        bounds = 4 * np.concatenate(([0], np.cumsum(n)))[first]
        packed = ids.astype("<u4").tobytes()
        out = [packed[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
        known, _ = self.young.bytes.gather(places)
        if len(known) != len(data) or not np.array_equal(known, data):  # two pieces of one hash
            for k, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist())):
                same, _ = self.young.bytes.gather(places[a:b])
                if same.tobytes() != parts[k]:
                    out[k] = self.many([raw[x:y].decode() for x, y in zip(start[a:b].tolist(), end[a:b].tolist())])[0].astype("<u4").tobytes()
        return out


def packed(encoded: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """What Pieces wants of ``many``."""
    return np.fromiter(chain.from_iterable(encoded), np.uint32), np.fromiter(map(len, encoded), np.int64, len(encoded))
