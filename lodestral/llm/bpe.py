"""Byte-level BPE encoding and decoding from a rank file.

A piece of text (one match of the splitting pattern) is merged with a segment tree over
its byte positions.  The leaf of a live position holds the rank of the pair that begins
there, as ``rank << 32 | position``; inner nodes hold the minimum, so the root is the
leftmost pair of least rank.  A merge updates three leaves in logarithmic time.

Defined cases: a null text is empty and has no ids; texts are encoded whole, special
tokens' strings are ordinary text; rows are independent, so repeated rows, ties, null
ids and extra columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestral.llm import shared, text

_NONE = 1 << 62


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(0, (n - 2).bit_length())
    get = ranks.get
    leaves = [_NONE if (r := get(piece[i : i + 2])) is None else r << 32 | i for i in range(n - 1)]
    leaves += [_NONE] * (size - n + 1)
    levels = [leaves]
    while len(leaves) > 1:
        leaves = [a if a < b else b for a, b in zip(leaves[::2], leaves[1::2])]
        levels.append(leaves)
    tree = [0]
    for level in reversed(levels):
        tree += level
    after, before = list(range(1, n + 2)), list(range(-1, n + 1))
    while (top := tree[1]) < _NONE:
        i = top & 0xFFFFFFFF
        j = after[i]
        k = after[i] = after[j]
        before[k] = i
        # The merged pair's right leaf goes; the pairs right and left of the merged part are new.
        place = size + j
        value = _NONE
        if j < n - 1 and tree[place] != value:
            tree[place] = value
            while place > 1:
                place >>= 1
                value, b = tree[2 * place], tree[2 * place + 1]
                if b < value:
                    value = b
                if tree[place] == value:
                    break
                tree[place] = value
        r = get(piece[i : after[k]]) if k < n else None
        value = _NONE if r is None else r << 32 | i
        place = size + i
        tree[place] = value
        while place > 1:
            place >>= 1
            value, b = tree[2 * place], tree[2 * place + 1]
            if b < value:
                value = b
            if tree[place] == value:
                break
            tree[place] = value
        p = before[i]
        if p >= 0:
            r = get(piece[p:k])
            value = _NONE if r is None else r << 32 | p
            place = size + p
            if tree[place] != value:
                tree[place] = value
                while place > 1:
                    place >>= 1
                    value, b = tree[2 * place], tree[2 * place + 1]
                    if b < value:
                        value = b
                    if tree[place] == value:
                        break
                    tree[place] = value
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Encoder and decoder of one rank file; kept per worker."""

    _loaded: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        n = max(self.ranks.values()) + 1
        self.bytes_of = [b""] * n
        for token, i in self.ranks.items():
            self.bytes_of[i] = token
        self.latin = pattern == public_tokenizers.PATTERN
        self.pieces = text.Pieces(lambda pieces: text.packed([merge(p.encode(), self.ranks) for p in pieces]), capacity=250_000)

        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        if ids is None:
            found = merge(piece.encode(), self.ranks)
            ids = pack(f"<{len(found)}I", *found)
            if len(piece) <= 64:
                if len(self.known) >= 1 << 16:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def _whole(self, value: str) -> bytes:
        return b"".join(map(self._piece, self.pattern.findall(value)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; of Latin texts each distinct piece is merged once."""
        texts = [t or "" for t in texts]
        latin = [self.latin and bool(text.LATIN(t)) for t in texts]
        pieced = iter(self.pieces([t for t, x in zip(texts, latin) if x]))
        return [next(pieced) if x else self._whole(t) for t, x in zip(texts, latin)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls._loaded:
            cls._loaded[path, pattern] = cls(path, pattern)
        return cls._loaded[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids binary): the ids of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(ranks, pattern)
        for batch in text.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codec.encode(batch.column("text").to_pylist()), pa.binary())], names=["doc_id", "ids"])

    return shared.arrow(docs.select("doc_id", "text"), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Adds decoded binary to (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(ranks, pattern)
        for batch in text.slices(batches, "ids"):
            ids = batch.column("ids")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array([codec.decode(x or b"") for x in ids.to_pylist()], pa.binary())], names=["doc_id", "ids", "decoded"])

    return shared.arrow(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): ``encode`` and ``decode`` in one pass, by one worker with one set of tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(ranks, pattern)
        for batch in text.slices(batches):
            ids = codec.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.binary())], names=["doc_id", "ids", "decoded"])

    return shared.arrow(docs.select("doc_id", "text"), run, "doc_id long, ids binary, decoded binary")
