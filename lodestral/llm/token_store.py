"""Token-id store with Elias-Fano document boundaries.

Ids of all documents lie concatenated in doc_id order.  The store is a Parquet table
of blocks; a block holds whole documents, their ids as packed little-endian integers
of the narrowest width, and the document boundaries as an Elias-Fano sequence: the low
bits of each boundary packed, the high bits in unary, and a 32-bit sample of the unary
vector for every 256th boundary.  ``select`` finds one boundary and ``range`` some in a row
from the nearest sample, so neither needs a 64-bit table; the reader looks boundaries up
that way, some thousand documents at a time, and ``document`` reads one of them.

Range partitions keep the global order; a block's place inside its partition is known
to the one task that writes it, and only one total per partition goes to the driver.

Defined cases: a null text is empty (its only id is the end id); a null doc_id sorts
first; equal doc_ids lie side by side, ordered by a hash of their text; an empty table
gives an empty store; a text may be as long as a row can be (a block holds it whole); only
doc_id and text are read, so no other column can clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lodestral.llm import shared, text

SAMPLE = 256
BLOCK_TOKENS = 1 << 20
#: Documents read at a time.
READ = 4096
STORE = "part int, block int, before long, n_docs int, n_tokens long, width int, doc_ids array<long>, ids binary, low_bits int, low binary, high binary, samples binary"


class EliasFano:
    """A non-decreasing sequence of integers below 2**32, from 0 up."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def range(self, a: int, b: int) -> np.ndarray:
        """Values a to b - 1: from the sample before the first to the sample after the last."""
        if a >= b:
            return np.zeros(0, np.int64)
        samples = np.frombuffer(self.samples, "<u4")
        skip, beyond = a % SAMPLE, (b - 1) // SAMPLE + 1
        begin = int(samples[a // SAMPLE])
        end = int(samples[beyond]) if beyond < len(samples) else 8 * len(self.high)
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8)[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :]
        ones = begin + np.flatnonzero(bits)[skip : skip + b - a]
        return (ones - np.arange(a, b)) << self.low_bits | self._lows(a, b)

    def _lows(self, a: int, b: int) -> np.ndarray:
        w = self.low_bits
        if not w:
            return np.zeros(b - a, dtype=np.int64)
        first, last = a * w // 8, -(-b * w // 8)
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8)[first:last], bitorder="little")[a * w - 8 * first :][: (b - a) * w]
        return bits.reshape(-1, w) @ (np.int64(1) << np.arange(w))

    def all(self) -> np.ndarray:
        return self.range(0, self.n)

    def select(self, i: int) -> int:
        """Value i: from the nearest sample, count ones byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(np.frombuffer(self.samples, "<u4")[i // SAMPLE]), i % SAMPLE
        byte, skip = divmod(at, 8)
        word = self.high[byte] >> skip << skip
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        at = 8 * byte + (word & -word).bit_length() - 1
        return (at - i) << self.low_bits | int(self._lows(i, i + 1)[0])


class Encoder:
    """Texts to packed 32-bit ids with a tokenizer of the tokenizers library."""

    _loaded: dict[tuple[str, int | None], Encoder] = {}

    def __init__(self, path: str, end: int | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if max(self.tokenizer.get_vocab_size() - 1, end or 0) < 1 << 16 else 4
        self.end = b"" if end is None else np.array([end], "<u4").tobytes()
        self.pieces = text.Pieces(lambda strings: text.packed(self._library(strings)))

    def _library(self, strings: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Latin texts go piece by piece, each distinct piece once; the rest go whole."""
        texts = [t or "" for t in texts]
        latin = [bool(text.LATIN(t)) for t in texts]
        pieced = iter(self.pieces([t for t, x in zip(texts, latin) if x]))
        whole = iter(self._library([t for t, x in zip(texts, latin) if not x]))
        return [(next(pieced) if x else np.array(next(whole), "<u4").tobytes()) + self.end for x in latin]

    @classmethod
    def load(cls, path: str, end: int | None) -> Encoder:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if (path, end) not in cls._loaded:
            cls._loaded[path, end] = cls(path, end)
        return cls._loaded[path, end]


def _blocks(path: str, end: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.load(path, end), TaskContext.get().partitionId()
        before = block = 0
        keys: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal before, block, keys, held, size
            ends = np.cumsum([0, *(len(x) // 4 for x in held)])
            ef = EliasFano.of(ends)
            ids = np.frombuffer(b"".join(held), "<u4")
            row = (part, block, before, len(held), len(ids), encoder.width, keys, ids.astype(f"<u{encoder.width}").tobytes(), ef.low_bits, ef.low, ef.high, ef.samples)
            out = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES)], names=_NAMES)
            before, block, keys, held, size = before + len(ids), block + 1, [], [], 0
            return out

        for batch in text.slices(batches):
            for key, ids in zip(batch.column("doc_id").to_pylist(), encoder(batch.column("text").to_pylist())):
                keys.append(key)
                held.append(ids)
                size += len(ids) // 4
                if size >= BLOCK_TOKENS:
                    yield flush()
        if held:
            yield flush()

    return run


_NAMES = [c.split()[0] for c in STORE.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def write(docs: DataFrame, tokenizer: str, to: str, end: int | None = 2) -> None:
    """Tokenise every whole text and write the store to folder ``to``."""
    spark = docs.sparkSession
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(shared.partitions(spark), *order).sortWithinPartitions(*order)
    shared.arrow(ranged, _blocks(tokenizer, end), STORE).write.option("compression", "zstd").parquet(to)


def _documents(bases: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, places = row["n_docs"], EliasFano(row["n_docs"] + 1, row["low_bits"], row["low"], row["high"], row["samples"])
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                base = bases[row["part"]] + row["before"]
                for a in range(0, n, READ):  # boundaries are looked up as they are needed
                    b = min(n, a + READ)
                    bounds = places.range(a, b + 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row["doc_ids"][a:b], pa.int64()), pa.array(base + bounds[:-1]), pa.array(np.diff(bounds)), pa.array([zlib.crc32(ids[x:y]) for x, y in zip(bounds, bounds[1:])], pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return run


def read(spark, path: str) -> DataFrame:
    """Per document of a store: doc_id, start, n_tokens, ids_crc32."""
    blocks = spark.read.schema(STORE).parquet(path)
    totals = dict(blocks.groupBy("part").agg(F.sum("n_tokens")).collect())  # one row per writing task
    bases, total = {}, 0
    for part in sorted(totals):
        bases[part] = total
        total += totals[part]
    blocks = blocks.select("part", "before", "n_docs", "width", "doc_ids", "ids", "low_bits", "low", "high", "samples")
    return shared.arrow(blocks, _documents(bases), "doc_id long, start long, n_tokens long, ids_crc32 long")


def document(block: dict, i: int) -> np.ndarray:
    """Ids of the i-th document of a block, a row of the store."""
    places = EliasFano(block["n_docs"] + 1, block["low_bits"], block["low"], block["high"], block["samples"])
    return np.frombuffer(block["ids"], f"<u{block['width']}")[places.select(i) : places.select(i + 1)].astype("<u4")
