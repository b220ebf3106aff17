"""Alignment of two tokenizers: a byte-level BPE (A) and sentence pieces (B).

Every byte of space+text carries a label: no token ends there, one of A, one of B, or one
of both.  A regular expression scans the labels up to each both-label; the A- and B-labels
in such a span are the tokens of one group.  Every A token of a group is linked to every B
token of it; an id pair's count is the number of documents that hold it linked.

Tokens are found once for each distinct unit of Latin texts: a unit begins where a piece
of A's splitting pattern begins with a run of blanks, so neither tokenizer joins bytes
across its bounds (that no piece of B has a blank after another character is checked when
it is loaded).  Other texts are encoded whole.  Units are looked up by hash; the bytes of
what was found must give the text again, else the text is encoded whole.

A document's distinct pairs are stored once.  Their counts are summed within batches
before the exchange.  The counts of the most frequent pairs, ``known`` at most, go to every
task; all others are joined by pair, so nothing is left out.  The highest count of each A
id has a row for each id of A's vocabulary at most, which bounds its broadcast.

Defined cases: null and empty texts, and texts whose tokens don't give back the bytes of
space+text (those with U+2581, as B reads it as a space), have no tokens: zeros and an
empty ``groups_sha256``.  Special tokens' strings are plain text.  A text may be as long
as a row can be.  Each row is a document of its own, so repeated rows count each and null
or repeated ids change nothing.  An empty table gives no rows.  Only doc_id and text are
read, so no other column can clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestral.llm import shared, text
from lodestral.llm.token_store import Encoder

_LABELS = np.frombuffer(b".ab|", np.uint8)
_GROUP = re.compile(rb"[^|]*\|")
#: Links of a group whose pairs are counted rather than listed.
LARGE = 1024


def _byte_of() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies write: printable ones stand for themselves, the rest for 256 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def groups(a_ends: np.ndarray, b_ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """End, number of A tokens and number of B tokens of each group of ``size`` bytes; ends are exclusive."""
    labels = np.zeros(size, np.uint8)
    labels[a_ends - 1] |= 1
    labels[b_ends - 1] |= 2
    spans = _GROUP.findall(_LABELS[labels].tobytes())
    ends = np.cumsum(np.fromiter(map(len, spans), np.int64, len(spans)))
    if not len(ends):
        return ends, ends, ends
    starts = np.append(0, ends[:-1])
    return ends, *(np.add.reduceat(labels >> k & 1, starts, dtype=np.int64) for k in (0, 1))


def _pairs(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a << 32 | b), how often each is linked, and the group of each; of large groups each pair comes once."""
    first_a, first_b, links = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b, n_a * n_b
    small = np.flatnonzero(links <= LARGE)
    group = np.repeat(small, links[small])
    k = np.arange(len(group)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
    pairs = a[first_a[group] + k // n_b[group]] << 32 | b[first_b[group] + k % n_b[group]]
    parts = [(pairs, np.ones(len(pairs), np.int64), group)]
    for g in np.flatnonzero(links > LARGE):
        (x, p), (y, q) = (np.unique(i[f[g] : f[g] + n[g]], return_counts=True) for i, f, n in ((a, first_a, n_a), (b, first_b, n_b)))
        parts.append(((x[:, None] << 32 | y).ravel(), (p[:, None] * q).ravel(), np.full(len(x) * len(y), g)))
    pairs, weights, group = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(group, kind="stable")
    return pairs[order], weights[order], group[order]


class _Found:
    """Groups of some units (or whole texts) after one another."""

    def __init__(self, aligner: Aligner, strings: list[bytes], a: list[list[int]], b: list[list[int]]):
        n = len(strings)
        sides = [text.packed(a), text.packed(b)]
        size, raw = np.fromiter(map(len, strings), np.int64, n), b"".join(strings)
        lengths = [table[flat] for table, (flat, _) in zip((aligner.length_a, aligner.length_b), sides)]
        owners = [np.repeat(np.arange(n), of) for _, of in sides]
        self.good = np.all([np.bincount(o, w, n) == size for o, w in zip(owners, lengths)], axis=0)
        tables = aligner.bytes_a, aligner.bytes_b
        if not self.good.all() or any(b"".join([t[i] for i in flat.tolist()]) != raw for t, (flat, _) in zip(tables, sides)):
            self.good = np.array([all(b"".join([t[i] for i in x]) == s for t, x in zip(tables, ids)) for s, ids in zip(strings, zip(a, b))], bool)
        (flat_a, ends_a), (flat_b, ends_b) = ((flat[self.good[o]].astype(np.int64), np.cumsum(w[self.good[o]])) for (flat, _), o, w in zip(sides, owners, lengths))
        bounds = np.cumsum(np.where(self.good, size, 0))
        ends, n_a, n_b = groups(ends_a, ends_b, int(bounds[-1]) if n else 0)
        unit = np.searchsorted(bounds, ends)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.bincount(unit, w, n).astype(np.int64) for w in (n_a, n_b, None, n_a * n_b))
        self.pairs, self.weights, of = _pairs(flat_a, flat_b, n_a, n_b)
        self.of_pairs = np.bincount(unit[of], minlength=n)
        # Each group's ids of A and then those of B, and what stands behind each id.
        written, last_a, last_b = np.zeros(len(flat_a) + len(flat_b), np.int64), np.cumsum(n_a) - 1, np.cumsum(n_b) - 1
        place_a = np.arange(len(flat_a)) + np.repeat(last_b + 1 - n_b, n_a)
        place_b = np.arange(len(flat_b)) + np.repeat(last_a + 1, n_b)
        written[place_a], written[place_b] = flat_a * 3, flat_b * 3
        written[place_a[last_a]] += 1
        written[place_b[last_b]] += 2
        per_unit = np.cumsum(self.n_a + self.n_b).tolist()
        names = [aligner.names[i] for i in written.tolist()]
        #: Each group is followed by a semicolon.
        self.lines = ["".join(names[x:y]).encode() for x, y in zip([0, *per_unit], per_unit)]


class _Units:
    """Groups of units by the units' hashes."""

    def __init__(self):
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.bytes, self.lines, self.pairs, self.weights = text._Runs(np.uint8), text._Runs(np.uint8), text._Runs(np.int64), text._Runs(np.int64)
        self.numbers = text._Runs(np.int64)  # good, n_a, n_b, n_groups, n_links of each

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.places[at], -1)

    def add(self, hashes: np.ndarray, *runs: tuple[np.ndarray, np.ndarray]) -> None:
        n, m = len(self.keys), len(hashes)
        for mine, new in zip((self.bytes, self.lines, self.pairs, self.weights, self.numbers), runs):
            mine.add(*new)
        keys, places = np.append(self.keys, hashes), np.append(self.places, np.arange(n, n + m))
        order = np.argsort(keys, kind="stable")  # two sorted runs
        self.keys, self.places = keys[order], places[order]

    def gather(self, places: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [x.gather(places) for x in (self.bytes, self.lines, self.pairs, self.weights, self.numbers)]

    def used(self) -> int:
        return self.bytes.used + self.lines.used + 16 * self.pairs.used + 40 * len(self.keys)


def _joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(strings), np.uint8), np.fromiter(map(len, strings), np.int64, len(strings))


class Aligner:
    """Both tokenizers and the units met so far; kept per worker.  Two generations of ``limit`` bytes are held."""

    _loaded: dict[tuple[str, str], Aligner] = {}

    def __init__(self, a_path: str, b_path: str, limit: int = 48 << 20):
        import sentencepiece

        self.a, self.b, self.limit = Encoder.load(a_path, None), sentencepiece.SentencePieceProcessor(model_file=b_path), limit
        byte_of = _byte_of()
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in byte_of for c in token):
                self.bytes_a[i] = bytes(byte_of[c] for c in token)
        b, self.bytes_b = self.b, []
        for i in range(b.vocab_size()):
            piece = b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else b"" if b.is_control(i) or b.is_unknown(i) else piece.replace("▁", " ").encode())
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.names = [f"{i}{end}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for end in ",|;"]
        self.apart = not any(b" " in x.lstrip(b" ") for x in self.bytes_b)
        self.young, self.old = _Units(), _Units()

    @classmethod
    def load(cls, a_path: str, b_path: str) -> Aligner:
        if (a_path, b_path) not in cls._loaded:
            cls._loaded[a_path, b_path] = cls(a_path, b_path)
        return cls._loaded[a_path, b_path]

    def tokens(self, strings: list[bytes]) -> _Found:
        """Groups of strings that begin with a blank, each encoded whole."""
        own = [s.decode() for s in strings]
        return _Found(self, strings, self.a._library(own), self.b.encode([s[1:] for s in own], num_threads=1) if own else [])

    def _add(self, hashes: np.ndarray, spans: list[bytes]) -> None:
        f = self.tokens(spans)
        numbers = np.stack([f.good, f.n_a, f.n_b, f.n_groups, f.n_links], axis=1).astype(np.int64).ravel()
        self.young.add(hashes, _joined(spans), _joined(f.lines), (f.pairs, f.of_pairs), (f.weights, f.of_pairs), (numbers, np.full(len(spans), 5)))

    def units(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each unit, and the first unit of each text."""
        data = np.frombuffer(raw, np.uint8)
        begins = np.zeros(len(data), bool)
        begins[text.pieces(data, offsets)[0]] = True
        blank = data == 0x20
        blank[1:] &= data[:-1] != 0x20
        begins &= blank
        begins[offsets[:-1]] = True
        start = np.flatnonzero(begins)
        return start, np.append(start[1:], len(data)), np.searchsorted(start, offsets)

    def __call__(self, texts: list[str | None]) -> list[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """n_a, n_b, n_groups, n_links, digest of the groups, distinct pairs and how often each is linked, of each text."""
        out = [(0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
        latin = [i for i, t in enumerate(texts) if t and self.apart and text.LATIN(t)]
        seen = set(latin)
        whole = [i for i, t in enumerate(texts) if t and i not in seen]
        if latin:
            parts = [b" " + texts[i].encode() for i in latin]
            for i, row in zip(latin, self._by_units(parts)):
                if row is None:
                    whole.append(i)
                else:
                    out[i] = row
        for i in whole:
            f = self.tokens([b" " + texts[i].encode()])
            if f.good[0]:
                out[i] = _row(f.n_a[0], f.n_b[0], f.n_groups[0], f.n_links[0], f.lines[0], f.pairs, f.weights)
        return out

    def _by_units(self, parts: list[bytes]) -> list[tuple | None]:
        """None: two units of one hash, or tokens that don't give the text again."""
        if self.young.used() > self.limit:
            self.young, self.old = _Units(), self.young
        raw = b"".join(parts)
        start, end, first = self.units(raw, np.cumsum([0, *map(len, parts)]))
        distinct, at, back = np.unique(text.word_hashes(np.frombuffer(raw, np.uint8), start, end), return_index=True, return_inverse=True)
        absent = np.flatnonzero(self.young.find(distinct) < 0)
        older = self.old.find(distinct[absent])
        moved, fresh = absent[older >= 0], absent[older < 0]
        if len(moved):
            self.young.add(distinct[moved], *self.old.gather(older[older >= 0]))
        if len(fresh):
            self._add(distinct[fresh], [raw[a:b] for a, b in zip(start[at[fresh]].tolist(), end[at[fresh]].tolist())])
        places = self.young.find(distinct)[back]
        out = []
        for k, part in enumerate(parts):
            (known, _), (lines, _), (pairs, _), (weights, _), (numbers, _) = self.young.gather(places[first[k] : first[k + 1]])
            good, *sums = numbers.reshape(-1, 5).T
            out.append(_row(*(int(x.sum()) for x in sums), lines.tobytes(), pairs, weights) if good.all() and known.tobytes() == part else None)
        return out


def _row(n_a, n_b, n_groups, n_links, lines: bytes, pairs: np.ndarray, weights: np.ndarray) -> tuple:
    distinct, back = np.unique(pairs, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, back, weights)
    return int(n_a), int(n_b), int(n_groups), int(n_links), sha256(lines[:-1]).hexdigest(), distinct, total


ALIGNED = "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, weights array<long>"
_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A stored table (``ALIGNED``) of groups and distinct pairs, a row for each row of docs; ``rid`` tells rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.load(a_path, b_path)
        for batch in text.slices(batches):
            rows = aligner(batch.column("text").to_pylist())
            ends = np.cumsum([0, *(len(r[5]) for r in rows)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[i] for r in rows]))) for i in (5, 6)]
            numbers = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), *numbers, pa.array([r[4] for r in rows], pa.string()), *lists], names=["rid", "doc_id", *_NUMBERS, "groups_sha256", "pairs", "weights"])

    own = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return shared.stored(shared.arrow(own, run, ALIGNED), "aligned")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    return np.asarray(column.flatten()), np.repeat(np.arange(len(column)), np.asarray(column.value_lengths()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs, n = np.unique(_flat(batch.column("pairs"))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])


def counts(aligned: DataFrame) -> DataFrame:
    """A stored table: pair, n (documents that hold it linked), best (n is the highest of its A id)."""
    found = shared.stored(shared.arrow(aligned.select("pairs"), _counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    top = found.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("top"))  # a row for each id of A at most
    return found.join(F.broadcast(top), F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _least(pairs: DataFrame, known: int) -> int:
    """A count that at most ``known`` pairs reach; from a histogram of at most 512 bins."""
    bins = dict(pairs.groupBy(F.floor(F.log2("n") * 8).alias("bin")).count().collect())
    held, least = 0, max(bins, default=0) + 1
    for k in sorted(bins, reverse=True):
        held += bins[k]
        if held > known:
            break
        least = k
    return int(np.floor(2 ** (least / 8))) + 1 if least > min(bins, default=0) else 0


def _summed(keys: np.ndarray, values: np.ndarray, best: np.ndarray):
    """n_best and count_sum of each row from the known pairs, and the pairs that aren't known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, row = _flat(batch.column("pairs"))
            weights, n = np.asarray(batch.column("weights").flatten()), batch.num_rows
            at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
            known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            spot, own, mine = at[known], row[known], weights[known]
            sums = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
            np.add.at(sums[0], own, mine * best[spot])
            np.add.at(sums[1], own, mine * values[spot])
            ends = np.searchsorted(row[~known], np.arange(n + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[~known])) for x in (pairs, weights)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "doc_id", *_NUMBERS, "groups_sha256")), *map(pa.array, sums), *lists], names=["rid", "doc_id", *_NUMBERS, "groups_sha256", "best", "sum", "pairs", "weights"])

    return run


def score(aligned: DataFrame, pairs: DataFrame, known: int = 1 << 19) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of ``aligned``."""
    least = _least(pairs, known)
    held = pairs.filter(F.col("n") >= least).toArrow()
    keys, values, best = (np.asarray(held.column(c).combine_chunks()) for c in ("pair", "n", "best")) if held.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    order = np.argsort(keys)
    head = "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, best long, sum long, pairs array<long>, weights array<long>"
    rows = shared.arrow(aligned, _summed(keys[order], values[order], best[order]), head)
    asked = rows.filter(F.size("pairs") > 0).select("rid", F.explode(F.arrays_zip("pairs", "weights")).alias("x")).select("rid", F.col("x.pairs").alias("pair"), F.col("x.weights").alias("w"))
    rare = asked.join(pairs.filter(F.col("n") < least), "pair").groupBy(F.col("rid").alias("of")).agg(F.sum(F.col("w") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("w") * F.col("n")).alias("more_sum"))
    zero = F.lit(0).cast("long")
    full = rows.drop("pairs", "weights").join(rare, F.col("rid") == F.col("of"), "left")
    return full.select("doc_id", *_NUMBERS, (F.col("best") + F.coalesce("more_best", zero)).alias("n_best"), (F.col("sum") + F.coalesce("more_sum", zero)).alias("count_sum"), "groups_sha256")


def cross(docs: DataFrame, a_path: str, b_path: str, known: int = 1 << 19) -> DataFrame:
    """The alignment of every whole text, with the corpus' counts of its pairs."""
    aligned = align(docs, a_path, b_path)
    return score(aligned, shared.stored(counts(aligned), "counts"), known)
