"""Removal of repeated byte spans by suffix arrays of shards.

Every 100-byte window has a minimizer, the least hash of the 32-byte strings inside it;
windows in a row with one minimizer make a segment, so equal windows lie in segments of
equal minimizers.  Equal segments collapse to the first of them, the others repeat in full.
The distinct segments of a minimizer that has more than one are cut out of their documents
and dealt to shards by minimizer.  A shard's segments lie one after the other in the order
of their coordinates; its suffix array is built by induced sorting (``suffix_array``), and
permuted common prefixes tell which windows have 100 bytes in common with a neighbour in
the array.  Of each run of such neighbours the window of the least coordinate stays and the
others repeat.  The bytes that repeated windows cover go.

Equality of segments rests on a hash of their minimizer and one of all their bytes (XXH3),
64 bits each; that of windows in a shard on the bytes themselves.

No group of unknown size meets in one task.  Map tasks collapse what they see and keep a
table of common contents.  Minimizers found very common in a small sample are dealt by
whole windows.  A minimizer with more than ``most`` distinct segments doesn't go to a shard:
its windows are told apart by 128-bit digests, of which the least coordinates are found by
an aggregate that combines in the map tasks.  Sorted rows of a partition are read as a
stream; a shard holds about ``SHARD`` bytes and the segments of its last minimizer.

Defined cases: a null text has no bytes; texts under 100 bytes lose nothing; a text may be
as long as a row can be; null doc_ids sort first.  Rows that share a doc_id are told apart
by a hash of their text, and rows equal in both are one document: they don't repeat each
other.  An empty table gives no rows; all columns of the input are kept, but those with the
names of new ones (``__kept``, ``__n_bytes``, ``__n_removed``, ``__n_spans``), which give way.
What is kept is bytes: a cut may fall inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from lodestral.llm import shared, substring, text
from lodestral.llm.suffix_array import permuted_prefixes, ranks

ROWS = "kind byte, route long, h long, doc_id long, th long, pos int, n int"
_NAMES = [c.split()[0] for c in ROWS.split(", ")]
SEGMENTS = "route long, doc_id long, th long, pos int, n int, bytes binary"
NEW = ("__kept", "__n_bytes", "__n_removed", "__n_spans")
GONE, OPEN, PATH = 0, 1, 2
SLICE, SHARD = 1 << 19, 1 << 20


def _batch(kind, r: substring._Rows) -> pa.RecordBatch:
    """Records as a batch; removed spans have no hashes."""
    kinds = np.broadcast_to(np.asarray(kind, np.int8), len(r.pos))
    gone = kinds == GONE
    longs = [np.where(gone, text.mix(np.arange(len(gone), dtype=np.uint64) ^ r.doc.view(np.uint64)), r.route), np.where(kinds == PATH, r.h, np.uint64(0))]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(kinds)), *(pa.array(x.view(np.int64)) for x in longs), pa.array(r.doc), pa.array(r.th), pa.array(r.pos.astype(np.int32)), pa.array(r.n.astype(np.int32))], names=_NAMES)


def _merged(r: substring._Rows) -> substring._Rows:
    """Spans that touch or overlap made one."""
    r = r.take(np.lexsort((r.pos, r.th, r.doc)))
    if not len(r.pos):
        return r
    other = np.append(True, (r.doc[1:] != r.doc[:-1]) | (r.th[1:] != r.th[:-1]))
    # Places of all documents on one line, each document beyond the one before.
    base = np.cumsum(other) * (int((r.pos + r.n).max()) + 2)
    end = np.maximum.accumulate(base + r.pos + r.n)
    new = np.append(True, (base + r.pos)[1:] > end[:-1])
    at = np.flatnonzero(new)
    out = r.take(at)
    out.n = end[np.append(at[1:], len(end)) - 1] - (base + r.pos)[at]
    return out


def _emit(r: substring._Rows, common: substring._Common) -> Iterator[pa.RecordBatch]:
    """A task's own repeats are removed spans already; their first stands for all."""
    r = r.take(np.lexsort((r.pos, r.rank, r.h, r.route)))
    first = np.append(True, (r.route[1:] != r.route[:-1]) | (r.h[1:] != r.h[:-1]))
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    same = ~first & (r.rank == r.rank[head]) & (r.pos == r.pos[head])
    at = np.flatnonzero(first)
    before, again, _ = common.meet(r.take(at))
    same[at[again]] = True  # a repeated row; its record has gone out
    path = first.copy()
    path[at[before | again]] = False
    yield _batch(PATH, r.take(np.flatnonzero(path)))
    yield _batch(GONE, _merged(r.take(np.flatnonzero(~path & ~same))))


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each place on."""
    at = np.arange(len(data) - size + 1)
    return text.Rolling(text.mix(data.astype(np.uint64) + np.uint64(1)))(at, at + size)


def _paths(window: int, size: int, hot: frozenset[int]):
    hot_routes = np.array(sorted(hot), np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = substring._Common()
        for batch in _slices(batches):
            data, offsets = text.strings(batch.column("row").field("text"))
            if len(data) < window:
                continue
            doc, th, rank = substring._ids(batch)
            grams = _grams(data, size)
            least = substring._minimizers(grams, window - size + 1)
            inside = np.zeros(len(data) + 1, np.int8)  # windows that lie in one document
            ends = offsets[1:] - window + 1
            own = ends > offsets[:-1]
            np.add.at(inside, offsets[:-1][own], 1)
            np.add.at(inside, ends[own], -1)
            s = np.flatnonzero(np.cumsum(inside[: len(least)], dtype=np.int8))
            if not len(s):
                continue
            new = np.append(True, (np.diff(s) != 1) | (np.diff(least[s]) != 0))
            a = s[new]
            n = np.diff(np.append(np.flatnonzero(new), len(s)))
            route = grams[least[a]]
            raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
            if len(hot_routes) and (often := np.isin(route, hot_routes)).any():
                each = np.repeat(a[often], n[often]) + np.arange(n[often].sum()) - np.repeat(np.cumsum(n[often]) - n[often], n[often])
                a, n = np.concatenate((a[~often], each)), np.concatenate((n[~often], np.ones(len(each), n.dtype)))
                route = np.concatenate((route[~often], np.array([digest(raw[x : x + window], 1) for x in each.tolist()], np.uint64)))
            h = np.array([digest(raw[x:y]) for x, y in zip(a.tolist(), (a + n + window - 1).tolist())], np.uint64)
            d = np.searchsorted(offsets, a, "right") - 1
            yield from _emit(substring._Rows(route, h, np.zeros(len(h), np.uint64), doc[d], th[d], rank[d], a - offsets[d], n), common)

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``SLICE`` bytes of text, where the text is a field of ``row``."""
    for batch in batches:
        place = pa.RecordBatch.from_arrays([batch.column("row").field("text"), pa.array(np.arange(batch.num_rows))], names=["text", "at"])
        for part in text.slices(iter([place]), limit=SLICE):
            yield batch.slice(part.column("at")[0].as_py(), part.num_rows)


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed spans, and the distinct segments of minimizers with more than one, among rows sorted by route, content and coordinate.

    The first segment of the content being read is carried from batch to batch, and with it
    whether it went out as one to compare.
    """
    carry, is_open = None, False
    for batch in batches:
        kind, route, h, doc, th, pos, n = (np.asarray(x) for x in batch.columns)
        none = np.zeros(len(doc), np.int64)
        r = substring._Rows(route.view(np.uint64), h.view(np.uint64), none, doc, th, none, pos.astype(np.int64), n.astype(np.int64))
        gone = np.flatnonzero(kind == GONE)
        if len(gone):
            yield _batch(GONE, r.take(gone))
        if len(gone) == len(kind):
            continue
        r = r.take(np.flatnonzero(kind != GONE))
        if carry is not None:
            r = substring._Rows(*(np.concatenate((x, y)) for x, y in zip(vars(carry).values(), vars(r).values())))
        other = np.append(True, r.route[1:] != r.route[:-1])
        first = other.copy()
        first[1:] |= r.h[1:] != r.h[:-1]
        head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        later = np.flatnonzero(~first & ~((r.doc == r.doc[head]) & (r.th == r.th[head]) & (r.pos == r.pos[head])))
        if len(later):
            yield _batch(GONE, _merged(r.take(later)))
        group = np.cumsum(other) - 1
        several = first & (np.bincount(group, weights=first) > 1)[group]
        out = several.copy()
        out[0] &= not (carry is not None and is_open)
        if out.any():
            yield _batch(OPEN, r.take(np.flatnonzero(out)))
        last = int(head[-1])
        is_open = bool(several[last]) or (last == 0 and is_open and carry is not None)
        carry = r.take(np.array([last]))


def _segments(window: int):
    """The bytes of the spans that documents were joined with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            data, offsets = text.strings(batch.column("row").field("text"))
            raw, begin = data.tobytes(), offsets.tolist()
            doc, th, _ = substring._ids(batch)
            places = [(i, s) for i, spans in enumerate(batch.column("spans").to_pylist()) for s in spans]
            row = np.array([i for i, _ in places], np.int64)
            cut = [raw[begin[i] + s["pos"] : begin[i] + s["pos"] + s["n"] + window - 1] for i, s in places]
            columns = [pa.array([s["route"] for _, s in places], pa.int64()), pa.array(doc[row]), pa.array(th[row]), *(pa.array([s[c] for _, s in places], pa.int32()) for c in ("pos", "n")), pa.array(cut, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SEGMENTS.split(", ")])

    return run


def repeated(segments: list[bytes], counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of the windows that occur at an earlier place of some segments, the first ``counts`` windows of each."""
    size = np.fromiter(map(len, segments), np.int64, len(segments))
    data = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    ends = np.cumsum(size + 1) - 1
    # Each segment ends with a symbol of its own, and all with the least of all.
    symbols = data.astype(np.int64) + len(segments) + 1
    symbols[ends] = np.arange(1, len(segments) + 1)
    rank = ranks(np.append(symbols, 0))
    begin = ends - size
    starts = np.repeat(begin, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    order = starts[np.argsort(rank[starts])]
    before = np.full(len(data), -1, np.int64)
    before[order[1:]] = order[:-1]
    prefix = np.zeros(len(data), np.int64)
    prefix[starts] = permuted_prefixes(data, starts, before[starts], window)
    joins = prefix[order] >= window
    group = np.flatnonzero(~joins)
    earliest = np.repeat(np.minimum.reduceat(order, group), np.diff(np.append(group, len(order))))
    gone = np.sort(order[order != earliest])
    of = np.searchsorted(ends, gone)
    return of, gone - begin[of]


def _shards(window: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            counts = np.asarray(table.column("n").combine_chunks()).astype(np.int64)
            of, at = repeated(table.column("bytes").to_pylist(), counts, window)
            if len(of):
                doc, th, pos = (np.asarray(table.column(c).combine_chunks()) for c in ("doc_id", "th", "pos"))
                none = np.zeros(len(of), np.uint64)
                yield _batch(GONE, _merged(substring._Rows(none, none, none, doc[of], th[of], of, pos[of] + at, np.ones(len(of), np.int64))))

        for batch in batches:
            if not batch.num_rows:
                continue
            route = np.asarray(batch.column("route"))
            length = np.asarray(pc.binary_length(batch.column("bytes"))).astype(np.int64)
            cuts = np.append(np.flatnonzero(np.append(last is not None and route[0] != last, route[1:] != route[:-1])), len(route))
            a, filled = 0, np.append(0, np.cumsum(length))
            for b in cuts.tolist():  # a shard ends only where a minimizer's segments do
                if b == len(route) or size + filled[b] - filled[a] >= shard:
                    held.append(batch.slice(a, b - a))
                    size, a = size + int(filled[b] - filled[a]), b
                    if b < len(route):
                        yield from flush()
                        held, size = [], 0
            last = route[-1]
        if held:
            yield from flush()

    return run


def _windows(window: int):
    """Digests and coordinates of the windows of spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            data, offsets = text.strings(batch.column("row").field("text"))
            raw, begin = data.tobytes(), offsets.tolist()
            doc, th, _ = substring._ids(batch)
            row, pos, n = substring._spans(batch)
            d = np.repeat(row, n)
            p = np.repeat(pos, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = (np.array(begin)[d] + p).tolist()
            digests = [pa.array(np.array([xxhash.xxh3_64_intdigest(raw[x : x + window], seed) for x in at], np.uint64).view(np.int64)) for seed in (1, 2)]
            yield pa.RecordBatch.from_arrays([*digests, pa.array(doc[d]), pa.array(th[d]), pa.array(p.astype(np.int32))], names=["h", "g", "doc_id", "th", "pos"])

    return run


def _by_digest(open_: DataFrame, window: int) -> DataFrame:
    """Removed windows of minimizers with too many segments for a shard."""
    found = shared.arrow(open_, _windows(window), "h long, g long, doc_id long, th long, pos int")
    place = F.struct("doc_id", "th", "pos")
    least = found.groupBy(F.col("h").alias("h1"), F.col("g").alias("g1")).agg(F.min(place).alias("least"), F.count("*").alias("k")).filter("k > 1")
    gone = found.join(least, (F.col("h") == F.col("h1")) & (F.col("g") == F.col("g1"))).filter(place > F.col("least"))
    zero = F.lit(0).cast("long")
    return gone.select(F.lit(GONE).cast("byte").alias("kind"), zero.alias("route"), zero.alias("h"), "doc_id", "th", "pos", F.lit(1).alias("n"))


def _hot(keyed: DataFrame, window: int, size: int, share: float, fraction: float) -> frozenset[int]:
    """The most common minimizers of a sample of documents, 1 / share at most."""
    sample = shared.arrow(keyed.sample(fraction, 7), _paths(window, size, frozenset()), ROWS).filter(f"kind = {PATH}")
    rows = sample.groupBy("route").count().filter("count >= 8").orderBy(F.desc("count"), "route").limit(int(1 / share)).collect()
    return frozenset(r["route"] for r in rows)


def _gone(keyed: DataFrame, window: int, size: int, most: int, share: float, fraction: float, shard: int) -> DataFrame:
    """Rows of the spans to remove."""
    tasks = shared.partitions(keyed.sparkSession)
    paths = shared.arrow(keyed, _paths(window, size, _hot(keyed, window, size, share, fraction)), ROWS)
    ordered = paths.repartition(tasks, "route").sortWithinPartitions("route", "h", "doc_id", "th", "pos")
    found = shared.stored(shared.arrow(ordered, _resolve, ROWS), "segments")
    several = found.filter(f"kind = {OPEN}")
    large = several.groupBy("route").count().filter(F.col("count") > most).select(F.col("route").alias("large"))
    told = several.join(large, F.col("route") == F.col("large"), "left")

    def of(spans: DataFrame) -> DataFrame:
        return keyed.join(substring._listed(spans, "pos", "n", "route"), substring._same()).select("row", "doc", "th", "spans")

    cut = shared.arrow(of(told.filter("large is null")), _segments(window), SEGMENTS)
    dealt = cut.repartition(tasks, "route").sortWithinPartitions("route", "doc_id", "th", "pos")
    by_array = shared.arrow(dealt, _shards(window, shard), ROWS)
    return found.filter(f"kind = {GONE}").union(by_array).union(_by_digest(of(told.filter("large is not null")), window))


def _apply(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            data, offsets = text.strings(batch.column("row").field("text"))
            row, pos, n = substring._spans(batch)
            change = np.zeros(len(data) + 1, np.int64)
            np.add.at(change, offsets[row] + pos, 1)
            np.add.at(change, offsets[row] + pos + n + window - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            begins = gone.copy()  # a removed run ends with its document
            begins[1:] &= ~gone[:-1]
            inner = offsets[1:-1][offsets[1:-1] < len(data)]
            begins[inner] = gone[inner]
            kept, runs = (np.concatenate(([0], np.cumsum(x)))[offsets] for x in (~gone, begins))
            left = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(np.ascontiguousarray(kept)), pa.py_buffer(data[~gone].tobytes())]).cast(pa.binary())
            total = np.diff(offsets)
            yield pa.RecordBatch.from_arrays([batch.column("row"), left, *(pa.array(x) for x in (total, total - np.diff(kept), np.diff(runs)))], names=["row", *NEW])

    return run


def dedup(docs: DataFrame, window: int = 100, size: int = 32, most: int = 5_000, share: float = 1 / 1000, fraction: float = 0.02, shard: int = SHARD) -> DataFrame:
    """All columns of docs (doc_id and text among them), with __kept (bytes), __n_bytes, __n_removed and __n_spans.

    ``size`` is that of minimizers, ``most`` the most distinct segments of one that a shard takes.
    """
    keyed = substring._keyed(docs)
    gone = _gone(keyed, window, size, most, share, fraction, shard)
    full = keyed.join(substring._listed(gone, "pos", "n"), substring._same(), "left").select("row", "doc", "th", "spans")
    done = shared.arrow(full, _apply(window), shared.fields(docs, "__kept binary, __n_bytes long, __n_removed long, __n_spans long"))
    return shared.unwrapped(done, docs, *NEW)
