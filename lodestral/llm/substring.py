"""Removal of repeated word spans by De Bruijn path compaction.

A window of 20 words is an edge between its first and last 19 words.  Edges that follow
one another in a document and share their minimizer (the least 6-word hash inside the
window) form a nonbranching path; about one path stands for eight windows.  Paths of
equal content compact to one record at their first source coordinate, and every later
occurrence is known to repeat in full.  Where different paths share a minimizer the
graph may branch: the first occurrences of such paths are joined with their documents
and compared edge by edge.  Coordinates (doc_id, word position) decide what is earlier,
and a word is removed if a repeated window covers it.

Every record carries, with its coordinates, two hashes of its path (minimizer and
content, from rolling word hashes) and an independent digest of the very bytes of the
words there (XXH3 of the words joined by spaces).  An occurrence counts as a repeat only
where the digest of its own words is that at the coordinates of the first, so no equality
rests on the rolling hashes alone.  ``audit`` goes further and compares the words of long
spans in the documents themselves.

Each map task compacts what it sees: repeats within a slice of 2 MB, and those of the
contents that its table of common ones holds, so a copied passage reaches the shuffle a
few times a task.  Minimizers found very common in a small sample of documents are dealt
out by whole windows (this changes only where rows meet, not what is found).  Rows of a
partition are sorted by Spark, which may spill, and read as a stream.

Defined cases: a null text has no words; texts under 20 words lose nothing; a text may be
as long as a row can be; null doc_ids sort first.  Rows that share a doc_id are told apart
by a hash of their text, and rows equal in both are one document: they don't repeat each
other.  An empty table gives no rows; all columns of the input are kept, but those with
the names of new ones (``__kept``, ``__n_words``, ``__n_removed``), which give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lodestral.llm import shared, text

ROWS = "kind byte, route long, h long, check long, doc_id long, th long, pos int, n int"
_NAMES = [c.split()[0] for c in ROWS.split(", ")]
#: With sources, a removed span also tells the place of an earlier occurrence.
SOURCES = ", s_doc long, s_th long, s_pos int"
_BITS = 27
_LOW = np.uint64((1 << _BITS + 1) - 1)
#: Kinds of rows: removed span, path to resolve edge by edge, path to compact.
GONE, OPEN, PATH = 0, 1, 2
NEW = ("__kept", "__n_words", "__n_removed")


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours."""
    step, out = 1, x
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[: len(out) - (width - step)], out[width - step :]) if width > step else out


def _minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each ``width`` neighbours, the first of equal ones; in blocks, as a place has 27 bits."""
    n = len(grams) - width + 1
    out = np.empty(n, np.int64)
    for a in range(0, n, 1 << _BITS):
        b = min(n, a + (1 << _BITS))
        part = grams[a : b + width - 1]
        out[a:b] = (_least(part & ~_LOW | np.arange(len(part), dtype=np.uint64), width) & _LOW).astype(np.int64) + a
    return out


def _texts(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("row").field("text")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about 2 MB of text, where the text is a field of ``row``."""
    for batch in batches:
        place = pa.RecordBatch.from_arrays([_texts(batch), pa.array(np.arange(batch.num_rows))], names=["text", "at"])
        for part in text.slices(iter([place])):
            yield batch.slice(part.column("at")[0].as_py(), part.num_rows)


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_id (null: least), text hash, and the dense rank of each row by both."""
    doc = np.asarray(batch.column("doc").fill_null(np.iinfo(np.int64).min))
    th = np.asarray(batch.column("th"))
    order = np.lexsort((th, doc))
    step = np.zeros(len(doc), np.int64)
    step[1:] = (doc[order][1:] != doc[order][:-1]) | (th[order][1:] != th[order][:-1])
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.cumsum(step)
    return doc, th, rank


class _Words:
    """Words of a batch: their hashes, the first word of each text, and digests of the bytes of word ranges."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = text.strings(_texts(batch))
        start, end, self.first = text.words(data, offsets)
        self.hashes = text.word_hashes(data, start, end)
        raw = data.tobytes()
        parts = (raw[a:b].split() for a, b in zip(offsets.tolist(), offsets[1:].tolist()))
        self.joined = b" ".join([w for part in parts for w in part])
        self.end = np.cumsum(end - start) + np.arange(len(start))
        self.start = self.end - (end - start)

    def digests(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        joined, digest = self.joined, xxhash.xxh3_64_intdigest
        return np.array([digest(joined[x:y]) for x, y in zip(self.start[a].tolist(), self.end[b - 1].tolist())], np.uint64)


class _Rows:
    """Records of paths as columns."""

    def __init__(self, route, h, check, doc, th, rank, pos, n):
        self.route, self.h, self.check, self.doc, self.th, self.rank, self.pos, self.n = route, h, check, doc, th, rank, pos, n

    def take(self, at: np.ndarray) -> _Rows:
        return _Rows(*(x[at] for x in vars(self).values()))


class _Common:
    """Contents met before by this task, with their least coordinates, in a table of fixed size.

    An entry that is met again is kept while others come and go.
    """

    def __init__(self, bits: int = 18):
        size = 1 << bits
        self.mask = np.uint64(size - 1)
        self.route, self.h, self.check = (np.zeros(size, np.uint64) for _ in range(3))
        self.doc, self.th, self.pos = (np.zeros(size, np.int64) for _ in range(3))
        self.worth = np.full(size, -1, np.int32)  # -1: empty

    def meet(self, r: _Rows) -> tuple[np.ndarray, np.ndarray, tuple]:
        """(seen at a lesser coordinate, seen at this one, that coordinate) of contents that differ from one another."""
        slot = (text.mix(r.h ^ r.check) & self.mask).astype(np.int64)
        known = (self.worth[slot] >= 0) & (self.route[slot] == r.route) & (self.h[slot] == r.h) & (self.check[slot] == r.check)
        d, t, p = self.doc[slot], self.th[slot], self.pos[slot]
        same = known & (d == r.doc) & (t == r.th) & (p == r.pos)
        before = known & ~same & ((d < r.doc) | (d == r.doc) & ((t < r.th) | (t == r.th) & (p < r.pos)))
        self.worth[slot[known]] += 1
        enter = np.flatnonzero(~before & ~same)
        enter = enter[np.unique(slot[enter], return_index=True)[1]]
        fresh = ~known[enter]
        self.worth[slot[enter[fresh]]] -= 1
        enter = enter[~fresh | (self.worth[slot[enter]] < 0)]
        at = slot[enter]
        self.worth[at] = np.maximum(self.worth[at], 0)
        for mine, theirs in ((self.route, r.route), (self.h, r.h), (self.check, r.check), (self.doc, r.doc), (self.th, r.th), (self.pos, r.pos)):
            mine[at] = theirs[enter]
        return before, same, (d, t, p)


def _batch(kind, r: _Rows, source=None) -> pa.RecordBatch:
    """Records as a batch; of removed spans the hashes are left out."""
    kinds = np.broadcast_to(np.asarray(kind, np.int8), len(r.pos))
    path = kinds == PATH
    longs = [np.where(path, r.route, text.mix(np.arange(len(path), dtype=np.uint64) ^ r.h)), np.where(path, r.h, np.uint64(0)), np.where(path, r.check, np.uint64(0))]
    columns = [pa.array(np.ascontiguousarray(kinds)), *(pa.array(x.view(np.int64)) for x in longs), pa.array(r.doc), pa.array(r.th), pa.array(r.pos.astype(np.int32)), pa.array(r.n.astype(np.int32))]
    if source is None:
        return pa.RecordBatch.from_arrays(columns, names=_NAMES)
    return pa.RecordBatch.from_arrays([*columns, pa.array(source[0]), pa.array(source[1]), pa.array(source[2].astype(np.int32))], names=[*_NAMES, "s_doc", "s_th", "s_pos"])


def _emit(r: _Rows, common: _Common, sources: bool) -> pa.RecordBatch:
    """A task's own repeats are removed spans already; their first stands for all."""
    r = r.take(np.lexsort((r.pos, r.rank, r.check, r.h, r.route)))
    first = np.ones(len(r.h), bool)
    first[1:] = (r.route[1:] != r.route[:-1]) | (r.h[1:] != r.h[:-1]) | (r.check[1:] != r.check[:-1])
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    same = ~first & (r.rank == r.rank[head]) & (r.pos == r.pos[head])
    source = [x[head] for x in (r.doc, r.th, r.pos)]
    at = np.flatnonzero(first)
    before, again, place = common.meet(r.take(at))
    for mine, known in zip(source, place):
        mine[at[before]] = known[before]
    same[at[again]] = True  # a repeated row; its record has gone out
    kind = np.where(first, PATH, GONE)
    kind[at[before]] = GONE
    keep = np.flatnonzero(~same)
    return _batch(kind[keep], r.take(keep), [x[keep] for x in source] if sources else None)


def _paths(window: int, size: int, hot: frozenset[int], sources: bool = False):
    hot_routes = np.array(sorted(hot), np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = _Common()
        for batch in _slices(batches):
            w = _Words(batch)
            if len(w.hashes) < window:
                continue
            doc, th, rank = _ids(batch)
            roll = text.Rolling(w.hashes)
            at = np.arange(len(w.hashes) - size + 1)
            grams = roll(at, at + size)
            least = _minimizers(grams, window - size + 1)
            owner = np.repeat(np.arange(len(doc)), np.diff(w.first))
            s = np.arange(len(least))
            s = s[s + window <= w.first[owner[s] + 1]]
            if not len(s):
                continue
            new = np.concatenate(([True], (np.diff(s) != 1) | (np.diff(least[s]) != 0)))
            a = s[new]
            n = np.diff(np.concatenate((np.flatnonzero(new), [len(s)])))
            route = grams[least[a]]
            if len(hot_routes):
                often = np.isin(route, hot_routes)
                each = np.repeat(a[often], n[often]) + np.arange(n[often].sum()) - np.repeat(np.cumsum(n[often]) - n[often], n[often])
                a = np.concatenate((a[~often], each))
                n = np.concatenate((n[~often], np.ones(len(each), n.dtype)))
                whole = roll(each, each + window)
                route = np.concatenate((route[~often], text.mix(whole ^ grams[least[each]])))
            end = a + n + window - 1
            h = text.mix(roll(a, end) ^ (least[a] - a).astype(np.uint64))
            d = owner[a]
            yield _emit(_Rows(route, h, w.digests(a, end), doc[d], th[d], rank[d], a - w.first[d], n), common, sources)

    return run


def _resolve(branches: bool, sources: bool = False):
    """Removed spans among records sorted by content and coordinate, and with ``branches`` paths that share a minimizer.

    The head of the content being read is carried from batch to batch, and with it
    whether it went out as a path to resolve.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, is_open = None, False
        for batch in batches:
            kind, route, h, check, doc, th, pos, n, *source = (np.asarray(x) for x in batch.columns)
            r = _Rows(route.view(np.uint64), h.view(np.uint64), check.view(np.uint64), doc, th, np.zeros(len(doc), np.int64), pos.astype(np.int64), n.astype(np.int64))
            gone = np.flatnonzero(kind == GONE)
            if len(gone):
                yield _batch(GONE, r.take(gone), [x[gone] for x in source] or None)
            if len(gone) == len(kind):
                continue
            r = r.take(np.flatnonzero(kind != GONE))
            if carry is not None:
                r = _Rows(*(np.concatenate((x, y)) for x, y in zip(vars(carry).values(), vars(r).values())))
            other = np.ones(len(r.h), bool)
            other[1:] = r.route[1:] != r.route[:-1]
            first = other.copy()
            first[1:] |= (r.h[1:] != r.h[:-1]) | (r.check[1:] != r.check[:-1])
            head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
            later = np.flatnonzero(~first & ~((r.doc == r.doc[head]) & (r.th == r.th[head]) & (r.pos == r.pos[head])))
            if len(later):
                yield _batch(GONE, r.take(later), [x[head[later]] for x in (r.doc, r.th, r.pos)] if sources else None)
            group = np.cumsum(other) - 1
            branched = first & (np.bincount(group, weights=first) > 1)[group]
            out = branched.copy()
            out[0] &= not (carry is not None and is_open)
            out = np.flatnonzero(out)
            if branches and len(out):
                yield _batch(OPEN, r.take(out), [x[out] for x in (r.doc, r.th, r.pos)] if sources else None)
            last = int(head[-1])
            is_open = bool(branched[last]) or (last == 0 and is_open and carry is not None)
            carry = r.take(np.array([last]))

    return run


def _spans(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and count of each span of a batch."""
    spans = batch.column("spans")
    if isinstance(spans, pa.ChunkedArray):
        spans = spans.combine_chunks()
    row = np.repeat(np.arange(len(spans)), np.asarray(spans.value_lengths().fill_null(0)))
    flat = spans.flatten()
    return row, np.asarray(flat.field("pos"), np.int64), np.asarray(flat.field("n"), np.int64)


def _edges(window: int, sources: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = _Common()
        for batch in _slices(batches):
            w = _Words(batch)
            doc, th, rank = _ids(batch)
            row, pos, n = _spans(batch)
            d = np.repeat(row, n)
            p = np.repeat(pos, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a = w.first[d] + p
            h = text.Rolling(w.hashes)(a, a + window)
            route = text.Rolling(text.mix(w.hashes ^ np.uint64(0x5851F42D4C957F2D)))(a, a + window)
            yield _emit(_Rows(route, h, w.digests(a, a + window), doc[d], th[d], rank[d], p, np.ones(len(p), np.int64)), common, sources)

    return run


def _apply(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            data, offsets = text.strings(_texts(batch))
            start, end, first = text.words(data, offsets)
            row, pos, n = _spans(batch)
            change = np.zeros(len(start) + 1, np.int64)
            np.add.at(change, first[row] + pos, 1)
            np.add.at(change, first[row] + pos + n + window - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            raw = data.tobytes()
            kept = []
            touched = np.zeros(batch.num_rows, bool)
            touched[row] = True
            for i in range(batch.num_rows):
                a, b = first[i], first[i + 1]
                if touched[i]:
                    k = np.flatnonzero(~gone[a:b]) + a
                    kept.append(b" ".join([raw[x:y] for x, y in zip(start[k].tolist(), end[k].tolist())]))
                else:
                    kept.append(b" ".join(raw[offsets[i] : offsets[i + 1]].split()))
            removed = np.concatenate(([0], np.cumsum(gone)))
            new = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(np.diff(first)), pa.array(removed[first[1:]] - removed[first[:-1]])]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *new], names=["row", *NEW])

    return run


def _hot(keyed: DataFrame, window: int, size: int, share: float, fraction: float) -> frozenset[int]:
    """The most common minimizers of a sample of documents, 1 / share at most."""
    sample = shared.arrow(keyed.sample(fraction, 7), _paths(window, size, frozenset()), ROWS).filter(f"kind = {PATH}")
    rows = sample.groupBy("route").count().filter("count >= 8").orderBy(F.desc("count"), "route").limit(int(1 / share)).collect()
    return frozenset(r["route"] for r in rows)


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, doc, th): whole rows, doc_id as a long and, only where ids repeat or are null, a hash of the text."""
    plain = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty()
    return shared.wrapped(docs, F.col("doc_id").cast("long").alias("doc"), (F.lit(0).cast("long") if plain else F.xxhash64("text")).alias("th"))


def _same():
    return (F.coalesce(F.col("doc"), F.lit(-(1 << 63))) == F.col("d")) & (F.col("th") == F.col("t"))


def _listed(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_list(F.struct(*columns)).alias("spans")).hint("shuffle_hash")


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition(shared.partitions(rows.sparkSession), "route").sortWithinPartitions("route", "h", "check", "doc_id", "th", "pos")


def _gone(keyed: DataFrame, window: int, size: int, share: float, fraction: float, sources: bool) -> DataFrame:
    """Rows of the spans to remove."""
    rows = ROWS + SOURCES * sources
    paths = shared.arrow(keyed, _paths(window, size, _hot(keyed, window, size, share, fraction), sources), rows)
    found = shared.stored(shared.arrow(_sorted(paths), _resolve(True, sources), rows), "paths")
    open_ = keyed.join(_listed(found.filter(f"kind = {OPEN}"), "pos", "n"), _same()).select("row", "doc", "th", "spans")
    edges = shared.arrow(open_, _edges(window, sources), rows)
    return found.filter(f"kind = {GONE}").union(shared.arrow(_sorted(edges), _resolve(False, sources), rows))


def marked(docs: DataFrame, window: int = 20, size: int = 6, share: float = 1 / 1000, fraction: float = 0.02) -> DataFrame:
    """(row, __kept, __n_words, __n_removed) of each row of docs.

    Documents meet their spans twice, by the same exchange of (row, doc, th).
    """
    keyed = _keyed(docs)
    gone = _gone(keyed, window, size, share, fraction, False)
    full = keyed.join(_listed(gone, "pos", "n"), _same(), "left").select("row", "doc", "th", "spans")
    return shared.arrow(full, _apply(window), shared.fields(docs, "__kept string, __n_words long, __n_removed long"))


def dedup(docs: DataFrame, window: int = 20, size: int = 6, share: float = 1 / 1000, fraction: float = 0.02) -> DataFrame:
    """All columns of docs (doc_id and text among them), with __kept, __n_words and __n_removed."""
    return shared.unwrapped(marked(docs, window, size, share, fraction), docs, *NEW)


def shortened(docs: DataFrame, window: int = 20) -> DataFrame:
    """The rows of docs with repeated words taken out of their texts (joined by one space then); all other columns stay.

    ``n_chars``, where there is such a column, becomes the length of the new text.
    """
    done = marked(docs, window)
    new = F.when(F.col("__n_removed") > 0, F.col("__kept")).otherwise(F.col("row").getField("text"))
    change = {"text": new, "n_chars": F.when(F.col("__n_removed") > 0, F.length("__kept").cast("long")).otherwise(F.col("row").getField("n_chars")) if "n_chars" in docs.columns else None}
    return done.select(*((change[c] if c in change else F.col("row").getField(c)).alias(c) for c in docs.columns))


def _merge_spans(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows in a row whose sources are in a row too make one long span."""
        for batch in batches:
            out = []
            for doc, th, spans in zip(*(batch.column(c).to_pylist() for c in ("d", "t", "spans"))):
                last = None
                for s in sorted(spans, key=lambda s: (s["s_doc"], s["s_th"], s["s_pos"] - s["pos"], s["pos"])):
                    key = (s["s_doc"], s["s_th"], s["s_pos"] - s["pos"])
                    if last and last[0] == key and s["pos"] <= last[2]:
                        last[2] = max(last[2], s["pos"] + s["n"])
                    else:
                        last = [key, s["pos"], s["pos"] + s["n"]]
                        out.append((doc, th, last))
            rows = [(doc, th, a, b - a + window - 1, k[0], k[1], a + k[2]) for doc, th, (k, a, b) in out]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "th", "pos", "n", "s_doc", "s_th", "s_pos"])

    return run


def repeats(docs: DataFrame, window: int = 20, size: int = 6, share: float = 1 / 1000, fraction: float = 0.02) -> DataFrame:
    """Long repeated spans with a source: (doc_id, th, pos, n, s_doc, s_th, s_pos), positions and lengths in words.

    th and s_th are 0 unless ids repeat; a null doc_id shows as the least long.
    """
    gone = _gone(_keyed(docs), window, size, share, fraction, True)
    return shared.arrow(_listed(gone, "pos", "n", "s_doc", "s_th", "s_pos"), _merge_spans(window), "doc_id long, th long, pos int, n int, s_doc long, s_th long, s_pos int")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the words at each asked place."""
    for batch in _slices(batches):
        w = _Words(batch)
        rows = []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            for s in spans:
                a = w.first[i] + s["pos"]
                rows.append((s["span"], sha256(w.joined[w.start[a] : w.end[a + s["n"] - 1]]).digest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["span", "digest"])


def audit(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans of ``repeats`` whose words differ from those at their source coordinates, or whose source isn't earlier.

    Both coordinates are looked up in the documents themselves; nothing is taken from the
    hashes that found the spans.  Expected to be empty.
    """
    spans = shared.stored(spans.withColumn("span", F.xxhash64("doc_id", "th", "pos", "n", "s_doc", "s_th", "s_pos")), "spans")
    ends = spans.select("doc_id", "th", "pos", "n", "span").union(spans.select("s_doc", "s_th", "s_pos", "n", "span"))
    keyed = _keyed(docs.select("doc_id", "text")).dropDuplicates(["doc", "th"])
    asked = keyed.join(_listed(ends, "pos", "n", "span"), _same()).select("row", "spans")
    odd = shared.arrow(asked, _digests, "span long, digest binary").groupBy("span").agg(F.count("*").alias("k"), F.count_distinct("digest").alias("d")).filter("k <> 2 or d <> 1").select("span")
    late = F.struct("s_doc", "s_th", "s_pos") >= F.struct(F.col("doc_id").alias("s_doc"), F.col("th").alias("s_th"), F.col("pos").alias("s_pos"))
    return spans.join(odd, "span", "left_semi").union(spans.filter(late)).drop("span")
