"""SimHash near-duplicates by a binary-trie self-join over fingerprints.

``fingerprints`` reads each whole text once.  Equal fingerprints form one class, so
copies never meet in pairs.  The classes are joined with themselves: 64 bits fall into
three blocks, and of two fingerprints at most two bits apart one block agrees; of the
rest, cut in three again, one part agrees too.  Each fingerprint so goes under nine keys
of about 36 bits.  Under a key the tail bits form a binary trie whose node pairs are
traversed together, adding up differing bits and dropping a pair beyond the budget.
A task hands on a spanning forest of the links it found, and components follow from
star contractions over tables, written to the shared folder each round.

Defined cases: a null or wordless text has fingerprint zero and links like any other;
null doc_ids take part but give no component id unless all ids of it are null; rows with
the same doc_id count as documents of their own, and of ties and repeated rows each has its
row and the same component; a text may be as long as a row can be (its shingles are counted
in blocks); an empty table gives no rows.  ``near_duplicates`` reads doc_id and text alone and
``distinct`` keeps whole rows as structs, so no other column can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lodestral.llm import shared, text

BLOCKS = ((0, 22), (22, 43), (43, 64))


def fingerprint(value: str, size: int = 3) -> int:
    words = value.encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, 42)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    n = len(words) - size + 1
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, n, 1 << 16):
        b = min(n, a + (1 << 16))
        h = np.array([digest(joined[x:y], 42) for x, y in zip(start[a:b].tolist(), end[a + size - 1 : b + size - 1].tolist())], "<u8")
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.slices(batches):
            values = np.array([fingerprint(t or "", size) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp): XXH64 SimHash over word shingles, as a signed long."""
    return shared.arrow(docs.select(F.col("doc_id").cast("long"), "text"), _fingerprints(size), "doc_id long, fp long")


def _layout(tag: int, blocks=BLOCKS, parts: int = 3) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Bit ranges of key and tail for one of the keys: a block and, with ``parts`` 3, a third of the rest.

    Of at most two differing bits one block of three is free; of the other two blocks,
    cut in three again, one part is free as well.
    """
    block, part = divmod(tag, parts)
    rest = [bit for i, (a, b) in enumerate(blocks) if i != block for bit in range(a, b)]
    runs = lambda bits: [(min(g), max(g) + 1) for g in _consecutive(bits)]
    if parts == 1:
        return [blocks[block]], runs(rest)
    cut = [round(i * len(rest) / parts) for i in range(parts + 1)]
    return [blocks[block], *runs(rest[cut[part] : cut[part + 1]])], runs(rest[: cut[part]] + rest[cut[part + 1] :])


def _consecutive(bits: list[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for b in bits:
        if out and out[-1][-1] + 1 == b:
            out[-1].append(b)
        else:
            out.append([b])
    return out


def _mask(ranges: list[tuple[int, int]]) -> int:
    return sum(((1 << b - a) - 1) << a for a, b in ranges)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _take(values: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(values), np.uint64)
    for a, b in ranges:
        out = out << np.uint64(b - a) | (values >> np.uint64(a)) & np.uint64((1 << b - a) - 1)
    return out


def trie_pairs(group: np.ndarray, tail: np.ndarray, bits: int, budget: int, root: np.ndarray | None = None, leaf: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one group whose tails may differ in at most ``budget`` bits.

    Rows are sorted by (group, tail).  Nodes of the tries are row ranges; the frontier
    holds node pairs of one depth with the bits they differ in so far.  A pair of at most
    ``leaf`` row pairs is handed out to be compared in full.  With ``root``, node pairs
    that lie within one known component are left out.
    """
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    wide = np.diff(edges) > 1
    u = v = np.stack([edges[:-1][wide], edges[1:][wide]], axis=1)
    err = np.zeros(len(u), np.int64)
    colour = None if root is None else np.concatenate(([0], np.cumsum(root[1:] != root[:-1])))
    for depth in range(bits + 1):
        if not len(u):
            return
        size = (u[:, 1] - u[:, 0]) * (v[:, 1] - v[:, 0])
        small = (size <= leaf) | (depth == bits)
        for at in range(0, int(small.sum()), 1 << 14):
            some = np.flatnonzero(small)[at : at + (1 << 14)]
            n, width = size[some], (v[some, 1] - v[some, 0])
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w = np.repeat(width, n)
            x, y = np.repeat(u[some, 0], n) + k // w, np.repeat(v[some, 0], n) + k % w
            yield x[x != y], y[x != y]
        u, v, err = u[~small], v[~small], err[~small]
        if depth == bits or not len(u):
            return
        ones = np.concatenate(([0], np.cumsum((tail >> np.uint64(bits - 1 - depth) & np.uint64(1)).astype(np.int64))))

        def split(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            mid = node[:, 1] - (ones[node[:, 1]] - ones[node[:, 0]])  # noqa: B023
            return np.stack([node[:, 0], mid], axis=1), np.stack([mid, node[:, 1]], axis=1)

        u0, u1 = split(u)
        v0, v1 = split(v)
        apart = u[:, 0] != v[:, 0]
        u, v = np.concatenate([u0, u1, u0, u1[apart]]), np.concatenate([v0, v1, v1, v0[apart]])
        err = np.concatenate([err, err, err + 1, err[apart] + 1])
        keep = (err <= budget) & (u[:, 1] > u[:, 0]) & (v[:, 1] > v[:, 0])
        u, v, err = u[keep], v[keep], err[keep]
        if colour is not None:
            one = (colour[u[:, 1] - 1] == colour[u[:, 0]]) & (colour[v[:, 1] - 1] == colour[v[:, 0]]) & (root[u[:, 0]] == root[v[:, 0]])
            u, v, err = u[~one], v[~one], err[~one]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least row of each row's component, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]
    return root


def connect(group: np.ndarray, tail: np.ndarray, bits: int, budget: int, near, links: list | None = None) -> np.ndarray:
    """Components of rows under ``near``, found through the tries: the least row of each.

    Neighbours in trie order are tried first, so that a dense group is mostly one
    component before node pairs are traversed.  ``links`` gets near pairs that span the
    components.
    """
    n = len(group)
    i = np.arange(n)
    root = i
    for gap in (1, 2, 3, 5, 9, 17):
        x = i[:-gap][group[gap:] == group[:-gap]] if gap < n else i[:0]
        x = x[near(x, x + gap)]
        if links is not None:
            links.append(tree(root, x, x + gap))
        root = join(root, x, x + gap)
    for x, y in trie_pairs(group, tail, bits, budget, root):
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
        close = near(x, y)
        if links is not None:
            links.append(tree(root, x[close], y[close]))
        root = join(root, x[close], y[close])
    return root


def tree(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that merge components, one after the other."""
    up: dict[int, int] = {}

    def find(r: int) -> int:
        while r in up:
            if up[r] in up:
                up[r] = up[up[r]]
            r = up[r]
        return r

    at = []
    apart = np.flatnonzero(root[x] != root[y])
    for k, a, b in zip(apart.tolist(), root[x[apart]].tolist(), root[y[apart]].tolist()):
        a, b = find(a), find(b)
        if a != b:
            up[a] = b
            at.append(k)
    return x[at], y[at]


def join(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Components after more links."""
    if not len(x):
        return root
    merged = np.flatnonzero(root != np.arange(len(root)))
    return forest(np.concatenate([x, merged]), np.concatenate([y, root[merged]]), len(root))


def _links(budget: int, rows: int = 1 << 15):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        tags, values = np.asarray(table.column("tag")), np.asarray(table.column("fp")).view(np.uint64)
        for tag in np.unique(tags):
            fps = values[tags == tag]
            key, rest = _layout(int(tag))
            group, tail, bits = _take(fps, key), _take(fps, rest), sum(b - a for a, b in rest)
            order = np.lexsort((tail, group))
            fps, group, tail = fps[order], group[order], tail[order]
            ends = np.flatnonzero(np.concatenate((group[1:] != group[:-1], [True]))) + 1
            a = 0
            while a < len(fps):  # whole groups, about ``rows`` rows at a time
                b = int(ends[min(np.searchsorted(ends, a + rows), len(ends) - 1)])
                near = lambda x, y: np.bitwise_count(fps[a:b][x] ^ fps[a:b][y]) <= budget  # noqa: B023, E731
                root = connect(group[a:b], tail[a:b], bits, budget, near)
                linked = np.flatnonzero(root != np.arange(b - a))
                if len(linked):
                    yield pa.RecordBatch.from_arrays([pa.array(fps[a:b][linked].view(np.int64)), pa.array(fps[a:b][root[linked]].view(np.int64))], names=["a", "b"])
                a = b

    return run


def links(classes: DataFrame, budget: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all pairs within ``budget`` <= 2 bits."""
    if not 0 <= budget <= 2:
        raise ValueError("three blocks hold for at most two differing bits")
    keys = [F.struct(F.lit(t).alias("tag"), F.col("fp"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(_layout(t)[0])))).alias("key")) for t in range(9)]
    dealt = classes.select(F.explode(F.array(*keys)).alias("k")).select("k.*").repartition(shared.partitions(classes.sparkSession), "tag", "key")
    return shared.arrow(dealt.select("tag", "fp"), _links(budget), "a long, b long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the least node of each component, for nodes with an edge.

    Alternating large-star and small-star contraction; every round is a stored table.
    """
    now = shared.stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), name, few=True)
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        mark = seen
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*").filter("hi <> lo").distinct()
        now = shared.stored(small, name, few=True)


def near_duplicates(docs: DataFrame, size: int = 3, budget: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id reachable over links within ``budget`` bits."""
    prints = shared.stored(fingerprints(docs, size), "fingerprints")
    classes = shared.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes, budget)).withColumnRenamed("node", "fp")
    named = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # A stored side leaves the last join free to split a hot fingerprint.
    return prints.join(shared.stored(named.join(ids, "root").select("fp", "component_id"), "fingerprint-components", few=True), "fp").select("doc_id", "fp", "component_id")


#: Multipliers that part one shingle hash into independent ones.
_SEEDS = text.mix(np.arange(1, 17, dtype=np.uint64))
SLICE_BLOCKS = ((0, 11), (11, 22), (22, 32))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


BANDS, ROWS = 24, 4
_BAND_SEEDS = text.mix(np.arange(101, 101 + BANDS, dtype=np.uint64))
_MASKS = text.mix(np.arange(201, 201 + BANDS * ROWS, dtype=np.uint64))
_FACTORS = text.mix(np.arange(401, 401 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)


def _shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    data, offsets = text.strings(column)
    data = _LOWER[data]
    start, end, first = text.words(data, offsets)
    roll = text.Rolling(text.word_hashes(data, start, end))
    for a, b in zip(first.tolist(), first[1:].tolist()):
        at = np.arange(a, a if a == b else max(a + 1, b - size + 1))
        yield np.unique(roll(at, np.minimum(at + size, b)))


def _node(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of shingles, as two signed longs."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), "<i8").tolist())


def _sketch(shingles: np.ndarray, words64: int) -> bytes:
    counts = np.zeros((words64, 64), np.int64)
    for x in range(0, len(shingles), 1 << 15):
        h = shingles[x : x + (1 << 15)]
        for k in range(words64):
            counts[k] += np.unpackbits(text.mix(h ^ _SEEDS[k]).view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(shingles), axis=1, bitorder="little").tobytes()


def _minima(shingles: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for x in range(0, len(shingles), 1 << 12):
            np.minimum(out, ((shingles[x : x + (1 << 12), None] ^ _MASKS) * _FACTORS).min(axis=0), out=out)
    return out


def _prints(size: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.slices(batches):
            nodes, sketches, minima = [], [], []
            for s in _shingle_sets(batch.column("text"), size):
                nodes.append(_node(s))
                sketches.append(_sketch(s, tables // 2))
                minima.append(_minima(s))
            bands = np.array(minima).reshape(-1, BANDS, ROWS)
            keys = np.tile(_BAND_SEEDS, (len(bands), 1))
            for r in range(ROWS):
                keys = text.mix(keys ^ bands[:, :, r])
            columns = [pa.array([x[0] for x in nodes], pa.int64()), pa.array([x[1] for x in nodes], pa.int64()), pa.array(sketches, pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), *columns], names=["doc_id", "th", "node", "check", "sketch", "keys"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.slices(batches):
            sets = list(_shingle_sets(batch.column("text"), size))
            yield pa.RecordBatch.from_arrays([pa.array([_node(s)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    return run


def _alike(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for p, q in zip(batch.column("p"), batch.column("q")):
                x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both / max(1, len(x) + len(y) - both) >= share)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class under the key of every band."""
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), "<i8").reshape(batch.num_rows, BANDS)
        for t in range(BANDS):
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, t]), batch.column("node"), batch.column("root")], names=["key", "node", "root"])


def _prefixes(codes: np.ndarray, bounds: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(code, set) of each set's rarest shingles: two sets similar by ``share`` have one of these in common."""
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    rarity = np.bincount(codes)[codes]
    order = np.lexsort((codes, rarity, owner))
    place = np.arange(len(codes)) - np.repeat(bounds[:-1], n)
    use = order[place < np.repeat(n - np.ceil(share * n - 1e-9).astype(np.int64) + 1, n)]
    use = use[np.argsort(codes[use], kind="stable")]
    return codes[use], owner[use]


def room_links(sets: list[np.ndarray], root: np.ndarray, share: float) -> list[tuple[int, int]]:
    """Pairs of sets similar by ``share`` that connect all such pairs of different roots.

    Of two roots one isn't the most frequent, so each set outside it is compared with the
    sets of other roots that share one of its rarest shingles.
    """
    root = np.unique(root, return_inverse=True)[1]
    n = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    bounds = np.concatenate(([0], np.cumsum(n)))
    code, owner = _prefixes(codes, bounds, share)
    begin = np.searchsorted(code, np.arange(codes.max() + 2)) if len(codes) else np.zeros(1, np.int64)
    by_set = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[by_set], np.arange(len(sets) + 1))
    mark, links, done = np.zeros(n.sum() + 1, bool), [], np.zeros(len(n), bool)
    while True:
        most = np.bincount(root).argmax()
        left = np.flatnonzero(~done & (root != most))
        if not len(left):
            return links
        i = int(left[0])
        done[i] = True
        own = code[by_set[first[i] : first[i + 1]]]
        if not len(own):
            continue
        others = np.unique(np.concatenate([owner[begin[c] : begin[c + 1]] for c in own.tolist()]))
        others = others[(root[others] != root[i]) & (np.minimum(n[others], n[i]) >= share * np.maximum(n[others], n[i]))]
        if not len(others):
            continue
        mark[codes[bounds[i] : bounds[i + 1]]] = True
        size = n[others]
        starts = np.cumsum(size) - size
        both = np.add.reduceat(mark[codes[np.repeat(bounds[others] - starts, size) + np.arange(size.sum())]].astype(np.int64), starts)
        mark[codes[bounds[i] : bounds[i + 1]]] = False
        for j in others[both / (size + n[i] - both) >= share].tolist():
            if root[j] != root[i]:
                links.append((i, j))
                root[root == root[j]] = root[i]


def _rooms(share: float):
    """Links between different roots under one key, decided by the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        key, node, root = (np.asarray(table.column(c)) for c in ("key", "node", "root"))
        shingles = table.column("shingles").combine_chunks()
        order = np.lexsort((node, key))
        for at in np.split(order, np.flatnonzero(key[order][1:] != key[order][:-1]) + 1):
            at = at[np.unique(node[at], return_index=True)[1]]
            found = room_links([np.frombuffer(shingles[k].as_buffer(), np.uint64) for k in at.tolist()], root[at], share)
            if found:
                a, b = node[at][np.array(found)].T
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    return run


def _deal(parts: int):
    """Each class under every key of every slice of its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                slices = np.frombuffer(b"".join(part.column("sketch").to_pylist()), "<u4").reshape(part.num_rows, -1).astype(np.uint64)
                for t in range(slices.shape[1]):
                    for k in range(3 * parts):
                        key = _take(slices[:, t], _layout(k, SLICE_BLOCKS, parts)[0])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, 3 * parts * t + k, np.int32)), pa.array(key.astype(np.int32)), part.column("node"), part.column("sketch")], names=["tag", "key", "node", "sketch"])

    return run


def _near(budget: int, share: float, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        tags, keys, nodes = (np.asarray(table.column(c)) for c in ("tag", "key", "node"))
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        for tag in np.unique(tags):
            at = np.flatnonzero(tags == tag)
            t, k = divmod(int(tag), 3 * parts)
            value = np.ascontiguousarray(sketches[at, 4 * t : 4 * t + 4]).view("<u4").ravel().astype(np.uint64)
            rest = _layout(k, SLICE_BLOCKS, parts)[1]
            tail, bits = _take(value, rest), sum(b - a for a, b in rest)
            order = np.lexsort((tail, keys[at]))
            at, tail = at[order], tail[order]
            wide = np.ascontiguousarray(sketches[at]).view("<u8")
            limit = int(share * 64 * wide.shape[1])

            def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                out = np.zeros(len(x), bool)
                for a in range(0, len(x), 1 << 17):
                    p, q = x[a : a + (1 << 17)], y[a : a + (1 << 17)]
                    out[a : a + (1 << 17)] = np.bitwise_count(wide[p] ^ wide[q]).sum(axis=1) <= limit  # noqa: B023
                return out

            pairs: list[tuple[np.ndarray, np.ndarray]] = []
            connect(keys[at].astype(np.int64), tail, bits, budget, near, pairs)
            for x, y in pairs:
                if len(x):
                    a, b = nodes[at][x], nodes[at][y]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    return run


def _shingles_of(nodes: DataFrame, known: DataFrame, classes: DataFrame, size: int, name: str) -> DataFrame:
    """(node, shingles) of distinct nodes, from their texts."""
    wanted = classes.join(nodes, "node", "left_semi").select(F.col("least.doc_id").alias("w"), F.col("least.th").alias("wt"))
    texts = known.join(wanted, known["doc_id"].eqNullSafe(wanted["w"]) & (known["th"] == wanted["wt"]), "left_semi")
    return shared.stored(shared.arrow(texts.select("text"), _sets(size), "node long, shingles binary"), name)


def _verified(pairs: DataFrame, known: DataFrame, classes: DataFrame, size: int, alike: float) -> DataFrame:
    """The pairs (a, b) of nodes whose distinct shingles are similar by ``alike``, from the texts."""
    pairs = shared.stored(pairs.distinct(), "slice-pairs", few=True)
    sets = _shingles_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), known, classes, size, "slice-shingles")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("p")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("q")), "b")
    return shared.stored(shared.arrow(both.select("a", "b", "p", "q"), _alike(alike), "a long, b long"), "slice-links", few=True)


#: Classes of one task where those under a key are compared.
ROOM = 1024


def _seated(rooms: DataFrame, room: int) -> DataFrame:
    """(room, node, root): those under a key in blocks of about ``room``, so that any two of different roots share one.

    Where one root has all but ``room`` of a key's classes, these are dealt out and the
    others sit in every block; else each block holds two of the parts of the key.
    """
    by_root = rooms.groupBy("key", "root").agg(F.count("*").alias("n"))
    large = by_root.groupBy(F.col("key").alias("k")).agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("root", "n").alias("top")).filter(F.col("all") > room)
    cell = lambda n: F.pmod(F.xxhash64("node"), n)
    parts, grid = F.ceil(F.col("most") / room), F.ceil(F.col("all") / room)
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    pairs = F.transform(every(grid), lambda c: F.least(c, cell(grid)) * grid + F.greatest(c, cell(grid)))
    few = F.col("all") - F.col("most") <= room
    blocks = F.when(F.col("k").isNull(), F.array(F.lit(0).cast("long"))).when(few & (F.col("root") == F.col("top")), F.array(cell(parts))).when(few, every(parts)).otherwise(pairs)
    seated = rooms.join(large, F.col("key") == F.col("k"), "left").select("key", "node", "root", F.explode(blocks).alias("block"))
    return seated.select(F.xxhash64("key", "block").alias("key"), "node", "root")


#: Classes beyond which a slice's keys are longer, at three times as many of them.
MANY = 1 << 22


def _keyed(docs: DataFrame) -> list:
    """What names a row: its id and a hash of its text."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th")]


def near_copies(docs: DataFrame, size: int = 5, tables: int = 12, budget: int = 2, share: float = 0.15, alike: float = 0.8, many: int = MANY, room: int = ROOM) -> DataFrame:
    """(doc_id, th, component_id, first), a row for each row of docs: near copies form a component.

    ``th`` is the XXH64 of the text: rows equal in both are copies of one document, rows
    of one doc_id with different texts are documents of their own.  The first of a
    component has the least (doc_id, th), null ids last; component_id is its doc_id.

    Components are those of pairs whose distinct shingles of ``size`` words have a Jaccard
    similarity of ``alike`` or more; the shingles of both texts decide every link.
    Candidates come in two rounds.  First the trie self-join runs on ``tables`` 32-bit
    SimHash slices of the distinct shingles with ``budget`` bits, keeping pairs that
    differ in at most ``share`` of all bits; that joins large groups by few pairs.  Then
    all classes meet under the keys of 24 MinHash bands of four rows; where those under a
    key aren't all in one component, their shingles meet in one task, which decides the
    pairs that share a rare shingle, as all pairs similar by ``alike`` do (keys of the same
    classes once; a key of more than ``room`` classes is split over several tasks).  Two texts agree in a row with the chance of their similarity, however
    their differences lie: at 0.8 no band meets with a chance of 0.59 ** 24, 3 in a million.
    Texts with the same set of shingles are one class, named by 128 bits; so are texts
    without words, null among them.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    known = docs.select(*_keyed(docs), "text")
    prints = shared.stored(shared.arrow(known, _prints(size, tables), "doc_id long, th long, node long, check long, sketch binary, keys binary"), "prints")
    if not prints.groupBy("doc_id", "th").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        known = known.dropDuplicates(["doc_id", "th"])
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    classes = shared.stored(prints.groupBy("node", "check").agg(F.min(row).alias("least"), *(F.first(c).alias(c) for c in ("sketch", "keys"))), "classes")
    parts = 3 if classes.count() > many else 1
    dealt = shared.arrow(classes.select("node", "sketch"), _deal(parts), "tag int, key int, node long, sketch binary").repartition(shared.partitions(spark), "tag", "key")
    links = _verified(shared.arrow(dealt, _near(budget, share, parts), "a long, b long"), known, classes, size, alike)
    rooted = classes.join(components(links), "node", "left").select("node", "keys", F.coalesce("root", "node").alias("root"))
    keys = shared.arrow(shared.stored(rooted, "rooted"), _keys, "key long, node long, root long")
    members = (F.count("*").alias("n"), F.bit_xor("node").alias("x"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    open_ = keys.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), *members).filter("least <> most").groupBy("n", "x", "lo", "hi").agg(F.min("key").alias("key")).select("key")
    rooms = shared.stored(keys.join(open_, "key", "left_semi"), "rooms")
    sets = _shingles_of(rooms.select("node").distinct(), known, classes, size, "room-shingles")
    met = _seated(rooms, room).join(sets, "node").select("key", "node", "root", "shingles").repartition(shared.partitions(spark), "key")
    links = links.union(shared.stored(shared.arrow(met, _rooms(alike), "a long, b long").distinct(), "room-links", few=True))
    named = classes.join(components(links), "node", "left").select("node", "check", "least", F.coalesce("root", "node").alias("root"))
    firsts = named.groupBy("root").agg(F.min("least").alias("of"))
    found = prints.select("doc_id", "th", "node", "check").join(shared.stored(named.join(firsts, "root").select("node", "check", "of"), "print-components", few=True), ["node", "check"])
    return found.select("doc_id", "th", F.col("of.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("of.doc_id")) & (F.col("th") == F.col("of.th"))).alias("first"))


def distinct(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies, with all columns: that of the least (doc_id, text hash).

    Rows are told apart by id and text, so no text goes because another one has its id;
    of rows equal in both, one stays.
    """
    marks = shared.stored(near_copies(docs), "near-copies", few=True)
    rows = shared.wrapped(docs, *_keyed(docs))

    def among(keys: DataFrame, how: str, table: DataFrame) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("k"), F.col("th").alias("kt")).distinct()
        return table.join(keys, table["doc_id"].eqNullSafe(keys["k"]) & (table["th"] == keys["kt"]), how)

    left = among(marks.filter("not first"), "left_anti", rows)
    twice = marks.filter("first").groupBy("doc_id", "th").agg(F.count("*").alias("n")).filter("n > 1")
    if not twice.isEmpty():
        left = among(twice, "left_anti", left).union(among(twice, "left_semi", left).dropDuplicates(["doc_id", "th"]))
    return shared.unwrapped(left, docs)
