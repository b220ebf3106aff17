"""Rows that share ids, repeat, hold nulls or have columns named like ours: every operator and stage keeps each text apart."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestral.llm import decontam, simhash, substring, toxicity
from tests.llm.test_llm_operators import PASSAGE, brute_contamination, brute_dedup

EXTRA = "row doc th spans first __kept __n_words __n_removed __score __n_sentences __bad __key k kt node h hits items w pos found size k_size n_hit place html".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
LABELS = "doc_id long, quality int, toxic int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *(f"{c}{k}" for c in EXTRA)) for k, (i, t) in enumerate(rows)], SCHEMA)


def shingles(text, n=5):
    w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[a : a + n]) for a in range(max(1, len(w) - n + 1))} if w else set()


def brute_distinct(rows, share=0.8):
    """Texts kept of (doc_id, text hash, text): the least of each component, nulls last."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    sets = [shingles(t) for _, _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or sets[i] and sets[j] and len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [rows[i] for i in range(len(rows)) if find(i) == i]


def _texts():
    rng = np.random.default_rng(8)
    fresh = lambda n: [f"t{x}" for x in rng.integers(0, 1 << 30, n)]
    a, b = fresh(120), fresh(90)
    near = [*a[:60], "changed", *a[61:]]
    far = [*a[:60], *fresh(60)]
    one = lambda w: " ".join(w)
    rows = [(3, one(a)), (5, one(near)), (5, one(b)), (7, one(b)), (7, one(b)), (8, one(far)), (8, one(a)), (9, None), (9, ""), (None, one(near)), (None, one(fresh(40))), (None, None), (4, one(a).upper()), (6, "two words"), (11, "two words"), (12, "two  Words\n")]
    rows += [(20, one(fresh(30))), (20, one(fresh(30)))] * 2
    return rows


def test_distinct(spark):
    """The cases that a removal by doc_id loses: one id with two texts, repeated rows, null ids."""
    docs = table(spark, _texts())
    hashed = [tuple(r) for r in docs.select("doc_id", F.xxhash64("text"), "text").collect()]
    kept = simhash.distinct(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=key) == sorted(((i, t) for i, _, t in brute_distinct(hashed)), key=key)
    assert {5, 20} <= {r["doc_id"] for r in got} and sum(r["doc_id"] == 20 for r in got) == 2
    source = {tuple(r) for r in docs.collect()}
    assert all(tuple(r) in source for r in got)  # whole rows, extra columns as they were


@pytest.mark.parametrize("many", [0, 1 << 22])
def test_longer_keys(spark, many):
    """Three times as many, longer keys of the slices find the same."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(60):
        w = [f"t{x}" for x in rng.integers(0, 1 << 30, 100)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:40], "x", *w[41:]]))]
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), many=many)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: i - i % 2 for i in range(120)}


@pytest.mark.parametrize("room", [1, 5, 40])
def test_split_rooms(spark, room):
    """Keys of many classes, with and without one large component, are split without losing a pair."""
    rng = np.random.default_rng(21)
    fresh = lambda n: [f"t{x}" for x in rng.integers(0, 1 << 30, n)]
    base, rows = fresh(100), []
    for k in range(40):  # one large component, others beside it that share most of its shingles
        w = list(base)
        for at in rng.integers(0, 100, 1 + (k % 8)):
            w[at] = f"x{k}"
        rows.append(" ".join(w))
    for k in range(30):
        rows.append(" ".join(base[:70] + fresh(30)))
    rows = [(i, i, t) for i, t in enumerate(rows)]
    got = simhash.near_copies(spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string"), room=room)
    kept = {r["component_id"] for r in got.collect()}
    assert kept == {i for i, _, _ in brute_distinct(rows)}


def test_seats(spark):
    """Any two classes of different roots under a key share a block."""
    rooms = [(1, k, 0 if k < 30 else k) for k in range(36)] + [(2, 100 + k, k % 9) for k in range(40)] + [(3, 300 + k, k) for k in range(4)]
    seated = simhash._seated(spark.createDataFrame(rooms, "key long, node long, root long"), 8).collect()
    blocks = {}
    for r in seated:
        blocks.setdefault(r["node"], set()).add(r["key"])
    for a, i, p in rooms:
        for b, j, q in rooms:
            if a == b and p != q:
                assert blocks[i] & blocks[j]
    sizes = {}
    for r in seated:
        sizes[r["key"]] = sizes.get(r["key"], 0) + 1
    assert max(sizes.values()) <= 30 and sum(len(b) for i, b in blocks.items() if i < 30) == 30


def test_layouts():
    """Some key of two numbers agrees whenever they differ in two bits at most."""
    rng = np.random.default_rng(2)
    for blocks, bits, parts in ((simhash.BLOCKS, 64, 3), (simhash.SLICE_BLOCKS, 32, 1), (simhash.SLICE_BLOCKS, 32, 3)):
        x = rng.integers(0, 1 << 62, 500).astype(np.uint64) & np.uint64((1 << bits) - 1)
        y = x.copy()
        for _ in range(2):
            y ^= np.uint64(1) << rng.integers(0, bits, 500).astype(np.uint64)
        agree = [simhash._take(x, simhash._layout(t, blocks, parts)[0]) == simhash._take(y, simhash._layout(t, blocks, parts)[0]) for t in range(3 * parts)]
        assert np.any(agree, axis=0).all()
        for t in range(3 * parts):
            key, tail = simhash._layout(t, blocks, parts)
            assert sorted(b for a, z in key + tail for b in range(a, z)) == list(range(bits))


def test_room_links():
    """All pairs similar by 0.8 end in one component, whatever roots there were."""
    rng = np.random.default_rng(1)
    for trial in range(30):
        base = [rng.integers(0, 400, 60) for _ in range(4)]
        sets = [np.unique(np.concatenate([b[: rng.integers(40, 61)], rng.integers(0, 4000, rng.integers(0, 9))])).astype(np.uint64) for b in base for _ in range(8)]
        start = np.arange(len(sets)) // (1 + trial % 3)
        root = {int(r): int(r) for r in np.unique(start)}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        alike = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        for i, j in simhash.room_links(sets, start, 0.8):
            assert alike(sets[i], sets[j]) >= 0.8
            a, b = find(int(start[i])), find(int(start[j]))
            root[max(a, b)] = min(a, b)
        assert all(find(int(start[i])) == find(int(start[j])) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j]) >= 0.8)


def test_operators_keep_columns(spark):
    docs = table(spark, [(1, PASSAGE), (2, PASSAGE + " more"), (None, None), (1, "other words"), (1, PASSAGE)])
    bench = spark.createDataFrame([(1, PASSAGE), (2, "none of it")], "item_id long, text string")
    source = {tuple(r) for r in docs.collect()}
    clean = decontam.clean(docs, bench)
    assert clean.columns == docs.columns and {tuple(r) for r in clean.collect()} == {r for r in source if r[1] in (None, "other words")}
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), -50.0)
    assert {tuple(r) for r in toxicity.kept(docs, model).collect()} == source
    scored = toxicity.score(docs, model)
    assert set(scored.columns) == set(docs.columns) | set(toxicity._NEW) and len(scored.columns) == len(set(scored.columns))
    assert {r["row"] for r in scored.collect()} == {r[5] for r in source} and scored.filter("__score > 0.001").isEmpty()
    marked = substring.dedup(docs)
    assert len(marked.columns) == len(set(marked.columns)) and {r["doc"] for r in marked.collect()} == {f"doc{k}" for k in range(5)}
    short = substring.shortened(docs)
    assert short.columns == docs.columns
    assert sorted((r["__kept"], r["n_chars"], r["text"]) for r in short.collect() if r["doc_id"] == 2) == [("__kept1", 4, "more")]


def test_stages_with_clashing_columns(spark):
    """Each stage but the last keeps the columns of documents, and others too."""
    rows = [(i, f"{PASSAGE} number {i} " + " ".join(f"v{i}x{k}" for k in range(60))) for i in range(6)] + [(None, None), (3, ""), (3, None)]
    docs = table(spark, rows)
    folder = __import__("tempfile").mkdtemp()
    spark.createDataFrame([(i, 1, 0) for i in range(6)], LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "v0x1 v0x2 v0x3")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert {r["row"] for r in out.collect()} <= {f"row{k}" for k in range(len(rows))}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == len(rows)


def test_toxicity_stage(spark):
    """The first stage against scores worked out sentence by sentence."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        w = [f"w{x}" for x in rng.integers(0, 50, 24)]
        if i % 4 == 0:
            w[int(rng.integers(0, 24))] = f"nasty{i % 3}"
        rows.append((i, ". ".join(" ".join(w[k : k + 6]) for k in range(0, 24, 6))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(400)], LABELS)
    folder = __import__("tempfile").mkdtemp()
    labels.write.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs.filter(~toxicity.held_out()), labels.filter(~toxicity.held_out()))
    got = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, folder).collect()}
    assert got == {i for i, t in rows if brute_score(model, t) < 0.5} and 250 < len(got) < 350


def brute_score(model, text):
    """Noisy-or over sentences, word by word."""
    import pyarrow as pa

    from lodestral.llm import text as helpers

    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    clean = 1.0
    for sentence in re.split(r"[.!?\n]", text or ""):
        words = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", sentence)
        if not words:
            continue
        z = model.bias
        for w in words:
            raw = "".join(c.lower() if c.isascii() else c for c in w).encode()
            hash_ = lambda b: helpers.word_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))
            z += weight.get(int(hash_(raw)[0]), 0.0)
            for n in toxicity.PREFIXES:
                if len(raw) >= n:
                    z += weight.get(int(helpers.mix(hash_(raw[:n]) ^ np.uint64(n))[0]), 0.0)
        clean *= 1 - 1 / (1 + np.exp(-z))
    assert pa is not None
    return 1 - clean


@pytest.mark.parametrize("size", [1, 3])
def test_small_batches(spark, size):
    """Records of a content and of a minimizer may lie in several batches."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["a", "b", "c"], int(rng.integers(15, 60))))) for i in range(60)]
    rows += [(100 + i, PASSAGE) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        got = {r["doc_id"]: (r["__n_words"], r["__n_removed"], r["__kept"]) for r in substring.dedup(docs, fraction=1.0, share=1 / 4).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == brute_dedup(rows)


def test_common_contents():
    """The table of common contents only ever calls what was met at a lesser place a repeat."""
    rng = np.random.default_rng(3)
    common, least = substring._Common(bits=3), {}
    for _ in range(60):
        h = np.unique(rng.integers(0, 30, 12)).astype(np.uint64)
        n = len(h)
        r = substring._Rows(h, h, h, rng.integers(0, 50, n), np.zeros(n, np.int64), np.zeros(n, np.int64), rng.integers(0, 5, n), np.ones(n, np.int64))
        before, again, (d, t, p) = common.meet(r)
        for k in range(n):
            place = (int(r.doc[k]), int(r.pos[k]))
            if before[k]:
                assert (int(d[k]), int(p[k])) in least[int(h[k])] and (int(d[k]), int(p[k])) < place
            if again[k]:
                assert place in least[int(h[k])]
            least.setdefault(int(h[k]), set()).add(place)


def test_large_benchmark_agrees(spark):
    """Beyond the limit the join on hashes finds the same, for repeated rows as well."""
    rows = [(1, PASSAGE), (1, PASSAGE), (1, "a b c"), (None, PASSAGE.upper()), (2, None), (3, "yes"), (4, "oh yes no " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(i, "yes") for i in range(50)] + [(60, PASSAGE), (61, "b c"), (None, "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    few, more = (sorted(map(repr, decontam.annotate(docs, bench, limit=n).collect())) for n in (50_000, 1))
    assert few == more and len(few) == len(rows)
    plain = brute_contamination([(k, t) for k, (_, t) in enumerate(rows)], [(i, t) for i, t in items if i is not None])
    assert sorted(v[2] for v in plain.values()) == sorted(list(r["items"]) for r in decontam.annotate(docs, bench).collect())


def test_benchmark_beyond_the_limit(spark):
    """A benchmark of more than 50,000 beginnings, at the default limit."""
    items = spark.range(4300).select(F.col("id").alias("item_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(25)), lambda k: F.concat(F.lit("w"), F.lower(F.hex(F.xxhash64(F.col("id"), k))))), " ").alias("text"))
    items = items.union(spark.createDataFrame([(9001, PASSAGE), (9002, "yes")], "item_id long, text string"))
    some = [r["text"] for r in items.filter("item_id % 1000 = 7").collect()]
    rows = [(k, f"before it {t} and after") for k, t in enumerate(some)] + [(10, " ".join(some[0].split()[5:15])), (11, PASSAGE + " yes"), (12, "nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], list(r["items"])) for r in decontam.annotate(docs, items).collect()}
    assert got == {**{k: (26, [str(1000 * k + 7)]) for k in range(len(some))}, 10: (0, []), 11: (len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", PASSAGE.lower())) + 1, ["9001", "9002"]), 12: (0, [])}
