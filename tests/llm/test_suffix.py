"""Suffix arrays and byte dedup against brute-force versions."""

import hashlib
import random

import numpy as np
import pytest

from lodestral.llm import suffix_array, suffix_dedup


def test_ranks():
    rng = np.random.default_rng(3)
    for k in range(400):
        s = rng.integers(1, 2 + k % 5, rng.integers(1, 70)) if k % 3 else np.tile(rng.integers(1, 4, 1 + k % 5), rng.integers(1, 20))
        s = np.append(s, 0)
        order = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        assert suffix_array.ranks(s)[order].tolist() == list(range(len(s)))


@pytest.mark.parametrize("block", [2, 1 << 12])
def test_ranks_of_blocks(monkeypatch, block):
    """Blocks of any size give the same order."""
    monkeypatch.setattr(suffix_array, "LEAST", block)
    rng = np.random.default_rng(5)
    for k in range(60):
        s = np.append(rng.integers(1, 40, 200) if k % 2 else np.repeat(rng.integers(1, 9, 40), rng.integers(1, 9, 40)), 0)
        order = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        assert suffix_array.ranks(s)[order].tolist() == list(range(len(s)))


def test_permuted_prefixes():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    starts = np.flatnonzero(np.arange(560) % 50 < 41)
    order = sorted(starts.tolist(), key=lambda i: data[i:].tobytes())
    before = np.full(len(data), -1)
    before[order[1:]] = order[:-1]
    got = suffix_array.permuted_prefixes(data, starts, before[starts], 30)
    for i, g in zip(starts.tolist(), got.tolist()):
        j, k = int(before[i]), 0
        while j >= 0 and k < 30 and data[i + k] == data[j + k]:
            k += 1
        assert g == k


def brute(docs, window=100):
    """Of (doc_id, text) rows; rows equal in both are one document."""
    seen, gone, texts = {}, {}, {}
    for key, text in docs:
        texts[key] = (text or "").encode()
    for key in sorted(texts):
        data, cut = texts[key], set()
        for i in range(len(data) - window + 1):
            if data[i : i + window] in seen:
                cut |= set(range(i, i + window))
            seen.setdefault(data[i : i + window], (key, i))
        gone[key] = cut
    out = {}
    for key, data in texts.items():
        cut = gone[key]
        spans = sum(1 for i in cut if i - 1 not in cut)
        out[key] = (len(data), len(cut), spans, hashlib.sha256(bytes(c for i, c in enumerate(data) if i not in cut)).hexdigest())
    return out


def result(df, **options):
    rows = suffix_dedup.dedup(df, **options).collect()
    return {r["doc_id"]: (r["__n_bytes"], r["__n_removed"], r["__n_spans"], hashlib.sha256(r["__kept"]).hexdigest()) for r in rows}


def corpus(seed=7):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeiourstlé") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = prose(60), prose(9)
    docs = [prose(rng.randint(1, 80)) for _ in range(60)]
    docs += [f"{prose(12)} {passage} {prose(12)}" for _ in range(12)] + [f"{prose(20)} {line} {prose(20)} {line}" for _ in range(40)]
    docs += [passage[rng.randint(0, 40) : -rng.randint(1, 40)] for _ in range(10)] + [docs[3]] * 5 + [docs[-1][:-5] + "x" * 7] * 2
    docs += ["a" * 450, "a" * 130, "ab" * 240, "b" + "ab" * 90, "xyz" * 130, None, "", "x" * 99, "é" * 120, "\0" * 230]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string").repartition(5).cache()


@pytest.mark.parametrize("options", [{}, {"most": 3}, {"most": 0}, {"fraction": 1.0, "share": 1 / 20}, {"shard": 500}, {"size": 7}])
def test_dedup(docs, options):
    """Shards of any size, digests instead of shards, hot minimizers by windows: all as brute force has it."""
    assert result(docs, **options) == brute(corpus())


def test_documents(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    assert result(df) == brute([tuple(r) for r in df.collect()])


def test_odd_rows(spark):
    """Null and repeated ids, repeated rows, clashing names, no rows."""
    long = "many words that are said twice, " * 6
    rows = [(None, long, 1, "r"), (3, long, 1, "r"), (3, long, 1, "r"), (3, "short", 2, "s"), (5, None, 3, "t")]
    df = spark.createDataFrame(rows, "doc_id int, text string, __n_spans int, spans string")
    got = sorted(((r["doc_id"] or -1, len(r["__kept"]), r["__n_removed"], r["__n_spans"], r["spans"]) for r in suffix_dedup.dedup(df).collect()))
    kept = next(g[1] for g in got if g[0] == -1)
    assert kept == 32 and got == sorted([(-1, 32, 160, 1, "r"), (3, 0, 192, 1, "r"), (3, 0, 192, 1, "r"), (3, 5, 0, 0, "s"), (5, 0, 0, 0, "t")])
    assert suffix_dedup.dedup(df.limit(0)).collect() == []


def test_long_text(spark):
    """A text above 10 MB whose second half is its first."""
    rng = np.random.default_rng(1)
    half = bytes(rng.integers(97, 123, 5_500_000, dtype=np.uint8)).decode()
    df = spark.createDataFrame([(1, half + half), (2, half[1000:3000])], "doc_id long, text string")
    got = result(df)
    assert got[1][:3] == (11_000_000, 5_500_000, 1) and got[2][:3] == (2000, 2000, 1)
