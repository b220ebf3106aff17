"""The pipeline, stage by stage, against brute-force versions."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P

import corpus_pipeline
from lodestral.llm import bpe, queries, shared
from tests.llm.test_llm_operators import brute_contamination, brute_dedup


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[a : a + n]) for a in range(max(1, len(w) - n + 1))} if w else set()


def test_stages(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    before, docs = documents, documents
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = shared.stored(stage(spark, docs, data), name)
        rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
        if name != "bpe":
            assert out.columns == before.columns
            got = {r["doc_id"]: r["text"] for r in out.collect()}
            assert set(got) <= {i for i, _ in rows} and len(got) == out.count()
        if name == "simhash_near_dedup":
            sets = {i: shingles(t) for i, t in rows}
            left = sorted(got)
            for i, t in rows:  # what went has a near copy that came before; near copies don't stay
                if i not in got:
                    assert any(j < i and len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j]) for j in sets)
            for a, i in enumerate(left):
                for j in left[a + 1 :]:
                    assert len(sets[i] & sets[j]) < 0.8 * max(1, len(sets[i] | sets[j]))
        if name == "substring_dedup":
            expected = brute_dedup(rows)
            assert {i: (t or "").split() for i, t in got.items()} == {i: e[2].split() for i, e in expected.items()}
        if name == "benchmark_decontamination":
            assert set(got) == {i for i, v in brute_contamination(rows, items).items() if not v[3]}
        if name == "bpe":
            codec = bpe.Codec.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
            texts = dict(rows)
            result = out.collect()
            assert len(result) == len(rows)
            for r in result:
                assert bytes(r["ids"]) == codec.encode([texts[r["doc_id"]]])[0] and r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
        kept[name] = out.count()
        docs = out
    whole = corpus_pipeline.run(spark, data)
    assert whole.count() == kept["bpe"]


def test_toxicity_held_out(spark):
    got = {r["doc_id"]: r for r in queries.op9_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    right = [got[i]["predicted"] == t for i, t in labels.items() if got[i]["held_out"]]
    assert np.mean(right) > 0.93


def test_empty(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).isEmpty()
