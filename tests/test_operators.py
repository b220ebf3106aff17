from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestral.operators import chunking, embeddings, evaluation, research, retrieval, search, store, sync, synthesis


def test_chunking():
    text = "One short line.\nAnother of them.\nabcdefghijklmnopqrstuvwxyz"
    assert chunking.paragraphs(text, 20) == ["One short line.", "Another of them.", "abcdefghijklmnopqrst", "uvwxyz"]
    assert chunking.paragraphs("aa bb  cc dd", 6) == ["aa bb", "cc dd"] and chunking.paragraphs("aaa bbb", 3) == ["aaa", "bbb"] and chunking.paragraphs("abc  d", 3) == ["abc", "d"]
    assert chunking.paragraphs("a\n\n b \nc", 6) == ["a\n\nb", "c"] and chunking.paragraphs(" \n ") == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é\n\t日", max_size=200), st.integers(4, 40))
def test_chunk_bounds(text, limit):
    assert all(0 < len(c) <= limit for c in chunking.paragraphs(text, limit))
    pieces = chunking.by_bytes(text, limit)
    assert "".join(pieces) == text and all(len(p.encode()) <= limit for p in pieces)


def test_byte_chunks(spark):
    assert chunking.by_bytes("", 10) == [""]
    with pytest.raises(ValueError):
        chunking.by_bytes("日", 2)
    rows = spark.createDataFrame([(1, "a b c d"), (2, "x")], "id long, text string")
    got = [(r["id"], r["chunk"], r["failure"]) for r in chunking.byte_chunks(rows, 2, 2).orderBy("id", "position").collect()]
    assert got == [(1, None, "document_too_large"), (2, "x", None)]


DOC = "id string, source_id string, url string, canonical_url string, status string, title string, text string, media_type string, published_at timestamp, fetched_at timestamp, etag string, last_modified string, content_hash string, failure_reason string, created_at timestamp, updated_at timestamp"


def _doc(i, source="s", url=None, status="active", text="t", title="x"):
    url = url or f"https://a.com/{i}"
    at = datetime(2024, 1, 1)
    return (f"id{i}", source, url, url, status, title, text, None, None, at, None, None, None, None, at, at)


def test_upsert(spark):
    old = spark.createDataFrame([_doc(1), _doc(2)], DOC)
    new = spark.createDataFrame([_doc(1, status="inactive", text=None, title=None), _doc(2, source="other"), _doc(3), _doc(4, url="ftp://a.com/4")], DOC)
    snapshot, rejected = store.upsert(old, new, "2024-02-01")
    got = {r["canonical_url"][-1]: r for r in snapshot.collect()}
    assert set(got) == {"1", "2", "3"}
    assert (got["1"]["id"], got["1"]["status"], got["1"]["text"], got["1"]["title"]) == ("id1", "inactive", None, None)
    assert got["1"]["created_at"] == datetime(2024, 1, 1) and got["1"]["updated_at"] == datetime(2024, 2, 1)
    assert got["2"]["source_id"] == "s" and got["2"]["updated_at"] == datetime(2024, 1, 1)
    assert {(r["canonical_url"][-1], r["error"]) for r in rejected.collect()} == {("2", "source conflict"), ("4", "invalid HTTP URL")}
    assert store.violations(snapshot).isEmpty() and store.violations(spark.createDataFrame([_doc(1, text=" ")], DOC)).count() == 1


def test_snapshot_files(spark, tmp_path):
    snapshot = spark.createDataFrame([_doc(1), _doc(2, status="inactive")], DOC)
    store.write_snapshot(snapshot, str(tmp_path / "s"))
    back = store.read_snapshot(spark, str(tmp_path / "s"))
    assert store.documents(back, "active").count() == 1 and store.get(back, "id2").count() == 1 and store.get_by_url(back, "HTTPS://a.com/1/").count() == 1
    assert "PartitionFilters: [isnotnull(status" in store.documents(back, "active")._jdf.queryExecution().toString()


def test_page_decisions(spark):
    at = datetime(2024, 1, 2)
    base = {"robots": "allowed", "status": 200, "error": None, "in_scope": True, "text": "x", "title": None, "existing_status": None, "existing_title": "old", "fetched_at": at, "published_at": datetime(2999, 1, 1), "discovered_at": datetime(2024, 1, 1), "existing_published_at": None}
    cases = [
        ({"robots": "deferred"}, ("keep", None, None, "robots_deferred")), ({"robots": "disallowed", "existing_status": "active"}, ("write", "inactive", "robots_disallowed", None)),
        ({"error": "boom", "existing_status": "active"}, ("keep", "active", None, "boom")), ({"error": "boom"}, ("write", "inactive", "boom", "boom")), ({"status": 304, "existing_status": "active"}, ("keep", "active", None, None)),
        ({"status": 304}, ("write", "inactive", "received HTTP 304 without a stored document", "received HTTP 304 without a stored document")), ({"in_scope": False, "existing_status": "active"}, ("write", "inactive", "redirect_outside_source_scope", None)),
        ({"text": " "}, ("write", "inactive", "no_extractable_text", "no_extractable_text")), ({}, ("write", "active", None, None)),
    ]
    schema = "id int, robots string, status int, error string, in_scope boolean, text string, title string, existing_status string, existing_title string, fetched_at timestamp, published_at timestamp, discovered_at timestamp, existing_published_at timestamp"
    rows = spark.createDataFrame([(i, *(base | c).values()) for i, (c, _) in enumerate(cases)], schema)
    got = sync.decide_pages(rows).orderBy("id").collect()
    assert [(r["action"], r["new_status"], r["reason"], r["failure"]) for r in got] == [e for _, e in cases]
    assert (got[-1]["new_title"], got[-1]["new_published_at"]) == ("old", datetime(2024, 1, 1))


def test_sitemap_levels(spark):
    tree = {"https://a.com/s": [("sitemap", "https://a.com/t"), ("sitemap", "https://b.com/u"), ("content", "https://a.com/1")], "https://a.com/t": [("sitemap", "https://a.com/s"), ("content", "https://a.com/2")]}

    def expand(level):
        found = [("x", kind, url) for r in level.collect() for kind, url in tree[r["url"]]]
        return level.sparkSession.createDataFrame(found, "source_id string, kind string, url string")

    content, seen = sync.sitemap_levels(spark.createDataFrame([("x", "https://a.com/s")], "source_id string, url string"), expand)
    assert sorted(r["url"] for r in content.collect()) == ["https://a.com/1", "https://a.com/2"]
    assert sorted(r["url"] for r in seen.collect()) == ["https://a.com/s", "https://a.com/t"]


def test_deep_sitemaps(spark):
    """A chain of twenty levels."""

    def expand(level):
        return level.select("source_id", F.explode(F.array(F.struct(F.lit("sitemap").alias("kind"), F.concat(F.lit("https://a.com/"), F.least(F.element_at(F.split("url", "/"), -1).cast("int") + 1, F.lit(20)).cast("string")).alias("url")), F.struct(F.lit("content").alias("kind"), F.concat("url", F.lit("/page")).alias("url")))).alias("e")).select("source_id", "e.*")

    content, seen = sync.sitemap_levels(spark.createDataFrame([("x", "https://a.com/1")], "source_id string, url string"), expand)
    assert content.count() == 20 and seen.count() == 20 and sync.sitemap_levels(content.limit(0), expand)[0].isEmpty()


def test_filter_counts(spark):
    rows = spark.createDataFrame([(1, 0, "a", "https://x.org/?utm_source=q"), (1, 1, "a", "https://x.org/"), (1, 2, " ", "https://y.org"), (1, 3, "a", "bad"), (1, 4, "a", "https://z.org"), (1, 5, "a", "https://z.org#f")], "request_id long, ord long, title string, url string")
    got = [r["reason"] for r in retrieval.filter_results(rows, 1).orderBy("ord").collect()]
    assert got == [None, "duplicate_url", "empty_title", "invalid_url", "truncated", "duplicate_url"]
    report = retrieval.filter_report(retrieval.filter_results(rows, 1)).first().asDict()
    assert report["input_count"] == sum(v for k, v in report.items() if k not in ("request_id", "input_count"))


def test_search(spark, tmp_path):
    docs = spark.createDataFrame([(1, "electric vehicle battery"), (2, "apple fruit"), (3, "city news vehicle vehicle")], "doc_id long, text string")
    assert [r["doc_id"] for r in search.bm25(docs, "Vehicle", 5).collect()] == [3, 1]
    assert search.bm25(docs, "?!", 5).isEmpty()
    search.write_postings(docs, str(tmp_path / "index"))
    indexed = search.bm25_indexed(spark, str(tmp_path / "index"), "Vehicle news", 5)
    assert indexed.collect() == search.bm25(docs, "Vehicle news", 5).collect()
    assert "In(term, [news,vehicle])" in indexed._jdf.queryExecution().toString()
    for bad in ((" ", 1), ("a", 0)):
        with pytest.raises(ValueError):
            search.bm25(docs, *bad)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1])], "doc_id long, embedding array<float>")
    near = search.vector(vectors, [1.0, 0.0], 2, "doc_id")
    assert [r["doc_id"] for r in near.collect()] == [1, 3]
    assert search.rrf([search.bm25(docs, "vehicle", 5), near], 3).first()["doc_id"] in (1, 3)


def test_reuse(spark):
    chunks = spark.createDataFrame([("a:0", "h", "c1"), ("a:1", "h", "c2")], "id string, content_hash string, chunk_hash string")
    index = spark.createDataFrame([("a:0", "h", "c1", [1.0]), ("a:1", "h", "old", [2.0])], "id string, content_hash string, chunk_hash string, vector array<float>")
    assert {r["id"]: r["vector"] for r in search.reuse_plan(chunks, index).collect()} == {"a:0": [1.0], "a:1": None}
    assert search.reuse_plan(chunks, index, by_text=False).filter("vector is null").isEmpty()


def test_embeddings(spark):
    docs = spark.createDataFrame([("a b",), ("",), (None,)], "t string")
    rows = docs.select(embeddings.embed(F.col("t"), embeddings.hashing_embedder(8), 8).alias("v")).collect()
    assert all(len(r["v"]) == 8 and abs(sum(x * x for x in r["v"]) - 1) < 1e-6 for r in rows)


def test_lifecycle(spark):
    events = [(1, 1, 1, "evidence", 2, None), (1, 1, 2, "shelve", 0, "old"), (1, 1, 3, "reactivate", 0, "new"), (1, 2, 1, "failure", 0, "boom"), (1, 2, 2, "reactivate", 0, None), (1, 3, 1, "evidence", 0, None)]
    rows = spark.createDataFrame(events, "run_id long, document_id long, step long, event string, n_evidence long, reason string")
    assert {r["document_id"]: (r["lifecycle"], r["updated_at_step"]) for r in research.lifecycle(rows).collect()} == {1: ("active", 3), 2: ("unusable", 1), 3: ("unusable", 1)}


def test_curation_errors(spark):
    docs = spark.createDataFrame([(1, "a", "active"), (1, "b", "shelved"), (1, "c", "unusable")], "run_id long, document_id string, lifecycle string")
    requests = spark.createDataFrame([(1, "b", "active"), (1, "c", "active")], "run_id long, document_id string, target string")
    most = spark.createDataFrame([(1, 2)], "run_id long, max_active_documents long")
    assert {(r["document_id"], r["error"]) for r in research.curation_errors(requests, docs, most).collect()} == {("c", "illegal transition"), (None, "too many active documents")}


def test_tsv(spark):
    assert synthesis.tsv("item", '{"value": " x "}') == "```tsv\nValue\nx\n```"
    assert synthesis.tsv("item", '{"value": 1.5}') == "```tsv\nValue\n1.5\n```"
    assert synthesis.tsv("set", '{"items": ["a", 1, "a", "1", true]}') == "```tsv\nItem\na\n1\nTrue\n```"
    assert synthesis.tsv("list", '{"items": ["a\\tb", "a\\tb", "say \\"x\\""]}') == '```tsv\nItem\n"a\tb"\n"a\tb"\n"say ""x"""\n```'
    assert synthesis.tsv("table", '{"columns": ["a", " b "], "rows": [[1, null]]}') == "```tsv\na\tb\n1\t\n```"
    bad = {
        "item": ("[1]", "{}", '{"value": null}', '{"value": [1]}', '{"value": " "}', '{"value": 1, "x": 2}', '{"items": [1]}', "1", "no"),
        "set": ('["a"]', '{"items": []}', '{"items": "abc"}', '{"items": [null]}', '{"items": [""]}', '{"items": [{}]}', '{"value": 1}'),
        "table": ('{"columns": [], "rows": [[]]}', '{"columns": ["a"], "rows": []}', '{"columns": ["a", "a "], "rows": [[1, 2]]}', '{"columns": ["a"], "rows": [[1, 2]]}', '{"columns": [" "], "rows": [[1]]}', '{"columns": [1], "rows": [[1]]}', '{"columns": ["a"], "rows": [[""]]}', '{"columns": ["a"], "rows": [1]}'),
    }
    rows = [(k, p) for k, v in bad.items() for p in v] + [("list", p) for p in bad["set"]] + [("odd", "{}"), ("item", None), (None, "{}")]
    for kind, payload in rows[:-3]:
        with pytest.raises(ValueError):
            synthesis.tsv(kind, payload)
    got = synthesis.render(spark.createDataFrame([*rows, ("item", '{"value": false}')], "kind string, payload string")).collect()
    assert [r["error"] for r in got] == ["invalid answer"] * len(rows) + [None] and got[-1]["block"] == "```tsv\nValue\nFalse\n```"


def test_embeddings_in_order():
    items = [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]
    assert embeddings.in_order(items, 2) == [[1.0], [2.0]] and embeddings.in_order([[3.0]], 1) == [[3.0]]
    for bad, n in ((items, 3), ([items[0]], 1), ([items[0], items[0]], 2), ([[1.0]], 2)):
        with pytest.raises(ValueError):
            embeddings.in_order(bad, n)



def test_balanced_sample_short(spark):
    cases = spark.createDataFrame([(0, "item"), (1, "set"), (2, "item")], "ord long, kind string")
    assert [r["ord"] for r in evaluation.balanced_sample(cases, "kind", ["set", "item"], 1).collect()] == [1, 0]
    with pytest.raises(ValueError):
        evaluation.balanced_sample(cases, "kind", ["set", "list"], 1)


def test_context(spark):
    docs = spark.createDataFrame([(1, "a", 1, "active"), (1, "b", 0, "shelved"), (1, "c", 2, None)], "run_id long, document_id string, ord long, lifecycle string")
    evidence = spark.createDataFrame([(1, "a", i, f"e{i}", "x" * 400) for i in range(12)], "run_id long, document_id string, ord long, evidence_id string, claim string")
    got = {r["document_id"]: (r["ref"], None if r["evidence"] is None else (len(r["evidence"]), len(r["evidence"][0]["claim"]))) for r in research.context(docs, evidence).collect()}
    assert got == {"a": ("D2", (10, 300)), "b": ("D1", None)}


def test_written_postings_are_exchanged_once(spark, tmp_path):
    """A term that all documents have is dealt over several files, and each distinct term of a document is one row."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("salt salt "), F.col("id")).alias("text")).union(spark.createDataFrame([(400, None), (401, "")], "doc_id long, text string"))
    search.write_postings(docs, str(tmp_path / "index"), partitions=4)
    made = spark.read.parquet(str(tmp_path / "index/postings"))
    assert made.count() == 800 and made.filter("term = 'salt' and tf = 2 and length = 3").count() == 400
    assert made.filter("term = 'salt'").select(F.input_file_name()).distinct().count() > 1
    assert spark.read.parquet(str(tmp_path / "index/stats")).first()["corpus"] == 402


def test_term_counts(spark):
    got = spark.createDataFrame([("b a B, c-a b",), ("",), ("!",)], "t string").select(search.term_counts(F.col("t")).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in got] == [(6, ["a", "b", "c"], [2, 3, 1]), (0, [], []), (0, [], [])]
