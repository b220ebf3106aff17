from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestral.functions import urls
from lodestral.operators import evaluation, research, retrieval, store
from lodestral.operators.agents import rule_action, synthesis_prompt, usage
from lodestral.sources import fetch, files
from tests.test_operators import DOC, _doc


def test_documents_or_fetch(spark):
    snapshot = spark.createDataFrame([_doc(1, title=None), _doc(2, status="inactive")], DOC)
    asked = spark.createDataFrame([("https://a.com/1/", "asked"), ("https://a.com/2", "two"), ("https://a.com/9", None)], "url string, title string")
    hits, misses = fetch.documents_or_fetch(asked, snapshot)
    assert [(r["title"], r["text"]) for r in hits.collect()] == [("asked", "t")]
    assert sorted(r["url"][-1] for r in misses.collect()) == ["2", "9"]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, answer string")
    files.write_lines(rows, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
    files.export_by_id(rows, str(tmp_path / "ids"))
    assert {p.name for p in (tmp_path / "ids").iterdir() if p.is_dir()} == {"id=a", "id=b"}
    with pytest.raises(ValueError):
        files.export_by_id(rows.union(rows), str(tmp_path / "twice"))


def test_candidates_and_subset(spark):
    results = spark.createDataFrame([(1, "r1", 0), (1, "r2", 1), (1, "r3", 2)], "run_id long, result_id string, ord int")
    left = retrieval.candidates(results, results.filter("result_id = 'r1'"))
    assert sorted(r["result_id"] for r in left.collect()) == ["r2", "r3"]
    assert [r["result_id"] for r in retrieval.select_subset(results, spark.createDataFrame([("r3",), ("r1",)], "result_id string")).collect()] == ["r1", "r3"]
    with pytest.raises(ValueError):
        retrieval.select_subset(results, spark.createDataFrame([("r9",)], "result_id string"))


def test_source_domains_and_refs(spark):
    evidence = spark.createDataFrame([(1, "https://www.a.com/x"), (1, "https://a.com/y"), (1, "odd"), (1, "https://b.com")], "run_id long, source_url string")
    assert research.source_domains(evidence, urls.publisher_domain(F.col("source_url"))).first()["source_domains"] == 2
    links = spark.createDataFrame([(1, "d", 2), (1, "d", 1), (1, "d", 2)], "run_id long, document_id string, research_index int")
    assert research.research_refs(links).first()["research_refs"] == ["R1", "R2"]


def test_small_columns(spark):
    rows = spark.createDataFrame([("finish", True), ("stop", True), ("research", False)], "last_action string, done boolean")
    assert [r[0] for r in rows.select(evaluation.stop_reason()).collect()] == ["finished", "stopped", "max_steps"]
    assert [r[0] for r in spark.range(3).select(rule_action(F.col("id"))).collect()] == ["research", "finish", "stop"]
    calls = spark.createDataFrame([("a", 2, 3), ("a", 1, 1)], "model string, prompt_tokens long, completion_tokens long")
    assert tuple(usage(calls, "model").first()) == ("a", 3, 4, 7, 2)


def test_synthesis_prompt(spark):
    groups = spark.createDataFrame([(1, 2, "S2", [(0, "c")]), (1, 1, "S1", [(0, "a"), (1, "b")])], "run_id long, position int, ref string, items array<struct<ord:int,claim:string>>")
    queries = spark.createDataFrame([(1, "why")], "run_id long, query string")
    assert synthesis_prompt(groups, queries).first()["prompt"] == "Question: why\n\nSources:\n[S1]\n- a\n- b\n\n[S2]\n- c"


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], DOC)
    snapshot, rejected = store.upsert(nothing, nothing, datetime(2024, 1, 1))
    assert snapshot.isEmpty() and rejected.isEmpty()
    none = spark.createDataFrame([], "request_id long, ord long, title string, url string")
    assert retrieval.filter_report(retrieval.filter_results(none)).isEmpty()
    first = store.incoming(spark.createDataFrame([("s", " https://A.com/x ", "active", " ", "t")], "source_id string, url string, status string, title string, text string")).first()
    assert (first["canonical_url"], first["title"], len(first["content_hash"])) == ("https://a.com/x", None, 64)
