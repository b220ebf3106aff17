import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestral.operators import agents, retrieval, runtime, store, traces
from lodestral.plans import app
from lodestral.sources import fetch

SITE = {
    "https://a.com/robots.txt": {"status": 200, "body": b"User-agent: *\nDisallow: /private\n"},
    "https://a.com/feed": {"status": 200, "etag": "f1", "body": b"<rss><channel><item><link>https://a.com/n/1</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item><item><link>https://a.com/private/2</link></item><item><link>https://a.com/n/3</link></item><item><link>https://b.com/out</link></item><item><link>https://a.com/n/4</link></item></channel></rss>"},
    "https://a.com/n/1": {"status": 200, "etag": "p1", "content_type": "text/html; charset=utf-8", "body": b"<title>One</title><main><p>electric vehicle battery</p><p>second line</p></main>"},
    "https://a.com/n/3": {"status": 200, "content_type": "text/html", "body": b"<main></main>"},
    "https://a.com/n/4": {"status": 503},
    "https://a.com/map": {"status": 200, "body": b"<sitemapindex><sitemap><loc>/map2</loc></sitemap><sitemap><loc>https://b.com/map</loc></sitemap></sitemapindex>"},
    "https://a.com/map2": {"status": 200, "body": b"<urlset><url><loc>/n/1</loc></url><url><loc>/n/5</loc></url></urlset>"},
    "https://a.com/n/5": {"status": 200, "content_type": "text/html", "body": b"<p>from a map</p>"},
}


def client(request):
    if request["url"] not in SITE:
        raise fetch.TransportError("unknown host")
    page = SITE[request["url"]]
    return {"status": 304} if request.get("if_none_match") and request["if_none_match"] == page.get("etag") else page


def test_sync_index_search(spark, tmp_path):
    sources = spark.createDataFrame([(0, "s", "S", "news", True, ["a.com"], ["/"], ["https://a.com/feed"], ["https://a.com/map"])], "ord int, id string, name string, source_type string, enabled boolean, allowed_domains array<string>, allowed_path_prefixes array<string>, feeds array<string>, sitemaps array<string>")
    snapshot = spark.createDataFrame([], store.DOCUMENT)
    state = spark.createDataFrame([], "url string, etag string, last_modified string, content binary")
    snapshot, state, failures = app.sync_corpus(sources, snapshot, state, client, "bot", datetime(2024, 2, 1))
    snapshot, state = snapshot.checkpoint(), state.checkpoint()
    got = {r["url"][-1]: (r["status"], r["failure_reason"], r["title"]) for r in snapshot.collect()}
    assert got == {"1": ("active", None, "One"), "2": ("inactive", "robots_disallowed", None), "3": ("inactive", "no_extractable_text", None), "4": ("inactive", "http_status 503", None), "5": ("active", None, None)}
    assert sorted(r["reason"] for r in failures.collect()) == ["http_status 503", "no_extractable_text"]
    assert {r["url"]: r["etag"] for r in state.collect()}["https://a.com/feed"] == "f1" and state.count() == 3
    again, _, _ = app.sync_corpus(sources, snapshot, state, client, "bot", datetime(2024, 3, 1))
    assert {r["url"][-1]: r["status"] for r in again.collect()}["1"] == "active"
    index = app.reindex(snapshot, dimensions=16).checkpoint()
    assert index.count() == 2 and app.reindex(snapshot, index, dimensions=16).filter("vector is null").isEmpty()
    app.write_index(index, str(tmp_path / "index"), "hashing", 16)
    index = app.read_index(spark, str(tmp_path / "index"), "hashing", 16)
    with pytest.raises(ValueError):
        app.read_index(spark, str(tmp_path / "index"), "other", 16)
    assert app.sync_report(snapshot, failures)[1] == 1 and app.sync_report(snapshot, failures.limit(0))[1] == 0
    for mode in ("bm25", "vector", "hybrid"):
        row = json.loads(next(app.as_json(app.search_corpus(index, snapshot, "vehicle", mode, 5, dimensions=16))))
        assert row["title"] == "One" and row["metadata"]["corpus_search_mode"] == mode and len(row["metadata"]) == 7
    with pytest.raises(ValueError):
        app.search_corpus(index, snapshot, "x", "odd")
    assert app.option(spark, "max_chunk_chars") == "1200"


def test_generate(spark):
    prompts = spark.createDataFrame([("a b",), (None,)], "p string")
    rows = prompts.select(agents.generate(F.col("p"), agents.fake_model("x y z")).alias("r")).select("r.*").collect()
    assert [r["prompt_tokens"] for r in rows] == [2, 0] and all(r["completion_tokens"] == 3 and r["attempts"] == 1 for r in rows)

    def broken(prompts):
        raise RuntimeError("down")

    rows = prompts.select(agents.generate(F.col("p"), broken).alias("r")).select("r.*").collect()
    assert all(r["error"] == "RuntimeError: down" and r["attempts"] == 2 for r in rows)


def test_evidence(spark):
    good = '```json\n[{"claim": " a ", "confidence": true}, {"claim": "b", "supporting_text": "s", "confidence": 0.5}]\n```'
    rows = [("d1", 0, good, None), ("d1", 1, "[]", None), ("d2", 0, '[{"claim": "x"}]', None), ("d2", 1, "oops", None), ("d3", 0, '{"a": 1}', None), ("d4", 0, '[{"claim": 3}]', None), ("d5", 0, None, "boom")]
    found, failed = agents.evidence(spark.createDataFrame(rows, "document_id string, position int, response string, error string"))
    assert [(r["claim"], r["confidence"], r["ord"]) for r in found.orderBy("ord").collect()] == [("a", 1.0, 0), ("b", 0.5, 1)]
    assert {r["document_id"]: r["reason"] for r in failed.collect()} == {"d2": "invalid_json", "d3": "invalid_schema", "d4": "invalid_schema", "d5": "llm_error"}


def test_selection(spark):
    results = agents.number_candidates(spark.createDataFrame([(1, 5, "r5"), (1, 2, "r2"), (1, 9, "r9")], "run_id long, ord long, result_id string"))
    answer = spark.createDataFrame([(1, '{"selected_refs": ["C3", "C1"]}')], "run_id long, response string")
    assert [r["result_id"] for r in agents.selection(answer, results).collect()] == ["r2", "r9"]
    with pytest.raises(ValueError):
        agents.selection(spark.createDataFrame([(1, '{"selected_refs": ["C7"]}')], "run_id long, response string"), results)


def test_actions(spark):
    rows = [(1, '<think>x</think>{"type": "research", "params": {"query": "q"}}'), (2, '{"type": "finish"}'), (3, "no"), (4, '{"type": "research", "params": {"query": " "}}'), (5, '{"type": "research", "params": {"query": "q", "source_domains": ["a.com", "x"]}}')]
    available = spark.createDataFrame([(i, ["research", "stop"]) for i in range(1, 6)], "run_id long, actions array<string>")
    got = {r["run_id"]: r["error"] for r in agents.actions(spark.createDataFrame(rows, "run_id long, response string"), available).collect()}
    assert got == {1: None, 2: "action not available", 3: "invalid action", 4: "blank query", 5: "bad domain"}


def test_traces(spark):
    tracer = traces.Tracer("t")
    with pytest.raises(KeyError), tracer.span("agent.run"):
        with tracer.span("agent.step", step_index=0) as s:
            s["output"] = {"action": {"type": "stop"}, "observation": {"x": object()}}
        raise KeyError("k")
    table = tracer.table(spark)
    assert {r["name"]: (r["status"], r["parent_span_id"]) for r in table.collect()} == {"agent.run": ("error", None), "agent.step": ("ok", "t-000001")}
    assert traces.completed_steps(table).count() == 1 and traces.root_seconds(table).count() == 1
    assert {r["span_id"]: r["depth"] for r in traces.depth(table).collect()} == {"t-000001": 0, "t-000002": 1}
    chain = spark.createDataFrame([("t", str(i), str(i - 1) if i else None) for i in range(150)] + [("t", "x", "gone"), ("t", "y", "z"), ("t", "z", "y")], "trace_id string, span_id string, parent_span_id string")
    assert {r["span_id"]: r["depth"] for r in traces.depth(chain).collect()} == {str(i): i for i in range(150)}


def test_runtime(spark):
    plan = iter(["research", "finish"])
    execute = runtime.dispatch({"research": lambda a, s: {"type": "research"}, "finish": lambda a, s: {"type": "finish", "answer": "done"}})
    tracer = traces.Tracer("r")
    result = runtime.run({"query": "q", "max_steps": 5}, lambda s: {"type": next(plan)}, execute, tracer)
    assert result.state["final_answer"] == "done" and result.state["current_step"] == 2 and len(result.state["history"]) == 2
    assert traces.completed_steps(tracer.table(spark)).count() == 2
    endless = runtime.run({"max_steps": 3}, lambda s: {"type": "research"}, execute, traces.Tracer("e"))
    assert not endless.state["done"] and endless.state["current_step"] == 3
    with pytest.raises(runtime.RunError) as e:
        runtime.run({"max_steps": 3}, lambda s: {"type": "odd"}, execute, traces.Tracer("x"))
    assert e.value.trace_id == "x"


def test_index_and_extraction(spark):
    index = spark.createDataFrame([(1, "u1", "r1")], "run_id long, normalized_url string, result_id string")
    new = spark.createDataFrame([(1, "u2", "r2")], index.schema)
    assert retrieval.extend_index(index, new).count() == 2
    with pytest.raises(ValueError):
        retrieval.extend_index(index, index)
    outcomes = spark.createDataFrame([(1, "a", 0, True), (1, "a", 1, True), (1, "b", 2, False), (1, "c", 3, True)], "run_id long, document_id string, ord int, success boolean")
    known = spark.createDataFrame([(1, "c")], "run_id long, document_id string")
    assert [r["document_id"] for r in retrieval.documents_to_extract(outcomes, known).collect()] == ["a"]


def _site(request):
    """Records each request in a folder; /r/k redirects to /p/(k // 10), /bad is missing."""
    import re
    import uuid
    from pathlib import Path

    where, path = re.fullmatch(r"https://site\.test/log(.*?)/(r/\d+|p/\d+|bad/\d+)", request["url"]).groups()
    Path(where, uuid.uuid4().hex).write_text(path)
    kind, k = path.split("/")
    if kind == "bad":
        return {"status": 404}
    final = {"final_url": f"https://site.test/log{where}/p/{int(k) // 10}"} if kind == "r" else {}
    return {"status": 200, "content_type": "text/html", "body": f"<p>page {path}</p>".encode()} | final


def test_waves(spark, tmp_path):
    """No request beyond the budget; pages that are reached twice count once."""
    base = f"https://site.test/log{tmp_path}"
    plans = {
        1: ["p/1", "bad/1", "r/20", "r/21", "p/3", "p/4", "p/5"],  # r/20 and r/21 are the page p/2
        2: ["bad/1", "bad/2", "bad/3"],
        3: ["p/7", "p/8", "p/9", "p/10", "p/11"],  # p/8 is known already
        4: ["r/10", "p/1", "p/6", "p/12", "p/13"],  # p/1 is found by r/10 before its turn, or in its wave
    }
    rows = [(run, k, f"{base}/{p}", f"{base}/{p}") for run, plan in plans.items() for k, p in enumerate(plan)]
    candidates = spark.createDataFrame(rows, "run_id long, ord long, url string, normalized_url string")
    known = spark.createDataFrame([(3, f"{base}/p/8")], "run_id long, normalized_url string")
    nothing = spark.createDataFrame([], store.DOCUMENT)
    got = retrieval.fetch_in_waves(candidates, known, 3, app.documents_or_pages(nothing, _site, 0)).collect()
    table = {(r["run_id"], r["url"].removeprefix(f"{base}/")): (r["document"] and r["document"].removeprefix(f"{base}/"), r["is_new"], r["attempts"], r["reason"]) for r in got}
    assert [p for p in plans[1] if (1, p) in table] == plans[1][:5] and table[1, "r/20"] == ("p/2", True, 1, None) and table[1, "r/21"] == ("p/2", False, 1, None)
    assert all(table[2, p] == (None, False, 1, "http_status 404") for p in plans[2])
    assert [p for p in plans[3] if (3, p) in table] == plans[3][:4] and table[3, "p/8"] == ("p/8", False, 0, None)
    assert [p for p in plans[4] if (4, p) in table] == plans[4][:4] and table[4, "p/1"] == ("p/1", False, 0, None)
    assert {run: sum(v[1] for (r, _), v in table.items() if r == run) for run in plans} == {1: 3, 2: 0, 3: 3, 4: 3}
    # One request for each attempt, of which runs may share some; p/1 of run 4 was asked for in the same wave.
    asked = sorted(p.read_text() for p in tmp_path.iterdir())
    assert not {"p/5", "p/13", "p/11", "p/8"} & set(asked) and len(asked) <= sum(v[2] for v in table.values()) + 1
    assert retrieval.fetch_in_waves(candidates.limit(0), known, 3, app.documents_or_pages(nothing, _site, 0)).collect() == []


def test_runs_side_by_side(spark):
    """Actions without an executor or with an odd observation stop the runs; endless ones end by their steps."""
    states = spark.range(3).withColumnRenamed("id", "run_id")
    always = lambda kind: lambda s: s.select("run_id", F.lit(kind).alias("type"), F.lit("{}").alias("params"))
    say = lambda kind: lambda a: a.select("run_id", F.lit(kind).alias("type"), F.lit("x").alias("answer"))
    ended, history, spans = runtime.run_all(states, always("research"), {"research": say("research")}, 2)
    assert {(r["step"], r["done"], r["answer"]) for r in ended.collect()} == {(2, False, None)} and history.count() == 6 and spans.count() == 3 * 7
    ended, history, spans = runtime.run_all(states, always("finish"), {"finish": say("finish")}, 5)
    assert {(r["step"], r["done"], r["answer"]) for r in ended.collect()} == {(1, True, "x")} and history.count() == 3
    assert traces.depth(spans.select(F.lit("t").alias("trace_id"), "span_id", F.col("parent").alias("parent_span_id"))).agg(F.max("depth")).first()[0] == 2
    for executors in ({}, {"research": say("finish")}, {"research": lambda a: say("research")(a).limit(1)}):
        with pytest.raises(ValueError):
            runtime.run_all(states, always("research"), executors, 2)
    none, history, _ = runtime.run_all(states.limit(0), always("research"), {"research": say("research")}, 2)
    assert none.count() == history.count() == 0
