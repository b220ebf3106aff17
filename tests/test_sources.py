import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestral.sources import discovery, fetch, files, html, registry, robots, web_search


def test_html_strategies():
    assert html.parse_html("<title> A </title><body><header>H</header><p>x <b>y</b></p><footer>f</footer></body>") == {"title": "A", "text": "x y", "strategy": "body", "dates": [], "error": None}
    assert html.parse_html("<main><nav>n</nav><h1>T</h1><p>a</p></main><p>out</p>")["text"] == "T\na"
    assert html.parse_html("<div role=main><li>a<p>b</p></li></div>")["text"] == "a b"
    assert html.parse_html("<article><p>s</p></article><article><p>longer</p></article>")["text"] == "longer"
    assert html.parse_html("<script>x</script>")["error"] == "no_extractable_text"


def test_html_dates(spark):
    """The first valid date counts; dates out of range or malformed are skipped, not raised."""
    script = '<script type="application/ld+json">{}</script>'.format
    meta = '<meta property="article:published_time" content="{}">'.format
    pages = [
        (script('{"x":[{"datePublished":"bad"}],"y":{"datePublished":"2024-02-03"}}'), datetime(2024, 2, 3)),
        (meta("2024-02-03T04:00:00+01:00"), datetime(2024, 2, 3, 3)),
        (meta("Mon, 10 Aug 99999999999999999999 08:00:00 GMT"), None),
        (meta("0001-01-01T00:00:00+05:00"), None),
        (meta("9999-12-31T23:59:59-05:00"), None),
        (script('{"datePublished": 5}') + script("{oops") + meta("Mon, 12 Aug 2024 08:00:00 EST"), datetime(2024, 8, 12, 13)),
        (script("[" * 5000) + meta("2024-02-03T04:00:00"), None),
    ]
    rows = spark.createDataFrame([(i, "text/html", (p + "<p>a</p>").encode()) for i, (p, _) in enumerate(pages)], "id long, media_type string, content binary")
    assert [r["published_at"] for r in html.parse_documents(rows).orderBy("id").collect()] == [d for _, d in pages]


def test_parse_documents(spark):
    rows = spark.createDataFrame([(1, "text/html", b"<p>a</p>"), (2, "application/pdf", b"no"), (3, "image/png", b"")], "id long, media_type string, content binary")
    got = {r["id"]: (r["text"], r["error"]) for r in html.parse_documents(rows).collect()}
    assert got[1] == ("a", None) and got[2][1] == "parse_error" and got[3][1] == "unsupported_media_type"


def pdf_file(pages, title=b"(A \\(test\\))", deflate=False):
    """A small PDF of one content stream a page."""
    import zlib

    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (4 + 2 * k) for k in range(len(pages))) + b"] >>", 3: b"<< /Title " + title + b" >>"}
    for k, content in enumerate(pages):
        objects[4 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (5 + 2 * k)
        data = zlib.compress(content) if deflate else content
        objects[5 + 2 * k] = b"<< /Length %d%s >>\nstream\n" % (len(data), b" /Filter /FlateDecode" if deflate else b"") + data + b"\nendstream"
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in objects.items()) + b"trailer << /Root 1 0 R /Info 3 0 R >>\n%%EOF"


@pytest.mark.parametrize("deflate", [False, True])
def test_pdf(deflate):
    one = b"BT /F1 12 Tf 72 700 Td (Hello \\(all\\)) Tj 0 -14 Td [(sec) -20 (ond) -300 (line)] TJ T* <48 65 79> Tj ET"
    got = html.parse("application/pdf", pdf_file([one, b"BT ET", b"BT (caf\\351) ' ET"], deflate=deflate))
    assert got == {"title": "A (test)", "text": "Hello (all)\nsecond line\nHey\n\ncaf\xe9", "strategy": "pdf", "dates": [], "error": None}
    assert html.parse_pdf(pdf_file([b"BT ET"]))["error"] == "no_extractable_text" and html.parse_pdf(pdf_file([b"BT (x) Tj ET"] * 201))["error"] == "document_too_large"
    assert html.parse_pdf(b"%PDF-1.4 nothing")["error"] == "parse_error" and html.parse_pdf(b"%PDF" + b" " * (20 << 20))["error"] == "document_too_large"
    assert html.parse_pdf(pdf_file([b"x"], title=b"<FEFF00E9>"))["error"] == "no_extractable_text" and html.parse_pdf(pdf_file([b"(t) Tj"], title=b"<FEFF00E9>"))["title"] == "\xe9"


RSS = b"<rss><channel><item><link>https://a.com/shop?size=xl&amp;hue=red#top</link><pubDate>Sat, 17 Feb 2024 21:22:23 +0100</pubDate></item><item><link>https://a.com/shop?hue=red&amp;size=xl</link></item><item><link>tel:12345</link></item></channel></rss>"
ATOM = b'<feed xmlns="http://www.w3.org/2005/Atom"><entry><link rel="self" href="/s"/><link href="/e1"/><published>2024-01-02T00:00:00Z</published></entry><entry><link rel="alternate" href="e2"/><updated>2024-01-02</updated></entry></feed>'
RDF = b'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/"><item><link>https://a.com/r</link><dc:date>2024-01-02</dc:date></item></rdf:RDF>'


def test_feeds():
    assert [u for u, _ in discovery.parse_feed("https://a.com/f/x.xml", ATOM)] == ["https://a.com/e1", "https://a.com/f/e2"]
    assert [d is None for _, d in discovery.parse_feed("https://a.com/f/x.xml", ATOM)] == [False, True]
    assert discovery.parse_feed("https://a.com/", RDF) == [("https://a.com/r", "2024-01-02")]
    for bad in (b"<html/>", b"<rss>", b'<!DOCTYPE x [<!ENTITY a "b">]><rss/>'):
        with pytest.raises(discovery.DiscoveryError):
            discovery.parse_feed("https://a.com/", bad)


def test_sitemaps():
    assert discovery.parse_sitemap("https://a.com/", b"<urlset><url><loc>/x</loc><lastmod>2024-01-01</lastmod></url></urlset>") == [("content", "https://a.com/x")]
    assert discovery.parse_sitemap("https://a.com/", b"<sitemapindex><sitemap><loc>/s.xml</loc></sitemap></sitemapindex>") == [("sitemap", "https://a.com/s.xml")]


def test_discovery_table(spark):
    rows = spark.createDataFrame([("https://a.com/f", "feed", RSS), ("https://a.com/b", "feed", b"<html/>")], "endpoint_url string, kind string, content binary")
    parsed = discovery.parse_endpoints(rows).cache()
    assert parsed.filter("error is not null").count() == 1
    merged = discovery.merge(parsed.filter("error is null")).collect()
    assert [(r["normalized_url"], r["published_at"]) for r in merged] == [("https://a.com/shop?hue=red&size=xl", datetime(2024, 2, 17, 20, 22, 23))]


def test_robots(spark):
    """Own rules of a made-up crawler: the longest pattern counts, allow wins a tie, * and $ as usual."""
    body = "user-agent: *\nDisallow: /\n\nUser-Agent: owl # night crawler\nallow: /barn/*.html$\ndisallow: /barn/\ndisallow: /tie\nallow: /tie\nDisallow:\n"
    assert sorted(robots.parse_rules(body, "Owl/7")) == [(False, "/barn/"), (False, "/tie"), (True, "/barn/*.html$"), (True, "/tie")] and robots.parse_rules(body, "moth") == [(False, "/")]
    files_ = spark.createDataFrame([("https://farm.test:443", 206, body), ("https://none.test:443", 410, ""), ("https://shut.test:443", 401, ""), ("https://slow.test:443", 429, "")], "origin string, status int, body string")
    urls_ = {
        "https://farm.test/barn/hay": "disallowed", "https://farm.test/barn/hay.html": "allowed", "https://farm.test/barn/hay.html?x": "disallowed", "https://farm.test/tie/1": "allowed", "https://farm.test": "allowed",
        "https://none.test/a": "allowed", "https://shut.test/a": "disallowed", "https://slow.test/a": "deferred", "https://new.test/a": "deferred", "https://me:pw@farm.test/": "disallowed",
    }
    rows = spark.createDataFrame(list(enumerate(urls_)), "id long, url string")
    got = robots.decide(rows, files_, robots.rules(files_, "owl"), ["id"])
    assert {r["url"]: r["decision"] for r in got.collect()} == urls_


def _source(**change):
    return {"id": "a", "name": "A", "source_type": "news", "allowed_domains": ["a.com"], "feeds": ["https://a.com/f"]} | change


def test_registry(spark, tmp_path):
    def load(*sources, version=2):
        path = tmp_path / f"r{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps({"schema_version": version, "sources": sources}))
        return registry.load(spark, str(path))

    good = load(_source(), _source(id="b", allowed_domains=["b.com"], feeds=[], enabled=False))
    assert [r["id"] for r in registry.enabled(good).collect()] == ["a"]
    twice = (_source(), _source(allowed_domains=["b.com"], feeds=[]))
    www = (_source(), _source(id="b", allowed_domains=["www.a.com"], feeds=[]))
    for bad in (twice, www, [_source(feeds=["https://b.com/f"])], [_source(allowed_path_prefixes=["x"])], [_source(allowed_domains=["https://a.com"])], [_source(allowed_domains=["a.com."], feeds=[])], [_source(source_type="unknown")]):
        with pytest.raises(registry.RegistryError):
            load(*bad)
    with pytest.raises(registry.RegistryError):
        load(_source(), version=1)


def test_scope(spark):
    sources = spark.createDataFrame([(0, "a", True, ["a.com"], ["/x"]), (1, "b", True, ["a.com"], ["/"])], "ord int, id string, enabled boolean, allowed_domains array<string>, allowed_path_prefixes array<string>")
    rows = spark.createDataFrame([(1, "https://a.com/x"), (2, "https://a.com/x/y"), (3, "https://a.com/xy"), (4, "https://b.com/x")], "id long, url string")
    assert {r["id"]: r["source_id"] for r in registry.match(rows, sources, ["id"]).collect()} == {1: "a", 2: "a", 3: "b", 4: None}


def test_fetch(spark):
    def client(request):
        if "down" in request["url"]:
            raise fetch.TransportError("no route")
        if request["if_none_match"]:
            return {"status": 304}
        return {"status": 200, "body": b"x", "etag": "e2", "content_type": "Text/HTML; x"}

    state = spark.createDataFrame([("https://a.com/", "e1", None, b"old")], "url string, etag string, last_modified string, content binary")
    ends = spark.createDataFrame([("https://a.com/",), ("https://b.com/",), ("https://down.com/",)], "url string")
    responses = fetch.fetch(fetch.conditional_requests(ends, state), client, delay=0)
    got = {r["url"]: r for r in fetch.response_state(responses, state).collect()}
    assert bytes(got["https://a.com/"]["content"]) == b"old" and got["https://a.com/"]["etag"] == "e1"
    assert bytes(got["https://b.com/"]["content"]) == b"x" and got["https://b.com/"]["media_type"] == "text/html"
    assert got["https://down.com/"]["error"] == "transport"
    assert {r["attempt_count"] for r in responses.filter("url like '%down%'").collect()} == {2}


def test_search_response(spark):
    body = json.dumps({"results": [{"title": "a", "url": "u1", "score": 0.5}, {"title": "no url"}, "odd", {"title": "d", "url": "u4", "content": "c"}]})
    rows = spark.createDataFrame([(1, body), (2, "[]"), (3, "oops")], "request_id long, response string")
    got = [(r["request_id"], r["rank"], r["url"], r["error"]) for r in fetch.parse_search(rows).orderBy("request_id", "rank").collect()]
    assert got == [(1, 1, "u1", None), (1, 4, "u4", None), (2, None, None, "invalid_response"), (3, None, None, "invalid_response")]
    assert json.loads(fetch.search_payload("q", region="de")) == {"query": "q", "max_results": 10, "country": "de"}


def test_files(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    path.write_text('{"id": 1, "q": "a"}\n\n{"id": 2, "q": "b"}\n')
    assert [(r["ord"], r["id"]) for r in files.read_cases(spark, str(path), "id long, q string", "id").orderBy("ord").collect()] == [(0, 1), (2, 2)]
    path.write_text('{"id": 1}\n{oops\n')
    with pytest.raises(ValueError, match=":2:"):
        files.read_cases(spark, str(path), "id long, q string")
    path.write_text('{"id": 1}\n{"id": 1}\n')
    with pytest.raises(ValueError, match="duplicate"):
        files.read_cases(spark, str(path), "id long, q string", "id")


def test_decrypt(spark):
    import base64
    import hashlib

    key = hashlib.sha256(b"k").digest()
    cipher = base64.b64encode(bytes(b ^ key[i % 32] for i, b in enumerate("héllo".encode() * 9))).decode()
    assert spark.createDataFrame([(cipher,)], "c string").select(files.decrypt(F.col("c"), F.lit("k")).alias("p")).first()["p"] == "héllo" * 9


def test_artifacts(spark):
    schema = "artifact_type string, id string, ord long, payload string"
    store = spark.createDataFrame([("doc", "1", 0, "a")], schema)
    more = files.put_artifacts(store, spark.createDataFrame([("doc", "2", 1, "b")], schema))
    assert [r["id"] for r in files.list_artifacts(more, "doc").collect()] == ["1", "2"] and files.get_artifact(more, "other", "1").isEmpty()
    with pytest.raises(ValueError):
        files.put_artifacts(store, store)


def test_numbered_lines(spark, tmp_path):
    """Files cut into many ranges: numbers, order and errors are those of a reader line by line."""
    texts = {"a.jsonl": "".join(f'{{"id": {k}}}\r\n' if k % 7 else "\n" for k in range(900)), "b.jsonl": '\n{"id": 5000}\n\n{"id": 5001}', "c.jsonl": ""}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        read = files.numbered_lines(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() >= 4 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = sorted((r["ord"], r["file"].rsplit("/", 1)[-1], r["number"], r["line"]) for r in read.collect())
        expected = [(name, k, line) for name, text in texts.items() for k, line in enumerate(text.replace("\r\n", "\n").split("\n")[: None if text and not text.endswith("\n") else -1], 1)]
        assert got == [(o, *row) for o, row in enumerate(expected)]
        assert [r["id"] for r in files.read_cases(spark, str(tmp_path), "id int", "id").orderBy("ord").collect()] == [k for k in range(900) if k % 7] + [5000, 5001]
        (tmp_path / "b.jsonl").write_text('{"id": 1}\n\nbroken\n{"id": ')
        with pytest.raises(ValueError, match=r"b\.jsonl:3: invalid case"):
            files.read_cases(spark, str(tmp_path), "id int")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_robot_rules_by_beginnings(spark):
    """Looking rules up by their literal beginnings finds what matching every rule finds."""
    patterns = ["/", "/a", "/a/b", "/a/*b", "/*", "*", "*.html$", "/a$", "/a/b$", "/x*y*z$", "/$", "/a*", "/a?b=*", "/é", "/a.b"]
    targets = ["/", "/a", "/a/", "/a/b", "/a/b/c", "/a/xb", "/q.html", "/q.html?x", "/x1y2z", "/x1y2zz", "/a?b=1", "/éx", "/acb"]
    rows = spark.createDataFrame([(k, "o", t) for k, t in enumerate(targets)] + [(99, "none", "/a")], "id int, origin string, target string")
    table = spark.createDataFrame([("o", k % 2 == 0, p, robots.pattern_regex(p)) for k, p in enumerate(patterns)], "origin string, allow boolean, pattern string, regex string")
    found = {(r["id"], r["pattern"]) for r in robots.matches(rows, table, ["id"]).collect()}
    import re

    assert found == {(k, p) for k, t in enumerate(targets) for p in patterns if re.search(robots.pattern_regex(p), t)}


def _timed(request):
    """Notes when a request ran, and in which task."""
    import time
    import uuid
    from pathlib import Path

    from pyspark import TaskContext

    where = request["url"].split("#")[1]
    began = time.time()
    time.sleep(0.03)
    Path(where, uuid.uuid4().hex).write_text(f"{began} {time.time()} {request['url'].split('/')[2]} {TaskContext.get().partitionId()}")
    return {"status": 200}


def _load(folder, host):
    """Most requests in flight, tasks, and requests a second of a host."""
    rows = [(float(a), float(b), p) for a, b, h, p in (f.read_text().split() for f in folder.iterdir()) if h == host]
    edges = sorted([(a, 1) for a, _, _ in rows] + [(b, -1) for _, b, _ in rows], key=lambda e: (e[0], e[1]))
    most = now = 0
    for _, e in edges:
        most = max(most, now := now + e)
    return most, len({p for _, _, p in rows}), len(rows) / max(1e-9, max(b for _, b, _ in rows) - min(a for a, _, _ in rows))


@pytest.mark.parametrize(("host_tasks", "rate"), [(1, None), (4, None), (4, 20.0)])
def test_hot_host(spark, tmp_path, host_tasks, rate):
    """Requests of one host in many tasks: no more at a time, and no more a second, than in one."""
    table = [(f"https://{'hot.test' if k % 8 else 'cold.test'}/{k}#{tmp_path}", None, None) for k in range(96)]
    requests = spark.createDataFrame(table, "url string, if_none_match string, if_modified_since string")
    got = fetch.fetch(requests, _timed, tasks=16, host_tasks=host_tasks, rate=rate).collect()
    assert len(got) == 96 and all(r["status"] == 200 and r["attempt_count"] == 1 for r in got)
    most, tasks, pace = _load(tmp_path, "hot.test")
    assert most <= 4 and (tasks == 1 if host_tasks == 1 else 2 <= tasks <= 4)
    if rate:
        assert pace <= rate * 1.6  # buckets start with a few tokens


def test_search_pushdown(spark):
    """Filters are pushed and not applied again; what can't be pushed stays with Spark."""
    reader = web_search._Reader(None)
    left = list(reader.pushFilters([web_search.In(("query",), ("b", "a")), web_search.EqualTo(("country",), "de"), web_search.EqualTo(("country",), "fr"), web_search.LessThan(("rank",), 4), web_search.EqualTo(("title",), "x"), web_search.EqualTo(("domain",), "d.test")]))
    assert [(f.attribute, f.value) for f in left] == [(("country",), "fr"), (("title",), "x")]
    assert (reader.queries, reader.domains, reader.most, reader.fixed) == (["a", "b"], ["d.test"], 3, {"country": "de"})

    def client(request):
        import json

        asked = json.loads(request["body"])
        items = [{"title": "t", "url": f"https://s.test/{k}", "content": request["body"]} for k in range(20)]
        return {"status": 503} if asked["query"] == "down" else {"status": 200, "body": json.dumps({"results": items}).encode()}

    spark.dataSource.register(web_search.source(client, "web_search_test"))
    with web_search.pushdown(spark):
        got = spark.read.format("web_search_test").load().filter("query = 'q' and country = 'de' and rank <= 2 and url like '%1'")
        rows = got.collect()
        assert [(r["rank"], r["url"], r["content"]) for r in rows] == [(2, "https://s.test/1", '{"query": "q", "max_results": 2, "country": "de"}')]
        assert [r["error"] for r in spark.read.format("web_search_test").load().filter("query = 'down'").collect()] == ["http_status 503"]
        with pytest.raises(Exception, match="needs a filter on query"):
            spark.read.format("web_search_test").load().collect()


def test_open_references():
    """A reference that was cut is decoded as by browsers, or stays as written."""
    page = "<title>a&amp;b&amp</title><article><p>&lt;x&gt &am &ampx; &#x27;&#39 &copy; R&D</p></article>"
    assert [html.parse_html(page)[c] for c in ("title", "text")] == ["a&b&", "<x> &am &x; '' © R&D"]
    assert [html.parse_html(page, closed=True)[c] for c in ("title", "text")] == ["a&b&amp", "<x&gt &am &ampx; '&#39 © R&D"]


@pytest.mark.parametrize("name", ["html_extract", "job1_ingest_pages"])
def test_cut_references_as_in_sql(spark, tmp_path, name):
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    pages = [(k, f"https://a.test/{k}", f"<html><title>T &amp; {cut}</title><body><article><h1>T &amp; {cut}</h1><p>x &quot;y&quot; {cut}</p></article></body></html>") for k, cut in enumerate(("&amp;", "&amp", "&am", "R&D"))]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    wanted = duck.execute(oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    got = queries()[name](spark, str(tmp_path)).select(columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, wanted.fetchall()))
