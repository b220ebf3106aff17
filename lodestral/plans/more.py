"""Further queries: connectors, parsers, agent steps and the corpus application, with their SQL oracles.

Web sites, models and files are made by rule from ids, so that SQL can tell what must come out.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Window as W, functions as F

from lodestral.functions import times, urls, values
from lodestral.functions.session import checkpoint, checkpoint_dir
from lodestral.operators import agents, chunking, embeddings, evaluation, inverted, research, retrieval, runtime, search, store, sync, traces
from lodestral.plans import app
from lodestral.plans.catalog import _HOST, _PARAGRAPHS, _STATE, _TOKENS, ORACLES, QUERIES, TERMS, _snapshot, _t, query  # noqa: F401
from lodestral.sources import discovery, fetch, files, html, registry, robots
from lodestral.sources import web_search as search_source
from lodestral.streaming import endpoints, runs


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _values(names: str, rows: list[tuple]) -> str:
    literal = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'{}'".format(v.replace("'", "''")) if isinstance(v, str) else str(v)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") v({names})"


# ---------------------------------------------------------------- registry and files

_HOSTS = f"(SELECT DISTINCT {_HOST} AS h FROM pages)"


def _hosts(spark, d) -> DataFrame:
    return _t(spark, d, "pages").select(urls.host(F.col("url")).alias("h")).distinct()


@query(f"""SELECT (row_number() OVER (ORDER BY replace(h, '.', '-')) - 1)::INTEGER AS ord, replace(h, '.', '-') AS id, CASE WHEN length(h) % 2 = 0 THEN 'news' ELSE 'blog' END AS source_type, length(h) % 3 > 0 AS enabled,
h || ',x' || h AS domains, CASE WHEN length(h) % 4 = 0 THEN '/en,/fr' ELSE '/' END AS prefixes, CASE WHEN length(h) % 5 = 0 THEN 0 ELSE 2 END AS endpoints FROM {_HOSTS}""")
def registry_load(spark, d):
    """A registry of the pages' hosts as its JSON file, read with defaults and checked by its rules."""
    h, n = F.col("h"), F.length("h")
    ends = lambda what: F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("https://"), h, F.lit(f"/{what}"))))
    source = F.struct(
        F.replace(h, F.lit("."), F.lit("-")).alias("id"), h.alias("name"), F.when(n % 2 == 0, "news").otherwise("blog").alias("source_type"), F.when(n % 3 == 0, False).alias("enabled"),
        F.array(F.concat(F.lit(" "), F.upper(h)), F.concat(F.lit("x"), h)).alias("allowed_domains"), F.when(n % 4 == 0, F.array(F.lit("/en"), F.lit("/fr"))).alias("allowed_path_prefixes"), ends("feed").alias("feeds"), ends("map").alias("sitemaps"),
    )
    path = _folder(spark, "registry")
    whole = _hosts(spark, d).agg(F.sort_array(F.collect_list(source)).alias("sources"))  # one file, as registries are
    whole.select(F.to_json(F.struct(F.lit(2).alias("schema_version"), "sources"))).coalesce(1).write.text(path)
    found = registry.load(spark, path)
    return found.select(
        "ord", "id", "source_type", "enabled", F.array_join("allowed_domains", ",").alias("domains"),
        F.array_join("allowed_path_prefixes", ",").alias("prefixes"), (F.size("feeds") + F.size("sitemaps")).alias("endpoints")
    )


@query(f"""SELECT CASE WHEN k = 0 THEN 'Bad ' || h ELSE h END AS id, ['bad id', 'bad source type', 'no domain', 'bad domain', 'bad path prefix', 'endpoint outside domains', 'endpoint with fragment', 'duplicate entries', 'domain of two sources'][k + 1] AS rule
FROM (SELECT replace(h, '.', '-') AS h, length(h) % 10 AS k FROM {_HOSTS}) WHERE k < 9""")
def registry_violations(spark, d):
    """Sources of the pages' hosts, nine of ten of which break one rule each."""
    h, k = F.col("h"), F.length("h") % 10
    id_, none = F.replace(h, F.lit("."), F.lit("-")), F.array().cast("array<string>")
    url = lambda host, tail: F.array(F.concat(F.lit("https://"), host, F.lit(tail)))
    own = _hosts(spark, d).select(
        F.when(k == 0, F.concat(F.lit("Bad "), id_)).otherwise(id_).alias("id"), h.alias("name"), F.when(k == 1, "rumour").otherwise("news").alias("source_type"), F.lit(True).alias("enabled"),
        F.when(k == 2, none).when(k == 3, F.array(F.replace(h, F.lit("."), F.lit("")))).otherwise(F.array(h)).alias("allowed_domains"), F.when(k == 4, F.array(F.lit("x"))).when(k == 7, F.array(F.lit("/"), F.lit("/"))).otherwise(F.array(F.lit("/"))).alias("allowed_path_prefixes"),
        F.when(k == 5, url(F.lit("else.test"), "/f")).when(k == 6, url(h, "/f#x")).otherwise(none).alias("feeds"), none.alias("sitemaps"), k.alias("k"),
    )
    twin = own.filter("k = 8").withColumn("id", F.concat("id", F.lit("-twin"))).withColumn("allowed_domains", F.array(F.concat(F.lit("www."), "name")))
    return registry.violations(registry.with_defaults(own.union(twin)))


@query("SELECT item_id, sha256(text) AS text_hash FROM benchmark")
def case_lines(spark, d):
    path = _folder(spark, "cases")
    files.write_lines(_t(spark, d, "benchmark").select("item_id", "text"), path)
    return files.read_cases(spark, path, "item_id long, text string", "item_id").select("item_id", F.sha2("text", 256).alias("text_hash"))


@query(
    "SELECT conv_id, turn, conv_id % 3 AS part, row_number() OVER (PARTITION BY conv_id % 3 ORDER BY conv_id, turn)::BIGINT AS number, row_number() OVER (ORDER BY conv_id % 3, conv_id, turn) - 1 AS ord FROM conversations"
)
def line_numbers(spark, d):
    """Lines of three files, read in byte ranges of a few kilobytes, with their numbers in the file and in all."""
    path, part = _folder(spark, "lines"), F.col("conv_id") % 3
    c = _t(spark, d, "conversations").select(F.to_json(F.struct("conv_id", "turn", "text")).alias("value"), part.alias("part"), "conv_id", "turn")
    c.repartitionByRange(3, "part").sortWithinPartitions("part", "conv_id", "turn").select("value", "part").write.partitionBy("part").text(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        found = checkpoint(files.numbered_lines(spark, f"{path}/*"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    case = F.from_json("line", "conv_id long, turn long").alias("c")
    return found.select(case, "number", "ord").select("c.*", (F.col("c.conv_id") % 3).alias("part"), "number", "ord")


@query(
    "SELECT item_id AS id, sha256(text) AS question_hash, CASE WHEN item_id % 2 = 0 THEN 'item' ELSE 'set' END AS answer_type, 'open' AS question_type, item_id % 3 AS topic FROM benchmark"
)
def prepared_questions(spark, d):
    """Encrypted questions decrypted, written as JSON lines and read again."""
    raw = _t(spark, d, "benchmark").select(
        F.col("item_id").alias("id"), files.encrypt(F.col("text"), F.lit("secret")).alias("question"),
        F.when(F.col("item_id") % 2 == 0, "ITEM").otherwise("Set").alias("answer_type"), F.lit("OPEN").alias("question_type"),
        (F.col("item_id") % 3).alias("topic")
    )
    path = _folder(spark, "questions")
    files.write_lines(files.prepare_questions(raw, "secret"), path)
    back = spark.read.schema("id long, question string, answer_type string, question_type string, topic long").json(path)
    return back.select("id", F.sha2("question", 256).alias("question_hash"), "answer_type", "question_type", "topic")


@query("SELECT doc_id, 'id' AS how, sha256(text) AS content_hash FROM documents WHERE doc_id = 7 UNION ALL SELECT doc_id, 'url', sha256(text) FROM documents WHERE doc_id = 11")
def document_lookup(spark, d):
    snapshot = _snapshot(_t(spark, d, "documents"), "2024-01-01")
    both = store.get(snapshot, "id7").withColumn("how", F.lit("id")).union(store.get_by_url(snapshot, " HTTPS://X.org/d/11/ ").withColumn("how", F.lit("url")))
    return both.select(F.substring("id", 3, 20).cast("long").alias("doc_id"), "how", "content_hash")


@query("SELECT doc_id::VARCHAR AS id, doc_id AS ord, quality::VARCHAR AS payload FROM labels")
def artifact_log(spark, d):
    put = lambda t, kind, payload: t.select(
        F.lit(kind).alias("artifact_type"), F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("ord"),
        F.col(payload).cast("string").alias("payload")
    )
    log = files.put_artifacts(put(_t(spark, d, "documents"), "document", "lang"), put(_t(spark, d, "labels"), "label", "quality"))
    return files.list_artifacts(log, "label").select("id", "ord", "payload")


@query("SELECT item_id AS id, length(text)::BIGINT AS n FROM benchmark")
def prediction_export(spark, d):
    path = _folder(spark, "predictions")
    files.export_by_id(_t(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.length("text").cast("long").alias("n")), path)
    return spark.read.schema("n long, id long").json(path).select("id", "n")


@query(f"SELECT doc_id, count(*) AS chunks, 'hashing' AS model, 64 AS dimensions FROM ({_PARAGRAPHS}) GROUP BY doc_id")
def options(spark, d):
    """Chunks of each document by the session's options, which have their defaults here."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("active").alias("status"))
    chunks = chunking.chunk_documents(docs, int(app.option(spark, "max_chunk_chars"))).groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("chunks"))
    return chunks.select("*", F.lit(app.option(spark, "embedding_model")).alias("model"), F.lit(int(app.option(spark, "embedding_dimensions"))).alias("dimensions"))


# ---------------------------------------------------------------- values


@query("""SELECT event_id, 'text/html' AS media_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS label, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE round_even(event_id / (event_id % 4 * 1000.0), 4) END AS ratio,
event_id % 600 IN (408, 425, 429) OR event_id % 600 >= 500 AS retry_status, CASE WHEN event_id % 5 = 0 THEN 'transport' ELSE 'http_status' END AS kind, event_id % 5 = 0 OR event_id % 600 IN (408, 425, 429) OR event_id % 600 >= 500 AS retryable,
'D' || event_id AS ref FROM events""")
def value_shapes(spark, d):
    """Media types, blank strings, ratios, error kinds and references."""
    i, status = F.col("event_id"), F.col("event_id") % 600
    kind = values.error_kind(F.when(i % 5 != 0, status))
    return _t(spark, d, "events").select(
        "event_id", values.media_type(F.lit(" Text/HTML ; charset=x")).alias("media_type"), values.blank_to_null(
            F.when(i % 3 == 0, " \t").otherwise(F.concat(F.lit(" "), "event_type"))
        ).alias("label"), values.ratio(i, (i % 4) * 1000).alias("ratio"),
        values.retryable_status(status).alias("retry_status"), kind.alias("kind"), values.retryable(kind, status).alias("retryable"), values.numbered("D", i).alias("ref"),
    )


@query("SELECT doc_id, left(text, 300) AS preview, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS body FROM documents")
def fenced_answers(spark, d):
    """Claim previews, and texts that come back out of thoughts and fences."""
    answer = F.concat(F.lit(" <think>a\nb</think>```json\n"), "text", F.lit("\n```\n"))
    return _t(spark, d, "documents").select(
        "doc_id", values.preview(F.col("text")).alias("preview"), F.md5(values.unfence(values.without_thoughts(answer)).cast("binary")).alias("body")
    )


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN epoch(date_trunc('day', ts)) WHEN 1 THEN epoch(date_trunc('second', ts)) WHEN 2 THEN epoch(date_trunc('second', ts)) - 7200 WHEN 3 THEN epoch(date_trunc('second', ts))
WHEN 4 THEN epoch(date_trunc('minute', ts)) + 18000 END::BIGINT AS seconds FROM events""")
def date_forms(spark, d):
    """Dates, offsets, mail dates with zones by number and name; naive and odd ones are null."""
    ts, form = F.col("ts").cast("timestamp"), F.col("event_id") % 8
    as_ = lambda f: F.date_format(ts, f)
    written = (
        F.when(form == 0, as_("yyyy-MM-dd")).when(form == 1, F.concat(as_("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(
            form == 2, F.concat(as_("yyyy-MM-dd HH:mm:ss"), F.lit("+02:00"))
        )
        .when(
            form == 3, F.concat(F.lit("Mon, "), as_("dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
        ).when(form == 4, F.concat(as_("d MMM yyyy HH:mm"), F.lit(" EST"))).when(form == 5, as_("yyyy-MM-dd'T'HH:mm:ss"))
        .when(form == 6, F.concat(as_("dd MMM yyyy HH:mm:ss"), F.lit(" -0000"))).otherwise(F.lit("Mon, 10 Aug 99999999999999999999 08:00:00 GMT"))
    )
    return _t(spark, d, "events").select("event_id", F.unix_timestamp(times.external(written)).alias("seconds"))


# ---------------------------------------------------------------- parsing


@query("""SELECT doc_id, 'T' || doc_id AS title, CASE doc_id % 5 WHEN 0 THEN 'main' WHEN 1 THEN 'role_main' WHEN 2 THEN 'article' WHEN 3 THEN 'body' END AS strategy,
CASE doc_id % 5 WHEN 2 THEN 'longer ' || doc_id || chr(10) || 'quoted' WHEN 4 THEN NULL ELSE 'head' || chr(10) || 'first <b> ' || doc_id || chr(10) || 'item' END AS text,
CASE WHEN doc_id % 3 = 0 THEN '2024-02-03 00:00:00' WHEN doc_id % 3 = 1 THEN '2024-05-06 06:08:09' END AS published_at, CASE WHEN doc_id % 5 = 4 THEN 'no_extractable_text' END AS error FROM labels""".replace("WHEN 3 THEN 'body' END AS strategy", "WHEN 3 THEN 'body' ELSE 'body' END AS strategy"))
def html_variants(spark, d):
    """Roots, noise, blocks and dates of pages of five shapes."""
    i = F.col("doc_id")
    s = i.cast("string")
    core = F.concat(
        F.lit("<nav>n</nav><h2>head</h2><aside><p>no</p></aside><p>first <i>&lt;b&gt;</i> "), s,
        F.lit("</p><form><p>f</p></form><ul><li>item</li></ul><script>x</script>")
    )
    body = (
        F.when(
            i % 5 == 0, F.concat(F.lit("<article><p>other</p></article><main>"), core, F.lit("</main>"))
        ).when(i % 5 == 1, F.concat(F.lit("<p>out</p><div role='main'>"), core, F.lit("</div>")))
        .when(i % 5 == 2, F.concat(F.lit("<article><p>short</p></article><article><p>longer "), s, F.lit("</p><blockquote>quoted</blockquote></article>")))
        .when(i % 5 == 3, F.concat(F.lit("<header><p>h</p></header>"), core, F.lit("<footer><p>f</p></footer>"))).otherwise(F.lit("<dialog><p>d</p></dialog>"))
    )
    date = F.when(
        i % 3 == 0, F.lit('<script type="application/ld+json">[{"datePublished": "soon"}, {"a": [{"datePublished": "2024-02-03"}]}]</script>')
    ).when(i % 3 == 1, F.lit('<meta property="article:published_time" content="2024-05-06T07:08:09+01:00">')).otherwise("")
    page = F.concat(F.lit("<html><head><title> T"), s, F.lit(" </title>"), date, F.lit("</head><body>"), body, F.lit("</body></html>"))
    rows = _t(spark, d, "labels").select("doc_id", F.lit("text/html").alias("media_type"), F.encode(page, "UTF-8").alias("content"))
    return html.parse_documents(rows, "doc_id").withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))


@query("""SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'Item ' || item_id END AS title, CASE item_id % 4 WHEN 0 THEN 'one ' || item_id || chr(10) || 'two' || chr(10) || chr(10) || 'three' END AS text,
CASE item_id % 4 WHEN 1 THEN 'parse_error' WHEN 2 THEN 'no_extractable_text' WHEN 3 THEN 'unsupported_media_type' END AS error FROM benchmark""")
def pdf_extract(spark, d):
    """Small PDF files by rule: with text, damaged, without text, of another type."""
    s = F.col("item_id").cast("string")
    file = lambda a, b: F.concat(
        F.lit(
            "%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [3 0 R 5 0 R]>> endobj\n3 0 obj <</Type /Page /Contents 4 0 R>> endobj\n4 0 obj <<>> stream\n"
        ), a,
        F.lit(
            "\nendstream endobj\n5 0 obj <</Type /Page /Contents 6 0 R>> endobj\n6 0 obj <<>> stream\n"
        ), b, F.lit("\nendstream endobj\n7 0 obj <</Title (Item "), s, F.lit(")>> endobj\ntrailer <</Info 7 0 R>>\n"),
    )
    k = F.col("item_id") % 4
    body = F.when(
        k == 0, file(F.concat(F.lit("BT (one "), s, F.lit(") Tj 0 -9 Td (two) Tj ET")), F.lit("BT [(thr) 5 (ee)] TJ ET"))
    ).when(k == 1, "%PDF-1.4 broken").otherwise(file(F.lit("BT ET"), F.lit("BT ET")))
    rows = _t(spark, d, "benchmark").select("item_id", F.when(k == 3, "image/png").otherwise("application/pdf").alias("media_type"), F.encode(body, "UTF-8").alias("content"))
    return html.parse_documents(rows, "item_id").select("item_id", "title", "text", "error")


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://a.test/n/' || page_id || '?x=1&y=2' WHEN 1 THEN 'https://a.test/feeds/e' || page_id WHEN 2 THEN 'https://b.test/r' || page_id END AS url,
CASE page_id % 6 WHEN 0 THEN '2024-01-02 02:04:05' WHEN 1 THEN '2024-03-04 00:00:00' WHEN 2 THEN '2024-01-05 00:00:00' END AS published, page_id % 6 > 2 AS failed FROM pages""")
def feed_entries(spark, d):
    """RSS, Atom and RDF entries; entities, malformed XML and other roots fail."""
    i, s = F.col("page_id"), F.col("page_id").cast("string")
    xml = (
        F.when(
            i % 6 == 0,
            F.concat(
                F.lit("<rss><channel><link>no</link><item><link> /n/"), s,
                F.lit("?x=1&amp;y=2 </link><pubDate>Tue, 02 Jan 2024 03:04:05 +0100</pubDate></item></channel></rss>")
            )
        )
        .when(
            i % 6 == 1,
            F.concat(
                F.lit("<feed xmlns='http://www.w3.org/2005/Atom'><entry><link rel='self' href='s'/><link href='e"), s,
                F.lit("'/><published>2024-03-04T00:00:00Z</published></entry></feed>")
            )
        )
        .when(
            i % 6 == 2,
            F.concat(
                F.lit("<r:RDF xmlns:r='http://r' xmlns:dc='http://d'><item><link>https://b.test/r"), s,
                F.lit("</link><dc:date>2024-01-05</dc:date></item></r:RDF>")
            )
        )
        .when(i % 6 == 3, F.lit("<!doctype x [<!ENTITY a 'b'>]><rss/>")).when(i % 6 == 4, F.lit("<rss><item>")).otherwise(F.lit("<html/>"))
    )
    rows = _t(spark, d, "pages").select(
        F.concat(F.lit("https://a.test/feeds/"), s, F.lit(".xml")).alias("endpoint_url"), F.lit("feed").alias("kind"), F.encode(xml, "UTF-8").alias("content")
    )
    found = discovery.parse_endpoints(rows)
    return found.select(
        F.regexp_extract("endpoint_url", r"(\d+)\.xml", 1).cast("long").alias("page_id"), "url",
        F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"), F.col("error").isNotNull().alias("failed")
    )


@query(
    "SELECT page_id, 'sitemap' AS kind, 'https://a.test/m' || page_id AS url FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'content', 'https://a.test/maps/p' || page_id FROM pages WHERE page_id % 2 = 1"
)
def sitemap_entries(spark, d):
    i, s = F.col("page_id"), F.col("page_id").cast("string")
    xml = F.when(
        i % 2 == 0, F.concat(F.lit("<sitemapindex xmlns='http://s'><sitemap><loc>/m"), s, F.lit("</loc></sitemap></sitemapindex>"))
    ).otherwise(F.concat(F.lit("<urlset><url><loc>p"), s, F.lit("</loc><lastmod>2024-01-01</lastmod></url><url/></urlset>")))
    rows = _t(spark, d, "pages").select(F.concat(F.lit("https://a.test/maps/"), s).alias("endpoint_url"), F.lit("sitemap").alias("kind"), F.encode(xml, "UTF-8").alias("content"))
    return discovery.parse_endpoints(rows).select(F.element_at(F.split("endpoint_url", "/"), -1).cast("long").alias("page_id"), "kind", "url")


# ---------------------------------------------------------------- fetching


def _by_number(request: dict) -> dict:
    """A site whose answer depends on the number that ends the URL."""
    n = int(request["url"].rsplit("/", 1)[-1])
    match n % 5:
        case 0:
            return {"status": 200, "body": b"page", "content_type": "text/html", "etag": f"e{n}"}
        case 1:
            return {"status": 304} if request.get("if_none_match") else {"status": 200, "body": b"new", "content_type": "TEXT/html; x", "etag": None}
        case 2:
            return {"status": 503}
        case 3:
            raise fetch.TransportError("no route")
    return {"status": 404}


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 200 WHEN 1 THEN CASE WHEN page_id % 2 = 0 THEN 304 ELSE 200 END WHEN 2 THEN 503 WHEN 4 THEN 404 END AS status, CASE WHEN page_id % 5 IN (2, 3) THEN 2 ELSE 1 END AS attempts,
CASE page_id % 5 WHEN 0 THEN 'e' || page_id WHEN 1 THEN CASE WHEN page_id % 2 = 0 THEN 'old' END END AS etag, CASE page_id % 5 WHEN 0 THEN 'page' WHEN 1 THEN CASE WHEN page_id % 2 = 0 THEN 'kept' ELSE 'new' END END AS body,
CASE page_id % 5 WHEN 2 THEN 'http_status 503' WHEN 3 THEN 'transport' WHEN 4 THEN 'http_status 404' END AS error FROM pages""")
def conditional_fetch(spark, d):
    """Conditional requests with retries, and the state of endpoints after them."""
    ends = _t(spark, d, "pages").select("page_id", F.concat(F.lit("https://h"), F.col("page_id") % 9, F.lit(".test/"), "page_id").alias("url"))
    state = ends.select(
        "url", F.when(F.col("page_id") % 2 == 0, "old").alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.encode(F.lit("kept"), "UTF-8").alias("content")
    )
    responses = checkpoint(fetch.fetch(fetch.conditional_requests(ends, state), _by_number, delay=0))
    after = fetch.response_state(responses, state)
    joined = ends.join(responses.select("url", "status", "attempt_count"), "url").join(after, "url")
    good = F.col("error").isNull()
    return joined.select(
        "page_id", "status", F.col("attempt_count").alias("attempts"), F.when(good, F.col("etag")).alias("etag"),
        F.when(good, F.decode("content", "UTF-8")).alias("body"), "error"
    )


@query("""SELECT page_id, r AS rank, CASE r WHEN 1 THEN 'https://s.test/' || page_id WHEN 3 THEN 'https://s.test/x' END AS url, CASE r WHEN 1 THEN page_id / 4.0 END AS score, CASE WHEN page_id % 4 = 3 THEN 'invalid_response' END AS error
FROM (SELECT page_id, unnest(CASE WHEN page_id % 4 = 3 THEN [NULL] ELSE [1, 3] END) AS r FROM pages)""")
def web_search(spark, d):
    """Items of search responses keep their ranks; responses without results are errors."""
    s = F.col("page_id").cast("string")
    good = F.concat(
        F.lit('{"results": [{"title": "a", "url": "https://s.test/'), s, F.lit('", "score": '), (F.col("page_id") / 4).cast("string"),
        F.lit('}, {"title": "no url"}, {"title": "b", "url": "https://s.test/x"}, 5]}')
    )
    rows = _t(spark, d, "pages").select(F.col("page_id").alias("request_id"), F.when(F.col("page_id") % 4 == 3, "[1]").otherwise(good).alias("response"))
    return fetch.parse_search(rows).select(F.col("request_id").alias("page_id"), "rank", "url", "score", "error")


@query("""SELECT conv_id, turn, sha256(text) AS query_hash, 1 + turn % 10 AS max_results, CASE WHEN conv_id % 2 = 0 THEN 'de' END AS country, CASE WHEN conv_id % 3 = 0 THEN 'week' END AS time_range,
CASE WHEN conv_id % 4 = 0 THEN role || '.test,x.test' END AS domains, 2 + (conv_id % 2 = 0)::BIGINT + (conv_id % 3 = 0)::BIGINT + (conv_id % 4 = 0)::BIGINT AS fields FROM conversations""")
def search_request(spark, d):
    """Web-search requests for every turn of the conversations: what isn't asked for is left out."""
    i = F.col("conv_id")
    domains = F.when(i % 4 == 0, F.array(F.concat("role", F.lit(".test")), F.lit("x.test")))
    made = fetch.search_requests(F.col("text"), 1 + F.col("turn") % 10, F.when(i % 2 == 0, "de"), F.when(i % 3 == 0, "week"), domains)
    p = lambda path: F.get_json_object("payload", f"$.{path}")
    asked = _t(spark, d, "conversations").select("conv_id", "turn", made.alias("payload"))
    return asked.select(
        "conv_id", "turn", F.sha2(p("query"), 256).alias("query_hash"), p("max_results").cast("long").alias("max_results"), p("country").alias("country"), p("time_range").alias("time_range"),
        F.array_join(F.from_json(p("include_domains"), "array<string>"), ",").alias("domains"), F.size(F.json_object_keys("payload")).cast("long").alias("fields"),
    )


@query(
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'fetch' ELSE 'stored' END AS route, CASE WHEN doc_id % 3 > 0 THEN coalesce(lang, 'asked') ELSE 'asked' END AS title FROM documents"
)
def document_source(spark, d):
    """Requested URLs whose active document is stored, and those to fetch."""
    docs = _t(spark, d, "documents")
    snapshot = _snapshot(docs, "2024-01-01").withColumn("status", F.when(F.substring("id", 3, 20).cast("long") % 3 == 0, "inactive").otherwise("active"))
    asked = docs.select("doc_id", F.concat(F.lit("https://x.org/d/"), "doc_id", F.lit("/#top")).alias("url"), F.lit("asked").alias("title"))
    hits, misses = fetch.documents_or_fetch(asked, snapshot)
    return hits.select("doc_id", F.lit("stored").alias("route"), "title").union(misses.select("doc_id", F.lit("fetch"), "title"))


# ---------------------------------------------------------------- corpus


@query("SELECT 'content' AS kind, url FROM pages UNION ALL SELECT 'sitemap', 'https://maps.test/' || page_id FROM pages")
def sitemap_walk(spark, d):
    """Nested sitemaps of all pages: each lists a page, two sitemaps below it, itself and one of another host."""
    name = lambda k: F.concat(F.lit("https://maps.test/"), k.cast("string"))
    entry = lambda kind, url: F.struct(F.lit(kind).alias("kind"), url.alias("url"))
    k, n = F.col("page_id"), _t(spark, d, "pages").count()
    below = [entry("sitemap", name(F.when(2 * k + j < n, 2 * k + j).otherwise(k))) for j in (1, 2)]
    listed = F.explode(F.array(entry("content", F.col("url")), *below, entry("sitemap", F.lit("https://else.test/1")), entry("sitemap", name(k))))
    links = _t(spark, d, "pages").select(name(k).alias("map"), listed.alias("e"))
    expand = lambda level: level.join(links, F.col("url") == F.col("map")).select("source_id", "e.*")
    content, seen = sync.sitemap_levels(spark.createDataFrame([("s", "https://maps.test/0")], "source_id string, url string"), expand)
    return content.select(F.lit("content").alias("kind"), "url").union(seen.select(F.lit("sitemap"), "url"))


def _farm(request: dict) -> dict:
    """The web site of ``corpus_sync``: saved feeds and pages that were not modified, new, moved and broken ones."""
    path = request["url"].removeprefix("https://farm.test")
    if path == "/robots.txt":
        return {"status": 200, "body": b"User-agent: *\nDisallow: /n/1\n"}
    if path.startswith("/feed/"):
        return {"status": 304} if request["if_none_match"] == "f" else {"status": 500}
    k = int(path.rsplit("/", 1)[-1])
    match k % 7:
        case 3:
            return {"status": 404}
        case 4:
            return {"status": 200, "content_type": "image/png", "body": b"x"}
        case 5:
            return {"status": 200, "content_type": "text/html", "body": b"<main></main>"}
        case 6:
            return {"status": 200, "final_url": "https://else.test/", "content_type": "text/html", "body": b"<p>moved</p>"}
    if request["if_none_match"] == f"e{k}":
        return {"status": 304}
    return {"status": 200, "content_type": "text/html; charset=utf-8", "etag": f"e{k}", "body": f"<title>T{k}</title><main><p>body {k}</p></main>".encode()}


_SYNC = """
WITH p AS (SELECT page_id AS k, page_id::VARCHAR LIKE '1%' AS barred, page_id % 7 AS m, page_id % 3 = 0 AS stored, sha256(html) AS old FROM pages),
c AS (SELECT *, CASE WHEN barred THEN 'barred' WHEN m IN (3, 4, 5) AND stored THEN 'kept' WHEN m IN (3, 4, 5) THEN 'failed' WHEN m = 6 THEN 'moved' WHEN stored AND k % 2 = 0 THEN 'kept' ELSE 'read' END AS what FROM p)
SELECT 'https://farm.test/n/' || k AS url, CASE WHEN what IN ('kept', 'read') THEN 'active' ELSE 'inactive' END AS status,
CASE what WHEN 'barred' THEN 'robots_disallowed' WHEN 'moved' THEN 'redirect_outside_source_scope' WHEN 'failed' THEN CASE m WHEN 3 THEN 'http_status 404' WHEN 4 THEN 'unsupported_media_type' ELSE 'no_extractable_text' END END AS reason,
CASE what WHEN 'kept' THEN 'Old ' || k WHEN 'read' THEN 'T' || k END AS title, CASE what WHEN 'kept' THEN old WHEN 'read' THEN sha256('body ' || k) END AS content_hash,
CASE what WHEN 'kept' THEN '2023-05-01' WHEN 'read' THEN '2024-03-' || lpad((1 + k % 28)::VARCHAR, 2, '0') END AS published, CASE WHEN stored THEN '2023-06-01' ELSE '2024-04-01' END AS created FROM c"""


@query(_SYNC)
def corpus_sync(spark, d):
    """One pass over a source whose corpus holds a third of the pages: saved feeds, robots, 304, moves, failures, upsert."""
    k, pages = F.col("page_id"), _t(spark, d, "pages")
    url = F.concat(F.lit("https://farm.test/n/"), k)
    item = F.concat(F.lit("<item><link>/n/"), k, F.lit("</link><pubDate>Fri, "), F.lpad((1 + k % 28).cast("string"), 2, "0"), F.lit(" Mar 2024 00:00:00 GMT</pubDate></item>"))
    feeds = pages.groupBy(F.concat(F.lit("https://farm.test/feed/"), F.floor(k / 100)).alias("url")).agg(F.concat_ws("", F.collect_list(item)).alias("items"))
    state = feeds.select(
        "url", F.lit("f").alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.encode(
            F.concat(
                F.lit("<rss><channel>"), "items", F.lit("<item><link>https://else.test/n/2</link></item><item><link>/out/1</link></item></channel></rss>")
            ),
            "UTF-8"
        ).alias("content")
    )
    text = lambda c: F.lit(c).alias
    sources = feeds.agg(F.sort_array(F.collect_list("url")).alias("feeds")).select(
        F.lit(0).alias("ord"), text("farm")("id"), text("Farm")("name"), text("news")("source_type"), F.lit(True).alias("enabled"), F.array(F.lit("farm.test")).alias("allowed_domains"), F.array(F.lit("/n")).alias("allowed_path_prefixes"), "feeds", F.array().cast("array<string>").alias("sitemaps"),
    )
    at = lambda when: F.lit(when).cast("timestamp")
    stored = pages.filter(k % 3 == 0).select(
        F.concat(F.lit("id"), k).alias("id"), text("farm")("source_id"), url.alias("url"), urls.normalize(url).alias("canonical_url"), text("active")("status"), F.concat(F.lit("Old "), k).alias("title"), F.col("html").alias("text"), text("text/html")("media_type"),
        at("2023-05-01").alias("published_at"), at("2023-06-01").alias("fetched_at"), F.when(k % 2 == 0, F.concat(F.lit("e"), k)).alias("etag"), F.lit(None).cast("string").alias("last_modified"), values.content_hash(F.col("html")).alias("content_hash"), F.lit(None).cast("string").alias("failure_reason"),
        at("2023-06-01").alias("created_at"), at("2023-06-01").alias("updated_at"),
    )
    snapshot, _, _ = app.sync_corpus(sources, stored, state, _farm, "bot", "2024-04-01 00:00:00")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return snapshot.select(
        "url", "status", F.col("failure_reason").alias("reason"), "title", "content_hash", day("published_at").alias("published"),
        day("created_at").alias("created")
    )


_BENCH_BM25 = f"""
WITH d AS (SELECT 'b' || item_id || ':0' AS id, item_id, {_TOKENS.format('text')} AS t, text FROM benchmark),
q AS (SELECT DISTINCT unnest(string_split('{TERMS}', ' ')) AS term),
n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
p AS (SELECT id, len(t) AS len, term, len(list_filter(t, lambda x: x = term)) AS tf FROM d, q),
df AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM p GROUP BY term),
s AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS s FROM p JOIN df USING (term), n WHERE tf > 0 GROUP BY id ORDER BY round(s, 12) DESC, id LIMIT 8)
SELECT row_number() OVER (ORDER BY round(s, 6) DESC, id) AS rank, 'B' || item_id AS title, 'https://b.test/' || item_id AS url, sha256(replace(text, chr(10), chr(10) || chr(10))) AS snippet_hash, 'bm25' AS mode, id AS chunk FROM s JOIN d USING (id)"""


@query(_BENCH_BM25)
def local_search(spark, d):
    """An index of chunks with vectors, written, read and searched; hits joined with their current documents."""
    b = _t(spark, d, "benchmark")
    url = F.concat(F.lit("https://b.test/"), "item_id")
    snapshot = b.select(
        F.concat(F.lit("b"), "item_id").alias("id"), F.lit("s").alias("source_id"), url.alias("url"), urls.normalize(url).alias("canonical_url"), F.lit("active").alias("status"), F.concat(F.lit("B"), "item_id").alias("title"), "text",
        F.lit(None).cast("timestamp").alias("published_at"), values.content_hash(F.col("text")).alias("content_hash"),
    )
    path = _folder(spark, "index")
    app.write_index(app.reindex(snapshot, dimensions=8), path, "hashing", 8)
    index = app.read_index(spark, path, "hashing", 8)
    assert app.reindex(snapshot, index, dimensions=8).filter("vector is null").isEmpty()
    hits = app.search_corpus(index, snapshot, TERMS, "bm25", 8, dimensions=8, terms=f"{path}/terms")
    return hits.select(
        F.col("rank").cast("long").alias("rank"), "title", "url", F.sha2("snippet", 256).alias("snippet_hash"),
        F.col("metadata")["corpus_search_mode"].alias("mode"), F.col("metadata")["corpus_chunk_id"].alias("chunk")
    )


def _indexed(spark, d) -> str:
    """An index of the documents that was made of older ones: some had other texts, some were not there, some are gone."""
    docs, i, path = _t(spark, d, "documents").select("doc_id", "text"), F.col("doc_id"), _folder(spark, "inverted")
    older = docs.select(
        F.when(i % 4 == 0, i + 10_000_000).otherwise(i).alias("doc_id"),
        F.when(i % 3 == 0, F.concat(F.lit("older words of the "), "text")).otherwise(F.col("text")).alias("text")
    )
    inverted.add(older, path, complete=True)
    inverted.add(docs, path, complete=True)
    return path


@query(ORACLES["bm25_postings"])
def index_after_changes(spark, d):
    """Postings of a full-text index after an update of new, changed and missing documents: those of a rebuild."""
    found = inverted.postings(spark, _indexed(spark, d))
    return found.select(F.col("key").alias("doc_id"), "term", F.col("tf").cast("long").alias("tf"), F.col("length").cast("long").alias("length"))


@query(f"""WITH t AS (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents), e AS (SELECT doc_id, unnest(t) AS term FROM t)
SELECT term, count(DISTINCT doc_id) AS df, (SELECT count(*) FROM t) AS corpus, (SELECT sum(len(t))::BIGINT FROM t) AS tokens FROM e GROUP BY term""")
def index_counts_by_differences(spark, d):
    """Documents of each term, documents and tokens in all: sums of what each batch changed."""
    path = _indexed(spark, d)
    facts = spark.read.parquet(f"{path}/statistics").agg(F.max_by("corpus", "batch").alias("corpus"), F.max_by("tokens", "batch").alias("tokens"))
    df = spark.read.parquet(f"{path}/terms").groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
    return df.crossJoin(F.broadcast(facts))  # one row


@query(ORACLES["bm25_topk"])
def bm25_block_topk(spark, d):
    """The best documents from the index of blocks, after changes: those of a scan of all texts."""
    return inverted.bm25(spark, _indexed(spark, d), TERMS, 10)


def _sizes(texts: list[str]) -> list[dict]:
    """Vectors by rule, ten texts a call at most, in an order of their own."""
    assert len(texts) <= 10
    items = [{"index": k, "embedding": [float(len(t)), float(len(t.split(" "))), 1.0]} for k, t in enumerate(texts)]
    return sorted(items, key=lambda item: item["embedding"])


@query("SELECT item_id, length(text)::DOUBLE AS a, len(string_split(text, ' '))::DOUBLE AS b, 1.0::DOUBLE AS c FROM benchmark")
def embedding_batches(spark, d):
    v = embeddings.embed(F.col("text"), _sizes, 3)
    made = checkpoint(_t(spark, d, "benchmark").select("item_id", v.alias("v")))
    return made.select("item_id", *(F.col("v")[k].cast("double").alias(c) for k, c in enumerate("abc")))


@query(
    "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'duplicate canonical URL' WHEN doc_id % 5 = 1 THEN 'active without text' WHEN doc_id % 5 = 2 THEN 'unknown status' END AS rule FROM labels WHERE doc_id % 5 < 3"
)
def snapshot_violations(spark, d):
    """Rules that stored rows must keep; every label is a row, some of them break one."""
    i = F.col("doc_id")
    rows = _t(spark, d, "labels").select(
        "doc_id", F.concat(F.lit("id"), i).alias("id"), F.when(i % 5 == 2, "lost").otherwise("active").alias("status"),
        F.when(i % 5 == 1, " \n").otherwise("x").alias("text"), F.concat(F.lit("https://x.org/"), i).alias("canonical_url")
    )
    twice = rows.filter(i % 5 == 0).withColumn("id", F.concat(F.lit("z"), F.col("id")))
    found = store.violations(rows.union(twice))
    return found.select(F.regexp_extract("id", r"\d+", 0).cast("long").alias("doc_id"), "rule")


# ---------------------------------------------------------------- agent steps


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 5 ELSE 0 END AS n, CASE doc_id % 5 WHEN 0 THEN 'a' || doc_id WHEN 2 THEN 'c' WHEN 3 THEN 'c0' END AS first_claim, CASE doc_id % 5 WHEN 0 THEN 1.5::DOUBLE END AS confidence,
CASE doc_id % 5 WHEN 1 THEN 'invalid_json' WHEN 4 THEN 'invalid_schema' END AS reason FROM labels""")
def evidence_items(spark, d):
    """Claims of model answers: fenced, wrapped, too many, malformed."""
    i = F.col("doc_id")
    seven = "[" + ", ".join(f'{{"claim": "c{k}"}}' for k in range(7)) + "]"
    answer = (
        F.when(
            i % 5 == 0, F.concat(F.lit('```json\n[{"claim": " a'), i.cast("string"), F.lit(' ", "confidence": true}, {"claim": "b", "confidence": 0.5}]\n```'))
        ).when(i % 5 == 1, "oops").when(i % 5 == 2, '{"claims": [{"claim": "c"}]}').when(i % 5 == 3, seven).otherwise('[{"claim": 3}]')
    )
    rows = _t(spark, d, "labels").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("position"), answer.alias("response"), F.lit(None).cast("string").alias("error"))
    found, failed = agents.evidence(rows)
    per = found.groupBy("document_id").agg(F.count("*").alias("n"), F.min_by("claim", "ord").alias("first_claim"), F.sum("confidence").alias("confidence"))
    joined = rows.select("document_id").join(per, "document_id", "left").join(failed, "document_id", "left")
    return joined.select(F.col("document_id").alias("doc_id"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), "first_claim", "confidence", "reason")


@query(
    "SELECT run_id, 'C' || n AS ref, page_id FROM (SELECT page_id % 5 AS run_id, page_id, row_number() OVER (PARTITION BY page_id % 5 ORDER BY page_id DESC) AS n FROM pages) WHERE n <= 2"
)
def candidate_selection(spark, d):
    """Candidates numbered per run; those that a model's answer names."""
    pages = _t(spark, d, "pages").select((F.col("page_id") % 5).alias("run_id"), (-F.col("page_id")).alias("ord"), F.col("page_id").alias("result_id"))
    answers = pages.select("run_id").distinct().withColumn("response", F.lit('```\n{"selected_refs": ["C2", "C1", "C2"]}\n```'))
    chosen = agents.selection(answers, agents.number_candidates(pages))
    return chosen.select("run_id", "ref", F.col("result_id").alias("page_id"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'research' WHEN 1 THEN 'finish' WHEN 3 THEN 'research' WHEN 4 THEN 'research' WHEN 5 THEN 'stop' END AS type,
CASE doc_id % 6 WHEN 1 THEN 'action not available' WHEN 2 THEN 'invalid action' WHEN 3 THEN 'blank query' WHEN 4 THEN 'bad domain' END AS error, CASE doc_id % 3 WHEN 0 THEN 'research' WHEN 1 THEN 'finish' ELSE 'stop' END AS by_rule FROM labels""")
def policy_actions(spark, d):
    """Actions that a model's answers ask for, checked against what is available; and those of the rule."""
    i = F.col("doc_id")
    answers = [
        '<think>x</think>{"type": "research", "params": {"query": "q"}}', '{"type": "finish"}', "no", '{"type": "research", "params": {"query": " "}}',
        '{"type": "research", "params": {"query": "q", "source_domains": ["a.test", "x"]}}', '{"type": "stop"}'
    ]
    answer = F.get(F.array(*map(F.lit, answers)), (i % 6).cast("int"))
    rows = _t(spark, d, "labels")
    found = agents.actions(rows.select(i.alias("run_id"), answer.alias("response")), rows.select(i.alias("run_id"), F.array(F.lit("research"), F.lit("stop")).alias("actions")))
    return found.select(F.col("run_id").alias("doc_id"), "type", "error", agents.rule_action(F.col("run_id") % 3).alias("by_rule"))


@query(f"""SELECT run_id, doc_id, 'D' || row_number() OVER (PARTITION BY run_id ORDER BY doc_id) AS ref, s AS lifecycle, CASE WHEN doc_id % 2 = 0 THEN 10 END AS n, CASE WHEN doc_id % 2 = 0 THEN 300 END AS chars, CASE WHEN doc_id % 2 = 0 THEN 'R0,R1' ELSE 'R' || doc_id % 3 END AS refs
FROM (SELECT doc_id, doc_id % 10 AS run_id, {_STATE} AS s FROM labels) WHERE s <> 'unusable'""")
def agent_context(spark, d):
    """Documents with a lifecycle, numbered, with their first evidence, cut claims and research references."""
    rows = _t(spark, d, "labels").select(
        (F.col("doc_id") % 10).alias("run_id"), F.col("doc_id").alias("document_id"), F.col("doc_id").alias("ord"),
        F.when(F.col("toxic") == 1, None).when(F.col("quality") == 1, "active").otherwise("shelved").alias("lifecycle")
    )
    items = F.sequence(F.lit(0), F.when(F.col("document_id") % 2 == 0, 11).otherwise(-1))
    evidence = rows.select(
        "run_id", "document_id", F.explode(F.when(F.col("document_id") % 2 == 0, items).otherwise(F.array().cast("array<int>"))).alias("ord")
    ).select("*", F.concat(F.lit("e"), "ord").alias("evidence_id"), F.repeat(F.lit("x"), 400).alias("claim"))
    links = rows.select(
        "run_id", "document_id",
        F.explode(
            F.when(F.col("document_id") % 2 == 0, F.array(F.lit(1), F.lit(0), F.lit(1))).otherwise(F.array((F.col("document_id") % 3).cast("int")))
        ).alias("research_index")
    )
    found = research.context(rows, evidence).join(research.research_refs(links), ["run_id", "document_id"])
    return found.select(
        "run_id", F.col("document_id").alias("doc_id"), "ref", "lifecycle", F.when(F.col("evidence").isNotNull(), F.size("evidence")).alias("n"),
        F.length(F.get("evidence", F.lit(0))["claim"]).alias("chars"), F.array_join("research_refs", ",").alias("refs")
    )


@query("SELECT page_id % 5 AS run_id, count(DISTINCT regexp_replace(lower(regexp_extract(url, '^[^/?#]*//([^/?#:]*)', 1)), '^www\\.', '')) AS source_domains FROM pages GROUP BY 1")
def evidence_domains(spark, d):
    evidence = _t(spark, d, "pages").select((F.col("page_id") % 5).alias("run_id"), F.col("url").alias("source_url"))
    return research.source_domains(evidence, urls.publisher_domain(F.col("source_url")))


@query("SELECT page_id % 3 AS run_id, page_id, 'left' AS kind FROM pages WHERE page_id % 4 <> 1 UNION ALL SELECT page_id % 3, page_id, 'chosen' FROM pages WHERE page_id % 7 = 0")
def candidates_left(spark, d):
    """Results not yet fetched, and a chosen subset in candidate order."""
    results = _t(spark, d, "pages").select((F.col("page_id") % 3).alias("run_id"), F.col("page_id").alias("result_id"), F.col("page_id").alias("ord"))
    left = retrieval.candidates(results, results.filter("result_id % 4 = 1"))
    chosen = retrieval.select_subset(results, results.filter("result_id % 7 = 0").select("result_id"))
    return left.select("run_id", F.col("result_id").alias("page_id"), F.lit("left").alias("kind")).union(chosen.select("run_id", "result_id", F.lit("chosen")))


@query(
    "SELECT run_id, document_id, min(event_id) AS ord FROM (SELECT user_id % 20 AS run_id, event_id % 40 AS document_id, event_id FROM events WHERE event_type <> 'error') WHERE document_id % 3 > 0 GROUP BY 1, 2"
)
def extraction_queue(spark, d):
    """Documents fetched with success, each once in order, that a run doesn't know yet."""
    e = _t(spark, d, "events").select(
        (F.col("user_id") % 20).alias("run_id"), (F.col("event_id") % 40).alias("document_id"), F.col("event_id").alias("ord"),
        (F.col("event_type") != "error").alias("success")
    )
    known = e.select("run_id", "document_id").distinct().filter("document_id % 3 = 0")
    return retrieval.documents_to_extract(e, known).select("run_id", "document_id", "ord")


@query("SELECT page_id % 3 AS run_id, page_id % 2 = 0 AS is_old, count(*) AS n FROM pages GROUP BY 1, 2")
def url_index(spark, d):
    rows = _t(spark, d, "pages").select(
        (F.col("page_id") % 3).alias("run_id"), F.concat(F.lit("https://u.test/"), "page_id").alias("normalized_url"), F.col("page_id").alias("result_id")
    )
    whole = retrieval.extend_index(rows.filter("result_id % 2 = 0"), rows.filter("result_id % 2 = 1"))
    return whole.groupBy("run_id", (F.col("result_id") % 2 == 0).alias("is_old")).agg(F.count("*").alias("n"))


@query(
    "SELECT user_id, nth, event_id, floor(log2(nth))::INTEGER AS depth FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events)"
)
def span_depths(spark, d):
    """Depth of spans in trees, where the parent of a user's n-th span is the n/2-th."""
    nth = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    e = checkpoint(_t(spark, d, "events").select("user_id", "event_id", nth.alias("nth")))
    spans = e.select(
        F.col("user_id").cast("string").alias("trace_id"), F.col("nth").cast("string").alias("span_id"),
        F.when(F.col("nth") > 1, F.floor(F.col("nth") / 2).cast("string")).alias("parent_span_id")
    )
    found = traces.depth(spans).select(F.col("trace_id").cast("long").alias("user_id"), F.col("span_id").cast("int").alias("nth"), "depth")
    return e.join(found, ["user_id", "nth"]).select("user_id", F.col("nth").cast("long").alias("nth"), "event_id", "depth")


@query("""SELECT user_id, 'step' AS kind, event_id::VARCHAR AS value FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, 'root', round(value, 2)::VARCHAR FROM events WHERE event_type = 'signup'
UNION ALL SELECT user_id, 'stop', CASE event_type WHEN 'click' THEN 'finished' ELSE 'max_steps' END FROM events WHERE event_type IN ('click', 'purchase')""")
def span_reports(spark, d):
    """Completed steps, seconds of root spans and stop reasons, of spans made from events."""
    e, kind = _t(spark, d, "events"), F.col("event_type")
    output = F.concat(F.lit('{"action": {"i": '), F.col("event_id").cast("string"), F.lit('}, "observation": {}}'))
    spans = e.select(
        F.col("user_id").cast("string").alias("trace_id"), F.col("event_id").cast("string").alias("span_id"), F.when(kind != "signup", "0").alias("parent_span_id"), F.when(kind == "signup", "agent.run").otherwise("agent.step").alias("name"), F.col("value").alias("duration_seconds"),
        F.when(kind == "error", "error").otherwise("ok").alias("status"), F.when(kind == "view", output).when(kind == "error", output).when(kind == "click", '{"action": {}}').alias("output"), F.create_map(F.lit("step_index"), F.col("event_id").cast("string")).alias("attributes"),
    )
    steps = traces.completed_steps(spans).select(F.col("trace_id").cast("long").alias("user_id"), F.lit("step").alias("kind"), F.get_json_object("action", "$.i").alias("value"))
    roots = traces.root_seconds(spans).select(F.col("trace_id").cast("long"), F.lit("root"), F.round("total_seconds", 2).cast("string"))
    ends = e.filter(kind.isin("click", "purchase")).select("user_id", F.when(kind == "click", "finish").otherwise("research").alias("last_action"), (kind == "click").alias("done"))
    return steps.union(roots).union(ends.select("user_id", F.lit("stop"), evaluation.stop_reason()))


_LOOP = """
WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, n, unnest(range(least(n, 3))) AS step FROM c)
SELECT conv_id, step::INTEGER AS step, CASE WHEN step = n - 1 THEN 'finish' ELSE 'research' END AS action, CASE WHEN step = n - 1 THEN 'answer of ' || n ELSE 'role ' || (SELECT min(role) FROM conversations t WHERE t.conv_id = s.conv_id AND t.turn = s.step) END AS answer,
CASE WHEN n <= 3 THEN 'finished' ELSE 'max_steps' END AS stop, (1 + 3 * least(n, 3))::BIGINT AS spans FROM s"""


@query(_LOOP)
def run_loop(spark, d):
    """Runs of all conversations side by side: a turn is a step, the last one finishes; three steps at most."""
    turns = _t(spark, d, "conversations").select(F.col("conv_id").alias("run_id"), "turn", "role")
    runs = turns.groupBy("run_id").agg(F.count("*").alias("n"))
    policy = lambda states: states.join(runs, "run_id").select(
        "run_id", F.when(F.col("step") == F.col("n") - 1, "finish").otherwise("research").alias("type"), F.lit("{}").alias("params")
    )

    def research(actions):
        at = (F.col("r") == F.col("run_id")) & (F.col("turn") == F.col("step"))
        said = actions.join(turns.withColumnRenamed("run_id", "r"), at).groupBy("run_id").agg(F.min("role").alias("role"))
        return said.select("run_id", F.lit("research").alias("type"), F.concat(F.lit("role "), "role").alias("answer"))

    def finish(actions):
        return actions.join(runs, "run_id").select("run_id", F.lit("finish").alias("type"), F.concat(F.lit("answer of "), "n").alias("answer"))

    states, history, spans = runtime.run_all(runs.select("run_id"), policy, {"research": research, "finish": finish}, 3)
    held = spans.groupBy("run_id").agg(F.count("*").alias("spans"))
    stop = F.when(F.col("done"), "finished").otherwise("max_steps")
    return history.join(states.select("run_id", stop.alias("stop")), "run_id").join(held, "run_id").select(
        F.col("run_id").alias("conv_id"), "step", F.col("type").alias("action"), "answer", "stop", "spans"
    )


@query(
    "SELECT conv_id, sha256('Question: q' || conv_id || chr(10) || chr(10) || 'Sources:' || chr(10) || string_agg('[S' || (turn + 1) || ']' || chr(10) || '- ' || role || chr(10) || '- ' || text, chr(10) || chr(10) ORDER BY turn)) AS prompt_hash FROM conversations GROUP BY conv_id"
)
def synthesis_prompts(spark, d):
    """Prompts with each source's claims under its reference."""
    c = _t(spark, d, "conversations")
    item = lambda k, text: F.struct(F.lit(k).alias("ord"), text.alias("claim"))
    groups = c.select(
        F.col("conv_id").alias("run_id"), (F.col("turn") + 1).alias("position"), values.numbered("S", F.col("turn") + 1).alias("ref"),
        F.array(item(0, F.col("role")), item(1, F.col("text"))).alias("items")
    )
    queries = c.select(F.col("conv_id").alias("run_id")).distinct().select("run_id", F.concat(F.lit("q"), "run_id").alias("query"))
    return agents.synthesis_prompt(groups, queries).select(F.col("run_id").alias("conv_id"), F.sha2("prompt", 256).alias("prompt_hash"))


def _shop(request: dict) -> dict:
    n = int(request["url"].rsplit("/", 1)[-1])
    if n % 7 == 3:
        return {"status": 404}
    moved = {"final_url": f"https://shop.test/moved/{n % 2}"} if n % 4 == 1 else {}
    return {"status": 200, "content_type": "text/html", "body": f"<main><p>{'plain' if n % 5 == 1 else 'fact'} {n}</p></main>".encode()} | moved


def _extractor(prompts: list[str]) -> list[str]:
    """Claims for prompts with facts or of stored documents, none for plain ones."""
    return ["[]" if "plain" in p else json.dumps([{"claim": p[-20:]}]) for p in prompts]


_ROUND = """
WITH r AS (SELECT page_id % 5 AS run_id, page_id, 'https://shop.test/' || page_id AS u, row_number() OVER (PARTITION BY page_id % 5 ORDER BY page_id) AS n FROM pages),
f AS (SELECT *, CASE WHEN page_id % 6 = 0 THEN 'known' WHEN page_id % 2 = 0 THEN 'stored' WHEN page_id % 7 = 3 THEN NULL ELSE 'web' END AS origin FROM r WHERE n <= 12),
g AS (SELECT *, CASE WHEN origin = 'web' AND page_id % 4 = 1 THEN 'https://shop.test/moved/1' WHEN origin IS NOT NULL THEN u END AS document FROM f),
h AS (SELECT *, origin IN ('stored', 'web') AND row_number() OVER (PARTITION BY run_id, document ORDER BY page_id) = 1 AS is_new FROM g),
k AS (SELECT *, coalesce(sum(CASE WHEN is_new THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM h)
SELECT run_id, page_id, document, origin, CASE WHEN origin = 'known' THEN 0 ELSE 1 END AS attempts, CASE WHEN NOT coalesce(is_new, false) THEN NULL WHEN origin = 'web' AND page_id % 5 = 1 THEN 'unusable' ELSE 'active' END AS lifecycle,
CASE WHEN NOT coalesce(is_new, false) OR origin = 'web' AND page_id % 5 = 1 THEN 0 ELSE 1 END AS n_evidence, CASE WHEN origin IS NULL THEN 'http_status 404' END AS reason FROM k WHERE used < 4"""


@query(_ROUND)
def research_round(spark, d):
    """A whole research step: filter, merge, known, stored or fetched documents in waves, redirects, extraction, lifecycle."""
    pages = _t(spark, d, "pages")
    url = F.concat(F.lit("https://shop.test/"), F.col("page_id"))
    run = F.col("page_id") % 5
    results = pages.select(run.alias("request_id"), F.col("page_id").alias("ord"), F.lit("t").alias("title"), url.alias("url"))
    snapshot = pages.select(
        F.concat(F.lit("d"), "page_id").alias("id"), url.alias("url"), urls.normalize(url).alias("canonical_url"),
        F.when(F.col("page_id") % 2 == 0, "active").otherwise("inactive").alias("status"), F.lit("s").alias("title"), F.lit("known fact").alias("text"),
        F.lit(None).cast("timestamp").alias("published_at")
    )
    index = spark.createDataFrame([], "run_id long, normalized_url string")
    held = pages.select(
        run.alias("run_id"),
        F.when(F.col("page_id") % 6 == 0, urls.normalize(url)).otherwise(F.concat(F.lit("https://other.test/"), "page_id")).alias("normalized_url")
    )
    found = app.research_round(results, index, snapshot, _shop, _extractor, max_results=12, limit=4, delay=0, documents=held)
    return found.select("run_id", F.col("ord").alias("page_id"), "document", "origin", "attempts", "lifecycle", F.col("n_evidence").cast("int").alias("n_evidence"), "reason")


# ---------------------------------------------------------------- reports, traces, streams


@query("SELECT event_id, row_number() OVER (ORDER BY ts, lpad(event_id::VARCHAR, 12, '0')) AS place, event_type AS name, round(value, 4) AS seconds FROM events WHERE user_id = 8")
def trace_scan(spark, d):
    """Spans of all traces in a sink of JSON lines; those of one trace in order of start and id."""
    e = _t(spark, d, "events")
    spans = e.select(
        F.col("user_id").cast("string").alias("trace_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("span_id"),
        F.col("event_type").alias("name"), F.col("ts").cast("timestamp").alias("started_at"), F.col("value").alias("duration_seconds")
    )
    path = _folder(spark, "spans")
    files.write_lines(spans, path)
    found = files.trace(spark.read.schema("trace_id string, span_id string, name string, started_at timestamp, duration_seconds double").json(path), "8")
    place = F.row_number().over(W.orderBy("started_at", "span_id"))  # one trace
    return found.select(F.col("span_id").cast("long").alias("event_id"), place.cast("long").alias("place"), "name", F.round("duration_seconds", 4).alias("seconds"))


@query("""SELECT source_id, documents, active_dated, failures, is_total, 1 AS exit_code FROM (
SELECT source AS source_id, sum(d)::BIGINT AS documents, sum(a)::BIGINT AS active_dated, sum(f)::BIGINT AS failures, grouping(source)::INTEGER AS is_total
FROM (SELECT coalesce(source, '-') AS source, 1 AS d, CASE WHEN n_chars % 2 = 0 THEN 1 ELSE 0 END AS a, 0 AS f FROM documents UNION ALL SELECT coalesce(source, '-'), 0, 0, 1 FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) GROUP BY ROLLUP (source))""")
def sync_report_lines(spark, d):
    """The report of a sync as JSON lines with its exit code."""
    docs = _t(spark, d, "documents").withColumn("source", F.coalesce("source", F.lit("-")))
    stored = docs.select(
        F.col("source").alias("source_id"), F.lit("active").alias("status"),
        F.when(F.col("n_chars") % 2 == 0, F.lit("2024-01-01").cast("timestamp")).alias("published_at")
    )
    failures = docs.join(_t(spark, d, "labels").filter("toxic = 1"), "doc_id").select(F.col("source").alias("source_id"))
    report, code = app.sync_report(stored, failures)
    item = F.from_json("value", "source_id string, documents long, active_dated long, failures long, is_total int").alias("r")
    return app.json_lines(report).select(item).select("r.*", F.lit(code).alias("exit_code"))


@query(f"""
WITH s AS (SELECT page_id % 7 AS run_id, page_id, CASE WHEN page_id % 13 = 0 THEN '' ELSE {_HOST} END AS domain, CASE length({_HOST}) % 4 WHEN 0 THEN 'news' WHEN 1 THEN 'blog' WHEN 2 THEN 'official' END AS source_type FROM pages),
h AS (SELECT * FROM s WHERE page_id % 5 > 0 AND source_type IS NOT NULL),
d AS (SELECT run_id, array_to_string(list(domain ORDER BY o), ',') AS domains FROM (SELECT run_id, domain, min(page_id) AS o FROM h WHERE domain <> '' GROUP BY ALL) GROUP BY run_id),
t AS (SELECT run_id, array_to_string(list(source_type ORDER BY o), ',') AS source_types, bool_or(source_type = CASE WHEN run_id % 2 = 0 THEN 'news' ELSE 'social' END) AS fits FROM (SELECT run_id, source_type, min(page_id) AS o FROM h GROUP BY ALL) GROUP BY run_id)
SELECT r.run_id, coalesce(domains, '') AS domains, coalesce(source_types, '') AS source_types, coalesce(fits, false) AS preferred FROM (SELECT DISTINCT page_id % 7 AS run_id FROM pages) r LEFT JOIN d USING (run_id) LEFT JOIN t USING (run_id)""")
def source_stats(spark, d):
    """Domains and types of the search results that each run holds; a fifth of the ids have no stored result."""
    p, i, h = _t(spark, d, "pages"), F.col("page_id"), urls.host(F.col("url"))
    state = p.select((i % 7).alias("run_id"), i.alias("result_id"), i.alias("ord"))
    results = p.filter(i % 5 > 0).select(
        i.alias("result_id"), F.when(i % 13 == 0, "").otherwise(h).alias("domain"),
        F.element_at(F.array(F.lit("news"), F.lit("blog"), F.lit("official"), F.lit(None)), F.length(h) % 4 + 1).alias("source_type")
    )
    preferred = p.select((i % 7).alias("run_id")).distinct().select(
        "run_id", F.array(F.when(F.col("run_id") % 2 == 0, "news").otherwise("social"), F.lit("aggregator")).alias("source_types")
    )
    found = evaluation.source_stats(state, results, preferred)
    return found.select(
        "run_id", F.array_join("domains", ",").alias("domains"), F.array_join("source_types", ",").alias("source_types"),
        F.col("preferred_source_type_match").alias("preferred")
    )


_SAID = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> ''))"


@query(
    f"SELECT role, sum({_SAID})::BIGINT AS prompt_tokens, count(*) * 2 AS completion_tokens, sum({_SAID})::BIGINT + count(*) * 2 AS total_tokens, count(*) AS calls FROM conversations GROUP BY role"
)
def model_usage(spark, d):
    """Tokens of calls to a model that says the same to every prompt, by role."""
    calls = checkpoint(_t(spark, d, "conversations").select("role", agents.generate(F.col("text"), agents.fake_model("two words")).alias("r")))
    return agents.usage(calls.select("role", "r.*"), "role")


@query("SELECT conv_id, turn, CASE WHEN text LIKE '%a%' THEN 'a claim' END AS claim, CASE WHEN text LIKE '%a%' THEN NULL ELSE 'invalid_schema' END AS reason FROM conversations")
def fake_extraction(spark, d):
    """A smoke run of extraction with models that say the same to every prompt: a claim, or an answer of no use."""
    c = _t(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("document_id"), "text", F.col("text").contains("a").alias("good"))
    say = lambda rows, answer: rows.select(
        "document_id", F.lit(0).alias("position"), agents.generate(F.col("text"), agents.fake_model(answer)).alias("r")
    ).select("document_id", "position", "r.response", "r.error")
    answers = checkpoint(say(c.filter("good"), '[{"claim": "a claim"}]').union(say(c.filter("not good"), '{"a": 1}')))
    found, bad = agents.evidence(answers)
    return c.join(found.select("document_id", "claim"), "document_id", "left").join(bad.select("document_id", "reason"), "document_id", "left").select("conv_id", "turn", "claim", "reason")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    """Sessions of users with gaps of half an hour, from a stream of events."""
    events = runs.read_events(spark, f"{d}/events.parque[t]", _t(spark, d, "events").schema)
    with runs.rocksdb(spark):  # nearly as many sessions as events
        out = runs.drain(runs.sessions(events, late="3650 days"), f"sessions_{uuid.uuid4().hex}", "complete")
    return out.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("began"), "n")


@query("SELECT DISTINCT 'https://x.org/' || event_type || '/' || user_id % 20 AS normalized_url FROM events")
def stream_first_seen(spark, d):
    """URLs that a stream of discoveries names for the first time within the watermark, once for all their forms."""
    events = runs.read_events(spark, f"{d}/events.parque[t]", _t(spark, d, "events").schema, 1000)
    url = F.concat(F.lit("HTTPS://X.org/"), "event_type", F.lit("/"), (F.col("user_id") % 20).cast("string"), F.when(F.col("event_id") % 2 == 0, "/#top").otherwise(""))
    seen = events.select(url.alias("url"), F.col("ts").cast("timestamp").alias("seen_at"))
    return runs.drain(runs.first_seen(seen, "3650 days"), f"first_seen_{uuid.uuid4().hex}").select("normalized_url")


@query(
    """SELECT 'https://x.org/' || doc_id // 2 AS canonical_url, arg_max(source, doc_id) AS source_id, sha256(arg_max(text, doc_id)) AS content_hash, max(doc_id) AS version FROM (SELECT doc_id, 's' AS source, text FROM documents) GROUP BY 1"""
)
def stream_upsert(spark, d):
    """Documents as a stream of fetched versions, two for each URL: the later one of each is stored."""
    docs = runs.read_events(spark, f"{d}/documents.parque[t]", _t(spark, d, "documents").schema, 1000)
    i, null = F.col("doc_id"), lambda t="string": F.lit(None).cast(t)
    url = F.concat(F.lit("https://x.org/"), F.floor(i / 2))
    rows = docs.select(
        null().alias("id"), F.lit("s").alias("source_id"), url.alias("url"), url.alias("canonical_url"), F.lit("active").alias("status"), i.cast("string").alias("title"), "text", null().alias("media_type"), null("timestamp").alias("published_at"),
        F.timestamp_seconds(i).alias("fetched_at"), null().alias("etag"), null().alias("last_modified"), values.content_hash(F.col("text")).alias("content_hash"), null().alias("failure_reason"),
    )
    path = _folder(spark, "stream-upsert")
    query = runs.upsert_batches(rows, f"{path}/store", f"{path}/checkpoint", 8).trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress["numInputRows"] else query.lastProgress["batchId"] - 1
    found = runs.upserted(spark, f"{path}/store", last)
    return found.select("canonical_url", "source_id", "content_hash", F.col("title").cast("long").alias("version"))


@query(ORACLES["lifecycle_reducer"])
def stream_lifecycle(spark, d):
    """Document lifecycle and curation as keyed state of a stream: what the batch reducer gives."""
    events = runs.read_events(spark, f"{d}/events.parque[t]", _t(spark, d, "events").schema, 1000)
    kind = F.when(F.col("event_type").isin("click", "signup"), "evidence").when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "view", "shelve").otherwise("reactivate")
    outcomes = events.select(
        (F.col("user_id") % 20).alias("run_id"), (F.col("event_id") % 15).alias("document_id"), F.col("event_id").alias("step"), kind.alias("event"),
        (F.col("event_id") % 3).alias("n_evidence"), F.lit(None).cast("string").alias("reason"), F.col("ts").cast("timestamp").alias("ts")
    )
    with runs.rocksdb(spark):
        out = runs.drain(runs.lifecycle(outcomes, "3650 days"), f"lifecycle_{uuid.uuid4().hex}", "update")
    newest = out.groupBy("run_id", "document_id").agg(F.max_by(F.struct("lifecycle", "updated_at_step"), "version").alias("s"))
    return newest.select("run_id", "document_id", "s.lifecycle", "s.updated_at_step")


@query(
    """SELECT user_id % 6 AS run_id, count(DISTINCT source) AS sources, count(DISTINCT doc_id) AS documents, true AS near FROM (SELECT d.doc_id, d.source, d.doc_id % 30 AS user_id FROM documents d) GROUP BY 1"""
)
def merged_sketches(spark, d):
    """Distinct documents of groups of runs: exact counts, and whether the estimate of the runs' merged sketches is within three standard errors."""
    docs = _t(spark, d, "documents").select("doc_id", "source", (F.col("doc_id") % 30).alias("run"))
    stored = checkpoint(evaluation.sketches(docs, "run", "doc_id"))
    estimate = evaluation.merged_estimate(stored.withColumn("run_id", F.col("run") % 6), "run_id")
    exact = docs.groupBy((F.col("run") % 6).alias("run_id")).agg(F.count_distinct("source").alias("sources"), F.count_distinct("doc_id").alias("documents"))
    near = F.abs(F.col("estimate") - F.col("documents")) <= 1 + 3 * 1.04 / 64 * F.col("documents")
    return exact.join(estimate, "run_id").select("run_id", "sources", "documents", near.alias("near"))


_ONE_HOST = "(SELECT page_id, regexp_extract(url, '^[^/?#]*//[^/?#]*([^#]*)', 1) AS t FROM pages)"
_MANY = f"""(SELECT page_id % 5 > 1 AS allow, CASE page_id % 5 WHEN 0 THEN t WHEN 1 THEN left(t, 5) || '*' || right(t, 2) WHEN 2 THEN left(t, 6) WHEN 3 THEN t || '$' ELSE left(t, 4) || '*=' END AS pattern FROM {_ONE_HOST})"""


@query(f"""
WITH r AS (SELECT DISTINCT allow, pattern, string_split(CASE WHEN pattern LIKE '%$' THEN left(pattern, length(pattern) - 1) ELSE pattern END, '*') AS p, pattern LIKE '%$' AS closed FROM {_MANY}),
h AS (SELECT page_id, allow, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, allow DESC) AS n FROM {_ONE_HOST} JOIN r ON starts_with(t, p[1]) AND CASE WHEN len(p) = 1 THEN NOT closed OR t = p[1] ELSE contains(substr(t, length(p[1]) + 1), p[2]) END)
SELECT page_id, CASE WHEN coalesce(allow, true) THEN 'allowed' ELSE 'disallowed' END AS decision FROM pages LEFT JOIN (SELECT * FROM h WHERE n = 1) USING (page_id)""")
def robots_many_rules(spark, d):
    """All pages on one host, each of which gave that host a rule: plain, open, closed or with a star."""
    t = F.regexp_extract("url", "^[^/?#]*//[^/?#]*([^#]*)", 1)
    pages, k = _t(spark, d, "pages").select("page_id", t.alias("t")), F.col("page_id") % 5
    one = pages.select("page_id", F.concat(F.lit("https://one.test"), "t").alias("url"))
    pattern = F.when(k == 0, F.col("t")).when(
        k == 1, F.concat(F.left("t", F.lit(5)), F.lit("*"), F.right("t", F.lit(2)))
    ).when(k == 2, F.left("t", F.lit(6))).when(k == 3, F.concat("t", F.lit("$"))).otherwise(F.concat(F.left("t", F.lit(4)), F.lit("*=")))
    lines = pages.select(F.concat(F.when(k > 1, "Allow: ").otherwise("Disallow: "), pattern).alias("line")).distinct()
    body = lines.agg(F.concat_ws("\n", F.lit("User-agent: *"), F.concat_ws("\n", F.collect_list("line"))).alias("body"))  # a host has one file
    site = body.select(F.lit("https://one.test:443").alias("origin"), F.lit(200).alias("status"), "body")
    return robots.decide(one, site, robots.rules(site, "bot"), ["page_id"]).select("page_id", "decision")


def _feeds(version: int):
    """Feeds whose hosts' names say how long they stay as they are; every fifth is missing."""

    def client(request: dict) -> dict:
        n = len(request["url"].split("/")[2])
        etag = f"v{version if n % 3 == 0 else 0}"
        if n % 5 == 0:
            return {"status": 404}
        if request["if_none_match"] == etag:
            return {"status": 304}
        return {"status": 200, "etag": etag, "body": f"{request['url']} {etag}".encode()}

    return client


@query(f"""
SELECT 'https://' || h || '/feed' AS url, CASE WHEN length(h) % 5 = 0 THEN NULL WHEN length(h) % 3 = 0 THEN 'v0,v1' ELSE 'v0' END AS versions, CASE WHEN length(h) % 5 = 0 THEN 'http_status 404' END AS error, 1 + (length(h) % 5 > 0 AND length(h) % 3 = 0)::BIGINT AS reads,
CASE WHEN length(h) % 5 = 0 THEN NULL WHEN length(h) % 3 = 0 THEN 'v1' ELSE 'v0' END AS last FROM {_HOSTS}""")
def stream_endpoints(spark, d):
    """Feeds of the pages' hosts as a stream, started three times from one checkpoint: only changed ones are read again."""
    feeds = sorted(r[0] for r in _hosts(spark, d).select(F.concat(F.lit("https://"), "h", F.lit("/feed"))).collect())  # a registry's list
    path, name = _folder(spark, "endpoints"), f"endpoints_{uuid.uuid4().hex}"
    for version in (0, 1, 1):
        stream = endpoints.stream(spark, _feeds(version), feeds, name)
        stream.writeStream.format("parquet").option("path", f"{path}/read").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    read = spark.read.schema(endpoints.SCHEMA).parquet(f"{path}/read")
    return read.groupBy("url").agg(
        F.nullif(F.array_join(F.array_sort(F.collect_list("etag")), ","), F.lit("")).alias("versions"), F.max("error").alias("error"),
        F.count("*").alias("reads"), F.max(F.split_part(F.decode("content", "UTF-8"), F.lit(" "), F.lit(2))).alias("last")
    )


def _engine(request: dict) -> dict:
    """Says in each result what it was asked; items without a url, and answers of no use for every fourth query."""
    asked = json.loads(request["body"])
    k = int(asked["query"].split()[-1])
    if k % 4 == 3:
        return {"status": 200, "body": b"[]"}
    results = [{"title": f"t{r}", "url": f"https://s.test/{k}/{r}", "content": request["body"], "score": r / 4} | ({"url": None} if r == 2 else {}) for r in range(1, 9)]
    return {"status": 200, "body": json.dumps({"results": results}).encode()}


@query("""
SELECT item_id, domain, rank, 'https://s.test/' || item_id || '/' || rank AS url, 3 AS max_results, 'de' AS country, domain AS domains, rank / 4.0 AS score, NULL AS error FROM benchmark, (VALUES ('a.test'), ('b.test')) d(domain), (VALUES (1), (3)) r(rank) WHERE item_id % 4 <> 3
UNION ALL SELECT item_id, domain, NULL, NULL, NULL, NULL, NULL, NULL, 'invalid_response' FROM benchmark, (VALUES ('a.test'), ('b.test')) d(domain) WHERE item_id % 4 = 3""")
def search_pushdown(spark, d):
    """Searches for the benchmark's items as a table: query, country, domains and limit of the filters are what the requests say."""
    name = f"web_search_{uuid.uuid4().hex}"
    spark.dataSource.register(search_source.source(_engine, name))
    items = [f"item {r[0]}" for r in _t(spark, d, "benchmark").select("item_id").collect()]  # searches that a user asks for
    with search_source.pushdown(spark):
        asked = lambda: spark.read.format(name).load().filter(F.col("query").isin(items) & (F.col("country") == "de") & F.col("domain").isin("a.test", "b.test"))
        found = checkpoint(asked().filter("rank <= 3 and error is null").union(asked().filter("error is not null")))
    said = lambda path: F.get_json_object("content", f"$.{path}")
    return found.select(
        F.split_part("query", F.lit(" "), F.lit(2)).cast("long").alias("item_id"), "domain", "rank", "url", said("max_results").cast("int").alias("max_results"), said("country").alias("country"), said("include_domains[0]").alias("domains"), "score", "error",
    )
