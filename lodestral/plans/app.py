"""Driver steps of the corpus: sync, reindex, search; results as JSON lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lodestral.functions import urls
from lodestral.functions.session import checkpoint
from lodestral.operators import agents, chunking, embeddings, inverted, retrieval, search, store, sync
from lodestral.sources import discovery, fetch, html, registry, robots

#: Options with their environment-like defaults, read from the session by ``option``.
DEFAULTS = {"max_chunk_chars": "1200", "embedding_model": "hashing", "embedding_dimensions": "64", "search_limit": "10", "retrieval_routes": "local,web"}


def option(spark: SparkSession, name: str) -> str:
    """A setting lodestral.<name> of the session, else its default."""
    return spark.conf.get(f"lodestral.{name}", DEFAULTS[name])


def sync_corpus(sources: DataFrame, snapshot: DataFrame, endpoint_state: DataFrame, client: Callable[[dict], dict], agent: str, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new snapshot, new endpoint state, failures) after one pass over the enabled sources.

    Feeds and sitemaps, scope, robots and page fetches are stages of one plan; what was
    fetched is checkpointed, so nothing is fetched twice by a retry further down.
    """
    on = registry.enabled(sources)
    ends = on.select(
        F.col("id").alias("source_id"),
        F.explode(
            F.concat(
                F.transform("feeds", lambda u: F.struct(u.alias("url"), F.lit("feed").alias("kind"))),
                F.transform("sitemaps", lambda u: F.struct(u.alias("url"), F.lit("sitemap").alias("kind")))
            )
        ).alias("e")
    ).select("source_id", "e.*")
    scope = on.select(F.col("id").alias("source_id"), "allowed_domains", "allowed_path_prefixes")

    failures = ends.select("source_id", "url", F.lit("").alias("reason")).limit(0)
    saved, depth = endpoint_state.select("url", "etag", "last_modified", "content").limit(0), 0

    def discover(level: DataFrame) -> DataFrame:
        """Fetch and parse endpoints; failures and validators of good ones are kept aside."""
        nonlocal failures, saved, depth
        answers = checkpoint(fetch.fetch(fetch.conditional_requests(level, endpoint_state), client))
        responses = level.join(fetch.response_state(answers, endpoint_state), "url").join(scope, "source_id")
        responses = responses.withColumn("error", F.coalesce("error", F.when(~F.array_contains("allowed_domains", urls.host(F.col("final_url"))), "redirect outside source")))
        good = responses.filter("error is null")
        parsed = discovery.parse_endpoints(good.select(F.col("url").alias("endpoint_url"), "kind", "content").dropDuplicates(["endpoint_url"]))
        found = checkpoint(parsed.join(level.select("source_id", F.col("url").alias("endpoint_url")).distinct(), "endpoint_url"))
        bad = found.filter("error is not null")
        failures = failures.union(responses.filter("error is not null").select("source_id", "url", "error")).union(bad.select("source_id", "endpoint_url", "error"))
        saved = saved.union(
            good.join(
                bad.select(F.col("endpoint_url").alias("url")).distinct(), "url", "left_anti"
            ).select("url", "etag", "last_modified", "content").dropDuplicates(["url"])
        )
        depth += 1
        if depth % 8 == 0:  # keep the plans of deep sitemaps short
            failures, saved = checkpoint(failures), checkpoint(saved)
        return found.filter("error is null")

    content = discover(ends.filter("kind = 'feed'")).select("source_id", "url", "published_at", "ord")
    maps = ends.filter("kind = 'sitemap'").select("source_id", "url")
    if not maps.isEmpty():
        listed, _ = sync.sitemap_levels(maps, lambda level: discover(level.withColumn("kind", F.lit("sitemap"))).select("source_id", "kind", "url"))
        content = content.union(listed.select("source_id", "url", F.lit(None).cast("timestamp"), F.lit(1 << 30)))  # after all feeds
    pages = discovery.merge(content, "source_id").join(scope, "source_id")
    pages = pages.filter(registry.in_scope(F.col("url"), F.col("allowed_domains"), F.col("allowed_path_prefixes")))
    origins = pages.select(
        robots.origin_key(F.col("url")).alias("origin"),
        F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.netloc(F.col("url")), F.lit("/robots.txt")).alias("url")
    ).dropDuplicates(["origin"])
    nothing = endpoint_state.limit(0)
    answers = checkpoint(fetch.fetch(fetch.conditional_requests(origins, nothing), client))
    files = origins.join(answers, "url").select("origin", "status", F.decode("body", "UTF-8").alias("body"))
    decided = checkpoint(robots.decide(pages.select("source_id", "url", "normalized_url", "published_at"), files, robots.rules(files, agent), ["source_id", "url"]))
    existing = snapshot.select(
        "canonical_url", F.col("status").alias("existing_status"), F.col("title").alias("existing_title"), F.col("published_at").alias("existing_published_at"),
        "etag", "last_modified"
    )
    allowed = decided.filter("decision = 'allowed'")
    validators = allowed.join(existing, F.col("normalized_url") == F.col("canonical_url"), "left").select(
        "url", "etag", "last_modified", F.lit(None).cast("binary").alias("content")
    )
    bodies = checkpoint(fetch.fetch(fetch.conditional_requests(allowed, validators), client))
    body = html.parse_documents(
        bodies.filter("status between 200 and 299").select(
            "url", fetch.media_type(F.col("content_type")).alias("media_type"), F.coalesce("body", F.lit(b"")).alias("content")
        ),
        "url"
    )
    body = checkpoint(body).select("url", "title", "text", F.col("published_at").alias("page_date"), F.col("error").alias("parse_error"))
    at = F.lit(as_of).cast("timestamp")
    rows = decided.join(
        bodies.select(
            "url", "status", "final_url", F.col("etag").alias("new_etag"), F.col("last_modified").alias("new_modified"), "content_type", "transport_error"
        ),
        "url", "left"
    ).join(body, "url", "left").join(scope, "source_id").join(existing.drop("etag", "last_modified"), F.col("normalized_url") == F.col("canonical_url"), "left")
    http = F.when(F.col("transport_error").isNotNull(), "transport").when(
        ~(F.col("status").between(200, 299) | (F.col("status") == 304)), F.concat(F.lit("http_status "), F.col("status").cast("string"))
    )
    error = F.coalesce(http, F.when(F.col("parse_error") != "no_extractable_text", F.col("parse_error")))
    inside = registry.in_scope(F.col("final_url"), F.col("allowed_domains"), F.col("allowed_path_prefixes"))
    decisions = sync.decide_pages(
        rows.select(
            "source_id", "url", "normalized_url", F.col("decision").alias("robots"), "status", error.alias("error"), inside.alias("in_scope"), "text", "title",
            "existing_status", "existing_title", at.alias("fetched_at"), F.col("page_date"), F.col("published_at").alias("discovered_at"),
            "existing_published_at", "new_etag", "new_modified", "content_type"
        ).withColumn("published_at", F.col("page_date"))
    )
    decisions = checkpoint(decisions)
    active = F.col("new_status") == "active"
    write = decisions.filter("action = 'write'").select(
        "source_id", "url", F.col("normalized_url").alias("canonical_url"), F.col("new_status").alias("status"), F.when(active, F.col("new_title")).alias("title"), F.when(active, F.col("text")).alias("text"), F.when(active, fetch.media_type(F.col("content_type"))).alias("media_type"),
        F.col("new_published_at").alias("published_at"), "fetched_at", F.when(active, F.col("new_etag")).alias("etag"), F.when(active, F.col("new_modified")).alias("last_modified"), F.when(active, F.sha2("text", 256)).alias("content_hash"), F.col("reason").alias("failure_reason"),
    )
    merged, rejected = store.upsert(snapshot, write, as_of)
    failures = failures.union(decisions.filter("failure is not null").select("source_id", "url", "failure")).union(rejected.select("source_id", "canonical_url", "error"))
    return merged, store.upsert_endpoints(endpoint_state, saved), failures


def reindex(snapshot: DataFrame, index: DataFrame | None = None, embedder=None, dimensions: int = 64, limit: int = 1200) -> DataFrame:
    """Chunks of active documents with vectors; unchanged chunks keep those of the old index."""
    chunks = checkpoint(chunking.chunk_documents(snapshot, limit))  # read for reused and for new vectors
    plan = chunks.withColumn("vector", F.lit(None).cast("array<float>")) if index is None else search.reuse_plan(chunks, index)
    make = embeddings.embed(F.col("text"), embedder or embeddings.hashing_embedder(dimensions), dimensions)
    reused = plan.filter("vector is not null")
    return reused.unionByName(plan.filter("vector is null").withColumn("vector", make))


def search_corpus(
    index: DataFrame, snapshot: DataFrame, query: str, mode: str = "hybrid", limit: int = 10, embedder=None, dimensions: int = 64, terms: str | None = None
) -> DataFrame:
    """Ranked current chunks with title, url, snippet and metadata.

    ``terms`` is the folder of the index' full-text tables (``write_index``); without it texts are scanned.
    """
    search.validate(query, limit)
    legs = []
    if mode in ("bm25", "hybrid"):
        legs.append(search.bm25(index, query, limit, "id", "text") if terms is None else inverted.bm25(index.sparkSession, terms, query, limit, "id"))
    if mode in ("vector", "hybrid"):
        vector = (embedder or embeddings.hashing_embedder(dimensions))([query])[0]
        legs.append(search.vector(index, vector, limit, "id", "vector"))
    if not legs:
        raise ValueError(f"unknown mode {mode}")
    top = search.rrf(legs, limit, "id") if mode == "hybrid" else legs[0]
    ranked = top.join(index, "id").withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))
    current = search.current_hits(ranked.select("id", "document_id", "source_id", "content_hash", "rank", "score", "text"), snapshot)
    docs = snapshot.select(F.col("id").alias("document_id"), "title", "url", "published_at")
    current = retrieval.search_metadata(current, mode)
    return current.join(docs, "document_id").select(
        "rank", F.coalesce("title", "url").alias("title"), "url", F.col("text").alias("snippet"), "published_at", "metadata"
    ).orderBy("rank")


def documents_or_pages(snapshot: DataFrame, client: Callable[[dict], dict], delay: float = 0.1) -> Callable[[DataFrame], DataFrame]:
    """``get`` of ``retrieval.fetch_in_waves``: active stored documents, else pages fetched and parsed; a URL is fetched once a wave."""

    def get(asked: DataFrame) -> DataFrame:
        hits, misses = fetch.documents_or_fetch(asked.withColumn("title", F.lit(None).cast("string")), snapshot)
        none = misses.select(
            "url", F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("binary").alias("content")
        ).limit(0)
        answers = checkpoint(fetch.fetch(fetch.conditional_requests(misses, none), client, delay=delay))
        parsed = html.parse_documents(
            answers.filter("status between 200 and 299").select(
                "url", fetch.media_type(F.col("content_type")).alias("media_type"), F.coalesce("body", F.lit(b"")).alias("content")
            ),
            "url"
        )
        failed = F.when(F.col("transport_error").isNotNull(), "transport").when(~F.col("status").between(200, 299), F.concat(F.lit("http_status "), F.col("status").cast("string")))
        pages = misses.select("run_id", "ord", "url").join(
            answers.select("url", "final_url", failed.alias("failed"), F.col("attempt_count").alias("attempts")), "url"
        ).join(parsed.select("url", "text", "error"), "url", "left")
        pages = pages.select(
            "run_id", "ord", "final_url", "text", F.coalesce("failed", "error").alias("reason"), "attempts"
        ).withColumn("origin", F.when(F.col("reason").isNull(), "web"))
        stored = hits.select(
            "run_id", "ord", F.col("url").alias("final_url"), "text", F.lit(None).cast("string").alias("reason"), F.lit(1).alias("attempts"),
            F.lit("stored").alias("origin")
        )
        return pages.unionByName(stored)

    return get


def research_round(
    results: DataFrame, index: DataFrame, snapshot: DataFrame, client: Callable[[dict], dict], model: Callable[[list[str]], list[str]], max_results: int = 10,
    limit: int = 4, delay: float = 0.1, documents: DataFrame | None = None
) -> DataFrame:
    """One research step for each request: (run_id, ord, url, document, origin, attempts, lifecycle, n_evidence, reason).

    Results (request_id, ord, title, url) are filtered and merged with the run's URL index.
    New ones are looked up among the run's ``documents`` (run_id, normalized_url), then in the
    store, and else fetched, in waves that never ask for more than the budget still needs.
    Each of the ``limit`` new documents goes to the model, whose evidence makes it active, or
    unusable without any.
    """
    kept = retrieval.filter_results(results, max_results).filter("reason is null").withColumnRenamed("request_id", "run_id").drop("reason", "normalized_url")
    new = checkpoint(retrieval.merge_results(kept, index).filter("is_new").drop("is_new"))
    known = new.select("run_id", "normalized_url").limit(0) if documents is None else documents
    tried = retrieval.fetch_in_waves(new, known, limit, documents_or_pages(snapshot, client, delay))
    key = F.concat_ws(":", "run_id", "ord")
    asked = tried.filter("is_new").select(key.alias("document_id"), F.lit(0).alias("position"), agents.generate(F.col("text"), model).alias("r"))
    found, bad = agents.evidence(checkpoint(asked).select("document_id", "position", "r.response", "r.error"))
    counts = found.groupBy("document_id").agg(F.count("*").alias("n"))
    out = tried.withColumn("document_id", key).join(counts, "document_id", "left").join(bad.withColumnRenamed("reason", "bad"), "document_id", "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    state = F.when(F.col("is_new"), F.when(n > 0, "active").otherwise("unusable"))
    return out.select("run_id", "ord", "url", "document", "origin", "attempts", state.alias("lifecycle"), n.alias("n_evidence"), F.coalesce("reason", "bad").alias("reason"))


def write_index(index: DataFrame, path: str, model: str, dimensions: int) -> None:
    """Index table below path/chunks and its model below path/meta, which replace what is there, and full-text tables
    below path/terms, which are brought up to the chunks."""
    spark = index.sparkSession
    index.write.mode("overwrite").parquet(f"{path}/chunks")
    inverted.add(spark.read.parquet(f"{path}/chunks"), f"{path}/terms", "id", "text", complete=True)
    spark.createDataFrame([(model, dimensions)], "model string, dimensions int").write.mode("overwrite").json(f"{path}/meta")


def read_index(spark: SparkSession, path: str, model: str, dimensions: int) -> DataFrame:
    """The index table; another model or number of dimensions raises."""
    meta = spark.read.schema("model string, dimensions int").json(f"{path}/meta").first()
    if (meta["model"], meta["dimensions"]) != (model, dimensions):
        raise ValueError(f"index was made with {meta['model']}, {meta['dimensions']} dimensions")
    return spark.read.parquet(f"{path}/chunks")


def sync_report(documents: DataFrame, failures: DataFrame) -> tuple[DataFrame, int]:
    """Per-source and total counts, and the exit code: 1 if anything failed."""
    return sync.summary(documents, failures), int(not failures.isEmpty())


def json_lines(df: DataFrame) -> DataFrame:
    """(value): each row as a JSON object."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def as_json(df: DataFrame) -> Iterator[str]:
    """JSON lines of a result, partition by partition."""
    return (r[0] for r in json_lines(df).toLocalIterator())
