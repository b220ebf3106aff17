"""Search-result filter, source classification, merge with the run's URL index."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestral.functions import urls
from lodestral.functions.session import checkpoint


def filter_results(results: DataFrame, max_results: int = 10, ignored: Iterable[str] = urls.TRACKING_KEYS, require_title: bool = True, require_url: bool = True) -> DataFrame:
    """Ordered cascade per request_id over ord; adds ``reason`` (null: kept).

    empty_title, empty_url, invalid_url, duplicate_url (the first of a normalised URL
    wins, even one that is truncated later), truncated.
    """
    early = F.when(F.lit(require_title) & (F.coalesce(urls.strip(F.col("title")), F.lit("")) == ""), "empty_title")
    early = early.when(F.lit(require_url) & (F.coalesce(urls.strip(F.col("url")), F.lit("")) == ""), "empty_url")
    early = early.when(~urls.fetchable(F.col("url")), "invalid_url")
    staged = results.withColumn("reason", early).withColumn("normalized_url", urls.normalize(F.col("url"), ignored))
    first = W.partitionBy("request_id", F.col("reason").isNull(), "normalized_url").orderBy("ord")
    staged = staged.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(first) > 1), "duplicate_url").otherwise(F.col("reason")))
    kept = F.sum(F.col("reason").isNull().cast("int")).over(W.partitionBy("request_id").orderBy("ord"))
    return staged.withColumn("reason", F.when(F.col("reason").isNull() & (kept > max_results), "truncated").otherwise(F.col("reason")))


def filter_report(filtered: DataFrame) -> DataFrame:
    count = lambda r: F.count_if(F.col("reason") == r)
    return filtered.groupBy("request_id").agg(
        F.count("*").alias("input_count"), F.count_if(F.col("reason").isNull()).alias("output_count"), count("empty_title").alias("dropped_empty_title"), count("empty_url").alias("dropped_empty_url"),
        count("invalid_url").alias("dropped_invalid_url"), count("duplicate_url").alias("dropped_duplicate_url"), count("truncated").alias("truncated"),
    )


def classify(results: DataFrame, domains: DataFrame, provider_type: Column | None = None) -> DataFrame:
    """Source type by exact domain, else the provider's, else unknown.

    ``domains`` (domain, source_type) is the registry: its size is that of a hand-kept
    list, and Spark broadcasts it by its own size limit.
    """
    known = domains.select(urls.domain_key(F.col("domain")).alias("key"), F.col("source_type").alias("known_type")).dropDuplicates(["key"])
    given = F.lit(None).cast("string") if provider_type is None else provider_type
    joined = results.withColumn("domain", urls.publisher_domain(F.col("url"))).join(known, F.col("domain") == F.col("key"), "left").drop("key")
    usable = given.isNotNull() & (given != "unknown")
    return joined.withColumn("source_type", F.coalesce("known_type", F.when(usable, given), F.lit("unknown"))).withColumn(
        "classification_source", F.when(F.col("known_type").isNotNull(), "domain").when(usable, "provider").otherwise("unknown")
    ).drop("known_type")


def classification_report(classified: DataFrame) -> DataFrame:
    return classified.agg(
        F.count("*").alias("input_count"), F.count_if(F.col("classification_source") != "unknown").alias("recognized_count"),
        F.count_if(F.col("classification_source") == "unknown").alias("unknown_count")
    )


def merge_results(new: DataFrame, index: DataFrame, ignored: Iterable[str] = urls.TRACKING_KEYS) -> DataFrame:
    """Adds ``is_new``: the normalised URL is not in the run's index (run_id, normalized_url)."""
    keyed = new.withColumn("normalized_url", urls.normalize(F.col("url"), ignored))
    seen = index.select("run_id", "normalized_url").distinct().withColumn("seen", F.lit(True))
    return keyed.join(seen, ["run_id", "normalized_url"], "left").withColumn("is_new", F.col("seen").isNull()).drop("seen")


def merge_report(merged: DataFrame) -> DataFrame:
    return merged.groupBy("run_id").agg(F.count("*").alias("candidate_count"), F.count_if("is_new").alias("new_count"), F.count_if(~F.col("is_new")).alias("reused_count"))


def candidates(results: DataFrame, processed: DataFrame) -> DataFrame:
    """Results that were neither fetched nor failed yet."""
    return results.join(processed.select("run_id", "result_id").distinct(), ["run_id", "result_id"], "left_anti")


def select_subset(results: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected results in candidate order; an unknown id raises."""
    unknown = selected.join(results, "result_id", "left_anti").limit(3).collect()
    if unknown:
        raise ValueError(f"unknown result ids: {[r['result_id'] for r in unknown]}")
    return results.join(selected.select("result_id").distinct(), "result_id", "left_semi").orderBy("ord")


def fetch_budget(outcomes: DataFrame, limit: int) -> DataFrame:
    """Outcomes up to the one that reaches ``limit`` new documents; failures and hits are free."""
    before = F.coalesce(F.sum(F.col("is_new").cast("int")).over(W.partitionBy("run_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return outcomes.withColumn("used", before).filter(F.col("used") < limit).drop("used")


def next_wave(left: DataFrame, known: DataFrame, used: DataFrame, limit: int) -> DataFrame:
    """Of candidates (run_id, ord, normalized_url) those that a run has to look at next; adds ``document`` (null: to fetch).

    ``known`` (run_id, normalized_url, document) are the run's documents and ``used`` (run_id,
    used) how many of them are new.  A run fetches as many as it still needs, in order; known
    ones in between cost nothing.
    """
    joined = left.join(known.select("run_id", "normalized_url", "document"), ["run_id", "normalized_url"], "left").join(used, "run_id", "left")
    ahead = F.coalesce(F.sum(F.col("document").isNull().cast("int")).over(W.partitionBy("run_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return joined.withColumn("ahead", ahead).filter(F.col("ahead") < F.lit(limit) - F.coalesce("used", F.lit(0))).drop("ahead", "used")


def fetch_in_waves(candidates: DataFrame, known: DataFrame, limit: int, get: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Outcomes of candidates (run_id, ord, url, normalized_url) until each run has ``limit`` new documents.

    ``get`` fetches rows (run_id, ord, url) and gives (run_id, ord, final_url, text, origin,
    reason, attempts), reason null for a document.  Documents join the run's index by their
    own normalised URL, so what redirects to a known page, or has the URL of one found
    before it, is that document and not a new one.  Between two waves only the number of
    runs that go on reaches the driver; a run takes ``limit`` waves at least and as many as it
    has candidates at most.

    Outcomes: run_id, ord, url, document (normalised URL), is_new, origin, reason, attempts
    (0: no request was needed), text.
    """
    known = checkpoint(known.select("run_id", "normalized_url", F.col("normalized_url").alias("document")))
    left, done = checkpoint(candidates.select("run_id", "ord", "url", "normalized_url")), None
    used = left.select("run_id", F.lit(0).cast("long").alias("used")).limit(0)
    while True:
        wave = checkpoint(next_wave(left, known, used, limit))
        if wave.isEmpty():
            break
        got = checkpoint(get(wave.filter("document is null").select("run_id", "ord", "url")))
        answers = wave.filter("document is null").select("run_id", "ord", "url", "normalized_url").join(got, ["run_id", "ord"])
        target = urls.normalize(F.coalesce("final_url", "url"), urls.TRACKING_KEYS)
        answers = answers.withColumn("target", F.when(F.col("reason").isNull(), target))
        # Of a wave's documents with one URL the first counts; a later candidate of that URL needs no request.
        found = answers.filter("target is not null").groupBy("run_id", F.col("target").alias("normalized_url")).agg(F.min("ord").alias("first"))
        fresh = found.join(known.select("run_id", "normalized_url"), ["run_id", "normalized_url"], "left_anti")
        met = answers.join(fresh.select("run_id", "normalized_url", F.col("first").alias("met")), ["run_id", "normalized_url"], "left")
        before = F.coalesce(F.col("met") < F.col("ord"), F.lit(False))
        own = met.join(
            fresh.select(F.col("run_id").alias("r"), F.col("normalized_url").alias("t"), "first"),
            (F.col("run_id") == F.col("r")) & (F.col("target") == F.col("t")), "left"
        )
        none = F.lit(None).cast("string")
        fetched = own.select(
            "run_id", "ord", "url", F.when(before, F.col("normalized_url")).otherwise(F.col("target")).alias("document"), (
                ~before & F.coalesce(F.col("first") == F.col("ord"), F.lit(False))
            ).alias("is_new"),
            F.when(before, "known").otherwise(F.col("origin")).alias("origin"), F.when(~before, F.col("reason")).alias("reason"), F.when(before, 0).otherwise(F.col("attempts")).alias("attempts"), F.when(~before, F.col("text")).alias("text"),
        )
        hits = wave.filter("document is not null").select(
            "run_id", "ord", "url", "document", F.lit(False).alias("is_new"), F.lit("known").alias("origin"), none.alias("reason"), F.lit(0).alias("attempts"),
            none.alias("text")
        )
        made = checkpoint(fetched.unionByName(hits))
        done = made if done is None else checkpoint(done.unionByName(made))
        known = checkpoint(known.unionByName(made.filter("is_new").select("run_id", F.col("document").alias("normalized_url"), "document")))
        used = done.groupBy("run_id").agg(F.sum(F.col("is_new").cast("long")).alias("used"))
        left = checkpoint(left.join(wave.select("run_id", "ord"), ["run_id", "ord"], "left_anti"))
    return done if done is not None else candidates.sparkSession.createDataFrame([], f"run_id {candidates.schema['run_id'].dataType.simpleString()}, {OUTCOME}")


OUTCOME = "ord long, url string, document string, is_new boolean, origin string, reason string, attempts int, text string"


def extend_index(index: DataFrame, new: DataFrame) -> DataFrame:
    """The run's URL index with new URLs (run_id, normalized_url, result_id); a known URL raises."""
    known = new.join(index, ["run_id", "normalized_url"], "left_semi").first()
    if known:
        raise ValueError(f"URL already in the index: {known['normalized_url']}")
    return index.unionByName(new)


def documents_to_extract(outcomes: DataFrame, known: DataFrame) -> DataFrame:
    """Successful fetches, each document once in order, that the run doesn't know yet."""
    first = outcomes.filter("success").withColumn("n", F.row_number().over(W.partitionBy("run_id", "document_id").orderBy("ord"))).filter("n = 1").drop("n")
    return first.join(known.select("run_id", "document_id"), ["run_id", "document_id"], "left_anti")


def search_metadata(hits: DataFrame, mode: str) -> DataFrame:
    """Ranked results of a local search with the metadata that tells where they came from."""
    pairs = (
        ("provider", F.lit("local_corpus")), ("score", F.col("score").cast("string")), ("corpus_document_id", F.col("document_id")),
        ("corpus_chunk_id", F.col("id")), ("corpus_source_id", F.col("source_id")), ("corpus_content_hash", F.col("content_hash")),
        ("corpus_search_mode", F.lit(mode))
    )
    return hits.withColumn("metadata", F.create_map(*(x for k, v in pairs for x in (F.lit(k), v))))
