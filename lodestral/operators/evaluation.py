"""Benchmark sampling, manifests and evaluation summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lodestral.functions.session import checkpoint
from lodestral.functions.values import ratio


def balanced_sample(cases: DataFrame, kind: str, kinds: list[str], n: int) -> DataFrame:
    """The first ``n`` of each kind in file order, kinds in the given order; a short kind raises."""
    counts = {r[0]: r[1] for r in cases.filter(F.col(kind).isin(kinds)).groupBy(kind).count().collect()}
    short = [k for k in kinds if counts.get(k, 0) < n]
    if short:
        raise ValueError(f"fewer than {n} cases of {', '.join(short)}")
    nth = F.row_number().over(W.partitionBy(kind).orderBy("ord"))
    picked = cases.filter(F.col(kind).isin(kinds)).withColumn("nth", nth).filter(F.col("nth") <= n)
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col(kind))
    return picked.orderBy(place, "ord")


def subset(cases: DataFrame, condition, limit: int | None = None) -> DataFrame:
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    found = cases.filter(condition).orderBy("ord")
    return found if limit is None else found.limit(limit)


def manifest(cases: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): counts by each column, one pass of grouping sets."""
    sets = cases.groupingSets([[c] for c in columns], *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    top = len(columns) - 1
    which = F.coalesce(*(F.when(F.col("g") == (1 << len(columns)) - 1 - (1 << top - i), F.lit(c)) for i, c in enumerate(columns)))
    value = F.coalesce(*(F.when(F.col("g") == (1 << len(columns)) - 1 - (1 << top - i), F.col(c).cast("string")) for i, c in enumerate(columns)))
    return sets.select(which.alias("column"), value.alias("value"), "n")


def id_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, key): ids on one side only."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(F.lit("missing").alias("side"), key).union(b.join(a, key, "left_anti").select(F.lit("extra").alias("side"), key))


def action_durations(spans: DataFrame) -> DataFrame:
    """Seconds and count of successful actions, by action type."""
    return spans.filter("status = 'ok'").groupBy("action_type").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("n"))


def case_results(cases: DataFrame) -> DataFrame:
    """Adds passed_minimums: done, enough active documents, active evidence and citations, an answer."""
    enough = (F.col("active_documents") >= F.col("min_documents")) & (F.col("active_evidence") >= F.col("min_evidence")) & (F.col("citations") >= F.col("min_citations"))
    return cases.withColumn("passed_minimums", F.coalesce(F.col("done") & enough & (F.trim(F.coalesce("final_answer", F.lit(""))) != ""), F.lit(False)))


def summary(results: DataFrame) -> DataFrame:
    """One row of counts, totals, averages (2 digits) and coverage (4 digits)."""
    counted = {
        "completed_count": F.col("done"), "passed_minimums_count": F.col("passed_minimums"), "with_documents_count": F.col("documents") > 0, "with_active_documents_count": F.col("active_documents") > 0,
        "with_unusable_documents_count": F.col("unusable_documents") > 0, "with_evidence_count": F.col("evidence") > 0, "with_active_evidence_count": F.col("active_evidence") > 0, "with_citations_count": F.col("citations") > 0,
        "preferred_source_match_count": F.col("preferred_source_type_match"), "error_count": F.col("error").isNotNull(), "with_retrieval_failures_count": F.size("retrieval_failure_reasons") > 0,
    }
    totals = {
        "total_curation_actions": "curation_actions", "total_filtered_results": "filtered_results", "total_classified_results": "classified_results",
        "total_recognized_sources": "recognized_sources", "total_unknown_sources": "unknown_sources"
    }
    averaged = (
        "retrieved_results", "filtered_results", "classified_results", "recognized_sources", "unknown_sources", "documents", "active_documents",
        "unusable_documents", "evidence", "active_evidence", "action_seconds"
    )
    one = results.agg(
        F.count("*").alias("case_count"), *(F.count_if(c).alias(k) for k, c in counted.items()), *(F.sum(c).alias(k) for k, c in totals.items()), *(
            F.bround(F.avg(c), 2).alias(f"average_{c}") for c in averaged
        ),
    )
    return one.withColumn("classification_coverage", ratio(F.col("total_recognized_sources"), F.col("total_classified_results")))


def histogram(results: DataFrame, column: str) -> DataFrame:
    """(value, n) of an array column's items."""
    return results.select(F.explode(column).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def unknown_domains(classified: DataFrame) -> DataFrame:
    """All domains without a known type, most frequent first."""
    found = classified.filter("classification_source = 'unknown' and domain <> ''").groupBy("domain").agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "domain")


def ordered_distinct(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Distinct values in order of first appearance."""
    first = rows.groupBy(key, value).agg(F.min(order).alias("o"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", value))), lambda x: x[value]).alias("values"))


def sketches(rows: DataFrame, run: str, value: str, lg_k: int = 12) -> DataFrame:
    """(run, sketch) of the distinct values of each run: a few kilobytes each that can be stored and merged later."""
    return rows.groupBy(run).agg(F.hll_sketch_agg(value, lg_k).alias("sketch"))


def merged_estimate(stored: DataFrame, *keys: str) -> DataFrame:
    """(keys, estimate) of distinct values over all runs of a key, from their stored sketches alone.

    The standard error is about 1.04 / sqrt(2 ** lg_k) of the count, 1.6 % for the default.
    """
    return stored.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def source_stats(state: DataFrame, results: DataFrame, preferred: DataFrame) -> DataFrame:
    """(run_id, domains, source_types, preferred_source_type_match) of each run's search results.

    ``state`` (run_id, result_id, ord) are the ids a run holds and ``results`` (result_id,
    domain, source_type) the stored results; ids without a stored result, and results without
    a source, say nothing.  Domains and types come in order of first appearance; blank domains
    are left out.  ``preferred`` (run_id, source_types) names the runs.
    """
    held = checkpoint(state.join(results.filter("source_type is not null"), "result_id").select("run_id", "ord", "domain", "source_type"))
    domains = ordered_distinct(held.filter("domain <> ''"), "run_id", "domain", "ord").withColumnRenamed("values", "domains")
    types = ordered_distinct(held, "run_id", "source_type", "ord").withColumnRenamed("values", "types")
    none = F.array().cast("array<string>")
    every = preferred.select("run_id", "source_types").join(domains, "run_id", "left").join(types, "run_id", "left")
    return every.select(
        "run_id", F.coalesce("domains", none).alias("domains"), F.coalesce("types", none).alias("source_types"),
        F.arrays_overlap("source_types", F.coalesce("types", none)).alias("preferred_source_type_match")
    )


def stop_reason(action: str = "last_action", done: str = "done"):
    return F.when(F.col(action) == "finish", "finished").when(F.col(action) == "stop", "stopped").when(~F.col(done), "max_steps").otherwise("error")
