"""Corpus sync: page decisions, breadth-first discovery, per-source summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from lodestral.functions import urls
from lodestral.functions.session import checkpoint
from lodestral.functions.times import published_at
from lodestral.operators.store import preserve_or_deactivate


def decide_pages(pages: DataFrame) -> DataFrame:
    """One decision per page of (url, robots, status, error, in_scope, text, title, existing_*, dates).

    Adds action (keep or write), new_status, reason, failure (row for the failure table),
    title and published_at.  The first case that holds counts: robots deferred, robots
    disallowed, fetch or parse error, 304 with and without a stored page, redirect out
    of scope, blank text, active.
    """
    has = F.col("existing_status").isNotNull()
    blank = F.coalesce(urls.strip(F.col("text")), F.lit("")) == ""
    error = F.coalesce("error", F.when(blank & F.col("in_scope") & (F.col("status") != 304), "no_extractable_text"))
    case = (
        F.when(F.col("robots") == "deferred", "deferred").when(F.col("robots") == "disallowed", "disallowed").when(F.col("error").isNotNull(), "failed")
        .when((F.col("status") == 304) & has, "unchanged").when(F.col("status") == 304, "missing").when(~F.col("in_scope"), "redirected").when(blank, "failed").otherwise("active")
    )
    kept_status, kept_reason = preserve_or_deactivate(F.col("existing_status"), error)
    missing = F.lit("received HTTP 304 without a stored document")
    keeps = F.col("case").isin("deferred", "unchanged") | ((F.col("case") == "failed") & F.coalesce(F.col("existing_status") == "active", F.lit(False)))
    return pages.withColumn("case", case).select(
        *pages.columns, "case", F.when(keeps, "keep").otherwise("write").alias("action"),
        F.when(keeps, F.col("existing_status")).when(F.col("case") == "active", "active").when(F.col("case") == "failed", kept_status).otherwise("inactive").alias("new_status"),
        F.when(F.col("case") == "disallowed", "robots_disallowed").when((F.col("case") == "failed"), kept_reason).when(F.col("case") == "missing", missing).when(
            F.col("case") == "redirected", "redirect_outside_source_scope"
        ).alias("reason"),
        F.when(F.col("case") == "deferred", "robots_deferred").when(F.col("case") == "failed", error).when(F.col("case") == "missing", missing).alias("failure"),
        F.when(F.col("case") == "active", F.coalesce("title", "existing_title")).alias("new_title"),
        F.when(
            F.col("case") == "active", published_at(F.col("fetched_at"), F.col("published_at"), F.col("discovered_at"), F.col("existing_published_at"))
        ).alias("new_published_at"),
    )


def sitemap_levels(start: DataFrame, expand: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(content URLs, all sitemaps): breadth-first over nested sitemaps.

    ``expand`` fetches and parses a level (source_id, url) into (source_id, kind, url).
    Children on another host than their source's sitemaps are left out; each sitemap is
    read once, so the walk ends however deep they nest.  A level is one job.
    """
    hosts = start.select("source_id", urls.host(F.col("url")).alias("h")).distinct()
    key = urls.normalize(F.col("url"))
    level = start.select("source_id", "url").withColumn("k", key).dropDuplicates(["source_id", "k"])
    seen, content, depth = level, level.select("source_id", "url").limit(0), 0
    while not level.isEmpty():
        depth += 1
        made = checkpoint(expand(level.select("source_id", "url")))  # fetched once
        found = made.filter("kind = 'content'").select("source_id", "url")
        content = content.unionByName(found)
        nested = made.filter("kind = 'sitemap'").withColumn("h", urls.host(F.col("url"))).join(hosts, ["source_id", "h"], "left_semi").select("source_id", "url").withColumn("k", key).dropDuplicates(["source_id", "k"])
        level = checkpoint(nested.join(seen, ["source_id", "k"], "left_anti"))
        seen = seen.unionByName(level)
        if depth % 16 == 0:  # keep the plans of long walks short
            seen, content = checkpoint(seen), checkpoint(content)
    return content, seen.select("source_id", "url")


def summary(documents: DataFrame, failures: DataFrame) -> DataFrame:
    """Per source and in total (source_id null): documents, active with date, failures."""
    d = documents.select("source_id", F.lit(1).alias("d"), ((F.col("status") == "active") & F.col("published_at").isNotNull()).cast("int").alias("a"), F.lit(0).alias("f"))
    f = failures.select("source_id", F.lit(0).alias("d"), F.lit(0).alias("a"), F.lit(1).alias("f"))
    return d.union(f).rollup("source_id").agg(
        F.sum("d").alias("documents"), F.sum("a").alias("active_dated"), F.sum("f").alias("failures"), F.grouping("source_id").cast("int").alias("is_total")
    )
