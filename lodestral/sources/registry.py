"""Registry of trusted sources: scan, integrity rules, URL-to-source join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lodestral.functions import urls

SCHEMA_VERSION = 2
#: Types a source may have.
TYPES = ("news", "official", "research", "leaderboard", "blog", "social", "aggregator")
SOURCE = "id string, name string, source_type string, enabled boolean, allowed_domains array<string>, allowed_path_prefixes array<string>, feeds array<string>, sitemaps array<string>"


class RegistryError(ValueError):
    pass


def load(spark: SparkSession, path: str) -> DataFrame:
    """One row per source with its place ``ord``; defaults filled; any broken rule raises."""
    try:
        fields = SOURCE.replace(" ", ": ").replace(",: ", ", ")
        raw = spark.read.schema(f"schema_version int, sources array<struct<{fields}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
        head = raw.first()
    except Exception as e:
        raise RegistryError(f"cannot read registry: {e}") from e
    if head is None or head["schema_version"] != SCHEMA_VERSION:
        raise RegistryError("unsupported schema version")
    sources = with_defaults(raw.select(F.posexplode("sources").alias("ord", "s")).select("ord", "s.*"))
    broken = violations(sources).limit(5).collect()
    if broken:
        raise RegistryError("; ".join(f"{r['id']}: {r['rule']}" for r in broken))
    return sources


def with_defaults(sources: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return sources.withColumns({
        "enabled": F.coalesce("enabled", F.lit(True)), "allowed_path_prefixes": F.coalesce("allowed_path_prefixes", F.array(F.lit("/"))), "feeds": F.coalesce("feeds", none), "sitemaps": F.coalesce("sitemaps", none),
        "allowed_domains": F.transform("allowed_domains", lambda d: F.lower(urls.strip(d))),
    })


def violations(sources: DataFrame) -> DataFrame:
    """(id, rule) for every broken integrity rule."""
    ends = F.concat("feeds", "sitemaps")
    unlike = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    bad_prefix = F.exists("allowed_path_prefixes", lambda p: ~p.startswith("/") | p.rlike("[?#]"))
    outside = F.exists(ends, lambda u: ~urls.strict_http(u) | ~F.array_contains(F.col("allowed_domains"), urls.host(u)))
    rules = F.array_compact(F.array(
        F.when(
            ~F.coalesce(F.col("id").rlike("^[a-z0-9][a-z0-9_-]*$"), F.lit(False)), "bad id"
        ), F.when(~F.coalesce(F.col("source_type").isin(*TYPES), F.lit(False)), "bad source type"),
        F.when(F.coalesce(F.size("allowed_domains"), F.lit(0)) < 1, "no domain"), F.when(F.exists("allowed_domains", lambda d: ~urls.bare_domain(d)), "bad domain"),
        F.when(bad_prefix, "bad path prefix"), F.when(outside, "endpoint outside domains"), F.when(F.exists(ends, lambda u: u.contains("#")), "endpoint with fragment"),
        F.when(unlike(F.col("allowed_domains")) | unlike(F.col("allowed_path_prefixes")) | unlike(ends), "duplicate entries"),
    ))
    own = sources.select("id", F.explode(rules).alias("rule"))
    twice = sources.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("duplicate id").alias("rule"))
    domains = sources.select("id", F.explode("allowed_domains").alias("d")).select("id", urls.domain_key(F.col("d")).alias("d")).distinct()
    shared = domains.groupBy("d").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n > 1").select("id", F.lit("domain of two sources").alias("rule"))
    return own.union(twice).union(shared)


def enabled(sources: DataFrame) -> DataFrame:
    return sources.filter("enabled").orderBy("ord")


def in_scope(url: Column, domains: Column, prefixes: Column) -> Column:
    """Host is an allowed domain and the path is, or lies below, an allowed prefix."""
    at = F.when(urls.path(url) == "", "/").otherwise(urls.path(url))
    below = F.exists(prefixes, lambda p: (p == "/") | (at == p) | at.startswith(F.concat(F.rtrim(p, F.lit("/")), F.lit("/"))))
    return F.coalesce(F.array_contains(domains, urls.host(url)) & below, F.lit(False))


def match(rows: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    """Left join to the first enabled source in registry order whose scope holds the URL.

    An equi-join on the host; Spark broadcasts the registry by its own size limit.
    """
    by_host = sources.filter("enabled").select(
        F.col("ord").alias("s_ord"), F.col("id").alias("source_id"), "allowed_domains", "allowed_path_prefixes", F.explode("allowed_domains").alias("domain")
    )
    hit = rows.select(*key, "url", urls.host(F.col("url")).alias("h")).join(by_host, F.col("h") == F.col("domain")).filter(
        in_scope(F.col("url"), F.col("allowed_domains"), F.col("allowed_path_prefixes"))
    )
    first = hit.withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy("s_ord"))).filter("n = 1").select(*key, "source_id")
    return rows.join(first, key, "left")
