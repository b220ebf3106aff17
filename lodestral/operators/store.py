"""Latest-version document store: snapshot tables merged by full outer join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestral.functions import urls
from lodestral.functions.values import blank_to_null, content_hash

#: Columns an upsert replaces, null included.
REPLACED = ("url", "status", "title", "text", "media_type", "published_at", "fetched_at", "etag", "last_modified", "content_hash", "failure_reason")
DOCUMENT = (
    "id string, source_id string, url string, canonical_url string, status string, title string, text string, media_type string, published_at timestamp, fetched_at timestamp, "
    "etag string, last_modified string, content_hash string, failure_reason string, created_at timestamp, updated_at timestamp"
)


def incoming(documents: DataFrame) -> DataFrame:
    """Adds canonical_url and content_hash; blank optional strings become null."""
    out = documents.withColumns({c: blank_to_null(F.col(c)) for c in ("title", "media_type", "etag", "last_modified", "failure_reason") if c in documents.columns})
    return out.withColumn("canonical_url", urls.normalize(F.col("url"))).withColumn("content_hash", content_hash(F.col("text")))


def upsert(old: DataFrame, new: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(snapshot, rejected): one version per canonical URL.

    ``new`` has source_id, the replaced columns and canonical_url, one row per canonical
    URL.  Invalid URLs and rows of another source than the stored one are rejected with
    ``error`` and leave the stored row as it is.  Ids derive from the canonical URL, so a
    retried task makes the same ones.
    """
    now = F.lit(as_of).cast("timestamp")
    n = new.select(F.col("canonical_url"), F.struct("source_id", *REPLACED).alias("n"))
    o = old.select(F.col("canonical_url"), F.struct(*(c for c in old.columns if c != "canonical_url")).alias("o"))
    joined = o.join(n, "canonical_url", "full_outer")
    invalid = F.col("n").isNotNull() & ~urls.strict_http(F.col("n.url"))
    conflict = F.col("n").isNotNull() & F.col("o").isNotNull() & (F.col("n.source_id") != F.col("o.source_id"))
    error = F.when(invalid, "invalid HTTP URL").when(conflict, "source conflict")
    marked = joined.withColumn("error", error)
    take = F.col("n").isNotNull() & F.col("error").isNull()
    snapshot = marked.filter(F.col("o").isNotNull() | take).select(
        F.coalesce("o.id", F.sha2("canonical_url", 256)).alias("id"), F.coalesce("o.source_id", "n.source_id").alias("source_id"), "canonical_url",
        *(F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in REPLACED),
        F.coalesce("o.created_at", now).alias("created_at"), F.when(take, now).otherwise(F.col("o.updated_at")).alias("updated_at"),
    )
    return snapshot, marked.filter(F.col("error").isNotNull()).select("canonical_url", "n.source_id", "error")


def upsert_endpoints(old: DataFrame, new: DataFrame) -> DataFrame:
    """Endpoint state by url: validators replaced (null too), content kept where none is given."""
    o = old.select("url", F.struct("etag", "last_modified", "content").alias("o"))
    n = new.select("url", F.struct("etag", "last_modified", "content").alias("n"))
    pick = lambda c: F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return o.join(n, "url", "full_outer").select("url", pick("etag"), pick("last_modified"), F.coalesce("n.content", "o.content").alias("content"))


def preserve_or_deactivate(existing_status, reason):
    """Status and reason after a failure: an active row stays, others become inactive."""
    active = F.coalesce(existing_status == "active", F.lit(False))
    return F.when(active, "active").otherwise("inactive"), F.when(~active, reason)


def documents(snapshot: DataFrame, status: str | None = None) -> DataFrame:
    found = snapshot if status is None else snapshot.filter(F.col("status") == status)
    return found.orderBy("created_at", "id")


def get(snapshot: DataFrame, document_id: str) -> DataFrame:
    return snapshot.filter(F.col("id") == document_id)


def get_by_url(snapshot: DataFrame, url: str) -> DataFrame:
    return snapshot.filter(F.col("canonical_url") == urls.normalize(F.lit(url)))


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """A new snapshot folder, partitioned by status so that status scans prune."""
    snapshot.write.mode("errorifexists").partitionBy("status").parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).parquet(path)


def violations(snapshot: DataFrame) -> DataFrame:
    """Active rows without text, unknown statuses, duplicate canonical URLs."""
    blank = snapshot.filter("status = 'active'").filter(F.coalesce(urls.strip(F.col("text")), F.lit("")) == "").select("id", F.lit("active without text").alias("rule"))
    status = snapshot.filter(~F.col("status").isin("discovered", "active", "inactive")).select("id", F.lit("unknown status").alias("rule"))
    twice = snapshot.groupBy("canonical_url").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n > 1").select("id", F.lit("duplicate canonical URL").alias("rule"))
    return blank.union(status).union(twice)
