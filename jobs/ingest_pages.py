"""ingest_pages: crawled pages into the store of page versions, new files only.

    python -m jobs.ingest_pages PAGES OUT CHECKPOINT [--config jobs/ingest_pages.json]

PAGES is a Parquet folder (or file) of (page_id, url, html) that grows by files; a file
stream with a checkpoint takes those that are new and ends.  Each micro-batch is parsed,
its URLs are normalised, and every page is compared with the newest stored version of its
URL: a page that says nothing new is written without its text.  Rows lie below OUT, one
partition for each batch and bucket of URLs.  A batch that is repeated after a failure
compares with the batches before it and replaces its own partitions, so a rerun gives the
same rows.

With ``closed``, character references without their semicolon stay as they are written.

``current`` reads the newest page of each URL with its text; the order of arrival doesn't matter.

Defined cases: pages without a fetchable URL are written with the error ``invalid_url``
and are current nowhere; a null page is an empty one (``no_extractable_text``); pages of one
URL in one batch are compared with the stored version, not with one another; of pages with
one URL and one id the one of greatest hash is current; an empty folder ingests nothing.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from jobs import common
from lodestral.functions import urls
from lodestral.sources import html

LOG = logging.getLogger("jobs.ingest_pages")
INPUT = "page_id long, url string, html string"
VERSIONS = (
    "page_id long, url string, canonical_url string, publisher string, title string, text string, published_at timestamp, content_hash string, n_chars long, change string, error string"
)
PARTITIONS = "batch long, bucket int"


def versions(spark: SparkSession, out: str, below: int | None = None) -> DataFrame:
    """All rows of the store, or those of batches before ``below``; none where nothing is stored yet."""
    try:
        found = spark.read.schema(f"{VERSIONS}, {PARTITIONS}").parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{VERSIONS}, {PARTITIONS}")
    return found if below is None else found.filter(F.col("batch") < below)


def parsed(pages: DataFrame, ignored: Iterable[str], buckets: int, closed: bool = False) -> DataFrame:
    """Pages as rows of the store, but for ``change``."""
    rows = pages.select(
        "page_id", "url", F.struct("page_id", "url").alias("page"), F.lit("text/html").alias("media_type"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content")
    )
    text = html.parse_documents(rows, "page", closed).select("page.*", "title", "text", "published_at", "error")
    canonical = F.when(urls.fetchable(F.col("url")), urls.normalize(F.col("url"), ignored))
    made = text.withColumn("canonical_url", canonical).withColumn("error", F.when(F.col("canonical_url").isNull(), "invalid_url").otherwise(F.col("error")))
    said = F.to_json(F.struct("title", "text", "published_at", "error"))
    return made.select(
        "page_id", "url", "canonical_url", urls.publisher_domain(F.col("url")).alias("publisher"), "title", "text", "published_at", F.sha2(said, 256).alias("content_hash"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "error",
        F.pmod(F.xxhash64("canonical_url"), F.lit(buckets)).cast("int").alias("bucket"),
    )


def compared(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds ``change``: new, changed or unchanged against the newest stored version; unchanged rows lose their text."""
    newest = stored.filter("canonical_url is not null").groupBy(F.col("canonical_url").alias("known")).agg(
        F.max_by("content_hash", F.struct("page_id", "content_hash")).alias("known_hash")
    )
    change = F.when(F.col("canonical_url").isNull(), "invalid").when(F.col("known").isNull(), "new").when(F.col("known_hash") == F.col("content_hash"), "unchanged").otherwise("changed")
    marked = rows.join(newest, F.col("canonical_url") == F.col("known"), "left").withColumn("change", change)
    return marked.withColumn("text", F.when(F.col("change") != "unchanged", F.col("text"))).select(*(c.split()[0] for c in VERSIONS.split(", ")), "bucket")


def current(spark: SparkSession, out: str) -> DataFrame:
    """The newest page of each URL.  A row without its text takes that of a row with the same hash."""
    rows = versions(spark, out).filter("canonical_url is not null")
    place = F.struct("page_id", "content_hash")
    newest = rows.groupBy("canonical_url").agg(F.max(place).alias("newest"), F.max_by(F.struct("url", "publisher", "title", "published_at", "n_chars", "error"), place).alias("v"))
    texts = rows.filter("text is not null").groupBy(F.col("canonical_url").alias("u"), F.col("content_hash").alias("h")).agg(F.first("text").alias("text"))  # equal hashes, equal texts
    same = (F.col("canonical_url") == F.col("u")) & (F.col("newest.content_hash") == F.col("h"))
    return newest.join(texts, same, "left").select("canonical_url", "newest.page_id", "newest.content_hash", "v.*", "text")


def _pattern(path: str) -> str:
    """The same path as a pattern: a file stream takes a single file only that way, and a folder too."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]" if path[-1] not in "]*}" else path


def run(spark: SparkSession, pages: str, out: str, checkpoint: str, ignored: Iterable[str] = urls.TRACKING_KEYS, buckets: int = 16, max_files: int = 1000, closed: bool = False) -> DataFrame:
    """Ingest what is new and wait for it; gives ``current``."""
    ignored = list(ignored)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        rows = compared(parsed(batch, ignored, buckets, closed), versions(session, out, batch_id)).withColumn("batch", F.lit(batch_id).cast("long"))
        # Buckets bound the files a batch writes; a bucket of many rows is cut by the writer.
        dealt = rows.repartition("bucket", F.pmod("page_id", F.lit(8)))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 200_000).partitionBy("batch", "bucket").parquet(out)
        wrote = versions(session, out).filter(F.col("batch") == batch_id).groupBy("change").count()
        LOG.info("batch %d written to %s: %s", batch_id, out, dict(sorted(tuple(r) for r in wrote.collect())))

    stream = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", max_files).parquet(_pattern(pages))
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("read %d rows of %s in %d batches", sum(p["numInputRows"] for p in query.recentProgress), pages, len(query.recentProgress))
    return current(spark, out)


if __name__ == "__main__":
    common.main(run, "ingest_pages: crawled pages into the store of page versions", "pages", "out", "checkpoint")
