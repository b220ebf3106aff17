"""index_documents: the corpus' full-text index, brought up to the documents as they stand.

    python -m jobs.index_documents DOCUMENTS OUT [--config jobs/index_documents.json]

DOCUMENTS is a Parquet table of (doc_id, text) that is replaced by newer states.  The job
compares its content hashes with the index below OUT, splits only new and changed texts
into tokens, voids the postings of changed and (with ``complete``) missing documents, and
writes one more batch partition of each index table.  The number of the last whole batch is
the mark from which the next run goes on.  A run without changes writes nothing, and one
that was broken off is repeated whole.  With ``merge_to`` the index is written anew as one
batch of another folder.

``search`` gives the best documents for a query from the index alone.

Defined cases: rows without a key are left out, a null text is an empty one, and of rows
with one key that of the least content hash counts; an empty table makes an empty index.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from jobs import common
from lodestral.functions.session import spread
from lodestral.operators import inverted

LOG = logging.getLogger("jobs.index_documents")


def run(spark: SparkSession, documents: str, out: str, key: str = "doc_id", text: str = "text", complete: bool = True, merge_to: str | None = None) -> DataFrame:
    """Bring the index up to the table; gives the valid postings (key, term, tf, length)."""
    table = spread(spark.read.parquet(documents).select(key, text))
    done = inverted.add(table, out, key, text, complete)
    LOG.info("read %s; index %s is at batch %d: %d new, %d changed, %d removed documents", documents, out, done["batch"], done["new"], done["changed"], done["removed"])
    if merge_to:
        inverted.merge(spark, out, merge_to)
        LOG.info("index %s written as one batch to %s", out, merge_to)
    return inverted.postings(spark, merge_to or out, table.schema[key].dataType.simpleString()).withColumnRenamed("key", key)


def search(spark: SparkSession, out: str, query: str, limit: int = 10, key: str = "doc_id") -> DataFrame:
    """Top ``limit`` (key, score) for a query."""
    found = inverted.Search(spark, out, query, limit, key)
    LOG.info("query %r read %d of %d blocks of %s", query, found.read, found.blocks, out)
    return found.top


if __name__ == "__main__":
    common.main(run, "index_documents: the corpus' full-text index", "documents", "out")
