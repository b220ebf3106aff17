"""The training-data pipeline: five stages, each over all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame.  All but the last return the columns of documents.  ``run`` applies them in a
row, each result written as Parquet to the shared folder and read again.

Defined cases, for every stage: a null or empty text is a document without words (clean,
and of several such documents the near-duplicate stage keeps one); null and repeated ids
are allowed, rows are judged by their texts; texts are read whole, however long; columns
that documents has besides are kept as they are, whatever their names; an empty table
gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestral.llm import bpe, decontam, shared, simhash, substring, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; learned as in op9, from the labels of other folds."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs.filter(~toxicity.held_out()), labels.filter(~toxicity.held_out()))
    return toxicity.kept(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row of least (doc_id, text hash) stays, null ids last; of repeated rows one.

    Near copies share 0.8 or more of their distinct five-word shingles, which differ in far
    more than two bits of one fingerprint: slices and bands find them, the shingles decide.
    Rows are told apart by id and text, so texts that share an id are judged each for itself.
    """
    return simhash.distinct(docs)


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by an earlier 20-word window go; the other words stay, joined by single spaces."""
    return substring.shortened(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark windows go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left, with digests of ids and decoded bytes."""
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe.round_trip(docs, ranks, pattern)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_spans),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", encode),
]

#: A learned score and merges by rank aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES:
        docs = shared.stored(stage(spark, docs, sf_dir), name)
    return docs
