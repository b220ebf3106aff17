"""JSON-lines, encrypted benchmark files, artifacts, spans and their writers."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, ord, line) of text files: the line's number in its file from 1, its place in all files from 0.

    Files are read in byte ranges by as many tasks as Spark cuts them into.  Lines of a range
    are counted first, and sums over the ranges before it give where its numbers begin; only
    that table, a row for each range, is joined.  Files come in the order of their paths.
    """
    meta = F.col("_metadata")
    read = spark.read.text(path).select(
        F.col("value").alias("line"), meta["file_path"].alias("file"), meta["file_block_start"].alias("begin"), F.monotonically_increasing_id().alias("id")
    )
    ranges = read.groupBy("file", "begin").agg(F.count("*").alias("lines"), F.min("id").alias("first"))
    before = lambda *by: F.coalesce(F.sum("lines").over(W.partitionBy(*by).orderBy("file", "begin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # The files' ranges in a row are as many as tasks.
    placed = ranges.select(F.col("file").alias("f"), F.col("begin").alias("b"), "first", before("file").alias("in_file"), before().alias("in_all"))
    at = F.col("id") - F.col("first")
    numbered = read.join(placed, (F.col("file") == F.col("f")) & (F.col("begin") == F.col("b")))
    return numbered.select("file", (F.col("in_file") + at + 1).alias("number"), (F.col("in_all") + at).alias("ord"), "line")


def read_cases(spark: SparkSession, path: str, schema: str, unique: str | None = None) -> DataFrame:
    """JSON lines with ``ord``; blank lines are skipped, a bad line, no line or a repeated id raises."""
    lines = numbered_lines(spark, path).filter("trim(line) <> ''")
    parsed = lines.select("file", "number", "ord", F.from_json("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("c"))
    bad = parsed.filter("c is null or c._bad is not null").orderBy("ord").select("file", "number").first()
    if bad:
        raise ValueError(f"{bad['file']}:{bad['number']}: invalid case")
    cases = parsed.select("ord", "c.*").drop("_bad")
    if unique is not None:
        if cases.isEmpty():
            raise ValueError(f"{path}: no cases")
        twice = cases.groupBy(unique).count().filter("count > 1").first()
        if twice:
            raise ValueError(f"{path}: duplicate {unique} {twice[0]}")
    return cases


def _masked(data: bytes, secret: str) -> bytes:
    """Bytes XORed with the SHA-256 digest of the secret, repeated."""
    raw = np.frombuffer(data, np.uint8)
    return (raw ^ np.resize(np.frombuffer(hashlib.sha256(secret.encode()).digest(), np.uint8), len(raw))).tobytes()


def decrypt(cipher: Column, secret: Column) -> Column:
    """Text of base64 data that is masked by the secret's digest; null for null."""

    @F.pandas_udf("string")
    def run(data: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([None if d is None or k is None else _masked(base64.b64decode(d), k).decode() for d, k in zip(data, key)], dtype=object)

    return run(cipher, secret)


def encrypt(text: Column, secret: Column) -> Column:
    """The inverse of ``decrypt``."""

    @F.pandas_udf("string")
    def run(data: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([None if d is None or k is None else base64.b64encode(_masked(d.encode(), k)).decode() for d, k in zip(data, key)], dtype=object)

    return run(text, secret)


def prepare_questions(raw: DataFrame, secret: str) -> DataFrame:
    """Decrypted questions with lower-case enumerations."""
    return raw.select(
        "id", decrypt(F.col("question"), F.lit(secret)).alias("question"), F.lower("answer_type").alias("answer_type"),
        F.lower("question_type").alias("question_type"), "topic"
    )


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def export_by_id(predictions: DataFrame, path: str, most: int = 10_000) -> None:
    """One folder of JSON per id, as evaluations are handed in; a repeated id, or more than ``most`` of them, raises."""
    ids = predictions.groupBy("id").count()
    twice = ids.filter("count > 1").first()
    if twice:
        raise ValueError(f"duplicate id {twice[0]}")
    if ids.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} predictions; write them as lines")
    predictions.repartition("id").write.mode("errorifexists").partitionBy("id").json(path)


def put_artifacts(store: DataFrame, new: DataFrame) -> DataFrame:
    """Append-only (artifact_type, id, ord, payload); a blank or known id raises."""
    bad = new.filter("id is null or trim(id) = ''").first() or new.join(store, ["artifact_type", "id"], "left_semi").first() or new.groupBy("artifact_type", "id").count().filter("count > 1").first()
    if bad:
        raise ValueError(f"missing or duplicate artifact id: {bad['id']}")
    return store.unionByName(new)


def get_artifact(store: DataFrame, kind: str, artifact_id: str) -> DataFrame:
    return store.filter((F.col("artifact_type") == kind) & (F.col("id") == artifact_id))


def list_artifacts(store: DataFrame, kind: str) -> DataFrame:
    return store.filter(F.col("artifact_type") == kind).orderBy("ord")


def trace(spans: DataFrame, trace_id: str) -> DataFrame:
    return spans.filter(F.col("trace_id") == trace_id).orderBy("started_at", "span_id")
