"""Session helpers: the folder that all executors share, and code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

_ROOT = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that lack it on their path."""
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(":") or spark.sparkContext.applicationId in _SHIPPED:
        return
    target = os.path.join(tempfile.mkdtemp(), "lodestral.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((_ROOT / "lodestral").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(spark.sparkContext.applicationId)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, removed when the application ends; a local one only on a local master."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base and not (sc.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:  # as in tests
        base = os.path.join(tempfile.gettempdir(), "lodestral-checkpoints")
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors.

    ``few`` is for tables of few or short rows: a file for every fourth shuffle partition, but
    four for each core at least, so that no stage has fewer tasks than it could use.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    if few:
        df = df.coalesce(max(partitions(spark) // 4, 4 * spark.sparkContext.defaultParallelism))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def wrapped(docs: DataFrame, *columns) -> DataFrame:
    """Whole rows as one struct ``row`` beside own columns, so that no name of the input can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *columns)


def fields(docs: DataFrame, more: str) -> StructType:
    """Schema of ``row`` and more columns."""
    return StructType([StructField("row", docs.schema), *StructType.fromDDL(more).fields])


def unwrapped(df: DataFrame, docs: DataFrame, *new: str) -> DataFrame:
    """The columns of docs and the new ones; a column of docs with the name of a new one gives way to it."""
    gone = {c.lower() for c in new}
    return df.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in gone), *new)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Give freed memory back to the system."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def _tidy(function):
    """The same, trimming when a task ends: workers are kept and would hold the memory."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            trim()

    return run


def spread(table: DataFrame) -> DataFrame:
    """A scanned table of fewer splits than there are cores, dealt over all of them.

    Only for a plain scan; a table of many files or row groups is left as it is.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if 0 < table.rdd.getNumPartitions() < cores else table


def arrow(df: DataFrame, function, schema: str | StructType, batch: str = "4m") -> DataFrame:
    """mapInArrow with batches of at most 4 MB (a session setting), so that workers hold little text at a time."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch)
    return df.mapInArrow(_tidy(function), schema)
