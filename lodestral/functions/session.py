"""Session settings that operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one only where none is named and the master is local, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named and not (sc.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestral-"))
    return named or sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def spread(table: DataFrame) -> DataFrame:
    """A scanned table of fewer splits than there are cores, dealt over all of them.

    Only for a plain scan in front of work that is heavy per row; a table of many files
    or row groups is left as it is.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if 0 < table.rdd.getNumPartitions() < cores else table
