"""Structured Streaming forms: upsert by batch, run state, windowed spans, first-seen URLs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestral.functions import urls
from lodestral.functions.session import checkpoint_dir
from lodestral.operators import store


def read_events(spark: SparkSession, path: str, schema, per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder or glob as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def _manifest(spark: SparkSession, target: str, batch_id: int) -> dict[int, int]:
    """Version of each bucket after a batch; empty before the first."""
    if batch_id < 0:
        return {}
    return dict(spark.read.schema("bucket int, version long").parquet(f"{target}/manifests/{batch_id}").collect())  # as many rows as buckets


def _buckets(spark: SparkSession, target: str, versions: dict[int, int]) -> DataFrame:
    paths = [f"{target}/version={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(store.DOCUMENT).parquet(*paths) if paths else spark.createDataFrame([], store.DOCUMENT)


def upserted(spark: SparkSession, target: str, batch_id: int) -> DataFrame:
    """The snapshot after a batch of ``upsert_batches``."""
    return _buckets(spark, target, _manifest(spark, target, batch_id))


def upsert_batches(stream: DataFrame, target: str, checkpoint: str, buckets: int = 64, keep: int = 2):
    """Latest-version upsert of each micro-batch, one row per canonical URL.

    Documents lie in buckets by a hash of their canonical URL.  A batch writes the buckets
    it touches as a new version and then a manifest, which tells the version of every
    bucket; a batch that is repeated after a failure writes the same.  Versions that the
    last ``keep`` manifests don't name are removed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()  # read for its latest time, its buckets and its rows
        try:
            newest = W.partitionBy("canonical_url").orderBy(F.col("fetched_at").desc(), "url")
            new = batch.withColumn("n", F.row_number().over(newest)).filter("n = 1").drop("n")
            bucket = F.pmod(F.xxhash64("canonical_url"), F.lit(buckets)).cast("int")
            touched = {r[0] for r in new.select(bucket).distinct().collect()}  # as many as there are buckets
            before = _manifest(spark, target, batch_id - 1)
            if touched:
                old = _buckets(spark, target, {b: v for b, v in before.items() if b in touched})
                snapshot, _ = store.upsert(old, new, batch.agg(F.max("fetched_at")).first()[0])
                snapshot.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/version={batch_id}")
            after = before | {b: batch_id for b in touched}
            spark.createDataFrame(sorted(after.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{target}/manifests/{batch_id}")
            _clean(spark, target, batch_id, keep)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _clean(spark: SparkSession, target: str, batch_id: int, keep: int) -> None:
    """Remove the manifest that has just become too old, and the buckets that only it names."""
    gone = batch_id - keep
    if gone < 0:
        return
    old, next_ = _manifest(spark, target, gone), _manifest(spark, target, gone + 1)
    paths = [f"{target}/version={v}/bucket={b}" for b, v in old.items() if next_.get(b) != v]
    for path in [*paths, f"{target}/manifests/{gone}"]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def span_windows(events: DataFrame, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Count and seconds by event type and tumbling window; later data than ``late`` is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("seconds"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def first_seen(discovered: DataFrame, late: str = "1 day") -> DataFrame:
    """Each normalised URL once within the watermark."""
    return discovered.withColumn("normalized_url", urls.normalize(F.col("url"))).withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["normalized_url"])


STATE = "user_id long, steps long, last_type string, last_ts timestamp"


def run_state(events: DataFrame) -> DataFrame:
    """Running state of each run: steps so far and the last action, by event time and id."""

    def update(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        steps, last_type, last_ts, last_id = state.get if state.exists else (0, None, None, None)
        for part in parts:
            steps += len(part)
            top = part.sort_values(["ts", "event_id"]).iloc[-1]
            at = int(pd.Timestamp(top["ts"]).value // 1000)
            if last_ts is None or (at, int(top["event_id"])) > (last_ts, last_id):
                last_type, last_ts, last_id = str(top["event_type"]), at, int(top["event_id"])
        state.update((steps, last_type, last_ts, last_id))
        yield pd.DataFrame({"user_id": [key[0]], "steps": [steps], "last_type": [last_type], "last_ts": [pd.Timestamp(last_ts, unit="us")]})

    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.groupBy("user_id").applyInPandasWithState(update, STATE, "steps long, last_type string, last_ts long, last_id long", "update", "NoTimeout")


LIFECYCLE = "run_id long, document_id long, lifecycle string, reason string, updated_at_step long, version long"


class Lifecycle(StatefulProcessor):
    """Lifecycle of each run's documents: a map by document, kept until the run has been silent for ``silent_ms`` of event time.

    An entry holds the first extraction and the last curation that were seen, by step, so that
    the order in which events arrive doesn't matter.
    """

    def __init__(self, silent_ms: int):
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        entry = "born_step long, born string, born_reason string, moved_step long, moved string, moved_reason string, version long"
        self.documents = handle.getMapState("documents", "document_id long", entry)
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """A batch's rows are reduced to one entry a document before the state is read and written, once a document."""
        new, latest = {}, 0
        for part in rows:
            latest = max(latest, int(part["ts"].max().value // 1_000_000))
            for document, entry in self._reduced(part):
                new[document] = self._merged(new[document], entry) if document in new else entry
        self._wait(latest)
        out = []
        for document, entry in sorted(new.items()):
            entry = self._merged(self._entry(document), entry)
            self.documents.updateValue((document,), entry)
            out.append(self._row(key[0], document, entry))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LIFECYCLE.split(", ")]).astype({"updated_at_step": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The run has been silent: its state goes, nothing more is said."""
        self.documents.clear()
        self.until.clear()
        yield from ()

    def close(self) -> None:
        pass

    @staticmethod
    def _reduced(part: pd.DataFrame) -> Iterator[tuple[int, tuple]]:
        """(document, entry) of one portion of rows; of several rows of one step the first counts."""
        born = part[part["event"].isin(("evidence", "failure"))].sort_values("step", kind="stable").drop_duplicates("document_id")
        moved = part[part["event"].isin(("shelve", "reactivate"))].sort_values("step", ascending=False, kind="stable").drop_duplicates("document_id")
        first = {
            int(r.document_id): (int(r.step), "active" if r.event == "evidence" and r.n_evidence > 0 else "unusable", r.reason) for r in born.itertuples()
        }
        last = {int(r.document_id): (int(r.step), "shelved" if r.event == "shelve" else "active", r.reason) for r in moved.itertuples()}
        none = (None, None, None)
        for document, n in part["document_id"].value_counts().items():
            yield int(document), (*first.get(int(document), none), *last.get(int(document), none), int(n))

    @staticmethod
    def _merged(old: tuple, new: tuple) -> tuple:
        """The earliest extraction and the latest curation of two entries, the older one where they are of one step."""
        born = new[:3] if new[0] is not None and (old[0] is None or new[0] < old[0]) else old[:3]
        moved = new[3:6] if new[3] is not None and (old[3] is None or new[3] > old[3]) else old[3:6]
        return (*born, *moved, old[6] + new[6])

    def _entry(self, document_id: int) -> tuple:
        at = (document_id,)
        return tuple(self.documents.getValue(at)) if self.documents.containsKey(at) else (None, None, None, None, None, None, 0)

    def _wait(self, latest: int) -> None:
        old = self.until.get()[0] if self.until.exists() else None
        new = latest + self.silent_ms
        if old is None or new > old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)
            self.until.update((new,))

    @staticmethod
    def _row(run, document_id: int, entry: tuple) -> tuple:
        born_step, born, born_reason, moved_step, moved, moved_reason, version = entry
        if moved is not None and born == "active":
            return run, document_id, moved, moved_reason, moved_step, version
        return run, document_id, born, born_reason, born_step, version


def lifecycle(outcomes: DataFrame, late: str = "1 day", silent_ms: int = 7 * 86_400_000) -> DataFrame:
    """Changes of ``operators.research.lifecycle`` from a stream of (run_id, document_id, step, event, n_evidence, reason, ts).

    One row for each document that a batch touches; the row of the highest ``version`` holds.
    Needs the RocksDB state store (``rocksdb``).
    """
    timed = outcomes.withWatermark("ts", late)
    return timed.groupBy("run_id").transformWithStateInPandas(Lifecycle(silent_ms), LIFECYCLE, "Update", "EventTime")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, old)


def drain(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all that is there now; the rows it gave, read back from a new folder of that name below ``spark.checkpoint.dir``.

    In complete mode each batch replaces the one before it.  The rows never pass through the driver.
    """
    spark = stream.sparkSession
    out = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{0 if mode == 'complete' else batch_id}")

    writer = stream.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    try:
        return spark.read.schema(stream.schema).parquet(f"{out}/*")
    except AnalysisException as e:  # no batch was run
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], stream.schema)
