from pyspark.sql import functions as F

from lodestral.operators import research
from lodestral.streaming import runs


def test_first_seen(spark, tmp_path):
    spark.createDataFrame([("https://a.com/x?b=1&a=2", "2024-01-01 00:00:00"), ("https://a.com/x?a=2&b=1", "2024-01-01 00:05:00"), ("https://a.com/y", "2024-01-01 00:00:00")], "url string, at string").select("url", F.col("at").cast("timestamp").alias("seen_at")).write.parquet(str(tmp_path / "in"))
    stream = runs.read_events(spark, str(tmp_path / "in"), "url string, seen_at timestamp")
    assert runs.drain(runs.first_seen(stream), "first_seen_test").count() == 2


def test_sessions(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    stream = runs.read_events(spark, f"{data}/events.parque[t]", events.schema)
    out = runs.drain(runs.sessions(stream, late="3650 days"), "sessions_test", "complete")
    assert out.agg(F.sum("n")).first()[0] == events.count()


def test_upsert_batches(spark, tmp_path):
    rows = spark.range(6).select(
        F.lit(None).cast("string").alias("id"), F.lit("s").alias("source_id"), F.concat(F.lit("https://a.com/"), F.col("id") % 4).alias("url"), F.concat(F.lit("https://a.com/"), F.col("id") % 4).alias("canonical_url"), F.lit("active").alias("status"),
        *(F.lit(None).cast("string").alias(c) for c in ("title", "media_type", "etag", "last_modified", "content_hash", "failure_reason")), F.col("id").cast("string").alias("text"), F.lit(None).cast("timestamp").alias("published_at"),
        F.timestamp_seconds(F.col("id")).alias("fetched_at"),
    )
    for i in range(2):
        rows.filter(F.col("text").cast("int") % 2 == i).write.mode("append").parquet(str(tmp_path / "in"))
    stream = runs.read_events(spark, str(tmp_path / "in"), rows.schema, 100)
    query = runs.upsert_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = runs.upserted(spark, str(tmp_path / "out"), 0)
    assert sorted((r["canonical_url"][-1], r["text"]) for r in got.collect()) == [("0", "4"), ("1", "5"), ("2", "2"), ("3", "3")]


def test_upsert_versions(spark, tmp_path):
    """Four batches over few buckets give what one upsert after the other gives; old versions go."""
    rows = spark.range(24).select(
        F.lit(None).cast("string").alias("id"), F.lit("s").alias("source_id"), *(F.concat(F.lit("https://a.com/"), F.col("id") % 7).alias(c) for c in ("url", "canonical_url")), F.lit("active").alias("status"),
        *(F.lit(None).cast("string").alias(c) for c in ("title", "media_type", "etag", "last_modified", "content_hash", "failure_reason")), F.col("id").cast("string").alias("text"), F.lit(None).cast("timestamp").alias("published_at"),
        F.timestamp_seconds(F.col("id")).alias("fetched_at"),
    )
    parts = [rows.filter(F.col("text").cast("int").between(6 * i, 6 * i + 5)).coalesce(1) for i in range(4)]
    for part in parts:
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = runs.read_events(spark, str(tmp_path / "in"), rows.schema, 1)
    runs.upsert_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp"), buckets=3).trigger(availableNow=True).start().awaitTermination()
    got = {r["canonical_url"][-1]: (r["text"], r["created_at"].second) for r in runs.upserted(spark, str(tmp_path / "out"), 3).collect()}
    assert {k: t for k, (t, _) in got.items()} == {str(i % 7): str(i) for i in range(24)} and max(s for _, s in got.values()) <= 11
    assert sorted(p.name for p in (tmp_path / "out/manifests").iterdir()) == ["2", "3"]
    named = {tuple(r) for k in (2, 3) for r in spark.read.parquet(str(tmp_path / f"out/manifests/{k}")).collect()}
    assert {(int(b.name[7:]), int(b.parent.name[8:])) for b in (tmp_path / "out").glob("version=*/bucket=*")} == named


def _outcomes(spark, rows):
    return spark.createDataFrame(rows, "run_id long, document_id long, step long, event string, n_evidence long, reason string, at string").withColumn("ts", F.col("at").cast("timestamp")).drop("at")


def test_lifecycle_in_batches(spark, data, tmp_path):
    """Events in any order over many batches give what the batch reducer gives over all of them."""
    events = spark.read.parquet(f"{data}/events.parquet")
    kind = F.element_at(F.array(*map(F.lit, ("evidence", "failure", "shelve", "reactivate"))), (F.col("event_id") % 4 + 1).cast("int"))
    table = events.select((F.col("user_id") % 5).alias("run_id"), (F.col("event_id") % 9).alias("document_id"), (F.col("event_id") * 7919 % 10007).alias("step"), kind.alias("event"), (F.col("event_id") % 3).alias("n_evidence"), F.concat(F.lit("r"), "event_id").alias("reason"), F.col("ts").cast("timestamp").alias("ts"))
    for k in range(3):
        table.filter(F.col("step") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = runs.read_events(spark, str(tmp_path / "in"), table.schema)
    with runs.rocksdb(spark):
        out = runs.drain(runs.lifecycle(stream, "3650 days", 3650 * 86_400_000), "lifecycle_test", "update", str(tmp_path / "cp"))
    newest = out.groupBy("run_id", "document_id").agg(F.max_by(F.struct("lifecycle", "reason", "updated_at_step"), "version").alias("s")).select("run_id", "document_id", "s.*")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(newest) == rows(research.lifecycle(table)) and out.count() > newest.count()


def test_lifecycle_expires(spark, tmp_path):
    """A run that stays silent beyond its time is forgotten; one that goes on keeps its documents."""
    parts = [
        [(1, 7, 5, "evidence", 1, "a", "2024-01-01 00:00:00"), (2, 7, 5, "evidence", 1, "a", "2024-01-01 00:00:00")],
        [(2, 8, 6, "failure", 0, "b", "2024-01-01 12:00:00")],
        [(3, 1, 1, "failure", 0, "c", "2024-01-02 06:00:00")],
        [(3, 1, 2, "failure", 0, "c", "2024-01-02 06:00:00")],  # the watermark has moved on: run 1 goes
        [(1, 7, 9, "shelve", 0, "d", "2024-01-02 06:00:00"), (2, 7, 9, "shelve", 0, "d", "2024-01-02 06:00:00")],
    ]
    for part in parts:
        _outcomes(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = runs.read_events(spark, str(tmp_path / "in"), _outcomes(spark, []).schema)
    with runs.rocksdb(spark):
        out = runs.drain(runs.lifecycle(stream, "1 second", 86_400_000), "lifecycle_expires", "update", str(tmp_path / "cp"))
    last = {r["run_id"]: (r["lifecycle"], r["version"]) for r in out.filter("document_id = 7 and updated_at_step = 9 or document_id = 7 and lifecycle is null").collect()}
    assert last == {1: (None, 1), 2: ("shelved", 2)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_endpoints(spark, tmp_path):
    """A restart from the checkpoint reads nothing that is unchanged; failures are told once."""
    from lodestral.sources.fetch import TransportError
    from lodestral.streaming import endpoints

    def site(state):
        def client(request):
            tag = state.get(request["url"])
            if tag is None:
                raise TransportError("down")
            return {"status": 304} if request["if_none_match"] == tag else {"status": 200, "etag": tag, "body": tag.encode()}

        return client

    def read(state, name="endpoints_test"):
        got = []
        stream = endpoints.stream(spark, site(state), ["a", "b", "c"], name)
        keep = lambda batch, _: got.extend((r["url"], r["etag"], r["error"]) for r in batch.collect())
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted(got, key=repr)

    assert read({"a": "1", "b": "1"}) == [("a", "1", None), ("b", "1", None), ("c", None, "transport")]
    assert read({"a": "1", "b": "1"}) == []
    assert read({"a": "1", "b": "2", "c": "1"}) == [("b", "2", None), ("c", "1", None)]


def test_drain_passes_the_driver_by(spark, data, tmp_path):
    """The rows of a stream come back from files, not from a table in the driver's memory; the same name may be used again."""
    events = spark.read.parquet(f"{data}/events.parquet")
    for k in range(2):
        events.filter(F.col("event_id") % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: runs.read_events(spark, str(tmp_path / "in"), events.schema)
    for _ in range(2):
        every = runs.drain(read(), "drain_test")
        assert "LocalTableScan" not in every._jdf.queryExecution().toString() and "memory" not in every._jdf.queryExecution().toString()
        assert sorted(map(tuple, every.collect())) == sorted(map(tuple, events.collect())) and len(every.inputFiles()) == 2
    counted = runs.drain(read().groupBy("event_type").count(), "drain_test", "complete")  # of the last batch alone
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, events.groupBy("event_type").count().collect()))
    (tmp_path / "none").mkdir()
    assert runs.drain(runs.read_events(spark, str(tmp_path / "none"), events.schema), "drain_test").count() == 0


def test_lifecycle_state_once_a_document():
    """However many rows a batch has, and in however many portions, each document's state is read and written once."""
    import pandas as pd

    class Value:
        def __init__(self):
            self.v, self.calls = {}, 0

        def getValue(self, k):
            self.calls += 1
            return self.v[k]

        def containsKey(self, k):
            return k in self.v

        def updateValue(self, k, v):
            self.calls += 1
            self.v[k] = v

        def get(self):
            return self.v[0]

        def exists(self):
            return 0 in self.v

        def update(self, v):
            self.v[0] = v

    class Handle:
        def getMapState(self, *_):
            return Value()

        def getValueState(self, *_):
            return Value()

        def registerTimer(self, _):
            pass

        deleteTimer = registerTimer

    rows = pd.DataFrame({"document_id": [k % 3 for k in range(3000)], "step": [k * 7919 % 3001 for k in range(3000)], "event": [("evidence", "failure", "shelve", "reactivate")[k % 4] for k in range(3000)]})
    rows = rows.assign(n_evidence=rows["step"] % 3, reason=rows["step"].astype(str), ts=pd.Timestamp("2024-01-01"))
    keyed = runs.Lifecycle(1000)
    keyed.init(Handle())
    for batch in (rows[:2000], rows[2000:]):
        keyed.documents.calls = 0
        out = next(iter(keyed.handleInputRows((1,), iter([batch[:700], batch[700:]]), None)))
        assert keyed.documents.calls <= 6
    for r in out.itertuples():
        mine = rows[rows["document_id"] == r.document_id]
        born, moved = (mine[mine["event"].isin(e)].sort_values("step") for e in (("evidence", "failure"), ("shelve", "reactivate")))
        active = born.iloc[0]["event"] == "evidence" and born.iloc[0]["n_evidence"] > 0
        want = moved.iloc[-1] if active else born.iloc[0]
        assert (r.version, r.updated_at_step, r.reason) == (1000, want["step"], want["reason"])
        assert r.lifecycle == ({"shelve": "shelved", "reactivate": "active"}[want["event"]] if active else "unusable")
