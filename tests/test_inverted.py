"""The written index against a scan of the texts as they stand."""

import pytest
from pyspark.sql import functions as F

from lodestral.operators import inverted, search


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def scan(df):
    return rows(search.postings(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text").select("doc_id", "term", F.col("tf").cast("int"), "length"))


@pytest.fixture(scope="module")
def states(spark, data):
    """Three states of one table: some documents are changed, some go and come back, some are new."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    i = F.col("doc_id")
    first = docs.filter(i % 5 != 0)
    second = docs.filter(i % 7 != 0).withColumn("text", F.when(i % 3 == 0, F.concat("text", F.lit(" altered the text"))).otherwise(F.col("text")))
    third = docs.withColumn("text", F.when(i % 4 == 0, F.lit(None)).otherwise(F.col("text")))
    return [s.cache() for s in (first, second, third)]


def test_changes(spark, states, tmp_path):
    """After each state the index is that of a rebuild; a repeated run writes nothing; a merged one is the same."""
    path, query = str(tmp_path / "index"), "the of altered"
    for k, state in enumerate(states, 1):
        assert inverted.add(state, path, complete=True)["batch"] == k
        again = inverted.add(state, path, complete=True)
        assert again == {"batch": k, "new": 0, "changed": 0, "removed": 0}
        assert rows(inverted.postings(spark, path)) == scan(state)
        whole = state.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        assert rows(inverted.bm25(spark, path, query, 10)) == rows(search.bm25(whole, query, 10))
    rebuilt, merged = str(tmp_path / "rebuilt"), str(tmp_path / "merged")
    inverted.add(states[-1], rebuilt)
    inverted.merge(spark, path, merged)
    for table, columns in (("terms", ["term", "df"]), ("statistics", ["corpus", "tokens"]), ("documents", ["key", "content_hash", "length"])):
        read = [rows(spark.read.parquet(f"{p}/{table}").select(columns)) for p in (rebuilt, merged)]
        assert read[0] == read[1]
    assert rows(inverted.postings(spark, merged)) == rows(inverted.postings(spark, rebuilt))
    assert rows(inverted.bm25(spark, merged, query, 25)) == rows(inverted.bm25(spark, path, query, 25))


def test_only_changes_are_split(spark, states, tmp_path):
    path = str(tmp_path / "index")
    inverted.add(states[0], path)
    one = states[0].limit(1).withColumn("text", F.lit("one new text"))
    assert inverted.add(one, path) == {"batch": 2, "new": 0, "changed": 1, "removed": 0}
    assert spark.read.parquet(f"{path}/documents").filter("batch = 2").count() == 1
    assert spark.read.parquet(f"{path}/postings").filter("batch = 2").count() == 3


def test_broken_run(spark, states, tmp_path):
    """A batch without its documents doesn't count, and is written anew."""
    path = str(tmp_path / "index")
    inverted.add(states[0], path)
    inverted._write(spark.createDataFrame([("the", "0-0", [1], [1], [1], 1, 1)], "term string, area string, keys array<bigint>, tfs array<int>, lengths array<int>, most int, least int"), path, "postings", 2)
    inverted._write(spark.createDataFrame([(9, 9)], "corpus long, tokens long"), path, "statistics", 2)
    assert rows(inverted.postings(spark, path)) == scan(states[0])
    inverted.add(states[1], path, complete=True)
    assert rows(inverted.postings(spark, path)) == scan(states[1])


def test_blocks_are_skipped(spark, tmp_path, monkeypatch):
    """Short documents about the term outrank the rest, whose blocks stay closed."""
    monkeypatch.setattr(inverted, "AREA", 50)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20, F.concat(F.lit("salt salt "), "id")).otherwise(F.concat(F.lit("salt "), F.repeat(F.lit("water "), 40), "id")).alias("text"))
    path = str(tmp_path / "index")
    inverted.add(docs, path)
    found = inverted.Search(spark, path, "salt", 10)
    assert rows(found.top) == rows(search.bm25(docs, "salt", 10))
    assert found.read < found.blocks / 4
    assert inverted.Search(spark, path, "absent", 10).top.collect() == []


def test_odd_rows(spark, tmp_path):
    """Null keys are left out; of rows with one key one counts; texts may be null or empty."""
    path = str(tmp_path / "index")
    df = spark.createDataFrame([(None, "a"), (1, "b c"), (1, "b c"), (2, None), (3, "")], "doc_id int, text string")
    assert inverted.add(df, path) == {"batch": 1, "new": 3, "changed": 0, "removed": 0}
    assert rows(inverted.postings(spark, path)) == [(1, "b", 1, 2), (1, "c", 1, 2)]
    empty = str(tmp_path / "empty")
    assert inverted.add(df.limit(0), empty)["batch"] == 0


def test_areas_hold_alike_documents(spark, tmp_path, monkeypatch):
    """A class of length is dealt to as many areas as its own documents fill, so blocks are few and full."""
    monkeypatch.setattr(inverted, "AREA", 50)
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 40, F.lit("salt")).otherwise(F.concat(F.lit("salt "), F.repeat(F.lit("water "), 40))).alias("text"))
    inverted.add(docs, str(tmp_path / "index"))
    blocks = spark.read.parquet(str(tmp_path / "index/postings")).filter("term = 'salt'")
    assert blocks.count() == 1 + 960 // 50 and blocks.agg(F.sum(F.size("keys"))).first()[0] == 1000


def test_postings_by_document(spark, states, tmp_path):
    """Void versions are left out by document: neither blocks nor a row for each posting are joined."""
    path = str(tmp_path / "index")
    inverted.add(states[0], path)
    found = inverted.postings(spark, path)
    assert all("/contents/" in f or "/replaced/" in f for f in found.inputFiles())


def test_broken_run_leaves_nothing(spark, states, tmp_path):
    """What a broken run wrote is gone even where its repetition has no rows for that table."""
    path = str(tmp_path / "index")
    inverted.add(states[0], path)
    inverted._write(spark.createDataFrame([("zzz", "0-0", [1], [1], [1], 1, 1)], "term string, area string, keys array<bigint>, tfs array<int>, lengths array<int>, most int, least int"), path, "postings", 2)
    fewer = states[0].filter("doc_id % 5 <> 1")
    assert inverted.add(fewer, path, complete=True)["new"] == 0
    assert spark.read.parquet(f"{path}/postings").filter("term = 'zzz'").count() == 0 and inverted.Search(spark, path, "zzz", 5).top.count() == 0
    assert rows(inverted.postings(spark, path)) == scan(fewer)
