"""Jobs over growing copies of the tables, broken and repeated runs, and the command lines."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import index_documents, ingest_pages
from lodestral.functions import urls
from lodestral.operators import search
from lodestral.sources import html

ROOT = Path(__file__).resolve().parents[1]
COLUMNS = ["canonical_url", "page_id", "content_hash", "url", "publisher", "title", "published_at", "n_chars", "error", "text"]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def page(k, word, tail=""):
    return (k, f"https://www.Site{k % 3}.test/p/{k % 5}{tail}", f"<title>T{word}</title><main><p>said {word}</p></main>")


@pytest.fixture()
def places(tmp_path):
    return [str(tmp_path / name) for name in ("pages", "out", "checkpoint")]


def add(spark, where, pages):
    spark.createDataFrame(pages, ingest_pages.INPUT).coalesce(1).write.mode("append").parquet(where)


def test_ingest_grows(spark, places):
    """Only new files are read; unchanged pages keep no text; late pages don't replace newer ones."""
    pages, out, _ = places
    add(spark, pages, [page(k, "a") for k in range(5)])
    first = ingest_pages.run(spark, *places)
    assert first.count() == 5 and {r["text"] for r in first.collect()} == {"said a"}
    again = ingest_pages.run(spark, *places)
    assert rows(again, *COLUMNS) == rows(first, *COLUMNS) and ingest_pages.versions(spark, out).count() == 5
    # 15: the URL of 0 unchanged; 16: that of 1 changed; 20: a new URL; -14: an old page of the URL of 1
    add(spark, pages, [page(15, "a", "/?utm_source=x"), page(16, "b"), (20, "https://new.test/", "<p>hello</p>"), page(-14, "c"), (21, "mailto:x", "<p>x</p>"), (22, "https://none.test/", None)])
    found = {r["canonical_url"]: r for r in ingest_pages.run(spark, *places).collect()}
    stored = {r["page_id"]: r for r in ingest_pages.versions(spark, out).collect()}
    assert {k: stored[k]["change"] for k in (15, 16, 20, 21, -14)} == {15: "unchanged", 16: "changed", 20: "new", 21: "invalid", -14: "changed"}
    assert stored[15]["text"] is None and found["https://www.site0.test/p/0"]["page_id"] == 15 and found["https://www.site0.test/p/0"]["text"] == "said a"
    assert found["https://www.site1.test/p/1"]["text"] == "said b" and found["https://new.test/"]["publisher"] == "new.test"
    assert found["https://none.test/"]["error"] == "no_extractable_text" and len(found) == 7


def test_ingest_in_any_portions(spark, data, tmp_path):
    """The current pages are those of one run over everything, however the input arrives."""
    table = spark.read.parquet(f"{data}/pages.parquet")
    twice = table.union(table.select(F.col("page_id") + 1000, "url", F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise("<p>other</p>")))
    results = []
    for name, portions in (("one", 1), ("three", 3)):
        pages, out, checkpoint = (str(tmp_path / name / x) for x in ("pages", "out", "checkpoint"))
        for k in range(portions):
            twice.filter(F.pmod(F.xxhash64("page_id"), F.lit(portions)) == k).coalesce(1).write.mode("append").parquet(pages)
            found = ingest_pages.run(spark, pages, out, checkpoint, max_files=1)
        results.append(rows(found, *COLUMNS))
    assert results[0] == results[1] and len(results[0]) == table.select(urls.normalize(F.col("url"), urls.TRACKING_KEYS)).distinct().count()


def test_ingest_broken_run(spark, places, monkeypatch):
    """A batch that failed after it was written is repeated into the same rows."""
    pages, out, _ = places
    add(spark, pages, [page(k, "a") for k in range(4)])
    ingest_pages.run(spark, *places)
    add(spark, pages, [page(k, "b") for k in range(5, 9)])
    real = ingest_pages.LOG.info
    monkeypatch.setattr(ingest_pages.LOG, "info", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        ingest_pages.run(spark, *places)
    wrote = rows(ingest_pages.versions(spark, out))
    monkeypatch.setattr(ingest_pages.LOG, "info", real)
    ingest_pages.run(spark, *places)
    assert rows(ingest_pages.versions(spark, out)) == wrote and len(wrote) == 8


def test_ingest_texts(spark, data, places):
    """Texts are those of the library's parser; a single file is read too."""
    found = ingest_pages.run(spark, f"{data}/pages.parquet", *places[1:])
    own = spark.read.parquet(f"{data}/pages.parquet").select("page_id", F.lit("text/html").alias("media_type"), F.encode("html", "UTF-8").alias("content"))
    assert set(rows(found, "page_id", "title", "text")) <= set(rows(html.parse_documents(own, "page_id"), "page_id", "title", "text"))


def scan(df):
    return rows(search.postings(df, "doc_id", "text").select("doc_id", "term", F.col("tf").cast("int"), "length"))


def test_index_grows(spark, data, tmp_path):
    """The table is replaced by newer states; the index follows, and is searched and merged."""
    table, out, merged = (str(tmp_path / x) for x in ("documents", "index", "merged"))
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    i = F.col("doc_id")
    docs.filter(i < 120).write.parquet(table)
    assert rows(index_documents.run(spark, table, out)) == scan(docs.filter(i < 120))
    later = docs.filter(i != 3).withColumn("text", F.when(i == 5, F.lit("quite new words")).otherwise(F.col("text")))
    later.write.mode("overwrite").parquet(table)
    assert rows(index_documents.run(spark, table, out)) == scan(later)
    assert rows(index_documents.run(spark, table, out, merge_to=merged)) == scan(later)
    batch = spark.read.parquet(f"{out}/documents").groupBy("batch").count()
    assert dict(rows(batch)) == {1: 120, 2: docs.count() - 120 + 2}
    for where in (out, merged):
        assert rows(index_documents.search(spark, where, "the of quite", 8)) == rows(search.bm25(later, "the of quite", 8))


def test_nothing_there(spark, tmp_path):
    """Empty inputs make empty outputs, before and after there is something."""
    pages, out, checkpoint, table, index = (str(tmp_path / x) for x in ("pages", "out", "checkpoint", "documents", "index"))
    spark.createDataFrame([], ingest_pages.INPUT).write.parquet(pages)
    assert ingest_pages.run(spark, pages, out, checkpoint).collect() == []
    for rows_, n in (([], 0), ([(1, "one two")], 2), ([], 0)):
        spark.createDataFrame(rows_, "doc_id long, text string").write.mode("overwrite").parquet(table)
        found = index_documents.run(spark, table, index)
        assert found.count() == n and found.schema["doc_id"].dataType.simpleString() == "bigint"
        assert index_documents.search(spark, index, "one", 3).count() == n // 2


def test_command_lines(spark, data, tmp_path):
    """Both jobs from a shell, each twice, with their config files."""
    env = os.environ | {"PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}", "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    config = tmp_path / "config.json"
    config.write_text(json.dumps(json.loads((ROOT / "jobs/ingest_pages.json").read_text()) | {"buckets": 2}))
    out, index = str(tmp_path / "out"), str(tmp_path / "index")
    ingest = [sys.executable, "-m", "jobs.ingest_pages", f"{data}/pages.parquet", out, str(tmp_path / "checkpoint"), "--config", str(config)]
    told = [subprocess.run(ingest, env=env, cwd=ROOT, capture_output=True, text=True, timeout=240, check=True).stderr for _ in range(2)]
    n = spark.read.parquet(f"{data}/pages.parquet").count()
    assert f"read {n} rows" in told[0] and "read 0 rows" in told[1] and ingest_pages.versions(spark, out).count() == n
    told = subprocess.run([sys.executable, "-m", "jobs.index_documents", f"{data}/documents.parquet", index, "--config", str(ROOT / "jobs/index_documents.json")], env=env, cwd=ROOT, capture_output=True, text=True, timeout=240, check=True).stderr
    assert "is at batch 1" in told and spark.read.parquet(f"{index}/documents").count() == spark.read.parquet(f"{data}/documents.parquet").count()
