"""A written full-text index that takes changes, and BM25 over its blocks.

Tables below a folder, each partitioned by ``batch``:

    postings    term, area, keys, tfs, lengths, most (greatest tf), least (least length)
    terms       term, df: by how much the batch changes the number of documents with the term
    replaced    key, was: versions of documents, by key and batch, that the batch makes void
    statistics  corpus, tokens: documents and tokens after the batch
    contents    key, content_hash, length, terms, tfs: new and changed documents, from which the postings are made
    documents   key, content_hash, length, removed: written last, so it tells which batches are whole

Only documents whose content hash is new are split into tokens, and their terms are counted
inside the row: what is exchanged is a row a document, never one a token.  A batch that is repeated
after a failure compares with the batches before it and writes the same partitions again.

A batch's documents are dealt to areas of about ``AREA`` documents of similar length; a
block holds the postings of one term in one area.  ``bm25`` first scores the areas with the
highest bounds, and then reads the blocks of those areas alone whose bound reaches the
score of the last hit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestral.functions.session import checkpoint
from lodestral.functions.values import content_hash
from lodestral.operators.search import B, K1, _top, term_counts, tokens, validate

BLOCK = "term string, area string, keys array<{key}>, tfs array<int>, lengths array<int>, most int, least int"
AREA = 4096
#: Tokens of an area, at most about so many: one area is made into blocks at once.
AREA_TOKENS = 2_000_000
#: Classes of length: two for each doubling.
CLASSES = 2


def _table(spark: SparkSession, path: str, name: str, schema: str, below: int | None = None) -> DataFrame:
    """A table's whole batches (those before ``below``); empty where nothing is written yet."""
    try:
        found = spark.read.schema(f"{schema}, batch int").parquet(f"{path}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch int")
    return found if below is None else found.filter(F.col("batch") < below)


def _documents(spark: SparkSession, path: str, key: str, below: int | None = None) -> DataFrame:
    return _table(spark, path, "documents", f"key {key}, content_hash string, length int, removed boolean", below)


def _contents(spark: SparkSession, path: str, key: str, below: int) -> DataFrame:
    return _table(spark, path, "contents", f"key {key}, content_hash string, length int, terms array<string>, tfs array<int>", below)


def batches(spark: SparkSession, path: str) -> int:
    """Number of whole batches, from the partitions of ``documents``."""
    return _table(spark, path, "documents", "removed boolean").agg(F.max("batch")).first()[0] or 0


def _latest(documents: DataFrame) -> DataFrame:
    """(key, batch, content_hash, length, removed): the newest version of each key, removed ones too."""
    version = F.struct("batch", "content_hash", "length", "removed")
    return documents.groupBy("key").agg(F.max_by(version, "batch").alias("v")).select("key", "v.*")


def _write(df: DataFrame, path: str, name: str, batch: int) -> None:
    """The batch's partition of a table, in place of what a broken run may have left there."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}/batch={batch}")


def changes(docs: DataFrame, known: DataFrame, complete: bool) -> DataFrame:
    """(key, content_hash, removed, was, old_length, rows) of new, changed and, if docs are ``complete``, missing documents.

    Only hashes are exchanged here, no texts.  ``was`` is the batch of the version that becomes
    void.  Of rows with one key that of the least hash counts.
    """
    new = docs.groupBy("key").agg(F.min("content_hash").alias("content_hash"), F.count("*").alias("rows"))
    old = _latest(known).filter("not removed").select(F.col("key").alias("old_key"), F.struct("batch", "content_hash", "length").alias("o"))
    both = new.join(old, F.col("key") == F.col("old_key"), "full_outer" if complete else "left")
    changed = F.col("o").isNull() | F.col("content_hash").isNull() | (F.col("content_hash") != F.col("o.content_hash"))
    return both.filter(changed).select(
        F.coalesce("key", "old_key").alias("key"), "content_hash", F.col("content_hash").isNull().alias("removed"), F.col("o.batch").alias("was"),
        F.col("o.length").alias("old_length"), "rows"
    )


def add(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", complete: bool = False) -> dict[str, int]:
    """Bring the index up to docs; counts of what was written.  Without changes nothing is.

    A null text is an empty one; rows without a key are left out.  Only texts of changed
    documents are joined to what has changed, which Spark broadcasts while it is small.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    batch = batches(spark, path) + 1
    known = _documents(spark, path, kind, batch)
    docs = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("content_hash", content_hash(F.col("text")))
    found = checkpoint(changes(docs, known, complete))
    counts = found.agg(
        F.count_if(~F.col("removed") & F.col("was").isNull()).alias("new"), F.count_if(~F.col("removed") & F.col("was").isNotNull()).alias("changed"), F.count_if("removed").alias("removed"),
        F.coalesce(F.sum("old_length"), F.lit(0)).alias("gone"), F.max("rows").alias("rows"),
    ).first().asDict()
    done = {"batch": batch} | {c: counts[c] for c in ("new", "changed", "removed")}
    if not sum(counts[c] for c in ("new", "changed", "removed")):
        return done | {"batch": batch - 1}
    own = ["key", "content_hash"]  # one hash for each key, and equal hashes, equal texts
    fresh = docs.join(found.filter("not removed").select(own), own)
    if (counts["rows"] or 1) > 1:
        fresh = fresh.dropDuplicates(own)
    # Read several times below, tokenised once.
    _write(fresh.select(*own, term_counts(F.col("text")).alias("c")).select(*own, "c.*"), path, "contents", batch)
    now = _contents(spark, path, kind, batch + 1).filter(F.col("batch") == batch)
    added = now.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    _write(_blocks(now), path, "postings", batch)
    void = found.filter("was is not null").select("key", "was")
    words = _contents(spark, path, kind, batch).select("key", "batch", F.array_join("terms", " ").alias("words")).filter("words <> ''")  # shorter rows to exchange
    old = _void(words, void, "left_semi").select(F.explode(F.split("words", " ")).alias("term"), F.lit(-1).alias("df"))
    plus = _postings(spark, path, kind, batch + 1).filter(F.col("batch") == batch).select("term", F.size("keys").alias("df"))
    _write(plus.union(old).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0").sortWithinPartitions("term"), path, "terms", batch)
    _write(void, path, "replaced", batch)
    last = _statistics(spark, path, batch).agg(F.coalesce(F.max_by("corpus", "batch"), F.lit(0)).alias("corpus"), F.coalesce(F.max_by("tokens", "batch"), F.lit(0)).alias("tokens"))
    after = last.select((F.col("corpus") + counts["new"] - counts["removed"]).alias("corpus"), (F.col("tokens") + added - counts["gone"]).alias("tokens"))
    _write(after, path, "statistics", batch)
    missing = found.filter("removed").select("key", F.lit(None).cast("string").alias("content_hash"), F.lit(0).alias("length"), F.lit(True).alias("removed"))
    _write(now.select(*own, "length", F.lit(False).alias("removed")).union(missing), path, "documents", batch)
    return done


def _statistics(spark: SparkSession, path: str, below: int) -> DataFrame:
    return _table(spark, path, "statistics", "corpus long, tokens long", below)


def _blocks(contents: DataFrame) -> DataFrame:
    """Blocks of (key, length, terms, tfs), ordered by term inside each file so that a term's rows lie in few row groups.

    Documents are exchanged once, by area; an area's bounded number of them becomes blocks in one step.
    """
    found = contents.filter("length > 0").withColumn("class", F.floor(F.log2(F.col("length") + 1) * CLASSES))
    sizes = found.groupBy("class").agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).collect()  # a row for each class of length
    dealt = F.create_map(*(F.lit(x) for r in sizes for x in (r["class"], max(1, r["n"] // AREA, r["tokens"] // AREA_TOKENS)))) if sizes else F.create_map(F.lit(0), F.lit(1))
    area = F.concat_ws("-", "class", F.pmod(F.xxhash64("key"), dealt[F.col("class")]))
    rows = found.select(area.alias("area"), "key", "length", F.array_join("terms", " ").alias("words"), "tfs")
    kind = contents.schema["key"].dataType.simpleString()
    return rows.groupBy("area").applyInArrow(_area_blocks, BLOCK.format(key=kind)).sortWithinPartitions("term", "area")


def _area_blocks(area: pa.Table) -> pa.Table:
    """The documents of one area as a row for each term, its documents in order of their keys."""
    area = area.sort_by("key").combine_chunks()
    words, tfs = (c.combine_chunks() for c in (pc.split_pattern(area["words"], " "), area["tfs"]))
    coded = words.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    term = rank[coded.indices.to_numpy()]
    by = np.argsort(term, kind="stable")
    doc = np.repeat(np.arange(area.num_rows), pc.list_value_length(words).to_numpy())[by]
    starts = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(order)))))
    tf, length = tfs.flatten().to_numpy()[by], area["length"].to_numpy()[doc]
    lists = lambda values: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values)
    keys = area["key"].combine_chunks().take(pa.array(doc))
    return pa.table({
        "term": coded.dictionary.take(order), "area": pa.repeat(area["area"][0], len(order)), "keys": lists(keys), "tfs": lists(pa.array(tf, pa.int32())), "lengths": lists(pa.array(length, pa.int32())),
        "most": pa.array(np.maximum.reduceat(tf, starts[:-1]), pa.int32()), "least": pa.array(np.minimum.reduceat(length, starts[:-1]), pa.int32()),
    })


def _postings(spark: SparkSession, path: str, key: str, below: int) -> DataFrame:
    return _table(spark, path, "postings", BLOCK.format(key=key), below)


def _valid(blocks: DataFrame, replaced: DataFrame) -> DataFrame:
    """(key, term, tf, length, area, batch) of blocks, without void versions."""
    item = F.explode(F.arrays_zip("keys", "tfs", "lengths")).alias("i")
    each = blocks.select("term", "area", "batch", item).select(
        F.col("i.keys").alias("key"), "term", F.col("i.tfs").alias("tf"), F.col("i.lengths").alias("length"), "area", "batch"
    )
    return _void(each, replaced, "left_anti")


def _void(versions: DataFrame, replaced: DataFrame, how: str) -> DataFrame:
    """Of rows with key and batch those of void versions (``left_semi``), or those of all others (``left_anti``)."""
    void = replaced.select(F.col("key").alias("void"), "was")
    return versions.join(void, (F.col("key") == F.col("void")) & (F.col("batch") == F.col("was")), how)


def _replaced(spark: SparkSession, path: str, key: str, below: int) -> DataFrame:
    return _table(spark, path, "replaced", f"key {key}, was int", below)


def key_type(spark: SparkSession, path: str) -> str:
    """Type of the keys; string where nothing is written yet."""
    try:
        return spark.read.parquet(f"{path}/documents").schema["key"].dataType.simpleString()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return "string"


def postings(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(key, term, tf, length) of all documents as they stand; ``kind`` is the keys' type where nothing may be written yet."""
    kind, below = kind or key_type(spark, path), batches(spark, path) + 1
    each = _live(spark, path, kind, below).select("key", "length", F.explode(F.arrays_zip("terms", "tfs")).alias("i"))
    return each.select("key", F.col("i.terms").alias("term"), F.col("i.tfs").alias("tf"), "length")


def _live(spark: SparkSession, path: str, kind: str, below: int) -> DataFrame:
    """(key, content_hash, length, terms, tfs, batch) of the documents as they stand: void versions go by document, not by posting."""
    return _void(_contents(spark, path, kind, below), _replaced(spark, path, kind, below), "left_anti")


def merge(spark: SparkSession, path: str, to: str) -> None:
    """The same index as one batch of a new folder, from the counted terms alone; no text is read."""
    kind, below = key_type(spark, path), batches(spark, path) + 1
    _write(_live(spark, path, kind, below).drop("batch"), to, "contents", 1)
    live = _contents(spark, to, kind, 2)
    facts = live.agg(F.count("*").alias("corpus"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"))
    _write(_blocks(live), to, "postings", 1)
    df = _postings(spark, to, kind, 2).groupBy("term").agg(F.sum(F.size("keys")).alias("df"))
    _write(df.sortWithinPartitions("term"), to, "terms", 1)
    _write(_replaced(spark, path, kind, below).select("key", "was").limit(0), to, "replaced", 1)
    _write(facts, to, "statistics", 1)
    _write(live.select("key", "content_hash", "length", F.lit(False).alias("removed")), to, "documents", 1)


def _part(tf: Column, length: Column) -> Column:
    return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("avgdl")))


class Search:
    """One query: ``top`` has the hits, ``blocks`` how many blocks its terms have, ``read`` how many were opened."""

    def __init__(self, spark: SparkSession, path: str, query: str, limit: int, key: str = "doc_id"):
        validate(query, limit)
        kind, below = key_type(spark, path), batches(spark, path) + 1
        words = [r[0] for r in spark.range(1).select(F.explode(F.array_distinct(tokens(F.lit(query))))).collect()]
        asked = F.col("term").isin(words)
        blocks = _postings(spark, path, kind, below).filter(asked)
        df = _table(spark, path, "terms", "term string, df long", below).filter(asked).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        facts = _statistics(spark, path, below).agg(F.max_by("corpus", "batch").alias("corpus"), F.max_by("tokens", "batch").alias("tokens"))
        # A row for each word of the query.
        weights = df.crossJoin(F.broadcast(facts)).select(
            "term", F.log(1 + (F.col("corpus") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), (F.col("tokens") / F.col("corpus")).alias("avgdl")
        )
        rows = [tuple(r) for r in weights.collect()]
        weights = spark.createDataFrame(rows, "term string, idf double, avgdl double")
        void = _replaced(spark, path, kind, below)
        bounds = blocks.select("term", "area", "batch", F.size("keys").alias("n"), "most", "least").join(F.broadcast(weights), "term")
        areas = bounds.groupBy("batch", "area").agg(F.sum(_part(F.col("most"), F.col("least"))).alias("bound"), F.count("*").alias("k"))
        self.blocks = areas.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]

        def scores(some: DataFrame) -> DataFrame:
            own = some.select(F.col("batch").alias("b"), F.col("area").alias("a"))
            chosen = blocks.join(own, (F.col("batch") == F.col("b")) & (F.col("area") == F.col("a")), "left_semi")
            return _valid(chosen, void).join(F.broadcast(weights), "term").groupBy(F.col("key").alias(key)).agg(F.sum(_part(F.col("tf"), F.col("length"))).alias("score"))

        first = areas.orderBy(F.desc("bound"), "batch", "area").limit(limit)
        least = [r[0] for r in scores(first).orderBy(F.desc("score")).limit(limit).select("score").collect()]
        # Bounds and scores are sums in different orders.
        enough = least[-1] * (1 - 1e-9) if len(least) == limit else 0.0
        rest = areas.filter(F.col("bound") >= enough)
        self.read = rest.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
        self.top = _top(scores(rest), key, limit)


def bm25(spark: SparkSession, path: str, query: str, limit: int, key: str = "doc_id") -> DataFrame:
    """Top ``limit`` (key, score): those of a scan of all texts as they stand."""
    return Search(spark, path, query, limit, key).top
