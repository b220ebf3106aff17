"""BM25, exact cosine and reciprocal-rank-fusion search over tables.

Tokens are lower-cased runs of letters and digits, without stemming; k1 = 1.2, b = 0.75,
idf = ln(1 + (N - df + 0.5) / (df + 0.5)); ranks are 1-based.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

K1, B, RRF_K = 1.2, 0.75, 60
#: Partitions of a written index over which one term's postings are dealt.
SPLIT = 16


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def term_counts(text: Column) -> Column:
    """Struct of a text's length in tokens, its terms in order, and how often each occurs, counted inside the row.

    The tokens are sorted; a term's count is the distance of its first place from that of the next term.
    """

    def counted(w: Column) -> Column:
        first = F.array_compact(F.transform(w, lambda x, i: F.when((i == 0) | (x != F.get(w, i - 1)), i)))
        tfs = _let(first, lambda f: F.transform(f, lambda a, i: F.coalesce(F.get(f, i + 1), F.size(w)) - a))
        return F.struct(F.size(w).alias("length"), F.array_distinct(w).alias("terms"), tfs.alias("tfs"))

    return _let(F.sort_array(tokens(text)), counted)


def validate(query: str, limit: int) -> None:
    if not query.strip():
        raise ValueError("query must not be blank")
    if limit <= 0:
        raise ValueError("limit must be positive")


def _top(scored: DataFrame, key: str, limit: int) -> DataFrame:
    """The best by score; sums in another order may differ in their last digits, so twelve count, and six are shown."""
    return scored.orderBy(F.desc(F.round("score", 12)), key).limit(limit).select(key, F.round("score", 6).alias("score"))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length): the inverted index as a table."""
    t = docs.select(key, tokens(F.col(text)).alias("t"))
    return t.select(key, F.size("t").alias("length"), F.explode("t").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Top ``limit`` (key, score): one scan, one row per document, no explosion of terms.

    Term frequencies are counted inside the row, corpus statistics are one aggregate row
    (a count per query term), and the top-k is a bounded heap per partition.
    """
    validate(query, limit)
    spark = docs.sparkSession
    terms = sorted({r for r in spark.range(1).select(F.explode(tokens(F.lit(query))).alias("t")).toPandas()["t"]})
    t = F.transform(
        F.array(tokens(F.col(text))),
        lambda w: F.struct(F.size(w).alias("n"), *(F.size(F.filter(w, _equals(term))).alias(f"tf{i}") for i, term in enumerate(terms)))
    )[0]
    counted = docs.select(key, t.alias("c")).select(key, "c.*")
    stats = counted.agg(F.count("*").alias("corpus"), F.avg("n").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))

    def part(i: int) -> Column:
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("corpus") - df + 0.5) / (df + 0.5))
        return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / F.col("avgdl")))).otherwise(F.lit(0.0))

    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    hit = reduce(lambda a, b: a | b, (F.col(f"tf{i}") > 0 for i in range(len(terms))))
    scored = counted.filter(hit).crossJoin(F.broadcast(stats))  # stats is one row
    return _top(scored.select(key, reduce(lambda a, b: a + b, map(part, range(len(terms)))).alias("score")), key, limit)


def _equals(term: str):
    return lambda t: t == term


def cosine(v: Column, q: Column) -> Column:
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot(v, q) / (F.sqrt(dot(v, v)) * F.sqrt(dot(q, q)))


def vector(chunks: DataFrame, query: list[float], limit: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Exact scan: top ``limit`` (key, score) by cosine, 1 - distance."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    q = F.array(*(F.lit(float(x)) for x in query))
    return _top(chunks.select(key, cosine(F.col(column), q).alias("score")), key, limit)


def rrf(legs: list[DataFrame], limit: int, key: str = "doc_id", k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over ranked legs (key, score), each of them a top-k list."""
    ranked = [leg.select(key, F.row_number().over(W.orderBy(F.desc("score"), key)).alias("rank")) for leg in legs]  # a top-k list
    fused = reduce(DataFrame.unionByName, ranked).groupBy(key).agg(F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("s"))
    return _top(fused.select(key, F.col("s").alias("score")), key, limit)


def reuse_plan(chunks: DataFrame, index: DataFrame, by_text: bool = True) -> DataFrame:
    """Chunks with the reusable vector of the old index, null where it must be embedded.

    The key is (id, content_hash), with the hash of the chunk's own text unless
    ``by_text`` is off.
    """
    keys = ["id", "content_hash", *(["chunk_hash"] if by_text else [])]
    return chunks.join(index.select(*keys, "vector").dropDuplicates(keys), keys, "left")


def current_hits(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Of a top-k list of ranked hits those whose document is active, of the same source and hash; first per URL, ranked anew."""
    docs = documents.filter("status = 'active'").select(F.col("id").alias("document_id"), "source_id", "content_hash", "canonical_url")
    joined = hits.join(docs, ["document_id", "source_id", "content_hash"])
    first = joined.withColumn("nth", F.row_number().over(W.partitionBy("canonical_url").orderBy("rank"))).filter("nth = 1").drop("nth")
    return first.withColumn("rank", F.row_number().over(W.orderBy("rank")))  # a top-k list


def write_postings(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> None:
    """Inverted index below ``path``: postings in order of (term, key), and corpus statistics.

    Terms are counted inside each document's row, and a row for each of them is exchanged once,
    without a sample of the input; a frequent term's postings are dealt over ``SPLIT`` partitions.
    The order lets a query's term filter skip row groups.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lengths = docs.select(F.size(tokens(F.col(text))).alias("n"))
    lengths.agg(F.count("*").alias("corpus"), F.avg("n").alias("avgdl")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    counted = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), term_counts(F.col(text)).alias("c")).select("key", "c.*")
    made = counted.select("key", "length", F.explode(F.arrays_zip("terms", "tfs")).alias("i")).select(F.col("i.terms").alias("term"), "key", F.col("i.tfs").cast("long").alias("tf"), "length")
    dealt = made.repartition(n, "term", F.pmod(F.xxhash64("key"), F.lit(SPLIT)))
    dealt.sortWithinPartitions("term", "key").write.mode("overwrite").parquet(f"{path}/postings")


def bm25_indexed(spark, path: str, query: str, limit: int, key: str = "doc_id") -> DataFrame:
    """The result of ``bm25`` from a written index: only the query terms' postings are read."""
    validate(query, limit)
    terms = sorted({r[0] for r in spark.range(1).select(F.explode(tokens(F.lit(query)))).collect()})
    found = spark.read.parquet(f"{path}/postings").filter(F.col("term").isin(terms))
    df = found.groupBy("term").agg(F.count("*").alias("df"))  # as many rows as the query has terms
    stats = spark.read.parquet(f"{path}/stats")
    idf = F.log(1 + (F.col("corpus") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))
    scored = found.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # stats is one row
    return _top(scored.groupBy(F.col("key").alias(key)).agg(F.sum(part).alias("score")), key, limit)
