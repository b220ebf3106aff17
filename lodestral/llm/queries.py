"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestral.llm import alignment, bpe, decontam, licenses, pagediff, pll, shared, simhash, substring, suffix_dedup, token_store, toxicity, webp


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared.spread(table(spark, sf_dir, "documents"))


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = shared.folder(spark, "token-store")
    token_store.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), to, end=2)
    return token_store.read(spark, to)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe.round_trip(table(spark, sf_dir, "documents"), ranks, pattern)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.dedup(documents(spark, sf_dir))
    return kept.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2("__kept", 256).alias("kept_sha256"))


def op4_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.load(webp.store(documents(spark, sf_dir)))


def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pll.score(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.extract(table(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontam.annotate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs.filter(~toxicity.held_out()), labels.filter(~toxicity.held_out()))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"), F.col("__n_sentences").alias("n_sentences"), F.col("__n_offending").alias("n_offending"), F.col("__worst").alias("worst_sentence"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.cross(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.dedup(documents(spark, sf_dir))
    return kept.select("doc_id", F.col("__n_bytes").alias("n_bytes"), F.col("__n_removed").alias("n_removed"), F.col("__n_spans").alias("n_spans"), F.sha2("__kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM g),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM f WHERE n > 1),
p AS (SELECT doc_id, w[j] AS word, j FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
a AS (SELECT p.doc_id, count(r.j) AS n_removed, string_agg(word, ' ' ORDER BY p.j) FILTER (WHERE r.j IS NULL) AS kept FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.j = r.j GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""

#: The article's blocks by patterns; enough for pages built like the test tables'.
OP7_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_split_to_array(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?b>', '', 'g'), '</?(?:h1|p)>') AS parts FROM a),
c AS (SELECT page_id, url, list_filter(list_transform(parts, lambda p: trim(regexp_replace(replace(replace(replace(replace(replace(p, '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda p: p <> '') AS parts FROM b)
SELECT page_id, url, array_to_string(parts, chr(10) || chr(10)) AS text, CAST(length(array_to_string(parts, chr(10) || chr(10))) AS BIGINT) AS n_chars FROM c
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS gram
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM g),
o AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT o.doc_id, o.i, o.n, g.item FROM o JOIN g ON o.gram = g.gram AND o.n = g.n),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
""".replace("\\\\", "\\")

#: Windows are told apart by their MD5; positions count bytes, two hexadecimal digits each.
OP12_SQL = """
WITH d AS (SELECT doc_id, x, length(x) // 2 AS n FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents)),
g AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM g) WHERE r > 1),
p AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS first FROM f),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM p) GROUP BY doc_id, span),
l AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS la, list(b ORDER BY a) AS lb FROM s GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN la IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(la) + 1), lambda j: substr(x, 2 * coalesce(lb[j], 0) + 1, 2 * (coalesce(la[j + 1], n) - coalesce(lb[j], 0)))), '') END)) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)
"""


QUERIES = {"op1_token_store": op1_token_store, "op2_substring_dedup": op2_substring_dedup, "op3_bpe": op3_bpe, "op4_webp": op4_webp, "op5_pseudo_likelihood": op5_pseudo_likelihood, "op6_simhash": op6_simhash, "op7_pages": op7_pages, "op8_decontaminate": op8_decontaminate, "op9_toxicity": op9_toxicity, "op10_licenses": op10_licenses, "op11_alignment": op11_alignment, "op12_suffix_array": op12_suffix_array}
ORACLES: dict[str, str] = {"op2_substring_dedup": OP2_SQL, "op7_pages": OP7_SQL, "op8_decontaminate": OP8_SQL, "op10_licenses": licenses.oracle(), "op12_suffix_array": OP12_SQL}
