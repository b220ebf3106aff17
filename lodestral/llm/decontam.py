"""Benchmark decontamination with a hash set of test n-grams, in DataFrame functions only.

Words are runs of digits, Latin letters (A-Z lower-cased) and all characters beyond
ASCII.  A window is ``size`` consecutive words of a benchmark item; an item of fewer
words, but at least one, is a window itself.  Each document's words are scanned once:
the hash of the first words at each position (three, or as many as a short window has)
is looked up in the set of the windows' beginnings, a set of at most ``limit`` numbers
that goes to every executor.  The few candidates are joined with the windows and so
compared in full.  A word inside any occurrence of a window is hit.

For a larger benchmark the candidates come from a join on hashes of whole windows; what
follows is the same.  Ids of items are joined last, once for each set of windows that
some document holds, so an answer that millions of items share is listed once and not in
every row of a join.

Defined cases: a null text has no words and is not contaminated; null or wordless items
have no windows, an item without an id counts as one without a name (it hits, but is not
listed); rows with the same doc_id are counted each by its own text; an empty benchmark
hits nothing; a text may be as long as a row can be; ``annotate`` reads doc_id and text
only, ``clean`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestral.llm import shared

#: What parts words, after A-Z are lower-cased: ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Normalised words of a text; null for null."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), SEPARATORS), lambda w: w != "")


def windows(benchmark: DataFrame, size: int = 13) -> DataFrame:
    """(item, gram, len): the distinct windows of each item."""
    w = F.col("w")
    n = F.size(w)
    grams = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter("size(w) > 0").select(
        "item", F.least(n, F.lit(size)).alias("len"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, size), " "))).alias("gram")
    )
    return grams.select("item", "gram", "len").distinct()


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def _head(w: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*(F.get(w, i + k) for k in range(n)))


def _occurrence(w: Column, n: int):
    """From a position to the struct of the ``n`` words there."""
    return lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), F.array_join(F.slice(w, i + 1, n), " ").alias("gram"))


def _fits(w: Column, n: int):
    return lambda i: i + n <= F.size(w)


def _begins(w: Column, n: int, hashes: list[int]):
    return lambda i: _head(w, i, n).isin(hashes)


_NONE = "cast(array() as array<struct<pos:int,len:int,gram:string>>)"


def _candidates(heads: dict[int, list[int]], lengths: list[int]) -> Column:
    """Places (pos, len, gram) among the words ``w`` of a document whose beginning is that of a window."""

    def found(w: Column) -> Column:
        lists = [F.expr(_NONE)]
        for head, hashes in sorted(heads.items()):
            starts = F.filter(F.when(F.size(w) >= head, F.sequence(F.lit(0), F.size(w) - head)), _begins(w, head, hashes))
            for n in (n for n in lengths if min(n, 3) == head):
                lists.append(F.coalesce(F.transform(F.filter(starts, _fits(w, n)), _occurrence(w, n)), F.expr(_NONE)))
        return F.concat(*lists)

    return _bound(F.col("w"), found)


def _covered(hits: Column) -> Column:
    """Number of words inside the union of hits sorted by position."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        F.array_sort(F.transform(hits, lambda h: F.struct(h["pos"].alias("pos"), (h["pos"] + h["len"]).alias("end")))),
        zero,
        lambda acc, h: F.struct((acc["n"] + F.greatest(h["end"] - F.greatest(h["pos"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], h["end"]).alias("end")),
        lambda acc: acc["n"],
    ).cast("long")


_KEY = ("doc_id", "th", "size")


def _same(a: DataFrame, b: DataFrame) -> Column:
    """Rows of one id and text, the columns of b under other names."""
    return a["doc_id"].eqNullSafe(b["k_doc_id"]) & a["th"].eqNullSafe(b["k_th"]) & a["size"].eqNullSafe(b["k_size"])


def _renamed(df: DataFrame, *more) -> DataFrame:
    return df.select(*(F.col(c).alias(f"k_{c}") for c in _KEY), *more)


def _scanned(docs: DataFrame, grams: DataFrame, limit: int) -> DataFrame:
    """(doc_id, th, size, n_words, found): each row of docs with its candidates, stored."""
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), F.octet_length("text").alias("size"), F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("w"))
    lengths = sorted(r["len"] for r in grams.select("len").distinct().collect())  # as many as a window has words, at most
    n_words = F.size("w").cast("long").alias("n_words")
    if not lengths:
        return base.select(*_KEY, n_words, F.expr(_NONE).alias("found"))
    first = F.split("gram", " ")
    some = grams.select(F.least("len", F.lit(3)).alias("n"), first.alias("g"))
    head = F.when(F.col("n") == 3, _head(F.col("g"), F.lit(0), 3)).when(F.col("n") == 2, _head(F.col("g"), F.lit(0), 2)).otherwise(_head(F.col("g"), F.lit(0), 1))
    known = some.select("n", head.alias("h")).distinct().limit(limit + 1).collect()
    if len(known) <= limit:
        heads: dict[int, list[int]] = {}
        for r in known:
            heads.setdefault(r["n"], []).append(r["h"])
        return shared.stored(base.select(*_KEY, n_words, _candidates(heads, lengths).alias("found")), "scanned")
    w = F.col("w")
    at = lambda n: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), _head(w, i, n).alias("h")))
    none = F.expr("cast(array() as array<struct<pos:int,len:int,h:bigint>>)")
    every = base.select(*_KEY, F.explode(F.concat(*(F.when(F.size(w) >= n, at(n)).otherwise(none) for n in lengths))).alias("x")).select(*_KEY, "x.pos", "x.len", "x.h")
    whole = [F.when(F.col("len") == n, _head(F.col("g"), F.lit(0), n)) for n in lengths]
    hashes = grams.select("len", first.alias("g")).select("len", F.coalesce(*whole).alias("h")).distinct()
    met = every.join(hashes, ["len", "h"], "left_semi").groupBy(*_KEY).agg(F.collect_set(F.struct("pos", "len")).alias("at"))
    met = _renamed(met, "at")
    with_words = base.join(met, _same(base, met), "left").select(*_KEY, "w", n_words, F.coalesce("at", F.expr("cast(array() as array<struct<pos:int,len:int>>)")).alias("at"))
    cut = F.transform("at", lambda x: F.struct(x["pos"].alias("pos"), x["len"].alias("len"), F.array_join(F.slice("w", x["pos"] + 1, x["len"]), " ").alias("gram")))
    return shared.stored(with_words.select(*_KEY, "n_words", cut.alias("found")), "scanned")


def _judged(docs: DataFrame, benchmark: DataFrame, size: int, limit: int) -> DataFrame:
    """Columns of ``annotate`` with the key of each row."""
    named = shared.stored(windows(benchmark, size), "windows")
    grams = named.select("gram", "len").distinct()
    rows = _scanned(docs, grams, limit)
    met = rows.select(*_KEY, F.explode("found").alias("x")).distinct().select(*_KEY, "x.pos", "x.len", "x.gram")
    hits = met.join(grams.select("gram"), "gram", "left_semi").groupBy(*_KEY).agg(F.collect_list(F.struct("pos", "len")).alias("hits"), F.array_sort(F.collect_set("gram")).alias("grams"))
    hits = shared.stored(hits.select(*_KEY, _covered(F.col("hits")).alias("n_hit"), "grams", F.sha2(F.array_join("grams", "\n"), 256).alias("kind")), "hits")
    kinds = hits.groupBy("kind").agg(F.first("grams").alias("grams")).select("kind", F.explode("grams").alias("gram"))
    listed = kinds.join(named.select("gram", "item"), "gram").groupBy("kind").agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed = listed.select(F.col("kind").alias("of"), "items", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    found = _renamed(hits.join(listed, hits["kind"] == listed["of"], "left"), "n_hit", "items", "n_items", "items_sha256")
    joined = rows.join(found, _same(rows, found), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        *_KEY, "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def annotate(docs: DataFrame, benchmark: DataFrame, size: int = 13, limit: int = 50_000) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items (sorted), items_sha256 (comma-joined), contaminated."""
    return _judged(docs, benchmark, size, limit).drop("th", "size")


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 13, limit: int = 50_000) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns; rows of one id are judged each by its text."""
    bad = _renamed(_judged(docs, benchmark, size, limit).filter("contaminated").select(*_KEY).distinct())
    rows = shared.wrapped(docs, "doc_id", F.xxhash64("text").alias("th"), F.octet_length("text").alias("size"))
    return shared.unwrapped(rows.join(bad, _same(rows, bad), "left_anti"), docs)
