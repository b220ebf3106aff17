"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or.

A document is a bag of sentences; its score is 1 - prod(1 - p) over the probabilities of
its sentences.  Only the documents carry labels.  Features of a sentence are hashes of
its words and of their first four to seven bytes.  Features are chosen by how many
*different* sentences of toxic and other documents hold them, so copies count once; Spark
counts them, and all that enough toxic sentences have, often enough, are kept.  Weights minimise the
noisy-or likelihood with Adam in NumPy on the driver.

Learning is bounded: the sample holds at most ``max_docs`` labelled documents (in the order
of a hash of doc_id, so it doesn't depend on partitioning) of at most ``max_bytes`` in all; a
document that would pass the bound is left out whole.  What reaches the driver are places
of chosen features only.  Every document of the table is scored, whole.

The settings were chosen by ``cross_validate`` inside the folds that may be learned from;
labels of the held-out fold took no part.

Defined cases: a null, empty or wordless text has no sentence and scores 0; null labels
and labels of unknown documents are not used, of several labels of one doc_id the
greatest holds; texts that share a doc_id are bags of their own, each with its label, and
repeated rows are one bag; null doc_ids are scored but never learned from; with no usable
labels of both kinds every score is 0; repeated rows are scored alike; a text may be as
long as a row can be; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestral.llm import shared, text

SEPARATORS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
PREFIXES = (4, 5, 6, 7)


def sentences(array: pa.Array):
    """Word features of a text column.

    (feature hashes, their word, sentence of each word, text of each sentence,
    start and end byte of each sentence).  Sentences without words don't count.
    """
    data, offsets = text.strings(array)
    data = _LOWER[data]
    start, end, first = text.words(data, offsets, SEPARATORS)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    stops = np.cumsum(ENDS[data], dtype=np.int64)[start] if len(start) else np.zeros(0, np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (stops[1:] != stops[:-1]) | (owner[1:] != owner[:-1])
    sentence = np.cumsum(new) - 1
    whole = text.word_hashes(data, start, end)
    hashes, word = [whole], [np.arange(len(start))]
    for n in PREFIXES:
        long = np.flatnonzero(end - start >= n)
        hashes.append(text.mix(text.word_hashes(data, start[long], start[long] + n) ^ np.uint64(n)))
        word.append(long)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(start)) - 1 if len(heads) else heads
    return np.concatenate(hashes), np.concatenate(word), sentence, owner[heads], start[heads] - offsets[owner[heads]], end[tails] - offsets[owner[heads]], whole, heads


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each sentence: its document's bag and label, a hash of its words, and its distinct features."""
    for batch in text.slices(batches):
        hashes, word, sentence, owner, _, _, whole, heads = sentences(batch.column("text"))
        if not len(owner):
            continue
        content = text.Rolling(whole)(heads, np.append(heads[1:], len(whole)))
        s = sentence[word]
        order = np.lexsort((hashes, s))
        s, h = s[order], hashes[order]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != s[:-1]) | (h[1:] != h[:-1])
        s, h = s[keep], h[keep]
        lists = pa.ListArray.from_arrays(np.searchsorted(s, np.arange(len(owner) + 1)).astype(np.int32), pa.array(h.view(np.int64)))
        of = pa.array(owner)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in ("doc_id", "th", "toxic")), pa.array(content.view(np.int64)), lists], names=["doc_id", "th", "toxic", "content", "features"])


class Model:
    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(features)
        self.features, self.weights, self.bias = features[order], weights[order], bias
        self.bits = np.uint64(22)
        self.maybe = np.zeros(1 << int(self.bits), bool)
        self.maybe[(self.features & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def logits(self, hashes: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.bias)
        if len(self.features):
            at = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.features, hashes[at]), len(self.features) - 1)
            real = self.features[place] == hashes[at]
            out += np.bincount(sentence[at[real]], weights=self.weights[place[real]], minlength=n)[:n]
        return out


def _chosen(docs: DataFrame, known: DataFrame, max_docs: int, max_bytes: int) -> list[tuple]:
    """(doc_id, th, toxic) of the sample."""
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.octet_length("text").alias("size"))
    rows = rows.join(known, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "th").limit(max_docs).collect()
    out, held = [], 0
    for r in rows:
        if held + (r["size"] or 0) <= max_bytes:
            held += r["size"] or 0
            out.append((r["doc_id"], r["th"], r["toxic"]))
    return out


@dataclass
class Bags:
    """Sentences of labelled documents by their chosen features.

    ``row`` and ``column`` are the features of sentences that have any, ``bag`` the document
    of each such sentence, ``plain`` the number of other sentences of each document.
    """

    row: np.ndarray
    column: np.ndarray
    bag: np.ndarray
    plain: np.ndarray
    y: np.ndarray


@dataclass
class Settings:
    """How features are chosen and weights learned."""

    least: int = 8
    lift: float = 4.0
    ridge: float = 0.0
    told: float = 1.0  # share of the log lift that a weight starts with
    steps: int = 400


def learned(bags: Bags, start: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the noisy-or likelihood, by Adam."""
    w, b = settings.told * start, -6.0
    n = len(bags.y)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, settings.steps + 1):
        z = b + np.bincount(bags.row, weights=w[bags.column], minlength=len(bags.bag))
        total = np.bincount(bags.bag, weights=np.logaddexp(0, z), minlength=n) + bags.plain * np.logaddexp(0, b)
        slope = np.where(bags.y == 1, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-9), 1.0)
        g = slope[bags.bag] / (1 + np.exp(-z))
        own = (slope * bags.plain).sum() / (1 + np.exp(-b))
        grad = np.append(np.bincount(bags.column, weights=g[bags.row], minlength=len(w)) / n + settings.ridge * w, (g.sum() + own) / n)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)  # so that vanishing slopes don't move
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def _hits(names: np.ndarray, kept: list[str]):
    """Places among sorted ``names`` of each sentence's features, beside the columns ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("features")
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            flat = np.asarray(lists.flatten()).view(np.uint64)
            row = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            place = np.minimum(np.searchsorted(names, flat), len(names) - 1)
            hit = np.flatnonzero(names[place] == flat)
            found = pa.ListArray.from_arrays(np.searchsorted(row[hit], np.arange(batch.num_rows + 1)).astype(np.int32), pa.array(place[hit].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), found], names=[*kept, "hits"])

    return run


def _strongest(table: DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(features, sorted; their log lifts): the strongest by counts over different sentences.

    Features of toxic sentences are counted first; of the other sentences only features
    that enough toxic ones have are counted at all.
    """
    none = np.zeros(0, np.uint64), np.zeros(0)
    bad = shared.stored(table.filter("toxic = 1").groupBy("content").agg(F.first("features").alias("features")), "toxic-sentences", few=True)
    often = bad.select(F.explode("features").alias("f")).groupBy("f").agg(F.count("*").alias("t")).filter(F.col("t") >= settings.least).toArrow()
    if not often.num_rows:
        return none
    names, t = (np.asarray(often.column(c).combine_chunks()) for c in ("f", "t"))
    order = np.argsort(names.view(np.uint64))
    names, t = names.view(np.uint64)[order], t[order]
    good = shared.arrow(table.filter("toxic = 0").select("content", "features"), _hits(names, ["content"]), "content long, hits array<int>")
    good = shared.stored(good.groupBy("content").agg(F.first("hits").alias("hits")), "other-sentences", few=True)
    n = np.zeros(len(names))
    for place, count in good.select(F.explode("hits").alias("k")).groupBy("k").count().collect():  # at most one row a name
        n[place] = count
    sentences_of = bad.count(), good.count()
    if not all(sentences_of):
        return none
    lift = (t + 0.1) / (n + 0.5) * sentences_of[1] / sentences_of[0]
    strength = np.where(lift > max(1.0, settings.lift), t * np.log(lift), 0)
    best = np.flatnonzero(strength > 0)
    return names[best], np.log(lift[best])


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 5000, max_bytes: int = 32 << 20, settings: Settings = Settings()) -> Model:  # noqa: B008
    """Learn from a bounded sample of labelled documents; docs and labels are those allowed for learning."""
    blank = Model(np.zeros(0, np.uint64), np.zeros(0), -np.inf)
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = _chosen(docs, known, max_docs, max_bytes)
    if len({t for _, _, t in chosen}) < 2:
        return blank
    spark = docs.sparkSession
    keys = F.broadcast(spark.createDataFrame(chosen, "k long, kt long, toxic int"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    rows = rows.join(keys, (F.col("doc_id") == F.col("k")) & (F.col("th") == F.col("kt"))).select("doc_id", "th", "toxic", "text").dropDuplicates(["doc_id", "th"])
    table = shared.stored(shared.arrow(rows, _sample_features, "doc_id long, th long, toxic int, content long, features array<long>"), "sentences", few=True)
    names, start = _strongest(table, settings)
    if not len(names):
        return blank
    bag = ["doc_id", "th", "toxic"]
    hits = shared.arrow(table.select(*bag, "features"), _hits(names, bag), "doc_id long, th long, toxic int, hits array<int>")
    per = hits.groupBy("doc_id", "th").agg(F.first("toxic").alias("toxic"), F.count_if(F.size("hits") == 0).alias("plain"), F.collect_list(F.when(F.size("hits") > 0, F.col("hits"))).alias("found"))
    per = sorted(per.collect(), key=lambda r: (r["doc_id"], r["th"]))
    lists = [(k, h) for k, r in enumerate(per) for h in sorted(r["found"])]
    bags = Bags(
        np.repeat(np.arange(len(lists)), [len(h) for _, h in lists]), np.array([f for _, h in lists for f in h], np.int64), np.array([k for k, _ in lists], np.int64),
        np.array([r["plain"] for r in per], float), np.array([r["toxic"] for r in per], float),
    )
    return Model(names, *learned(bags, start, settings))


def cross_validate(docs: DataFrame, labels: DataFrame, choices: list[Settings]) -> list[tuple[Settings, float, float]]:
    """(settings, log loss, accuracy) over the folds 1 to 4, each scored by a model of the other three."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    out = []
    for settings in choices:
        loss = right = n = 0.0
        for k in range(1, 5):
            inner = (fold > 0) & (fold != k)
            model = fit(docs.filter(inner), labels.filter(inner), settings=settings)
            scores = score(docs.filter(fold == k).select("doc_id", "text"), model).join(labels.filter(fold == k).filter("toxic is not null").select("doc_id", "toxic"), "doc_id")
            p = F.least(F.greatest(F.col("__score"), F.lit(1e-4)), F.lit(1 - 1e-4))
            r = scores.agg(F.sum(-F.log(F.when(F.col("toxic") > 0, p).otherwise(1 - p))), F.count_if((F.col("__score") >= 0.5) == (F.col("toxic") > 0)), F.count("*")).first()
            loss, right, n = loss + (r[0] or 0), right + r[1], n + r[2]
        out.append((settings, loss / max(1, n), right / max(1, n)))
    return out


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.slices(batches):
            hashes, word, sentence, owner, _, _, _, _ = sentences(batch.column("text"))
            z = model.logits(hashes, sentence[word], len(owner))
            n = batch.num_rows
            total = np.bincount(owner, weights=np.logaddexp(0, z), minlength=n)
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            order = np.lexsort((np.arange(len(z)), -z, owner))
            heads = np.concatenate(([True], owner[order][1:] != owner[order][:-1])) if len(z) else np.zeros(0, bool)
            worst, rank = np.full(n, -1), np.zeros(n)
            at = order[heads]
            worst[owner[at]] = at - np.searchsorted(owner, owner[at])
            rank[owner[at]] = p[at]
            offending = np.bincount(owner[p >= 0.5], minlength=n)
            new = [pa.array(-np.expm1(-total)), pa.array(np.bincount(owner, minlength=n)), pa.array(offending), pa.array(worst), pa.array(rank)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *new], names=["row", *_NEW])

    return run


_NEW = ["__score", "__n_sentences", "__n_offending", "__worst", "__worst_score"]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs with __score, __n_sentences, __n_offending, __worst (index, -1: none) and __worst_score.

    Columns of docs with these names give way to the new ones.
    """
    schema = shared.fields(docs, "__score double, __n_sentences long, __n_offending long, __worst long, __worst_score double")
    return shared.unwrapped(shared.arrow(shared.wrapped(docs, F.col("text")), _score(model), schema), docs, *_NEW)


def kept(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs that score below ``least``, with all their columns."""
    schema = shared.fields(docs, "__score double, __n_sentences long, __n_offending long, __worst long, __worst_score double")
    return shared.unwrapped(shared.arrow(shared.wrapped(docs, F.col("text")), _score(model), schema).filter(F.col("__score") < least), docs)


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, sentence, p, text): every sentence of probability ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.slices(batches):
            hashes, word, sentence, owner, start, end, _, _ = sentences(batch.column("text"))
            z = model.logits(hashes, sentence[word], len(owner))
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            at = np.flatnonzero(p >= least)
            data, offsets = text.strings(batch.column("text"))
            raw = data.tobytes()
            spans = [raw[offsets[o] + a : offsets[o] + b].decode() for o, a, b in zip(owner[at], start[at], end[at])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner[at])), pa.array(at - np.searchsorted(owner, owner[at])), pa.array(p[at]), pa.array(spans, pa.string())], names=["doc_id", "sentence", "p", "text"])

    return shared.arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, sentence long, p double, text string")


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """True for the fold that is never learned from; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))
