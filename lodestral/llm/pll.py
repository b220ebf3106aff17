"""Language-model scoring by masked pseudo-likelihood.

A small network predicts every token from the two tokens on either side, never from the
token itself; the sum of the conditional log-probabilities scores a document.

The vocabulary is that of the whole corpus: every distinct word with its count, a table
that grows with the corpus.  The ``SINGLE`` most frequent words are symbols of their own,
all others fall into clusters by their hash.  The network gives the probability of a
symbol (of its class, times that of the member within the class, so two short softmaxes
do), and the vocabulary that of the word within its cluster:

    (count in other documents + ALPHA) / (the same, summed over all words of the cluster)

so a document's own tokens don't vouch for it, and a word that no other document holds
has a small probability of its own.  Counts of the words most frequent in the corpus, at
most ``known`` of them, go to every task; those of the others are joined by word.

Training is data-parallel in NumPy and starts from the corpus' own word frequencies.  It
runs in ``ROUNDS`` rounds, each over a part of the documents: partitions of about ``PART``
tokens, dealt by a hash of id and text and sorted, make one pass of Adagrad steps from the
same start, and hand on parameters and accumulated gradients, which are averaged, weighted
by tokens, in groups of ``FAN`` until one row is left.  The number of partitions follows
from the number of tokens alone, so scores don't depend on cores or input splits.

Defined cases: a null, empty or wordless text has no tokens and scores 0 with perplexity
null; words at an end of a text see a padding symbol; an empty table trains nothing and
gives no rows; repeated rows and ties score alike; a text may be as long as a row can be
(its symbols lie in one row of two bytes a word); null ids change nothing; only doc_id and
text are read, so no other column can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lodestral.llm import shared, text

CLASSES = MEMBERS = 32
SYMBOLS = CLASSES * MEMBERS
SINGLE = SYMBOLS // 2
CLUSTERS = SYMBOLS - SINGLE
ALPHA = 0.5
WIDTH, HIDDEN = 8, 16
STEP, SCORE = 8192, 1 << 14
#: Logarithms of rare words are summed as whole numbers of this fraction, so that no order changes the sum.
UNIT = 1 << 32
ROUNDS, PART, FAN = 4, 1 << 21, 32
#: Shapes of the parameters: embeddings (with padding), hidden layer, class and member layers.
SHAPES = {"e": (4, SYMBOLS + 1, WIDTH), "w": (4 * WIDTH, HIDDEN), "b": (HIDDEN,), "c": (HIDDEN, CLASSES), "cb": (CLASSES,), "m": (CLASSES, HIDDEN, MEMBERS), "mb": (CLASSES, MEMBERS)}


def start(counts: np.ndarray | None = None, seed: int = 11) -> dict[str, np.ndarray]:
    """Parameters before training; with token counts of the symbols, their frequencies are what is predicted first."""
    rng = np.random.default_rng(seed)
    p = {k: (np.zeros(s) if k.endswith("b") else rng.normal(0, 0.3 if k == "e" else 0.2, s)).astype(np.float32) for k, s in SHAPES.items()}
    if counts is not None:
        share = (counts.reshape(CLASSES, MEMBERS) + 0.5) / (counts.sum() + SYMBOLS / 2)
        p["cb"], p["mb"] = np.log(share.sum(axis=1)).astype(np.float32), np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
        p["c"], p["m"] = 0.05 * p["c"], 0.05 * p["m"]
    return p


def pack(p: dict[str, np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(p[k], "<f4").tobytes() for k in SHAPES)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(data, "<f4"), {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).copy()
        at += n
    return out


@dataclass
class Vocabulary:
    """Words by hash: the most frequent, those with known counts (sorted, the most frequent among them), and totals of the clusters.

    ``rare`` has (h, n) of the words whose counts aren't known here.
    """

    single: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    tokens: np.ndarray
    types: np.ndarray
    rare: DataFrame | None = None

    def plain(self) -> Vocabulary:
        return Vocabulary(self.single, self.words, self.counts, self.tokens, self.types)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        out = SINGLE + (hashes >> np.uint64(40)) % np.uint64(CLUSTERS)
        if len(self.single):
            order = np.argsort(self.single)
            at = np.minimum(np.searchsorted(self.single[order], hashes), len(order) - 1)
            out = np.where(self.single[order][at] == hashes, order[at].astype(np.uint64), out)
        return out.astype(np.uint16)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Count of each word, -1 if it isn't known here."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.counts[at], -1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text.slices(batches, limit=4 << 20):
        data, offsets = text.strings(batch.column("text"))
        begin, end, _ = text.words(data, offsets)
        words, n = np.unique(text.word_hashes(data, begin, end), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["h", "n"])


def vocabulary(docs: DataFrame, known: int = 1 << 20) -> Vocabulary:
    """Words of all texts with their counts."""
    table = shared.stored(shared.arrow(docs.select("text"), _counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "vocabulary")
    # The least count such that no more than ``known`` words have it: distinct counts are few.
    often = sorted((tuple(r) for r in table.groupBy("n").count().collect()), reverse=True)
    least, held = (often[0][0] + 1 if often else 1), 0
    for n, words in often:
        if held + words > known:
            break
        least, held = n, held + words
    top = table.filter(F.col("n") >= least).toArrow()
    words, counts = (np.asarray(top.column(c).combine_chunks()) for c in ("h", "n"))
    words = words.view(np.uint64)
    order = np.lexsort((words, -counts))[:SINGLE]
    single = words[order]
    order = np.argsort(words)
    cluster = (F.shiftrightunsigned("h", 40) % CLUSTERS).cast("int")
    totals = table.groupBy(cluster.alias("cluster")).agg(F.sum("n").alias("tokens"), F.count("*").alias("types")).collect()
    tokens, types = np.zeros(CLUSTERS), np.zeros(CLUSTERS)
    for r in totals:
        tokens[r["cluster"]], types[r["cluster"]] = r["tokens"], r["types"]
    out = Vocabulary(single, words[order], counts[order], tokens, types, table.filter(F.col("n") < least))
    at = (single >> np.uint64(40)).astype(np.int64) % CLUSTERS  # single words are in no cluster
    np.subtract.at(out.tokens, at, out.known(single).astype(float))
    np.subtract.at(out.types, at, 1.0)
    return out


def _coded(v: Vocabulary):
    """Symbols of each text, the sum of its words' log-probabilities within clusters but for rare numerators, and the rare words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.slices(batches):
            data, offsets = text.strings(batch.column("text"))
            begin, end, first = text.words(data, offsets)
            hashes = text.word_hashes(data, begin, end)
            n = batch.num_rows
            owner = np.repeat(np.arange(n), np.diff(first))
            # One entry for each distinct word of each text.
            distinct, code = np.unique(hashes, return_inverse=True)
            kinds, counts = v.symbols(distinct), v.known(distinct)
            pair, own = np.unique(owner * np.int64(max(1, len(distinct))) + code, return_counts=True)
            row, word = np.divmod(pair, max(1, len(distinct)))
            symbol = kinds[word].astype(np.int64)
            clustered = symbol >= SINGLE
            row, word, own, cluster = row[clustered], word[clustered], own[clustered], symbol[clustered] - SINGLE
            spot, back = np.unique(row * CLUSTERS + cluster, return_inverse=True)
            mine = np.bincount(back, weights=own, minlength=len(spot))[back]
            room = v.tokens[cluster] - mine + ALPHA * v.types[cluster]
            common = counts[word] >= 0
            others = np.where(common, counts[word] - own, 0) + ALPHA
            value = own * (np.where(common, np.log(others), 0.0) - np.log(room))
            rare = np.flatnonzero(~common)
            ends = np.searchsorted(row[rare], np.arange(n + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (distinct[word[rare]].view(np.int64), own[rare].astype(np.int32))]
            packed = kinds[code].astype("<u2").tobytes() if len(code) else b""
            pieces = [packed[2 * a : 2 * b] for a, b in zip(first.tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), batch.column("th"), pa.array(np.diff(first)), pa.array(pieces, pa.binary()), pa.array(np.bincount(row, weights=value, minlength=n).astype(float)), *lists],
                names=[c.split()[0] for c in CODED.split(", ")],
            )

    return run


CODED = "rid long, doc_id long, th long, n_tokens long, symbols binary, within double, rare array<long>, own array<int>"


def coded(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """A stored table of symbols, a row for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("text").alias("th"), "text")
    return shared.stored(shared.arrow(rows, _coded(v.plain()), CODED), "symbols")


def windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol of each word of some texts, its four neighbours, and the word offset of each text."""
    data, offsets = text.strings(column)
    ids = data.view("<u2").astype(np.int32) if len(data) else np.zeros(0, np.int32)
    first = offsets // 2
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    around = np.full((len(ids), 4), SYMBOLS, np.int32)
    for k, d in enumerate((-2, -1, 1, 2)):
        if abs(d) >= len(ids):
            continue
        here, there = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
        same = owner[here] == owner[there]
        part = around[here, k]
        part[same] = ids[there][same]
    return ids, around, first


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _forward(p, ids, around):
    """Tokens sorted by class: order, class bounds, inputs, hidden, class and member probabilities."""
    cls = ids // MEMBERS
    order = np.argsort(cls, kind="stable")
    bounds = np.searchsorted(cls[order], np.arange(CLASSES + 1))
    ctx = around[order]
    x = np.concatenate([p["e"][k][ctx[:, k]] for k in range(4)], axis=1)
    h = np.tanh(x @ p["w"] + p["b"])
    pc = _softmax(h @ p["c"] + p["cb"])
    pm = np.empty((len(ids), MEMBERS), np.float32)
    for c in range(CLASSES):
        a, b = bounds[c], bounds[c + 1]
        if b > a:
            pm[a:b] = h[a:b] @ p["m"][c] + p["mb"][c]
    return order, bounds, ctx, x, h, pc, _softmax(pm)


def _weighted(bias: np.ndarray, weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    """bias + weights.T @ x, columns of x by themselves: sums run in a fixed order, whatever the number of columns."""
    out = np.repeat(bias[:, None], x.shape[1], axis=1)
    for row, part in zip(weights, x):
        out += row[:, None] * part
    return out


def _log_of(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log-softmax of each column at the chosen row."""
    logits -= np.maximum.reduce(logits, axis=0)
    powers = np.exp(logits)
    total = powers[0].copy()
    for row in powers[1:]:
        total += row
    return logits[chosen, np.arange(len(chosen))] - np.log(total)


def log_probabilities(p: dict[str, np.ndarray], ids: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Of each token, by steps that treat every token alone: what else is scored with it doesn't change a bit."""
    out = np.empty(len(ids))
    near = [p["e"][k] @ p["w"][k * WIDTH : (k + 1) * WIDTH] for k in range(4)]
    for a in range(0, len(ids), SCORE):
        part, ctx = ids[a : a + SCORE], around[a : a + SCORE]
        order = np.argsort(part // MEMBERS, kind="stable")
        s, ctx = part[order], ctx[order]
        bounds = np.searchsorted(s // MEMBERS, np.arange(CLASSES + 1))
        z = p["b"] + near[0][ctx[:, 0]]
        for k in (1, 2, 3):
            z += near[k][ctx[:, k]]
        h = np.ascontiguousarray(np.tanh(z).T)
        found = _log_of(_weighted(p["cb"], p["c"], h), s // MEMBERS).astype(float)
        for c in range(CLASSES):
            x, y = bounds[c], bounds[c + 1]
            if y > x:
                found[x:y] += _log_of(_weighted(p["mb"][c], p["m"][c], np.ascontiguousarray(h[:, x:y])), s[x:y] % MEMBERS)
        out[a : a + SCORE][order] = found
    return out


def _learn(p, g2, ids, around, rate: float) -> None:
    n = len(ids)
    order, bounds, ctx, x, h, dc, dm = _forward(p, ids, around)
    row, s = np.arange(n), ids[order]
    dc[row, s // MEMBERS] -= 1
    dm[row, s % MEMBERS] -= 1
    grad = {"c": h.T @ dc / n, "cb": dc.mean(axis=0), "m": np.zeros_like(p["m"]), "mb": np.zeros_like(p["mb"])}
    dh = dc @ p["c"].T
    for c in range(CLASSES):
        a, b = bounds[c], bounds[c + 1]
        if b > a:
            grad["m"][c] = h[a:b].T @ dm[a:b] / n
            grad["mb"][c] = dm[a:b].sum(axis=0) / n
            dh[a:b] += dm[a:b] @ p["m"][c].T
    dz = dh * (1 - h * h)
    grad["w"], grad["b"] = x.T @ dz / n, dz.mean(axis=0)
    dx = dz @ p["w"].T
    grad["e"] = np.zeros_like(p["e"])
    for k in range(4):
        flat = (ctx[:, k, None] * WIDTH + np.arange(WIDTH)).ravel()
        grad["e"][k] = np.bincount(flat, weights=dx[:, k * WIDTH : (k + 1) * WIDTH].ravel(), minlength=(SYMBOLS + 1) * WIDTH).reshape(-1, WIDTH) / n
    for k, g in grad.items():
        g2[k] += g * g
        p[k] -= (rate * g / (np.sqrt(g2[k]) + 1e-6)).astype(np.float32)


_STATE = "part long, n long, params binary, squares binary"


def _train(params: bytes, squares: bytes, rate: float):
    """One pass over a partition; tokens of neighbouring documents share steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, g2, seen = unpack(params), unpack(squares), 0
        ids, around = np.zeros(0, np.int32), np.zeros((0, 4), np.int32)

        def step(least: int) -> None:
            nonlocal ids, around
            while len(ids) >= least and len(ids):
                _learn(p, g2, ids[:STEP], around[:STEP], rate)
                ids, around = ids[STEP:], around[STEP:]

        for batch in text.slices(batches, "symbols"):
            more, near, _ = windows(batch.column("symbols"))
            ids, around, seen = np.concatenate((ids, more)), np.concatenate((around, near)), seen + len(more)
            step(STEP)
        step(1)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([seen], pa.int64()), pa.array([pack(p)], pa.binary()), pa.array([pack(g2)], pa.binary())], names=["part", "n", "params", "squares"])

    return run


def _average(table: pa.Table) -> pa.Table:
    table = table.sort_by("part")
    n = np.asarray(table.column("n"), np.float64)
    mean = lambda c: sum(np.frombuffer(x.as_py(), "<f4").astype(np.float64) * w for x, w in zip(table.column(c), n)) / n.sum()
    both = [pa.array([mean(c).astype("<f4").tobytes()], pa.binary()) for c in ("params", "squares")]
    return pa.table([pa.array([table.column("group")[0].as_py()], pa.int64()), pa.array([int(n.sum())], pa.int64()), *both], names=["part", "n", "params", "squares"])


def train(symbols: DataFrame, params: bytes, rate: float = 0.3, part: int = PART, rounds: int = ROUNDS) -> bytes:
    """Packed parameters learned from every token of a table of ``coded``."""
    total = symbols.agg(F.sum("n_tokens")).first()[0] or 0
    tasks = max(1, -(-total // (part * max(1, rounds))))
    squares = pack({k: np.full(s, 1e-8, np.float32) for k, s in SHAPES.items()})
    for k in range(rounds if total else 0):
        own = symbols.filter("n_tokens > 0").select("th", "doc_id", "symbols", F.xxhash64("th", "doc_id").alias("deal")).filter(F.pmod("deal", F.lit(rounds)) == k)
        dealt = own.repartition(tasks, F.shiftright("deal", 8)).sortWithinPartitions("deal", "th", "doc_id").select("symbols")
        rows = shared.stored(shared.arrow(dealt, _train(params, squares, rate), _STATE), "parameters")
        top = rows.agg(F.max("part")).first()[0]
        if top is None:
            continue
        while True:
            rows = rows.withColumn("group", F.floor(F.col("part") / FAN)).groupBy("group").applyInArrow(_average, _STATE)
            if top < FAN:
                break
            top //= FAN
        one = rows.first()
        params, squares = bytes(one["params"]), bytes(one["squares"])
    return params


def symbol_counts(v: Vocabulary) -> np.ndarray:
    """Tokens of each symbol in the corpus."""
    out = np.zeros(SYMBOLS)
    out[: len(v.single)] = v.known(v.single)
    out[SINGLE:] = v.tokens
    return out


def _log_net(params: bytes, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = unpack(params)
        for batch in text.slices(batches, "symbols"):
            ids, around, first = windows(batch.column("symbols"))
            net, full = np.zeros(batch.num_rows), np.flatnonzero(np.diff(first))
            if len(full):  # each text is summed by itself
                net[full] = np.add.reduceat(log_probabilities(p, ids, around), first[full])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(net)], names=[*names, "net"])

    return run


def rare_part(symbols: DataFrame, v: Vocabulary) -> DataFrame:
    """(rid, value): log numerators of the rare words of each text, from the vocabulary joined by word."""
    pairs = F.arrays_zip("rare", "own")
    asked = symbols.filter(F.size("rare") > 0).select("rid", F.explode(pairs).alias("x")).select("rid", F.col("x.rare").alias("h"), F.col("x.own").alias("own"))
    value = F.col("own") * F.round(F.log(F.col("n") - F.col("own") + F.lit(ALPHA)) * UNIT).cast("long")
    return asked.join(v.rare, "h").groupBy("rid").agg((F.sum(value) / UNIT).alias("value"))


def scored(symbols: DataFrame, v: Vocabulary, params: bytes) -> DataFrame:
    """(doc_id, n_tokens, log_prob, perplexity) of each row of a table of ``coded``."""
    kept = ["rid", "doc_id", "n_tokens", "within"]
    net = shared.arrow(symbols.select(*kept, "symbols"), _log_net(params, kept), "rid long, doc_id long, n_tokens long, within double, net double")
    more = rare_part(symbols, v).withColumnRenamed("rid", "of")
    log_prob = F.col("net") + F.col("within") + F.coalesce("value", F.lit(0.0))
    perplexity = F.when(F.col("n_tokens") > 0, F.exp(-F.col("log_prob") / F.col("n_tokens")))
    return net.join(more, F.col("rid") == F.col("of"), "left").select("doc_id", "n_tokens", log_prob.alias("log_prob")).select("*", perplexity.alias("perplexity"))


def score(docs: DataFrame, known: int = 1 << 20, rate: float = 0.3, part: int = PART, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_tokens, log_prob, perplexity) of each whole text, by a model learned from all texts; ``rounds`` 0: word frequencies alone."""
    v = vocabulary(docs, known)
    symbols = coded(docs, v)
    return scored(symbols, v, train(symbols, pack(start(symbol_counts(v))), rate, part, rounds))
