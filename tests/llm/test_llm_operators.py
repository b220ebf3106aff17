"""Each operator against a brute-force version, on fixtures with nulls, ties and odd texts."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestral.llm import bpe, decontam, licenses, pagediff, pll, simhash, substring, token_store, toxicity

SCHEMA = "doc_id long, text string, lang string, pos long, spans string, tag int"
RNG = np.random.default_rng(5)
VOCABULARY = [f"w{i}" for i in range(40)] + ["Straße", "été", "日本", "x.y", "A-b"]
LONG = " ".join(RNG.choice(VOCABULARY, 4000))
PASSAGE = " ".join(RNG.choice(VOCABULARY, 60))


def _texts():
    out = [None, "", "   ", "one", "a b", "\t\n", LONG, LONG + " tail", "x " * 300, PASSAGE, "start " + PASSAGE + "\n\nend words", "Mixed" + PASSAGE.replace(" ", "  ")]
    out += [" ".join(RNG.choice(VOCABULARY, int(RNG.integers(1, 90)))) for _ in range(40)]
    return out + out[12:20] + ["é" * 700, "don't  'tis\x1c \x85 a", "  lead", "日本語 テキスト　x", "<|endoftext|> a"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", i, "x", 1) for i, t in enumerate(_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r["doc_id"], r["text"]) for r in docs.collect())


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def repeated(spark):
    """Repeated rows, equal ids with different texts, null ids."""
    t = PASSAGE
    return spark.createDataFrame([(1, t, "a", 0, "", 0), (1, t, "a", 0, "", 0), (1, t + " more", "b", 0, "", 0), (None, t, None, None, None, None), (None, None, None, None, None, None), (2, t, "c", 0, "", 0)], SCHEMA)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


# op1

TOKENIZER = P.path("byte_bpe_50k.json")


def test_token_store(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    token_store.write(docs, TOKENIZER, str(tmp_path / "s"))
    got = {r["doc_id"]: r for r in token_store.read(spark, str(tmp_path / "s")).collect()}
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    start = 0
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        start += len(ids)


@pytest.mark.parametrize("n,top", [(1, 0), (1, 9), (300, 0), (5000, 5000), (1000, 10**6), (700, 70)])
def test_elias_fano(n, top):
    v = np.sort(np.random.default_rng(n).integers(0, top + 1, n))
    ef = token_store.EliasFano.of(v)
    assert (ef.all() == v).all() and [ef.select(i) for i in range(n)] == v.tolist()
    for a, b in np.sort(np.random.default_rng(1).integers(0, n + 1, (20, 2)), axis=1).tolist():
        assert (ef.range(a, b) == v[a:b]).all()
    with pytest.raises(IndexError):
        ef.select(n)


def test_token_store_odd(spark, none, repeated, tmp_path):
    token_store.write(none, TOKENIZER, str(tmp_path / "n"))
    assert token_store.read(spark, str(tmp_path / "n")).isEmpty()
    token_store.write(repeated, TOKENIZER, str(tmp_path / "r"))
    from tokenizers import Tokenizer

    for block in spark.read.parquet(str(tmp_path / "r")).collect():
        for k, i in enumerate(block["doc_ids"]):
            assert token_store.document(block.asDict(), k).tolist() in ([2], *(Tokenizer.from_file(TOKENIZER).encode(t, add_special_tokens=False).ids + [2] for t in (PASSAGE, PASSAGE + " more"))), i
    got = token_store.read(spark, str(tmp_path / "r")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 1, 1, 2] and sum(r["n_tokens"] for r in got[:-1]) == got[-1]["start"]


# op2


def brute_dedup(rows, n=20):
    seen, out = {}, {}
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            if seen.setdefault(tuple(w[p : p + n]), (i, p)) != (i, p):
                gone[p : p + n] = [True] * n
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize("share", [1 / 1000, 1 / 4])
def test_substring(docs, rows, share):
    got = {r["doc_id"]: (r["__n_words"], r["__n_removed"], r["__kept"]) for r in substring.dedup(docs, share=share, fraction=1.0).collect()}
    assert got == brute_dedup(rows)


def test_repeats(docs, rows):
    found = substring.repeats(docs, fraction=1.0).cache()
    texts = {i: words(t) for i, t in rows}
    covered = defaultdict(set)
    for r in found.collect():
        assert texts[r["doc_id"]][r["pos"] : r["pos"] + r["n"]] == texts[r["s_doc"]][r["s_pos"] : r["s_pos"] + r["n"]] and r["n"] >= 20
        assert (r["s_doc"], r["s_pos"]) < (r["doc_id"], r["pos"])
        covered[r["doc_id"]] |= set(range(r["pos"], r["pos"] + r["n"]))
    assert {i: len(covered[i]) for i in texts} == {i: e[1] for i, e in brute_dedup(rows).items()}
    assert substring.audit(docs, found).isEmpty()
    wrong = found.limit(1).selectExpr("doc_id", "th", "pos", "n", "s_doc", "s_th", "s_pos + 1 as s_pos")
    assert substring.audit(docs, wrong).count() == 1


def test_substring_odd(none, repeated):
    assert substring.repeats(none).isEmpty() and substring.audit(repeated, substring.repeats(repeated)).isEmpty()
    assert substring.dedup(none).isEmpty()
    out = substring.dedup(repeated)
    assert out.columns[:6] == repeated.columns
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["__n_removed"]) for r in out.collect())
    n = len(PASSAGE.split())
    # The null id comes first and keeps the passage; repeated rows fare alike.
    assert got == [(False, 0, 0), (False, 0, 0), (True, 1, n), (True, 1, n), (True, 1, n), (True, 2, n)]


# op3

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def test_bpe(docs, rows):
    import tiktoken

    codec = bpe.Codec.load(RANKS, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()}
    for i, text in rows:
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == library.encode_ordinary(text or "")
        assert bytes(got[i]["decoded"]).decode() == (text or "")


def test_bpe_long_piece():
    codec = bpe.Codec.load(RANKS, P.PATTERN)
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for piece in ("a" * 5000, "".join(RNG.choice(list("abcdefghij"), 3000)), "!?" * 900):
        assert bpe.merge(piece.encode(), codec.ranks) == library.encode_ordinary(piece)


def test_bpe_odd(none, repeated):
    assert bpe.encode(none, RANKS, P.PATTERN).isEmpty() and bpe.encode(repeated, RANKS, P.PATTERN).count() == 6


# op5


def brute_score(texts, v, params):
    """Log-probability word by word: the network by loops over symbols, words within clusters by counts over the corpus."""
    from lodestral.llm import text as helpers

    p = pll.unpack(params)
    hash_ = lambda w: int(helpers.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    corpus = [words(t) for t in texts]
    count = defaultdict(int)
    for w in (w for doc in corpus for w in doc):
        count[w] += 1
    single = {int(h): k for k, h in enumerate(v.single)}
    symbol = {w: single.get(hash_(w), pll.SINGLE + (hash_(w) >> 40) % pll.CLUSTERS) for w in count}
    out = []
    for doc in corpus:
        ids, total = [symbol[w] for w in doc], 0.0
        for i, s in enumerate(ids):
            near = [ids[i + d] if 0 <= i + d < len(ids) else pll.SYMBOLS for d in (-2, -1, 1, 2)]
            x = np.concatenate([p["e"][k][a] for k, a in enumerate(near)]).astype(float)
            h = np.tanh(x @ p["w"] + p["b"])
            c = h @ p["c"] + p["cb"]
            m = h @ p["m"][s // pll.MEMBERS] + p["mb"][s // pll.MEMBERS]
            total += c[s // pll.MEMBERS] - np.log(np.exp(c).sum()) + m[s % pll.MEMBERS] - np.log(np.exp(m).sum())
            if s >= pll.SINGLE:
                others = {w: n - doc.count(w) for w, n in count.items() if symbol[w] == s}
                total += np.log(others[doc[i]] + pll.ALPHA) - np.log(sum(n + pll.ALPHA for n in others.values()))
        out.append(total)
    return out


@pytest.fixture(scope="module")
def scattered(spark):
    """Few texts of many words, so that some are single, some in clusters."""
    rng = np.random.default_rng(17)
    texts = [" ".join(f"v{int(x * x * 1400)}" for x in rng.random(int(rng.integers(0, 90)))) for _ in range(60)] + [None, "", " ", "lone", "a b"]
    return texts, spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, rid string")


@pytest.mark.parametrize("known", [1 << 20, 600, 0])
def test_pseudo_likelihood(scattered, known):
    texts, docs = scattered
    v = pll.vocabulary(docs, known)
    assert len(v.single) == min(pll.SINGLE, len(v.words)) and len(v.words) <= known
    symbols = pll.coded(docs, v)
    params = pll.train(symbols, pll.pack(pll.start(pll.symbol_counts(v))), part=500)
    got = {r["doc_id"]: r for r in pll.scored(symbols, v, params).collect()}
    expected = brute_score(texts, v, params)
    for i, t in enumerate(texts):
        assert got[i]["n_tokens"] == len(words(t)) and abs(got[i]["log_prob"] - expected[i]) < 1e-3 * (1 + abs(expected[i]))
        assert (got[i]["perplexity"] is None) == (not words(t))


def test_pseudo_likelihood_stable(scattered, spark):
    """Scores depend on the texts alone, not on input splits or shuffle partitions."""
    _, docs = scattered
    scores = []
    for splits, shuffle in ((1, 3), (7, 11)):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle))
        try:
            scores.append({r["doc_id"]: round(r["log_prob"], 9) for r in pll.score(docs.repartition(splits), part=300).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
    assert scores[0] == scores[1]


def test_pseudo_likelihood_learns(spark):
    """Words that follow from both neighbours become likelier than by their frequency."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"{'abc'[k % 3]}{x}" for k in range(60) for x in [int(rng.integers(0, 6))]) for _ in range(4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    mean = lambda df: df.agg(F.sum("log_prob") / F.sum("n_tokens")).first()[0]
    plain = mean(pll.score(docs, rounds=0))
    assert abs(plain + np.log(18)) < 0.05 and mean(pll.score(docs, part=30_000)) > plain + 0.9


def test_pseudo_likelihood_odd(none, repeated, docs):
    assert pll.score(none).isEmpty()
    got = pll.score(repeated).collect()
    assert len(got) == 6 and len({round(r["log_prob"], 6) for r in got if r["doc_id"] == 1 and r["n_tokens"] == 60}) == 1
    p = pll.start()
    import pyarrow as pa

    ids, around, _ = pll.windows(pa.array([np.array([1, 2, 3, 4, 5], "<u2").tobytes(), np.array([6], "<u2").tobytes(), b""], pa.binary()))
    assert around[0].tolist() == [pll.SYMBOLS, pll.SYMBOLS, 2, 3] and around[2].tolist() == [1, 2, 4, 5] and (around[5] == pll.SYMBOLS).all()
    for c in range(2):  # probabilities of all symbols add up to one
        every = np.arange(pll.SYMBOLS, dtype=np.int32)
        assert abs(np.exp(pll.log_probabilities(p, every, np.repeat(around[c : c + 1], pll.SYMBOLS, axis=0))).sum() - 1) < 1e-3


def test_pseudo_likelihood_gradient():
    rng = np.random.default_rng(0)
    ids, around = rng.integers(0, 64, 200).astype(np.int32), rng.integers(0, 64, (200, 4)).astype(np.int32)
    p = pll.start()
    g2 = {k: np.full(s, 1e-8, np.float32) for k, s in pll.SHAPES.items()}
    before = pll.log_probabilities(p, ids, around).mean()
    for _ in range(60):
        pll._learn(p, g2, ids, around, 0.1)
    assert pll.log_probabilities(p, ids, around).mean() > before + 1


# op6


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[a : a + 3]), 42) for a in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(values, ids, budget=2):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if (values[i] ^ values[j]).bit_count() <= budget:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(docs, rows):
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    prints = {i: brute_fingerprint(t) for i, t in rows}
    roots = components_of(prints, [i for i, _ in rows])
    assert got == {i: (prints[i], roots[i]) for i, _ in rows}


def test_trie_join(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 30)
    values = {int(b) ^ sum(1 << int(k) for k in rng.integers(0, 64, rng.integers(0, 4))) for b in base for _ in range(30)}
    values |= {int(b) for b in base}
    ids = sorted(values)
    classes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in ids], "fp long")
    roots = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(simhash.links(classes)).collect()}
    expected = defaultdict(set)
    for v, r in components_of({v: v for v in ids}, ids).items():
        expected[r].add(v)
    got = defaultdict(set)
    for v in ids:
        got[roots.get(v, v)].add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_simhash_odd(none, repeated):
    assert simhash.near_duplicates(none).isEmpty()
    got = simhash.near_duplicates(repeated).collect()
    assert len(got) == 6 and {r["component_id"] for r in got if r["fp"]} >= {1}


def test_near_copies(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(VOCABULARY, 200)) for _ in range(60)]
    near = []
    for t in texts[:20]:
        w = t.split()
        w[100] = "changed"
        near.append(" ".join(w))
    all_ = texts + near + texts[:5]
    rows = spark.createDataFrame(list(enumerate(all_)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(rows).collect()}
    expected = {i: i if i < 60 else (i - 60 if i < 80 else i - 80) for i in range(len(all_))}
    assert got == expected


def similar(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_block_edits(spark):
    rng = np.random.default_rng(4)
    fresh = lambda n: [f"t{x}" for x in rng.integers(0, 1 << 30, n)]
    rows = []
    for i in range(40):  # words in one block: appended, or put in place of others
        w = fresh(300)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w + fresh(73) if i % 2 else w[:100] + fresh(28) + w[128:]))]
    assert all(0.8 <= similar(rows[2 * i][1], rows[2 * i + 1][1]) < 0.83 for i in range(40))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(80)}


def test_near_copies_shared_lines(spark):
    rng = np.random.default_rng(6)
    fresh = lambda n: [f"t{x}" for x in rng.integers(0, 1 << 30, n)]
    line = fresh(10)
    texts = [" ".join(line * 60 + fresh(100)) for _ in range(20)]  # one line again and again, words of their own
    for _ in range(20):  # scattered changes, below the bound
        w = fresh(300)
        v = list(w)
        for k in range(7, 300, 25):
            v[k] = "changed"
        texts += [" ".join(w), " ".join(v)]
    assert similar(texts[0], texts[1]) < 0.1 and all(0.6 < similar(texts[i], texts[i + 1]) < 0.75 for i in range(20, 60, 2))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(60)}


# op8


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_contamination(rows, items, n=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    grams = defaultdict(set)
    for i, t in items:
        w = split(t)
        for p in range(max(1, len(w) - n + 1)) if w else ():
            grams[tuple(w[p : p + n])].add(str(i))
    out = {}
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for size in {len(g) for g in grams}:
            for p in range(len(w) - size + 1):
                if tuple(w[p : p + size]) in grams:
                    hit |= set(range(p, p + size))
                    found |= grams[tuple(w[p : p + size])]
        out[i] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("limit", [50_000, 3])
def test_decontamination(spark, docs, rows, limit):
    items = [(1, PASSAGE), (2, " ".join(PASSAGE.split()[5:30])), (3, "one"), (4, "W3 w4"), (5, None), (6, "..."), (10, " ".join(LONG.split()[100:108])), (11, "w1 w2 w3 w4"), (12, "ÉTÉ")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontam.annotate(docs, bench, limit=limit).collect()}
    assert got == brute_contamination(rows, items)


def test_decontamination_odd(spark, docs, none, repeated):
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    empty = bench.limit(0)
    assert decontam.annotate(none, bench).isEmpty() and decontam.annotate(docs, empty).filter("n_hit > 0 or contaminated").isEmpty()
    assert decontam.annotate(repeated, bench).count() == 6
    kept = decontam.clean(repeated, bench)
    assert kept.columns == repeated.columns and [r["text"] for r in kept.collect()] == [None]
    assert decontam.clean(repeated, empty).count() == 6


# op9


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(900):
        sentences = [" ".join(rng.choice(VOCABULARY, 8)) for _ in range(int(rng.integers(1, 9)))]
        bad = i % 5 == 0
        if bad:
            sentences[int(rng.integers(0, len(sentences)))] += f" vile{rng.choice(list('abcdefgh'))}ness"
        rows.append((i, ". ".join(sentences)))
        labels.append((i, int(bad)))
    rows += [(9000, None), (9001, ""), (9002, "..."), (None, "vileaness")]
    labels += [(9000, 1), (9100, 1), (None, 1), (3, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs.filter(~toxicity.held_out()), labels.filter(~toxicity.held_out()))
    got = toxicity.score(docs, model).collect()
    scores = {r["doc_id"]: r["__score"] for r in got}
    truth = {i: i % 5 == 0 for i in range(900)}
    assert np.mean([(scores[i] >= 0.5) == t for i, t in truth.items() if zlib.crc32(str(i).encode()) % 5 == 0]) > 0.97
    assert scores[9000] == scores[9001] == scores[9002] == 0 and all(0 <= s <= 1 for s in scores.values())
    located = toxicity.locate(docs, model).collect()
    assert len(located) > 150 and np.mean(["vile" in r["text"] for r in located]) > 0.95


def test_toxicity_odd(labelled, none, repeated):
    docs, labels = labelled
    blank = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, blank).filter("__score > 0.001").isEmpty()
    assert toxicity.score(none, blank).isEmpty()
    assert toxicity.score(repeated, blank).columns[:6] == repeated.columns


# op10


def test_licenses(spark, docs, none, repeated):
    rows = [(1, "x " * 50 + licenses.TEMPLATES["mit"] + " y" * 50), (2, licenses.TEMPLATES["gpl-3.0-notice"].replace("Foundation", "Club").upper()), (3, "Released under the terms"), (4, None), (5, licenses.TEMPLATES["apache-2.0-notice"] + " " + licenses.TEMPLATES["mit"])]
    got = {r["doc_id"]: (r["n_licenses"], r["licenses"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (1, "mit") and got[2] == (1, "gpl-3.0-notice") and got[3] == (0, "") and got[4] == (0, "") and "apache-2.0-notice" in got[5][1] and "mit" in got[5][1]
    assert licenses.scan(none).isEmpty() and licenses.scan(repeated).count() == 3 and licenses.scan(docs, {}).filter("n_licenses > 0").isEmpty()
    with pytest.raises(ValueError):
        licenses.scan(docs, {"short": "two words"})


# op7


def test_pages(spark):
    page = "<html><head><title>T</title></head><body><nav><a>Home</a></nav>{}<footer>f</footer></body></html>"
    rows = [
        (1, "https://a.com/x/1", page.format("<article><h1>A &amp; B</h1><p>one  two<br>three<p>same</article>")), (2, "https://a.com/x/2", page.format("<article><p>same</p><aside>no</aside><p>own</p></article>")),
        (3, "https://b.com/1", page.format("<div>Shared line</div><p>Only here</p>")), (4, "https://b.com/2", page.format("<div>Shared line</div><p>And here</p>")), (5, None, None), (6, "odd", ""), (7, "https://c.com/", "<p>alone"), (1, "https://a.com/x/1", "<article>dup"),
    ]
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in pagediff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    expected = [(1, "A & B\n\none two three\n\nsame"), (1, "dup"), (2, "same\n\nown"), (3, "Only here"), (4, "And here"), (5, ""), (6, ""), (7, "alone")]
    assert got == [(i, t, len(t)) for i, t in expected]
    assert pagediff.extract(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


def brute_lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


def test_lcs():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = (list(rng.choice(list("abcd"), rng.integers(0, 12))) for _ in range(2))
        assert len(pagediff.shared_lines(a, b)) == brute_lcs(a, b)


def test_pseudo_likelihood_bits(scattered, spark):
    """Copies of a text score alike to the last bit, whatever else is in their batches."""
    texts, docs = scattered
    again = docs.select((F.col("doc_id") + 100_000).alias("doc_id"), "text", "rid").repartition(9)
    scores = {}
    for r in pll.score(docs.union(again).repartition(5), known=20, part=300).collect():
        scores.setdefault(r["doc_id"] % 100_000, set()).add(r["log_prob"])
    assert len(scores) == docs.count() and all(len(x) == 1 for x in scores.values())


def test_bpe_round_trip(docs, none):
    """One pass gives what encoding and then decoding gives."""
    ranks, pattern = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    rows = lambda df: sorted((r["doc_id"] if r["doc_id"] is not None else -1, bytes(r["ids"]), bytes(r["decoded"])) for r in df.collect())
    assert rows(bpe.round_trip(docs, ranks, pattern)) == rows(bpe.decode(bpe.encode(docs, ranks, pattern), ranks, pattern))
    assert bpe.round_trip(none, ranks, pattern).collect() == []
