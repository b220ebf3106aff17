"""One text of more than 10 MB through every operator, beside short ones."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from lodestral.llm import bpe, decontam, licenses, pagediff, pll, simhash, substring, token_store, toxicity
from tests.llm.test_llm_operators import brute_dedup, brute_fingerprint, words

SIZE = 10 << 20


@pytest.fixture(scope="module")
def long():
    rng = np.random.default_rng(23)
    known = np.array(["".join(rng.choice(list("abcdefghijklmnopqrstuv"), int(k))) for k in rng.integers(2, 9, 30_000)])
    text = " ".join(known[(rng.random(1_900_000) ** 2 * len(known)).astype(int)].tolist())
    assert len(text) > SIZE
    return text


@pytest.fixture(scope="module")
def rows(long):
    return [(1, "a short text"), (2, long), (3, long[5_000_000:5_000_400].split(" ", 1)[1]), (4, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()


def test_tokens(spark, docs, long, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    token_store.write(docs, path, str(tmp_path / "s"))
    got = {r["doc_id"]: r for r in token_store.read(spark, str(tmp_path / "s")).collect()}
    ids = [*Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids, 2]
    assert (got[2]["n_tokens"], got[2]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and got[3]["start"] == got[2]["start"] + len(ids)


def test_bpe(docs, long):
    import tiktoken

    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    codec = bpe.Codec.load(ranks, P.PATTERN)
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs, ranks, P.PATTERN), ranks, P.PATTERN).collect()}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    assert np.array_equal(np.frombuffer(got[2]["ids"], "<u4"), np.array(library.encode_ordinary(long))) and hashlib.sha256(got[2]["decoded"]).digest() == hashlib.sha256(long.encode()).digest()


def test_substring(docs, rows):
    got = {r["doc_id"]: (r["__n_words"], r["__n_removed"], r["__kept"]) for r in substring.dedup(docs).collect()}
    assert got == brute_dedup(rows) and got[3][1] > 20


def test_simhash(docs, long):
    got = {r["doc_id"]: r["fp"] % (1 << 64) for r in simhash.near_duplicates(docs).collect()}
    assert got[2] == brute_fingerprint(long) and got[4] == 0
    assert simhash.distinct(docs).count() == 4


def test_scores(docs, rows):
    got = {r["doc_id"]: r for r in pll.score(docs).collect()}
    assert {i: r["n_tokens"] for i, r in got.items()} == {i: len(words(t)) for i, t in rows} and -12 < got[2]["log_prob"] / got[2]["n_tokens"] < -6
    model = toxicity.Model(np.array([1, 2], np.uint64), np.zeros(2), -20.0)
    bags = {r["doc_id"]: (r["__n_sentences"], r["__score"]) for r in toxicity.score(docs, model).collect()}
    assert bags[4] == (0, 0) and all(n == 1 and 0 < s < 1e-8 for i, (n, s) in bags.items() if i < 4)


def test_windows(spark, docs, long):
    item = " ".join(long[9_000_000:9_000_200].split(" ")[1:20])
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in decontam.annotate(docs, bench).collect()}
    assert got[2] == (len(long.split()), 19, ["7"]) and got[1][1] == 0
    marked = spark.createDataFrame([(1, long[:6_000_000] + " " + licenses.TEMPLATES["mit-notice"] + " " + long[6_000_000:])], "doc_id long, text string")
    assert licenses.scan(marked).first()["licenses"] == "mit-notice"


def test_page(spark, long):
    line = long[:200]
    body = "".join(f"<p>{long[a : a + 1000]}</p>" for a in range(0, SIZE, 1000))
    pages = spark.createDataFrame([(1, "https://a.test/1", f"<nav>x</nav><article>{body}</article>"), (2, "https://a.test/2", f"<div>{line}</div><p>" + "same</p><p>" * 5000 + "own</p>"), (3, "https://a.test/3", f"<div>{line}</div><p>" + "same</p><p>" * 4000 + "mine</p>")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in pagediff.extract(pages).collect()}
    assert got[1]["n_chars"] > SIZE - 50_000 and got[2]["text"].endswith("own") and got[3]["text"] == "mine"
