"""Alignment of two tokenizers against a brute-force version by token byte ranges."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from lodestral.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "a", "Hello world, it's the unbelievable end.", "  two  blanks\n\n  and \t lines \n", "é öäü naïve café", "日本語 text ünd 🙂", "has ▁ mark", "<s> </s> <|endoftext|> <0x41>",
    "Hello world, it's the unbelievable end.", "antidisestablishmentarianism " * 3, "0123456789" * 30, "x" * 300, "\n \n  x", "tab\tin\twords  ", "nul\x00 byte", "aaaa bbbb " * 40,
]


def brute(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte_of, rows, pairs = alignment._byte_of(), [], Counter()
    for key, text in docs:
        whole = b" " + (text or "").encode()
        left = a.encode(whole.decode(), add_special_tokens=False) if text else None
        right = b.encode(text, out_type=int) if text else []
        tokens_a = [(i, bytes(byte_of[c] for c in t)) for i, t in zip(left.ids, left.tokens)] if text else []
        tokens_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in right]
        if not text or b"".join(t for _, t in tokens_a) != whole or b"".join(t for _, t in tokens_b) != whole:
            rows.append((key, 0, 0, [], ""))
            continue
        groups, at_a, at_b, held_a, held_b, y = [], 0, 0, [], [], iter(tokens_b)
        for i, t in tokens_a:
            held_a.append(i)
            at_a += len(t)
            while at_b < at_a:
                j, u = next(y)
                held_b.append(j)
                at_b += len(u)
            if at_a == at_b:
                groups.append((held_a, held_b))
                held_a, held_b = [], []
        text_of = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        links = [(p, q) for x, z in groups for p in x for q in z]
        pairs.update(set(links))
        rows.append((key, len(tokens_a), len(tokens_b), [groups, links], hashlib.sha256(text_of.encode()).hexdigest()))
    best = {}
    for (p, _), n in pairs.items():
        best[p] = max(best.get(p, 0), n)
    out = []
    for key, n_a, n_b, found, digest in rows:
        groups, links = found or ([], [])
        out.append((key, n_a, n_b, len(groups), len(links), sum(pairs[x] == best[x[0]] for x in links), sum(pairs[x] for x in links), digest))
    return Counter(out)


def rows(df):
    return Counter(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect())


@pytest.mark.parametrize("known", [1 << 19, 30, 0])
def test_cases(spark, known):
    docs = [*enumerate(TEXTS), (3, "repeated id"), (None, "no id"), (None, "no id")]
    df = spark.createDataFrame([(k, t, "x", 7) for k, t in docs], "doc_id long, text string, pairs string, rid long")
    assert rows(alignment.cross(df, A, B, known)) == brute(docs)


def test_documents(spark, data):
    """Whole test documents; equal to the brute-force version whatever the number of known pairs."""
    df = spark.read.parquet(f"{data}/documents.parquet")
    expected = brute([tuple(r) for r in df.select("doc_id", "text").collect()])
    for known in (1 << 19, 500):
        assert rows(alignment.cross(df.repartition(3), A, B, known)) == expected


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id int, text string, n_a string")
    assert alignment.cross(df, A, B).collect() == []


def test_long_text(spark):
    """One text above 10 MB, with and without blanks, beside a short one."""
    long = "many words in one text " * 450_000
    docs = [(1, long), (2, "z" * 3000 + " end"), (3, long[:50])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in alignment.cross(df, A, B).collect()}
    assert got[1]["n_groups"] >= 5 * 450_000 and got[1]["n_links"] >= got[1]["n_groups"] and got[2]["n_a"] > 0


def test_generations():
    """Units that leave the table and come back give the same rows."""
    texts = [" ".join(f"w{i % 97}x{i % 31} y" for i in range(k, k + 200)) for k in range(40)]
    small, large = alignment.Aligner(A, B, limit=4000), alignment.Aligner(A, B)
    plain = lambda rows: [(*r[:5], r[5].tolist(), r[6].tolist()) for r in rows]
    assert [plain(small([t]))[0] for t in texts] == plain(large(texts))
    assert plain(large(texts)) == plain([(lambda f: alignment._row(f.n_a[0], f.n_b[0], f.n_groups[0], f.n_links[0], f.lines[0], f.pairs, f.weights))(large.tokens([b" " + t.encode()])) for t in texts])
