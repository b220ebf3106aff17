from urllib.parse import parse_qsl, urlencode, urlsplit

import pytest
from pyspark.sql import functions as F

from lodestral.functions import times, urls, values


def reference_normal_form(url, ignored=()):
    s = urlsplit(url.strip())
    q = urlencode(sorted((k, v) for k, v in parse_qsl(s.query, keep_blank_values=True) if k not in ignored))
    return (f"{s.scheme.lower()}:" if s.scheme else "") + (f"//{s.netloc.lower()}" if s.netloc else "") + (s.path.rstrip("/") or "/") + (f"?{q}" if q else "")


URLS = [
    "HTTP://WWW.A.com:80/x/y//?b=2&a=1&a=0#f", " https://u:p@h.org ", "http://a.com?x=%7E*%zz&y=a+b&utm_source=q", "//x.y/z", "mailto:a@b", "http://a.com/p?q=é&empty=&k",
    "/rel?x=1&&y", "http://[::1]:80/a", "https://a_b.com./", "http://a.com/%zz/b?%41=%42", "http://a.com/?a=%E2%82%AC&a=~-_.*",
]


@pytest.mark.parametrize("ignored", [(), ("utm_source", "a")])
def test_normalize(spark, ignored):
    rows = spark.createDataFrame([(u,) for u in URLS], "u string").select("u", urls.normalize(F.col("u"), ignored).alias("n")).collect()
    assert {r["u"]: r["n"] for r in rows} == {u: reference_normal_form(u, ignored) for u in URLS}


def test_predicates(spark):
    cases = {"http://a.com/": (True, True), "https://u:p@a.com": (True, False), "https://a.com.": (True, False), "ftp://a.com": (False, False), "mailto:x@y": (False, False), "http:///x": (False, False), "": (False, False), None: (False, False)}
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", urls.fetchable(F.col("u")).alias("f"), urls.strict_http(F.col("u")).alias("s")).collect()
    assert {r["u"]: (r["f"], r["s"]) for r in rows} == cases


def test_domains(spark):
    rows = spark.createDataFrame([("https://www.News.example.com:8080/a",), ("x",)], "u string").select(urls.publisher_domain(F.col("u")).alias("d"), urls.publisher_home(F.col("u")).alias("h"), urls.port(F.col("u")).alias("p")).collect()
    assert [tuple(r) for r in rows] == [("news.example.com", "https://www.news.example.com:8080", 8080), ("", None, None)]
    good = {"a.com": True, "a-b.co.uk": True, "a": False, "-a.com": False, "a.com.": False, "http://a.com": False, "x" * 64 + ".com": False}
    rows = spark.createDataFrame([(d,) for d in good], "d string").select("d", urls.bare_domain(F.col("d")).alias("x")).collect()
    assert {r["d"]: r["x"] for r in rows} == good


def test_resolve(spark):
    row = spark.createDataFrame([("https://a.com/x/feed.xml", "../y?z=1")], "b string, v string").select(urls.resolve("b", "v").alias("u")).first()
    assert row["u"] == "https://a.com/y?z=1"


def test_dates(spark):
    cases = {
        "2024-01-02": "2024-01-02 00:00:00", "2024-01-02T03:04:05Z": "2024-01-02 03:04:05", "2024-01-02T03:04:05+02:00": "2024-01-02 01:04:05", "2024-01-02T03:04:05": None,
        "Tue, 02 Jan 2024 03:04:05 GMT": "2024-01-02 03:04:05", "2 Jan 2024 03:04 +0100": "2024-01-02 02:04:00", "soon": None, "": None, None: None,
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", times.external(F.col("t")).cast("string").alias("x")).collect()
    assert {r["t"]: r["x"] for r in rows} == cases


def test_values(spark):
    row = spark.range(1).select(
        values.media_type(F.lit(" Text/HTML ; charset=x")).alias("m"), values.citations(F.lit("a [S2] b [S1][S2] [S0] [S01] [S11]")).alias("c"), values.without_thoughts(F.lit("<think>a\nb</think> yes ")).alias("w"),
        values.ratio(F.lit(1), F.lit(0)).alias("r"), values.ratio(F.lit(1), F.lit(3)).alias("q"), values.token_count(F.lit(" a  b\nc ")).alias("t"), values.retryable_status(F.lit(503)).alias("s"), values.retryable_status(F.lit(404)).alias("n"),
        values.content_hash(F.lit(None).cast("string")).alias("h"), values.blank_to_null(F.lit(" \t")).alias("b"),
    ).first()
    assert tuple(row) == ("text/html", [2, 1, 11], "yes", 0.0, 0.3333, 3, True, False, None, None)


def test_claims(spark):
    cases = {'```json\n{"claims":[{"a":1}]}\n```': '[{"a":1}]', "[1]": "[1]", '{"claims":[1],"x":2}': None, "zz": None, "```python\n[1]\n```": None}
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", F.to_json(values.claims(F.col("t"))).alias("c")).collect()
    assert {r["t"]: r["c"] for r in rows} == cases


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), (None,)], "v array<double>").select(values.valid_vector(F.col("v"), 2).alias("x")).collect()
    assert [r["x"] for r in rows] == [True, False, False, False, False]
