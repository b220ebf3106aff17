"""HTTP and search connectors with an injected client.

A client is a function of one request dict that returns a response dict; it is shipped to
the executors.  Rows of one host lie in one task, or in a few that share its load between
them, so a host sees bounded load.  Results should be stored before they are used twice:
a retried task fetches again.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lodestral.functions import urls
from lodestral.functions.values import media_type

RESPONSE = "url string, status int, final_url string, content_type string, etag string, last_modified string, body binary, transport_error string, attempt_count int"
_NAMES = [c.split()[0] for c in RESPONSE.split(", ")]


class TransportError(Exception):
    pass


def with_retry(client: Callable[[dict], dict], request: dict, attempts: int = 2, delay: float = 0.1) -> dict:
    """The response with attempt_count; the last error is data, not an exception."""
    out: dict = {}
    for attempt in range(1, attempts + 1):
        try:
            out = dict(client(request)) | {"transport_error": None}
        except TransportError as e:
            out = {"transport_error": str(e)}
        out["attempt_count"] = attempt
        status = out.get("status")
        if not (out["transport_error"] or status in (408, 425, 429) or (status or 0) >= 500):
            break
        if attempt < attempts:
            time.sleep(delay)
    return out


class _Share:
    """A task's share of one host's load: so many requests in flight, and so many a second from a token bucket."""

    def __init__(self, flights: int, rate: float | None):
        self.room, self.rate, self.lock = threading.Semaphore(flights), rate, threading.Lock()
        self.tokens, self.at = float(flights), time.monotonic()

    def __enter__(self) -> None:
        self.room.acquire()
        if self.rate is None:
            return
        with self.lock:  # a token that isn't there yet is waited for
            now = time.monotonic()
            self.tokens = min(self.tokens + (now - self.at) * self.rate, 1.0 + self.rate) - 1
            self.at, wait = now, max(0.0, -self.tokens / self.rate)
        time.sleep(wait)

    def __exit__(self, *_) -> None:
        self.room.release()


def fetch(
    requests: DataFrame, client: Callable[[dict], dict], concurrency: int = 4, attempts: int = 2, delay: float = 0.1, tasks: int | None = None,
    host_tasks: int = 1, rate: float | None = None
) -> DataFrame:
    """Responses of (url, if_none_match, if_modified_since).

    A host sees ``concurrency`` requests at a time at most, and ``rate`` a second where one is
    given.  Its URLs go to ``host_tasks`` tasks (no more than ``concurrency``), each of which
    has an equal share of both, so a host with many URLs is spread without more load on it.
    Shares belong to a slice of a host's URLs, wherever slices meet in one task.
    """
    n = tasks or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, min(host_tasks, concurrency))
    flights, pace = concurrency // slices, None if rate is None else rate / slices
    host = urls.netloc(F.col("url"))
    dealt = requests.select("url", "if_none_match", "if_modified_since", F.concat_ws("#", host, F.pmod(F.xxhash64("url"), F.lit(slices))).alias("slice")).repartition(n, "slice")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shares: dict[str, _Share] = {}

        def one(r: dict) -> dict:
            def asked(request: dict) -> dict:
                with shares[r["slice"]]:
                    return client(request)

            request = {k: r[k] for k in ("url", "if_none_match", "if_modified_since")}
            return {"url": r["url"], "final_url": r["url"]} | with_retry(asked, request, attempts, delay)

        with ThreadPoolExecutor(concurrency) as pool:
            for part in parts:
                rows = part.astype(object).where(part.notna(), None).to_dict("records")
                for r in rows:
                    shares.setdefault(r["slice"], _Share(flights, pace))
                answers = pool.map(one, rows)
                yield pd.DataFrame([{k: a.get(k) for k in _NAMES} for a in answers], columns=_NAMES).astype({"status": "Int32", "attempt_count": "Int32"})

    return dealt.mapInPandas(run, RESPONSE)


def conditional_requests(endpoints: DataFrame, state: DataFrame) -> DataFrame:
    """(url, if_none_match, if_modified_since) from saved validators."""
    known = state.select("url", F.col("etag").alias("if_none_match"), F.col("last_modified").alias("if_modified_since"))
    return endpoints.select("url").distinct().join(known, "url", "left")


def response_state(responses: DataFrame, state: DataFrame) -> DataFrame:
    """Validators and content after a fetch: 304 keeps them, 2xx replaces them, null included."""
    saved = state.select("url", F.col("etag").alias("o_etag"), F.col("last_modified").alias("o_lm"), F.col("content").alias("o_content"))
    j, same = responses.join(saved, "url", "left"), F.col("status") == 304
    error = F.when(F.col("transport_error").isNotNull(), "transport").when(same & F.col("o_content").isNull(), "304 without content").when(
        ~(same | F.col("status").between(200, 299)), F.concat(F.lit("http_status "), F.col("status").cast("string"))
    )
    pick = lambda new, old: F.when(same, F.col(old)).otherwise(F.col(new)).alias(new)
    return j.select(
        "url", "final_url", pick("etag", "o_etag"), pick("last_modified", "o_lm"), F.when(same, F.col("o_content")).otherwise(F.col("body")).alias("content"),
        media_type(F.col("content_type")).alias("media_type"), error.alias("error")
    )


def documents_or_fetch(requests: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): active stored documents for requested URLs, and requests to fetch."""
    asked = requests.withColumn("canonical_url", urls.normalize(F.col("url")))
    active = snapshot.filter("status = 'active'").select("canonical_url", F.col("title").alias("doc_title"), "text", "published_at", F.col("id").alias("document_id"))
    hits = asked.join(active, "canonical_url").withColumn("title", F.coalesce("doc_title", "title", "url")).drop("doc_title")
    return hits, asked.join(active, "canonical_url", "left_anti")


def search_payload(query: str, max_results: int = 10, region: str | None = None, time_range: str | None = None, source_domains: list[str] | None = None) -> str:
    """JSON request of a web search; what is None is left out."""
    given = {"query": query, "max_results": max_results, "country": region, "time_range": time_range, "include_domains": source_domains}
    return json.dumps({k: v for k, v in given.items() if v is not None})


def search_requests(query: Column, max_results: Column, region: Column, time_range: Column, source_domains: Column) -> Column:
    """``search_payload`` of every row; what is null is left out."""
    fields = {"query": query, "max_results": max_results, "country": region, "time_range": time_range, "include_domains": source_domains}
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))


def parse_search(responses: DataFrame) -> DataFrame:
    """(request_id, rank, title, url, content, score) of JSON responses; gaps in rank stay.

    Items without a string title or url are skipped; a response without a results array
    gives one row with ``error``.
    """
    body = F.try_parse_json("response")
    items = F.try_variant_get(body, "$.results", "array<variant>")
    rows = responses.select("request_id", F.posexplode_outer(items).alias("at", "item"), items.isNull().alias("bad"))
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get("item", path, "variant")) == "STRING", F.try_variant_get("item", path, "string"))
    out = rows.select(
        "request_id", (F.col("at") + 1).alias("rank"), text("$.title").alias("title"), text("$.url").alias("url"), text("$.content").alias("content"),
        F.try_variant_get("item", "$.score", "double").alias("score"), F.when(F.col("bad"), "invalid_response").alias("error")
    )
    return out.filter("error is not null or (title is not null and url is not null)")
