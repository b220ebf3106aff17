"""Web search as a table: what is asked for in filters goes into the requests.

    spark.dataSource.register(web_search.source(client))
    spark.read.format("web_search").load().filter("query = 'solar' and country = 'de' and rank <= 5")

Columns: query, country, time_range, domain (a requested source domain), rank, title, url,
content, score, error.  A filter on query (equal or in) is needed; filters on country,
time_range, domain (equal or in) and rank (at most) narrow the request; all others stay with
Spark.  Each query is a request of its own in a task of its own.  A response without a
results array gives one row with ``error``.  What is pushed belongs to the loaded table, so
each branch of a plan loads its own.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual

from lodestral.sources.fetch import search_payload, with_retry

SCHEMA = "query string, country string, time_range string, domain string, rank int, title string, url string, content string, score double, error string"
#: Most results that are asked for where no filter says less.
MOST = 10


class _Query(InputPartition):
    def __init__(self, query: str):
        super().__init__(query)
        self.query = query


class _Reader(DataSourceReader):
    def __init__(self, client: Callable[[dict], dict]):
        self.client, self.queries, self.domains, self.most = client, None, None, MOST
        self.fixed: dict[str, str] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self._push(f):
                yield f

    def _push(self, f: Filter) -> bool:
        """True if the request takes care of a filter; a second one on the same column stays with Spark."""
        name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
        wanted = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
        if name == "rank" and isinstance(f, LessThanOrEqual | LessThan):
            self.most = min(self.most, f.value - isinstance(f, LessThan))
            return self.most > 0  # none at all is left to Spark
        if wanted is None or not all(isinstance(v, str) for v in wanted):
            return False
        if name == "query" and self.queries is None:
            self.queries = sorted(set(wanted))
        elif name == "domain" and self.domains is None:
            self.domains = sorted(set(wanted))
        elif name in ("country", "time_range") and name not in self.fixed and len(wanted) == 1:
            self.fixed[name] = wanted[0]
        else:
            return False
        return True

    def partitions(self) -> list[InputPartition]:
        if self.queries is None:
            raise ValueError("web_search needs a filter on query")
        return [_Query(q) for q in self.queries if q.strip()]

    def read(self, partition: _Query) -> Iterator[tuple]:
        country, time_range = self.fixed.get("country"), self.fixed.get("time_range")
        head = partition.query, country, time_range
        for domain in self.domains or [None]:
            payload = search_payload(partition.query, max(self.most, 1), country, time_range, None if domain is None else [domain])
            answer = with_retry(self.client, {"body": payload})
            rows, error = _items(answer)
            if error:
                yield *head, domain, None, None, None, None, None, error
            for rank, item in rows:
                if rank <= max(self.most, 1):
                    yield *head, domain, rank, item["title"], item["url"], _text(item, "content"), _number(item, "score"), None


def _text(item: dict, key: str) -> str | None:
    return item.get(key) if isinstance(item.get(key), str) else None


def _number(item: dict, key: str) -> float | None:
    value = item.get(key)
    return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else None


def _items(answer: dict) -> tuple[list[tuple[int, dict]], str | None]:
    """Ranked items with a title and a url, and an error."""
    if answer.get("transport_error"):
        return [], "transport"
    if not 200 <= (answer.get("status") or 0) < 300:
        return [], f"http_status {answer.get('status')}"
    try:
        results = json.loads(answer.get("body") or b"")["results"]
    except (ValueError, KeyError, TypeError):
        return [], "invalid_response"
    if not isinstance(results, list):
        return [], "invalid_response"
    return [(k, i) for k, i in enumerate(results, 1) if isinstance(i, dict) and _text(i, "title") is not None and _text(i, "url") is not None], None


def source(client: Callable[[dict], dict], name: str = "web_search") -> type[DataSource]:
    """A data source class that asks ``client``, a function of {"body": JSON} that gives status and body."""

    class WebSearch(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(client)

    return WebSearch


@contextmanager
def pushdown(spark: SparkSession) -> Iterator[None]:
    """Filters reach Python data sources inside; the session's setting is put back.  Plans are made when they are first run."""
    name = "spark.sql.python.filterPushdown.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, old)
