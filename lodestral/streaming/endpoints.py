"""Feeds and sitemaps as a stream: offsets are the endpoints' validators, so a restart reads changed ones only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lodestral.sources.fetch import with_retry

SCHEMA = "url string, etag string, last_modified string, content binary, error string"


class _Endpoint(InputPartition):
    def __init__(self, url: str):
        super().__init__(url)
        self.url = url


class _Reader(DataSourceStreamReader):
    """An offset is {url: [etag, last_modified, failed]} of all endpoints; the driver asks for validators, tasks for contents."""

    def __init__(self, client: Callable[[dict], dict], urls: list[str]):
        self.client, self.urls, self.known = client, urls, {}

    def _get(self, url: str, known: list | None = None) -> dict:
        etag, modified = (known or [None, None])[:2]
        return with_retry(self.client, {"url": url, "if_none_match": etag, "if_modified_since": modified})

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for url in self.urls:
            answer = self._get(url, self.known.get(url))
            status = answer.get("status") or 0
            if 200 <= status < 300:
                self.known[url] = [answer.get("etag"), answer.get("last_modified"), False]
            elif status != 304 or url not in self.known:  # a failure is told once, until the endpoint answers again
                self.known[url] = [None, None, True]
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Endpoint(url) for url, state in sorted(end.items()) if start.get(url) != state]

    def read(self, partition: _Endpoint) -> Iterator[tuple]:
        answer = self._get(partition.url)
        status = answer.get("status") or 0
        good = 200 <= status < 300
        error = None if good else "transport" if answer.get("transport_error") else f"http_status {status}"
        yield partition.url, answer.get("etag"), answer.get("last_modified"), answer.get("body") if good else None, error


def source(client: Callable[[dict], dict], name: str = "endpoints") -> type[DataSource]:
    """A data source class that fetches with ``client``; register it and read it as a stream with the option ``urls`` (a line each).

    Endpoints are those of a registry, a list kept by hand.  Endpoints without validators are
    taken to be unchanged while they answer.
    """

    class Endpoints(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Reader(client, [u for u in self.options.get("urls", "").split("\n") if u])

    return Endpoints


def stream(spark: SparkSession, client: Callable[[dict], dict], urls: list[str], name: str = "endpoints") -> DataFrame:
    """The stream of (url, etag, last_modified, content, error) of endpoints whose validators have changed."""
    spark.dataSource.register(source(client, name))
    return spark.readStream.format(name).option("urls", "\n".join(urls)).load()
