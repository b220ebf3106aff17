"""Feeds and sitemaps to discovered URLs."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodestral.functions import times, urls


class DiscoveryError(ValueError):
    pass


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _root(content: bytes) -> ET.Element:
    head = content.upper()
    if b"<!DOCTYPE" in head or b"<!ENTITY" in head:
        raise DiscoveryError("document types and entities are not allowed")
    try:
        return ET.fromstring(content)
    except ET.ParseError as e:
        raise DiscoveryError(f"malformed XML: {e}") from e


def _child(node: ET.Element, *names: str) -> str | None:
    for name in names:
        for c in node:
            if _local(c.tag) == name and c.text and c.text.strip():
                return c.text.strip()
    return None


def parse_feed(base: str, content: bytes) -> list[tuple[str, str | None]]:
    """(url, date as written) of Atom entries, or of RSS or RDF items."""
    root = _root(content)
    kind, out = _local(root.tag), []
    if kind == "feed":
        for entry in (c for c in root if _local(c.tag) == "entry"):
            links = [c.get("href") for c in entry if _local(c.tag) == "link" and (c.get("rel") or "alternate") == "alternate" and c.get("href")]
            if links:
                out.append((urljoin(base, links[0].strip()), _child(entry, "published")))
    elif kind in ("rss", "RDF"):
        for item in (n for n in root.iter() if _local(n.tag) == "item"):
            if link := _child(item, "link"):
                out.append((urljoin(base, link), _child(item, "pubDate", "date")))
    else:
        raise DiscoveryError(f"not a feed: {kind}")
    return out


def parse_sitemap(base: str, content: bytes) -> list[tuple[str, str]]:
    """(kind, url): content of a urlset, sitemap of a sitemapindex; lastmod is not a date of publication."""
    root = _root(content)
    kinds = {"urlset": ("url", "content"), "sitemapindex": ("sitemap", "sitemap")}
    if _local(root.tag) not in kinds:
        raise DiscoveryError(f"not a sitemap: {_local(root.tag)}")
    item, kind = kinds[_local(root.tag)]
    return [(kind, urljoin(base, loc)) for n in root if _local(n.tag) == item and (loc := _child(n, "loc"))]


def parse_endpoints(endpoints: DataFrame) -> DataFrame:
    """Rows of (endpoint_url, kind feed or sitemap, content); a bad document is one row with error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for url, kind, content in zip(part["endpoint_url"], part["kind"], part["content"]):
                try:
                    if kind == "feed":
                        rows += [(url, "content", u, d, i, None) for i, (u, d) in enumerate(parse_feed(url, bytes(content)))]
                    else:
                        rows += [(url, k, u, None, i, None) for i, (k, u) in enumerate(parse_sitemap(url, bytes(content)))]
                except DiscoveryError as e:
                    rows.append((url, kind, None, None, 0, str(e)))
            yield pd.DataFrame(rows, columns=["endpoint_url", "kind", "url", "written", "ord", "error"])

    found = endpoints.select("endpoint_url", "kind", "content").mapInPandas(run, "endpoint_url string, kind string, url string, written string, ord int, error string")
    return found.select("endpoint_url", "kind", "url", times.external(F.col("written")).alias("published_at"), "ord", "error")


def merge(discovered: DataFrame, *keys: str) -> DataFrame:
    """First place of each normalised URL; the date is the first that is known."""
    valid = discovered.filter(urls.strict_http(F.col("url"))).withColumn("normalized_url", urls.normalize(F.col("url")))
    return valid.groupBy(*keys, "normalized_url").agg(
        F.min("ord").alias("ord"), F.min_by("url", "ord").alias("url"),
        F.min_by("published_at", F.when(F.col("published_at").isNotNull(), F.col("ord"))).alias("published_at")
    )
