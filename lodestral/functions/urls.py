"""URL identity as Column functions (in the JVM, but for ``resolve``)."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, functions as F

#: Query keys that a run's URL identity leaves out.
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")

_SPLIT = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
# Fixed value: one label of a host name.
_LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
_WHITE = r"^[\s\u0085   -     　\x1C-\x1F]+|[\s\u0085   -     　\x1C-\x1F]+$"


def strip(c: Column) -> Column:
    """Trim all Unicode white space at both ends."""
    return F.regexp_replace(c, _WHITE, "")


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(strip(url), _SPLIT, i)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return F.lower(_part(url, 2))


def path(url: Column) -> Column:
    return _part(url, 3)


def host(url: Column) -> Column:
    """Lower-case host without user information and port; empty if there is none."""
    bare = F.regexp_replace(netloc(url), r"^.*@", "")
    return F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(bare, r":[0-9]*$", ""))


def port(url: Column) -> Column:
    """Explicit port, else that of http or https, else null."""
    given = F.regexp_extract(netloc(url), r":([0-9]+)$", 1)
    return F.when(given != "", given.cast("int")).when(scheme(url) == "http", 80).when(scheme(url) == "https", 443)


def user_info(url: Column) -> Column:
    return F.regexp_extract(netloc(url), r"^(.*)@", 1)


def _decode(c: Column) -> Column:
    """Percent-decoding in which malformed escapes stay literal."""
    return F.url_decode(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize(url: Column, ignored: Iterable[str] = ()) -> Column:
    """Canonical form: case, trailing slashes, order of query pairs; no fragment, no ignored keys."""
    drop = list(ignored)
    pieces = F.filter(F.split(_part(url, 4), "&"), lambda p: p != "")
    pairs = F.transform(
        pieces,
        lambda p: F.struct(
            _decode(F.regexp_extract(p, r"^([^=]*)", 1)).alias("k"),
            _decode(F.regexp_replace(p, r"^[^=]*=?", "")).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda p: ~p["k"].isin(drop)) if drop else pairs
    query = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")
    trimmed = F.regexp_replace(path(url), "/+$", "")
    return F.concat(
        F.when(scheme(url) != "", F.concat(scheme(url), F.lit(":"))).otherwise(""),
        F.when(netloc(url) != "", F.concat(F.lit("//"), netloc(url))).otherwise(""),
        F.when(trimmed == "", "/").otherwise(trimmed),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def fetchable(url: Column) -> Column:
    """http or https with a host; false for null or malformed."""
    return F.coalesce(scheme(url).isin("http", "https") & (host(url) != ""), F.lit(False))


def strict_http(url: Column) -> Column:
    """Fetchable, host not ending in a dot, no user information."""
    return fetchable(url) & ~F.coalesce(host(url).endswith("."), F.lit(False)) & ~F.coalesce(netloc(url).contains("@"), F.lit(False))


def robots_target(url: Column) -> Column:
    return fetchable(url) & ~F.coalesce(netloc(url).contains("@"), F.lit(False))


def publisher_domain(url: Column) -> Column:
    return F.regexp_replace(F.rtrim(host(url), F.lit(".")), r"^www\.", "")


def publisher_home(url: Column) -> Column:
    return F.when((scheme(url) != "") & (netloc(url) != ""), F.concat(scheme(url), F.lit("://"), netloc(url)))


def domain_key(domain: Column) -> Column:
    return F.regexp_replace(F.lower(strip(domain)), r"^www\.", "")


def bare_domain(domain: Column) -> Column:
    """Two labels or more, each of 63 characters at most, 253 in all."""
    return F.coalesce((F.length(domain) <= 253) & domain.rlike(rf"^{_LABEL}(?:\.{_LABEL})+$"), F.lit(False))


def origin(url: Column) -> Column:
    return F.struct(scheme(url).alias("scheme"), host(url).alias("host"), port(url).alias("port"))


def _joined(base: str | None, value: str | None) -> str | None:
    if base is None or value is None:
        return None
    try:
        return urljoin(base, value.strip())
    except ValueError:
        return None


def resolve(base: Column, value: Column) -> Column:
    """Relative reference against a base, batch by batch; no built-in function does this."""

    @F.pandas_udf("string")
    def run(bases: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([_joined(b, v) for b, v in zip(bases, values)], dtype=object)

    return run(base, value)
