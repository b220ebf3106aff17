"""Crawl permission: robots rules as a table, longest match by join."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from lodestral.functions import urls


def parse_rules(body: str, agent: str) -> list[tuple[bool, str]]:
    """(allow, path pattern) of the groups of the most specific matching agent."""
    groups: list[tuple[list[str], list[tuple[bool, str]]]] = []
    open_ = False
    for line in body.splitlines():
        name, colon, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            if not open_:
                groups.append(([], []))
            groups[-1][0].append(value.lower())
            open_ = True
        elif name in ("allow", "disallow"):
            open_ = False
            if groups and value:
                groups[-1][1].append((name == "allow", value))
        else:
            open_ = False
    product = agent.split("/", 1)[0].lower()
    names = [a for g, _ in groups for a in g if a != "*" and a and product.startswith(a)]
    best = max(names, key=len, default="*")
    return [r for g, rules in groups if best in g for r in rules]


def pattern_regex(pattern: str) -> str:
    """Regular expression of a path pattern with * and a closing $."""
    closed = pattern.endswith("$")
    body = ".*".join(map(re.escape, (pattern[:-1] if closed else pattern).split("*")))
    return f"^{body}{'$' if closed else ''}"


def rules(robots: DataFrame, agent: str) -> DataFrame:
    """(origin, allow, pattern, regex) of the 2xx robots files (origin, status, body)."""

    @F.pandas_udf("array<struct<allow:boolean,pattern:string,regex:string>>")
    def parse(bodies: pd.Series) -> pd.Series:
        return pd.Series([[{"allow": a, "pattern": p, "regex": pattern_regex(p)} for a, p in parse_rules(b or "", agent)] for b in bodies], dtype=object)

    good = robots.filter("status BETWEEN 200 AND 299")
    return good.select("origin", F.explode(parse("body")).alias("r")).select("origin", "r.*")


def status_decision(status):
    """Decision where no rules apply: by HTTP status; null is a transport error."""
    return F.when(status.between(200, 299), "allowed").when(status.isin(404, 410), "allowed").when(status.isin(401, 403), "disallowed").otherwise("deferred")


def origin_key(url):
    return F.concat(urls.scheme(url), F.lit("://"), urls.host(url), F.lit(":"), F.coalesce(urls.port(url).cast("string"), F.lit("")))


def literal(pattern):
    """What a path must begin with for a pattern to match: the pattern up to its first * or closing $."""
    return F.regexp_replace(F.regexp_extract(pattern, r"^[^*]*", 0), r"\$$", "")


def matches(rows: DataFrame, rule_table: DataFrame, key: list[str]) -> DataFrame:
    """(key, allow, pattern) of the rules that hold for rows of (key, origin, target).

    Rules are found by their literal beginnings: a target is looked up once for each length
    that the beginnings of its origin have, so a host with thousands of rules costs as many
    lookups as there are lengths.  Only what begins alike is matched by expression.
    """
    heads = rule_table.select("origin", "allow", "pattern", "regex", literal(F.col("pattern")).alias("head"))
    lengths = heads.groupBy("origin").agg(F.collect_set(F.length("head")).alias("lengths"))  # as many as a path has characters
    fit = F.filter("lengths", lambda n: n <= F.length("target"))
    asked = rows.join(lengths, "origin").select(*key, "origin", "target", F.explode(fit).alias("n")).withColumn("head", F.col("target").substr(F.lit(1), F.col("n")))
    plain = F.col("pattern") == F.col("head")
    return asked.join(heads, ["origin", "head"]).filter(plain | F.regexp_like("target", F.col("regex"))).select(*key, "allow", "pattern")


def decide(rows: DataFrame, robots: DataFrame, rule_table: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``decision`` to (key, url): the longest matching rule, allow on ties."""
    base = rows.withColumn("origin", origin_key(F.col("url")))
    target = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^#]*)", 1)
    target = F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target))
    hits = matches(base.select(*key, "origin", target.alias("target")), rule_table, key)
    best = hits.withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy(F.length("pattern").desc(), F.col("allow").desc()))).filter("n = 1").select(*key, "allow")
    joined = base.join(robots.select("origin", "status").dropDuplicates(["origin"]), "origin", "left").join(best, key, "left")
    ok = F.col("status").between(200, 299)
    decision = F.when(~urls.robots_target(F.col("url")), "disallowed").when(
        ok & F.col("allow").isNotNull(), F.when(F.col("allow"), "allowed").otherwise("disallowed")
    ).otherwise(status_decision(F.col("status")))
    return joined.withColumn("decision", decision).drop("status", "allow", "origin")
