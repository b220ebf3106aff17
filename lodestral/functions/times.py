"""Dates from outside, as Column functions; the session time zone is taken to be UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lodestral.functions.urls import strip

_OFFSET = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?(Z|[+-]\d{2}:?\d{2}(:?\d{2})?)$"
_MAIL = r"(?i)^(?:[a-z]{3},?\s+)?(\d{1,2}\s+[a-z]{3}\s+\d{4}\s+\d{2}:\d{2}(?::\d{2})?)\s+([+-]\d{4}|[A-Z]{1,3})$"
# Zone names of mail dates.
ZONES = {
    "GMT": "+0000", "UT": "+0000", "UTC": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600",
    "PST": "-0800", "PDT": "-0700"
}


def external(c: Column) -> Column:
    """ISO date (midnight), ISO date-time with offset or RFC 2822 date; naive, odd or outside the years 1 to 9999: null."""
    value = strip(c)
    iso = F.when(value.rlike(_OFFSET), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(value, ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2")))
    day = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(value, F.lit("yyyy-MM-dd")))
    clock = F.initcap(F.regexp_replace(F.regexp_extract(value, _MAIL, 1), r"\s+", " "))
    zone = F.regexp_extract(value, _MAIL, 2)
    named = F.create_map(*(F.lit(x) for pair in ZONES.items() for x in pair))
    zone = F.when(zone == "-0000", None).when(zone.rlike("^[+-]"), zone).otherwise(F.get(F.array(F.element_at(named, F.upper(zone))), F.lit(0)))
    mail = F.when(
        (clock != "") & zone.isNotNull(),
        F.coalesce(
            F.try_to_timestamp(F.concat_ws(" ", clock, zone), F.lit("d MMM yyyy HH:mm:ss Z")),
            F.try_to_timestamp(F.concat_ws(" ", clock, zone), F.lit("d MMM yyyy HH:mm Z"))
        ),
    )
    found = F.coalesce(iso, day, mail)
    return F.when(F.year(found).between(1, 9999), found)


def published_at(fetched: Column, *candidates: Column) -> Column:
    """The first candidate that is at most 24 hours after the fetch."""
    return F.coalesce(*(F.when(c <= fetched + F.expr("INTERVAL 24 HOURS"), c) for c in candidates))
