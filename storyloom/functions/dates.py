"""Publication times from the strings that feeds write."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zone names of mail dates, in minutes from UTC. Other names don't tell a zone.
ZONES = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420,
}

MAIL = r"(?i)^\s*(?:[a-z]+,?\s+)?(\d{1,2})[\s-]+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[\s-]+(\d{4}|\d{2})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([a-z]+|[+-]\d{4})?(?:\s*\(.*\))?\s*$"
ISO = r"^\s*(\d{4})-(\d{2})-(\d{2})(T| )(\d{2}):(\d{2}):(\d{2})(Z|[+-]\d{2}:?\d{2})?\s*$"


def _at(*parts: Column) -> Column:
    """A timestamp from year, month, day, hour, minute, second as text, or null if there is none."""
    y, mo, d, h, mi, s = parts
    two = lambda c: F.lpad(c, 2, "0")
    text = F.concat(F.lpad(y, 4, "0"), F.lit("-"), two(mo), F.lit("-"), two(d), F.lit(" "), two(h), F.lit(":"), two(mi), F.lit(":"), two(s))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))


def _offset(zone: Column) -> Column:
    """Minutes of +hhmm or +hh:mm."""
    digits = F.replace(zone, F.lit(":"), F.lit(""))
    minutes = F.substring(digits, 2, 2).cast("int") * 60 + F.substring(digits, 4, 2).cast("int")
    return F.when(digits.startswith("-"), -minutes).otherwise(minutes)


def _utc(local: Column, minutes: Column, default_tz: Column) -> Column:
    """A local time less its offset; without one it is of the default zone."""
    shifted = F.timestamp_micros(F.unix_micros(local) - minutes.cast("long") * 60_000_000)
    return F.when(minutes.isNull(), F.to_utc_timestamp(local, default_tz)).otherwise(shifted)


def parse_date(raw: Column, default_tz: Column) -> Column:
    """A mail date or one of the explicit forms as a UTC timestamp; null if it is none of them.

    Sessions must run in UTC. Times without a zone are of default_tz, and so are those with a zone
    name that tells none or with -0000.
    """
    g = lambda k: F.regexp_extract(raw, MAIL, k)
    month = _month(g(2)).cast("string")
    short = g(3).cast("int")
    year = F.when(F.length(g(3)) == 2, F.when(short < 69, short + 2000).otherwise(short + 1900)).otherwise(short).cast("string")
    zone = F.upper(g(7))
    named = F.element_at(F.create_map(*(F.lit(x) for kv in ZONES.items() for x in kv)), zone)
    minutes = F.when(zone.rlike(r"^[+-]\d{4}$") & (zone != "-0000"), _offset(zone)).otherwise(named)
    second = F.when(g(6) == "", "0").otherwise(g(6))
    mail = F.when(raw.rlike(MAIL), _utc(_at(year, month, g(1), g(4), g(5), second), minutes, default_tz))
    i = lambda k: F.regexp_extract(raw, ISO, k)
    iso_minutes = F.when(i(8) == "Z", 0).when(i(8) != "", _offset(i(8)))
    iso_local = _at(i(1), i(2), i(3), i(5), i(6), i(7))
    # A zone belongs to the form with T only.
    iso = F.when(raw.rlike(ISO) & ((i(4) == "T") | (i(8) == "")), _utc(iso_local, iso_minutes, default_tz))
    return F.coalesce(mail, iso)


def _month(name: Column) -> Column:
    at = F.position(F.lower(name), F.lit("janfebmaraprmayjunjulaugsepoctnovdec"))
    return ((at + 2) / 3).cast("int")


def published(parsed: list[Column], raw: list[Column], default_tz: Column) -> Column:
    """The first known time of parsed ones (UTC), then of raw strings, in order."""
    return F.coalesce(*parsed, *(parse_date(r, default_tz) for r in raw))


def age_hours(ts: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 3_600_000_000.0
