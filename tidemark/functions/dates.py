"""Dates in payloads and free text, as column expressions: when a market will be resolved."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of fields that hold the resolution, of payloads that may hold these fields, of texts, of months.
RESOLUTION = ["resolution_ts", "close_ts", "end_ts", "resolved_ts", "resolution_time", "close_time", "end_time", "resolve_date"]
NESTED = ["metadata", "meta", "raw", "rule_parse_json"]
TEXTS = ["question", "title", "slug", "description"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_MONTH = f"({'|'.join(MONTHS)})"
_ISO = r"\b(20[0-9]{2})[-_/](0[1-9]|1[0-2])[-_/](0[1-9]|[12][0-9]|3[01])\b"
_FAR = 400 * 86400


def as_utc(c: Column) -> Column:
    """A time without zone is taken as UTC (the session's zone should be UTC)."""
    return c.cast("timestamp")


def instant(text: Column) -> Column:
    """The time in a string: seconds since 1970, milliseconds if over 1e10, or ISO 8601 with or without a zone; null for
    anything else, and for numbers that are not positive."""
    t = F.trim(text)
    number = F.when(t.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), t.try_cast("double"))
    seconds = F.when(number > 10_000_000_000, number / 1000).when(number > 0, number)
    iso = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"), t.try_cast("timestamp"))
    return F.when(number.isNotNull(), F.timestamp_seconds(F.when(seconds < 253_402_300_800, seconds))).otherwise(iso)


def _date(year: Column, month: Column, day: Column) -> Column:
    """Midnight of a day, null for one that no calendar has."""
    return F.try_to_timestamp(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), F.lit("yyyy-MM-dd"))


def _groups(text: Column, pattern: str, n: int) -> list[Column]:
    return [F.regexp_extract(text, pattern, i + 1) for i in range(n)]


def _number(c: Column) -> Column:
    return c.try_cast("int")


def _month(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), c).cast("int")


def date_in_text(text: Column, now: Column | None = None) -> Column:
    """The first kind of date found: 2026-03-01, march 1, 2026, 1 march 2026, and with a decision time march 1 or 1
    march: the next such day, this year or the next, up to 400 days on. The first kind found settles it: if no calendar
    has that day the answer is null."""
    t = F.lower(F.trim(text))
    dmy, mdy = rf"\b([0-3]?[0-9])\s+{_MONTH},?\s+(20[0-9]{{2}})\b", rf"\b{_MONTH}\s+([0-3]?[0-9]),?\s+(20[0-9]{{2}})\b"
    md, dm = rf"\b{_MONTH}\s+([0-3]?[0-9])\b", rf"\b([0-3]?[0-9])\s+{_MONTH}\b"
    y, m, d = _groups(t, _ISO, 3)
    found = F.when(y != "", _date(_number(y), _number(m), _number(d)))
    m, d, y = _groups(t, mdy, 3)
    found = F.when(t.rlike(_ISO), found).when(m != "", _date(_number(y), _month(m), _number(d)))
    d, m, y = _groups(t, dmy, 3)
    kinds = [(t.rlike(_ISO), found), (t.rlike(mdy), found), (m != "", _date(_number(y), _month(m), _number(d)))]
    if now is not None:
        at = as_utc(now)

        def next_(month: Column, day: Column) -> Column:
            this = _date(F.year(at), month, day)
            then = F.when(this >= at, this).when(this < at, _date(F.year(at) + 1, month, day))
            return F.when(F.unix_micros(then) - F.unix_micros(at) <= _FAR * 1_000_000, then)

        m, d = _groups(t, md, 2)
        kinds.append((m != "", next_(_month(m), _number(d))))
        d, m = _groups(t, dm, 2)
        kinds.append((m != "", next_(_month(m), _number(d))))
    out = F.lit(None).cast("timestamp")
    for here, value in reversed(kinds):
        out = F.when(here, value).otherwise(out)
    return F.when(t.isNotNull() & (t != ""), out)


def resolution(payload: Column, now: Column | None = None) -> Column:
    """When the market of a JSON payload is resolved: the first of its fields that holds a time, then those of its nested
    payloads, then a date in its texts."""
    top = F.from_json(payload, "map<string,string>")
    inner = F.flatten(F.transform(F.transform(F.array(*map(F.lit, NESTED)), lambda k: F.from_json(F.try_element_at(top, k), "map<string,string>")), lambda m: F.transform(F.array(*map(F.lit, RESOLUTION)), lambda k: F.try_element_at(m, k))))
    fields = F.concat(F.transform(F.array(*map(F.lit, RESOLUTION)), lambda k: F.try_element_at(top, k)), inner)
    texts = F.transform(F.array(*map(F.lit, TEXTS)), lambda k: F.try_element_at(top, k))
    first = lambda a, f: F.get(F.filter(F.transform(a, f), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(first(fields, instant), first(texts, lambda t: date_in_text(t, now)))
