"""Dates, offsets and intervals: literals on the driver, columns in Spark."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def parse_time_offset(text: str) -> int:
    """Milliseconds of `3w2d12h`, `-6h`, `5h-2m`, `1.5d`: signed, units s m h d w, fractions allowed."""
    if not re.fullmatch(r"(?:[+-]?\d+(?:\.\d+)?[smhdw])+", text):
        raise ValueError(f"not a time offset: {text!r}")
    total, sign = 0.0, 1
    for s, n, unit in re.findall(r"([+-]?)(\d+(?:\.\d+)?)([smhdw])", text):
        sign = {"+": 1, "-": -1}.get(s, sign)  # a sign holds until the next one
        total += sign * float(n) * _UNITS[unit]
    return round(total * 1000)


def parse_date(text: str) -> int:
    """Epoch milliseconds of yyyyMMdd with an optional HH, HHmm or HHmmss, am or pm, and zone (else UTC)."""
    m = re.fullmatch(r"(\d{8})(?:(\d{1,2})(\d\d)?(\d\d)?\s*(am|pm)?)?\s*(Z|UTC|GMT|[+-]\d{4})?", re.sub("[:/\\s_T-](?=\\d\\d(?:\\D|\\d|$))", "", text) if ":" in text else text, re.I)
    if not m:
        raise ValueError(f"not a date: {text!r}")
    day, hour, minute, second, half, zone = m.groups()
    h = int(hour or 0)
    if half:
        if not 1 <= h <= 12:
            raise ValueError(f"not an hour: {text!r}")
        h = h % 12 + (12 if half.lower() == "pm" else 0)
    at = datetime.strptime(day, "%Y%m%d").replace(tzinfo=timezone.utc)
    at = at.replace(hour=h, minute=int(minute or 0), second=int(second or 0))
    if zone and zone[0] in "+-":
        shift = int(zone[1:3]) * 60 + int(zone[3:])
        at -= timedelta(minutes=shift if zone[0] == "+" else -shift)
    return int(at.timestamp() * 1000)


def parse_interval(text: str) -> tuple[int, int]:
    """(start, end) in milliseconds of `START/OFFSET`; a negative offset ends at START."""
    start, offset = text.split("/", 1)
    a, d = parse_date(start), parse_time_offset(offset)
    return (a, a + d) if d >= 0 else (a + d, a)


def millis(at: Column) -> Column:
    return F.unix_millis(at)


def format_interval(milliseconds: Column) -> Column:
    """`1 days 2 hr 3 min 4 sec` without empty parts."""
    s = F.floor(milliseconds / 1000)
    parts = [
        F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {unit}")))
        for n, unit in (
            (F.floor(s / 86400), "days"),
            (F.floor(F.pmod(s, F.lit(86400)) / 3600), "hr"),
            (F.floor(F.pmod(s, F.lit(3600)) / 60), "min"),
            (F.pmod(s, F.lit(60)), "sec"),
        )
    ]
    return F.concat_ws(" ", *parts)


def short_message_time(text: Column) -> Column:
    """Timestamp of `Wed Aug 27 13:08:45 +0000 2008`: the weekday goes first, as Spark's parser has no text weekday."""
    return F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3} ", ""), F.lit("MMM dd HH:mm:ss Z yyyy"))


def fractional_year(date_text: Column) -> Column:
    """Year with a fraction of `Month D, YYYY`, `D Month YYYY`, `Month YYYY` or `YYYY`.

    A year is a leap year if 4 divides it; a day above 31 makes it null; a month
    alone stands at its first day.
    """
    months = "january february march april may june july august september october november december".split()
    t = F.lower(F.trim(date_text))
    mdy, dmy, my, y = r"^([a-z]+)\s+(\d{1,2}),?\s+(\d{4})$", r"^(\d{1,2})\s+([a-z]+),?\s+(\d{4})$", r"^([a-z]+),?\s+(\d{4})$", r"^(\d{4})$"
    name = F.coalesce(*[F.nullif(F.regexp_extract(t, p, g), F.lit("")) for p, g in ((mdy, 1), (dmy, 2), (my, 1))])
    day = F.coalesce(*[F.regexp_extract(t, p, g).try_cast("int") for p, g in ((mdy, 2), (dmy, 1))], F.lit(1))
    year = F.coalesce(*[F.regexp_extract(t, p, g).try_cast("int") for p, g in ((mdy, 3), (dmy, 3), (my, 2), (y, 1))])
    before, full, starts = [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334], F.lit(None).cast("int"), F.lit(None)
    for i, m in enumerate(months):
        starts = F.when(F.length(name).between(3, len(m)) & F.lit(m).startswith(name), before[i]).otherwise(starts)
        full = F.when(F.length(name).between(3, len(m)) & F.lit(m).startswith(name), i + 1).otherwise(full)
    leap = year % 4 == 0
    of_year = starts + F.when(leap & (full > 2), 1).otherwise(0) + day - 1
    whole = year + of_year / F.when(leap, 366).otherwise(365)
    return F.when(t.rlike(y), year.cast("double")).when(day.between(1, 31), whole)
