"""Lenient dates: a date part, a time part or both, with fields that roll over; times without a zone are UTC."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"
ZONES = {"utc": 0, "gmt": 0, "z": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "cet": 60, "cest": 120}

_N = r"[ \t]*-?\d+"
_MONTH = "|".join([*MONTHS, *(m[:3] for m in MONTHS)])
#: Date forms in the order in which they are tried; each takes what it can from the front.
DATES = tuple(
    re.compile(p, re.I)
    for p in (
        rf"(?P<y>{_N})-(?P<m>[ \t]*\d+)-(?P<d>[ \t]*\d+)T",
        rf"(?P<y>{_N})-(?P<m>[ \t]*\d+)-(?P<d>[ \t]*\d+)",
        rf"(?:{WEEKDAYS}), +(?P<name>{_MONTH}) +(?P<d>\d+), *(?P<y>{_N})",
        rf"(?P<name>{_MONTH}) +(?P<d>\d+), *(?P<y>{_N})",
        rf"(?P<m>[ \t]*\d+)/(?P<d>[ \t]*\d+)/(?P<short>{_N})",
        rf"(?P<y>{_N})-(?P<m>[ \t]*\d+)",
        rf"(?P<y>{_N})",
    )
)
_H, _HS = r"[ \t]*(?P<h>-?\d+):[ \t]*(?P<mi>-?\d+)", r"[ \t]*(?P<h>-?\d+):[ \t]*(?P<mi>-?\d+):[ \t]*(?P<s>-?\d+)"
_RFC, _NAMED = r"(?P<zone>[+-]\d{4}|[A-Z]{3,4})", r"[ ]+(?P<zone>(?:GMT|UTC)?[+-]\d{1,2}:?\d{2}|[A-Z]{1,4})"
_AMPM = r"[  ]*(?P<half>am|pm)"
TIMES = tuple(
    (re.compile(p, re.I), strict)
    for p, strict in (
        (rf"{_HS}\.(?P<ms>\d+)Z", True),
        (rf"{_HS}Z", True),
        (rf"{_H}Z", True),
        (rf"{_HS}\.(?P<ms>\d+){_RFC}", False),
        (rf"{_HS}{_RFC}", False),
        (rf"{_H}{_RFC}", False),
        (rf"{_HS}\.(?P<ms>\d+){_NAMED}", False),
        (rf"{_HS}{_NAMED}", False),
        (rf"{_H}{_NAMED}", False),
        (rf"{_HS}\.(?P<ms>\d+)", False),
        (_HS, False),
        (_H, False),
        (rf"{_HS}{_AMPM}{_NAMED}", False),
        (rf"{_HS}{_AMPM}", False),
        (rf"{_H}{_AMPM}", False),
    )
)
_COLON_ZONE = re.compile(r"([+-]\d\d):(\d\d)\Z")


def _days(year: int, month: int, day: int) -> int:
    """Days since 1970 by the Gregorian calendar; month and day may lie outside their range."""
    year, month = year + (month - 1) // 12, (month - 1) % 12 + 1
    y = year - (month <= 2)
    era, of_era = divmod(y, 400)
    of_year = (153 * ((month + 9) % 12) + 2) // 5
    return era * 146097 + of_era * 365 + of_era // 4 - of_era // 100 + of_year + day - 1 - 719468


def _zone(text: str) -> int | None:
    """Minutes east of UTC."""
    if m := re.fullmatch(r"(?:GMT|UTC)?([+-])(\d{1,2}):?(\d{2})", text, re.I):
        return (int(m[2]) * 60 + int(m[3])) * (-1 if m[1] == "-" else 1)
    return ZONES.get(text.lower())


def parse_millis(text: str | None) -> int | None:
    """Milliseconds since 1970; ValueError if the text is no date."""
    if text is None:
        return None
    text = _COLON_ZONE.sub(r"\1\2", text)
    at, date, time = 0, None, None
    for form in DATES:
        if m := form.match(text):
            g = m.groupdict()
            month = MONTHS.index(next(x for x in MONTHS if x.startswith(g["name"].lower()))) + 1 if g.get("name") else int(g.get("m") or 1)
            year = int(g["y"] if g.get("y") else g["short"])
            if g.get("short") and re.fullmatch(r"\d\d", g["short"].strip()):
                now = datetime.now(timezone.utc).year
                year += now // 100 * 100
                year -= 100 * (year > now + 20)
            date, at = _days(year, month, int(g.get("d") or 1)) * 86_400_000, m.end()
            break
    for form, strict in TIMES:
        if m := form.match(text, at):
            g = m.groupdict()
            h, mi, s, ms = (int(g.get(k) or 0) for k in ("h", "mi", "s", "ms"))
            if strict and not (0 <= h < 24 and 0 <= mi < 60 and 0 <= s < 60 and 0 <= ms < 1000):
                continue
            if g.get("half"):
                h = h % 12 + 12 * (g["half"].lower() == "pm")
            zone = _zone(g["zone"]) if g.get("zone") else 0
            if zone is None:
                continue
            time, at = ((h * 60 + mi - zone) * 60 + s) * 1000 + ms, m.end()
            break
    if (date is None and time is None) or at != len(text):
        raise ValueError(f"invalid date: {text}")
    return (date or 0) + (time or 0)


def parse(text: str | None) -> datetime | None:
    """As parse_millis, as a UTC datetime; ValueError too for years that Spark's timestamps can't hold."""
    ms = parse_millis(text)
    if ms is None:
        return None
    try:
        return EPOCH + timedelta(milliseconds=ms)
    except OverflowError as e:
        raise ValueError(f"date out of range: {text}") from e


def _millis(text: str | None) -> int | None:
    try:
        return parse_millis(text)
    except ValueError:
        return None


def lenient_millis(x) -> Column:
    """Milliseconds of a lenient date, null where it is none."""
    parse_one = _millis

    @F.pandas_udf(LongType())
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([parse_one(t) for t in text], dtype="Int64")

    return run(x)


def lenient_date(x) -> Column:
    """A lenient date as timestamp, null where it is none."""
    return F.timestamp_millis(lenient_millis(x))
