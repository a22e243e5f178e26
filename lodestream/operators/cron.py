"""Cron expressions of five or six fields, next and previous fire time (DT5, DT6)."""

from __future__ import annotations

import datetime as dt
import functools
from dataclasses import dataclass
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, functions as F

MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
DAYS = {d: i for i, d in enumerate("sun mon tue wed thu fri sat".split())}
#: How far ahead or back a fire time is looked for, in days: leap days come every eight years at the most.
HORIZON_DAYS = 366 * 9


def _field(text: str, lo: int, hi: int, names: dict[str, int]) -> frozenset[int]:
    found: set[int] = set()
    for part in text.lower().split(","):
        span, _, step = part.partition("/")
        number = lambda s: names[s] if s in names else int(s)
        if span in ("*", "?"):
            a, b = lo, hi
        elif "-" in span:
            a, b = map(number, span.split("-"))
        else:
            a = number(span)
            b = hi if step else a
        by = int(step) if step else 1
        if by < 1 or a < lo or b > hi or a > b:
            raise ValueError(f"bad cron field {text!r}")
        found.update(range(a, b + 1, by))
    return frozenset(found)


@dataclass(frozen=True)
class Cron:
    seconds: frozenset[int]
    minutes: frozenset[int]
    hours: frozenset[int]
    days: frozenset[int]
    months: frozenset[int]
    weekdays: frozenset[int]
    either: bool  # both day fields are given: one that fits is enough

    def on(self, d: dt.date) -> bool:
        if d.month not in self.months:
            return False
        day, week = d.day in self.days, d.isoweekday() % 7 in self.weekdays
        return day or week if self.either else day and week


@functools.lru_cache(maxsize=512)
def parse(expr: str) -> Cron:
    fields = expr.split()
    if len(fields) == 5:
        fields = ["0", *fields]
    if len(fields) != 6:
        raise ValueError(f"cron expression of {len(fields)} fields")
    week = frozenset(d % 7 for d in _field(fields[5], 0, 7, DAYS))
    return Cron(_field(fields[0], 0, 59, {}), _field(fields[1], 0, 59, {}), _field(fields[2], 0, 23, {}), _field(fields[3], 1, 31, {}), _field(fields[4], 1, 12, MONTHS), week, fields[3][0] not in "*?" and fields[5][0] not in "*?")


def _times(cron: Cron, day: dt.date, zone: ZoneInfo, backward: bool):
    order = lambda s: sorted(s, reverse=backward)
    for h in order(cron.hours):
        for m in order(cron.minutes):
            for s in order(cron.seconds):
                local = dt.datetime(day.year, day.month, day.day, h, m, s, tzinfo=zone)
                ms = int(local.timestamp() * 1000)
                back = dt.datetime.fromtimestamp(ms / 1000, zone)
                if (back.hour, back.minute) != (h, m):  # the clock skips this time: it fires when the clock goes on
                    ms = int(dt.datetime.fromtimestamp(local.astimezone(dt.timezone.utc).timestamp(), zone).timestamp() * 1000)
                yield ms


def fire(expr: str, now_ms: int, zone: str = "UTC", backward: bool = False) -> int | None:
    """The next fire time after now, or the previous one before it; null for a bad expression or zone, or none within the horizon."""
    try:
        cron, tz = parse(expr.strip()), ZoneInfo(zone)
    except (ValueError, KeyError, IndexError, OSError):
        return None
    day = dt.datetime.fromtimestamp(now_ms / 1000, tz).date()
    step = dt.timedelta(days=-1 if backward else 1)
    for _ in range(HORIZON_DAYS):
        if cron.on(day):
            for ms in _times(cron, day, tz, backward):
                if ms < now_ms if backward else ms > now_ms:
                    return ms
        day += step
    return None


def fire_column(expr: Column, now_ms: Column, zone: str = "UTC", backward: bool = False) -> Column:
    @F.pandas_udf("long")
    def run(exprs: pd.Series, nows: pd.Series) -> pd.Series:
        return pd.Series([None if e is None else fire(e, int(n), zone, backward) for e, n in zip(exprs, nows, strict=True)], dtype="Int64")

    return run(expr, now_ms)
