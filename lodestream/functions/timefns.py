"""Dates, times and durations (DT*). ``now`` is always an argument, in epoch milliseconds."""

from __future__ import annotations

import datetime as dt
import math
import re
from dataclasses import dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import Column, functions as F

DAY_MS = 86_400_000


def strict_date_ms(c: Column) -> Column:
    """Epoch milliseconds of YYYY-MM-DD at midnight UTC; null for anything else."""
    text = F.trim(c)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.unix_millis(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))


def utc_offset_minutes(c: Column) -> Column:
    """Minutes of UTC±H[:MM], null beyond 14 hours or for other text."""
    pattern = r"^UTC([+-])(\d{1,2})(?::([0-5]\d))?$"
    text = F.trim(c)
    minutes = F.regexp_extract(text, pattern, 2).try_cast("int") * 60 + F.coalesce(F.regexp_extract(text, pattern, 3).try_cast("int"), F.lit(0))
    sign = F.when(F.regexp_extract(text, pattern, 1) == "-", -1).otherwise(1)
    return F.when(text.rlike(pattern) & (minutes <= 840), sign * minutes)


def _offset(text: str | None) -> int | None:
    found = re.fullmatch(r"UTC([+-])(\d{1,2})(?::([0-5]\d))?", (text or "").strip())
    if not found:
        return None
    minutes = int(found[2]) * 60 + int(found[3] or 0)
    return None if minutes > 840 else -minutes if found[1] == "-" else minutes


@dataclass(frozen=True)
class DateRange:
    """Inclusive range in epoch milliseconds."""

    start_ms: int
    end_ms: int


def date_range(now_ms: int, start: str | None = None, end: str | None = None, days: float | str | None = None, mode: str = "utc", utc_offset: str | None = None, local: str = "UTC") -> DateRange:
    """Explicit dates, else the last ``days`` (30, at least 1) ending today; a day starts at midnight of the mode's zone, an unusable offset means UTC."""
    zone: dt.tzinfo = dt.timezone.utc
    if mode == "gateway":
        zone = ZoneInfo(local)
    elif mode == "specific" and (minutes := _offset(utc_offset)) is not None:
        zone = dt.timezone(dt.timedelta(minutes=minutes))
    midnight = lambda d: int(dt.datetime(d.year, d.month, d.day, tzinfo=zone).timestamp() * 1000)

    def parse(text: str | None) -> dt.date | None:
        try:
            return dt.date.fromisoformat(text.strip()) if text and re.fullmatch(r"\d{4}-\d{2}-\d{2}", text.strip()) else None
        except ValueError:
            return None

    first, last = parse(start), parse(end)
    if first and last:
        return DateRange(midnight(first), midnight(last) + DAY_MS - 1)
    today = dt.datetime.fromtimestamp(now_ms / 1000, zone).date()
    try:
        many = 30 if days in (None, "") else max(1, math.floor(float(days)))
    except ValueError:
        many = 30
    return DateRange(midnight(today) - (many - 1) * DAY_MS, midnight(today) + DAY_MS - 1)


def absolute_time_ms(c: Column) -> Column:
    """Epoch-millisecond digits, an ISO date, or an ISO datetime, UTC if it names no zone; null for other text."""
    text = F.trim(c)
    zoned = F.when(text.rlike(r"(?i)(Z|[+-]\d{2}:?\d{2})$") & text.rlike(r"^\d{4}-\d{2}-\d{2}T"), text)
    full = F.coalesce(zoned, F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z"))), F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.concat(text, F.lit("Z"))))
    return F.when(text.rlike(r"^\d+$") & (text.try_cast("double") > 0), text.try_cast("long")).otherwise(F.unix_millis(F.try_to_timestamp(full)))


def next_every(now_ms: Column, every_ms: Column, anchor_ms: Column) -> Column:
    """Next fire of a periodic schedule: the anchor itself while it lies ahead, else the next whole step after it, one at least; null without a period."""
    every = F.greatest(F.lit(1), F.floor(every_ms).cast("long"))
    anchor = F.greatest(F.lit(0), F.floor(F.coalesce(anchor_ms, now_ms)).cast("long"))
    steps = F.greatest(F.lit(1), F.floor((now_ms - anchor + every - 1) / every).cast("long"))
    return F.when(every_ms.isNull(), F.lit(None).cast("long")).when(now_ms < anchor, anchor).otherwise(anchor + steps * every)


def next_at(now_ms: Column, at_ms: Column) -> Column:
    return F.when(at_ms > now_ms, at_ms)


def is_top_of_hour(expr: Column) -> Column:
    """Cron expressions of five or six fields that fire at minute 0 (and second 0) of several hours."""
    fields = F.filter(F.split(F.trim(expr), r"\s+"), lambda f: f != "")
    five = (F.size(fields) == 5) & (F.get(fields, F.lit(0)) == "0") & F.contains(F.get(fields, F.lit(1)), F.lit("*"))
    six = (F.size(fields) == 6) & (F.get(fields, F.lit(0)) == "0") & (F.get(fields, F.lit(1)) == "0") & F.contains(F.get(fields, F.lit(2)), F.lit("*"))
    return F.coalesce(five | six, F.lit(False))


def stagger_offset_ms(job_id: Column, window_ms: Column) -> Column:
    """A stable offset below the window from the first four bytes of the id's SHA-256; 0 for no window."""
    first = F.conv(F.substring(F.sha2(job_id, 256), 1, 8), 16, 10).cast("long")
    return F.when(window_ms > 1, first % window_ms).otherwise(F.lit(0)).cast("long")


def decay(age_days: Column, half_life_days: float) -> Column:
    if half_life_days <= 0:
        return F.lit(1.0)
    return F.exp(F.lit(-math.log(2) / half_life_days) * F.greatest(F.lit(0.0), age_days))


DATED_MEMORY = r"(?:^|/)memory/(\d{4})-(\d{2})-(\d{2})\.md$"


def decay_time_ms(path: Column, source: Column, mtime_ms: Column) -> Column:
    """The date in a dated memory path, nothing for other memory files, else the file's time."""
    normal = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")
    date = F.concat_ws("-", *[F.regexp_extract(normal, DATED_MEMORY, i) for i in (1, 2, 3)])
    from_path = F.when(normal.rlike(DATED_MEMORY), F.unix_millis(F.try_to_timestamp(date, F.lit("yyyy-MM-dd"))))
    evergreen = (source == "memory") & (normal.isin("MEMORY.md", "memory.md") | (F.startswith(normal, F.lit("memory/")) & ~normal.rlike(DATED_MEMORY)))
    return F.when(from_path.isNotNull(), from_path).when(F.coalesce(evergreen, F.lit(False)), F.lit(None).cast("long")).otherwise(mtime_ms)


def daily_reset_ms(now_ms: Column, at_hour: int = 4, offset_minutes: int = 0) -> Column:
    """The latest ``at_hour`` o'clock, in a zone of fixed offset, that isn't after now."""
    shift = offset_minutes * 60_000 - at_hour * 3_600_000
    return (F.floor((now_ms + shift) / DAY_MS) * DAY_MS - shift).cast("long")


def _join(*parts: Column) -> Column:
    return F.concat(*parts)


def _n(c: Column) -> Column:
    return c.cast("long").cast("string")


def duration_compact(ms: Column, spaced: bool = False) -> Column:
    """500ms, 45s, 2m5s, 1h30m, 2d3h; null for null and for what isn't positive."""
    gap = F.lit(" " if spaced else "")
    total = F.floor(ms / 1000 + 0.5)
    hours, minutes, seconds = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    days, rest = F.floor(hours / 24), hours % 24
    pair = lambda a, x, b, y: F.when(b > 0, _join(_n(a), F.lit(x), gap, _n(b), F.lit(y))).otherwise(_join(_n(a), F.lit(x)))
    return (
        F.when(ms.isNull() | (ms <= 0), F.lit(None).cast("string"))
        .when(ms < 1000, _join(_n(F.floor(ms + 0.5)), F.lit("ms")))
        .when(hours >= 24, pair(days, "d", rest, "h"))
        .when(hours > 0, pair(hours, "h", minutes, "m"))
        .when(minutes > 0, pair(minutes, "m", seconds, "s"))
        .otherwise(_join(_n(seconds), F.lit("s")))
    )


def time_ago(ms: Column) -> Column:
    """just now, 5m ago, 3h ago (under two days), 2d ago; unknown for null and negative."""
    minutes = F.floor(F.floor(ms / 1000 + 0.5) / 60 + 0.5)
    hours = F.floor(minutes / 60 + 0.5)
    return (
        F.when(ms.isNull() | (ms < 0), F.lit("unknown"))
        .when(minutes < 1, F.lit("just now"))
        .when(minutes < 60, _join(_n(minutes), F.lit("m ago")))
        .when(hours < 48, _join(_n(hours), F.lit("h ago")))
        .otherwise(_join(_n(F.floor(hours / 24 + 0.5)), F.lit("d ago")))
    )


def reset_remaining(target_ms: Column, now_ms: Column) -> Column:
    """now, 5m, 2h 5m, 3d 4h, or a date from a week on; null without a target."""
    minutes = F.floor((target_ms - now_ms) / 60_000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    return (
        F.when(target_ms.isNull() | (target_ms == 0), F.lit(None).cast("string"))
        .when(target_ms <= now_ms, F.lit("now"))
        .when(minutes < 60, _join(_n(minutes), F.lit("m")))
        .when((hours < 24) & (minutes % 60 > 0), _join(_n(hours), F.lit("h "), _n(minutes % 60), F.lit("m")))
        .when(hours < 24, _join(_n(hours), F.lit("h")))
        .when(days < 7, _join(_n(days), F.lit("d "), _n(hours % 24), F.lit("h")))
        .otherwise(F.date_format(F.timestamp_millis(target_ms), "MMM d"))
    )


def duration_ms(c: Column, default_unit: str = "ms") -> Column:
    """Milliseconds of 1h30m, 500ms or a bare number in the default unit; null where the text isn't one."""
    low = F.lower(F.trim(c))
    factor = {"ms": 1.0, "s": 1e3, "m": 6e4, "h": 3.6e6, "d": 8.64e7}
    unit = lambda u: F.when(u == "ms", 1.0).when(u == "s", 1e3).when(u == "m", 6e4).when(u == "h", 3.6e6).when(u == "d", 8.64e7)
    part = r"(\d+(?:\.\d+)?)(ms|s|m|h|d)"
    values, units = F.regexp_extract_all(low, F.lit(part), F.lit(1)), F.regexp_extract_all(low, F.lit(part), F.lit(2))
    total = F.aggregate(F.zip_with(values, units, lambda v, u: v.cast("double") * unit(u)), F.lit(0.0), lambda s, x: s + x)
    bare = low.rlike(r"^\d+(?:\.\d+)?$")
    return F.when(bare, F.floor(low.try_cast("double") * factor[default_unit] + 0.5)).when(low.rlike(f"^(?:{part})+$"), F.floor(total + 0.5)).cast("long")


def minute_of_day(now_ms: Column, zone: str) -> Column:
    local = F.from_utc_timestamp(F.timestamp_millis(now_ms), zone)
    return F.hour(local) * 60 + F.minute(local)


def within_active_hours(now_ms: Column, start: str | None, end: str | None, zone: str = "UTC") -> Column:
    """[start, end) of the day, over midnight if end is before start; equal bounds never, unusable ones always."""

    def minutes(text: str | None, midnight: bool) -> int | None:
        found = re.fullmatch(r"([01]\d|2[0-4]):([0-5]\d)", text or "")
        if not found or (found[1] == "24" and (not midnight or found[2] != "00")):
            return None
        return int(found[1]) * 60 + int(found[2])

    first, last = minutes(start, False), minutes(end, True)
    if first is None or last is None:
        return F.lit(True)
    if first == last:
        return F.lit(False)
    now = minute_of_day(now_ms, zone)
    return (now >= first) & (now < last) if last > first else (now >= first) | (now < last)
