"""Instants, local times and delivery slots as column expressions (session time zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def ago(now: Column, days: int) -> Column:
    return now - F.expr(f"INTERVAL {days} DAYS")


def window_days(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(1), F.round((F.unix_millis(end) - F.unix_millis(start)) / 86_400_000).cast("int"))


def day_axis(first: Column, last: Column) -> Column:
    return F.transform(F.sequence(F.to_date(first), F.to_date(last)), lambda d: F.date_format(d, "yyyy-MM-dd"))


def clamp_window(days: Column) -> Column:
    """NaN, infinite and missing become 7; else rounded into 1 to 30."""
    odd = days.isNull() | F.isnan(days) | (F.abs(days) == float("inf"))
    return F.when(odd, 7).otherwise(F.least(F.lit(30), F.greatest(F.lit(1), F.floor(F.when(odd, 7.0).otherwise(days) + 0.5).cast("int"))))


def local(ts: Column, zone: Column) -> Column:
    return F.from_utc_timestamp(ts, zone)


def to_instant(date: Column, hour: Column, minute: Column, zone: Column) -> Column:
    """A local reading as an instant: the first of two, the later side of a gap."""
    wall = F.timestamp_seconds(F.unix_timestamp(date.cast("timestamp")) + hour * 3600 + minute * 60)
    return F.to_utc_timestamp(wall, zone)


def first_brief_at(now: Column, hour: Column, minute: Column, zone: Column) -> Column:
    today = to_instant(F.to_date(local(now, zone)), hour, minute, zone)
    next_day = F.to_date(local(now + F.expr("INTERVAL 24 HOURS"), zone))
    return F.when(today > now, today).otherwise(to_instant(next_day, hour, minute, zone))


def _owed(slot: Column, now: Column, recorded: Column) -> Column:
    return F.when((slot >= recorded) & (slot <= now), slot)


def due_slot(now: Column, recorded: Column, hour: Column, minute: Column, zone: Column) -> Column:
    """Today's reading if it is past, else yesterday's by the calendar; NULL if not owed."""
    day = F.to_date(local(now, zone))
    today, yesterday = to_instant(day, hour, minute, zone), to_instant(F.date_sub(day, 1), hour, minute, zone)
    return F.when(today <= now, _owed(today, now, recorded)).otherwise(_owed(yesterday, now, recorded))


def due_cadence_slot(now: Column, recorded: Column, hour: Column, minute: Column, zone: Column, cadence: Column, weekday: Column, compat: bool = False) -> Column:
    """Daily, weekly or never.  A weekly reading still ahead today falls back a week; ``compat`` falls back one day instead."""
    day = F.to_date(local(now, zone))
    names = F.array(*[F.lit(w) for w in WEEKDAYS])
    back = F.pmod(F.weekday(day) - (F.array_position(names, weekday) - 1), F.lit(7)).cast("int")
    recent = F.date_sub(day, back)
    slot, before = to_instant(recent, hour, minute, zone), to_instant(F.date_sub(recent, F.lit(1 if compat else 7)), hour, minute, zone)
    weekly = F.when(slot <= now, _owed(slot, now, recorded)).otherwise(_owed(before, now, recorded))
    return F.when(cadence == "daily", due_slot(now, recorded, hour, minute, zone)).when(cadence == "weekly", weekly)


def iso_day(text: Column, edge: str = "start") -> Column:
    """A calendar day as its first or last millisecond; anything else is NULL."""
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    day = F.when(F.date_format(day, "yyyy-MM-dd") == text, day).cast("timestamp")
    return day if edge == "start" else day + F.expr("INTERVAL 86399999 MILLISECONDS")


def backoff(failures: Column, base_ms: int, most_ms: int) -> Column:
    shift = F.least(F.lit(6), F.greatest(F.lit(0), failures - 1))
    return F.least(F.lit(float(most_ms)), base_ms * F.pow(F.lit(2.0), shift)).cast("long")
