"""Half-open validity windows, decay and schedules."""

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_at(start: Column, end: Column, at: Column) -> Column:
    """Whether start <= at < end, where a null bound is open."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (end > at))


def decayed(weight: Column, at: Column, now: Column, half_life_days: float) -> Column:
    days = (F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400.0
    return weight * F.pow(F.lit(0.5), days / half_life_days)


def closed(end: Column, at: Column) -> Column:
    """A window's end once it is closed at a time: only an open or later end moves."""
    return F.when(end.isNull() | (end > at), at).otherwise(end)


def cron_field(field: str, low: int, high: int) -> list[int]:
    """Values of one cron field: ``*``, lists, ranges and steps of either; a step behind one value changes nothing."""
    out: set[int] = set()
    for part in field.split(","):
        span, _, step = part.partition("/")
        if span == "*":
            a, b = low, high
        elif "-" in span:
            a, b = map(int, span.split("-"))
        else:
            a = b = int(span)
        if not low <= a <= b <= high or step and int(step) < 1:
            raise ValueError(f"bad cron field {field!r}")
        out.update(range(a, b + 1, int(step or 1)))
    return sorted(out)


def cron_next(expression: str, after: datetime) -> datetime:
    """The next minute after ``after`` that all five fields allow (day of month and of week both)."""
    minute, hour, day, month, week = expression.split()
    minutes, hours = cron_field(minute, 0, 59), cron_field(hour, 0, 23)
    days, months = cron_field(day, 1, 31), cron_field(month, 1, 12)
    weekdays = {d % 7 for d in cron_field(week, 0, 7)}
    at = (after + timedelta(minutes=1)).replace(second=0, microsecond=0)
    last = at + timedelta(days=366 * 8)
    while at < last:
        if at.month not in months or at.day not in days or at.isoweekday() % 7 not in weekdays:
            at = at.replace(hour=0, minute=0) + timedelta(days=1)
        elif at.hour not in hours:
            at = at.replace(minute=0) + timedelta(hours=1)
        elif at.minute not in minutes:
            at += timedelta(minutes=1)
        else:
            return at
    raise ValueError(f"{expression!r} never fires")


def next_fire(expression: Column, after: Column) -> Column:
    """``cron_next`` of columns, by an Arrow-batched function; null where either is null."""
    import pandas as pd

    @F.pandas_udf("timestamp")
    def fire(cron: pd.Series, at: pd.Series) -> pd.Series:
        found = [None if c is None or pd.isna(t) else cron_next(c, t.to_pydatetime().replace(tzinfo=None)) for c, t in zip(cron, at, strict=True)]
        return pd.Series(found, dtype="datetime64[ns]")

    return fire(expression, after.cast("timestamp"))
