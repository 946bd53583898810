"""Time buckets and calendar parts. The session time zone is UTC."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

UNITS = ("hour", "day", "week", "month")  # a week starts on Monday
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def event_time(epoch_millis):
    return F.timestamp_millis(_col(epoch_millis))


def event_date(epoch_millis):
    return F.date_format(event_time(epoch_millis), "yyyy-MM-dd")


def bucket(ts, unit):
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}, not {unit!r}")
    return F.date_trunc(unit, _col(ts))


def calendar(ts):
    """(day_idx, day_of_week, hour_of_day); Monday is 0."""
    ts = _col(ts)
    return (
        F.weekday(ts).alias("day_idx"),
        F.date_format(ts, "EEEE").alias("day_of_week"),
        F.hour(ts).alias("hour_of_day"),
    )


def to_millis(instant):
    """Epoch milliseconds of an ISO text, a datetime (naive is UTC) or a number."""
    if isinstance(instant, (int, float)):
        return int(instant)
    if isinstance(instant, str):
        instant = datetime.fromisoformat(instant)
    if instant.tzinfo is None:
        instant = instant.replace(tzinfo=timezone.utc)
    whole = int(instant.replace(microsecond=0).timestamp())
    return whole * 1000 + instant.microsecond // 1000
