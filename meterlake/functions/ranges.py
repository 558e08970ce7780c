"""Named ranges of local days as half-open ranges of instants. Plain Python, as it runs once per command, but for columns of days."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.usage import Filter


def local_midnight(day: date, zone: str) -> datetime:
    """The first instant of a local day, in UTC; a day whose midnight is skipped begins at the jump."""
    tz = ZoneInfo(zone)
    wall = datetime(day.year, day.month, day.day)
    for minute in range(24 * 60):
        there = (wall + timedelta(minutes=minute)).replace(tzinfo=tz)
        instant = there.astimezone(UTC)
        if instant.astimezone(tz).replace(tzinfo=None) == wall + timedelta(minutes=minute):
            return instant
    raise ValueError(f"{day} is not a day of {zone}")


def midnight(day: Column, zone: str) -> Column:
    """``local_midnight`` of a column of days, as timestamps of UTC without a zone."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), day.cast("timestamp_ntz"))


def boundary(text: str, zone: str) -> datetime:
    """A local day (YYYY-MM-DD) or an RFC 3339 instant."""
    try:
        return local_midnight(date.fromisoformat(text), zone) if len(text) == 10 else datetime.fromisoformat(text).astimezone(UTC)
    except ValueError as e:
        raise ValueError(f"{text} is neither a date (YYYY-MM-DD) nor a timestamp") from e


def resolve(name: str | None = None, *, since: str | None = None, until: str | None = None, zone: str = "UTC", today: date | None = None, adapter: str | None = None) -> tuple[Filter, str]:
    """(filter, label) of today, week, month, a year, or a start; ``until`` overrides the end."""
    if name and since:
        raise ValueError("a named range and a start exclude each other")
    now = today or datetime.now(ZoneInfo(zone)).date()
    begin: datetime | None = None
    end: datetime | None = None
    label = "all time"
    if name == "today":
        begin, end, label = local_midnight(now, zone), local_midnight(now + timedelta(days=1), zone), "today"
    elif name in ("week", "month"):
        days = 7 if name == "week" else 30
        begin, label = local_midnight(now - timedelta(days=days - 1), zone), f"the last {days} days"
    elif name:
        year = int(name)
        begin, end, label = local_midnight(date(year, 1, 1), zone), local_midnight(date(year + 1, 1, 1), zone), name
    elif since:
        begin, label = boundary(since, zone), f"since {since}"
    if until:
        end, label = boundary(until, zone), f"{label} until {until}" if since else f"{label}, until {until}"

    def text(at: datetime | None) -> str | None:
        return at.strftime("%Y-%m-%d %H:%M:%S.%f") if at else None

    return Filter(text(begin), text(end), adapter), label
