"""Which rows and groups a query is about: instants, calendar periods, missing values, literal text, conditions on groups.

Comparisons with a missing value are unknown, and only what is true selects a row: neither `x > 3` nor its negation selects rows without an x. Only `is_missing`
and `is_present` ask for that. Conditions are Columns, so they combine by `&`, `|` and `~` and reach the scan; a field that isn't there is an error of Spark's.
"""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIODS = ("day", "week", "month")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def is_missing(value: Column) -> Column:
    return value.isNull()


def is_present(value: Column) -> Column:
    return value.isNotNull()


def has_text(value: Column, text: str) -> Column:
    """Whether a text has another in it, letter by letter: no character is special."""
    return F.contains(value, F.lit(text))


def during(instant: Column, since: datetime | None = None, until: datetime | None = None) -> Column:
    """Whether an instant (UTC, without zone) is at or after `since` and before `until`; undated rows are selected only if there is no bound at all."""
    bounds = [f(instant, _naive(b)) for b, f in ((since, lambda i, b: i >= b), (until, lambda i, b: i < b)) if b is not None]
    return bounds[0] & bounds[1] if len(bounds) == 2 else bounds[0] if bounds else F.lit(True)


def _naive(bound: datetime) -> Column:
    at = bound.astimezone(UTC) if bound.tzinfo else bound
    return F.lit(at.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def midnight(day: date, zone: str) -> datetime:
    """The first instant of a local date, in UTC: the jump of the clock where midnight is skipped, the first of two midnights."""
    local = ZoneInfo(zone)
    at = datetime(day.year, day.month, day.day, tzinfo=local).astimezone(UTC)
    minute = timedelta(minutes=1)
    while (at - minute).astimezone(local).date() >= day:  # a jump that began the evening before
        at -= minute
    return at


def _first_day(day: date, period: str, week_start: str) -> date:
    if period == "month":
        return day.replace(day=1)
    return day - timedelta(days=(day.weekday() - WEEKDAYS.index(week_start)) % 7) if period == "week" else day


def _moved(first: date, period: str, periods: int) -> date:
    if period == "month":
        months = first.year * 12 + first.month - 1 + periods
        return date(months // 12, months % 12 + 1, 1)
    return first + timedelta(days=periods * (7 if period == "week" else 1))


def last_periods(n: int, period: str, now: datetime, zone: str = "UTC", week_start: str = "monday") -> tuple[datetime, datetime]:
    """The bounds, half open and in UTC, of the n calendar periods of a time zone that end with the current one."""
    if n < 1 or period not in PERIODS:
        raise ValueError(f"the last {n} {period}")
    first = _first_day(now.astimezone(ZoneInfo(zone)).date(), period, week_start)
    return midnight(_moved(first, period, 1 - n), zone), midnight(_moved(first, period, 1), zone)


def period_of(instant: Column, period: str, zone: str = "UTC", week_start: str = "monday") -> Column:
    """The first local date of the calendar period that an instant (UTC, without zone) lies in."""
    day = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), instant))
    if period == "week":
        return F.date_sub(day, F.pmod(F.weekday(day) - WEEKDAYS.index(week_start), F.lit(7)).cast("int"))
    return F.trunc(day, "month") if period == "month" else day


def active_threads(requests: DataFrame, thread: str, instant: str, since: datetime | None, until: datetime | None) -> DataFrame:
    """(id) of the threads with usage in an interval: a clause that takes in all their usage."""
    return requests.filter(during(F.col(instant), since, until) & F.col(thread).isNotNull()).select(F.col(thread).alias("id")).distinct()


def latest_thread(requests: DataFrame, thread: str, instant: str, where: Column | None = None) -> DataFrame:
    """(id) of the thread that was used last, of those that meet a condition; of equal instants the least id. No row where nothing is dated."""
    rows = requests.filter(F.col(instant).isNotNull() & F.col(thread).isNotNull())
    rows = rows if where is None else rows.filter(where)
    last = rows.groupBy(F.col(thread).alias("id")).agg(F.max(instant).alias("_last"))
    return last.orderBy(F.desc("_last"), F.asc("id")).limit(1).select("id")
