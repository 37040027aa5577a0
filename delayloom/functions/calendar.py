"""Calendar rules as column expressions; instants are UTC, wall clocks are UTC+05:30."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed public holidays, month-day: fixed values.
FIXED_HOLIDAYS = ("01-26", "04-14", "05-01", "08-15", "10-02", "12-25")
#: First hour of each part of the day; night wraps: fixed values.
DAY_BANDS = (("early", 4), ("am_peak", 7), ("midday", 11), ("pm_peak", 16), ("night", 21))


def local_time(instant: Column) -> Column:
    return instant + F.expr("INTERVAL 330 MINUTES")


def day_minute(clock: Column) -> Column:
    """Minute of the day of a wall clock."""
    return F.hour(clock) * 60 + F.minute(clock)


def wrap_minutes(difference: Column) -> Column:
    """A difference of day minutes folded into -720..719."""
    return F.pmod(difference + 720, F.lit(1440)) - 720


def is_holiday(day: Column) -> Column:
    return (F.month(day) * 100 + F.day(day)).isin(*[int(x.replace("-", "")) for x in FIXED_HOLIDAYS])


def sunday_schedule(day: Column, movable: Column | None = None) -> Column:
    """Sundays and holidays run to the Sunday timetable; ``movable`` says whether a movable holiday is in force."""
    listed = (F.weekday(day) == 6) | is_holiday(day)
    return listed if movable is None else listed | F.coalesce(movable, F.lit(False))


def holidays_in_force(holidays: DataFrame, tentative: bool = False, most: int = 5000) -> tuple[date, ...]:
    """Dates of ``holidays(date, status)`` that count: confirmed and reported ones, tentative ones only if asked for.

    A list kept by hand, some dozen dates a year; more than ``most`` are refused.
    """
    rows = holidays.filter(F.col("status").isin("confirmed", "reported", *(["tentative"] if tentative else []))).select("date").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} holidays")
    return tuple(sorted(r["date"] for r in rows))


def mask_index(day: Column, holidays: Sequence[date] = ()) -> Column:
    """Place in a Monday..Sunday mask that says whether a service runs on ``day``; ``holidays`` are the movable ones in force."""
    movable = day.isin(*holidays) if holidays else None
    return F.when(sunday_schedule(day, movable), F.lit(6)).otherwise(F.weekday(day))


def runs_on(mask: Column, day: Column, holidays: Sequence[date] = ()) -> Column:
    """Whether a Monday..Sunday Y/N mask has the service on ``day``."""
    return F.substr(mask, mask_index(day, holidays) + 1, F.lit(1)) == "Y"


def service_day(clock: Column, run_start_minute: Column) -> Column:
    """Day on which the run started, a reading being within twelve hours of the start."""
    since = wrap_minutes(day_minute(clock) - run_start_minute)
    since = F.when(since == -720, F.lit(720)).otherwise(since)
    return F.to_date(clock - F.make_dt_interval(mins=since))


def run_key(scheduled_clock: Column) -> Column:
    """Service day of a scheduled time: days turn at three in the morning."""
    return F.to_date(scheduled_clock - F.expr("INTERVAL 3 HOURS"))


def day_kind(day: Column) -> Column:
    return F.when((F.weekday(day) >= 5) | is_holiday(day), "weekend").otherwise("weekday")


def day_band(hour: Column) -> Column:
    out = F.lit("night")
    for name, first in DAY_BANDS:
        out = F.when(hour >= first, name).otherwise(out)
    return out


def lead_bucket(lead: Column) -> Column:
    """0 after the scheduled time, then up to 15, 30, 60 and more minutes ahead."""
    return F.when(lead < 0, 0).when(lead <= 15, 1).when(lead <= 30, 2).when(lead <= 60, 3).otherwise(4)


def runs_ac(is_ac: Column, weekdays_only: Column, day: Column, holidays_too: bool = False) -> Column:
    """Air-conditioned today: weekday-only sets rest at weekends, and on holidays where ``holidays_too``."""
    rest = F.weekday(day) >= 5
    if holidays_too:
        rest = rest | is_holiday(day)
    return F.coalesce(is_ac, F.lit(False)) & ~(F.coalesce(weekdays_only, F.lit(False)) & rest)
