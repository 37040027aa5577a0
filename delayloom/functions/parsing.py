"""Text of feeds, timetables and reports as typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def delay_from_text(text: Column) -> Column:
    """"On Time", "21 Mins." and "04:17 Hrs." as minutes; anything else is null."""
    clock = r"(\d{1,2}):(\d{2})\s*hrs"
    low = F.lower(F.trim(text))
    hours = F.regexp_extract(low, clock, 1).try_cast("double") * 60 + F.regexp_extract(low, clock, 2).try_cast("double")
    minutes = F.regexp_extract(low, r"^(\d+)\s*min", 1).try_cast("double")
    return F.when(low == "on time", 0.0).when(low.rlike(clock), hours).otherwise(minutes)


def clock_seconds(text: Column) -> Column:
    """HH:MM[:SS] as seconds of the day; null where it is no time."""
    form = r"^([01]?\d|2[0-3]):([0-5]\d)(?::([0-5]\d))?$"
    part = lambda i: F.coalesce(F.regexp_extract(F.trim(text), form, i).try_cast("int"), F.lit(0))
    return F.when(F.trim(text).rlike(form), part(1) * 3600 + part(2) * 60 + part(3))


def yes_no(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("yes", "y", "true", "1"), True).when(low.isin("no", "n", "false", "0"), False)


def days_mask(text: Column) -> Column:
    """"daily", a Y/N mask, "mon-sat" or "sat|sun" (ranges may wrap) as a Monday..Sunday mask; null if none of these."""
    low = F.lower(F.trim(text))
    names = F.array(*map(F.lit, DAYS))
    at = lambda x: F.array_position(names, F.trim(x)).cast("int") - 1

    def has(part: Column, day: Column) -> Column:
        first, last = at(F.element_at(F.split(part, "-"), 1)), at(F.element_at(F.split(part, "-"), -1))
        inside = F.when(first <= last, (day >= first) & (day <= last)).otherwise((day >= first) | (day <= last))
        return (first >= 0) & (last >= 0) & inside

    parts = F.split(low, r"\|")
    known = F.forall(parts, lambda p: F.forall(F.split(p, "-"), lambda x: at(x) >= 0) & (F.size(F.split(p, "-")) <= 2))
    listed = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: F.when(F.exists(parts, lambda p: has(p, d)), "Y").otherwise("N")), "")
    return F.when(low == "daily", "YYYYYYY").when(F.upper(low).rlike("^[YN]{7}$"), F.upper(low)).when(known, listed)


def nearest_clock(text: Column, anchor: Column) -> Column:
    """The instant with local clock ``text`` (HH:MM) that lies closest to ``anchor``."""
    local = anchor + F.expr("INTERVAL 330 MINUTES")
    base = F.date_trunc("day", local) + F.make_dt_interval(secs=clock_seconds(text)) - F.expr("INTERVAL 330 MINUTES")
    options = F.array(*[F.struct(F.abs(F.unix_micros(base + F.expr(f"INTERVAL {d} DAYS")) - F.unix_micros(anchor)).alias("gap"), (base + F.expr(f"INTERVAL {d} DAYS")).alias("at")) for d in (-1, 0, 1)])
    return F.when(clock_seconds(text).isNotNull() & anchor.isNotNull(), F.array_min(options)["at"])


def train_description(text: Column) -> Column:
    """"HH:MM type from STN" as a struct of clock seconds, type and station; null fields where absent."""
    form = r"(?i)^\s*(\d{1,2}:\d{2})\s+(fast|slow|train)\s+from\s+(\S+)"
    part = lambda i: F.nullif(F.regexp_extract(text, form, i), F.lit(""))
    return F.struct(clock_seconds(part(1)).alias("seconds"), F.nullif(F.lower(part(2)), F.lit("train")).alias("train_type"), F.upper(part(3)).alias("station_code"))


def short_error(text: Column, width: int = 200) -> Column:
    """Error text on one line without query strings; what is longer than ``width`` ends in an ellipsis."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, r"\?\S*", ""), r"\s+", " "))
    return F.when(F.length(plain) > width, F.concat(F.substring(plain, 1, width - 1), F.lit("…"))).otherwise(plain)


def name_key(text: Column) -> Column:
    """Letters of a name in upper case: what station names are matched by."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))


def block_id(*parts: Column) -> Column:
    """Stable eight-digit key of a block."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary")), 1, 8)
