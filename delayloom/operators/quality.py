"""Data-quality flags over readings; each flag is one pass and all share their windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import day_minute, local_time, wrap_minutes

TRAIN = ["source", "train_number", "station_code", "event"]
MINUTE = 60_000_000


def _gap(later: Column, earlier: Column) -> Column:
    """Minutes between two instants as a double."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / MINUTE


def flag_exact_duplicate(obs: DataFrame) -> DataFrame:
    """Readings equal to an earlier one in all that was read."""
    same = Window.partitionBy(*TRAIN, "observed_at", "actual_or_expected_time", "delay_minutes", "cancelled").orderBy("id")
    return obs.withColumn("first_id", F.first("id").over(same)).filter("id <> first_id").select("id", "first_id")


def _with_previous(obs: DataFrame, column: str, reach: float, hours: int = 6) -> DataFrame:
    """``obs`` with ``gap`` in minutes to the reading before it of the same train, place and event, and that one's ``column``, where at most ``reach`` minutes lie between.

    Time is cut into slices of some ``hours``, each with what happened in the
    last ``reach`` minutes before it. So a train number that a third of all
    readings bear, or none, is many groups and not one.
    """
    span, width = hours * 3600_000_000, int(reach * MINUTE)
    t = F.unix_micros("observed_at")
    own = F.floor(t / span)
    cut = obs.select("*", own.alias("own_"), F.explode(F.array_distinct(F.array(own, F.floor((t + width) / span)))).alias("slice_"))
    w = Window.partitionBy(*TRAIN, "slice_").orderBy("observed_at", "id")
    cut = cut.withColumn("gap", _gap(F.col("observed_at"), F.lag("observed_at").over(w))).withColumn(f"prev_{column}", F.lag(column).over(w))
    return cut.filter((F.col("slice_") == F.col("own_")) & (F.col("gap") <= reach)).drop("own_", "slice_")


def flag_near_duplicate(obs: DataFrame, minutes: float = 5) -> DataFrame:
    """The same train, place and event read again shortly after from another batch."""
    out = _with_previous(obs, "batch_id", minutes).withColumnRenamed("prev_batch_id", "prev_batch")
    return out.filter((F.col("gap") <= minutes) & ~F.col("batch_id").eqNullSafe(F.col("prev_batch"))).select("id", "gap", "prev_batch")


def flag_implausible_delay(obs: DataFrame, trains: DataFrame, early: int = 15, late: int = 180, early_far: int = 120, late_far: int = 1440) -> DataFrame:
    """Delays outside the bounds for trains of the timetable, wider ones for all others."""
    known = trains.select("train_id", F.lit(True).alias("known"))
    o = obs.join(known, "train_id", "left")
    bounds = F.when(F.col("known"), F.struct(F.lit(early).alias("early"), F.lit(late).alias("late"))).otherwise(F.struct(F.lit(early_far).alias("early"), F.lit(late_far).alias("late")))
    o = o.withColumn("b", bounds).select("id", "delay_minutes", "b.early", "b.late")
    return o.filter((F.col("delay_minutes") < -F.col("early")) | (F.col("delay_minutes") > F.col("late")))


def flag_delay_jump(obs: DataFrame, window: float = 60, slack: float = 15) -> DataFrame:
    """A delay that changed by more than the time between two readings allows."""
    o = _with_previous(obs.filter("delay_minutes IS NOT NULL AND NOT cancelled"), "delay_minutes", window).withColumnRenamed("prev_delay_minutes", "prev_delay")
    return o.filter((F.col("gap") <= window) & (F.abs(F.col("delay_minutes") - F.col("prev_delay")) > F.col("gap") + slack)).select("id", "prev_delay", "delay_minutes", "gap")


def with_schedule(obs: DataFrame, stops: DataFrame) -> DataFrame:
    """Uncancelled readings of timetable trains at their stops with the minute of day they were due, what delay that implies, and how far off they were read.

    Departures are due at the departure, all other events at the arrival.
    """
    due = stops.select("train_id", "station_code", (F.coalesce("departure_s", "arrival_s") / 60).cast("int").alias("dep"), (F.coalesce("arrival_s", "departure_s") / 60).cast("int").alias("arr"))
    o = obs.filter("NOT coalesce(cancelled, false)").join(due, ["train_id", "station_code"])
    o = o.withColumn("due", F.when(F.col("event") == "departure", F.col("dep")).otherwise(F.col("arr")))
    implied = wrap_minutes(day_minute(local_time(F.col("actual_or_expected_time"))) - F.col("due"))
    away = wrap_minutes(day_minute(local_time(F.col("observed_at"))) - F.col("due") - F.round(F.coalesce("delay_minutes", F.lit(0.0))).cast("int"))
    return o.withColumn("implied", implied).withColumn("away", away)


def flag_schedule_mismatch(scheduled: DataFrame, limit: float = 20) -> DataFrame:
    return scheduled.filter(F.abs(F.col("implied") - F.col("delay_minutes")) > limit).select("id", "implied", "delay_minutes")


def flag_far_from_schedule(scheduled: DataFrame, limit: float = 240) -> DataFrame:
    return scheduled.filter(F.abs("away") > limit).select("id", "away")


def flag_future_timestamp(obs: DataFrame, now: Column, tolerance: float = 5) -> DataFrame:
    return obs.withColumn("ahead", _gap(F.col("observed_at"), now)).filter(F.col("ahead") > tolerance).select("id", "ahead")


def flag_batch_time_mismatch(obs: DataFrame, tolerance: float = 90) -> DataFrame:
    """Readings stamped far from the time in their batch id."""
    at = F.try_to_timestamp(F.substring("batch_id", 1, 15), F.lit("yyyyMMdd'T'HHmmss"))
    return obs.withColumn("off", _gap(F.col("observed_at"), at)).filter(F.abs("off") > tolerance).select("id", "off")


#: What is stored of each flag beside its name; braces stand for columns of the rule: fixed values.
DETAILS = {
    "exact_duplicate": "the same reading as observation {first_id}",
    "near_duplicate": "read {gap} min after batch {prev_batch}",
    "implausible_delay": "delay {delay_minutes} min; allowed {early} early to {late} late",
    "delay_jump": "delay went from {prev_delay} to {delay_minutes} min in {gap} min",
    "schedule_mismatch": "source says {delay_minutes} min late; our timetable implies {implied}",
    "far_from_schedule": "read {away} min from when the train was due",
    "future_timestamp": "stamped {ahead} min in the future",
    "batch_time_mismatch": "stamped {off} min from its batch",
}
#: Decimals that measured minutes are told with.
_DECIMALS = {"gap": 1, "ahead": 1, "off": 0}


def _detail(flag: str) -> Column:
    """The text of a flag from the columns of its rule."""
    parts = []
    for piece in DETAILS[flag].replace("}", "{").split("{"):
        told = F.round(piece, _DECIMALS[piece]) if piece in _DECIMALS else F.col(piece) if len(parts) % 2 else F.lit(piece)
        parts.append(F.coalesce(told.cast("string"), F.lit("?")))
    return F.concat(*parts)


def find_flags(obs: DataFrame, trains: DataFrame, stops: DataFrame, now: Column, include_synthetic: bool = False) -> DataFrame:
    """``id, flag, detail`` of all eight rules, one row per reading and flag; synthetic readings aren't looked at unless asked for."""
    obs = obs if include_synthetic else obs.filter("source <> 'synthetic'")
    scheduled = with_schedule(obs, stops)
    found = {
        "exact_duplicate": flag_exact_duplicate(obs), "near_duplicate": flag_near_duplicate(obs), "implausible_delay": flag_implausible_delay(obs, trains), "delay_jump": flag_delay_jump(obs),
        "schedule_mismatch": flag_schedule_mismatch(scheduled), "far_from_schedule": flag_far_from_schedule(scheduled), "future_timestamp": flag_future_timestamp(obs, now), "batch_time_mismatch": flag_batch_time_mismatch(obs),
    }
    out = None
    for name, df in found.items():
        part = df.select("id", F.lit(name).alias("flag"), _detail(name).alias("detail"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id", "flag").agg(F.min("detail").alias("detail"))


def write_flags(flags: DataFrame, path: str, now: Column) -> None:
    """Replace the stored flags."""
    flags.withColumn("flagged_at", now).write.mode("overwrite").parquet(path)


def in_window(obs: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Readings observed from ``start`` to ``end``, both included; open where none is given. For the reports on a stretch of time."""
    obs = obs if start is None else obs.filter(F.col("observed_at") >= start)
    return obs if end is None else obs.filter(F.col("observed_at") <= end)


def flagged_rows(obs: DataFrame, flags: DataFrame) -> DataFrame:
    """Readings, how many of them bear a flag (once each, whatever their number of flags), and their share."""
    out = obs.join(flags.select("id").distinct().withColumn("flagged_", F.lit(1)), "id", "left").agg(F.count("*").alias("rows"), F.count("flagged_").alias("flagged"))
    return out.withColumn("share", F.coalesce(F.try_divide("flagged", "rows"), F.lit(0.0)))


def flag_summary(obs: DataFrame, flags: DataFrame, examples: int = 5) -> DataFrame:
    """Per flag its rows among ``obs``, their share and the newest examples."""
    joined = flags.join(obs.select("id", "observed_at"), "id")
    newest = Window.partitionBy("flag").orderBy(F.col("observed_at").desc(), F.col("id").desc())
    top = joined.withColumn("r", F.row_number().over(newest)).filter(F.col("r") <= examples).groupBy("flag").agg(F.array_sort(F.collect_list("id")).alias("examples"))
    counts = joined.groupBy("flag").agg(F.count("*").alias("rows"))
    return counts.join(top, "flag").crossJoin(obs.agg(F.count("*").alias("all_rows"))).select("flag", "rows", (F.col("rows") / F.col("all_rows")).alias("share"), F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"))


def source_rates(obs: DataFrame) -> DataFrame:
    return obs.groupBy("source").agg(F.count("*").alias("rows"), F.count_if("cancelled").alias("cancelled"), F.count_if("less_accurate").alias("less_accurate"), F.count_if(F.col("delay_minutes").isNull()).alias("no_delay"))


def unmatched_trains(obs: DataFrame, trains: DataFrame) -> DataFrame:
    """Train numbers without a train in the timetable, by readings."""
    kind = F.when(F.col("train_number").rlike("^9[5-9][0-9]{3}$"), "suburban").otherwise("other")
    return obs.join(trains.select("train_id"), "train_id", "left_anti").groupBy("train_number").agg(F.count("*").alias("rows")).withColumn("kind", kind)


def unmatched_stations(obs: DataFrame, stops: DataFrame) -> DataFrame:
    """Places that trains of the timetable were read at though the timetable doesn't take them there."""
    seen = obs.join(stops.select("train_id").distinct(), "train_id", "left_semi")
    return seen.join(stops.select("train_id", "station_code"), ["train_id", "station_code"], "left_anti").groupBy("station_code").agg(F.count("*").alias("rows"), F.countDistinct("train_id").alias("trains"))


def schedule_drift(scheduled: DataFrame, least: float = 2, most: float = 20) -> DataFrame:
    """Train and station where reported and implied delays differ by a steady amount."""
    gap = F.col("implied") - F.col("delay_minutes")
    out = scheduled.filter("delay_minutes IS NOT NULL").groupBy("train_id", "station_code").agg(F.median(gap).alias("drift"), F.count("*").alias("rows"))
    return out.filter(F.abs("drift").between(least, most))
