"""The feed of running-status sentences as readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stations import station_alias

#: Form of a sentence: age, cancellation or verb and place or pair of places, delay, accuracy. Fixed values.
SENTENCE = (
    r"^(?:\[(\d+) min ago\] )?"
    r"(?:(Cancellation Reported)|(Rake at|At|Crossed|Arriving) ([^,(]+?)|Between ([^,(]+?) - [^,(]+?|Reaching [^,(]+? \(at ([^)]+?) now\))"
    r"(?:, (\d+) min (Late|Early))?( \(Less Accurate\))?$"
)


def status_sentence(text: Column) -> Column:
    """One sentence as a struct of event, place, minutes_ago, delay_minutes and less_accurate.

    Events are at, arriving, crossed, between (place: the one last passed),
    rake_at, cancelled and unknown; a train reaching its end "at X now" is at X.
    """
    said = F.trim(text)
    part = lambda i: F.nullif(F.regexp_extract(said, SENTENCE, i), F.lit(""))
    verb = F.replace(F.lower(part(3)), F.lit(" "), F.lit("_"))
    event = F.when(part(2).isNotNull(), "cancelled").when(part(6).isNotNull(), "at").when(part(5).isNotNull(), "between").otherwise(F.coalesce(verb, F.lit("unknown")))
    size = part(7).cast("double")
    return F.struct(
        event.alias("event"), F.coalesce(part(4), part(5), part(6)).alias("place"), F.coalesce(part(1).cast("int"), F.lit(0)).alias("minutes_ago"),
        F.when(part(8) == "Early", 0 - size).otherwise(size).alias("delay_minutes"), part(9).isNotNull().alias("less_accurate"),
    )


def status_feed(raw: DataFrame) -> DataFrame:
    """One reading per train of ``raw(body, fetched_at, ...)``, whose body maps train numbers to sentences; other columns stay.

    A body that is no JSON object, or null, gives none. The reading is as old
    as its sentence says. Only "at" pins a train to a place at a known instant,
    so only it has a time. A cancelled train and an unknown sentence have no place.
    """
    other = [c for c in raw.columns if c not in ("body", "fetched_at")]
    each = raw.select(*other, "fetched_at", F.explode(F.from_json("body", "map<string,string>")).alias("train_number", "raw_status"))
    each = each.withColumn("said_", status_sentence(F.col("raw_status")))
    seen = F.col("fetched_at") - F.make_dt_interval(mins=F.col("said_.minutes_ago"))
    at = F.col("said_.event") == "at"
    place = F.when(F.col("said_.place").isNull(), "").otherwise(station_alias(F.col("said_.place"), F.col("train_number")))
    return each.select(
        *other, seen.alias("observed_at"), "train_number", place.alias("station_code"), F.col("said_.event").alias("event"), F.when(at, seen).alias("actual_or_expected_time"), F.when(at, "actual").alias("time_kind"),
        F.col("said_.delay_minutes").alias("delay_minutes"), (F.col("said_.event") == "cancelled").alias("cancelled"), F.col("said_.less_accurate").alias("less_accurate"), "raw_status",
    )
