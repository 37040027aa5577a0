"""Riders' favourite routes: the usual train, messages that are due, and which leg a rider means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import sunday_schedule
from .journeys import next_trains


def usual_trip(favourites: DataFrame, stops: DataFrame, trains: DataFrame, reach: int = 10) -> DataFrame:
    """Train of each ``favourites(user_id, name, from_station, to_station, usual, day)`` that leaves nearest its usual minute of ``day``, if one does within ``reach`` minutes."""
    wanted = F.unix_date("day").cast("long") * 1440 + F.col("usual")
    asked = favourites.filter("usual IS NOT NULL").select(F.struct("user_id", "name", "day").alias("req_id"), F.col("from_station").alias("origin"), F.col("to_station").alias("destination"), wanted.alias("wanted"), F.timestamp_seconds((wanted - reach) * 60 - 19800).alias("at"))
    gap = F.abs(F.col("dep") - F.col("wanted"))
    near = next_trains(asked, stops, trains, 6).filter(gap <= reach)
    best = near.groupBy("req_id").agg(F.min_by(F.struct("train_id", "dep", "arr"), F.struct(gap, "place")).alias("trip"))
    return best.select("req_id.*", "trip.*")


def due_notifications(favourites: DataFrame, sent: DataFrame, stops: DataFrame, trains: DataFrame, now: Column, lead: int = 20, after: int = 5, grace: int = 10, skip_sundays: bool = True) -> DataFrame:
    """Messages whose moment lies at most ``grace`` minutes before ``now`` (local minutes since the epoch) and that aren't in ``sent``.

    "notify" comes ``lead`` minutes before the usual time, "nudge" ``after``
    minutes after the usual train's arrival. The usual train may be of the
    day before or after: midnight can lie between.
    """
    day = F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.date_from_unix_date((F.floor(now / 1440) + d).cast("int"))))
    days = favourites.filter("usual IS NOT NULL").withColumn("day", day).filter(F.substr("weekdays", F.weekday("day") + 1, F.lit(1)) == "Y")
    if skip_sundays:
        days = days.filter(~sunday_schedule(F.col("day")))
    key = ["user_id", "name", "day"]
    notify = days.filter("notify").select(*key, F.lit("notify").alias("kind"), (F.unix_date("day").cast("long") * 1440 + F.col("usual") - lead).alias("moment"), F.lit(None).cast("string").alias("train_id"))
    nudge = usual_trip(days.filter("nudge"), stops, trains).select(*key, F.lit("nudge").alias("kind"), (F.col("arr") + after).alias("moment"), "train_id")
    due = notify.unionByName(nudge).filter((F.col("moment") <= now) & (now < F.col("moment") + grace))
    return due.join(sent.select("user_id", "kind", "name", "day"), ["user_id", "kind", "name", "day"], "left_anti").select(*key, "kind", "moment", "train_id")


def pick_commute_route(favourites: DataFrame, moments: DataFrame, return_after: int = 840) -> DataFrame:
    """The favourite meant by each of ``moments(user_id, minute)``.

    The default (else the first by name), unless another one runs the other
    way: then the leg whose usual time is earlier counts as outbound and is
    meant before ``return_after``, the other one from then on.
    """
    leg = F.struct("name", "from_station", "to_station", "usual")
    first = favourites.groupBy("user_id").agg(F.min_by(leg, F.struct(~F.col("is_default"), "name")).alias("main"))
    other = favourites.select("user_id", leg.alias("leg"))
    turned = first.join(other, "user_id").filter("leg.from_station = main.to_station AND leg.to_station = main.from_station")
    back = turned.groupBy("user_id").agg(F.min_by("leg", "leg.name").alias("back"))
    both = moments.join(first, "user_id").join(back, "user_id", "left")
    swapped = F.coalesce(F.col("back.usual") < F.col("main.usual"), F.lit(False))
    homeward = F.col("minute") >= return_after
    name = F.when(F.col("back").isNull() | (homeward == swapped), F.col("main.name")).otherwise(F.col("back.name"))
    return both.select("user_id", "minute", name.alias("name"))
