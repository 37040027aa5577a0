"""Crowding scores of trips: rules first, then riders' reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import train_description
from .matching import home_lines

#: Rule values: fixed values.
BASE, UP_PEAK, DOWN_PEAK, SHOULDER_HOURS = 2.0, (8.0, 11.0), (17.5, 21.0), 1.0
PEAK, SHOULDER, COUNTER_PEAK, SUNDAY_SHARE, NIGHT, NIGHT_HOURS = 2.0, 1.0, 0.5, 0.4, -0.5, (23.0, 5.0)
FAST_IN_PEAK, FIFTEEN_CAR, AC, STARTS_HERE, LADIES, AHEAD_CANCELLED, AHEAD_LATE, AHEAD_LATE_MINUTES = 0.5, -0.5, -1.0, -1.0, -0.5, 1.0, 0.5, 10.0
REPORT_WINDOW, REPORT_DAYS, HALF_WEIGHT, SIMILAR_WEIGHT = 30, 90, 3.0, 0.5


def _within(hour: Column, low, high) -> Column:
    return (hour >= low) & (hour <= high)


def rule_score(trips: DataFrame) -> DataFrame:
    """``trips`` with rule_score (1 to 5, unrounded), the period's name, and reasons.

    Needs hour (with its fraction), direction, train_type, sunday, ahead_cancelled,
    ahead_delay, starts_here, car_count, ac and is_ladies_special.
    """
    up, h = F.col("direction") == "up", F.col("hour")
    own = lambda i: F.when(up, UP_PEAK[i]).otherwise(DOWN_PEAK[i])
    other = lambda i: F.when(up, DOWN_PEAK[i]).otherwise(UP_PEAK[i])
    period = F.when(_within(h, own(0), own(1)), "peak").when(_within(h, own(0) - SHOULDER_HOURS, own(1) + SHOULDER_HOURS), "shoulder").when(_within(h, other(0), other(1)), "counter").when((h >= NIGHT_HOURS[0]) | (h <= NIGHT_HOURS[1]), "night").otherwise("off_peak")
    t = trips.withColumn("period", period)
    scale, p = F.when(F.col("sunday"), SUNDAY_SHARE).otherwise(1.0), F.col("period")
    change = F.when(p == "peak", PEAK * scale).when(p == "shoulder", SHOULDER * scale).when(p == "counter", COUNTER_PEAK * scale).when(p == "night", NIGHT).otherwise(0.0)
    terms = [
        ("fast train", (p == "peak") & (F.col("train_type") == "fast"), FAST_IN_PEAK), ("train ahead cancelled", F.col("ahead_cancelled"), AHEAD_CANCELLED), ("train ahead late", ~F.col("ahead_cancelled") & (F.col("ahead_delay") >= AHEAD_LATE_MINUTES), AHEAD_LATE),
        ("starts here", F.col("starts_here"), STARTS_HERE), ("15 cars", F.col("car_count") == 15, FIFTEEN_CAR), ("AC", F.col("ac"), AC), ("ladies' special", F.col("is_ladies_special"), LADIES),
    ]
    score = F.lit(BASE) + change
    for _, holds, value in terms:
        score = score + F.when(F.coalesce(holds, F.lit(False)), value).otherwise(0.0)
    reasons = F.filter(F.array(p, *[F.when(F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds, _ in terms]), lambda x: x.isNotNull())
    return t.withColumn("rule_score", F.least(F.lit(5.0), F.greatest(F.lit(1.0), score))).withColumn("reasons", reasons)


def said_reports(reports: DataFrame, matches: DataFrame, trains: DataFrame, places: DataFrame) -> DataFrame:
    """What riders' reports say of crowding: place, line, type, clock minute, matched train if any, and when.

    ``reports(id, station_code, train_description, reported_at, crowd_level)``
    may name a line; ``matches(id, train_id)`` has null where none was found.
    The line is the matched train's, else the one named, else the station's
    home line. Reports whose text names no clock, no type or another station
    say nothing here.
    """
    told = train_description(F.col("train_description"))
    r = reports.withColumn("told", told).filter("told.seconds IS NOT NULL AND told.train_type IS NOT NULL AND told.station_code = station_code")
    r = r.join(matches.filter("train_id IS NOT NULL").select("id", "train_id"), "id", "left").join(trains.select("train_id", F.col("line").alias("train_line")), "train_id", "left").join(home_lines(places), "station_code", "left")
    line = F.coalesce("train_line", *(["line"] if "line" in reports.columns else []), "home")
    return r.select("station_code", line.alias("line"), F.col("told.train_type").alias("train_type"), "train_id", F.floor(F.col("told.seconds") / 60).alias("minute"), F.unix_seconds("reported_at").alias("at_s"), "crowd_level")


#: Sizes of the blocks of minutes, as powers of two: the largest divides a day.
_SIZES = range(6)


def _blocks_of_window(minute: Column, width: int) -> Column:
    """Blocks (k, number) of 2^k minutes that make up the minutes within ``width`` of one, round the clock; about ten."""
    low, high = minute - width + 1440, minute + width + 1441
    ends = [(F.ceil(low / 2**k), F.floor(high / 2**k)) for k in (*_SIZES, len(_SIZES))]
    whole = [F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>")) for a, b in ends]
    alone = lambda k: whole[k] if k + 1 == len(_SIZES) else F.filter(whole[k], lambda x: ~((F.shiftright(x, 1) >= ends[k + 1][0]) & (F.shiftright(x, 1) < ends[k + 1][1])))
    out = [F.transform(alone(k), lambda x: F.struct(F.lit(k).alias("k"), F.pmod(x, F.lit(1440 >> k)).alias("block"))) for k in _SIZES]
    return F.concat(*out)


def sums_in_window(asks: DataFrame, points: DataFrame, keys: list[str], width: int | None) -> DataFrame:
    """``asks`` with ``n`` and ``total`` of the ``points`` of its keys from ``since`` to ``until``, and within ``width`` minutes of its minute of the day.

    ``asks(keys, minute, since, until)`` are distinct; ``points(keys, minute,
    at_s, crowd_level)``. A table of running sums over time stands for every
    block of 1 to 32 minutes: a point is in six of them, a window of minutes is
    made of about ten, and each is asked at both ends of the time. So points
    and asks never meet in pairs, and work grows with their number only.
    Without ``width`` the minute of the day does not count.
    """
    every = F.array(F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("block")))
    of_point = every if width is None else F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright(F.col("minute").cast("long"), k).alias("block")) for k in _SIZES])
    of_ask = every if width is None else _blocks_of_window(F.col("minute").cast("long"), width)
    own = [*keys, "minute", "since", "until"]
    added = points.groupBy(*keys, "minute", "at_s").agg(F.count("*").alias("n_"), F.sum("crowd_level").alias("s_"))
    added = added.select(*keys, F.explode(of_point).alias("b"), F.col("at_s").alias("t"), F.lit(0).alias("side"), "n_", "s_")
    ask = F.struct(*own)
    ends = F.expr("array(named_struct('t', since - 1, 'sign', -1), named_struct('t', until, 'sign', 1))")
    asked = asks.select(*keys, ask.alias("ask"), F.explode(of_ask).alias("b"), ends.alias("ends")).select(*keys, "ask", "b", F.explode("ends").alias("e")).select(*keys, "ask", "b", F.col("e.t").alias("t"), F.col("e.sign").alias("sign"), F.lit(1).alias("side"))
    both = added.unionByName(asked, allowMissingColumns=True).select("*", "b.k", "b.block")
    past = Window.partitionBy(*keys, "k", "block").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("n", F.coalesce(F.sum("n_").over(past), F.lit(0))).withColumn("total", F.coalesce(F.sum("s_").over(past), F.lit(0))).filter("side = 1")
    return seen.groupBy("ask").agg(F.sum(F.col("sign") * F.col("n")).alias("n"), F.sum(F.col("sign") * F.col("total")).alias("total")).select("ask.*", "n", "total").filter("n > 0")


def _asks(trips: DataFrame, keys: list[str]) -> DataFrame:
    now = F.unix_seconds("at")
    return trips.select("key", *keys, "minute", (now - REPORT_DAYS * 86400).alias("since"), now.alias("until"))


def similar_reports(trips: DataFrame, reports: DataFrame) -> DataFrame:
    """Per trip the number and sum of levels of other trains' reports at its station, type and line near its time of day, not too old.

    ``trips`` has key, station_code, line, train_type, train_id, minute and at,
    the moment it is asked for; ``reports`` as ``said_reports``. Those of the
    trip's own train are counted by the same rule and taken off.
    """
    place = ["station_code", "line", "train_type"]
    own = ["minute", "since", "until"]
    asks = _asks(trips, [*place, "train_id"])
    near = sums_in_window(asks.select(*place, *own).distinct(), reports, place, REPORT_WINDOW)
    same = sums_in_window(asks.select(*place, "train_id", *own).distinct(), reports.filter("train_id IS NOT NULL"), [*place, "train_id"], REPORT_WINDOW)
    met = asks.join(near, [*place, *own]).join(same.withColumnsRenamed({"n": "own_n", "total": "own_total"}), [*place, "train_id", *own], "left")
    met = met.select("key", (F.col("n") - F.coalesce("own_n", F.lit(0))).alias("similar_n"), (F.col("total") - F.coalesce("own_total", F.lit(0))).alias("similar_sum"))
    return met.filter("similar_n > 0")


def train_reports(trips: DataFrame, reports: DataFrame) -> DataFrame:
    """Per trip the number and sum of levels of reports of this very train at its station, not too old."""
    of = ["station_code", "train_id"]
    asks = _asks(trips, of).withColumn("minute", F.lit(0))
    found = sums_in_window(asks.drop("key").distinct(), reports.filter("train_id IS NOT NULL").withColumn("minute", F.lit(0)), of, None)
    return asks.join(found, [*of, "minute", "since", "until"]).select("key", F.col("n").alias("own_n"), F.col("total").alias("own_sum"))


def crowding_estimate(scored: DataFrame, similar: DataFrame, own: DataFrame) -> DataFrame:
    """Rule score blended with reports by how many there are; halves round down."""
    s = scored.join(similar, "key", "left").join(own, "key", "left").na.fill(0, ["similar_n", "similar_sum", "own_n", "own_sum"])
    weight = F.when(F.col("own_n") > 0, SIMILAR_WEIGHT).otherwise(1.0)
    n = F.col("own_n") + weight * F.col("similar_n")
    mean = F.when(n > 0, (F.col("own_sum") + weight * F.col("similar_sum")) / F.nullif(n, F.lit(0.0)))
    share = n / (n + HALF_WEIGHT)
    blended = F.when(n > 0, (1 - share) * F.col("rule_score") + share * mean).otherwise(F.col("rule_score"))
    return s.withColumn("crowd_score", F.least(F.lit(5), F.greatest(F.lit(1), F.ceil(blended - 0.5))).cast("int"))
