"""Journeys over tables of requests: next trains, lines that cover a pair, changes, and reasons for none."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import mask_index
from ..session import kept

DAY_LIST = ["origin", "destination", "today", "yesterday"]


def local_minute(instant: Column) -> Column:
    """Minutes of local time since the epoch."""
    return F.floor((F.unix_seconds(instant) + 19800) / 60)


def legs(stops: DataFrame, trains: DataFrame) -> DataFrame:
    """Every ordered pair of calls of a train: origin, destination, minutes after the run's start."""
    info = trains.select("train_id", "line", "direction", "train_type", "run_start_min", "is_ac", "ac_weekdays_only", "is_ladies_special", "car_count")
    a = stops.select("train_id", "days", F.col("station_code").alias("origin"), F.col("stop_seq").alias("o_seq"), F.col("minutes").alias("o_min"))
    b = stops.select("train_id", F.col("station_code").alias("destination"), F.col("stop_seq").alias("d_seq"), F.col("minutes").alias("d_min"))
    return a.join(b, "train_id").filter("o_seq < d_seq").join(info, "train_id")


def day_lists(asked: DataFrame, stops: DataFrame, trains: DataFrame) -> DataFrame:
    """Departures of one calendar day for each ``asked(origin, destination, today, yesterday)``, numbered by departure, arrival and id.

    ``today`` and ``yesterday`` are places in the running mask: runs that
    started on the day itself and, after midnight, those of the day before.
    -1 stands for a day whose runs don't count. There are as many lists as
    pairs of stations and kinds of neighbouring days, however many requests.
    """
    start = F.col("run_start_min") + F.col("o_min")
    on = lambda c: F.substr("days", F.col(c) + 1, F.lit(1)) == "Y"
    t = legs(stops, trains).withColumn("minute", F.pmod(start, F.lit(1440))).withColumn("nights", F.floor(start / 1440))
    met = asked.select("origin", "destination", "today", "yesterday").distinct().join(t, ["origin", "destination"])
    met = met.filter(((F.col("nights") == 0) & (F.col("today") >= 0) & on("today")) | ((F.col("nights") == 1) & (F.col("yesterday") >= 0) & on("yesterday")))
    order = Window.partitionBy(*DAY_LIST).orderBy("minute", F.col("d_min") - F.col("o_min"), "train_id")
    return met.drop("days").withColumn("rank", F.row_number().over(order))


def next_trains(requests: DataFrame, stops: DataFrame, trains: DataFrame, n: int | str = 5, holidays: Sequence[date] = ()) -> DataFrame:
    """First ``n`` trains of each ``requests(req_id, origin, destination, at)``, by departure, arrival and id; ``n`` may name a column of requests.

    The run may have started on the day before, of or after the request. Only
    runs whose mask has the service day count; on ``holidays``, the movable
    ones in force, as on fixed ones, trains run as on Sundays.

    A request looks into the departures of its day from its minute on, of the
    next day, and of the small hours after. Where a list starts for a minute is
    found once per list and minute; then a request meets exactly the entries it
    takes, so work grows with requests times ``n``.
    """
    now, none = F.col("now_"), F.lit(-1)
    kind = lambda k: mask_index(F.date_from_unix_date((F.floor(F.col("now_") / 1440) + k).cast("int")), holidays)
    looks = [F.struct(F.lit(k).alias("k"), today.alias("today"), yesterday.alias("yesterday"), since.cast("long").alias("since")) for k, today, yesterday, since in (
        (0, kind(0), kind(-1), F.pmod(now, F.lit(1440))), (1, kind(1), kind(0), F.lit(0)), (2, none, kind(1), F.lit(0)))]
    row = F.struct(*[F.col(f"`{c}`") for c in requests.columns]).alias("row_")
    asked = requests.withColumn("now_", local_minute(F.col("at"))).select("req_id", "origin", "destination", row, F.floor(now / 1440).alias("day_"), F.explode(F.array(*looks)).alias("x")).select("*", "x.*").drop("x")
    lists = day_lists(asked, stops, trains)
    length = lists.groupBy(*DAY_LIST).agg(F.count("*").alias("length"))
    moments = asked.filter("since > 0").select(*DAY_LIST, "since").distinct()
    both = lists.select(*DAY_LIST, F.col("minute").alias("since"), F.lit(1).alias("train_")).unionByName(moments.withColumn("train_", F.lit(0)))
    ahead = Window.partitionBy(*DAY_LIST).orderBy("since", "train_").rowsBetween(Window.unboundedPreceding, -1)
    gone = both.withColumn("gone", F.coalesce(F.sum("train_").over(ahead), F.lit(0))).filter("train_ = 0").select(*DAY_LIST, "since", "gone")
    found = asked.join(length, DAY_LIST).join(gone, [*DAY_LIST, "since"], "left").withColumn("gone", F.coalesce("gone", F.lit(0)))
    earlier = Window.partitionBy("req_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("left_", F.col("length") - F.col("gone")).withColumn("have", F.coalesce(F.sum("left_").over(earlier), F.lit(0)))
    found = found.withColumn("take", F.least("left_", (F.col("row_")[n] if isinstance(n, str) else F.lit(n)) - F.col("have"))).filter("take > 0").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("take"))))
    found = found.select(*DAY_LIST, "row_", (F.col("day_") + F.col("k")).alias("day_no"), (F.col("gone") + F.col("i")).alias("rank"), (F.col("have") + F.col("i")).cast("int").alias("place"))
    trips = found.join(lists, [*DAY_LIST, "rank"]).withColumn("dep", F.col("day_no") * 1440 + F.col("minute"))
    other = [c for c in requests.columns if c not in ("origin", "destination")]
    leg = [c for c in lists.columns if c not in (*DAY_LIST, "minute", "nights", "rank")]
    return trips.select("origin", "destination", *[F.col("row_")[c].alias(c) for c in other], *leg, F.date_from_unix_date((F.col("day_no") - F.col("nights")).cast("int")).alias("service_day"), "dep", (F.col("dep") + F.col("d_min") - F.col("o_min")).alias("arr"), "place")


def asked_once(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests of the same ends and moment are one question: ``questions(req_id, origin, destination, at)``, and ``req_id, question`` of each request."""
    asked = requests.select("req_id", F.struct("origin", "destination", "at").alias("question"))
    return asked.select("question").distinct().select(F.col("question").alias("req_id"), "question.*"), asked


def told_to_all(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """``answers`` to questions as answers to the requests that asked them (``asked_once``)."""
    return answers.withColumnRenamed("req_id", "question").join(asked, "question").select(*answers.columns)


def pairs_of(requests: DataFrame) -> DataFrame:
    return requests.select("origin", "destination").distinct()


def covering_lines(pairs: DataFrame, stops: DataFrame, trains: DataFrame) -> DataFrame:
    return pairs.join(legs(stops, trains).select("origin", "destination", "line", "direction").distinct(), ["origin", "destination"])


def missing_direction(pairs: DataFrame, stops: DataFrame, trains: DataFrame) -> DataFrame:
    """Pairs and lines with trains only the other way."""
    lines = legs(stops, trains).select("origin", "destination", "line").distinct()
    back = lines.select(F.col("origin").alias("destination"), F.col("destination").alias("origin"), "line")
    return pairs.join(back, ["origin", "destination"]).join(lines, ["origin", "destination", "line"], "left_anti").select("origin", "destination", "line")


def interchanges(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """Stations on both a line of the origin and another line of the destination."""
    return _interchanges(pairs, places).select("origin", "destination", "change")


def _interchanges(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """``interchanges`` with ``order``, the first place that a station has on a line."""
    on = places.select("code", "line")
    a = pairs.join(on.select(F.col("code").alias("origin"), F.col("line").alias("l1")), "origin").join(on.select(F.col("code").alias("destination"), F.col("line").alias("l2")), "destination").filter("l1 <> l2")
    both = on.select(F.col("code").alias("change"), F.col("line").alias("l1")).join(on.select(F.col("code").alias("change"), F.col("line").alias("l2")), "change")
    met = a.join(both, ["l1", "l2"]).filter("change <> origin AND change <> destination").select("origin", "destination", "change").distinct()
    return met.join(places.groupBy(F.col("code").alias("change")).agg(F.min("seq").alias("order")), "change")


def one_change(requests: DataFrame, stops: DataFrame, trains: DataFrame, places: DataFrame, least: int = 5, most: int = 60, first: int = 6, second: int = 3) -> DataFrame:
    """Best journey with one change of each request: earliest arrival, then latest departure, then the first interchange along the lines.

    At each interchange the next ``first`` trains there are tried, each with the
    first of the next ``second`` trains onward that isn't a ladies' special and
    leaves ``least`` to ``most`` minutes after the arrival. First trains that
    are ladies' specials don't count. Where the way on from an interchange runs
    in a direction of which nothing is loaded, one changes neither there nor
    further along a train that calls there; where that is so of a way to an
    interchange, journeys that go out (down) and back (up) don't count.

    A journey depends on the ends and the minute only: what many ask is
    answered once.
    """
    requests, asked = asked_once(requests.withColumn("at", F.timestamp_seconds(F.floor(F.unix_seconds("at") / 60) * 60)))
    inter = kept(_interchanges(pairs_of(requests), places), "interchanges")
    lacking = lambda a, b: missing_direction(inter.select(F.col(a).alias("origin"), F.col(b).alias("destination")).distinct(), stops, trains).select(F.col("origin").alias(a), F.col("destination").alias(b)).distinct()
    pair = ["origin", "destination"]
    avoid = inter.join(lacking("change", "destination"), ["change", "destination"]).select(*pair, "change")
    turned = inter.join(lacking("origin", "change"), ["origin", "change"]).select("origin", F.col("destination").alias("goal")).distinct().withColumn("turned", F.lit(True))
    via = requests.join(inter.join(avoid, [*pair, "change"], "left_anti"), pair).withColumnRenamed("destination", "goal").withColumnRenamed("change", "destination")
    one = next_trains(via.withColumn("req_id", F.struct("req_id", "destination", "order")), stops, trains, first).filter("NOT is_ladies_special")
    leg = one.select(F.col("req_id.req_id").alias("req"), "origin", F.col("destination").alias("change"), F.col("req_id.order").alias("order"), "goal", F.col("train_id").alias("train_1"), F.col("direction").alias("way_1"), F.col("dep").alias("dep_1"), F.col("arr").alias("arr_1"), "o_seq", "d_seq")
    leg = kept(leg, "first-legs")
    past = avoid.select("origin", F.col("destination").alias("goal"), F.col("change").alias("avoided")).join(stops.select(F.col("train_id").alias("train_1"), F.col("station_code").alias("avoided"), "stop_seq"), "avoided")
    long = leg.join(past, ["origin", "goal", "train_1"]).filter("stop_seq > o_seq AND stop_seq < d_seq").select("req", "change", "train_1", "dep_1").distinct()
    leg = leg.join(long, ["req", "change", "train_1", "dep_1"], "left_anti").join(turned, ["origin", "goal"], "left")
    key = F.struct("req", "change", "order", "train_1", "way_1", "dep_1", "arr_1", F.coalesce("turned", F.lit(False)).alias("turned"))
    again = leg.select(key.alias("req_id"), F.col("change").alias("origin"), F.col("goal").alias("destination"), F.timestamp_seconds((F.col("arr_1") + least) * 60 - 19800).alias("at"))
    two = next_trains(again, stops, trains, second).filter(F.col("dep") <= F.col("req_id.arr_1") + most).filter("NOT is_ladies_special")
    onward = two.groupBy("req_id").agg(F.min(F.struct("dep", "arr", "train_id", "direction")).alias("t")).select("req_id.*", "t.*")
    onward = onward.filter(~(F.col("turned") & (F.col("way_1") == "down") & (F.col("direction") == "up")))
    best = onward.groupBy(F.col("req").alias("req_id")).agg(F.min(F.struct("arr", (-F.col("dep_1")).alias("late"), "order", "change", "arr_1", "train_1", F.col("train_id").alias("train_2"))).alias("b"))
    best = best.select("req_id", F.col("b.arr").alias("arr"), (-F.col("b.late")).alias("dep"), F.col("b.change").alias("change"), F.col("b.train_1").alias("train_1"), F.col("b.train_2").alias("train_2"))
    return told_to_all(best, asked)


def no_train_reason(pairs: DataFrame, stops: DataFrame, trains: DataFrame, places: DataFrame) -> DataFrame:
    """Why a pair has no through train: served, direction missing, no common line, or no single train."""
    served = covering_lines(pairs, stops, trains).select("origin", "destination").distinct().withColumn("served", F.lit(True))
    other = missing_direction(pairs, stops, trains).select("origin", "destination").distinct().withColumn("other", F.lit(True))
    on = places.select("code", "line")
    shared = pairs.join(on.withColumnRenamed("code", "origin"), "origin").join(on.withColumnRenamed("code", "destination"), ["destination", "line"]).select("origin", "destination").distinct().withColumn("shared", F.lit(True))
    out = pairs.join(served, ["origin", "destination"], "left").join(other, ["origin", "destination"], "left").join(shared, ["origin", "destination"], "left")
    return out.select("origin", "destination", F.when(F.col("served"), "served").when(F.col("other"), "direction_missing").when(F.col("shared").isNull(), "different_lines").otherwise("no_single_train").alias("reason"))
