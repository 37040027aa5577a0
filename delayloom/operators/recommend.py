"""Take this train or wait: options per request with delays and crowding, and the choice among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import runs_ac, sunday_schedule
from ..session import kept
from .crowding import crowding_estimate, rule_score, similar_reports, train_reports
from .journeys import local_minute, next_trains
from .runs import earlier_values


def baseline_predictions(targets: DataFrame, clean: DataFrame, least: int = 5) -> DataFrame:
    """``targets(key, train_id, station_code, service_day)`` with the earlier days' median and, from ``least`` readings on, their spread; with fewer the range is the median alone."""
    q = earlier_values(targets, clean, "service_day", "delay_minutes", [0.1, 0.5, 0.9])
    end = lambda i: F.when(F.col("n") >= least, F.col("q")[i]).otherwise(F.col("q")[1])
    return targets.join(q, ["train_id", "station_code", "service_day"]).select("key", end(0).alias("low"), F.col("q")[1].alias("delay"), end(2).alias("high"), "n")


def cancelled_trains(trips: DataFrame, obs: DataFrame, hours: int = 4) -> DataFrame:
    """``req_id, train_id`` of ``trips(req_id, train_id, at)`` whose train was read as cancelled in the hours before; both meet on train and slot of that length."""
    width = hours * 3600
    slot = lambda c: F.floor(F.unix_seconds(c) / width)
    c = obs.filter("cancelled").select("train_id", "observed_at", F.explode(F.array(slot(F.col("observed_at")), slot(F.col("observed_at")) + 1)).alias("slot"))
    r = trips.select("req_id", "train_id", "at", slot(F.col("at")).alias("slot"))
    return r.join(c, ["train_id", "slot"]).filter(f"observed_at <= at AND observed_at >= at - INTERVAL {hours} HOURS").select("req_id", "train_id").distinct()


def delay_levels(targets: DataFrame, model: DataFrame, baseline: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """Per target the best delay there is, and where it comes from: model, baseline or timetable.

    ``targets(key, station_code, ...)``; ``model`` and ``baseline`` have key,
    delay, low and high. With ``covered(station_code)`` the model is used only
    at the stations it was trained on; elsewhere the baseline stands in.
    """
    side = lambda df, p: df.select("key", *[F.col(c).alias(f"{p}_{c}") for c in ("delay", "low", "high")], F.lit(True).alias(f"has_{p}"))
    t = targets if covered is None else targets.join(covered.select("station_code", F.lit(True).alias("covered_")), "station_code", "left")
    inside = F.lit(True) if covered is None else F.coalesce("covered_", F.lit(False))
    t = t.join(side(model, "m"), "key", "left").join(side(baseline, "b"), "key", "left")
    by_model, by_past = F.coalesce("has_m", F.lit(False)) & inside, F.coalesce("has_b", F.lit(False))
    pick = lambda c: F.when(by_model, F.col(f"m_{c}")).when(by_past, F.col(f"b_{c}"))
    return t.select(*targets.columns, F.when(by_model, "model").when(by_past, "baseline").otherwise("timetable").alias("level"), F.coalesce(pick("delay"), F.lit(0.0)).alias("delay"), pick("low").alias("low"), pick("high").alias("high"))


def usable_model(registry: DataFrame, allow_synthetic: bool = False) -> DataFrame:
    """The promoted version of ``registry(version, status, is_synthetic)``, if it may be used: one trained on synthetic data only where allowed."""
    return registry.filter((F.col("status") == "promoted") & (F.lit(allow_synthetic) | ~F.coalesce("is_synthetic", F.lit(False))))


def live_readings(options: DataFrame, clean: DataFrame, max_age: int = 30) -> DataFrame:
    """Latest reading of each option's run at or before its boarding place, taken at most ``max_age`` minutes before the request and never after it."""
    o = options.select("req_id", "train_id", "service_day", "at", F.col("o_seq").alias("board"))
    c = clean.select("train_id", "service_day", "observed_at", "id", "delay_minutes", (F.col("point_seq") + 1).alias("seq"))
    met = o.join(c, ["train_id", "service_day"]).filter(f"seq <= board AND observed_at <= at AND observed_at >= at - INTERVAL {max_age} MINUTES")
    return met.groupBy("req_id", "train_id", "service_day").agg(F.max_by("delay_minutes", F.struct("observed_at", "id")).alias("live_delay"))


def boarding_trips(requests: DataFrame, stops: DataFrame, trains: DataFrame, candidates: int = 5, lookback: int = 45) -> DataFrame:
    """The next trains of each request (``earlier`` false), and those that should have left in the ``lookback`` minutes before.

    Of the latter at most three times ``candidates`` are looked at, from the
    earliest on. Both come from the numbered lists of a day's departures, so a
    request meets a bounded number of trains in either direction.
    """
    ask = lambda earlier, n, at: requests.select(F.struct("req_id", F.lit(earlier).alias("earlier"), F.col("at").alias("asked_at")).alias("req_id"), "origin", "destination", at.alias("at"), F.lit(n).alias("most"))
    both = ask(False, candidates, F.col("at")).unionByName(ask(True, 3 * candidates, F.col("at") - F.make_dt_interval(mins=F.lit(lookback))))
    t = next_trains(both, stops, trains, "most")
    t = t.withColumn("earlier", F.col("req_id.earlier")).withColumn("at", F.col("req_id.asked_at")).withColumn("req_id", F.col("req_id.req_id")).withColumn("now", local_minute(F.col("at"))).drop("most", "place")
    return t.filter("NOT earlier OR dep < now")


def catchable(trips: DataFrame, live: DataFrame) -> DataFrame:
    """``trips`` in the order in which they are told: per line the last train gone, late trains still to be caught, next trains.

    ``live(req_id, train_id, service_day, live_delay)``; a reading that rounds
    to no delay or less says nothing. An earlier train whose departure and
    delay together lie ahead is an option again. ``place`` is 0 for a train
    gone (no option), 1 for a late and 2 for a next one.
    """
    late = live.filter(F.rint("live_delay") > 0)
    t = trips.join(late, ["req_id", "train_id", "service_day"], "left")
    ahead = F.col("dep") + F.rint("live_delay") >= F.col("now")
    t = t.withColumn("place", F.when(~F.col("earlier"), 2).when(F.coalesce(ahead, F.lit(False)), 1).otherwise(0))
    line = Window.partitionBy("req_id", "line")
    last = F.max(F.when(F.col("place") == 0, F.struct("dep", "arr", "train_id"))).over(line)
    t = t.withColumn("last_", last).withColumn("wanted_", F.max("place").over(line) > 0)
    return t.filter((F.col("place") > 0) | (F.col("wanted_") & (F.struct("dep", "arr", "train_id") == F.col("last_")))).drop("last_", "wanted_")


def _forecasts(trips: DataFrame, clean: DataFrame, model: DataFrame | None, covered: DataFrame | None) -> DataFrame:
    """``trips`` with the delays foretold at both ends (null: nothing is known), the range at the destination, and the request's level."""
    run = ["req_id", "train_id", "service_day"]
    at_end = trips.select(*run, F.explode(F.array(F.struct(F.lit("from").alias("end"), F.col("origin").alias("station_code")), F.struct(F.lit("to").alias("end"), F.col("destination").alias("station_code")))).alias("x")).select(*run, "x.*")
    targets = at_end.select(F.struct(*run, "end").alias("key"), "train_id", "station_code", "service_day")
    past = baseline_predictions(targets, clean).select("key.*", *[F.col(c).alias(f"b_{c}") for c in ("delay", "low", "high")])
    told = at_end.join(past, [*run, "end"], "left")
    if model is None:
        by_model = F.lit(False)
        told = told.withColumns({f"m_{c}": F.lit(None).cast("double") for c in ("delay", "low", "high")}).withColumn("reached", F.lit(False)).withColumn("covered_", F.lit(False))
    else:
        m = model.select(*run, "station_code", *[F.col(c).alias(f"m_{c}") for c in ("delay", "low", "high")])
        told = told.join(m, [*run, "station_code"], "left")
        told = told.withColumn("covered_", F.lit(True)) if covered is None else told.join(covered.select("station_code", F.lit(True).alias("covered_")), "station_code", "left").withColumn("covered_", F.coalesce("covered_", F.lit(False)))
        told = told.withColumn("reached", F.max("covered_").over(Window.partitionBy("req_id")))
        by_model = F.col("reached") & F.col("covered_")
    pick = lambda c: F.when(by_model, F.col(f"m_{c}")).otherwise(F.col(f"b_{c}"))
    told = told.select(*run, "end", "reached", *[pick(c).alias(c) for c in ("delay", "low", "high")])
    end = lambda e, c: F.max(F.when(F.col("end") == e, F.col(c)))
    ends = told.groupBy(*run, "reached").agg(end("from", "delay").alias("from_delay"), end("to", "delay").alias("to_delay"), end("to", "low").alias("to_low"), end("to", "high").alias("to_high"))
    known = F.max(F.col("from_delay").isNotNull() | F.col("to_delay").isNotNull()).over(Window.partitionBy("req_id"))
    return trips.join(ends.withColumn("level", F.when(F.col("reached"), "model").when(known, "baseline").otherwise("timetable")).drop("reached"), run)


def apply_live(trips: DataFrame) -> DataFrame:
    """Delays at both ends and the range of arrival: what is foretold, and where a live reading is there, that from boarding on.

    A live reading replaces the delay at boarding; the change foretold on the
    way stays, so arrival and its range move along with it.
    """
    start, end = F.coalesce("from_delay", F.lit(0.0)), F.coalesce("to_delay", F.lit(0.0))
    shift = F.when(F.col("live_delay").isNotNull(), F.greatest(F.col("live_delay"), F.lit(0.0)) - start).otherwise(F.lit(0.0))
    ranged = (F.col("level") != "timetable") & (F.col("to_high") > F.col("to_low"))
    t = trips.withColumn("delay", start + shift).withColumn("arrival_delay", end + shift)
    t = t.withColumn("arrival_low", F.when(ranged, F.col("to_low") + shift)).withColumn("arrival_high", F.when(ranged, F.col("to_high") + shift))
    return t.withColumn("expected_dep", F.col("dep") + F.rint("delay")).withColumn("expected_arr", F.col("arr") + F.rint("arrival_delay")).drop("from_delay", "to_delay", "to_low", "to_high")


def train_before(options: DataFrame) -> DataFrame:
    """``options`` with what is known of the train before it on its line, of which the first may be one that is gone."""
    before = Window.partitionBy("req_id", "line").orderBy("place", "dep", "arr", "train_id")
    known = F.lag(F.when((F.col("level") != "timetable") | F.col("live_delay").isNotNull(), F.col("delay"))).over(before)
    return options.withColumn("ahead_cancelled", F.coalesce(F.lag("cancelled").over(before), F.lit(False))).withColumn("ahead_delay", known)


def options_for(
    requests: DataFrame, stops: DataFrame, trains: DataFrame, clean: DataFrame, obs: DataFrame, candidates: int = 5, model: DataFrame | None = None, covered: DataFrame | None = None, reports: DataFrame | None = None
) -> DataFrame:
    """The trains that each request may take, with cancellation, delays at both ends, expected times and crowding.

    Options are the next trains and earlier ones that run so late that they can
    still be caught. ``model`` has a trained model's forecasts (req_id,
    train_id, service_day, station_code, delay, low, high); it is used for a
    request if either end is ``covered``, and there at the covered ends. Other
    ends have the earlier days' median, and without one the timetable. A late
    live reading replaces the delay at boarding (``apply_live``); one that is
    on time or early never overrides the past. The train before on the same
    line adds to crowding when it is late or cancelled; riders' ``reports``
    (``crowding.said_reports``) up to the request are blended in.
    """
    trips = kept(boarding_trips(requests, stops, trains, candidates), "trips")  # read by each of the joins below
    told = kept(catchable(trips, live_readings(trips, clean)), "told")
    gone = cancelled_trains(told, obs).withColumn("cancelled", F.lit(True))
    t = apply_live(_forecasts(told, clean, model, covered)).join(gone, ["req_id", "train_id"], "left").withColumn("cancelled", F.coalesce("cancelled", F.lit(False)))
    t = train_before(t).filter("place > 0")
    t = t.withColumn("hour", F.pmod("dep", F.lit(1440)) / 60).withColumn("sunday", sunday_schedule(F.col("service_day"))).withColumn("starts_here", F.col("o_seq") == 1).withColumn("ac", runs_ac(F.col("is_ac"), F.col("ac_weekdays_only"), F.col("service_day")))
    scored = rule_score(t)
    if reports is None:
        return scored.withColumn("crowd_score", F.ceil(F.col("rule_score") - 0.5).cast("int"))
    asks = told.filter("place > 0").select(F.struct("req_id", "train_id", "service_day").alias("key"), F.col("origin").alias("station_code"), "line", "train_type", "train_id", F.pmod("dep", F.lit(1440)).alias("minute"), "at")
    keyed = scored.withColumn("key", F.struct("req_id", "train_id", "service_day"))
    return crowding_estimate(keyed, similar_reports(asks, reports), train_reports(asks, reports)).drop("key")


def choose(options: DataFrame, very_late: float = 15, slack: float = 10, extra: float = 5, gain: int = 1, ladies_ok: bool = False) -> DataFrame:
    """One pick per request and the rule behind it.

    Earliest expected arrival first; if that train is very late and a steadier
    one arrives soon after, the steadier one; then a clearly emptier train that
    arrives little later. Cancelled trains and (by default) ladies' specials
    are never picked. ``wait`` says that a running train leaves before the pick.
    """
    late = F.col("delay") >= very_late
    running = options.filter(~F.col("cancelled") & (F.lit(ladies_ok) | ~F.col("is_ladies_special"))).withColumn("very_late", late)
    order = F.struct("expected_arr", "dep", *(["place"] if "place" in options.columns else []), *(["arr"] if "arr" in options.columns else []), "train_id")
    req = Window.partitionBy("req_id")
    r = running.withColumn("order", order).withColumn("first", F.min(F.struct("order", "expected_arr", "very_late")).over(req))
    steady = F.when(F.col("first.very_late") & ~F.col("very_late") & (F.col("expected_arr") <= F.col("first.expected_arr") + slack), F.col("order"))
    r = r.withColumn("steady", F.min(steady).over(req)).withColumn("base", F.coalesce("steady", F.col("first.order")))
    r = r.withColumn("base_crowd", F.max(F.when(F.col("order") == F.col("base"), F.col("crowd_score"))).over(req))
    empty = F.when((F.col("order") != F.col("base")) & (F.col("expected_arr") <= F.col("base.expected_arr") + extra) & (F.col("crowd_score") <= F.col("base_crowd") - gain) & ~F.col("very_late"), F.struct("crowd_score", "order"))
    r = r.withColumn("empty", F.min(empty).over(req)).withColumn("pick", F.coalesce(F.col("empty.order"), F.col("base")))
    r = r.withColumn("pick_dep", F.max(F.when(F.col("order") == F.col("pick"), F.col("expected_dep"))).over(req)).withColumn("wait", F.max((F.col("order") != F.col("pick")) & (F.col("expected_dep") < F.col("pick_dep"))).over(req)).withColumn("running", F.count("*").over(req))
    rule = F.when(F.col("empty").isNotNull(), "crowding").when(F.col("steady").isNotNull(), "very_late").when(F.col("running") == 1, "only").otherwise("earliest")
    return r.filter("order = pick").select("req_id", "train_id", "dep", "expected_arr", "crowd_score", "wait", rule.alias("rule"))


def now_minute(requests: DataFrame) -> DataFrame:
    return requests.withColumn("now", local_minute(F.col("at")))
