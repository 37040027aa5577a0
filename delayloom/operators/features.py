"""Point-in-time features: nothing in a row was known only after its cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import local_time, service_day, sunday_schedule
from .runs import earlier_values


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, columns: list[str], tie: str) -> DataFrame:
    """Each left row with ``columns`` of the latest right row of its keys at or before its time; ties in time go to the larger ``tie``.

    Both sides are merged and carried forward in one window: one shuffle on the
    keys, whatever the number of matches a plain range join would make.
    """
    pack = F.struct(*[F.col(c) for c in columns])
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    a = left.select(*keys, F.col(left_ts).alias("ts_"), F.lit(1).alias("side_"), F.lit(None).cast("long").alias("tie_"), row.alias("row_"))
    b = right.select(*keys, F.col(right_ts).alias("ts_"), F.lit(0).alias("side_"), F.col(tie).cast("long").alias("tie_"), pack.alias("pack_"))
    both = a.unionByName(b, allowMissingColumns=True)
    carried = both.withColumn("pack_", F.last("pack_", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("ts_", "side_", "tie_").rowsBetween(Window.unboundedPreceding, 0)))
    return carried.filter("side_ = 1").select("row_.*", *[F.col("pack_")[c].alias(f"prior_{c}") for c in columns])


def route_points(stops: DataFrame, trains: DataFrame, places: DataFrame) -> DataFrame:
    """All places a train passes: its stops, and between two stops the skipped places with interpolated times."""
    order = Window.partitionBy("train_id").orderBy("stop_seq")
    s = stops.join(trains.select("train_id", "line"), "train_id").withColumn("next_seq", F.lead("station_seq").over(order)).withColumn("next_minutes", F.lead("minutes").over(order))
    step = F.when(F.col("next_seq") > F.col("station_seq"), 1).otherwise(-1)
    s = s.withColumn("passed", F.when(F.abs(F.coalesce("next_seq", "station_seq") - F.col("station_seq")) > 1, F.sequence(F.col("station_seq") + step, F.col("next_seq") - step)).otherwise(F.array().cast("array<int>")))
    share = (F.col("seq") - F.col("station_seq")) / (F.col("next_seq") - F.col("station_seq"))
    between = s.withColumn("seq", F.explode("passed")).select("train_id", "line", "seq", (F.col("minutes") + share * (F.col("next_minutes") - F.col("minutes"))).alias("minutes"), F.lit(False).alias("is_stop"))
    points = s.select("train_id", "line", F.col("station_seq").alias("seq"), F.col("minutes").cast("double").alias("minutes"), F.lit(True).alias("is_stop")).unionByName(between)
    points = points.join(places.select("line", "seq", F.col("code").alias("station_code")), ["line", "seq"])
    along = Window.partitionBy("train_id")
    return points.select("train_id", "station_code", (F.row_number().over(along.orderBy("minutes")) - 1).alias("point_seq"), F.col("seq").alias("station_seq"), "minutes", "is_stop", F.coalesce(F.try_divide("minutes", F.max("minutes").over(along)), F.lit(0.0)).alias("progress"))


def clean_obs(obs: DataFrame, trains: DataFrame, stops: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """Readings that place a train on its route with a delay, with local time and service day; flagged readings are left out."""
    if flags is not None:
        obs = obs.join(flags.select("id").distinct(), "id", "left_anti")
    o = obs.filter("delay_minutes IS NOT NULL AND NOT coalesce(cancelled, false) AND coalesce(event, '') NOT IN ('cancelled', 'rake_at', 'unknown')")
    info = trains.select("train_id", "run_start_min", "direction", "train_type", "line", "is_ac", "car_count")
    point = stops.select("train_id", "station_code", (F.col("stop_seq") - 1).alias("point_seq"), "station_seq", F.col("minutes").alias("sched_minutes"))
    o = o.join(info, "train_id").join(point, ["train_id", "station_code"]).withColumn("local_ts", local_time(F.col("observed_at")))
    return o.withColumn("service_day", service_day(F.col("local_ts"), F.col("run_start_min"))).select("id", "observed_at", "train_id", "station_code", "delay_minutes", "batch_id", "source", "local_ts", "run_start_min", "direction", "train_type", "line", "is_ac", "car_count", "point_seq", "station_seq", "sched_minutes", "service_day")


def batches(clean: DataFrame) -> DataFrame:
    return clean.groupBy("batch_id").agg(F.max("local_ts").alias("batch_ts"))


def batch_line(clean: DataFrame) -> DataFrame:
    """State of each line and direction per poll; an arrival and a departure of one train count twice."""
    return clean.groupBy("batch_id", "line", "direction").agg(F.median("delay_minutes").alias("line_median"), F.count("*").alias("line_count"))


def batch_far(obs: DataFrame, trains: DataFrame) -> DataFrame:
    """State of the trains outside the timetable per poll: each train's mean first, then their median."""
    o = obs.filter("delay_minutes IS NOT NULL AND NOT cancelled").join(trains.select("train_id"), "train_id", "left_anti")
    return o.groupBy("batch_id", "train_id").agg(F.avg("delay_minutes").alias("d")).groupBy("batch_id").agg(F.median("d").alias("ld_median"), F.count("*").alias("ld_count"))


def training_targets(clean: DataFrame, cold_minutes: int = 10) -> DataFrame:
    """One row per reading and earlier reading of its run, and one from before the run started."""
    run = ["train_id", "service_day"]
    earlier = clean.select(*run, F.col("local_ts").alias("cutoff"), F.col("id").alias("cutoff_id"))
    warm = clean.join(earlier, run).filter("cutoff < local_ts")
    cold = clean.withColumn("cutoff", F.col("service_day").cast("timestamp") + F.make_dt_interval(mins=F.col("run_start_min") - cold_minutes)).withColumn("cutoff_id", F.lit(-1).cast("long"))
    columns = ["id", "cutoff_id", *run, "station_code", "cutoff", F.col("delay_minutes").alias("label"), F.col("local_ts").alias("label_time")]
    return warm.select(*columns).unionByName(cold.select(*columns))


def history_delay(clean: DataFrame) -> DataFrame:
    """Median and count of a train's delays at a station on days before each of its days there."""
    out = earlier_values(clean, clean, "service_day", "delay_minutes", [0.5])
    return out.select("train_id", "station_code", "service_day", F.col("q")[0].alias("hist_delay"), F.col("n").alias("hist_count"))


def prediction_targets(asked: DataFrame) -> DataFrame:
    """Targets without labels for ``asked(target_id, train_id, service_day, station_code, cutoff)``; cutoffs are local times."""
    none = F.lit(None)
    return asked.select(F.col("target_id").cast("long").alias("id"), F.lit(-1).cast("long").alias("cutoff_id"), "train_id", "service_day", "station_code", "cutoff", none.cast("double").alias("label"), none.cast("timestamp").alias("label_time"))


def batch_state(targets: DataFrame, polls: DataFrame, max_age: int = 20) -> DataFrame:
    """The latest poll at or before each cutoff, if not older than ``max_age`` minutes (by whole minutes of the clock).

    Polls and cutoffs meet in quarter-hour slots: a poll serves its slot and
    the two after it, which covers the largest age, so no global sort is needed.
    """
    slot = lambda c: F.floor(F.unix_seconds(c) / 900)
    spread = polls.select("batch_id", "batch_ts", F.explode(F.sequence(slot(F.col("batch_ts")), slot(F.col("batch_ts")) + 2)).alias("slot"))
    minute = lambda c: F.floor(F.unix_seconds(c) / 60)
    keyed = targets.select("id", "cutoff_id", "cutoff", slot(F.col("cutoff")).alias("slot"))
    met = keyed.join(spread, "slot").filter((F.col("batch_ts") <= F.col("cutoff")) & (minute(F.col("cutoff")) - minute(F.col("batch_ts")) <= max_age))
    return met.groupBy("id", "cutoff_id").agg(F.max_by("batch_id", F.struct("batch_ts", "batch_id")).alias("state_batch"))


def train_ahead(targets: DataFrame, clean: DataFrame) -> DataFrame:
    """Delay and gap of the nearest other train ahead of ours in the state poll; ``targets`` has state_batch, line, direction, train_type and our_seq.

    An as-of join on the place along the line: readings and targets of a poll,
    line, direction and type are put in the order of the way from the front,
    and each target takes the reading before it. Every reading carries the last
    one of another train along, which stands in where the nearest is our own.
    """
    group = ["state_batch", "line", "direction", "train_type"]
    way = lambda seq: F.when(F.col("direction") == "down", -F.col(seq)).otherwise(F.col(seq))  # noqa: E731  what is ahead comes first
    row = F.struct("train_id", F.col("station_seq").alias("seq"), F.col("delay_minutes").alias("d"))
    r = clean.select(F.col("batch_id").alias("state_batch"), *group[1:], way("station_seq").alias("way"), F.lit(1).alias("side"), F.col("id").alias("tie"), row.alias("near"))
    order = [F.col("way"), F.col("side"), F.col("tie").desc()]
    along = Window.partitionBy(*group).orderBy(*order)
    r = r.withColumn("last", F.lag("near").over(along))
    changed = F.when(F.col("last.train_id") != F.col("near.train_id"), F.col("last"))
    r = r.withColumn("other", F.last(changed, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))).select(*group, "way", "side", "tie", F.struct("near", "other").alias("both"))
    t = targets.filter("state_batch IS NOT NULL AND our_seq IS NOT NULL").select(*group, way("our_seq").alias("way"), F.lit(0).alias("side"), F.col("id").alias("tie"), F.struct("id", "cutoff_id", "train_id", "our_seq").alias("t"))
    met = r.unionByName(t, allowMissingColumns=True).withColumn("both", F.last("both", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))).filter("t IS NOT NULL")
    found = met.select("t.*", F.when(F.col("both.near.train_id") != F.col("t.train_id"), F.col("both.near")).otherwise(F.col("both.other")).alias("x"))
    return found.filter("x IS NOT NULL").select("id", "cutoff_id", F.col("x.d").alias("ahead_delay"), F.abs(F.col("x.seq") - F.col("our_seq")).alias("ahead_gap"))


def block_spans(blocks: DataFrame, places: DataFrame, default_start: int = 600, default_end: int = 960) -> DataFrame:
    """Blocks with their hours (usual hours if none are given, all day if one is missing) and ends as places on the line."""
    at = lambda side: places.select("line", F.col("code").alias(f"{side}_station"), F.col("seq").alias(f"{side}_seq"))
    none = F.col("start_min").isNull() & F.col("end_min").isNull()
    part = F.col("start_min").isNull() | F.col("end_min").isNull()
    b = blocks.join(at("from"), ["line", "from_station"], "left").join(at("to"), ["line", "to_station"], "left")
    return b.select("block_no", "block_date", "line", "tracks", "from_seq", "to_seq", F.when(none, default_start).when(~part, F.col("start_min")).alias("start_min"), F.when(none, default_end).when(~part, F.col("end_min")).alias("end_min"))


def in_block(points: DataFrame, spans: DataFrame) -> DataFrame:
    """``points(key, day, line, train_type, station_seq, minute)`` with ``megablock``: 1 inside a block in force."""
    s = spans.withColumnRenamed("line", "b_line").withColumn("low", F.least("from_seq", "to_seq")).withColumn("high", F.greatest("from_seq", "to_seq"))
    hit = F.expr("""b_line = line AND block_date = day AND (tracks IS NULL OR tracks = 'both' OR tracks = train_type) AND (from_seq IS NULL OR to_seq IS NULL OR station_seq BETWEEN low AND high)
        AND (start_min IS NULL OR end_min IS NULL OR CASE WHEN start_min <= end_min THEN minute BETWEEN start_min AND end_min ELSE minute >= start_min OR minute <= end_min END)""")
    inside = points.join(s, hit, "left_semi").select("key").distinct().withColumn("megablock", F.lit(1))
    return points.join(inside, "key", "left").withColumn("megablock", F.coalesce("megablock", F.lit(0)))


def flag01(c: Column) -> Column:
    return c.cast("int")


def feature_rows(targets: DataFrame, clean: DataFrame, obs: DataFrame, trains: DataFrame, stops: DataFrame, places: DataFrame, blocks: DataFrame) -> DataFrame:
    """All features of each target at its cutoff."""
    info = trains.select("train_id", "run_start_min", "direction", "train_type", "line", "is_ac", "car_count")
    point = stops.select("train_id", "station_code", (F.col("stop_seq") - 1).alias("point_seq"), "station_seq", F.col("minutes").alias("sched_minutes"))
    origin = stops.filter("stop_seq = 1").select("train_id", F.col("station_seq").alias("origin_seq"))
    last = stops.groupBy("train_id").agg(F.max("minutes").alias("trip_minutes"))
    t = targets.join(info, "train_id").join(point, ["train_id", "station_code"]).join(origin, "train_id").join(last, "train_id")
    t = t.withColumn("sched_time", F.col("service_day").cast("timestamp") + F.make_dt_interval(mins=F.col("run_start_min") + F.col("sched_minutes")))
    t = asof_join(t, clean, ["train_id", "service_day"], "cutoff", "local_ts", ["delay_minutes", "sched_minutes", "point_seq", "station_seq"], "id")
    state = batch_state(targets, batches(clean))
    t = t.join(state, ["id", "cutoff_id"], "left").withColumn("our_seq", F.coalesce("prior_station_seq", "origin_seq"))
    ahead = train_ahead(t.select("id", "cutoff_id", "train_id", "state_batch", "line", "direction", "train_type", "our_seq"), clean)
    t = t.join(ahead, ["id", "cutoff_id"], "left")
    t = t.join(batch_line(clean).withColumnRenamed("batch_id", "state_batch"), ["state_batch", "line", "direction"], "left")
    t = t.join(batch_far(obs, trains).withColumnRenamed("batch_id", "state_batch"), "state_batch", "left")
    t = t.join(history_delay(clean), ["train_id", "station_code", "service_day"], "left")
    points = t.select(F.struct("id", "cutoff_id").alias("key"), F.col("service_day").alias("day"), "line", "train_type", "station_seq", (F.hour("sched_time") * 60 + F.minute("sched_time")).alias("minute"))
    mega = in_block(points, block_spans(blocks, places)).select(F.col("key.id").alias("id"), F.col("key.cutoff_id").alias("cutoff_id"), "megablock")
    t = t.join(mega, ["id", "cutoff_id"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return t.select(
        "id", "cutoff_id", "train_id", "station_code", "service_day", "label", (F.col("sched_minutes") / F.col("trip_minutes")).alias("progress"), "point_seq",
        flag01(F.col("train_type") == "fast").alias("is_fast"), flag01(F.col("is_ac")).alias("is_ac"), "car_count", flag01(F.col("direction") == "up").alias("is_up"), F.hour("sched_time").alias("hour"), F.weekday("service_day").alias("weekday"), F.month("service_day").alias("month"),
        flag01(sunday_schedule(F.col("service_day"))).alias("sunday_schedule"), "sched_minutes", ((F.unix_seconds("sched_time") - F.unix_seconds("cutoff")) / 60).alias("lead_minutes"),
        flag01(F.col("prior_delay_minutes").isNotNull()).alias("has_prior"), F.col("prior_delay_minutes").alias("prior_delay"), (F.col("sched_minutes") - F.col("prior_sched_minutes")).alias("prior_lead_minutes"), (F.col("point_seq") - F.col("prior_point_seq")).alias("prior_points_back"),
        F.col("line_median").alias("line_median_delay"), "line_count", "ahead_delay", "ahead_gap", F.col("ld_median").alias("ld_median_delay"), zero("ld_count").alias("ld_count"), "hist_delay", zero("hist_count").alias("hist_count"), "megablock",
    )
