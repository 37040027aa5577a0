"""Runs (one train, one station, one service day) and the statistics drawn from them."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import day_band, day_kind, lead_bucket, local_time, run_key, sunday_schedule
from ..session import kept

RUN = ["train_id", "station_code", "run_key"]


def run_readings(obs: DataFrame, trains: DataFrame) -> DataFrame:
    """Usable arrivals and departures of timetable trains with their scheduled time and run."""
    o = obs.filter("source <> 'synthetic' AND event IN ('arrival', 'departure') AND NOT cancelled AND delay_minutes IS NOT NULL").join(trains.select("train_id"), "train_id", "left_semi")
    o = o.withColumn("scheduled", F.col("actual_or_expected_time") - F.make_dt_interval(mins=F.rint("delay_minutes").cast("int")))
    return o.withColumn("run_key", run_key(local_time(F.col("scheduled"))))


def final_runs(readings: DataFrame, within_minutes: int = 15) -> DataFrame:
    """Last reading of each run, if taken close to the time it speaks of."""
    newest = F.max(F.struct("observed_at", "id", "delay_minutes", "scheduled", F.col("actual_or_expected_time").alias("due"))).alias("last")
    out = readings.groupBy(*RUN).agg(newest).select(*RUN, F.col("last.delay_minutes").alias("d_final"), F.col("last.observed_at").alias("last_seen"), F.col("last.scheduled").alias("scheduled"), F.col("last.due").alias("due"))
    return out.filter(F.abs(F.unix_micros("last_seen") - F.unix_micros("due")) <= within_minutes * 60_000_000)


def drift_pairs(readings: DataFrame, final: DataFrame) -> DataFrame:
    """Every earlier reading of a run against its final delay."""
    earlier = readings.select(*RUN, "id", "observed_at", "delay_minutes").join(final, RUN).filter("observed_at < last_seen")
    lead = (F.unix_micros("scheduled") - F.unix_micros("observed_at")) / 60_000_000
    return earlier.select("id", (F.col("delay_minutes") <= 0).alias("said_on_time"), lead.alias("lead"), (F.col("d_final") - F.col("delay_minutes")).alias("drift"))


def drift_table(pairs: DataFrame) -> DataFrame:
    d = F.col("drift")
    q = F.percentile(d, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = pairs.groupBy("said_on_time", lead_bucket(F.col("lead")).alias("bucket")).agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mean_abs"), q.alias("q"), F.avg((d >= 5).cast("double")).alias("share_later"), F.avg((d <= -3).cast("double")).alias("share_earlier"))
    return out.select("said_on_time", "bucket", "n", "mean_abs", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"), "share_later", "share_earlier")


def run_facts(final: DataFrame, trains: DataFrame) -> DataFrame:
    """Final runs with direction, type, local hour, band and kind of day."""
    r = final.join(trains.select("train_id", "direction", "train_type", "line"), "train_id")
    r = r.withColumn("hour", F.hour(local_time(F.col("scheduled")))).withColumn("kind", day_kind(F.col("run_key")))
    return r.withColumn("band", day_band(F.col("hour")))


def _numbers(late: float, few: int):
    d = F.col("d_final")
    return [F.count("*").alias("runs"), F.median(d).alias("median"), F.percentile(d, 0.9).alias("p90"), F.avg((d >= late).cast("double")).alias("share_late"), (F.count("*") < few).alias("few")]


def delay_patterns(facts: DataFrame, late: float = 5, few: int = 5) -> DataFrame:
    """Delay numbers by direction and hour, direction and band, direction, type, and overall: one pass of grouping sets."""
    sets = [["direction", "hour"], ["direction", "band"], ["direction"], ["train_type"], []]
    grain = F.when(F.grouping("hour") == 0, "hour").when(F.grouping("band") == 0, "band").when(F.grouping("direction") == 0, "direction").when(F.grouping("train_type") == 0, "type").otherwise("overall")
    return facts.groupingSets(sets, "direction", "hour", "band", "train_type").agg(grain.alias("grain"), *_numbers(late, few)).select("grain", "direction", "hour", "band", "train_type", "runs", "median", "p90", "share_late", "few")


def day_kind_split(facts: DataFrame, least_days: int = 2) -> DataFrame:
    """The same numbers per kind of day, and whether there are days enough of both kinds to tell them apart."""
    out = facts.groupBy("kind").agg(F.countDistinct("run_key").alias("days"), F.count("*").alias("runs"), F.median("d_final").alias("median"), F.percentile("d_final", 0.9).alias("p90"))
    every = Window.partitionBy()
    return out.withColumn("ready", (F.count("*").over(every) == 2) & (F.min("days").over(every) >= least_days))


def _sweep(window: int):
    """Cutoffs of one slice of a line against the latest readings of its trains: one pass over enter, expire and ask events."""

    def local(events: pd.DataFrame) -> pd.DataFrame:
        latest: dict[str, tuple[int, float]] = {}
        live: list[float] = []
        due: deque[tuple[int, str]] = deque()
        out = []
        e = events.sort_values(["t", "asks", "tie"], kind="stable")
        for t, asks, train, delay, key in zip(e["t"].tolist(), e["asks"].tolist(), e["train_id"].tolist(), e["delay"].tolist(), e["key"].tolist(), strict=True):
            while due and due[0][0] <= t:  # a reading counts for less than the window
                end, gone = due.popleft()
                if gone in latest and latest[gone][0] == end:
                    live.pop(bisect_left(live, latest.pop(gone)[1]))
            if not asks:
                if train in latest:
                    live.pop(bisect_left(live, latest[train][1]))
                latest[train] = (t + window, delay)
                due.append((t + window, train))
                insort(live, delay)
                continue
            own = bisect_left(live, latest[train][1]) if train in latest else len(live)
            n = len(live) - (train in latest)
            if n:
                place = lambda k: live[k + (k >= own)]
                out.append((key, (place((n - 1) // 2) + place(n // 2)) / 2))
        return pd.DataFrame(out, columns=["key", "line_delay"]).astype({"key": "int64", "line_delay": "float64"})

    return local


def line_state(cuts: DataFrame, readings: DataFrame, window: int = 30, slice_hours: int = 6) -> DataFrame:
    """``key, line_delay``: the median over other trains' latest readings in the ``window`` minutes up to each cutoff of its line and direction.

    ``cuts(key, line, direction, train_id, cutoff)``, key a long; ``readings(line,
    direction, train_id, observed_at, id, delay_minutes)``. A line is swept in
    slices of a few hours, each with the window before it: a reading enters, is
    replaced by the train's next one or expires, and a cutoff asks for the
    middle of what is live. So a cutoff meets no readings in pairs, and a group
    holds one line's readings of one slice.
    """
    width, span = window * 60_000_000, slice_hours * 3600_000_000
    t = F.unix_micros("observed_at")
    r = readings.select("line", "direction", "train_id", t.alias("t"), F.lit(0).alias("asks"), F.col("id").alias("tie"), F.col("delay_minutes").alias("delay"), F.lit(-1).cast("long").alias("key"), F.explode(F.array_distinct(F.array(F.floor(t / span), F.floor((t + width) / span)))).alias("slice"))
    cut = F.unix_micros("cutoff")
    c = cuts.select("line", "direction", "train_id", cut.alias("t"), F.lit(1).alias("asks"), F.lit(0).cast("long").alias("tie"), F.lit(None).cast("double").alias("delay"), "key", F.floor(cut / span).alias("slice"))
    return r.unionByName(c).groupBy("line", "direction", "slice").applyInPandas(_sweep(width), "key long, line_delay double")


def line_state_backtest(readings: DataFrame, final: DataFrame, trains: DataFrame, leads: tuple[int, ...] = (15, 30, 45, 60), window: int = 30) -> DataFrame:
    """How well a run's final delay is foretold at several lead times by nothing, its own last reading, its line's median (``line_state``), or the larger of both."""
    t = trains.select("train_id", "line", "direction")
    cut = final.join(t, "train_id").withColumn("lead", F.explode(F.array(*map(F.lit, leads)))).withColumn("cutoff", F.col("scheduled") - F.make_dt_interval(mins=F.col("lead")))
    cut = kept(cut.select(*RUN, "line", "direction", "lead", "cutoff", "d_final", F.monotonically_increasing_id().alias("key")), "cutoffs")
    own = cut.join(readings.select(*RUN, "observed_at", "id", "delay_minutes"), RUN).filter("observed_at <= cutoff").groupBy("key").agg(F.max_by("delay_minutes", F.struct("observed_at", "id")).alias("own"))
    state = line_state(cut, readings.join(t, "train_id"), window)
    out = cut.join(own, "key", "left").join(state, "key", "left").withColumn("best", F.greatest(F.coalesce("own", F.lit(0.0)), F.coalesce("line_delay", F.lit(0.0))))
    miss = lambda c: F.avg(F.abs(F.col("d_final") - F.coalesce(c, F.lit(0.0))))
    return out.rollup("lead", "direction").agg(F.grouping("lead").alias("all_leads"), F.grouping("direction").alias("all_directions"), F.count("*").alias("runs"), miss(F.lit(0.0)).alias("mae_zero"), miss(F.col("own")).alias("mae_own"), miss(F.col("line_delay")).alias("mae_line"), miss(F.col("best")).alias("mae_max"), F.avg(F.col("line_delay").isNotNull().cast("double")).alias("line_known"))


def earlier_values(asked: DataFrame, values: DataFrame, day: str, value: str, shares: list[float]) -> DataFrame:
    """Per train, station and day of ``asked`` the percentiles ``q`` of ``value`` on earlier days, and their number ``n``.

    Days without earlier values are left out. Values are counted per day, and
    a histogram is carried forward: for each value of a place one running count
    over the days. A day's percentiles are then the values at their ranks in
    its histogram. Delays are nearly whole minutes, so a histogram has few
    values, and work grows with the days asked for, not with all days before
    each of them. Results are exact whatever the values are.
    """
    place = ["train_id", "station_code"]
    counts = values.filter(F.col(value).isNotNull()).groupBy(*place, day, F.col(value).alias("v_")).agg(F.count("*").alias("n_"))
    days = asked.select(*place, day).distinct().join(counts.select(*place, "v_").distinct(), place).select(*place, day, "v_", F.lit(0).cast("long").alias("n_"), F.lit(True).alias("asks_"))
    before = Window.partitionBy(*place, "v_").orderBy(F.unix_date(day)).rangeBetween(Window.unboundedPreceding, -1)
    held = counts.withColumn("asks_", F.lit(False)).unionByName(days).withColumn("held_", F.sum("n_").over(before)).filter("asks_ AND held_ > 0")
    upward = Window.partitionBy(*place, day).orderBy("v_").rowsBetween(Window.unboundedPreceding, 0)
    ranked = held.withColumn("upto_", F.sum("held_").over(upward)).withColumn("all_", F.sum("held_").over(Window.partitionBy(*place, day)))
    at = lambda rank: F.min(F.when(F.col("upto_") > rank, F.col("v_")))
    ends = [end for q in shares for end in (at(F.floor((F.col("all_") - 1) * q)), at(F.ceil((F.col("all_") - 1) * q)))]
    out = ranked.groupBy(*place, day).agg(F.max("all_").alias("n"), F.array(*ends).alias("e_"))
    between = lambda i, q: F.col("e_")[2 * i] + (F.col("e_")[2 * i + 1] - F.col("e_")[2 * i]) * ((F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q))
    return out.select(*place, day, F.array(*[between(i, q) for i, q in enumerate(shares)]).alias("q"), "n")


def baseline_check(readings: DataFrame, final: DataFrame, trains: DataFrame) -> DataFrame:
    """Earlier days' median of all readings against that of final delays, as forecasts of a final delay."""
    earlier = lambda df, v, name: earlier_values(final, df, "run_key", v, [0.5]).select(*RUN, F.col("q")[0].alias(name))
    both = final.join(earlier(readings, "delay_minutes", "by_reading"), RUN).join(earlier(final, "d_final", "by_run"), RUN).join(trains.select("train_id", "direction"), "train_id")
    miss = lambda c: F.col("d_final") - F.col(c)
    return both.rollup("direction").agg(F.grouping("direction").alias("all_directions"), F.count("*").alias("runs"), F.avg(F.abs(miss("by_reading"))).alias("mae_reading"), F.avg(miss("by_reading")).alias("bias_reading"), F.avg(F.abs(miss("by_run"))).alias("mae_run"), F.avg(miss("by_run")).alias("bias_run"))


def neighbours(stations: DataFrame, places: DataFrame, line: str = "central") -> DataFrame:
    """``station_code`` of ``stations`` and of the stations next to them in the order of ``line``."""
    codes = stations.select("station_code").distinct()
    order = Window.partitionBy("line").orderBy("seq")
    row = places.filter(F.col("line") == line).withColumn("before", F.lag("code").over(order)).withColumn("after", F.lead("code").over(order))
    near = row.select(F.col("code").alias("station_code"), F.explode(F.array("before", "after")).alias("next")).join(codes.withColumnRenamed("station_code", "next"), "next", "left_semi")
    return codes.union(near.select("station_code")).distinct()


def compare_runs(a: DataFrame, b: DataFrame, places: DataFrame) -> DataFrame:
    """Two sets of run facts, the second at the first one's stations and their neighbours and in its slots (Sunday timetable or not, hour): delay numbers by direction and type."""
    day = F.to_date(local_time(F.col("scheduled")))
    a, b = (df.withColumn("sunday", sunday_schedule(day)) for df in (a, b))
    b = b.join(neighbours(a, places), "station_code", "left_semi").join(a.select("sunday", "hour").distinct(), ["sunday", "hour"], "left_semi")
    d = F.col("d_final")
    part = lambda df, name: df.groupBy(F.lit(name).alias("dataset"), "direction", "train_type").agg(F.count("*").alias("runs"), F.avg(d).alias("mean"), F.median(d).alias("p50"), F.percentile(d, 0.9).alias("p90"), *[F.avg(x.cast("double")).alias(n) for n, x in (("share_1", d <= 1), ("share_5", d >= 5), ("share_10", d >= 10))])
    return part(a, "a").unionByName(part(b, "b"))


def delay_by_hour_weekday(clean: DataFrame) -> DataFrame:
    return clean.groupBy(F.weekday("local_ts").alias("weekday"), F.hour("local_ts").alias("hour")).agg(F.avg("delay_minutes").alias("delay"), F.count("*").alias("readings"))


def delay_by_station(clean: DataFrame) -> DataFrame:
    return clean.groupBy("line", "direction", "station_code").agg(F.avg("delay_minutes").alias("delay"), F.count("*").alias("readings"))


def delay_by_train(clean: DataFrame, obs: DataFrame) -> DataFrame:
    """Per train its delays, days and readings, with the days on which it was read as cancelled."""
    days = obs.filter("cancelled").groupBy("train_id").agg(F.countDistinct(F.to_date(local_time(F.col("observed_at")))).alias("cancelled_days"))
    out = clean.groupBy("train_id").agg(F.median("delay_minutes").alias("median"), F.percentile("delay_minutes", 0.9).alias("p90"), F.max("delay_minutes").alias("worst"), F.countDistinct("service_day").alias("days"), F.count("*").alias("readings"))
    return out.join(days, "train_id", "left").withColumn("cancelled_days", F.coalesce("cancelled_days", F.lit(0)))


def delay_along_route(clean: DataFrame) -> DataFrame:
    return clean.groupBy("train_id", "point_seq").agg(F.median("delay_minutes").alias("median"), F.percentile("delay_minutes", 0.9).alias("p90"), F.count("*").alias("n"))


def observation_summary(obs: DataFrame) -> DataFrame:
    return obs.agg(F.count("*").alias("rows"), F.unix_seconds(F.min("observed_at")).alias("first_s"), F.unix_seconds(F.max("observed_at")).alias("last_s"), F.count_if("cancelled").alias("cancelled"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def recent_reports(reports: DataFrame, limit: int = 3) -> DataFrame:
    """Latest reports of each rider."""
    newest = Window.partitionBy("source").orderBy(F.col("reported_at").desc(), F.col("id").desc())
    return reports.withColumn("r", F.row_number().over(newest)).filter(F.col("r") <= limit).select("source", "r", "id", "crowd_level")


def crowd_summary(reports: DataFrame) -> DataFrame:
    """Reports per level and mean level per local hour, as two grains of one pass."""
    r = reports.withColumn("hour", F.hour(local_time(F.col("reported_at"))))
    return r.groupingSets([["crowd_level"], ["hour"]], "crowd_level", "hour").agg(F.count("*").alias("reports"), F.avg("crowd_level_copy").alias("mean_level")) if "crowd_level_copy" in r.columns else crowd_summary(r.withColumn("crowd_level_copy", F.col("crowd_level")))
