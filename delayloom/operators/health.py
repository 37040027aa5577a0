"""Is the feed alive: gaps between polls, outages of sources, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def build_run_log(polls: DataFrame, results: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per poll and known source: what the source answered, or that it was skipped. Sources are a handful of settings rows."""
    every = polls.crossJoin(sources).join(results, ["batch_id", "source"], "left")
    status = F.when(~F.col("enabled"), "skipped_disabled").when(F.col("readings").isNull(), "failed").when(F.col("error").isNotNull(), "partial").otherwise("ok")
    return every.withColumn("status", status).withColumn("readings", F.coalesce("readings", F.lit(0)))


def match_counts(obs: DataFrame, *by: str) -> DataFrame:
    """Distinct train numbers with and without a train in the timetable."""
    known = F.col("train_id") != F.col("train_number")
    return obs.filter("source <> 'synthetic'").groupBy(*by).agg(F.countDistinct(F.when(known, F.col("train_number"))).alias("matched"), F.countDistinct(F.when(~known, F.col("train_number"))).alias("unmatched"))


def settle_run_log(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """Runs with their counts filled in; a partial run is good once its batch has loaded."""
    out = runs.join(counts, ["batch_id", "source"], "left")
    return out.withColumn("status", F.when((F.col("status") == "partial") & F.col("matched").isNotNull(), "ok").otherwise(F.col("status")))


def backfill_run_log(obs: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs rebuilt from readings of batches that the log doesn't know, timed by the batch id."""
    at = F.try_to_timestamp(F.substring("batch_id", 1, 15), F.lit("yyyyMMdd'T'HHmmss"))
    return obs.groupBy("batch_id", "source").agg(F.count("*").alias("readings")).join(runs.select("batch_id", "source"), ["batch_id", "source"], "left_anti").withColumn("started_at", at).withColumn("status", F.lit("ok")).withColumn("backfilled", F.lit(True))


def find_gaps(times: DataFrame, start: Column, end: Column, cadence: int = 15, tolerance: int = 10) -> DataFrame:
    """Stretches between polls (``at``) that are longer than cadence and tolerance together, edges of the window included.

    Polls are thinned to one per instant and each UTC day is gone through by
    itself; the first poll of a day then follows the last one before it, which
    a second pass over one row a day finds.
    """
    us = lambda c: F.unix_micros(c)
    inside = times.filter((F.col("at") >= start) & (F.col("at") <= end)).select(us(F.col("at")).alias("at"), F.lit(1).alias("edge")).distinct()
    frame = times.sparkSession.range(1)
    edges = frame.select(us(start).alias("at"), F.lit(0).alias("edge")).unionByName(frame.select(us(end).alias("at"), F.lit(2).alias("edge")))
    poll = F.struct("at", "edge")
    both = inside.unionByName(edges).withColumn("day", F.floor(F.col("at") / 86_400_000_000)).withColumn("prev", F.lag(poll).over(Window.partitionBy("day").orderBy("at", "edge")))
    days = both.groupBy("day").agg(F.max(poll).alias("last")).withColumn("before", F.lag("last").over(Window.orderBy("day")))  # one row a day
    both = both.filter("prev IS NOT NULL").select("at", "edge", "prev").unionByName(both.filter("prev IS NULL").join(days, "day").select("at", "edge", F.col("before").alias("prev")))
    steps = (F.col("at") - F.col("prev.at")) / (cadence * 60_000_000)
    between = (F.col("edge") == 1) & (F.col("prev.edge") == 1)
    missed = F.greatest(F.lit(1), F.when(between, F.bround(steps, 0) - 1).otherwise(F.floor(steps))).cast("long")
    return both.filter(F.col("at") - F.col("prev.at") > (cadence + tolerance) * 60_000_000).select((F.col("prev.at") / 1_000_000).cast("long").alias("from_s"), (F.col("at") / 1_000_000).cast("long").alias("to_s"), missed.alias("missed"))


def outages(runs: DataFrame) -> DataFrame:
    """Islands of consecutive failed runs per source; skipped runs don't count either way."""
    tried = runs.filter("status <> 'skipped_disabled'")
    w = Window.partitionBy("source").orderBy("started_at", "batch_id")
    island = F.sum((F.col("status") != "failed").cast("int")).over(w)
    return tried.withColumn("island", island).filter("status = 'failed'").groupBy("source", "island").agg(F.min("started_at").alias("first"), F.max("started_at").alias("last"), F.count("*").alias("runs"))


def source_health(runs: DataFrame) -> DataFrame:
    """Counts per source and whether its last attempt succeeded."""
    c = lambda s: F.count_if(F.col("status") == s).alias(s)
    tried = F.col("status") != "skipped_disabled"
    last = F.max_by(F.when(tried, F.col("status")), F.when(tried, F.struct("started_at", "batch_id")))
    out = runs.groupBy("source").agg(c("ok"), c("partial"), c("failed"), c("skipped_disabled"), F.sum(F.when(tried, F.col("readings")).otherwise(0)).alias("readings"), last.alias("last"))
    return out.withColumn("state", F.when(F.col("last") == "failed", "down").when(F.col("last").isNotNull(), "up").otherwise("disabled")).drop("last")


def health_report(runs: DataFrame, obs: DataFrame, now: Column, cadence: int = 15) -> DataFrame:
    """Expected and actual polls since the first, and the age of the newest reading in minutes."""
    r = runs.agg(F.min("started_at").alias("first"), F.countDistinct("batch_id").alias("actual"))
    o = obs.filter("source <> 'synthetic'").agg(F.max("observed_at").alias("newest"))
    minutes = lambda a, b: F.floor((F.unix_seconds(a) - F.unix_seconds(b)) / 60)
    return r.crossJoin(o).select(F.floor(minutes(now, F.col("first")) / cadence).alias("expected"), "actual", minutes(now, F.col("newest")).alias("age_minutes"))


def health_between(runs: DataFrame, obs: DataFrame, start: Column, end: Column, now: Column, cadence: int = 15) -> DataFrame:
    """The feed between two instants: polls expected and made, when it was last polled, and the newest reading's age at ``now``.

    Time before the first poll on record isn't counted. Gaps are ``find_gaps``
    from the same start; sources ``source_health`` of the same runs.
    """
    at = F.col("started_at")
    r = runs.agg(F.min(at).alias("first"), F.max(F.when(at <= now, at)).alias("last"), F.countDistinct(F.when(at.between(start, end), F.col("batch_id"))).alias("actual"))
    o = obs.filter("source <> 'synthetic'").agg(F.max(F.when(F.col("observed_at") <= now, F.col("observed_at"))).alias("newest"))
    since = F.when((F.col("first") > start) & (F.col("first") <= end), F.col("first")).otherwise(start)
    expected = F.greatest(F.lit(0), F.floor((F.unix_micros(end) - F.unix_micros(since)) / (cadence * 60_000_000)))
    return r.crossJoin(o).select(expected.alias("expected"), "actual", F.unix_seconds("last").alias("last_s"), F.floor((F.unix_seconds(now) - F.unix_seconds("newest")) / 60).alias("age_minutes"))


def evaluate_alerts(runs: DataFrame, now: Column, quiet_hours: int = 3, streak: int = 3, answers: int = 4, least: float = 10) -> DataFrame:
    """Alerts per source: no success for hours, the last runs all failed, or few readings in the last answers."""
    newest = Window.partitionBy("source").orderBy(F.col("started_at").desc(), F.col("batch_id").desc())
    tried = runs.filter("status <> 'skipped_disabled'").withColumn("r", F.row_number().over(newest))
    good = F.when(F.col("status").isin("ok", "partial"), F.col("started_at"))
    base = tried.groupBy("source").agg(F.max(good).alias("success"), F.coalesce(F.min(F.when(F.col("status") != "failed", F.col("r"))) - 1, F.count("*")).alias("streak"))
    answered = tried.filter("status <> 'failed'").withColumn("a", F.row_number().over(newest)).filter(F.col("a") <= answers).groupBy("source").agg(F.avg("readings").alias("mean"))
    s = base.join(answered, "source", "left")
    alerts = F.array(F.when(F.coalesce(F.unix_seconds(now) - F.unix_seconds("success") > quiet_hours * 3600, F.lit(True)), F.lit("quiet")), F.when(F.col("streak") >= streak, F.lit("failing")), F.when(F.col("mean") < least, F.lit("thin")))
    return s.select("source", F.explode(F.filter(alerts, lambda x: x.isNotNull())).alias("alert"), "streak", "mean")


def decide_alerts(alerts: DataFrame, state: DataFrame, now: Column, repeat_hours: int = 12) -> DataFrame:
    """What to send given the alerts in force and those sent before: ALERT, STILL after hours, RECOVERED; with the new state."""
    a = alerts.select(F.concat_ws(":", "source", "alert").alias("alert_key")).distinct().withColumn("on_", F.lit(True))
    s = state.filter("active").select("alert_key", "first_seen_at", "last_sent_at")
    j = a.join(s, "alert_key", "full")
    due = F.unix_seconds(now) - F.unix_seconds("last_sent_at") >= repeat_hours * 3600
    action = F.when(F.col("on_") & F.col("first_seen_at").isNull(), "ALERT").when(F.col("on_") & due, "STILL").when(F.col("on_").isNull(), "RECOVERED").otherwise("NONE")
    j = j.withColumn("action", action)
    return j.select("alert_key", "action", F.col("on_").isNotNull().alias("active"), F.coalesce("first_seen_at", now).alias("first_seen_at"), F.when(F.col("action") == "NONE", F.col("last_sent_at")).otherwise(now).alias("last_sent_at"))


def last_collected(obs: DataFrame, runs: DataFrame) -> DataFrame:
    a = obs.filter("source <> 'synthetic'").agg(F.max("observed_at").alias("a"))
    return a.crossJoin(runs.agg(F.max("started_at").alias("b"))).select(F.unix_seconds(F.greatest("a", "b")).alias("last_s"))
