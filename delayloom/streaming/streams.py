"""The feed as streams: idempotent load, repeats, line state, live board, alerts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..session import file_system
from ..sources.files import OBSERVATION


def read_stream(spark: SparkSession, path: str, schema: str = OBSERVATION) -> DataFrame:
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(path)


MANIFEST = "_manifest"


def loaded_epochs(spark: SparkSession, target: str) -> list[str]:
    """Folders of the micro-batches of ``target`` that are whole, by the manifest."""
    fs, at = file_system(spark, f"{target}/{MANIFEST}")
    return sorted(f.getPath().getName().replace(".", "/", 1) for f in fs.listStatus(at)) if fs.exists(at) else []


def read_loaded(spark: SparkSession, target: str, leave_out: str | None = None) -> DataFrame:
    """Rows of all whole micro-batches of ``target``; what a broken one left behind is not among them."""
    paths = [f"{target}/{e}" for e in loaded_epochs(spark, target) if e != leave_out]
    schema = f"{OBSERVATION}, loader string, epoch long, batch_day string"
    return spark.read.schema(schema).option("basePath", target).parquet(*paths) if paths else spark.createDataFrame([], schema)


def stream_batches(spark: SparkSession, source: str, target: str, checkpoint: str):
    """Append new batch files to ``target``, late ones included, none twice even if a file is delivered again.

    Each micro-batch has a folder of its own (by the stream's id, which its
    checkpoint keeps, and the number of the micro-batch) and is listed in a
    manifest once it is whole. A micro-batch that broke off is tried again by
    Spark under the same number: what it left is overwritten, and neither it
    nor anything unlisted counts as loaded. In it is a folder per UTC day of
    the batch id; only the days at hand are looked through for batches that
    are loaded already.
    """

    def load(batch: DataFrame, epoch: int) -> None:
        loader = spark.read.json(f"{checkpoint}/metadata").first()["id"]
        name = f"loader={loader}/epoch={epoch}"
        fs, mark = file_system(spark, f"{target}/{MANIFEST}/{name.replace('/', '.', 1)}")
        fs.delete(mark, False)
        dated = batch.withColumn("batch_day", F.substring("batch_id", 1, 8))
        days = [r["batch_day"] for r in dated.select("batch_day").distinct().collect()]  # days of one micro-batch
        known = read_loaded(spark, target, leave_out=name).filter(F.col("batch_day").isin(days)).select("batch_id").distinct()
        dated.join(known, "batch_id", "left_anti").select(*dated.columns).write.mode("overwrite").partitionBy("batch_day").parquet(f"{target}/{name}")
        fs.create(mark, True).close()

    return read_stream(spark, source).writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedup(obs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Exact repeats that arrive within ``delay`` of each other go."""
    return obs.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(["source", "train_number", "station_code", "event", "observed_at", "delay_minutes", "cancelled"])


def stream_line_state(obs: DataFrame, trains: DataFrame, window: str = "15 minutes", lateness: str = "20 minutes") -> DataFrame:
    """Readings, mean and median delay per window, line and direction; a window closes when later ones are ``lateness`` on.

    The median is a delay that was read, the lower of the middle two. A
    window's state counts its different delays, of which there are few, as
    they are nearly whole minutes.
    """
    known = obs.filter("delay_minutes IS NOT NULL AND NOT cancelled").withWatermark("observed_at", lateness).join(trains.select("train_id", "line", "direction"), "train_id")
    out = known.groupBy(F.window("observed_at", window), "line", "direction").agg(F.count("*").alias("readings"), F.avg("delay_minutes").alias("mean_delay"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY delay_minutes)").alias("median_delay"))
    return out.select(F.col("window.start").alias("start"), "line", "direction", "readings", "mean_delay", "median_delay")


def stream_latest_reading(obs: DataFrame, lateness: str = "20 minutes") -> DataFrame:
    """Newest reading of each train and UTC day; a day's state goes when later readings are ``lateness`` past its end."""
    seen = obs.withWatermark("observed_at", lateness).groupBy(F.window("observed_at", "1 day"), "train_id")
    last = F.max_by(F.struct("station_code", "delay_minutes", "observed_at", "batch_id"), F.struct("observed_at", "batch_id", "station_code", "delay_minutes")).alias("last")
    return seen.agg(last).select("train_id", F.to_date("window.start").alias("day"), "last.*")


class _Alerts(StatefulProcessor):
    """Alerts of one source; all times are milliseconds.

    State: the failed runs in a row, the last good run (the first run seen, if
    none was good), and when ``failing`` and ``quiet`` were last sent (0: not
    in force). In event time, runs wait in ``pending`` until the watermark
    has passed them, so they are taken in order whatever batch brought them.
    """

    def __init__(self, streak: int, quiet: int, repeat: int, by_event: bool):
        self.streak, self.quiet, self.repeat, self.by_event = streak, quiet, repeat, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", "failed long, good long, failing long, quiet long, due long")
        self.pending = handle.getListState("pending", "at long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        runs = sorted(zip((t.value // 1_000_000 for t in new["started_at"]), new["status"], strict=True))
        if self.by_event:
            self.pending.appendList(runs)
            facts = self.facts.get() if self.facts.exists() else (0, 0, 0, 0, 0)
            if not facts[4] or runs[0][0] < facts[4]:
                self.facts.update((*facts[:4], self._wake(facts[4], runs[0][0])))
            yield self._rows(key, [])
        else:
            now = timerValues.getCurrentProcessingTimeInMs()
            yield self._rows(key, self._advance([(now, status) for _, status in runs], now))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() if self.by_event else timerValues.getCurrentProcessingTimeInMs()
        held = list(self.pending.get()) if self.by_event and self.pending.exists() else []
        due = sorted((at, status) for at, status in held if at < until)
        if due:
            self.pending.put([(at, status) for at, status in held if at >= until]) if len(due) < len(held) else self.pending.clear()
        yield self._rows(key, self._advance(due, until, min((at for at, _ in held if at >= until), default=None)))

    def _wake(self, due: int, at: int) -> int:
        """Moves the source's one timer."""
        if at != due:
            if due:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(at)
        return at

    def _rows(self, key, out: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], alert, at // 1000, action) for alert, at, action in out], columns=["source", "alert", "at_s", "action"]).astype({"source": "object", "alert": "object", "at_s": "int64", "action": "object"})

    def _advance(self, runs: list[tuple[int, str]], until: int, waiting: int | None = None) -> list[tuple[str, int, str]]:
        """What is to be said up to ``until``, of the ``runs`` and of the deadlines between them; the timer goes to the next deadline or ``waiting`` run."""
        failed, good, failing, quiet, due = self.facts.get() if self.facts.exists() else (0, 0, 0, 0, 0)
        out = []
        for at, status in [*[r for r in runs if r[1] != "skipped_disabled"], (until, None)]:
            while good:  # deadlines before the run
                ends = [(quiet + self.repeat if quiet else good + self.quiet, "quiet")] + [(failing + self.repeat, "failing")] * bool(failing)
                end, alert = min(ends)
                if end >= at:
                    break
                out.append((alert, end, "STILL" if (quiet if alert == "quiet" else failing) else "ALERT"))
                quiet, failing = (end, failing) if alert == "quiet" else (quiet, end)
            if status is None:
                break
            good = good or at
            failed = failed + 1 if status == "failed" else 0
            if failed >= self.streak and not failing:
                out.append(("failing", at, "ALERT"))
                failing = at
            if status != "failed":
                out += [(alert, at, "RECOVERED") for alert, sent in (("failing", failing), ("quiet", quiet)) if sent]
                failing, quiet, good = 0, 0, at
        ends = [waiting] * (waiting is not None) + ([quiet + self.repeat if quiet else good + self.quiet] + [failing + self.repeat] * bool(failing) if good else [])
        if ends:
            due = self._wake(0 if due < until else due, min(ends))
        self.facts.update((failed, good, failing, quiet, due))
        return out

    def close(self) -> None:
        pass


def stream_alerts(runs: DataFrame, streak: int = 3, quiet_hours: float = 3, repeat_hours: float = 12, lateness: str = "20 minutes", by_event: bool = True) -> DataFrame:
    """source, alert, at_s, action: ALERT when a problem begins, STILL every ``repeat_hours`` while it lasts, RECOVERED when a run succeeds.

    ``failing``: the last ``streak`` runs of the source failed. ``quiet``: no
    good run for ``quiet_hours``, counted from the first run if none was good.
    ``runs(source, started_at, status)``; runs skipped as disabled don't count.

    Silence is told by timers, not by the next run. With ``by_event`` they
    follow the watermark over all sources, messages bear the time they were
    due, and runs are taken in order once ``lateness`` has passed, so a replay
    says the same whatever its batches. Otherwise they follow the clock: then
    a collector that sends nothing at all is told of as well. State is kept in
    RocksDB (``state_in_rocksdb``).
    """
    r = runs.select("source", "started_at", "status")
    r = r.withWatermark("started_at", lateness) if by_event else r
    processor = _Alerts(streak, int(quiet_hours * 3600_000), int(repeat_hours * 3600_000), by_event)
    return r.groupBy("source").transformWithStateInPandas(processor, "source string, alert string, at_s long, action string", "Append", "EventTime" if by_event else "ProcessingTime")


@contextmanager
def state_in_rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which timers need."""
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.set(name, before)
