"""Streams that must say the same whatever breaks or stays silent."""

import shutil
from datetime import datetime, timedelta
from pathlib import Path

from delayloom.operators import runs as run_operators
from delayloom.sources import files
from delayloom.streaming import streams

T0 = datetime(2024, 1, 9, 3)
RUN = "source string, started_at timestamp, status string"


def alerts(spark, tmp_path, parts, **more):
    """Messages of a stream over files that arrive one after the other: rows of (source, minute, status) each."""
    for k, rows in enumerate(parts):
        spark.createDataFrame([(s, T0 + timedelta(minutes=m), status) for s, m, status in rows], RUN).coalesce(1).write.parquet(str(tmp_path / "runs" / str(k)))
    with streams.state_in_rocksdb(spark):
        stream = spark.readStream.schema(RUN).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "runs"))
        q = streams.stream_alerts(stream, **more).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    start = (T0 - datetime(1970, 1, 1)).total_seconds()
    return sorted((r["source"], r["alert"], (r["at_s"] - start) / 60, r["action"]) for r in spark.read.schema("source string, alert string, at_s long, action string").parquet(str(tmp_path / "out")).collect())


def test_silence_is_told_without_another_run(spark, tmp_path):
    # a is never heard of again after minute 0; b goes on and moves the watermark
    parts = [[("a", 0, "ok"), ("b", 0, "ok")], [("b", m, "ok") for m in range(15, 600, 15)], [("b", m, "ok") for m in range(600, 1000, 15)]]
    assert alerts(spark, tmp_path, parts) == [("a", "quiet", 180, "ALERT"), ("a", "quiet", 900, "STILL")]


def test_runs_out_of_order_and_across_batches(spark, tmp_path):
    parts = [[("a", 0, "ok"), ("a", 30, "failed"), ("a", 15, "failed")], [("a", 60, "ok"), ("a", 45, "failed"), ("a", 46, "skipped_disabled")], [("a", 200, "ok")]]
    assert alerts(spark, tmp_path, parts) == [("a", "failing", 45, "ALERT"), ("a", "failing", 60, "RECOVERED")]


def test_a_load_that_broke_off_is_made_whole(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "table", "mark"))
    row = lambda k: (T0, f"central-{k}", "S01", T0, None, 1.0, "ntes", "1", "arrival", False, False, f"20240109T0{k}3000Z-000001")
    spark.createDataFrame([row(k) for k in range(8)], files.OBSERVATION).repartition(4).write.parquet(source)
    load = lambda: streams.stream_batches(spark, source, target, mark).awaitTermination()
    load()
    assert streams.read_loaded(spark, target).count() == 8
    # as if the job had died half-way: some files written, nothing listed, the micro-batch not committed
    folder = Path(target) / streams.loaded_epochs(spark, target)[0]
    shutil.rmtree(Path(target) / streams.MANIFEST)
    for f in sorted(folder.rglob("*.parquet"))[::2]:
        f.unlink()
    for f in (Path(mark) / "commits").iterdir():
        f.unlink()
    assert streams.read_loaded(spark, target).count() == 0
    load()
    assert streams.read_loaded(spark, target).count() == 8 and streams.read_loaded(spark, target).select("train_id").distinct().count() == 8
    # delivered again, under another name and with one new batch
    spark.createDataFrame([row(k) for k in range(9)], files.OBSERVATION).coalesce(1).write.parquet(str(tmp_path / "in" / "again"))
    load()
    assert streams.read_loaded(spark, target).count() == 9


def test_sweep_of_a_line_equals_pairs(spark):
    import random
    from statistics import median

    rng = random.Random(9)
    base = datetime(2024, 1, 9)
    readings = [("one", "up", f"t{rng.randrange(6)}", base + timedelta(minutes=rng.randrange(1500)), i, float(rng.randrange(-3, 30))) for i in range(900)]
    cuts = [(k, "one", "up", f"t{rng.randrange(7)}", base + timedelta(minutes=rng.randrange(1500))) for k in range(300)]
    got = run_operators.line_state(spark.createDataFrame(cuts, "key long, line string, direction string, train_id string, cutoff timestamp"), spark.createDataFrame(readings, "line string, direction string, train_id string, observed_at timestamp, id long, delay_minutes double")).collect()
    expected = {}
    for key, _, _, own, at in cuts:
        latest = {}
        for _, _, train, t, i, d in sorted(readings, key=lambda r: (r[3], r[4])):
            if train != own and at - timedelta(minutes=30) < t <= at:
                latest[train] = d
        if latest:
            expected[key] = median(latest.values())
    assert {r["key"]: r["line_delay"] for r in got} == expected and len(expected) > 200
