"""Hand-made cases of single operators."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from delayloom.functions import calendar, parsing
from delayloom.operators import crowding, evaluation, features, health, matching, recommend, runs, timetable
from delayloom.sources import files
from delayloom.streaming import streams

T0 = datetime(2024, 1, 9, 2, 30)  # eight in the morning, local time


def values(df, column):
    return [r[column] for r in df.collect()]


def test_clock_and_masks(spark):
    rows = spark.createDataFrame([("daily",), ("mon-sat",), ("sat|sun",), ("fri-mon",), ("YNYNYNY",), ("soon",)], "d string")
    assert values(rows.select(parsing.days_mask(F.col("d")).alias("m")), "m") == ["YYYYYYY", "YYYYYYN", "NNNNNYY", "YNNNYYY", "YNYNYNY", None]
    rows = spark.createDataFrame([("8:05",), ("23:59:30",), ("24:00",), ("",)], "t string")
    assert values(rows.select(parsing.clock_seconds(F.col("t")).alias("s")), "s") == [29100, 86370, None, None]
    rows = spark.createDataFrame([("On Time",), ("21 Mins.",), ("04:17 Hrs.",), ("?",)], "t string")
    assert values(rows.select(parsing.delay_from_text(F.col("t")).alias("s")), "s") == [0.0, 21.0, 257.0, None]


def test_holidays_run_to_sunday_timetable(spark):
    rows = spark.createDataFrame([(date(2024, 1, 26),), (date(2024, 1, 28),), (date(2024, 1, 29),)], "d date")
    assert values(rows.select(calendar.runs_on(F.lit("YYYYYYN"), F.col("d")).alias("r")), "r") == [False, False, True]
    assert values(rows.select(calendar.wrap_minutes(F.lit(1430)).alias("w")), "w") == [-10] * 3


def test_service_day_across_midnight(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 2, 0, 20), 1430), (datetime(2024, 1, 1, 23, 40), 5), (datetime(2024, 1, 1, 12, 0), 600)], "t timestamp, start int")
    assert values(rows.select(calendar.service_day(F.col("t"), F.col("start")).alias("d")), "d") == [date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 1)]


def test_asof_never_looks_ahead(spark):
    left = spark.createDataFrame([(1, "a", T0), (2, "a", T0 + timedelta(minutes=5)), (3, "b", T0)], "row int, k string, at timestamp")
    right = spark.createDataFrame([("a", T0, 1, 1.0), ("a", T0, 2, 2.0), ("a", T0 + timedelta(minutes=9), 3, 3.0), ("b", T0 + timedelta(seconds=1), 4, 4.0)], "k string, ts timestamp, id long, v double")
    got = {r["row"]: r["prior_v"] for r in features.asof_join(left, right, ["k"], "at", "ts", ["v"], "id").collect()}
    assert got == {1: 2.0, 2: 2.0, 3: None}


def test_crowding_halves_round_down_and_reports_blend(spark):
    trip = dict(key=1, hour=9.0, direction="up", train_type="fast", sunday=False, ahead_cancelled=False, ahead_delay=None, starts_here=False, car_count=12, ac=False, is_ladies_special=False)
    schema = "key int, hour double, direction string, train_type string, sunday boolean, ahead_cancelled boolean, ahead_delay double, starts_here boolean, car_count int, ac boolean, is_ladies_special boolean"
    scored = crowding.rule_score(spark.createDataFrame([tuple(trip.values())], schema))
    assert values(scored, "rule_score") == [4.5]
    none = spark.createDataFrame([], "key int, similar_n long, similar_sum long"), spark.createDataFrame([], "key int, own_n long, own_sum long")
    assert values(crowding.crowding_estimate(scored, *none), "crowd_score") == [4]
    own = spark.createDataFrame([(1, 3, 3)], "key int, own_n long, own_sum long")
    assert values(crowding.crowding_estimate(scored, none[0], own), "crowd_score") == [3]


def test_match_confidence_is_best_less_half_second(spark):
    rows = spark.createDataFrame([(1, "x", 10, 0, 1.0), (1, "y", 17, 7, 0.3), (2, "x", 10, 0, 1.0), (2, "y", 11, 1, 0.9), (3, "x", 10, 8, 0.2)], "id long, train_id string, dep long, gap long, score double")
    got = {r["id"]: (r["train_id"], r["confidence"], r["reason"]) for r in matching.match_reports(rows).collect()}
    assert got == {1: ("x", 0.85, "matched"), 2: (None, 0.55, "ambiguous"), 3: (None, 0.2, "far")}


def option(req, train, dep, arr, delay=0.0, crowd=3, cancelled=False, ladies=False):
    return (req, train, dep, arr, float(delay), float(dep + max(delay, 0)), float(arr + max(delay, 0)), crowd, cancelled, ladies)


def test_choice_rules(spark):
    rows = [
        option(1, "a", 0, 30), option(1, "b", 5, 40),
        option(2, "a", 0, 20, delay=16), option(2, "b", 5, 40),
        option(3, "a", 0, 30, crowd=4), option(3, "b", 2, 34, crowd=2),
        option(4, "a", 0, 30, cancelled=True), option(4, "b", 5, 40), option(4, "c", 1, 20, ladies=True),
    ]
    df = spark.createDataFrame(rows, "req_id int, train_id string, dep int, arr int, delay double, expected_dep double, expected_arr double, crowd_score int, cancelled boolean, is_ladies_special boolean")
    got = {r["req_id"]: (r["train_id"], r["rule"], r["wait"]) for r in recommend.choose(df).collect()}
    assert got == {1: ("a", "earliest", False), 2: ("b", "very_late", False), 3: ("b", "crowding", True), 4: ("b", "only", False)}


def test_gaps_count_missed_runs(spark):
    times = spark.createDataFrame([(T0,), (T0 + timedelta(minutes=60),)], "at timestamp")
    got = health.find_gaps(times, F.lit(T0), F.lit(T0 + timedelta(minutes=70))).collect()
    assert [r["missed"] for r in got] == [3]


def test_alert_decisions(spark):
    now = F.lit(T0).cast("timestamp")
    alerts = spark.createDataFrame([("ntes", "quiet"), ("mobond", "thin")], "source string, alert string")
    state = spark.createDataFrame([("mobond:thin", True, T0 - timedelta(days=1), T0 - timedelta(hours=13)), ("ntes:failing", True, T0, T0)], "alert_key string, active boolean, first_seen_at timestamp, last_sent_at timestamp")
    got = {r["alert_key"]: r["action"] for r in health.decide_alerts(alerts, state, now).collect()}
    assert got == {"ntes:quiet": "ALERT", "mobond:thin": "STILL", "ntes:failing": "RECOVERED"}


def test_registry_supersedes(spark):
    old = spark.createDataFrame([("v1", "promoted"), ("v2", "rejected")], "version string, status string")
    new = spark.createDataFrame([("v3", "promoted")], "version string, status string")
    assert {r["version"]: r["status"] for r in evaluation.update_registry(old, new).collect()} == {"v1": "superseded", "v2": "rejected", "v3": "promoted"}


def test_timetable_problems(spark, tmp_path):
    text = "﻿# line: test\nTrain_Number,destination,service_type,direction,station_code,station_name,scheduled_arrival,scheduled_departure,days,ac,cars\n90101,X,fast,up,AA,Alpha,,08:00,daily,yes,12\n90101,X,fast,down,BB,Beta,25:00,,daily,yes,12\n"
    path = tmp_path / "t.csv"
    path.write_text(text.replace("﻿", ""))
    rows = timetable.parse_timetable(files.read_timetable_csv(spark, str(path))).withColumn("line_no", F.monotonically_increasing_id())
    found = set(values(timetable.validate_rows(rows), "message"))
    assert found == {"direction differs within the train", "scheduled_arrival can't be read"}


def test_export_and_idempotent_stream(spark, tmp_path):
    row = (T0, "central-1", "S01", T0, None, 1.0, "ntes", "1", "arrival", False, False, "20240109T023000Z-000001")
    obs = spark.createDataFrame([row, row], files.OBSERVATION)
    files.export_monthly(obs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    obs.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        streams.stream_batches(spark, str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "mark")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def test_final_run_needs_a_reading_close_to_its_time(spark):
    near = (1, "t", "S01", date(2024, 1, 9), T0, 4.0, T0, T0)
    far = (2, "t", "S02", date(2024, 1, 9), T0, 4.0, T0, T0 + timedelta(minutes=16))
    df = spark.createDataFrame([near, far], "id long, train_id string, station_code string, run_key date, observed_at timestamp, delay_minutes double, scheduled timestamp, actual_or_expected_time timestamp")
    assert values(runs.final_runs(df), "station_code") == ["S01"]
