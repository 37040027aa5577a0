"""Compaction, corrections, blocks, levels of forecasts: hand-made cases."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from delayloom.operators import evaluation, journeys, matching, recommend, runs, timetable
from delayloom.sources import files

T0 = datetime(2024, 1, 9, 2, 30)


def reading(n, at=T0, source="ntes"):
    return (at + timedelta(minutes=n), f"central-{n}", "S01", at, None, float(n), source, str(n), "arrival", False, False, f"b{n}")


def test_compaction_keeps_earlier_months_and_merges_late_files(spark, tmp_path):
    write = lambda rows, name: spark.createDataFrame(rows, files.OBSERVATION).write.parquet(str(tmp_path / name)) or str(tmp_path / name)
    target, held = str(tmp_path / "months"), lambda: {(r["month"], r["train_number"]) for r in spark.read.schema(files.OBSERVATION + ", month string").parquet(str(tmp_path / "months")).collect()}
    first = write([reading(1), reading(2), reading(2), reading(3, datetime(2024, 2, 9)), reading(4, source="synthetic"), reading(5, datetime(2024, 3, 9))], "first")
    files.compact_batches(spark, first, target, str(tmp_path / "s1"), "2024-03")
    assert held() == {("2024-01", "1"), ("2024-01", "2"), ("2024-02", "3")}
    late = write([reading(2), reading(6)], "late")
    out = files.compact_batches(spark, late, target, str(tmp_path / "s2"), "2024-03").collect()
    assert [(r["month"], r["rows"], r["added"]) for r in out] == [("2024-01", 3, 1)]
    assert held() == {("2024-01", "1"), ("2024-01", "2"), ("2024-01", "6"), ("2024-02", "3")}


def test_blocks_round_trip_and_replacement(spark, tmp_path):
    columns = "block_id string, block_date date, line string, from_station string, to_station string, start_s int, end_s int, tracks string, direction string, source string, summary string"
    day = date(2024, 3, 3)
    row = lambda i, line="central", a=None, start=None: (i, day, line, a, None, start, None, None, None, "manual", None)
    stored = spark.createDataFrame([row("a"), row("b", "harbour")], columns)
    files.write_blocks(stored, str(tmp_path / "blocks"))
    back = files.read_blocks(spark, str(tmp_path / "blocks"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, stored.collect()))
    new = spark.createDataFrame([row("c", a="KYN"), row("b", "harbour", start=60), row("d", "harbour")], columns)
    got = {(r["block_id"], r["start_s"]) for r in files.save_blocks(back, new).collect()}
    assert got == {("c", None), ("b", None), ("d", None)}
    assert files.list_blocks(stored, "2024-03-04").count() == 0


@pytest.fixture(scope="module")
def small(spark):
    trains = spark.createDataFrame([("central-1", "1", "central", "down", "slow", 480, False, False, False, 12, "YYYYYYY"), ("central-2", "2", "central", "up", "fast", 1430, True, True, True, 15, "YYYYYNN")], "train_id string, number string, line string, direction string, train_type string, run_start_min int, is_ac boolean, ac_weekdays_only boolean, is_ladies_special boolean, car_count int, days string")
    cells = [("central-1", "S01", 1, 1, 0, None, 28800), ("central-1", "S02", 2, 2, 10, 29400, 29400), ("central-1", "S03", 3, 3, 20, 30000, None), ("central-2", "S03", 1, 3, 0, None, 85800), ("central-2", "S02", 2, 2, 15, 300, 300), ("central-2", "S01", 3, 1, 30, 1200, None)]
    stops = spark.createDataFrame(cells, "train_id string, station_code string, stop_seq int, station_seq int, minutes int, arrival_s int, departure_s int").join(trains.select("train_id", "days"), "train_id")
    places = spark.createDataFrame([(f"S0{i}", line, i) for i in (1, 2, 3) for line in ("central", "harbour")], "code string, line string, seq int")
    return trains, stops, places


def test_next_trains_across_midnight(spark, small):
    trains, stops, _ = small
    ask = [(1, "S02", "S01", datetime(2024, 1, 9, 18, 20)), (2, "S02", "S01", datetime(2024, 1, 12, 18, 40)), (3, "S01", "S03", datetime(2024, 1, 9, 2, 30)), (4, "S01", "S03", datetime(2024, 1, 9, 2, 31))]  # local 23:50, 00:10, 08:00, 08:01
    got = {}
    for r in journeys.next_trains(spark.createDataFrame(ask, "req_id int, origin string, destination string, at timestamp"), stops, trains, 2).collect():
        got.setdefault(r["req_id"], []).append((r["place"], r["service_day"], r["dep"] % 1440))
    assert {k: sorted(v) for k, v in got.items()} == {
        1: [(1, date(2024, 1, 9), 5), (2, date(2024, 1, 10), 5)],
        # 2, asked ten past midnight on Saturday: the train of Friday night is gone, and it doesn't run at weekends.
        3: [(1, date(2024, 1, 9), 480), (2, date(2024, 1, 10), 480)],
        4: [(1, date(2024, 1, 10), 480)],
    }


def test_report_criteria(spark, small):
    trains, stops, places = small
    wanted = 19731 * 1440 + 485  # five minutes after the slow train left S01
    night = 19731 * 1440 + 5
    schema = "id int, station_code string, train_type string, wanted long, line string, destination_code string, said_ac boolean, said_cars int, said_ladies boolean"
    rows = [(1, "S01", None, wanted, None, None, None, None, None), (2, "S01", "fast", wanted, None, None, None, None, None), (3, "S01", None, wanted, None, "S03", False, 12, None), (4, "S02", None, wanted + 10, None, "S01", None, None, None),
            (5, "S01", None, wanted, "harbour", None, None, None, None), (6, "S02", None, night, None, None, None, None, None), (7, "S02", None, night, None, None, True, 15, True), (8, "S01", None, wanted, None, None, None, 15, None), (9, "S03", None, wanted + 15, None, None, None, None, None)]
    got = {r["id"]: (r["train_id"], r["gap"]) for r in matching.report_candidates(spark.createDataFrame(rows, schema), stops, trains, places).collect()}
    assert got == {1: ("central-1", 5), 3: ("central-1", 5), 7: ("central-2", 0)}
    assert [r["train_id"] for r in matching.report_candidates(spark.createDataFrame(rows[5:6], schema), stops, trains, places, ladies_ok=True).collect()] == ["central-2"]


def overrides(spark, rows):
    return spark.createDataFrame(rows, "number string, action string, reason string, direction string, train_type string, days string, is_ac boolean, car_count int")


def changes(spark, rows):
    return spark.createDataFrame(rows, "number string, kind string, station_code string, station_seq int, stop_seq int, arrival_s int, departure_s int")


def test_overrides(spark, small):
    trains, stops, _ = small
    o = overrides(spark, [("1", "set", "seen", None, "fast", None, None, None), ("2", "remove", "gone", None, None, None, None, None), ("3", "add", "new", "down", "slow", None, None, 12)])
    c = changes(spark, [("1", "stop_time", "S02", 2, None, 29460, 29460), ("1", "remove_stop", "S03", None, None, None, None), ("1", "stop_time", "S04", 4, None, 30600, None), ("3", "stop", "S01", 1, 1, None, 3600), ("3", "stop", "S02", 2, 2, 4200, None)])
    after, held, report = timetable.apply_overrides(trains, stops, o, c)
    assert {(r["number"], r["train_type"], r["car_count"], r["days"]) for r in after.collect()} == {("1", "fast", 12, "YYYYYYY"), ("3", "slow", 12, "YYYYYYY")}
    assert [(r["station_code"], r["stop_seq"], r["arrival_s"]) for r in held.filter("number = '1'").orderBy("stop_seq").collect()] == [("S01", 1, None), ("S02", 2, 29460), ("S04", 3, 30600)]
    assert {r["number"]: r["outcome"] for r in report.collect()} == {"1": "changed", "2": "removed", "3": "added"}
    same = changes(spark, [("1", "stop_time", "S02", 2, None, 29400, 29400)])
    _, _, report = timetable.apply_overrides(trains, stops, overrides(spark, [("1", "set", "again", None, "slow", None, False, 12)]), same)
    assert report.first()["outcome"] == "no change"


def test_overrides_are_all_or_none(spark, small):
    trains, stops, _ = small
    o = overrides(spark, [("1", "set", " ", None, None, None, None, None), ("2", "add", "x", "up", "fast", None, None, None), ("9", "set", "x", None, None, None, None, None), ("8", "swap", "x", None, None, None, None, None)])
    c = changes(spark, [("1", "remove_stop", "S07", None, None, None, None), ("1", "stop_time", "S02", 2, None, 60000, 60000)])
    with pytest.raises(ValueError) as e:
        timetable.apply_overrides(trains, stops, o, c)
    for text in ("1: no reason", "1: no stop to remove at S07", "1: a step takes over two hours", "2: the train already exists", "9: no such train", "8: unknown action"):
        assert text in str(e.value)


def test_cycles_and_conflicts_are_told(spark):
    pairs = spark.createDataFrame([("c", "A", "B", 3, 0), ("c", "B", "C", 2, 0), ("c", "C", "A", 1, 0), ("d", "A", "B", 2, 2), ("d", "B", "A", 2, 2)], "line string, a string, b string, trains long, against long")
    order = timetable.station_order(pairs)
    assert {(r["line"], r["code"]) for r in timetable.order_cycles(pairs, order).collect()} >= {("c", "A"), ("c", "B"), ("c", "C")}
    assert [(r["line"], r["a"], r["b"]) for r in timetable.order_conflicts(pairs).collect()] == [("d", "A", "B")]


def test_levels_and_models(spark):
    t = spark.createDataFrame([(1, "S01"), (2, "S02"), (3, "S01"), (4, "S02")], "key int, station_code string")
    side = lambda rows: spark.createDataFrame(rows, "key int, delay double, low double, high double")
    model, past = side([(1, 4.0, 1.0, 6.0), (2, 5.0, 1.0, 6.0)]), side([(1, 2.0, 0.0, 3.0), (2, 3.0, 0.0, 4.0), (3, 1.0, 0.0, 2.0)])
    covered = spark.createDataFrame([("S01",)], "station_code string")
    got = {r["key"]: (r["level"], r["delay"], r["high"]) for r in recommend.delay_levels(t, model, past, covered).collect()}
    assert got == {1: ("model", 4.0, 6.0), 2: ("baseline", 3.0, 4.0), 3: ("baseline", 1.0, 2.0), 4: ("timetable", 0.0, None)}
    registry = spark.createDataFrame([("v1", "superseded", False), ("v2", "promoted", True)], "version string, status string, is_synthetic boolean")
    assert recommend.usable_model(registry).count() == 0 and recommend.usable_model(registry, True).count() == 1


def test_predict_targets_and_ablation(spark):
    rows = spark.range(400).selectExpr("id", "id % 24 AS hour", "id % 7 AS weekday", "CAST(id % 24 AS DOUBLE) AS label")
    model, low, high = evaluation.train_delay_model(rows, ["hour", "weekday"], iterations=5)
    asked = spark.createDataFrame([(5,), (900,)], "target_id long")
    got = {r["target_id"]: r["delay"] for r in evaluation.predict_targets(model, low, high, asked, rows.limit(50)).collect()}
    assert got[900] is None and abs(got[5] - 5) < 5
    out = {r["inputs"]: r["mae"] for r in evaluation.ablate_features(rows, rows, ["weekday"], ["hour"], 5).collect()}
    assert out["with"] < 0.6 * out["without"]


def test_earlier_values_see_only_earlier_days(spark):
    v = spark.createDataFrame([("t", "s", date(2024, 1, d), x) for d, x in ((1, 1.0), (1, 3.0), (2, 5.0), (4, None), (4, 100.0))], "train_id string, station_code string, day date, v double")
    ask = spark.createDataFrame([("t", "s", date(2024, 1, d)) for d in (1, 2, 3, 4, 5, 5)], "train_id string, station_code string, day date")
    got = {r["day"].day: (r["q"][0], r["n"]) for r in runs.earlier_values(ask, v, "day", "v", [0.5]).collect()}
    assert got == {2: (2.0, 2), 3: (3.0, 3), 4: (3.0, 3), 5: (4.0, 4)}


def test_segments(spark):
    p = spark.createDataFrame([(1.0, 1.0, "S01", True), (4.0, 1.0, None, False)], "label double, m double, station_code string, live boolean").withColumn("m", F.col("m"))
    got = {(r["segment"], r["value"]): r["mae"] for r in evaluation.evaluate_segments(p, "m", ("station_code", "live")).collect()}
    assert got == {("all", "all"): 1.5, ("station_code", "S01"): 0.0, ("station_code", "none"): 3.0, ("live", "true"): 0.0, ("live", "false"): 3.0}


def test_ranges_by_segment(spark):
    rows = spark.range(300).selectExpr("id", "id % 2 = 0 AS live", "id % 3 AS hour", "CAST(CASE WHEN id % 2 = 0 THEN id % 5 ELSE id % 50 END AS DOUBLE) AS label")
    model, _, _ = evaluation.train_delay_model(rows, ["hour"], iterations=2)
    ranges = evaluation.residual_ranges(model, rows, ["live"])
    width = {r["live"]: r["high"] - r["low"] for r in ranges.collect()}
    assert set(width) == {True, False, None} and width[True] < width[None] < width[False]
    asked = spark.createDataFrame([(1, True, 0), (2, None, 0)], "id long, live boolean, hour long")
    got = {r["id"]: r["high"] - r["low"] for r in evaluation.predict_ranges(model, ranges, asked, ["live"]).collect()}
    assert abs(got[1] - width[True]) < 1e-9 and abs(got[2] - width[None]) < 1e-9
