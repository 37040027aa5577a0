"""Options for a rider: trains still to be caught, delays at both ends, the train before, coverage, and reports."""

import random
from datetime import date, datetime, timedelta

import pytest

from delayloom.operators import crowding, recommend

DAY = date(2024, 1, 10)  # a Wednesday
T0 = datetime(2024, 1, 10)
TRAIN = "train_id string, line string, direction string, train_type string, run_start_min int, is_ac boolean, ac_weekdays_only boolean, is_ladies_special boolean, car_count int"
STOP = "train_id string, station_code string, stop_seq int, minutes int, days string"
CLEAN = "id long, train_id string, station_code string, service_day date, observed_at timestamp, delay_minutes double, point_seq int"


def at(minute, day=0):
    """The instant of a minute of local time."""
    return T0 + timedelta(days=day, minutes=minute - 330)


@pytest.fixture
def world(spark):
    """Trains O-M-D of one line leave O at 6:40, 6:50, 7:00, 7:05, 7:15 and 7:25 and need 20 minutes; another line has one at 7:10."""
    starts = {"a": 400, "b": 410, "c": 420, "d": 425, "e": 435, "f": 445, "x": 430}
    trains = spark.createDataFrame([(t, "two" if t == "x" else "one", "up", "slow", m, False, False, False, 12) for t, m in starts.items()], TRAIN)
    stops = spark.createDataFrame([(t, s, k + 1, 10 * k, "YYYYYYY") for t in starts for k, s in enumerate("OMD")], STOP)
    return stops, trains


def options(spark, world, readings, cancelled=(), now=424, **more):
    requests = spark.createDataFrame([(1, "O", "D", at(now))], "req_id long, origin string, destination string, at timestamp")
    points = {"O": 0, "M": 1, "D": 2}
    clean = spark.createDataFrame([(i, t, s, DAY + timedelta(days=day), at(m, day), float(v), points[s]) for i, (t, s, day, m, v) in enumerate(readings)], CLEAN)
    obs = spark.createDataFrame([(t, at(m), True) for t, m in cancelled], "train_id string, observed_at timestamp, cancelled boolean")
    rows = recommend.options_for(requests, *world, clean, obs, candidates=4, **more).collect()
    first = 24 * 60 * ((DAY - date(1970, 1, 1)).days)
    return {r["train_id"]: r.asDict() | {"dep": r["dep"] - first, "expected_dep": r["expected_dep"] - first, "expected_arr": r["expected_arr"] - first} for r in rows}


def test_late_trains_that_can_be_caught_return(spark, world):
    # b left 14 minutes ago but is read 14 late; a, 20 late, has left by now; c's reading says on time
    got = options(spark, world, [("a", "O", 0, 410, 20), ("b", "O", 0, 415, 14), ("c", "O", 0, 421, 0.4)])
    assert sorted(got) == ["b", "d", "e", "f", "x"]
    assert (got["b"]["place"], got["b"]["expected_dep"], got["b"]["expected_arr"], got["d"]["ahead_delay"]) == (1, 424, 444, 14)
    assert sorted(options(spark, world, [("b", "O", 0, 415, 13.4)])) == ["d", "e", "f", "x"]


def test_a_train_more_late_than_the_wait(spark, world):
    assert sorted(options(spark, world, [("a", "O", 0, 410, 23)])) == ["d", "e", "f", "x"]
    assert sorted(options(spark, world, [("a", "O", 0, 410, 23.6)])) == ["a", "d", "e", "f", "x"]


def test_readings_beyond_boarding_old_or_to_come_do_not_count(spark, world):
    late = [("b", "M", 0, 420, 30), ("b", "O", 0, 393, 30), ("b", "O", 0, 425, 30)]
    assert sorted(options(spark, world, late)) == ["d", "e", "f", "x"]


def test_delays_at_both_ends_and_a_live_reading(spark, world):
    past = [("d", "O", -k, 425, 2) for k in range(1, 6)] + [("d", "D", -k, 445, v) for k, v in zip(range(1, 6), (4, 5, 6, 7, 8), strict=True)]
    d = options(spark, world, past)["d"]
    assert (d["delay"], d["arrival_delay"], d["level"]) == (2, 6, "baseline")
    assert (d["arrival_low"], d["arrival_high"]) == pytest.approx((4.4, 7.6))
    d = options(spark, world, [*past, ("d", "O", 0, 423, 9)])["d"]
    assert (d["delay"], d["arrival_delay"], d["expected_dep"], d["expected_arr"]) == (9, 13, 434, 458)
    assert (d["arrival_low"], d["arrival_high"]) == pytest.approx((11.4, 14.6))
    # a small lateness replaces a larger one foretold; on time or early says nothing
    assert options(spark, world, [*past, ("d", "O", 0, 423, 0.6)])["d"]["delay"] == pytest.approx(0.6)
    assert options(spark, world, [*past, ("d", "O", 0, 423, 0.5)])["d"]["delay"] == 2
    # few readings: a median, no range
    few = options(spark, world, past[5:7])["d"]
    assert (few["delay"], few["arrival_delay"], few["arrival_low"]) == (0, 4.5, None)


def test_the_first_option_has_a_train_before_it(spark, world):
    past = [("c", "O", -1, 420, 12), ("x", "O", -1, 430, 1)]
    got = options(spark, world, past)
    assert (got["d"]["ahead_delay"], got["e"]["ahead_delay"], got["x"]["ahead_delay"]) == (12, 0, None)
    assert got["d"]["rule_score"] == got["e"]["rule_score"] + 0.5
    assert options(spark, world, past, cancelled=[("c", 300)])["d"]["ahead_cancelled"]
    assert not options(spark, world, past, cancelled=[("c", 180)])["d"]["ahead_cancelled"]
    # where only the timetable is known, nothing is known of the train before, but for a live reading
    assert options(spark, world, [])["d"]["ahead_delay"] is None
    assert options(spark, world, [("d", "O", 0, 420, 11)])["e"]["ahead_delay"] == 11


def test_a_model_counts_where_either_end_is_covered(spark, world):
    past = [("d", s, -1, 425, 3) for s in "OD"]
    model = spark.createDataFrame([(1, "d", DAY, s, 7.0, 5.0, 9.0) for s in "OD"], "req_id long, train_id string, service_day date, station_code string, delay double, low double, high double")
    cover = lambda *codes: spark.createDataFrame([(c,) for c in codes], "station_code string")
    of = lambda covered: tuple(options(spark, world, past, model=model, covered=covered)["d"][c] for c in ("level", "delay", "arrival_delay", "arrival_low"))
    assert of(cover("D")) == ("model", 3, 7, 5)
    assert of(cover("O")) == ("model", 7, 3, None)
    assert of(cover("M")) == ("baseline", 3, 3, None)
    assert of(None) == ("model", 7, 7, 5)


def test_reports_change_the_crowding_of_an_option(spark, world):
    said = "station_code string, line string, train_type string, train_id string, minute int, at_s long, crowd_level int"
    when = lambda m, day=-1: int((at(m, day) - datetime(1970, 1, 1)).total_seconds())
    reports = spark.createDataFrame([("O", "one", "slow", None, 430, when(430), 5)] * 9 + [("O", "one", "slow", "d", 425, when(425), 1)] * 2 + [("O", "one", "slow", None, 430, when(430, 0), 1)] * 50 + [("O", "one", "slow", None, 430, when(430, -91), 1)] * 50, said)
    got = options(spark, world, [], reports=reports)
    assert (got["d"]["similar_n"], got["d"]["own_n"]) == (9, 2) and (got["e"]["similar_n"], got["e"]["own_n"]) == (11, 0)
    assert (got["x"]["similar_n"], got["x"]["own_n"]) == (0, 0)


def test_sums_in_windows_equal_pairs(spark):
    rng = random.Random(3)
    points = [("p" if rng.random() < 0.7 else "q", rng.randrange(1440), rng.randrange(1000), rng.randrange(1, 6)) for _ in range(3000)]
    asks = list({("pqr"[rng.randrange(3)], rng.choice([0, 5, 29, 30, 31, 700, 1409, 1410, 1439]), (s := rng.randrange(900)), s + rng.randrange(-5, 300)) for _ in range(400)})
    got = crowding.sums_in_window(spark.createDataFrame(asks, "place string, minute int, since long, until long"), spark.createDataFrame(points, "place string, minute int, at_s long, crowd_level int"), ["place"], 30).collect()
    gap = lambda a, b: min((a - b) % 1440, (b - a) % 1440)
    expected = {}
    for a in asks:
        met = [v for p, m, t, v in points if p == a[0] and gap(m, a[1]) <= 30 and a[2] <= t <= a[3]]
        if met:
            expected[a] = (len(met), sum(met))
    assert {tuple(r)[:4]: (r["n"], r["total"]) for r in got} == expected and len(expected) > 150
