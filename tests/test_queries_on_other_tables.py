"""Queries against their SQL on tables that the smallest ones don't hold: instants within a second, many rows a group, many trains a minute."""

import os
import random
from datetime import date, datetime
from pathlib import Path

import duckdb
import pytest

from delayloom.operators import journeys, matching
from delayloom.plans import registry
from test_queries import SF, TABLES, plain


def same_as_sql(spark, tmp_path, name, **changed):
    """Runs a query and its SQL over the smallest tables, of which ``changed`` are replaced by a SELECT each; the rows, which must be alike."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        source, at = Path(SF) / f"{t}.parquet", tmp_path / f"{t}.parquet"
        if t in changed:
            con.execute(f"COPY (WITH old AS (SELECT * FROM '{source}') {changed[t]}) TO '{at}' (FORMAT parquet)")
        else:
            os.symlink(source, at)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}{'/*.parquet' if at.is_dir() else ''}'")
    df = registry.queries()[name](spark, str(tmp_path))
    cursor = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in df.columns) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(plain(v) for v in r) for r in df.collect()), key=str) == want
    return want


#: A poll each 15 minutes and source, all at 0.4 s after the quarter: those at the instants asked for begin within their second, but after them.
POLLS = "SELECT * REPLACE (k AS event_id, make_timestamp(1704067200400000 + (k // 4) * 900000000) AS ts) FROM (SELECT row_number() OVER () - 1 AS k, * FROM old, range(10)) WHERE k < 9600"


def test_alerts_in_force_at_an_instant(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "evaluate_alerts", events=POLLS)


def test_alerts_decided_between_two_instants(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "decide_alerts", events=POLLS)


def test_medians_of_windows_with_many_readings(spark, tmp_path):
    """Some 2000 readings of one line, direction and quarter of an hour, hardly two with the same delay."""
    many = "SELECT * REPLACE (event_id + i * 1000 AS event_id, 'click' AS event_type, user_id % 25 // 5 * 20 AS user_id, make_timestamp(1704067200000000 + (event_id % 4) * 3600000000 + i * 1000000) AS ts, ((event_id + i * 1000) * 7919 % 60013)::DOUBLE AS value) FROM old, range(16) AS r(i)"
    assert same_as_sql(spark, tmp_path, "stream_line_state", events=many)


MANY_TRAINS = "SELECT * REPLACE (s_suppkey + i * 10 AS s_suppkey) FROM (SELECT * FROM old WHERE s_suppkey < 10), range(250) AS r(i)"


def test_reports_matched_among_many_trains(spark, tmp_path):
    """Two and more trains alike leave each station at the same minute."""
    assert same_as_sql(spark, tmp_path, "match_reports", supplier=MANY_TRAINS)


def test_best_candidates_are_the_first_of_all(spark, tmp_path):
    """Each report has two rows at most, whatever the rider said, around midnight and on holidays too."""
    rng = random.Random(3)
    pick = lambda *x: rng.choice([None, *x])
    day = (date(2024, 1, 26) - date(1970, 1, 1)).days * 1440
    wanted = [(k, rng.choice("ABCX"), rng.choice([None, *[day + rng.choice([-1440, 0, 1440, 2880]) + m for m in (*range(-25, 25), 700, 705, 711)]]), pick("fast", "slow"), 3, pick("one", "two"), pick("B", "C", "D"), pick(True, False), pick(12, 15, 9), pick(True, False)) for k in range(400)]
    trains = [(f"t{k}", rng.choice(["one", "two"]), rng.choice(["fast", "slow"]), rng.choice([0, 1420, 1430, 700]) + rng.randrange(12), *[pick(True, False) for _ in range(3)], pick(12, 15)) for k in range(150)]
    days = {t[0]: rng.choice(["YYYYYYY", "YYYYYNN", "NNNNNNY"]) for t in trains}
    stops = [(t[0], code, k + 1, 5 * k, days[t[0]]) for t in trains for k, code in enumerate("ABCD" if t[3] % 2 else "DCBA")]
    places = [(c, line, k) for line in ("one", "two") for k, c in enumerate("ABCD", 1)]
    args = [
        spark.createDataFrame(wanted, "id long, station_code string, wanted long, train_type string, crowd_level int, line string, destination_code string, said_ac boolean, said_cars int, said_ladies boolean"),
        spark.createDataFrame(stops, "train_id string, station_code string, stop_seq int, minutes int, days string"),
        spark.createDataFrame(trains, "train_id string, line string, train_type string, run_start_min int, is_ac boolean, ac_weekdays_only boolean, is_ladies_special boolean, car_count int"),
        spark.createDataFrame(places, "code string, line string, seq int"),
    ]
    for more in ({}, {"ladies_ok": True, "window": 4, "holidays": [date(2024, 1, 25)]}):
        every = {}
        for r in matching.report_candidates(*args, **more).collect():
            every.setdefault(r.id, []).append((-r.score, r.gap, r.dep, r.train_id))
        got = {}
        for r in matching.best_candidates(*args, **more).collect():
            got.setdefault(r.id, []).append((-r.score, r.gap, r.dep, r.train_id))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:2] for k, v in every.items()} and max(map(len, every.values())) > 2


def test_what_many_ask_is_answered_once(spark):
    at = datetime(2024, 1, 10, 8)
    rows = [(1, "A", "B", at), (2, "A", "B", at), (3, "A", "C", at), (4, "A", "B", at.replace(second=1))]
    questions, asked = journeys.asked_once(spark.createDataFrame(rows, "req_id long, origin string, destination string, at timestamp"))
    assert sorted((r.origin, r.destination, r.at) for r in questions.collect()) == sorted({r[1:] for r in rows})
    told = journeys.told_to_all(questions.select("req_id", "destination"), asked)
    assert sorted(map(tuple, told.collect())) == [(r[0], r[2]) for r in rows]


@pytest.mark.parametrize("name", ["one_change", "one_change_half_loaded"])
def test_a_change_is_looked_for_once_per_question(spark, tmp_path, monkeypatch, name):
    """Three times as many requests, all asked before, give no more first legs; their answers are those of the SQL."""
    looked, real = [], journeys.kept

    def kept(df, what):
        out = real(df, what)
        if what == "first-legs":
            looked.append(out.select("req").distinct().count())
        return out

    monkeypatch.setattr(journeys, "kept", kept)
    told = same_as_sql(spark, tmp_path, name, customer="SELECT * REPLACE (c_custkey + i * 14400 AS c_custkey) FROM old, range(3) AS r(i)")
    assert len(told) % 3 == 0 and 0 < looked[0] < len(told)
