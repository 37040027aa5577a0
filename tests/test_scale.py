"""Jobs that no busy month, day or train number may turn into one task's work."""

import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from delayloom import session
from delayloom.operators import features, health, quality, runs
from delayloom.sources import files

T0 = datetime(2024, 1, 9)


def reading(k, at, train="1", delay=1.0, batch="b"):
    return (at, f"central-{train}", "S01", at, None, delay, "ntes", train, "arrival", False, False, f"{batch}{k}")


def test_a_large_month_has_many_sorted_files(spark, tmp_path):
    rows = [reading(k, T0 + timedelta(minutes=k)) for k in range(4000)] + [reading(k, T0 + timedelta(days=40, minutes=k)) for k in range(10)]
    obs = spark.createDataFrame(rows + rows[:100], files.OBSERVATION)
    files.export_monthly(obs, str(tmp_path / "out"), file_bytes=4000)
    january = sorted((tmp_path / "out" / "month=2024-01").glob("*.parquet"))
    assert len(january) > 3 and (tmp_path / "out" / "month=2024-02").is_dir()
    times = [[r["observed_at"] for r in spark.read.parquet(str(f)).collect()] for f in january]
    assert all(t == sorted(t) for t in times) and sum(map(len, times)) == 4000
    spans = sorted((t[0], t[-1]) for t in times)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    back = spark.read.parquet(str(tmp_path / "out")).drop("month")
    assert files.same_rows(back, spark.createDataFrame(rows, files.OBSERVATION).select(back.columns)).first()["same"]


def test_rows_compared_by_fingerprint(spark):
    rng = random.Random(1)
    a = [(rng.choice([None, 1, 2]), rng.choice([None, "x", "y"])) for _ in range(300)]
    b = a[5:] + [(9, None), (None, "x"), (1, None)]
    schema = "n int, s string"
    for buckets, every in ((1, False), (8, False), (4096, False), (8, True)):
        r = files.same_rows(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), buckets, every).first()
        assert (r["only_a"], r["only_b"]) == (sum((Counter(a) - Counter(b)).values()), sum((Counter(b) - Counter(a)).values())) and not r["same"]
    mixed = spark.createDataFrame(rng.sample(a, len(a)), schema)
    assert files.same_rows(spark.createDataFrame(a, schema), mixed).first()["same"]
    assert not files.same_rows(spark.createDataFrame([(1, None)], "n int, s int"), spark.createDataFrame([(None, 1)], "n int, s int")).first()["same"]


def test_one_number_with_most_readings(spark):
    """A third of all readings bear no train number; slices give what one window over each train gives."""
    rng = random.Random(4)
    rows = [(k, T0 + timedelta(seconds=rng.randrange(200_000)), rng.choice([None, "1", "2"]), "S01", "arrival", "ntes", f"b{rng.randrange(3)}", float(rng.randrange(0, 90)), False) for k in range(3000)]
    obs = spark.createDataFrame(rows, "id long, observed_at timestamp, train_number string, station_code string, event string, source string, batch_id string, delay_minutes double, cancelled boolean")
    near, jump = set(), set()
    for number in (None, "1", "2"):
        own = sorted((r for r in rows if r[2] == number), key=lambda r: (r[1], r[0]))
        for x, y in zip(own, own[1:]):
            gap = (y[1] - x[1]).total_seconds() / 60
            if gap <= 5 and x[6] != y[6]:
                near.add((y[0], x[6]))
            if gap <= 60 and abs(y[7] - x[7]) > gap + 15:
                jump.add((y[0], x[7]))
    assert {(r["id"], r["prev_batch"]) for r in quality.flag_near_duplicate(obs).collect()} == near and near
    assert {(r["id"], r["prev_delay"]) for r in quality.flag_delay_jump(obs).collect()} == jump and jump


def test_gaps_across_days(spark):
    at = [T0 + timedelta(minutes=m) for m in (0, 15, 30, 1430, 1450, 4000, 4015)]
    times = spark.createDataFrame([(t,) for t in at + at[:2]], "at timestamp")
    got = health.find_gaps(times, F.lit(T0 - timedelta(days=1)), F.lit(T0 + timedelta(days=6))).collect()
    start = int((T0 - datetime(1970, 1, 1)).total_seconds())
    assert sorted(((r["from_s"] - start) // 60, (r["to_s"] - start) // 60, r["missed"]) for r in got) == [(-1440, 0, 96), (30, 1430, 92), (1450, 4000, 169), (4015, 8640, 308)]


def test_percentiles_of_earlier_days(spark):
    rng = random.Random(6)
    rows = [(f"t{rng.randrange(2)}", "S", (T0 + timedelta(days=rng.randrange(30))).date(), rng.choice([None, 0.5, *map(float, range(-3, 9))])) for _ in range(600)]
    df = spark.createDataFrame(rows, "train_id string, station_code string, day date, v double")
    got = {(r["train_id"], r["day"]): (r["q"], r["n"]) for r in runs.earlier_values(df, df, "day", "v", [0.1, 0.5, 0.9]).collect()}

    def percentile(values, q):
        p = (len(values) - 1) * q
        a, b = values[int(p)], values[min(int(p) + 1, len(values) - 1)]
        return a + (b - a) * (p - int(p))

    expected = {}
    for train, _, day, _ in rows:
        before = sorted(v for t, _, d, v in rows if t == train and d < day and v is not None)
        if before:
            expected[train, day] = ([percentile(before, q) for q in (0.1, 0.5, 0.9)], len(before))
    assert got.keys() == expected.keys()
    assert all(got[k][1] == n and all(abs(x - y) < 1e-9 for x, y in zip(got[k][0], q)) for k, (q, n) in expected.items())


def test_the_train_ahead_is_another_train(spark):
    rng = random.Random(7)
    group = lambda: (rng.choice("pq"), "one", rng.choice(["up", "down"]), "slow")
    clean = [(*group(), f"t{rng.randrange(4)}", rng.randrange(8), float(rng.randrange(20)), k) for k in range(250)]
    targets = [(k, -1, f"t{rng.randrange(5)}", *group(), rng.randrange(9)) for k in range(200)]
    got = features.train_ahead(spark.createDataFrame(targets, "id long, cutoff_id long, train_id string, state_batch string, line string, direction string, train_type string, our_seq int"),
                               spark.createDataFrame(clean, "batch_id string, line string, direction string, train_type string, train_id string, station_seq int, delay_minutes double, id long")).collect()
    expected = {}
    for k, _, own, *where, seq in targets:
        met = [(abs(s - seq), i, d) for *w, t, s, d, i in clean if w == where and t != own and (s > seq if where[2] == "down" else s < seq)]
        if met:
            expected[k] = (min(met)[2], min(met)[0])
    assert {r["id"]: (r["ahead_delay"], r["ahead_gap"]) for r in got} == expected and len(expected) > 100


def test_shared_folders_can_be_cleared(spark):
    kept = session.kept(spark.range(5), "five")
    path = kept.inputFiles()[0]
    assert session.clear_shared(spark) > 0
    fs, at = session.file_system(spark, path)
    assert not fs.exists(at)


def test_models_refuse_what_they_cannot_learn_from(spark):
    import pytest

    from delayloom.operators import evaluation

    days = lambda n: spark.createDataFrame([((T0 + timedelta(days=k)).date(),) for k in range(n)], "service_day date")
    evaluation.refuse_short_span(days(15))
    for rows in (days(14), days(14).limit(0)):
        with pytest.raises(ValueError):
            evaluation.refuse_short_span(rows)
    real = spark.createDataFrame([("ntes",)], "source string")
    evaluation.refuse_synthetic(real)
    with pytest.raises(ValueError):
        evaluation.refuse_synthetic(real.union(spark.createDataFrame([("synthetic",)], "source string")))
