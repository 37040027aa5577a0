"""Queries that keep tables: compaction, timetable files, corrections, run logs, matches; and model targets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.calendar import holidays_in_force, local_time, sunday_schedule
from ..functions.parsing import block_id, short_error
from ..operators import evaluation, health, journeys, matching, recommend, timetable
from ..session import shared_folder
from ..sources import adapters as A
from ..sources import files
from ..streaming import streams
from .base_sql import BASE
from .journeys import EVAL, HOLIDAYS, NEXT, RUNS_ON, _pred, _split, _stream, _t, next_trips
from .readings import SQL as READING_SQL
from .readings import TARGETS, _clean, _feature_rows

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("compact_batches", BASE + """, x AS (SELECT DISTINCT * EXCLUDE (id), id % 10 = 0 AND id < 10000000 AS late FROM observations_dup
 WHERE source <> 'synthetic'), y AS (SELECT * EXCLUDE (late), bool_and(late) AS late FROM x GROUP BY ALL)
SELECT strftime(observed_at, '%Y-%m') AS month, count(*) AS rows, count_if(late)::BIGINT AS added_late FROM y GROUP BY 1""")
def compact_batches(s, d):
    """Batches folded into months, then a folder of late files: what was there stays."""
    rows = A.repeated_observations(s, d).withColumn("late", F.expr("id % 10 = 0 AND id < 10000000"))
    early, late, target = (shared_folder(s, n) for n in ("early", "late", "months"))
    rows.filter("NOT late").drop("late").write.parquet(early)
    rows.filter("late").drop("late").write.parquet(late)
    files.compact_batches(s, early, target, shared_folder(s, "staged"), "2024-12")
    added = files.compact_batches(s, late, target, shared_folder(s, "staged"), "2024-12").select("month", F.col("added").alias("added_late"))
    held = s.read.schema(files.OBSERVATION + ", month string").parquet(target).groupBy("month").agg(F.count("*").alias("rows"))
    return held.join(added, "month", "left")


@query("read_timetable_csv", BASE + "SELECT train_id, station_code, arrival_s::INTEGER AS arrival_s, departure_s::INTEGER AS departure_s, days AS mask, is_ac, car_count, car_count = 15 AS is_ladies_special, car_count = 12 AS ac_weekdays_only, 0::INTEGER AS problems FROM scheduled_stops JOIN (SELECT train_id, is_ac, car_count FROM trains) USING (train_id)")
def read_timetable_csv(s, d):
    """The timetable written as text cells and read back as typed columns."""
    path = shared_folder(s, "csv")
    clock = lambda c: F.expr(f"CASE WHEN {c} IS NOT NULL THEN format_string(' %02d:%02d', CAST({c} / 3600 AS INT), CAST({c} / 60 AS INT) % 60) END")
    stops, trains = _t(s, d)
    rows = stops.join(trains.select("train_id", "is_ac", "car_count"), "train_id")
    days = F.expr("CASE days WHEN 'YYYYYYY' THEN 'Daily' WHEN 'YYYYYNN' THEN 'mon-fri' ELSE days END")
    rows.select(F.col("train_id").alias("Train_Number"), F.col("station_code").alias("STATION_CODE"), clock("arrival_s").alias("scheduled_arrival"), clock("departure_s").alias("Scheduled_Departure"), days.alias("days"), F.when(F.col("is_ac"), "Yes").otherwise("n").alias("AC"), F.col("car_count").alias("cars")).withColumn("Notes", F.expr("CASE WHEN cars = 15 THEN 'Ladies_Special | x' WHEN cars = 12 THEN 'non_ac_weekends' END")).write.option("header", True).csv(path)
    typed = timetable.parse_timetable(files.read_timetable_csv(s, path))
    return typed.select("is_ladies_special", "ac_weekdays_only", F.col("train_number").alias("train_id"), "station_code", "arrival_s", "departure_s", "mask", "is_ac", "car_count", F.size("bad").alias("problems"))


BROKEN = BASE + """, b0 AS (SELECT *, max(stop_seq) OVER (PARTITION BY train_id) AS last, string_split(train_id, '-')[2]::INTEGER % 10 AS k FROM scheduled_stops),
b1 AS (SELECT train_id, stop_seq, k, last, CASE WHEN k = 4 AND stop_seq >= 3 THEN (arrival_s + 10800) % 86400 WHEN k = 5
 AND arrival_s IS NOT NULL THEN ((stop_seq * 100) % 1440) * 60 ELSE arrival_s END AS a, CASE WHEN k = 4
 AND stop_seq >= 3 THEN (departure_s + 10800) % 86400 WHEN k = 5
 AND departure_s IS NOT NULL THEN ((stop_seq * 100) % 1440) * 60 ELSE departure_s END AS d FROM b0 WHERE NOT (k = 1 AND stop_seq > 1)),
b AS (SELECT train_id, stop_seq, CASE WHEN NOT (k = 3 AND stop_seq = last) THEN a END AS a, CASE WHEN NOT (k = 2 AND stop_seq = 1) THEN d END AS d
 FROM b1),
u AS (SELECT train_id, stop_seq, 0 AS side, a AS t FROM b WHERE a IS NOT NULL UNION ALL SELECT train_id, stop_seq, 1, d FROM b WHERE d IS NOT NULL),
g AS (SELECT train_id, ((t - lag(t) OVER (PARTITION BY train_id ORDER BY stop_seq, side)) % 86400 + 86400) % 86400 AS step FROM u),
w AS (SELECT train_id, max(step) AS longest, sum(coalesce(step, 0)) AS whole FROM g GROUP BY 1),
e AS (SELECT train_id, count(*) AS n, bool_or(stop_seq = 1 AND d IS NULL) AS no_start, bool_or(r = 1 AND a IS NULL) AS no_end
 FROM (SELECT *, row_number() OVER (PARTITION BY train_id ORDER BY stop_seq DESC) AS r FROM b) GROUP BY 1)
SELECT train_id, 'fewer than two stops' AS message FROM e WHERE n < 2 UNION ALL SELECT train_id, 'no departure at the start' FROM e WHERE no_start
 UNION ALL SELECT train_id, 'no arrival at the end' FROM e WHERE no_end
UNION ALL SELECT train_id, 'a step takes over two hours' FROM w WHERE longest > 7200 UNION ALL SELECT train_id, 'the run takes twelve hours or more'
 FROM w WHERE whole >= 43200"""
query("validate_runs", BROKEN)(lambda s, d: timetable.validate_runs(A.broken_stops(s, d)))


@query("validate_rows", BASE + """, r AS (SELECT (t.number::INTEGER - 95000) * 100 + stop_seq AS line_no, t.number::INTEGER % 10 AS k, stop_seq, max(stop_seq) OVER (PARTITION BY train_id) AS last
 FROM scheduled_stops s JOIN trains t USING (train_id))
SELECT line_no, 'days is blank' AS message FROM r WHERE k = 1 AND stop_seq = 1 UNION ALL SELECT line_no, 'service_type is neither fast nor slow' FROM r WHERE k = 2 AND stop_seq = 2
UNION ALL SELECT line_no, 'service_type differs within the train' FROM r WHERE k = 2 UNION ALL SELECT line_no, 'direction differs within the train' FROM r WHERE k = 3
UNION ALL SELECT line_no, 'scheduled_arrival can''t be read' FROM r WHERE k = 4 AND stop_seq = 2 UNION ALL SELECT line_no, 'no time' FROM r WHERE k = 5 AND stop_seq = 2
UNION ALL SELECT line_no, 'cars can''t be read' FROM r WHERE k = 6 AND stop_seq = 1 UNION ALL SELECT line_no, 'station twice in the train' FROM r WHERE k = 7 AND stop_seq IN (1, 2)""")
def validate_rows(s, d):
    """Every stop of every train as a row of text cells; seven tenths of the trains have a fault each."""
    stops, trains = _t(s, d)
    r = stops.drop("days").join(trains, "train_id").withColumn("k", F.expr("CAST(number AS INT) % 10")).withColumn("last", F.max("stop_seq").over(Window.partitionBy("train_id")))
    clock = lambda c: f"CASE WHEN {c} IS NOT NULL AND NOT (k = 5 AND stop_seq = 2) THEN format_string('%02d:%02d', {c} div 3600, {c} div 60 % 60) ELSE '' END"
    station = "CASE WHEN k = 7 AND stop_seq = 2 THEN first_code ELSE station_code END"
    r = r.withColumn("first_code", F.min_by("station_code", "stop_seq").over(Window.partitionBy("train_id")))
    rows = r.selectExpr(
        "(CAST(number AS INT) - 95000) * 100 + stop_seq AS line_no", "number AS train_number", f"{station} AS station_code", f"concat('Station ', {station}) AS station_name", "'here' AS destination",
        "CASE WHEN k = 1 AND stop_seq = 1 THEN ' ' ELSE 'daily' END AS days", "CASE WHEN k = 2 AND stop_seq = 2 THEN 'express' ELSE train_type END AS service_type",
        "CASE WHEN k = 3 AND stop_seq = last THEN CASE WHEN direction = 'up' THEN 'down' ELSE 'up' END ELSE direction END AS direction",
        f"CASE WHEN k = 4 AND stop_seq = 2 THEN 'x9' ELSE {clock('arrival_s')} END AS scheduled_arrival", f"{clock('departure_s')} AS scheduled_departure", "CASE WHEN is_ac THEN 'yes' ELSE 'no' END AS ac",
        "CASE WHEN k = 6 AND stop_seq = 1 THEN 'twelve' ELSE CAST(car_count AS STRING) END AS cars",
    )
    return timetable.validate_rows(timetable.parse_timetable(rows))


@query("reconcile_listings", BASE + "SELECT number, 2::BIGINT AS pages, CASE WHEN number::INTEGER % 5 = 0 OR number::INTEGER % 7 = 0 THEN 'rejected' ELSE 'kept' END AS verdict FROM trains")
def reconcile_listings(s, d):
    """Every train on two pages, which differ for a fifth of them; for a seventh, one page can't be read."""
    t = A.trains(s, d).select("number", "train_type", "days", "car_count")
    second = t.withColumn("car_count", F.expr("CASE WHEN CAST(number AS INT) % 5 = 0 THEN car_count + 1 ELSE car_count END"))
    lost = F.expr("CAST(number AS INT) % 7 = 0")
    return timetable.reconcile_listings(t.withColumn("page", F.lit(1)).withColumn("unreadable", F.lit(None).cast("boolean")).unionByName(second.withColumn("page", F.lit(2)).withColumn("unreadable", lost)))


@query("update_registry", "SELECT n_name AS version, CASE WHEN n_nationkey = 7 THEN 'promoted' WHEN n_nationkey % 3 = 0 THEN 'superseded' ELSE 'rejected' END AS status, n_nationkey = 7 AS is_synthetic FROM nation")
def update_registry(s, d):
    """A version for each nation, a third of them promoted; one comes again and is promoted."""
    n = A._read(s, d, "nation").selectExpr("n_nationkey AS k", "n_name AS version", "CASE WHEN n_nationkey % 3 = 0 THEN 'promoted' ELSE 'rejected' END AS status", "false AS is_synthetic")
    entry = n.filter("k = 7").select("version", F.lit("promoted").alias("status"), F.lit(True).alias("is_synthetic"))
    return evaluation.update_registry(n.drop("k"), entry)


OVERRIDES = BASE + """, t AS (SELECT *, number::INTEGER % 6 AS k FROM trains)
SELECT number, CASE k WHEN 0 THEN 'removed' WHEN 1 THEN
 CASE WHEN car_count = 9 THEN 'no change' ELSE 'changed' END WHEN 2 THEN 'changed' WHEN 3 THEN 'changed' WHEN 4 THEN 'no change' ELSE 'added' END AS outcome,
 CASE k WHEN 0 THEN 0 WHEN 3 THEN n - 1 WHEN 5 THEN 2 ELSE n END::BIGINT AS stops,
 CASE k WHEN 0 THEN NULL WHEN 1 THEN 9 WHEN 5 THEN NULL ELSE car_count END::INTEGER AS car_count
FROM t JOIN (SELECT train_id, count(*) AS n FROM scheduled_stops GROUP BY 1) USING (train_id)"""


@query("apply_overrides", OVERRIDES)
def apply_overrides(s, d):
    """One correction per train: removed, other attributes, another time, a stop less, nothing new; a sixth of the trains is new."""
    stops, trains = _t(s, d)
    k = F.col("number").cast("int") % 6
    action = F.when(k == 0, "remove").when(k == 5, "add").otherwise("set")
    o = trains.select("number", action.alias("action"), F.lit("checked by hand").alias("reason"), F.when(k == 5, "up").alias("direction"), F.when(k == 5, "slow").alias("train_type"), F.lit(None).cast("string").alias("days"), F.lit(None).cast("boolean").alias("is_ac"), F.when(k == 1, 9).alias("car_count"))
    named = stops.join(trains.select("train_id", "number"), "train_id").withColumn("k", k)
    cell = ["number", "station_code", "station_seq", "stop_seq", "arrival_s", "departure_s"]
    time = named.filter("k = 2 AND stop_seq = 2").withColumns({"kind": F.lit("stop_time"), "arrival_s": (F.col("arrival_s") + 60) % 86400, "departure_s": (F.col("departure_s") + 60) % 86400})
    same = named.filter("k = 4 AND stop_seq = 2").withColumn("kind", F.lit("stop_time"))
    less = named.filter("k = 3 AND stop_seq = 3").withColumn("kind", F.lit("remove_stop"))
    new = named.filter("k = 5 AND stop_seq <= 2").withColumn("kind", F.lit("stop")).withColumn("arrival_s", F.coalesce("arrival_s", "departure_s"))
    changes = time.unionByName(same).unionByName(less).unionByName(new).select(*cell, "kind")
    old = trains.filter(k != 5)
    after, held, report = timetable.apply_overrides(old, stops.join(old.select("train_id"), "train_id", "left_semi"), o, changes)
    n = held.groupBy("number").agg(F.count("*").alias("stops"))
    return report.join(n, "number", "left").join(after.select("number", "car_count"), "number", "left").select("number", "outcome", F.coalesce("stops", F.lit(0)).alias("stops"), "car_count")


@query("upsert_stops", BASE + "SELECT train_id, count(*) AS stops FROM scheduled_stops s JOIN trains t USING (train_id) WHERE t.line = 'central' AND NOT t.is_ac OR t.is_ac AND stop_seq <= 3 GROUP BY train_id")
def upsert_stops(s, d):
    """AC trains come with three stops each and replace a whole line."""
    stops, trains = _t(s, d)
    ac = trains.filter("is_ac")
    new = stops.join(ac.select("train_id"), "train_id", "left_semi").filter("stop_seq <= 3")
    return timetable.upsert_stops(stops, trains, new, ac, "harbour").groupBy("train_id").agg(F.count("*").alias("stops"))


@query("upsert_stations", BASE + """, o AS (SELECT code, arg_min(line, (line <> 'central', line)) AS line, arg_min(seq, (line <> 'central', line)) AS seq FROM places GROUP BY code)
SELECT code, CASE WHEN substr(code, 2)::INTEGER % 2 = 0 THEN 'old ' || p.name ELSE 'New ' || p.name END AS name, o.line, o.seq::INTEGER AS seq FROM o
 JOIN (SELECT DISTINCT code, name FROM places) p USING (code)""")
def upsert_stations(s, d):
    """Half of the stations are stored under the second line's old name, which a load of the first line must not change."""
    p = A.places(s, d)
    stored = p.select("code", F.concat(F.lit("old "), "name").alias("name"), F.lit("harbour").alias("line")).distinct().filter("substr(code, 2) % 2 = 0")
    new = p.filter("line = 'central'").select("code", F.concat(F.lit("New "), "name").alias("name"), "line")
    return timetable.upsert_stations(stored.withColumn("seq", F.lit(0)), new, p.select("line", "code", "seq"))


@query("build_run_log", BASE + """, p AS (SELECT DISTINCT batch_id FROM observations), s AS (SELECT *
 FROM (VALUES ('ntes', true), ('mobond', true), ('yatri', false)) v(source, enabled)),
r AS (SELECT batch_id, source, count(*) AS readings, bool_or(id % 23 = 0) AS error FROM observations GROUP BY ALL)
SELECT p.batch_id, s.source, coalesce(readings, 0) AS readings,
 CASE WHEN NOT enabled THEN 'skipped_disabled' WHEN readings IS NULL THEN 'failed' WHEN error THEN 'partial' ELSE 'ok' END AS status FROM p CROSS
 JOIN s LEFT JOIN r ON r.batch_id = p.batch_id AND r.source = s.source""")
def build_run_log(s, d):
    o = A.observations(s, d)
    sources = s.createDataFrame([("ntes", True), ("mobond", True), ("yatri", False)], "source string, enabled boolean")
    results = o.groupBy("batch_id", "source").agg(F.count("*").alias("readings"), F.when(F.max(F.expr("id % 23 = 0")), "parse error").alias("error"))
    return health.build_run_log(o.select("batch_id").distinct(), results, sources).select("batch_id", "source", "readings", "status")


@query("backfill_matches", BASE + """, r AS (SELECT id, id % 4 AS k FROM crowd_reports)
SELECT id, CASE WHEN k IN (0, 1) THEN 'new' || (id % 100)::VARCHAR ELSE 'old' END AS matched_train_id,
 CASE WHEN k IN (0, 1) THEN 0.7 ELSE 0.5 END::DOUBLE AS match_confidence,
 CASE WHEN k IN (0, 1) THEN 'auto' WHEN k = 2 THEN 'user' ELSE 'nudge' END AS match_method FROM r""")
def backfill_matches(s, d):
    """Reports never tried, answered by the machine, and answered by people, who keep their answers."""
    k = F.col("id") % 4
    r = A.crowd_reports(s, d).select("id", F.when(k != 0, "old").alias("matched_train_id"), F.when(k != 0, 0.5).alias("match_confidence"), F.when(k == 1, "auto").when(k == 2, "user").when(k == 3, "nudge").alias("match_method"))
    m = r.select("id", F.concat(F.lit("new"), (F.col("id") % 100).cast("string")).alias("train_id"), F.lit(0.7).alias("confidence"))
    return matching.backfill_matches(r, m, again=True)


@query("stream_latest_reading", BASE + """, o AS (SELECT *, observed_at::DATE AS day FROM observations_dup), w AS (SELECT max(observed_at) - INTERVAL 20 MINUTE AS mark FROM o)
SELECT train_id, day, arg_max(station_code, (observed_at, batch_id, station_code, delay_minutes)) AS station_code, floor(epoch(max(observed_at)))::BIGINT AS observed_s
 FROM o WHERE day + INTERVAL 1 DAY <= (SELECT mark FROM w) GROUP BY ALL""")
def stream_latest_reading(s, d):
    return _stream(s, d, streams.stream_latest_reading, "append").select("train_id", "day", "station_code", F.unix_seconds("observed_at").alias("observed_s"))


@query("evaluate_segments", EVAL + """, x AS (SELECT p.*, s.station_code, s.hour FROM pred p
 JOIN split s USING (id)), y AS (SELECT label, train_station AS p, 'all' AS segment, 'all' AS value FROM x UNION ALL
 SELECT label, train_station, 'direction', direction FROM x UNION ALL SELECT label, train_station, 'station_code', station_code FROM x UNION ALL
 SELECT label, train_station, 'hour', hour::VARCHAR FROM x)
SELECT segment, value, count(*) AS rows, avg(abs(label - p)) AS mae, avg((abs(label - round_even(p, 0)) <= 2)::INTEGER::DOUBLE) AS within_2, avg((abs(label - round_even(p, 0)) <= 5)::INTEGER::DOUBLE) AS within_5, avg(label - p) AS bias
 FROM y GROUP BY ALL""")
def evaluate_segments(s, d):
    rows = _pred(s, d).join(_split(s, d).select("id", "station_code", "hour"), "id")
    return evaluation.evaluate_segments(rows, "train_station", ("direction", "station_code", "hour"))


ASKED = "SELECT id, -1 AS cutoff_id, train_id, service_day, station_code, local_ts - INTERVAL 45 MINUTE AS cutoff, NULL::DOUBLE AS label FROM clean_obs"
_before, _after = TARGETS.index(", targets AS ("), TARGETS.index("),\npolls AS")


def _asked(clean):
    """Targets to foretell: every reading's place, three quarters of an hour before it."""
    from ..operators.features import prediction_targets

    return prediction_targets(clean.select(F.col("id").alias("target_id"), "train_id", "service_day", "station_code", (F.col("local_ts") - F.expr("INTERVAL 45 MINUTES")).alias("cutoff")))


query("prediction_features", TARGETS[:_before] + f", targets AS ({ASKED}" + TARGETS[_after:] + READING_SQL["feature_rows"].removeprefix(TARGETS))(lambda s, d: _feature_rows(s, d, _asked))


@query("delay_levels", NEXT + """, past AS (SELECT t.req_id, t.train_id, t.service_day, quantile_cont(o.delay_minutes, 0.1) AS low, quantile_cont(o.delay_minutes, 0.5) AS delay, quantile_cont(o.delay_minutes, 0.9) AS high, count(*) AS n
 FROM trips t JOIN clean_obs o ON o.train_id = t.train_id AND o.station_code = t.origin AND o.service_day < t.service_day GROUP BY ALL)
SELECT t.req_id, t.train_id, t.service_day, CASE WHEN n >= 3
 AND t.origin < 'S13' THEN 'model' WHEN n >= 2 THEN 'baseline' ELSE 'timetable' END AS level, CASE WHEN n >= 3
 AND t.origin < 'S13' THEN delay + 1 WHEN n >= 2 THEN delay ELSE 0 END::DOUBLE AS delay, CASE WHEN n >= 2 THEN low END AS low,
 CASE WHEN n >= 2 THEN high END AS high
FROM trips t LEFT JOIN past USING (req_id, train_id, service_day)""")
def delay_levels(s, d):
    """A stand-in for a model where three past readings are there and the station is covered, the baseline where two are."""
    key = F.struct("req_id", "train_id", "service_day").alias("key")
    t = next_trips(s, d).select(key, "train_id", F.col("origin").alias("station_code"), "service_day")
    past = recommend.baseline_predictions(t, _clean(s, d), least=2).filter("n >= 2")
    model = past.filter("n >= 3").withColumn("delay", F.col("delay") + 1)
    covered = A.places(s, d).filter("code < 'S13'").select(F.col("code").alias("station_code")).distinct()
    return recommend.delay_levels(t, model, past, covered).select("key.*", "level", "delay", "low", "high")


@query("ablate_features")
def ablate_features(s, d):
    """Test error without and with the time of day; trained models have no SQL, tests hold them against simpler forecasts."""
    rows = _split(s, d).withColumn("up", (F.col("direction") == "up").cast("int"))
    return evaluation.ablate_features(rows.filter("split <> 'test'"), rows.filter("split = 'test'"), ["weekday", "up"], ["hour"], iterations=3)


def _trained(s, d):
    rows = _split(s, d).withColumn("up", (F.col("direction") == "up").cast("int"))
    train, inputs = rows.filter("split <> 'test'"), ["hour", "weekday", "up"]
    return train, rows.filter("split = 'test'"), evaluation.train_delay_model(train, inputs, iterations=5)


@query("delay_model", EVAL + """, m AS (SELECT quantile_cont(label, 0.5) AS middle FROM split WHERE split <> 'test')
SELECT count(*) AS rows, round(coalesce(avg(abs(label - middle)), 0), 6) AS mae_middle, round(coalesce(avg(abs(label)), 0), 6) AS mae_zero, true AS in_order, true AS no_worse, true AS covers FROM split CROSS JOIN m WHERE split = 'test'""")
def delay_model(s, d):
    """A trained model's forecasts of the test rows, against the errors of the training rows' median and of no delay.

    Whether each range holds its forecast, whether the error is between a half
    and 1.1 times that of the median, and whether ranges hold 60 to 95 % of the
    delays (they are made to hold 80 %).
    """
    train, test, (model, low, high) = _trained(s, d)
    p = evaluation.predict_delay(model, low, high, test).crossJoin(train.agg(F.median("label").alias("middle")))
    miss = lambda c: F.avg(F.abs(F.col("label") - c))
    holds = lambda x: F.coalesce(x, F.lit(True))
    own, middle = miss(F.col("prediction")), miss(F.col("middle"))
    inside = F.avg(F.col("label").between(F.col("low"), F.col("high")).cast("double"))
    told = [F.round(F.coalesce(x, F.lit(0.0)), 6) for x in (middle, miss(F.lit(0.0)))]
    return p.agg(F.count("*").alias("rows"), told[0].alias("mae_middle"), told[1].alias("mae_zero"), holds(F.min(F.col("prediction").between(F.col("low"), F.col("high")))).alias("in_order"), holds(own.between(0.5 * middle, 1.1 * middle)).alias("no_worse"), holds(inside.between(0.6, 0.95)).alias("covers"))


@query("delay_ranges", EVAL + "SELECT direction, count(*) AS rows, true AS in_order, true AS covers FROM split WHERE split = 'test' GROUP BY direction")
def delay_ranges(s, d):
    """Ranges of each direction by the residuals of its own training rows: whether they hold their forecast, and 60 to 95 % of the delays."""
    train, test, (model, _, _) = _trained(s, d)
    p = evaluation.predict_ranges(model, evaluation.residual_ranges(model, train, ["direction"]), test, ["direction"])
    inside = F.avg(F.col("label").between(F.col("low"), F.col("high")).cast("double"))
    return p.groupBy("direction").agg(F.count("*").alias("rows"), F.min(F.col("prediction").between(F.col("low"), F.col("high"))).alias("in_order"), inside.between(0.6, 0.95).alias("covers"))


@query("predict_targets", EVAL + "SELECT id AS target_id, id % 7 <> 0 AS known, id % 7 <> 0 AS in_order FROM split WHERE split = 'test'")
def predict_targets(s, d):
    """Forecasts for the test rows as targets; a seventh of them has no features, as a train that doesn't serve the station."""
    _, test, (model, low, high) = _trained(s, d)
    out = evaluation.predict_targets(model, low, high, test.select(F.col("id").alias("target_id")), test.filter("id % 7 <> 0"))
    return out.select("target_id", F.col("delay").isNotNull().alias("known"), F.coalesce(F.col("delay").between(F.col("low"), F.col("high")), F.lit(False)).alias("in_order"))


IN_FORCE = "SELECT DATE '2024-01-01' + ((n_nationkey * 3) % 31)::INTEGER FROM nation WHERE n_nationkey % 3 < {0}"


@query("movable_holidays", BASE + f"SELECT id, isodow(day) = 7 OR strftime(day, '%m-%d') IN {HOLIDAYS} OR day IN ({IN_FORCE.format(2)}) AS sunday, isodow(day) = 7 OR strftime(day, '%m-%d') IN {HOLIDAYS} OR day IN ({IN_FORCE.format(3)}) AS with_tentative FROM (SELECT id, (observed_at + INTERVAL 330 MINUTE)::DATE AS day FROM observations)")
def movable_holidays(s, d):
    """Which days run to the Sunday timetable, without and with tentative holidays."""
    listed = A.movable_holidays(s, d)
    day = F.to_date(local_time(F.col("observed_at")))
    flag = lambda tentative: sunday_schedule(day, day.isin(*holidays_in_force(listed, tentative)))
    return A.observations(s, d).select("id", flag(False).alias("sunday"), flag(True).alias("with_tentative"))


_plain = RUNS_ON.format(m="days", d="service_day")


@query("next_trains_on_holidays", NEXT.replace(_plain, f"substr(days, CASE WHEN isodow(service_day) = 7 OR strftime(service_day, '%m-%d') IN {HOLIDAYS} OR service_day IN ({IN_FORCE.format(2)}) THEN 7 ELSE isodow(service_day) END, 1) = 'Y'") + "SELECT req_id, train_id, service_day, dep, arr, place FROM trips")
def next_trains_on_holidays(s, d):
    days = holidays_in_force(A.movable_holidays(s, d))
    return journeys.next_trains(A.requests(s, d), *_t(s, d), holidays=days).select("req_id", "train_id", "service_day", "dep", "arr", "place")


@query("read_observation_batches", BASE + "SELECT source, count(*) AS rows, count(delay_minutes) AS delays, count(train_number) AS numbers, 0::BIGINT AS kinds FROM observations GROUP BY source")
def read_observation_batches(s, d):
    """Batch files in nested folders, one of them with a column less and one more, read by name."""
    path = shared_folder(s, "batches")
    o = A.observations(s, d)
    o.filter("id % 2 = 0").drop("time_kind").write.parquet(f"{path}/2024-01-01/a")
    o.filter("id % 2 = 1").withColumn("raw_status", F.lit("text")).write.parquet(f"{path}/2024-01-02/b")
    return files.read_observation_batches(s, path).groupBy("source").agg(F.count("*").alias("rows"), F.count("delay_minutes").alias("delays"), F.count("train_number").alias("numbers"), F.count("time_kind").alias("kinds"))


query("block_id", BASE + "SELECT block_no, substr(sha1(strftime(block_date, '%Y-%m-%d') || '|' || line || '|' || from_station || '|' || coalesce(start_min::VARCHAR, '') || '|' || coalesce(tracks, '')), 1, 8) AS block_id FROM blocks")(
    lambda s, d: A.blocks(s, d).select("block_no", block_id(*[F.col(c) for c in ("block_date", "line", "from_station", "start_min", "tracks")]).alias("block_id"))
)
query("short_error", "SELECT event_id AS id, CASE WHEN event_id % 3 = 2 THEN repeat('x', 199) || '…' ELSE 'HTTP 503 for https://feed.example/boards after ' || (event_id % 9)::VARCHAR || ' tries' END AS error FROM events")(
    lambda s, d: A._read(s, d, "events").select(F.col("event_id").alias("id"), short_error(F.expr("CASE WHEN event_id % 3 = 2 THEN repeat('x', 250) ELSE concat('  HTTP 503 for\thttps://feed.example/boards?key=', event_id, '&q=1  after ', event_id % 9, '\n tries ') END")).alias("error"))
)
query("supplement_report", BASE + "SELECT CASE WHEN NOT is_ac THEN 'missing' WHEN train_type <> 'fast' THEN 'changed' ELSE 'unchanged' END AS change, count(*) AS trains FROM trains GROUP BY 1")(
    lambda s, d: timetable.supplement_report(timetable.apply_supplement(A.trains(s, d), A.trains(s, d).filter("is_ac").select("number", F.lit("fast").alias("train_type"))))
)
query("station_places", BASE + "SELECT code, name, CASE WHEN substr(code, 2)::INTEGER % 7 = 0 THEN 'depot' ELSE line END AS line, CASE WHEN substr(code, 2)::INTEGER % 7 = 0 THEN 0 ELSE seq END AS seq FROM places WHERE substr(code, 2)::INTEGER % 7 <> 0 OR line = 'central'")(
    lambda s, d: timetable.station_places(A.places(s, d).filter("substr(code, 2) % 7 <> 0").select("code", "line", "seq"), A.places(s, d).filter("line = 'central'").select("code", "name", F.lit("depot").alias("line"), F.lit(0).alias("seq")))
)
query("run_info", BASE + "SELECT t.train_id, t.run_start_min, s.station_seq AS origin_seq, t.line, t.car_count FROM trains t JOIN scheduled_stops s ON s.train_id = t.train_id AND s.stop_seq = 1")(
    lambda s, d: timetable.run_info(A.trains(s, d), A.scheduled_stops(s, d)).select("train_id", "run_start_min", "origin_seq", "line", "car_count")
)
