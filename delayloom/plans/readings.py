"""Queries over readings: quality flags, runs, and point-in-time features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, quality, runs
from ..session import kept
from ..sources import adapters as A
from .base_sql import BASE

NOW = "2024-01-25 00:00:00"
NUMBERS = "count(*) AS runs, quantile_cont(d_final, 0.5) AS median, quantile_cont(d_final, 0.9) AS p90, avg((d_final >= 5)::INTEGER::DOUBLE) AS share_late, count(*) < 5 AS few"
FACTS = BASE + """, facts AS (SELECT f.*, t.direction, t.train_type, t.line, hour(scheduled + INTERVAL 330 MINUTE) AS hour,
 CASE WHEN isodow(run_key) >= 6 OR strftime(run_key, '%m-%d') IN ('01-26', '04-14', '05-01', '08-15', '10-02', '12-25') THEN 'weekend' ELSE 'weekday' END AS kind
 FROM final_runs f JOIN trains t USING (train_id)),
banded AS (SELECT *, CASE WHEN hour >= 21 OR hour < 4 THEN 'night' WHEN hour >= 16 THEN 'pm_peak' WHEN hour >= 11 THEN 'midday' WHEN hour >= 7 THEN 'am_peak' ELSE 'early' END AS band
 FROM facts)
"""
READINGS = BASE + """, readings AS (SELECT o.*, actual_or_expected_time - to_minutes(round_even(delay_minutes, 0)::BIGINT) AS scheduled, (actual_or_expected_time - to_minutes(round_even(delay_minutes, 0)::BIGINT) + INTERVAL 330 MINUTE - INTERVAL 3 HOUR)::DATE AS run_key
 FROM observations o SEMI JOIN trains USING (train_id) WHERE source <> 'synthetic' AND event IN ('arrival', 'departure') AND NOT cancelled
 AND delay_minutes IS NOT NULL)
"""
DQ = BASE + """, o AS (SELECT *, epoch_us(observed_at) AS us FROM observations_dup),
sched AS (SELECT *, ((hour(t) * 60 + minute(t) - due + 720) % 1440 + 1440) % 1440 - 720 AS implied, ((hour(l) * 60 + minute(l) - due - round(coalesce(delay_minutes, 0))::INTEGER + 720) % 1440 + 1440) % 1440 - 720 AS away
 FROM (SELECT o.*, CASE WHEN event = 'departure' THEN coalesce(departure_s, arrival_s) ELSE coalesce(arrival_s, departure_s) END // 60 AS due, actual_or_expected_time + INTERVAL 330 MINUTE AS t, observed_at + INTERVAL 330 MINUTE AS l
  FROM o JOIN scheduled_stops s ON s.train_id = o.train_id AND s.station_code = o.station_code WHERE NOT cancelled)),
lagged AS (SELECT *, (us - lag(us) OVER w) / 60000000 AS gap, lag(batch_id) OVER w AS prev_batch
 FROM o WINDOW w AS (PARTITION BY source, train_number, station_code, event ORDER BY us, id)),
jumps AS (SELECT *, (us - lag(us) OVER w) / 60000000 AS gap, lag(delay_minutes) OVER w AS prev_delay FROM o WHERE delay_minutes IS NOT NULL
 AND NOT cancelled WINDOW w AS (PARTITION BY source, train_number, station_code, event ORDER BY us, id)),
exact AS (SELECT id, first_id FROM (SELECT id, first_value(id) OVER (PARTITION BY source, train_number, station_code, event, us, actual_or_expected_time, delay_minutes, cancelled
 ORDER BY id) AS first_id FROM o) WHERE id <> first_id),
near AS (SELECT id, gap, prev_batch FROM lagged WHERE gap <= 5 AND batch_id IS DISTINCT FROM prev_batch),
implausible AS (SELECT o.id, delay_minutes, CASE WHEN t.train_id IS NULL THEN 120 ELSE 15 END::INTEGER AS early, CASE WHEN t.train_id IS NULL THEN 1440 ELSE 180 END::INTEGER AS late FROM o LEFT JOIN trains t USING (train_id) WHERE delay_minutes <
 CASE WHEN t.train_id IS NULL THEN -120 ELSE -15 END OR delay_minutes > CASE WHEN t.train_id IS NULL THEN 1440 ELSE 180 END),
jump AS (SELECT id, prev_delay, delay_minutes, gap FROM jumps WHERE gap <= 60 AND abs(delay_minutes - prev_delay) > gap + 15),
mismatch AS (SELECT id, implied, delay_minutes FROM sched WHERE abs(implied - delay_minutes) > 20),
far AS (SELECT id, away FROM sched WHERE abs(away) > 240),
future AS (SELECT id, (us - epoch_us(TIMESTAMP '2024-01-25 00:00:00')) / 60000000 AS ahead FROM o
 WHERE (us - epoch_us(TIMESTAMP '2024-01-25 00:00:00')) / 60000000 > 5),
offbatch AS (SELECT id, off FROM (SELECT id, (us - epoch_us(try_strptime(substr(batch_id, 1, 15), '%Y%m%dT%H%M%S'))) / 60000000 AS off FROM o)
 WHERE abs(off) > 90),
flags AS (SELECT id, flag, min(detail) AS detail FROM (SELECT id, 'exact_duplicate' AS flag, 'the same reading as observation ' || first_id AS detail FROM exact
 UNION ALL SELECT id, 'near_duplicate', 'read ' || round(gap, 1) || ' min after batch ' || coalesce(prev_batch, '?') FROM near
 UNION ALL SELECT id, 'implausible_delay', 'delay ' || delay_minutes || ' min; allowed ' || early || ' early to ' || late || ' late' FROM implausible
 UNION ALL SELECT id, 'delay_jump', 'delay went from ' || prev_delay || ' to ' || delay_minutes || ' min in ' || round(gap, 1) || ' min' FROM jump
 UNION ALL SELECT id, 'schedule_mismatch', 'source says ' || delay_minutes || ' min late; our timetable implies ' || implied FROM mismatch
 UNION ALL SELECT id, 'far_from_schedule', 'read ' || away || ' min from when the train was due' FROM far
 UNION ALL SELECT id, 'future_timestamp', 'stamped ' || round(ahead, 1) || ' min in the future' FROM future
 UNION ALL SELECT id, 'batch_time_mismatch', 'stamped ' || round(off) || ' min from its batch' FROM offbatch) GROUP BY id, flag)
"""
TARGETS = BASE + """, targets AS (
 SELECT l.id, p.id AS cutoff_id, l.train_id, l.service_day, l.station_code, p.local_ts AS cutoff, l.delay_minutes AS label FROM clean_obs l
 JOIN clean_obs p ON p.train_id = l.train_id AND p.service_day = l.service_day AND p.local_ts < l.local_ts
 UNION ALL SELECT id, -1, train_id, service_day, station_code, service_day::TIMESTAMP + to_minutes(run_start_min - 10), delay_minutes FROM clean_obs),
polls AS (SELECT batch_id, max(local_ts) AS batch_ts FROM clean_obs GROUP BY 1),
batch_line AS (SELECT batch_id, line, direction, quantile_cont(delay_minutes, 0.5) AS line_median, count(*) AS line_count FROM clean_obs
 GROUP BY ALL),
batch_far AS (SELECT batch_id, quantile_cont(d, 0.5) AS ld_median, count(*) AS ld_count FROM (SELECT batch_id, train_id, avg(delay_minutes) AS d
 FROM observations o ANTI JOIN trains USING (train_id) WHERE delay_minutes IS NOT NULL AND NOT cancelled GROUP BY ALL) GROUP BY 1),
prior AS (SELECT * FROM (SELECT t.id, t.cutoff_id, o.delay_minutes AS prior_delay, o.sched_minutes AS prior_sched, o.point_seq AS prior_point, o.station_seq AS prior_seq, row_number() OVER (PARTITION BY t.id, t.cutoff_id
 ORDER BY o.local_ts DESC, o.id DESC) AS r
 FROM targets t JOIN clean_obs o ON o.train_id = t.train_id AND o.service_day = t.service_day AND o.local_ts <= t.cutoff) WHERE r = 1),
state AS (SELECT t.id, t.cutoff_id, arg_max(b.batch_id, (b.batch_ts, b.batch_id)) AS state_batch FROM targets t JOIN polls b ON b.batch_ts <= t.cutoff
 AND date_diff('minute', b.batch_ts, t.cutoff) <= 20 AND b.batch_ts > t.cutoff - INTERVAL 1 HOUR GROUP BY ALL),
history AS (SELECT k.train_id, k.station_code, k.service_day, quantile_cont(o.delay_minutes, 0.5) AS hist_delay, count(*) AS hist_count
 FROM (SELECT DISTINCT train_id, station_code, service_day FROM clean_obs) k JOIN clean_obs o ON o.train_id = k.train_id
 AND o.station_code = k.station_code AND o.service_day < k.service_day GROUP BY ALL),
spans AS (SELECT b.*, f.seq AS from_seq, t.seq AS to_seq, CASE WHEN start_min IS NULL
 AND end_min IS NULL THEN 600 WHEN end_min IS NOT NULL THEN start_min END AS s, CASE WHEN start_min IS NULL
 AND end_min IS NULL THEN 960 WHEN start_min IS NOT NULL THEN end_min END AS e
 FROM blocks b LEFT JOIN places f ON f.line = b.line AND f.code = b.from_station LEFT JOIN places t ON t.line = b.line AND t.code = b.to_station)
"""

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _base(spark, d):
    return A.observations(spark, d), A.trains(spark, d)


def _readings(spark, d):
    obs, t = _base(spark, d)
    return runs.run_readings(obs, t)


def _facts(spark, d):
    return runs.run_facts(runs.final_runs(_readings(spark, d)), A.trains(spark, d))


def _clean(spark, d):
    obs, t = _base(spark, d)
    return features.clean_obs(obs, t, A.scheduled_stops(spark, d))


def _sched(spark, d):
    return quality.with_schedule(A.repeated_observations(spark, d), A.scheduled_stops(spark, d))


def seconds(df, *columns):
    return df.withColumns({c: F.unix_seconds(c) for c in columns})


def _feature_rows(spark, d, targets):
    """Features of ``targets(clean)``; readings, stops and targets are written once, as many joins need them."""
    clean, stops = kept(_clean(spark, d), "clean"), kept(A.scheduled_stops(spark, d), "stops")
    return features.feature_rows(kept(targets(clean), "targets"), clean, A.observations(spark, d), A.trains(spark, d), stops, A.places(spark, d), A.blocks(spark, d))


query("trains", BASE + "SELECT * FROM trains")(A.trains)
query("scheduled_stops", BASE + "SELECT * FROM scheduled_stops")(A.scheduled_stops)
query("observations", BASE + "SELECT * REPLACE (floor(epoch(observed_at))::BIGINT AS observed_at, floor(epoch(actual_or_expected_time))::BIGINT AS actual_or_expected_time) FROM observations")(lambda s, d: seconds(A.observations(s, d), "observed_at", "actual_or_expected_time"))
query("flag_exact_duplicate", DQ + "SELECT * FROM exact")(lambda s, d: quality.flag_exact_duplicate(A.repeated_observations(s, d)))
query("flag_near_duplicate", DQ + "SELECT * FROM near")(lambda s, d: quality.flag_near_duplicate(A.repeated_observations(s, d)))
query("flag_implausible_delay", DQ + "SELECT * FROM implausible")(lambda s, d: quality.flag_implausible_delay(A.repeated_observations(s, d), A.trains(s, d)))
query("flag_delay_jump", DQ + "SELECT * FROM jump")(lambda s, d: quality.flag_delay_jump(A.repeated_observations(s, d)))
query("flag_schedule_mismatch", DQ + "SELECT * FROM mismatch")(lambda s, d: quality.flag_schedule_mismatch(_sched(s, d)))
query("flag_far_from_schedule", DQ + "SELECT * FROM far")(lambda s, d: quality.flag_far_from_schedule(_sched(s, d)))
query("flag_future_timestamp", DQ + "SELECT * FROM future")(lambda s, d: quality.flag_future_timestamp(A.repeated_observations(s, d), F.lit(NOW).cast("timestamp")))
query("flag_batch_time_mismatch", DQ + "SELECT * FROM offbatch")(lambda s, d: quality.flag_batch_time_mismatch(A.repeated_observations(s, d)))


def _flags(s, d):
    return quality.find_flags(A.repeated_observations(s, d), A.trains(s, d), A.scheduled_stops(s, d), F.lit(NOW).cast("timestamp"))


REAL = DQ.replace("FROM observations_dup)", "FROM observations_dup WHERE source <> 'synthetic')", 1)
query("find_flags", REAL + "SELECT * FROM flags")(_flags)
query("flag_summary", REAL + """, j AS (SELECT f.*, o.us, row_number() OVER (PARTITION BY flag ORDER BY o.us DESC, f.id DESC) AS r FROM flags f JOIN o USING (id))
SELECT flag, count(*) AS rows, count(*) / (SELECT count(*) FROM observations_dup) AS share, array_to_string(list(id
 ORDER BY id) FILTER (r <= 5), ',') AS examples FROM j GROUP BY flag""")(lambda s, d: quality.flag_summary(A.repeated_observations(s, d), _flags(s, d)))
WINDOW = "WHERE observed_at BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00'"
_week = lambda df: quality.in_window(df, F.lit("2024-01-08").cast("timestamp"), F.lit("2024-01-15").cast("timestamp"))
query("flag_summary_window", REAL + f""", d AS (SELECT * FROM observations_dup {WINDOW}), j AS (SELECT f.*, o.us, row_number() OVER (PARTITION BY flag ORDER BY o.us DESC, f.id DESC) AS r FROM flags f JOIN o USING (id) SEMI JOIN d USING (id))
SELECT flag, count(*) AS rows, count(*) / (SELECT count(*) FROM d) AS share, array_to_string(list(id
 ORDER BY id) FILTER (r <= 5), ',') AS examples FROM j GROUP BY flag""")(lambda s, d: quality.flag_summary(_week(A.repeated_observations(s, d)), _flags(s, d)))
query("flagged_rows", REAL + f", d AS (SELECT * FROM observations_dup {WINDOW}) SELECT (SELECT count(*) FROM d) AS rows, count(DISTINCT id) AS flagged, count(DISTINCT id) / (SELECT count(*) FROM d) AS share FROM flags SEMI JOIN d USING (id)")(lambda s, d: quality.flagged_rows(_week(A.repeated_observations(s, d)), _flags(s, d)))
query("source_rates", BASE + "SELECT source, count(*) AS rows, count_if(cancelled)::BIGINT AS cancelled, count_if(less_accurate)::BIGINT AS less_accurate, (count(*) - count(delay_minutes))::BIGINT AS no_delay FROM observations GROUP BY source")(lambda s, d: quality.source_rates(A.observations(s, d)))
query("unmatched_trains", BASE + "SELECT train_number, count(*) AS rows, CASE WHEN regexp_matches(train_number, '^9[5-9][0-9]{3}$') THEN 'suburban' ELSE 'other' END AS kind FROM observations ANTI JOIN trains USING (train_id) GROUP BY train_number")(lambda s, d: quality.unmatched_trains(*_base(s, d)))
query("unmatched_stations", BASE + "SELECT station_code, count(*) AS rows, count(DISTINCT train_id) AS trains FROM observations o SEMI JOIN trains USING (train_id) WHERE NOT EXISTS (SELECT 1 FROM scheduled_stops s WHERE s.train_id = o.train_id AND s.station_code = o.station_code) GROUP BY 1")(lambda s, d: quality.unmatched_stations(A.observations(s, d), A.scheduled_stops(s, d)))
query("schedule_drift", DQ + "SELECT train_id, station_code, quantile_cont(implied - delay_minutes, 0.5) AS drift, count(*) AS rows FROM sched WHERE delay_minutes IS NOT NULL GROUP BY ALL HAVING abs(quantile_cont(implied - delay_minutes, 0.5)) BETWEEN 2 AND 20")(lambda s, d: quality.schedule_drift(_sched(s, d)))
query("final_runs", BASE + "SELECT train_id, station_code, run_key, d_final, floor(epoch(last_seen))::BIGINT AS last_seen, floor(epoch(scheduled))::BIGINT AS scheduled, floor(epoch(due))::BIGINT AS due FROM final_runs")(lambda s, d: seconds(runs.final_runs(_readings(s, d)), "last_seen", "scheduled", "due"))
PAIRS = READINGS + """, pairs AS (SELECT r.id, r.delay_minutes <= 0 AS said_on_time, (epoch_us(f.scheduled) - epoch_us(r.observed_at)) / 60000000 AS lead, d_final - delay_minutes AS drift
 FROM readings r JOIN final_runs f ON f.train_id = r.train_id AND f.station_code = r.station_code AND f.run_key = r.run_key
 AND r.observed_at < f.last_seen)
"""
query("drift_pairs", PAIRS + "SELECT * FROM pairs")(lambda s, d: runs.drift_pairs(_readings(s, d), runs.final_runs(_readings(s, d))))
query("drift_table", PAIRS + """SELECT said_on_time, CASE WHEN lead < 0 THEN 0 WHEN lead <= 15 THEN 1 WHEN lead <= 30 THEN 2 WHEN lead <= 60 THEN 3 ELSE 4 END AS bucket, count(*) AS n, avg(abs(drift)) AS mean_abs, quantile_cont(drift, 0.1) AS p10, quantile_cont(drift, 0.5) AS p50, quantile_cont(drift, 0.9) AS p90,
 avg((drift >= 5)::INTEGER::DOUBLE) AS share_later, avg((drift <= -3)::INTEGER::DOUBLE) AS share_earlier FROM pairs GROUP BY 1, 2""")(lambda s, d: runs.drift_table(runs.drift_pairs(_readings(s, d), runs.final_runs(_readings(s, d)))))
query("delay_patterns", FACTS + f"""SELECT CASE WHEN grouping(hour) = 0 THEN 'hour' WHEN grouping(band) = 0 THEN 'band' WHEN grouping(direction) = 0 THEN 'direction' WHEN grouping(train_type) = 0 THEN 'type' ELSE 'overall' END AS grain, direction, hour, band, train_type, {NUMBERS}
 FROM banded GROUP BY GROUPING SETS ((direction, hour), (direction, band), (direction), (train_type), ())""")(lambda s, d: runs.delay_patterns(_facts(s, d)))
query("day_kind_split", FACTS + "SELECT *, count(*) OVER () = 2 AND min(days) OVER () >= 2 AS ready FROM (SELECT kind, count(DISTINCT run_key) AS days, count(*) AS runs, quantile_cont(d_final, 0.5) AS median, quantile_cont(d_final, 0.9) AS p90 FROM banded GROUP BY kind)")(lambda s, d: runs.day_kind_split(_facts(s, d)))
query("line_state_backtest", READINGS + """, cut AS (SELECT f.*, t.line, t.direction, lead, scheduled - to_minutes(lead) AS cutoff FROM final_runs f JOIN trains t USING (train_id) CROSS
 JOIN (VALUES (15), (30), (45), (60)) AS l(lead)),
own AS (SELECT c.train_id, c.station_code, c.run_key, c.lead, arg_max(r.delay_minutes, (r.observed_at, r.id)) AS own FROM cut c
 JOIN readings r ON r.train_id = c.train_id AND r.station_code = c.station_code AND r.run_key = c.run_key AND r.observed_at <= c.cutoff GROUP BY ALL),
latest AS (SELECT c.train_id, c.station_code, c.run_key, c.lead, r.train_id AS other, arg_max(r.delay_minutes, (r.observed_at, r.id)) AS d FROM cut c
 JOIN (SELECT r.*, t.line, t.direction FROM readings r JOIN trains t USING (train_id)) r ON r.line = c.line AND r.direction = c.direction
 AND r.train_id <> c.train_id AND r.observed_at <= c.cutoff AND r.observed_at > c.cutoff - INTERVAL 30 MINUTE GROUP BY ALL),
state AS (SELECT train_id, station_code, run_key, lead, quantile_cont(d, 0.5) AS line_delay FROM latest GROUP BY ALL),
j AS (SELECT c.*, own, line_delay FROM cut c LEFT JOIN own USING (train_id, station_code, run_key, lead) LEFT
 JOIN state USING (train_id, station_code, run_key, lead))
SELECT lead, direction, grouping(lead)::TINYINT AS all_leads, grouping(direction)::TINYINT AS all_directions, count(*) AS runs, avg(abs(d_final)) AS mae_zero, avg(abs(d_final - coalesce(own, 0))) AS mae_own, avg(abs(d_final - coalesce(line_delay, 0))) AS mae_line, avg(abs(d_final - greatest(coalesce(own, 0), coalesce(line_delay, 0)))) AS mae_max, avg((line_delay IS NOT NULL)::INTEGER::DOUBLE) AS line_known
 FROM j GROUP BY ROLLUP (lead, direction)""")(lambda s, d: runs.line_state_backtest(_readings(s, d), runs.final_runs(_readings(s, d)), A.trains(s, d)))
query("baseline_check", READINGS + """, a AS (SELECT f.train_id, f.station_code, f.run_key, quantile_cont(r.delay_minutes, 0.5) AS by_reading FROM final_runs f
 JOIN readings r ON r.train_id = f.train_id AND r.station_code = f.station_code AND r.run_key < f.run_key GROUP BY ALL),
b AS (SELECT f.train_id, f.station_code, f.run_key, quantile_cont(r.d_final, 0.5) AS by_run FROM final_runs f
 JOIN final_runs r ON r.train_id = f.train_id AND r.station_code = f.station_code AND r.run_key < f.run_key GROUP BY ALL),
j AS (SELECT f.*, by_reading, by_run, direction FROM final_runs f JOIN a USING (train_id, station_code, run_key)
 JOIN b USING (train_id, station_code, run_key) JOIN trains USING (train_id))
SELECT direction, grouping(direction)::TINYINT AS all_directions, count(*) AS runs, avg(abs(d_final - by_reading)) AS mae_reading, avg(d_final - by_reading) AS bias_reading, avg(abs(d_final - by_run)) AS mae_run, avg(d_final - by_run) AS bias_run
 FROM j GROUP BY ROLLUP (direction)""")(lambda s, d: runs.baseline_check(_readings(s, d), runs.final_runs(_readings(s, d)), A.trains(s, d)))
COMPARED = FACTS + """, f AS (SELECT *, isodow((scheduled + INTERVAL 330 MINUTE)::DATE) = 7 OR strftime(scheduled + INTERVAL 330 MINUTE, '%m-%d') IN ('01-26', '04-14', '05-01', '08-15', '10-02', '12-25') AS sunday FROM banded),
a AS (SELECT * FROM f WHERE line = 'harbour'), b AS (SELECT * FROM f WHERE line = 'central'), codes AS (SELECT DISTINCT station_code FROM a),
row_ AS (SELECT code, lag(code) OVER (ORDER BY seq) AS p, lead(code) OVER (ORDER BY seq) AS n FROM places WHERE line = 'central'),
near AS (SELECT station_code FROM codes UNION SELECT code FROM row_ WHERE p IN (SELECT station_code FROM codes) OR n IN (SELECT station_code FROM codes))
"""
query("neighbours", COMPARED + "SELECT station_code FROM near")(lambda s, d: runs.neighbours(_facts(s, d).filter("line = 'harbour'"), A.places(s, d)))
query("compare_runs", COMPARED + """, u AS (SELECT 'a' AS dataset, * FROM a UNION ALL SELECT 'b', * FROM b SEMI JOIN near USING (station_code) SEMI JOIN a USING (sunday, hour))
SELECT dataset, direction, train_type, count(*) AS runs, avg(d_final) AS mean, quantile_cont(d_final, 0.5) AS p50, quantile_cont(d_final, 0.9) AS p90, avg((d_final <= 1)::INTEGER::DOUBLE) AS share_1, avg((d_final >= 5)::INTEGER::DOUBLE) AS share_5, avg((d_final >= 10)::INTEGER::DOUBLE) AS share_10
 FROM u GROUP BY ALL""")(lambda s, d: runs.compare_runs(_facts(s, d).filter("line = 'harbour'"), _facts(s, d).filter("line = 'central'"), A.places(s, d)))
query("delay_by_hour_weekday", BASE + "SELECT (isodow(local_ts) - 1)::INTEGER AS weekday, hour(local_ts) AS hour, avg(delay_minutes) AS delay, count(*) AS readings FROM clean_obs GROUP BY 1, 2")(lambda s, d: runs.delay_by_hour_weekday(_clean(s, d)))
query("delay_by_station", BASE + "SELECT line, direction, station_code, avg(delay_minutes) AS delay, count(*) AS readings FROM clean_obs GROUP BY ALL")(lambda s, d: runs.delay_by_station(_clean(s, d)))
query("delay_by_train", BASE + """, x AS (SELECT train_id, count(DISTINCT (observed_at + INTERVAL 330 MINUTE)::DATE) AS cancelled_days FROM observations WHERE cancelled GROUP BY 1)
SELECT train_id, median, p90, worst, days, readings, coalesce(cancelled_days, 0) AS cancelled_days
 FROM (SELECT train_id, quantile_cont(delay_minutes, 0.5) AS median, quantile_cont(delay_minutes, 0.9) AS p90, max(delay_minutes) AS worst, count(DISTINCT service_day) AS days, count(*) AS readings
 FROM clean_obs GROUP BY 1) LEFT JOIN x USING (train_id)""")(lambda s, d: runs.delay_by_train(_clean(s, d), A.observations(s, d)))
query("delay_along_route", BASE + "SELECT train_id, point_seq, quantile_cont(delay_minutes, 0.5) AS median, quantile_cont(delay_minutes, 0.9) AS p90, count(*) AS n FROM clean_obs GROUP BY ALL")(lambda s, d: runs.delay_along_route(_clean(s, d)))
query("observation_summary", BASE + "SELECT count(*) AS rows, floor(epoch(min(observed_at)))::BIGINT AS first_s, floor(epoch(max(observed_at)))::BIGINT AS last_s, count_if(cancelled)::BIGINT AS cancelled, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM observations")(lambda s, d: runs.observation_summary(A.observations(s, d)))
query("recent_reports", BASE + "SELECT source, r::INTEGER AS r, id, crowd_level FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY reported_at DESC, id DESC) AS r FROM crowd_reports) WHERE r <= 3")(lambda s, d: runs.recent_reports(A.crowd_reports(s, d)))
query("crowd_summary", BASE + "SELECT crowd_level, hour, count(*) AS reports, avg(l) AS mean_level FROM (SELECT *, crowd_level AS l, hour(reported_at + INTERVAL 330 MINUTE) AS hour FROM crowd_reports) GROUP BY GROUPING SETS ((crowd_level), (hour))")(lambda s, d: runs.crowd_summary(A.crowd_reports(s, d)))
query("route_points", BASE + """, n AS (SELECT s.*, t.line, lead(station_seq) OVER (PARTITION BY train_id ORDER BY stop_seq) AS nq, lead(s.minutes) OVER (PARTITION BY train_id
 ORDER BY stop_seq) AS nm FROM scheduled_stops s JOIN trains t USING (train_id)),
p AS (SELECT train_id, station_code, station_seq, minutes::DOUBLE AS minutes, true AS is_stop FROM n UNION ALL
 SELECT n.train_id, p.code, p.seq, n.minutes + (p.seq - n.station_seq)::DOUBLE / (nq - n.station_seq) * (nm - n.minutes), false FROM n
 JOIN places p ON p.line = n.line AND p.seq > least(station_seq, nq) AND p.seq < greatest(station_seq, nq))
SELECT train_id, station_code, (row_number() OVER (PARTITION BY train_id
 ORDER BY minutes) - 1)::INTEGER AS point_seq, station_seq, minutes, is_stop, minutes / max(minutes) OVER (PARTITION BY train_id) AS progress FROM p""")(lambda s, d: features.route_points(A.scheduled_stops(s, d), A.trains(s, d), A.places(s, d)))
query("clean_obs", BASE + "SELECT id, train_id, station_code, delay_minutes, service_day, point_seq, sched_minutes FROM clean_obs")(lambda s, d: _clean(s, d).select("id", "train_id", "station_code", "delay_minutes", "service_day", "point_seq", "sched_minutes"))
query("batch_line", TARGETS + "SELECT * FROM batch_line")(lambda s, d: features.batch_line(_clean(s, d)))
query("batch_far", TARGETS + "SELECT * FROM batch_far")(lambda s, d: features.batch_far(*_base(s, d)))
query("batches", TARGETS + "SELECT batch_id, floor(epoch(batch_ts))::BIGINT AS batch_ts FROM polls")(lambda s, d: seconds(features.batches(_clean(s, d)), "batch_ts"))
query("training_targets", TARGETS + "SELECT id, cutoff_id, train_id, service_day, station_code, floor(epoch(cutoff))::BIGINT AS cutoff, label FROM targets")(lambda s, d: seconds(features.training_targets(_clean(s, d)), "cutoff").drop("label_time"))
query("asof_prior", TARGETS + "SELECT t.id, t.cutoff_id, prior_delay, prior_point FROM targets t LEFT JOIN prior p USING (id, cutoff_id)")(lambda s, d: features.asof_join(features.training_targets(_clean(s, d)), _clean(s, d), ["train_id", "service_day"], "cutoff", "local_ts", ["delay_minutes", "point_seq"], "id").select("id", "cutoff_id", F.col("prior_delay_minutes").alias("prior_delay"), F.col("prior_point_seq").alias("prior_point")))
query("asof_batch_state", TARGETS + "SELECT * FROM state")(lambda s, d: features.batch_state(features.training_targets(_clean(s, d)), features.batches(_clean(s, d))))
query("history_delay", TARGETS + "SELECT * FROM history")(lambda s, d: features.history_delay(_clean(s, d)))
query("block_spans", TARGETS + "SELECT block_no, block_date, line, tracks, from_seq, to_seq, s AS start_min, e AS end_min FROM spans")(lambda s, d: features.block_spans(A.blocks(s, d), A.places(s, d)))
query("feature_rows", TARGETS + """, g AS (SELECT t.*, r.direction, r.train_type, r.line, r.is_ac, r.car_count, r.run_start_min, s.stop_seq - 1 AS point_seq, s.station_seq, s.minutes AS sched_minutes, o.station_seq AS origin_seq, (SELECT max(minutes)
 FROM scheduled_stops x WHERE x.train_id = t.train_id) AS trip,
  t.service_day::TIMESTAMP + to_minutes(r.run_start_min + s.minutes) AS sched_time, p.prior_delay, p.prior_sched, p.prior_point, coalesce(p.prior_seq, o.station_seq) AS our_seq, st.state_batch
 FROM targets t JOIN trains r USING (train_id) JOIN scheduled_stops s ON s.train_id = t.train_id AND s.station_code = t.station_code
 JOIN scheduled_stops o ON o.train_id = t.train_id AND o.stop_seq = 1 LEFT JOIN prior p USING (id, cutoff_id) LEFT
 JOIN state st USING (id, cutoff_id)),
ahead AS (SELECT g.id, g.cutoff_id, arg_min(a.delay_minutes, (abs(a.station_seq - g.our_seq), a.id)) AS ahead_delay, min(abs(a.station_seq - g.our_seq)) AS ahead_gap
 FROM g JOIN clean_obs a ON a.batch_id = g.state_batch AND a.direction = g.direction AND a.line = g.line AND a.train_type = g.train_type
 AND a.train_id <> g.train_id
  AND CASE WHEN g.direction = 'down' THEN a.station_seq > g.our_seq ELSE a.station_seq < g.our_seq END GROUP BY ALL)
SELECT g.id, g.cutoff_id, g.train_id, g.station_code, g.service_day, g.label, g.sched_minutes / trip AS progress, g.point_seq, (train_type = 'fast')::INTEGER AS is_fast, is_ac::INTEGER AS is_ac, car_count, (g.direction = 'up')::INTEGER AS is_up, hour(sched_time) AS hour, isodow(g.service_day) - 1 AS weekday, month(g.service_day) AS month,
 (isodow(g.service_day) = 7 OR strftime(g.service_day, '%m-%d') IN ('01-26', '04-14', '05-01', '08-15', '10-02', '12-25'))::INTEGER AS sunday_schedule, g.sched_minutes, (floor(epoch(sched_time)) - floor(epoch(cutoff))) / 60 AS lead_minutes, (prior_delay IS NOT NULL)::INTEGER AS has_prior, prior_delay, g.sched_minutes - prior_sched AS prior_lead_minutes, g.point_seq - prior_point AS prior_points_back,
 l.line_median AS line_median_delay, l.line_count, a.ahead_delay, a.ahead_gap, f.ld_median AS ld_median_delay, coalesce(f.ld_count, 0) AS ld_count, h.hist_delay, coalesce(h.hist_count, 0) AS hist_count,
 EXISTS (SELECT 1 FROM spans k WHERE k.block_date = g.service_day AND k.line = g.line
 AND (k.tracks IS NULL OR k.tracks = 'both' OR k.tracks = g.train_type)
 AND (from_seq IS NULL OR to_seq IS NULL OR g.station_seq BETWEEN least(from_seq, to_seq) AND greatest(from_seq, to_seq))
  AND (s IS NULL OR e IS NULL OR CASE WHEN s <= e THEN hour(sched_time) * 60 + minute(sched_time) BETWEEN s
 AND e ELSE hour(sched_time) * 60 + minute(sched_time) >= s OR hour(sched_time) * 60 + minute(sched_time) <= e END))::INTEGER AS megablock
FROM g LEFT JOIN batch_line l ON l.batch_id = g.state_batch AND l.line = g.line AND l.direction = g.direction LEFT JOIN ahead a ON a.id = g.id
 AND a.cutoff_id = g.cutoff_id LEFT JOIN batch_far f ON f.batch_id = g.state_batch LEFT JOIN history h ON h.train_id = g.train_id
 AND h.station_code = g.station_code AND h.service_day = g.service_day""")(
    lambda s, d: _feature_rows(s, d, features.training_targets)
)
