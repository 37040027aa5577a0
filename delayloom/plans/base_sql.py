"""The adapter tables as DuckDB common table expressions; oracles start with them."""

STATION = "'S' || lpad(({0})::VARCHAR, 2, '0')"

BASE = f"""WITH trains AS (
 SELECT CASE WHEN s_suppkey % 6 = 5 THEN 'harbour' ELSE 'central' END || '-' || (95000 + s_suppkey)::VARCHAR AS train_id, (95000 + s_suppkey)::VARCHAR AS number,
  CASE WHEN s_suppkey % 6 = 5 THEN 'harbour' ELSE 'central' END AS line, CASE WHEN s_suppkey % 2 = 0 THEN 'up' ELSE 'down' END AS direction,
  CASE WHEN s_suppkey % 3 = 0 THEN 'fast' ELSE 'slow' END AS train_type, ((240 + s_suppkey * 67) % 1440)::INTEGER AS run_start_min,
  s_suppkey % 4 = 0 AS is_ac, s_suppkey % 8 = 0 AS ac_weekdays_only, s_suppkey % 20 = 7 AS is_ladies_special,
 CASE WHEN s_suppkey % 5 = 0 THEN 15 ELSE 12 END AS car_count,
  CASE WHEN s_suppkey % 7 = 6 THEN 'NNNNNNY' WHEN s_suppkey % 7 = 5 THEN 'YYYYYNN' ELSE 'YYYYYYY' END AS days FROM supplier),
places AS (
 SELECT {STATION.format('n_nationkey')} AS code, n_name AS name, 'central' AS line, row_number() OVER (ORDER BY n_nationkey)::INTEGER AS seq
 FROM nation
 UNION ALL SELECT {STATION.format('n_nationkey')}, n_name, 'harbour', row_number() OVER (ORDER BY n_nationkey)::INTEGER FROM nation
 WHERE n_regionkey < 2),
stops0 AS (
 SELECT t.*, p.code, p.seq, 4 * CASE WHEN direction = 'down' THEN seq - 1 ELSE (SELECT max(seq) FROM places x
 WHERE x.line = t.line) - seq END AS minutes
 FROM trains t JOIN places p USING (line) WHERE NOT (line = 'central' AND train_type = 'fast' AND seq % 3 = 2)),
stops1 AS (SELECT *, row_number() OVER (PARTITION BY train_id ORDER BY minutes)::INTEGER AS stop_seq, count(*) OVER (PARTITION BY train_id) AS stops
 FROM stops0),
scheduled_stops AS (
 SELECT train_id, code AS station_code, stop_seq, seq AS station_seq, minutes,
 CASE WHEN stop_seq > 1 THEN ((run_start_min + minutes) % 1440) * 60 END AS arrival_s,
  CASE WHEN stop_seq < stops THEN ((run_start_min + minutes) % 1440) * 60 END AS departure_s, days FROM stops1),
obs0 AS (
 SELECT *, user_id // 5 AS k, CASE event_type WHEN 'click' THEN 'arrival' WHEN 'purchase' THEN 'arrival' WHEN 'view' THEN 'departure' WHEN 'signup' THEN 'between' ELSE
 CASE WHEN event_id % 5 = 0 THEN 'cancelled' ELSE 'unknown' END END AS event,
  CASE WHEN user_id % 5 = 4 THEN '11' || lpad((user_id // 5)::VARCHAR, 4, '0') ELSE (95000 + user_id // 5)::VARCHAR END AS number FROM events),
observations AS (
 SELECT event_id AS id, ts AS observed_at,
 CASE WHEN user_id % 5 = 4 THEN number WHEN k % 6 = 5 THEN 'harbour-' || number ELSE 'central-' || number END AS train_id, number AS train_number,
  {STATION.format('(k * 7 + event_id % 2) % 25')} AS station_code, event, event = 'cancelled' AS cancelled,
  CASE WHEN event <> 'cancelled' THEN floor(value / 6) - 3 + CASE WHEN event_id % 11 = 0 THEN 0.5::DOUBLE ELSE 0 END END::DOUBLE AS delay_minutes,
  ts + to_minutes(event_id % 61 - 20) AS actual_or_expected_time,
 CASE WHEN event_id % 97 = 0 THEN 'synthetic' WHEN event_id % 10 = 0 THEN 'mobond' ELSE 'ntes' END AS source, event_id % 3 = 0 AS less_accurate,
  strftime(make_timestamp((epoch_us(ts) // 900000000) * 900000000), '%Y%m%dT%H%M%SZ') || '-00000' || (event_id % 2)::VARCHAR AS batch_id FROM obs0),
observations_dup AS (
 SELECT * FROM observations UNION ALL SELECT * REPLACE (id + 10000000 AS id) FROM observations WHERE id % 50 = 0
 UNION ALL SELECT * REPLACE (id + 20000000 AS id, observed_at + INTERVAL 2 MINUTE AS observed_at, '20240101T000000Z-late00' AS batch_id)
 FROM observations WHERE id % 53 = 0
 UNION ALL SELECT * REPLACE (id + 30000000 AS id, ((id + 30000000) % 7 - 2) * 100::DOUBLE AS delay_minutes, observed_at + INTERVAL 1 MINUTE AS observed_at)
 FROM observations WHERE id % 61 = 0),
rep0 AS (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_minutes((o_orderkey * 37) % 43200) AS at_ FROM orders),
crowd_reports AS (
 SELECT o_orderkey AS id, at_ AS reported_at, {STATION.format('o_custkey % 25')} AS station_code,
  strftime(at_ + INTERVAL 330 MINUTE - to_minutes(o_orderkey % 9), '%H:%M') ||
 CASE WHEN o_orderkey % 3 = 0 THEN ' fast' ELSE ' slow' END || ' from ' || {STATION.format('o_custkey % 25')} AS train_description,
  (1 + o_orderkey % 5)::INTEGER AS crowd_level, 'rider' || o_custkey::VARCHAR AS source FROM rep0),
requests AS (
 SELECT * FROM (SELECT c_custkey AS req_id, {STATION.format('c_custkey % 25')} AS origin, {STATION.format('(c_custkey * 3 + 5) % 25')} AS destination, TIMESTAMP '2024-01-10 00:00:00' + to_minutes((c_custkey * 61) % 2880) AS at_
 FROM customer) WHERE origin <> destination),
blocks AS (
 SELECT n_nationkey AS block_no, DATE '2024-01-01' + (n_nationkey % 30)::INTEGER AS block_date,
 CASE WHEN n_nationkey % 3 = 0 THEN 'harbour' ELSE 'central' END AS line,
  {STATION.format('n_nationkey % 10')} AS from_station, {STATION.format('n_nationkey % 10 + 8')} AS to_station,
 CASE WHEN n_nationkey % 5 <> 0 THEN (n_nationkey * 53) % 1440 END AS start_min,
  CASE WHEN n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 0 THEN (n_nationkey * 53 + 300) % 1440 END AS end_min,
 CASE WHEN n_nationkey % 4 = 0 THEN 'fast' WHEN n_nationkey % 4 = 1 THEN 'slow' WHEN n_nationkey % 4 = 2 THEN 'both' END AS tracks FROM nation),
collector_runs AS (
 SELECT batch_id, source, started_at, readings,
 CASE WHEN substr(batch_id, 10, 4)::INTEGER % 7 = 0 THEN 'failed' WHEN readings % 5 = 0 THEN 'partial' WHEN substr(batch_id, 10, 4)::INTEGER % 11 = 0 THEN 'skipped_disabled' ELSE 'ok' END AS status
 FROM (SELECT batch_id, source, count(*) AS readings, min(observed_at) AS started_at FROM observations GROUP BY ALL)),
final_runs AS (
 SELECT * FROM (SELECT train_id, station_code, run_key, arg_max(delay_minutes, (observed_at, id)) AS d_final, max(observed_at) AS last_seen, arg_max(scheduled, (observed_at, id)) AS scheduled, arg_max(due, (observed_at, id)) AS due
 FROM (
  SELECT o.*, actual_or_expected_time - to_minutes(round_even(delay_minutes, 0)::BIGINT) AS scheduled, actual_or_expected_time AS due, (actual_or_expected_time - to_minutes(round_even(delay_minutes, 0)::BIGINT) + INTERVAL 330 MINUTE - INTERVAL 3 HOUR)::DATE AS run_key
  FROM observations o SEMI JOIN trains USING (train_id) WHERE source <> 'synthetic' AND event IN ('arrival', 'departure') AND NOT cancelled
 AND delay_minutes IS NOT NULL) GROUP BY ALL)
 WHERE abs(epoch_us(last_seen) - epoch_us(due)) <= 900000000),
clean_obs AS (
 SELECT *, (local_ts - to_minutes(CASE WHEN since > 720 THEN since - 1440 ELSE since END))::DATE AS service_day FROM (
  SELECT o.id, o.observed_at, o.train_id, o.station_code, o.delay_minutes, o.batch_id, o.source, o.observed_at + INTERVAL 330 MINUTE AS local_ts, t.run_start_min, t.direction, t.train_type, t.line, t.is_ac, t.car_count,
   p.stop_seq - 1 AS point_seq, p.station_seq, p.minutes AS sched_minutes, (((hour(o.observed_at + INTERVAL 330 MINUTE) * 60 + minute(o.observed_at + INTERVAL 330 MINUTE) - t.run_start_min) % 1440) + 1440) % 1440 AS since
  FROM observations o JOIN trains t USING (train_id) JOIN scheduled_stops p ON p.train_id = o.train_id AND p.station_code = o.station_code
  WHERE o.delay_minutes IS NOT NULL AND NOT o.cancelled AND o.event NOT IN ('cancelled', 'rake_at', 'unknown')))
"""
