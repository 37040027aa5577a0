"""Queries over requests, reports, models, health and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar, parsing
from ..operators import crowding, evaluation, features, health, journeys, matching, recommend, runs, timetable
from ..session import kept, shared_folder
from ..sources import adapters as A
from ..sources import files
from ..streaming import streams
from .base_sql import BASE
from .readings import FACTS, _clean

QUERIES, SQL = {}, {}
now = lambda: F.lit("2024-01-25 00:00:00").cast("timestamp")
HOLIDAYS = "('01-26', '04-14', '05-01', '08-15', '10-02', '12-25')"
RUNS_ON = "substr({m}, CASE WHEN isodow({d}) = 7 OR strftime({d}, '%m-%d') IN " + HOLIDAYS + " THEN 7 ELSE isodow({d}) END, 1) = 'Y'"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _t(s, d):
    return A.scheduled_stops(s, d), A.trains(s, d)


LEGS = BASE + """, legs AS (SELECT a.train_id, a.station_code AS origin, b.station_code AS destination, a.stop_seq AS o_seq, b.stop_seq AS d_seq, a.minutes AS o_min, b.minutes AS d_min, a.days, t.line, t.direction, t.train_type, t.run_start_min, t.is_ac, t.ac_weekdays_only, t.is_ladies_special, t.car_count
 FROM scheduled_stops a JOIN scheduled_stops b ON a.train_id = b.train_id AND a.stop_seq < b.stop_seq JOIN trains t ON t.train_id = a.train_id),
pairs AS (SELECT DISTINCT origin, destination FROM requests)
"""
NEXT = LEGS + f""", trips0 AS (SELECT r.req_id, r.at_, (floor(epoch(r.at_))::BIGINT + 19800) // 60 AS now, off, l.* FROM requests r JOIN legs l ON l.origin = r.origin
 AND l.destination = r.destination CROSS JOIN (VALUES (-1), (0), (1)) AS o(off)),
trips1 AS (SELECT *, DATE '1970-01-01' + (now // 1440 + off)::INTEGER AS service_day, (now // 1440 + off) * 1440 + run_start_min + o_min AS dep, (now // 1440 + off) * 1440 + run_start_min + d_min AS arr
 FROM trips0),
trips AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY dep, arr, train_id)::INTEGER AS place FROM trips1
 WHERE dep >= now AND {RUNS_ON.format(m='days', d='service_day')}) WHERE place <= 5)
"""
query("next_trains", NEXT + "SELECT req_id, train_id, service_day, dep, arr, place FROM trips")(lambda s, d: journeys.next_trains(A.requests(s, d), *_t(s, d)).select("req_id", "train_id", "service_day", "dep", "arr", "place"))


def next_trips(s, d):
    return journeys.next_trains(A.requests(s, d), *_t(s, d))


query("covering_lines", LEGS + "SELECT DISTINCT origin, destination, line, direction FROM pairs JOIN legs USING (origin, destination)")(lambda s, d: journeys.covering_lines(journeys.pairs_of(A.requests(s, d)), *_t(s, d)))
query("missing_direction", LEGS + "SELECT DISTINCT p.origin, p.destination, l.line FROM pairs p JOIN legs l ON l.origin = p.destination AND l.destination = p.origin WHERE NOT EXISTS (SELECT 1 FROM legs x WHERE x.origin = p.origin AND x.destination = p.destination AND x.line = l.line)")(lambda s, d: journeys.missing_direction(journeys.pairs_of(A.requests(s, d)), *_t(s, d)))
query("interchanges", LEGS + "SELECT DISTINCT p.origin, p.destination, c1.code AS change FROM pairs p JOIN places a ON a.code = p.origin JOIN places b ON b.code = p.destination AND a.line <> b.line JOIN places c1 ON c1.line = a.line JOIN places c2 ON c2.code = c1.code AND c2.line = b.line WHERE c1.code NOT IN (p.origin, p.destination)")(lambda s, d: journeys.interchanges(journeys.pairs_of(A.requests(s, d)), A.places(s, d)))
ONE_CHANGE = f""", inter AS (SELECT DISTINCT p.origin, p.destination, c1.code AS change, (SELECT min(seq) FROM places x WHERE x.code = c1.code) AS along FROM pairs p
 JOIN places a ON a.code = p.origin JOIN places b ON b.code = p.destination AND a.line <> b.line JOIN places c1 ON c1.line = a.line
 JOIN places c2 ON c2.code = c1.code AND c2.line = b.line WHERE c1.code NOT IN (p.origin, p.destination)),
ways AS (SELECT DISTINCT origin AS a, destination AS b, line FROM legs),
lacking AS (SELECT DISTINCT w.b AS a, w.a AS b FROM ways w WHERE NOT EXISTS (SELECT 1 FROM ways x WHERE x.a = w.b AND x.b = w.a AND x.line = w.line)),
avoid AS (SELECT i.* FROM inter i JOIN lacking k ON k.a = i.change AND k.b = i.destination),
turned AS (SELECT DISTINCT i.origin, i.destination FROM inter i JOIN lacking k ON k.a = i.origin AND k.b = i.change),
via AS (SELECT r.req_id, r.origin, r.destination AS goal, i.change, i.along, (floor(epoch(r.at_))::BIGINT + 19800) // 60 AS now FROM requests r
 JOIN inter i USING (origin, destination) WHERE NOT EXISTS (SELECT 1 FROM avoid v WHERE (v.origin, v.destination, v.change) = (r.origin, r.destination, i.change))),
one0 AS (SELECT v.req_id, v.change, v.along, v.goal, v.now, l.*, DATE '1970-01-01' + (v.now // 1440 + off)::INTEGER AS service_day, (v.now // 1440 + off) * 1440 + run_start_min + o_min AS dep, (v.now // 1440 + off) * 1440 + run_start_min + d_min AS arr
 FROM via v JOIN legs l ON l.origin = v.origin AND l.destination = v.change CROSS JOIN (VALUES (-1), (0), (1)) AS o(off)),
one AS (SELECT p.* RENAME (train_id AS train_1, direction AS way_1, dep AS dep_1, arr AS arr_1)
 FROM (SELECT *, row_number() OVER (PARTITION BY req_id, change ORDER BY dep, arr, train_id) AS place FROM one0 WHERE dep >= now
 AND {RUNS_ON.format(m='days', d='service_day')}) p WHERE place <= 6 AND NOT is_ladies_special AND NOT EXISTS (SELECT 1 FROM avoid v
 JOIN scheduled_stops s ON s.station_code = v.change WHERE v.origin = p.origin AND v.destination = p.goal AND s.train_id = p.train_id AND s.stop_seq > o_seq AND s.stop_seq < d_seq)),
two0 AS (SELECT a.req_id, a.change, a.along, a.origin AS start_, a.goal, a.train_1, a.way_1, a.dep_1, a.arr_1, l.train_id AS train_2, l.direction, l.days, l.is_ladies_special, DATE '1970-01-01' + ((a.arr_1 + 5) // 1440 + off)::INTEGER AS service_day,
 ((a.arr_1 + 5) // 1440 + off) * 1440 + run_start_min_2 + l.o_min AS dep, ((a.arr_1 + 5) // 1440 + off) * 1440 + run_start_min_2 + l.d_min AS arr
 FROM one a JOIN (SELECT *, run_start_min AS run_start_min_2 FROM legs) l ON l.origin = a.change AND l.destination = a.goal CROSS JOIN (VALUES (-1), (0), (1)) AS o(off)),
next3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY req_id, change, train_1, dep_1 ORDER BY dep, arr, train_2) AS place FROM two0
 WHERE dep >= arr_1 + 5 AND {RUNS_ON.format(m='days', d='service_day')}) WHERE place <= 3),
two AS (SELECT * FROM next3 WHERE NOT is_ladies_special AND dep - arr_1 <= 60 QUALIFY row_number() OVER (PARTITION BY req_id, change, train_1, dep_1 ORDER BY place) = 1),
fit AS (SELECT * FROM two t WHERE NOT (way_1 = 'down' AND direction = 'up' AND EXISTS (SELECT 1 FROM turned u WHERE u.origin = t.start_ AND u.destination = t.goal)))
SELECT req_id, arr, dep_1 AS dep, change, train_1, train_2 FROM (SELECT *, row_number() OVER (PARTITION BY req_id
 ORDER BY arr, dep_1 DESC, along, change, arr_1, train_1, train_2) AS r FROM fit) WHERE r = 1"""
query("one_change", LEGS + ONE_CHANGE)(lambda s, d: journeys.one_change(A.requests(s, d), *_t(s, d), A.places(s, d)))
HALF = "NOT (line = 'harbour' AND direction = 'up')"


@query("one_change_half_loaded", LEGS.replace("JOIN trains t ON t.train_id = a.train_id)", f"JOIN trains t ON t.train_id = a.train_id WHERE {HALF})") + ONE_CHANGE)
def one_change_half_loaded(s, d):
    """The same with a timetable of which one direction of a line isn't loaded."""
    return journeys.one_change(A.requests(s, d), A.scheduled_stops(s, d), A.trains(s, d).filter(HALF), A.places(s, d))


query("no_train_reason", LEGS + """SELECT origin, destination, CASE WHEN EXISTS (SELECT 1 FROM legs l WHERE l.origin = p.origin
 AND l.destination = p.destination) THEN 'served' WHEN EXISTS (SELECT 1 FROM legs l WHERE l.origin = p.destination
 AND l.destination = p.origin) THEN 'direction_missing'
 WHEN NOT EXISTS (SELECT 1 FROM places a JOIN places b USING (line) WHERE a.code = p.origin
 AND b.code = p.destination) THEN 'different_lines' ELSE 'no_single_train' END AS reason FROM pairs p""")(lambda s, d: journeys.no_train_reason(journeys.pairs_of(A.requests(s, d)), *_t(s, d), A.places(s, d)))
MATCH = BASE + f""", said AS (SELECT id, reported_at, substr(train_description, 1, 2)::INTEGER * 60 + substr(train_description, 4, 2)::INTEGER AS m,
 CASE WHEN contains(train_description, 'fast') THEN 'fast' ELSE 'slow' END AS said_type, right(train_description, 3) AS station_code, crowd_level, (floor(epoch(reported_at))::BIGINT + 19800) // 60 AS logged
 FROM crowd_reports),
wanted AS (SELECT id, station_code, said_type AS train_type, crowd_level,
 CASE WHEN id % 4 = 0 THEN 'S' || lpad((id % 25)::VARCHAR, 2, '0') END AS destination_code,
 CASE id % 6 WHEN 0 THEN true WHEN 1 THEN false END AS said_ac, CASE id % 7 WHEN 0 THEN 15 WHEN 1 THEN 12 END::INTEGER AS said_cars,
 CASE WHEN id % 9 = 0 THEN true END AS said_ladies, CASE WHEN id % 11 = 0 THEN 'harbour' END AS line, max((logged // 1440 + o) * 1440 + m) AS wanted
 FROM said CROSS JOIN (VALUES (-1), (0), (1)) AS x(o) WHERE (logged // 1440 + o) * 1440 + m <= logged + 60 GROUP BY ALL),
cand0 AS (SELECT w.id, s.train_id, (wanted // 1440 + o) * 1440 + t.run_start_min + s.minutes AS dep, DATE '1970-01-01' + (wanted // 1440 + o)::INTEGER AS day, wanted, s.days, said_ac, t.is_ac, t.ac_weekdays_only
 FROM wanted w JOIN scheduled_stops s ON s.station_code = w.station_code AND s.departure_s IS NOT NULL JOIN trains t ON t.train_id = s.train_id
 AND t.train_type = w.train_type AND t.line = coalesce(w.line, 'central') CROSS JOIN (VALUES (-1), (0), (1)) AS x(o)
 WHERE (destination_code IS NULL OR EXISTS (SELECT 1 FROM scheduled_stops z WHERE z.train_id = s.train_id AND z.station_code = w.destination_code
 AND z.stop_seq > s.stop_seq)) AND (said_cars IS NULL OR (said_cars = 15) = (t.car_count = 15))
 AND coalesce(said_ladies, false) = t.is_ladies_special),
cand AS MATERIALIZED (SELECT id, train_id, dep, abs(dep - wanted) AS gap, greatest(0, 1 - abs(dep - wanted) / 10) AS score FROM cand0
 WHERE abs(dep - wanted) <= 20 AND {RUNS_ON.format(m='days', d='day')} AND (said_ac IS NULL OR said_ac = (is_ac AND NOT (ac_weekdays_only
 AND (isodow(day) >= 6 OR strftime(day, '%m-%d') IN {HOLIDAYS})))))
"""
_wanted = lambda s, d: matching.report_wanted(A.told_reports(s, d))
_matched = lambda s, d: matching.match_reports(matching.best_candidates(_wanted(s, d), *_t(s, d), A.places(s, d)))
query("report_wanted", MATCH + "SELECT * FROM wanted")(_wanted)
query("report_candidates", MATCH + "SELECT * FROM cand")(lambda s, d: matching.report_candidates(_wanted(s, d), *_t(s, d), A.places(s, d)))
query("match_reports", MATCH + """, b AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM cand WINDOW w AS (PARTITION BY id
 ORDER BY score DESC, gap, dep, train_id)), c AS (SELECT *, round_even(score - coalesce(second, 0) / 2, 3) AS confidence FROM b WHERE r = 1)
SELECT id, CASE WHEN confidence >= 0.6 THEN train_id END AS train_id, confidence,
 CASE WHEN confidence >= 0.6 THEN 'matched' WHEN coalesce(second, 0) > 0 THEN 'ambiguous' ELSE 'far' END AS reason FROM c""")(lambda s, d: _matched(s, d))
EVAL = BASE + """, rows_ AS (SELECT id, train_id, station_code, service_day, direction, hour(local_ts) AS hour, isodow(service_day) - 1 AS weekday, delay_minutes AS label
 FROM clean_obs),
split AS (SELECT *, CASE WHEN date_diff('day', service_day, (SELECT max(service_day)
 FROM rows_)) < 7 THEN 'test' WHEN date_diff('day', service_day, (SELECT max(service_day) FROM rows_)) < 14 THEN 'valid' ELSE 'train' END AS split
 FROM rows_),
m0 AS (SELECT quantile_cont(label, 0.5) AS m FROM split WHERE split = 'train'), m1 AS (SELECT train_id, station_code, quantile_cont(label, 0.5) AS m
 FROM split WHERE split = 'train' GROUP BY ALL), m2 AS (SELECT hour, weekday, direction, quantile_cont(label, 0.5) AS m FROM split
 WHERE split = 'train' GROUP BY ALL),
pred AS (SELECT id, s.direction, label, 0.0::DOUBLE AS zero, coalesce(m1.m, m2.m, m0.m) AS train_station, coalesce(m2.m, m0.m) AS hour_weekday
 FROM split s CROSS JOIN m0 LEFT JOIN m1 ON m1.train_id = s.train_id AND m1.station_code = s.station_code LEFT JOIN m2 ON m2.hour = s.hour
 AND m2.weekday = s.weekday AND m2.direction = s.direction WHERE split = 'test'),
long AS (SELECT direction, label, 'zero' AS model, zero AS p FROM pred UNION ALL SELECT direction, label, 'train_station', train_station FROM pred
 UNION ALL SELECT direction, label, 'hour_weekday', hour_weekday FROM pred),
metrics AS (SELECT model, direction, count(*) AS rows, avg(abs(label - p)) AS mae, avg((abs(label - round_even(p, 0)) <= 2)::INTEGER::DOUBLE) AS within_2, avg((abs(label - round_even(p, 0)) <= 5)::INTEGER::DOUBLE) AS within_5,
 avg(CASE WHEN label >= p THEN 0.1 * (label - p) ELSE 0.9 * (p - label) END) AS pinball_10, avg(CASE WHEN label >= p THEN 0.9 * (label - p) ELSE 0.1 * (p - label) END) AS pinball_90
 FROM long GROUP BY GROUPING SETS ((model), (model, direction)))
"""


def _split(s, d):
    return evaluation.time_split(evaluation.label_rows(_clean(s, d)))


def _pred(s, d):
    rows = _split(s, d)
    return evaluation.predict_baselines(rows.filter("split = 'test'"), evaluation.fit_baselines(rows.filter("split = 'train'")))


query("time_split", EVAL + "SELECT split, count(*) AS rows, min(service_day) AS first_day, max(service_day) AS last_day FROM split GROUP BY split")(lambda s, d: _split(s, d).groupBy("split").agg(F.count("*").alias("rows"), F.min("service_day").alias("first_day"), F.max("service_day").alias("last_day")))
query("predict_baselines", EVAL + "SELECT * FROM pred")(_pred)
query("evaluate", EVAL + "SELECT * FROM metrics")(lambda s, d: evaluation.evaluate(_pred(s, d)))
query("readiness_gates", EVAL + """, r AS (SELECT * FROM clean_obs WHERE source <> 'synthetic'), h AS (SELECT count(DISTINCT service_day) AS days, count(*) AS usable, (SELECT max(n)
 FROM (SELECT count(*) AS n FROM r GROUP BY station_code)) AS station, count_if(date_diff('day', service_day, (SELECT max(service_day)
 FROM r)) < 7) AS test FROM r)
SELECT gate, "have"::BIGINT AS "have", need::BIGINT AS need, "have" >= need AS passed FROM (SELECT 'days' AS gate, days AS "have", 28 AS need FROM h
 UNION ALL SELECT 'usable', usable, 5000 FROM h UNION ALL SELECT 'station', station, 300 FROM h UNION ALL SELECT 'test', test, 500 FROM h)""")(lambda s, d: evaluation.readiness_gates(_clean(s, d)))
query("promotion_decision", EVAL + """, o AS (SELECT * FROM metrics WHERE direction IS NULL), b AS (SELECT * FROM o WHERE model <> 'train_station' ORDER BY mae, model LIMIT 1)
SELECT o.mae AS model_mae, b.model AS best_baseline, b.mae AS baseline_mae,
 CASE WHEN o.mae >= b.mae THEN 'not better than the best baseline' ELSE 'promoted' END AS reason, o.mae < b.mae AS promote FROM o CROSS JOIN b
 WHERE o.model = 'train_station'""")(lambda s, d: evaluation.promotion_decision(evaluation.evaluate(_pred(s, d)), "train_station", 0.8))
query("encode_categories", EVAL + ", c AS (SELECT station_code, row_number() OVER (ORDER BY station_code) - 1 AS k FROM (SELECT DISTINCT station_code FROM split WHERE split = 'train')) SELECT id, coalesce(k, -1)::INTEGER AS station_code_code FROM split LEFT JOIN c USING (station_code)")(lambda s, d: evaluation.encode_categories(_split(s, d), _split(s, d).filter("split = 'train'"), ("station_code",)).select("id", "station_code_code"))


CROWD = NEXT + """, scored AS (SELECT *, CASE WHEN direction = 'up' THEN 8 ELSE 17.5 END AS a, CASE WHEN direction = 'up' THEN 11 ELSE 21 END AS b,
 CASE WHEN direction = 'up' THEN 17.5 ELSE 8 END AS oa, CASE WHEN direction = 'up' THEN 21 ELSE 11 END AS ob, (dep % 1440) / 60 AS h,
 isodow(service_day) = 7 OR strftime(service_day, '%m-%d') IN """ + HOLIDAYS + """ AS sunday, o_seq = 1 AS starts_here, is_ac AND NOT (ac_weekdays_only AND isodow(service_day) >= 6) AS ac FROM trips),
ruled AS (SELECT *, CASE WHEN h BETWEEN a AND b THEN 'peak' WHEN h BETWEEN a - 1 AND b + 1 THEN 'shoulder' WHEN h BETWEEN oa
 AND ob THEN 'counter' WHEN h >= 23 OR h <= 5 THEN 'night' ELSE 'off_peak' END AS period FROM scored),
rs AS MATERIALIZED (SELECT *, least(5::DOUBLE, greatest(1::DOUBLE, 2 + CASE period WHEN 'peak' THEN 2 * (CASE WHEN sunday THEN 0.4 ELSE 1 END) WHEN 'shoulder' THEN (CASE WHEN sunday THEN 0.4 ELSE 1 END) WHEN 'counter' THEN 0.5 * (CASE WHEN sunday THEN 0.4 ELSE 1 END) WHEN 'night' THEN -0.5 ELSE 0 END
 + CASE WHEN period = 'peak' AND train_type = 'fast' THEN 0.5 ELSE 0 END + CASE WHEN starts_here THEN -1 ELSE 0 END +
 CASE WHEN car_count = 15 THEN -0.5 ELSE 0 END + CASE WHEN ac THEN -1 ELSE 0 END + CASE WHEN is_ladies_special THEN -0.5 ELSE 0 END)) AS rule_score
 FROM ruled)
"""


def _scored(s, d, requests=None):
    t = journeys.next_trains(requests or A.requests(s, d), *_t(s, d)).withColumn("hour", F.pmod("dep", F.lit(1440)) / 60).withColumn("sunday", calendar.sunday_schedule(F.col("service_day"))).withColumn("starts_here", F.col("o_seq") == 1)
    t = t.withColumn("ac", calendar.runs_ac(F.col("is_ac"), F.col("ac_weekdays_only"), F.col("service_day"))).withColumn("ahead_cancelled", F.lit(False)).withColumn("ahead_delay", F.lit(None).cast("double"))
    return crowding.rule_score(t)


query("crowding_rule_score", CROWD + "SELECT req_id, place, period, round(rule_score, 6) AS rule_score FROM rs")(lambda s, d: _scored(s, d).select("req_id", "place", "period", F.round("rule_score", 6).alias("rule_score")))


SAID = MATCH.removeprefix(BASE) + """, best AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM cand WINDOW w AS (PARTITION BY id
 ORDER BY score DESC, gap, dep, train_id)),
matched AS (SELECT id, train_id FROM best WHERE r = 1 AND round_even(score - coalesce(second, 0) / 2, 3) >= 0.6),
said_of AS MATERIALIZED (SELECT c.station_code, coalesce(t.line, CASE WHEN c.id % 11 = 0 THEN 'harbour' END, 'central') AS line, s.said_type AS train_type, m.train_id, s.m AS minute, c.reported_at, c.crowd_level
 FROM crowd_reports c JOIN said s USING (id) LEFT JOIN matched m USING (id) LEFT JOIN trains t ON t.train_id = m.train_id),
alike AS (SELECT x.req_id, x.train_id, x.service_day, count(*) AS n, sum(crowd_level)::DOUBLE AS total FROM rs x JOIN said_of s ON s.station_code = x.origin
 AND s.line = x.line AND s.train_type = x.train_type AND s.train_id IS DISTINCT FROM x.train_id
 AND least(abs(x.dep % 1440 - s.minute), 1440 - abs(x.dep % 1440 - s.minute)) <= 30 AND s.reported_at BETWEEN x.at_ - INTERVAL 90 DAY AND x.at_
 GROUP BY ALL),
own AS (SELECT x.req_id, x.train_id, x.service_day, count(*) AS n, sum(crowd_level)::DOUBLE AS total FROM rs x JOIN said_of s ON s.station_code = x.origin
 AND s.train_id = x.train_id AND s.reported_at BETWEEN x.at_ - INTERVAL 90 DAY AND x.at_ GROUP BY ALL),
joined AS (SELECT x.*, x.rule_score::DOUBLE AS by_rule, coalesce(a.n, 0) AS similar_n, coalesce(o.n, 0) AS own_n, coalesce(a.total, 0)::DOUBLE AS sa, coalesce(o.total, 0)::DOUBLE AS so,
 CASE WHEN o.n > 0 THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS w FROM rs x LEFT JOIN alike a USING (req_id, train_id, service_day)
 LEFT JOIN own o USING (req_id, train_id, service_day)),
blend AS (SELECT *, own_n + w * similar_n AS n FROM joined),
crowded AS (SELECT *, least(5, greatest(1, ceil(CASE WHEN n > 0 THEN (1 - n / (n + 3)) * by_rule + n / (n + 3) * ((so + w * sa) / n) ELSE by_rule END - 0.5)))::INTEGER AS crowd_score
 FROM blend)
"""


def _said(s, d):
    return crowding.said_reports(A.told_reports(s, d), _matched(s, d), A.trains(s, d), A.places(s, d))


def _crowd_trips(s, d, requests):
    return _scored(s, d, requests).select(F.struct("req_id", "place").alias("key"), F.col("origin").alias("station_code"), "line", "train_type", "train_id", F.pmod("dep", F.lit(1440)).alias("minute"), "at", "rule_score")


@query("crowding_estimate", CROWD + SAID + "SELECT req_id, place, similar_n, own_n, crowd_score FROM crowded")
def crowding_estimate(s, d):
    questions, asked = journeys.asked_once(A.requests(s, d))
    trips, r = kept(_crowd_trips(s, d, questions), "crowd-trips"), kept(_said(s, d), "said")
    out = crowding.crowding_estimate(trips, crowding.similar_reports(trips, r), crowding.train_reports(trips, r))
    return journeys.told_to_all(out.select("key.req_id", "key.place", "similar_n", "own_n", "crowd_score"), asked)


def _options(s, d, answer):
    """``answer`` of the options of each question that requests ask, told to each of them."""
    questions, asked = journeys.asked_once(A.requests(s, d))
    options = recommend.options_for(questions, *_t(s, d), _clean(s, d), A.observations(s, d), reports=kept(_said(s, d), "said"))
    return journeys.told_to_all(answer(options), asked)


query("baseline_predictions", NEXT + """, t AS (SELECT DISTINCT req_id, train_id, service_day, origin FROM trips)
SELECT t.req_id, t.train_id, t.service_day, CASE WHEN count(*) >= 5 THEN quantile_cont(o.delay_minutes, 0.1) ELSE quantile_cont(o.delay_minutes, 0.5) END AS low, quantile_cont(o.delay_minutes, 0.5) AS delay, CASE WHEN count(*) >= 5 THEN quantile_cont(o.delay_minutes, 0.9) ELSE quantile_cont(o.delay_minutes, 0.5) END AS high, count(*) AS n
 FROM t JOIN clean_obs o ON o.train_id = t.train_id AND o.station_code = t.origin AND o.service_day < t.service_day GROUP BY ALL""")(
    lambda s, d: recommend.baseline_predictions(journeys.next_trains(A.requests(s, d), *_t(s, d)).select(F.struct("req_id", "train_id", "service_day").alias("key"), "train_id", F.col("origin").alias("station_code"), "service_day"), _clean(s, d)).select("key.*", "low", "delay", "high", "n")
)
query("cancelled_trains", NEXT + "SELECT DISTINCT req_id, t.train_id FROM trips t JOIN observations o ON o.train_id = t.train_id AND o.cancelled AND o.observed_at <= at_ AND o.observed_at >= at_ - INTERVAL 4 HOUR")(lambda s, d: recommend.cancelled_trains(next_trips(s, d), A.observations(s, d)))
query("live_readings", NEXT + "SELECT t.req_id, t.train_id, t.service_day, arg_max(o.delay_minutes, (o.observed_at, o.id)) AS live_delay FROM trips t JOIN clean_obs o ON o.train_id = t.train_id AND o.service_day = t.service_day AND o.point_seq + 1 <= t.o_seq AND o.observed_at <= t.at_ AND o.observed_at >= t.at_ - INTERVAL 30 MINUTE GROUP BY ALL")(lambda s, d: recommend.live_readings(journeys.next_trains(A.requests(s, d), *_t(s, d)), _clean(s, d)))
RUN_OF = "req_id, train_id, service_day"
OPTIONS = NEXT + f""", missed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY dep, arr, train_id)::INTEGER AS place FROM trips1
 WHERE dep >= now - 45 AND {RUNS_ON.format(m='days', d='service_day')}) WHERE place <= 15 AND dep < now),
seen AS (SELECT *, true AS coming FROM trips UNION ALL SELECT *, false FROM missed),
fresh AS (SELECT * FROM (SELECT e.req_id, e.train_id, e.service_day, arg_max(o.delay_minutes, (o.observed_at, o.id)) AS live_delay FROM seen e
 JOIN clean_obs o ON o.train_id = e.train_id AND o.service_day = e.service_day AND o.point_seq + 1 <= e.o_seq
 AND o.observed_at BETWEEN e.at_ - INTERVAL 30 MINUTE AND e.at_ GROUP BY ALL) WHERE round_even(live_delay, 0) > 0),
sorted_ AS (SELECT e.* EXCLUDE (place), live_delay,
 CASE WHEN coming THEN 2 WHEN dep + round_even(live_delay, 0) >= now THEN 1 ELSE 0 END AS place FROM seen e LEFT JOIN fresh USING ({RUN_OF})),
told AS MATERIALIZED (SELECT * FROM sorted_ WHERE place > 0 UNION ALL SELECT * FROM (SELECT * FROM sorted_ p WHERE place = 0
 AND EXISTS (SELECT 1 FROM sorted_ q WHERE q.req_id = p.req_id AND q.line = p.line AND q.place > 0)
 QUALIFY row_number() OVER (PARTITION BY req_id, line ORDER BY dep DESC, arr DESC, train_id DESC) = 1)),
past AS (SELECT {RUN_OF}, station, median(delay_minutes) AS mid, CASE WHEN count(*) >= 5 THEN quantile_cont(delay_minutes, 0.1) ELSE median(delay_minutes) END AS low,
 CASE WHEN count(*) >= 5 THEN quantile_cont(delay_minutes, 0.9) ELSE median(delay_minutes) END AS high
 FROM (SELECT t.req_id, t.train_id, t.service_day, o.station_code AS station, o.delay_minutes FROM told t JOIN clean_obs o
 ON o.train_id = t.train_id AND o.station_code IN (t.origin, t.destination) AND o.service_day < t.service_day) GROUP BY ALL),
gone AS (SELECT DISTINCT t.req_id, t.train_id, true AS gone FROM told t JOIN observations o ON o.train_id = t.train_id AND o.cancelled
 AND o.observed_at BETWEEN at_ - INTERVAL 4 HOUR AND at_),
ends AS (SELECT t.*, coalesce(gone, false) AS cancelled, EXISTS (SELECT 1 FROM past p WHERE p.req_id = t.req_id) AS informed,
 coalesce(a.mid, 0) AS leave, coalesce(b.mid, 0) AS reach, b.low, b.high FROM told t LEFT JOIN gone USING (req_id, train_id)
 LEFT JOIN past a ON (a.req_id, a.train_id, a.service_day, a.station) = (t.req_id, t.train_id, t.service_day, t.origin)
 LEFT JOIN past b ON (b.req_id, b.train_id, b.service_day, b.station) = (t.req_id, t.train_id, t.service_day, t.destination)),
moved AS (SELECT *, CASE WHEN live_delay IS NULL THEN 0 ELSE greatest(live_delay, 0) - leave END AS shift FROM ends),
late AS (SELECT *, leave + shift AS delay, reach + shift AS arrival_delay, CASE WHEN high > low THEN low + shift END AS arrival_low, CASE WHEN high > low THEN high + shift END AS arrival_high
 FROM moved),
ahead AS (SELECT *, dep + round_even(delay, 0) AS expected_dep, arr + round_even(arrival_delay, 0) AS expected_arr, coalesce(lag(cancelled) OVER w, false) AS ahead_cancelled,
 lag(CASE WHEN informed OR live_delay IS NOT NULL THEN delay END) OVER w AS ahead_delay
 FROM late WINDOW w AS (PARTITION BY req_id, line ORDER BY place, dep, arr, train_id)),
facts AS (SELECT *, CASE WHEN ahead_cancelled THEN 1 WHEN ahead_delay >= 10 THEN 0.5 ELSE 0 END AS extra FROM ahead WHERE place > 0)""" + CROWD.removeprefix(NEXT).replace("FROM trips", "FROM facts").replace("2 + CASE period", "2 + extra + CASE period") + SAID + """, options AS MATERIALIZED (SELECT * FROM crowded)
"""
CHOOSE = OPTIONS + """, running AS (SELECT *, delay >= 15 AS very_late, row_number() OVER (PARTITION BY req_id
 ORDER BY expected_arr, dep, place, arr, train_id) AS k, count(*) OVER (PARTITION BY req_id) AS running_n FROM options WHERE NOT cancelled AND NOT is_ladies_special),
steady AS (SELECT r.req_id, min(r.k) AS k FROM running r JOIN running f ON f.req_id = r.req_id AND f.k = 1 AND f.very_late AND NOT r.very_late
 AND r.expected_arr <= f.expected_arr + 10 GROUP BY r.req_id),
base AS (SELECT r.req_id, r.k, r.expected_arr, r.crowd_score, s.k IS NOT NULL AS swapped FROM running r LEFT JOIN steady s ON s.req_id = r.req_id
 WHERE r.k = coalesce(s.k, 1)),
emptier AS (SELECT r.req_id, arg_min(r.k, (r.crowd_score, r.k)) AS k FROM running r JOIN base b ON b.req_id = r.req_id AND r.k <> b.k
 AND r.expected_arr <= b.expected_arr + 5 AND r.crowd_score <= b.crowd_score - 1 AND NOT r.very_late GROUP BY r.req_id),
pick AS (SELECT r.*, CASE WHEN e.k IS NOT NULL THEN 'crowding' WHEN swapped THEN 'very_late' WHEN running_n = 1 THEN 'only' ELSE 'earliest' END AS rule
 FROM base b LEFT JOIN emptier e ON e.req_id = b.req_id JOIN running r ON r.req_id = b.req_id AND r.k = coalesce(e.k, b.k))
SELECT req_id, train_id, dep, expected_arr, crowd_score, EXISTS (SELECT 1 FROM running x WHERE x.req_id = p.req_id AND x.k <> p.k
 AND x.expected_dep < p.expected_dep) AS wait, rule FROM pick p"""
SHOWN = ["req_id", "train_id", "service_day", "place", "dep", "arr", "delay", "arrival_delay", "arrival_low", "arrival_high", "live_delay", "cancelled", "expected_dep", "expected_arr", "ahead_cancelled", "ahead_delay", "similar_n", "own_n", "crowd_score"]
query("recommend_options", OPTIONS + f"SELECT {', '.join(SHOWN)} FROM options")(lambda s, d: _options(s, d, lambda options: options.select(*SHOWN)))
query("choose", CHOOSE)(lambda s, d: _options(s, d, recommend.choose))
query("source_health", BASE + """SELECT source, count_if(status = 'ok')::BIGINT AS ok, count_if(status = 'partial')::BIGINT AS partial, count_if(status = 'failed')::BIGINT AS failed, count_if(status = 'skipped_disabled')::BIGINT AS skipped_disabled, sum(CASE WHEN status <> 'skipped_disabled' THEN readings ELSE 0 END)::BIGINT AS readings,
 CASE arg_max(status, (started_at, batch_id)) FILTER (status <> 'skipped_disabled') WHEN 'failed' THEN 'down' ELSE 'up' END AS state
 FROM collector_runs GROUP BY source""")(lambda s, d: health.source_health(A.collector_runs(s, d)))
query("outages", BASE + """, i AS (SELECT *, sum((status <> 'failed')::INTEGER) OVER (PARTITION BY source ORDER BY started_at, batch_id) AS island FROM collector_runs
 WHERE status <> 'skipped_disabled')
SELECT source, island::BIGINT AS island, floor(epoch(min(started_at)))::BIGINT AS "first", floor(epoch(max(started_at)))::BIGINT AS "last", count(*) AS runs
 FROM i WHERE status = 'failed' GROUP BY source, island""")(lambda s, d: health.outages(A.collector_runs(s, d)).withColumns({"first": F.unix_seconds("first"), "last": F.unix_seconds("last")}))
query("find_gaps", BASE + """, e AS (SELECT DISTINCT epoch_us(started_at) AS at_, 1 AS edge FROM collector_runs WHERE started_at BETWEEN TIMESTAMP '2024-01-02'
 AND TIMESTAMP '2024-01-25' UNION ALL SELECT epoch_us(TIMESTAMP '2024-01-02'), 0 UNION ALL SELECT epoch_us(TIMESTAMP '2024-01-25'), 2),
g AS (SELECT *, lag(at_) OVER (ORDER BY at_, edge) AS prev, lag(edge) OVER (ORDER BY at_, edge) AS pe FROM e)
SELECT prev // 1000000 AS from_s, at_ // 1000000 AS to_s, greatest(1, CASE WHEN edge = 1
 AND pe = 1 THEN round_even((at_ - prev) / 900000000, 0) - 1 ELSE floor((at_ - prev) / 900000000) END)::BIGINT AS missed FROM g
 WHERE at_ - prev > 1500000000""")(lambda s, d: health.find_gaps(A.collector_runs(s, d).select(F.col("started_at").alias("at")), F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-25").cast("timestamp")))
query("match_counts", BASE + "SELECT source, count(DISTINCT train_number) FILTER (train_id <> train_number) AS matched, count(DISTINCT train_number) FILTER (train_id = train_number) AS unmatched FROM observations WHERE source <> 'synthetic' GROUP BY source")(lambda s, d: health.match_counts(A.observations(s, d), "source"))
query("settle_run_log", BASE + """, c AS (SELECT batch_id, source, count(DISTINCT train_number) FILTER (train_id <> train_number) AS matched, count(DISTINCT train_number) FILTER (train_id = train_number) AS unmatched
 FROM observations WHERE source <> 'synthetic' GROUP BY ALL)
SELECT r.batch_id, r.source, readings, CASE WHEN status = 'partial' AND matched IS NOT NULL THEN 'ok' ELSE status END AS status, matched, unmatched
 FROM collector_runs r LEFT JOIN c USING (batch_id, source)""")(lambda s, d: health.settle_run_log(A.collector_runs(s, d), health.match_counts(A.observations(s, d), "batch_id", "source")).drop("started_at"))
query("backfill_run_log", BASE + """SELECT batch_id, source, count(*) AS readings, floor(epoch(strptime(substr(batch_id, 1, 15), '%Y%m%dT%H%M%S')))::BIGINT AS started_at, 'ok' AS status, true AS backfilled
 FROM observations o
 WHERE NOT EXISTS (SELECT 1 FROM collector_runs r WHERE r.batch_id = o.batch_id AND r.source = o.source AND r.status = 'ok') GROUP BY ALL""")(lambda s, d: health.backfill_run_log(A.observations(s, d), A.collector_runs(s, d).filter("status = 'ok'")).withColumn("started_at", F.unix_seconds("started_at")))
query("health_report", BASE + "SELECT floor((floor((1706140800 - epoch(min(started_at))::BIGINT) / 60)) / 15)::BIGINT AS expected, count(DISTINCT batch_id) AS actual, (SELECT floor((1706140800 - floor(epoch(max(observed_at)))::BIGINT) / 60)::BIGINT FROM observations WHERE source <> 'synthetic') AS age_minutes FROM collector_runs")(lambda s, d: health.health_report(A.collector_runs(s, d), A.observations(s, d), now()))
query("health_between", BASE + """SELECT greatest(0, floor((epoch_us(TIMESTAMP '2024-01-20') - epoch_us(CASE WHEN min(started_at) > TIMESTAMP '2023-12-25' AND min(started_at) <= TIMESTAMP '2024-01-20' THEN min(started_at) ELSE TIMESTAMP '2023-12-25' END)) / 900000000))::BIGINT AS expected,
 count(DISTINCT batch_id) FILTER (started_at BETWEEN TIMESTAMP '2023-12-25' AND TIMESTAMP '2024-01-20') AS actual, floor(epoch(max(started_at) FILTER (started_at <= TIMESTAMP '2024-01-25')))::BIGINT AS last_s,
 (SELECT floor((1706140800 - floor(epoch(max(observed_at)))::BIGINT) / 60)::BIGINT FROM observations WHERE source <> 'synthetic' AND observed_at <= TIMESTAMP '2024-01-25') AS age_minutes FROM collector_runs""")(
    lambda s, d: health.health_between(A.collector_runs(s, d), A.observations(s, d), F.lit("2023-12-25").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"), now())
)


def _alerts_sql(at: int) -> str:
    """Alerts in force at an instant, as the query ``in_{at}``."""
    return f"""t_{at} AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, batch_id DESC) AS r FROM collector_runs
 WHERE status <> 'skipped_disabled' AND epoch(started_at) <= {at}),
b_{at} AS (SELECT source, max(started_at) FILTER (status IN ('ok', 'partial')) AS success, coalesce(min(r) FILTER (status <> 'failed') - 1, count(*)) AS streak
 FROM t_{at} GROUP BY source),
m_{at} AS (SELECT source, avg(readings) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, batch_id DESC) AS a FROM t_{at}
 WHERE status <> 'failed') WHERE a <= 4 GROUP BY source),
s_{at} AS (SELECT * FROM b_{at} LEFT JOIN m_{at} USING (source)),
in_{at} AS (SELECT source, 'quiet' AS alert, streak, mean FROM s_{at} WHERE coalesce({at} - floor(epoch(success)) > 10800, true) UNION ALL
 SELECT source, 'failing', streak, mean FROM s_{at} WHERE streak >= 3 UNION ALL SELECT source, 'thin', streak, mean FROM s_{at} WHERE mean < 10)"""


def _alerts(s, d, at: int):
    moment = F.timestamp_seconds(F.lit(at))
    return health.evaluate_alerts(A.collector_runs(s, d).filter(F.col("started_at") <= moment), moment)


query("evaluate_alerts", BASE + ", " + _alerts_sql(1706140800) + " SELECT * FROM in_1706140800")(lambda s, d: _alerts(s, d, 1706140800))
EARLIER, LATER = 1705708800, 1705737600


@query("decide_alerts", BASE + f""", {_alerts_sql(EARLIER)}, {_alerts_sql(LATER)}, k AS (SELECT source || ':' || alert AS alert_key, 1 AS was, 0 AS is_ FROM in_{EARLIER} UNION ALL SELECT source || ':' || alert, 0, 1 FROM in_{LATER}),
j AS (SELECT alert_key, max(was) AS was, max(is_) AS is_, {LATER} - (CASE WHEN alert_key LIKE 'm%' THEN {LATER - 43200} ELSE {EARLIER} END) >= 43200 AS due FROM k GROUP BY alert_key)
SELECT alert_key, CASE WHEN was = 0 THEN 'ALERT' WHEN is_ = 0 THEN 'RECOVERED' WHEN due THEN 'STILL' ELSE 'NONE' END AS action, is_ = 1 AS active FROM j""")
def decide_alerts(s, d):
    """What is to be said eight hours after a first round of alerts, of which those of one source were sent four hours before it."""
    sent = F.timestamp_seconds(F.when(F.col("source").startswith("m"), LATER - 43200).otherwise(EARLIER))
    state = _alerts(s, d, EARLIER).select(F.concat_ws(":", "source", "alert").alias("alert_key"), F.lit(True).alias("active"), F.timestamp_seconds(F.lit(EARLIER)).alias("first_seen_at"), sent.alias("last_sent_at"))
    return health.decide_alerts(_alerts(s, d, LATER), state, F.timestamp_seconds(F.lit(LATER))).select("alert_key", "action", "active")


query("readiness_counts", BASE + """SELECT 'station' AS grain, station_code AS value, count(*) AS readings, count(*) >= 300 AS covered FROM clean_obs WHERE source <> 'synthetic' GROUP BY 2
 UNION ALL SELECT 'source', source, count(*), NULL FROM clean_obs WHERE source <> 'synthetic' GROUP BY 2""")(lambda s, d: evaluation.readiness_counts(_clean(s, d)))
query("last_collected", BASE + "SELECT floor(epoch(greatest((SELECT max(observed_at) FROM observations WHERE source <> 'synthetic'), (SELECT max(started_at) FROM collector_runs))))::BIGINT AS last_s")(lambda s, d: health.last_collected(A.observations(s, d), A.collector_runs(s, d)))
query("station_pairs", BASE + """, n AS (SELECT t.line, t.direction, s.station_code, lead(s.station_code) OVER (PARTITION BY s.train_id ORDER BY stop_seq) AS nx FROM scheduled_stops s
 JOIN trains t USING (train_id)),
p AS (SELECT line, CASE WHEN direction = 'down' THEN station_code ELSE nx END AS a,
 CASE WHEN direction = 'down' THEN nx ELSE station_code END AS b, count(*) AS trains FROM n WHERE nx IS NOT NULL GROUP BY ALL)
SELECT p.line, p.a, p.b, p.trains, coalesce(q.trains, 0) AS against FROM p LEFT JOIN p q ON q.line = p.line AND q.a = p.b AND q.b = p.a""")(lambda s, d: timetable.station_pairs(*_t(s, d)))
query("station_order", BASE + "SELECT DISTINCT p.line, p.code, p.seq FROM places p JOIN trains t USING (line)")(lambda s, d: timetable.station_order(timetable.station_pairs(*_t(s, d))))
query("timetable_summary", BASE + "SELECT t.line, count(*) AS trains, count_if(is_ac)::BIGINT AS ac, count_if(car_count = 15)::BIGINT AS fifteen_car, count_if(is_ladies_special)::BIGINT AS ladies, count_if(train_type = 'fast')::BIGINT AS fast, any_value(stations) AS stations, any_value(stops) AS stops FROM trains t JOIN (SELECT line, count(DISTINCT station_code) AS stations, count(*) AS stops FROM scheduled_stops s JOIN trains USING (train_id) GROUP BY line) USING (line) GROUP BY t.line")(lambda s, d: timetable.timetable_summary(A.trains(s, d), A.scheduled_stops(s, d)))
query("rematch_trains", BASE + "SELECT id, coalesce(t.train_id, o.train_id) AS train_id FROM observations o LEFT JOIN trains t ON t.number = o.train_number")(lambda s, d: timetable.rematch_trains(A.observations(s, d).withColumn("train_id", F.col("train_number")), A.trains(s, d)).select("id", "train_id"))
query("upsert_timetable", BASE + "SELECT train_id, CASE WHEN is_ac THEN 16 ELSE car_count END AS car_count FROM trains WHERE line = 'central' OR is_ac")(lambda s, d: timetable.upsert_timetable(A.trains(s, d), A.trains(s, d).filter("is_ac").withColumn("car_count", F.lit(16)), "harbour").select("train_id", "car_count"))
query("apply_supplement", BASE + "SELECT number, CASE WHEN is_ac THEN 'fast' ELSE train_type END AS train_type, CASE WHEN NOT is_ac THEN 'missing' WHEN train_type <> 'fast' THEN 'changed' ELSE 'unchanged' END AS change FROM trains")(lambda s, d: timetable.apply_supplement(A.trains(s, d), A.trains(s, d).filter("is_ac").select("number", F.lit("fast").alias("train_type"))).select("number", "train_type", "change"))
query("calendar_days", BASE + """SELECT id, isodow(day) - 1 AS weekday, isodow(day) = 7 OR strftime(day, '%m-%d') IN """ + HOLIDAYS + """ AS sunday, CASE WHEN isodow(day) >= 6 OR strftime(day, '%m-%d') IN """ + HOLIDAYS + """ THEN 'weekend' ELSE 'weekday' END AS kind, (l - INTERVAL 3 HOUR)::DATE AS run_key,
 CASE WHEN hour(l) >= 21 OR hour(l) < 4 THEN 'night' WHEN hour(l) >= 16 THEN 'pm_peak' WHEN hour(l) >= 11 THEN 'midday' WHEN hour(l) >= 7 THEN 'am_peak' ELSE 'early' END AS band
 FROM (SELECT id, observed_at + INTERVAL 330 MINUTE AS l, (observed_at + INTERVAL 330 MINUTE)::DATE AS day FROM observations)""")(
    lambda s, d: A.observations(s, d).withColumn("l", calendar.local_time(F.col("observed_at"))).withColumn("day", F.to_date("l")).select("id", F.weekday("day").alias("weekday"), calendar.sunday_schedule(F.col("day")).alias("sunday"), calendar.day_kind(F.col("day")).alias("kind"), calendar.run_key(F.col("l")).alias("run_key"), calendar.day_band(F.hour("l")).alias("band"))
)
query("parse_delay", BASE + "SELECT id, CASE WHEN delay_minutes >= 0 THEN trunc(delay_minutes) END AS minutes FROM observations")(
    lambda s, d: A.observations(s, d).select("id", parsing.delay_from_text(F.expr("CASE WHEN delay_minutes >= 120 THEN format_string('%02d:%02d Hrs.', CAST(delay_minutes AS INT) div 60, CAST(delay_minutes AS INT) % 60) WHEN delay_minutes >= 1 THEN CAST(CAST(delay_minutes AS INT) AS STRING) || ' Mins.' WHEN delay_minutes >= 0 THEN 'On Time' ELSE 'early' END")).alias("minutes"))
)
query("nearest_clock", BASE + "SELECT id, floor(epoch(date_trunc('minute', actual_or_expected_time)))::BIGINT AS at_s FROM observations")(lambda s, d: A.observations(s, d).select("id", F.unix_seconds(parsing.nearest_clock(F.date_format(calendar.local_time(F.col("actual_or_expected_time")), "HH:mm"), F.col("observed_at"))).alias("at_s")))


@query("monthly_export", BASE + "SELECT strftime(observed_at, '%Y-%m') AS month, count(*) AS rows FROM (SELECT DISTINCT * EXCLUDE (id) FROM observations_dup WHERE source <> 'synthetic') GROUP BY 1")
def monthly_export(s, d):
    path = shared_folder(s, "export")
    files.export_monthly(A.repeated_observations(s, d), path)
    return s.read.parquet(path).groupBy(F.col("month").cast("string").alias("month")).agg(F.count("*").alias("rows"))


query("monthly_counts", BASE + """SELECT month, count(*) AS rows, any_value(n) - count(*) AS duplicates FROM (SELECT DISTINCT * EXCLUDE (id), strftime(observed_at, '%Y-%m') AS month
 FROM observations_dup WHERE source <> 'synthetic') JOIN (SELECT strftime(observed_at, '%Y-%m') AS month, count(*) AS n FROM observations_dup
 WHERE source <> 'synthetic' GROUP BY 1) USING (month) GROUP BY month""")(lambda s, d: files.monthly_counts(A.repeated_observations(s, d)))
query("load_new_batches", BASE + "SELECT id FROM observations_dup o WHERE NOT EXISTS (SELECT 1 FROM observations x WHERE x.source <> 'ntes' AND x.batch_id = o.batch_id)")(lambda s, d: files.load_new_batches(A.observations(s, d).filter("source <> 'ntes'"), A.repeated_observations(s, d)).select("id"))
query("same_rows_copy", BASE + "SELECT 0::BIGINT AS only_a, 0::BIGINT AS only_b, count(*) >= 0 AS same FROM observations_dup")(lambda s, d: files.same_rows(A.repeated_observations(s, d), A.repeated_observations(s, d).repartition(7)))
query("same_rows", BASE + "SELECT 0::BIGINT AS only_a, (SELECT count(*) FROM observations_dup) - (SELECT count(*) FROM observations) AS only_b, false AS same")(lambda s, d: files.same_rows(A.observations(s, d), A.repeated_observations(s, d)))


def _stream(s, d, build, mode):
    """Write the readings as files, run a stream over them to the end, and read what it wrote."""
    source, out = shared_folder(s, "stream-in"), shared_folder(s, "stream-out")
    A.repeated_observations(s, d).withColumn("time_kind", F.lit(None).cast("string")).repartitionByRange(4, "observed_at").write.parquet(source)
    q = build(streams.read_stream(s, source)).writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", shared_folder(s, "stream-checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(out)


query("stream_dedup", BASE + "SELECT count(*) AS rows, sum(delay_minutes) AS delay FROM (SELECT DISTINCT source, train_number, station_code, event, observed_at, delay_minutes, cancelled FROM observations_dup)")(lambda s, d: _stream(s, d, lambda df: streams.stream_dedup(df, "60 days"), "append").agg(F.count("*").alias("rows"), F.sum("delay_minutes").alias("delay")))
query("stream_line_state", BASE + """, k AS (SELECT o.*, t.line, t.direction FROM (SELECT * FROM observations_dup WHERE delay_minutes IS NOT NULL AND NOT cancelled) o
 JOIN trains t USING (train_id)), w AS (SELECT max(observed_at) - INTERVAL 20 MINUTE AS mark FROM observations_dup WHERE delay_minutes IS NOT NULL
 AND NOT cancelled),
g AS (SELECT epoch_us(observed_at) // 900000000 * 900 AS start_s, line, direction, count(*) AS readings, avg(delay_minutes) AS mean_delay, quantile_disc(delay_minutes, 0.5) AS median_delay
 FROM k GROUP BY ALL)
SELECT * FROM g WHERE (start_s + 900) * 1000000 <= (SELECT epoch_us(mark) FROM w)""")(lambda s, d: _stream(s, d, lambda df: streams.stream_line_state(df, A.trains(s, d)), "append").select(F.unix_seconds("start").alias("start_s"), "line", "direction", "readings", "mean_delay", "median_delay"))


@query("stream_batches", BASE + "SELECT count(*) AS rows, count(DISTINCT batch_id) AS batches FROM observations_dup")
def stream_batches(s, d):
    source, out, mark = shared_folder(s, "load-in"), shared_folder(s, "load-out"), shared_folder(s, "load-checkpoint")
    rows = A.repeated_observations(s, d).withColumn("time_kind", F.lit(None).cast("string"))
    rows.write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        streams.stream_batches(s, source, out, mark).awaitTermination()
    return streams.read_loaded(s, out).agg(F.count("*").alias("rows"), F.countDistinct("batch_id").alias("batches"))


@query("stream_alerts", BASE + """, r AS (SELECT source, epoch_us(started_at) // 1000 AS at_, status <> 'failed' AS good, row_number() OVER w AS k FROM collector_runs WHERE status <> 'skipped_disabled'
 WINDOW w AS (PARTITION BY source ORDER BY started_at)),
mark AS (SELECT max(epoch_us(started_at) // 1000) - 1200000 AS mark FROM collector_runs),
calm AS (SELECT source, at_ FROM r WHERE good OR k = 1),
silent AS (SELECT source, 'quiet' AS alert, at_ + 10800000 AS a, (SELECT min(g.at_) FROM r g WHERE g.source = calm.source AND g.good AND g.at_ > calm.at_) AS b FROM calm),
islands AS (SELECT *, k - row_number() OVER (PARTITION BY source, good ORDER BY k) AS island FROM r),
broken AS (SELECT source, 'failing' AS alert, list(at_ ORDER BY k)[3] AS a, (SELECT min(g.at_) FROM r g WHERE g.source = i.source AND g.good AND g.at_ > max(i.at_)) AS b
 FROM islands i WHERE NOT good GROUP BY source, island HAVING count(*) >= 3),
spells AS (SELECT source, alert, a, coalesce(b, mark + 1) AS b, least(coalesce(b, mark), mark) AS upto, mark FROM (SELECT * FROM silent UNION ALL SELECT * FROM broken) CROSS JOIN mark),
held AS (SELECT * FROM spells WHERE a < upto)
SELECT source, alert, (a + n * 43200000) // 1000 AS at_s, CASE WHEN n = 0 THEN 'ALERT' ELSE 'STILL' END AS action FROM held, unnest(range(0, 1 + (upto - a - 1) // 43200000)) AS x(n)
UNION ALL SELECT source, alert, b // 1000, 'RECOVERED' FROM held WHERE b < mark""")
def stream_alerts(s, d):
    source, out = shared_folder(s, "runs-in"), shared_folder(s, "alerts-out")
    told = kept(A.collector_runs(s, d), "runs")
    for k in range(4):  # written one after the other, so the stream reads them in this order
        told.filter(F.least(F.floor(F.dayofyear("started_at") / 8), F.lit(3)) == k).coalesce(1).write.parquet(f"{source}/{k}")
    with streams.state_in_rocksdb(s):
        runs = s.readStream.schema("batch_id string, source string, started_at timestamp, readings long, status string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
        q = streams.stream_alerts(runs).writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_folder(s, "alerts-checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination()
    return s.read.schema("source string, alert string, at_s long, action string").parquet(out)
