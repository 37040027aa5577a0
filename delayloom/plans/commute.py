"""Queries over riders' favourite routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import sunday_schedule
from ..operators import commute
from ..sources import adapters as A
from .base_sql import STATION
from .journeys import HOLIDAYS, LEGS, RUNS_ON

QUERIES, SQL = {}, {}
#: Saturday, five past midnight: messages of two service days are due.
NOW = 19742 * 1440 + 5
GRACE = 180

FAVOURITES = LEGS + f""", fav0 AS (SELECT c_custkey AS k, {STATION.format('c_custkey % 25')} AS a, {STATION.format('(c_custkey * 3 + 5) % 25')} AS b FROM customer),
favourites AS (SELECT k AS user_id, 'home' AS name, a AS from_station, b AS to_station, CASE WHEN k % 11 <> 0 THEN (k * 37) % 1440 END AS usual,
 CASE WHEN k % 4 = 0 THEN 'YYYYYYY' ELSE 'YYYYYNN' END AS weekdays, k % 2 = 0 AS is_default, k % 5 <> 0 AS notify, k % 7 <> 0 AS nudge FROM fav0
 WHERE a <> b
 UNION ALL SELECT k, 'return', b, a, CASE WHEN k % 11 <> 0 THEN (k * 37 + 540) % 1440 END,
 CASE WHEN k % 4 = 0 THEN 'YYYYYYY' ELSE 'YYYYYNN' END, k % 2 <> 0, k % 5 <> 0, k % 7 <> 0 FROM fav0 WHERE a <> b AND k % 3 = 0),
days_ AS (SELECT * FROM (SELECT f.*, {NOW // 1440} + off AS day_no, DATE '1970-01-01' + ({NOW // 1440} + off) AS day FROM favourites f CROSS
 JOIN (VALUES (-1), (0), (1)) AS o(off) WHERE usual IS NOT NULL)
 WHERE substr(weekdays, isodow(day), 1) = 'Y' AND isodow(day) <> 7 AND strftime(day, '%m-%d') NOT IN {HOLIDAYS}),
near0 AS (SELECT f.user_id, f.name, f.day, f.nudge, day_no * 1440 + usual AS wanted, l.train_id, l.days, DATE '1970-01-01' + ((day_no * 1440 + usual - 10) // 1440 + off)::INTEGER AS service_day,
 ((day_no * 1440 + usual - 10) // 1440 + off) * 1440 + run_start_min + o_min AS dep, ((day_no * 1440 + usual - 10) // 1440 + off) * 1440 + run_start_min + d_min AS arr
 FROM days_ f JOIN legs l ON l.origin = f.from_station AND l.destination = f.to_station CROSS JOIN (VALUES (-1), (0), (1)) AS o(off)),
near1 AS (SELECT *, row_number() OVER (PARTITION BY user_id, name, day ORDER BY dep, arr, train_id) AS place FROM near0 WHERE dep >= wanted - 10
 AND {RUNS_ON.format(m='days', d='service_day')}),
usual_trips AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, name, day ORDER BY abs(dep - wanted), place) AS r FROM near1
 WHERE place <= 6 AND abs(dep - wanted) <= 10) WHERE r = 1)
"""


def _days(s, d):
    days = A.favourites(s, d).withColumn("day", F.explode(F.array(*[F.date_from_unix_date(F.lit(NOW // 1440 + o)) for o in (-1, 0, 1)])))
    return days.filter(F.substr("weekdays", F.weekday("day") + 1, F.lit(1)) == "Y").filter(~sunday_schedule(F.col("day")))


QUERIES["usual_trip"] = lambda s, d: commute.usual_trip(_days(s, d), A.scheduled_stops(s, d), A.trains(s, d))
SQL["usual_trip"] = FAVOURITES + "SELECT user_id, name, day, train_id, dep, arr FROM usual_trips"


def due_notifications(s, d):
    sent = A.favourites(s, d).filter("user_id % 10 = 1").select("user_id", F.lit("notify").alias("kind"), "name", F.date_from_unix_date(F.lit(NOW // 1440 - 1)).alias("day"))
    return commute.due_notifications(A.favourites(s, d), sent, A.scheduled_stops(s, d), A.trains(s, d), F.lit(NOW).cast("long"), grace=GRACE)


QUERIES["due_notifications"] = due_notifications
SQL["due_notifications"] = FAVOURITES + f"""SELECT * FROM (SELECT user_id, name, day, 'notify' AS kind, day_no * 1440 + usual - 20 AS moment, NULL::VARCHAR AS train_id FROM days_ WHERE notify
 AND NOT (user_id % 10 = 1 AND day_no = {NOW // 1440 - 1})
 UNION ALL SELECT user_id, name, day, 'nudge', arr + 5, train_id FROM usual_trips WHERE nudge) WHERE moment <= {NOW} AND {NOW} < moment + {GRACE}"""

QUERIES["pick_commute_route"] = lambda s, d: commute.pick_commute_route(A.favourites(s, d), A.favourites(s, d).select("user_id").distinct().withColumn("minute", F.pmod(F.col("user_id") * 97, F.lit(1440)).cast("long")))
SQL["pick_commute_route"] = FAVOURITES + """, main AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY is_default DESC, name) AS r FROM favourites) WHERE r = 1),
both_ AS (SELECT m.user_id, m.name, b.name AS back, m.usual, b.usual AS back_usual, (m.user_id * 97) % 1440 AS minute FROM main m LEFT
 JOIN favourites b ON b.user_id = m.user_id AND b.from_station = m.to_station AND b.to_station = m.from_station)
SELECT user_id, minute::BIGINT AS minute, CASE WHEN back IS NULL THEN name WHEN back_usual < usual THEN
 CASE WHEN minute >= 840 THEN name ELSE back END ELSE CASE WHEN minute >= 840 THEN back ELSE name END END AS name FROM both_"""
