"""Queries over texts: status feeds, riders' messages, station names, block notices and announcements.

The SQL never parses the texts: it says what was written into them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import crowd_text, notices, stations, status
from ..session import shared_folder
from ..sources import adapters as A
from ..sources import files
from .base_sql import BASE, STATION

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


CODES = "['CSMT', 'DR', 'CLA', 'ULNR', 'ABH', 'BUD', 'VILLAGE HALT']"
NAMES = "['CSMT', 'DADAR', 'KURLA', 'ULHAS NAGAR', 'AMBARNATH', 'BADLAPUR', 'VILLAGE HALT']"
FEED = f"""WITH k AS (SELECT event_id AS k, (90000 + event_id % 10000)::VARCHAR AS train_number, event_id // 100 AS poll FROM events),
said AS (SELECT *, k % 8 = 7 AS odd, CASE WHEN k % 3 = 0 AND k % 8 <> 7 THEN k % 14 ELSE 0 END AS ago,
 CASE k % 8 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'rake_at' WHEN 2 THEN 'at' WHEN 3 THEN 'crossed' WHEN 4 THEN 'arriving' WHEN 5 THEN 'between' WHEN 6 THEN 'at' ELSE 'unknown' END AS event,
 CASE WHEN k % 8 IN (0, 7) THEN '' WHEN train_number[1:2] IN ('90', '91', '92', '93', '94') THEN {NAMES}[k % 7 + 1] ELSE {CODES}[k % 7 + 1] END AS station_code,
 CASE WHEN k % 5 <> 0 AND k % 8 NOT IN (0, 7) THEN (k % 47) * (CASE WHEN k % 4 = 1 THEN -1 ELSE 1 END) END::DOUBLE AS delay_minutes, k % 6 = 0
 AND k % 8 <> 7 AS less_accurate FROM k),
feed AS (SELECT poll, train_number, station_code, event, epoch(TIMESTAMP '2024-01-05 00:00:00')::BIGINT + poll * 60 - ago * 60 AS observed_s, delay_minutes, event = 'cancelled' AS cancelled, less_accurate
 FROM said)
"""


@query("parse_status", FEED + "SELECT poll, train_number, station_code, event, observed_s, CASE WHEN event = 'at' THEN observed_s END AS time_s, CASE WHEN event = 'at' THEN 'actual' END AS time_kind, delay_minutes, cancelled, less_accurate FROM feed")
def parse_status(s, d):
    out = status.status_feed(A.status_feed(s, d))
    return out.select("poll", "train_number", "station_code", "event", F.unix_seconds("observed_at").alias("observed_s"), F.unix_seconds("actual_or_expected_time").alias("time_s"), "time_kind", "delay_minutes", "cancelled", "less_accurate")


@query("read_raw_archive", FEED + "SELECT event, count(*) AS readings, sum(delay_minutes) AS delay, min(observed_s) AS first_s FROM feed GROUP BY event")
def read_raw_archive(s, d):
    """The feed's answers written as a compressed archive, read back and parsed."""
    path = shared_folder(s, "archive")
    A.status_feed(s, d).select(F.lit("mobond").alias("source"), "fetched_at", F.lit(200).alias("status_code"), "body").write.option("compression", "gzip").json(path)
    out = status.status_feed(files.read_raw_archive(s, path).select("body", "fetched_at"))
    return out.groupBy("event").agg(F.count("*").alias("readings"), F.sum("delay_minutes").alias("delay"), F.min(F.unix_seconds("observed_at")).alias("first_s"))


CROWD = BASE + """SELECT k AS id, code AS station, t::INTEGER AS minute, CASE WHEN k % 17 = 4 THEN NULL WHEN k % 5 IN (1, 2) THEN 'fast' WHEN k % 5 > 2 THEN 'slow' END AS service,
 CASE WHEN k % 6 < 5 THEN k % 6 + 1 END::INTEGER AS level,
 CASE WHEN k % 4 = 0 THEN to_code END AS destination, CASE k % 8 WHEN 0 THEN true WHEN 1 THEN false END AS ac,
 CASE k % 7 WHEN 0 THEN 15 WHEN 1 THEN 12 END::INTEGER AS cars,
 CASE WHEN k % 9 = 0 THEN true END AS ladies, (k % 10 = 3)::INTEGER + (k % 13 = 5 AND k % 2 = 1 AND contains(name, ' '))::INTEGER AS unknown_words, (k % 17 = 4)::INTEGER AS conflicts
FROM (SELECT o_orderkey AS k, (o_orderkey * 13) % 1440 AS t, p.code, p.name, q.code AS to_code FROM orders JOIN places p ON p.line = 'central'
 AND p.seq = o_custkey % 25 + 1 JOIN places q ON q.line = 'central' AND q.seq = (o_custkey + 7) % 25 + 1)"""


@query("parse_crowd_report", CROWD)
def parse_crowd_report(s, d):
    out = crowd_text.parse_crowd_reports(A.crowd_messages(s, d), "text", stations.directory(A.places(s, d)))
    return out.select("id", *[f"said.{f}" for f in crowd_text.FIELDS], F.size("said.unrecognised").alias("unknown_words"), F.size("said.conflicts").alias("conflicts"))


@query("station_lookup", BASE + "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE code END AS station_code FROM customer JOIN places ON line = 'central' AND seq = c_custkey % 25 + 1")
def station_lookup(s, d):
    at = A.places(s, d).filter("line = 'central'").select("code", "name", (F.col("seq") - 1).alias("n"))
    c = A._read(s, d, "customer").selectExpr("c_custkey AS id", "c_custkey % 25 AS n").join(at, "n")
    text = F.expr("CASE id % 5 WHEN 0 THEN code WHEN 1 THEN lower(code) WHEN 2 THEN initcap(name) WHEN 3 THEN concat(' ', replace(lower(name), ' ', '-'), '.') ELSE concat(name, ' x') END")
    return stations.station_lookup(c.select("id", text.alias("text")), "text", stations.directory(A.places(s, d))).select("id", "station_code")


@query("station_suggest")
def station_suggest(s, d):
    """Station names with a letter missing: the station itself must come among the suggestions. Likeness has no SQL; tests hold it against the standard library."""
    typo = A.places(s, d).select("code", F.expr("concat(substr(name, 1, 2), substr(name, 4))").alias("text"))
    found = stations.station_suggest(typo, "text", stations.directory(A.places(s, d)))
    return typo.join(found, "text").select("code", "text", F.array_contains("suggestions", F.col("code")).alias("found")).distinct()


NAMED = BASE + """, x AS (SELECT o.id, CASE WHEN o.id % 7 = 0 THEN '92001' ELSE train_number END AS number, o.station_code AS code, translate(p.name, '0123456789', 'ABCDEFGHIJ') AS name
 FROM observations o JOIN places p ON p.line = 'central' AND p.code = o.station_code)
SELECT id, CASE WHEN id % 3 = 0 AND number = '92001' THEN lower(name) WHEN id % 3 = 1 THEN 'NOWHERE' ELSE code END AS station_code FROM x"""


@query("rematch_stations", NAMED)
def rematch_stations(s, d):
    """Two thirds of the readings name a station in letters, or one that isn't there."""
    named = A.places(s, d).withColumn("name", F.translate("name", "0123456789", "ABCDEFGHIJ"))
    at = named.filter("line = 'central'").select(F.col("code").alias("station_code"), "name")
    o = A.observations(s, d).join(at, "station_code").withColumn("train_number", F.expr("CASE WHEN id % 7 = 0 THEN '92001' ELSE train_number END"))
    o = o.withColumn("station_code", F.expr("CASE id % 3 WHEN 0 THEN lower(name) WHEN 1 THEN 'NOWHERE' ELSE station_code END"))
    return stations.rematch_stations(o, named).select("id", "station_code")


NOTICES = """WITH n AS (SELECT n_nationkey AS k, DATE '2024-02-01' + n_nationkey::INTEGER AS block_date FROM nation)
SELECT k AS notice, block_date, CASE WHEN k // 4 % 4 = 3 THEN 'harbour' ELSE 'central' END AS line, 'MTN' AS from_station, 'MLND' AS to_station,
 CASE WHEN k % 12 = 11 THEN 300 ELSE (k % 12 + 1) * 3600 + 300 END::INTEGER AS start_s, 57300::INTEGER AS end_s,
 ['fast', 'slow', NULL, NULL][k // 4 % 4 + 1] AS tracks, ['both', 'up', 'down', 'both'][k % 4 + 1] AS direction FROM n
UNION ALL SELECT k, block_date, 'central', 'Halt Road', 'CLA', 83400::INTEGER, ((k % 5) * 3600 + 900)::INTEGER, NULL, 'down' FROM n"""


@query("parse_block_notice", NOTICES)
def parse_block_notice(s, d):
    return notices.parse_block_notice(A.block_notices(s, d)).drop("block_id")


ANNOUNCED = """WITH c AS (SELECT n_nationkey AS k, n_regionkey AS page, n_nationkey % 28 + 1 AS day, [1, 2, 12][n_nationkey % 3 + 1] AS month,
 CASE WHEN n_nationkey % 11 <> 10 THEN make_date(2023, 12, (n_nationkey % 9 + 20)::INTEGER) END AS posted_on,
 [['central'], ['central', 'transharbour'], ['harbour'], [], ['western']][n_nationkey % 5 + 1] AS lines FROM nation
 WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0),
y AS (SELECT *, CASE WHEN make_date(2023, month, day) >= posted_on - 7 THEN make_date(2023, month, day) ELSE make_date(2024, month, day) END AS block_date,
 CASE WHEN posted_on IS NULL THEN 'can''t read when this was posted' WHEN len(lines) = 0 THEN 'no readable line' END AS warning FROM c)
SELECT page, CASE WHEN warning IS NULL THEN block_date END AS block_date, unnest(CASE WHEN warning IS NULL THEN lines ELSE [NULL::VARCHAR] END) AS line, posted_on, warning
 FROM y"""


@query("parse_block_announcements", ANNOUNCED)
def parse_block_announcements(s, d):
    return notices.announced_blocks(notices.announcement_cards(A.announcement_pages(s, d)))


BLOCKS = f"""WITH o AS (SELECT n_nationkey AS k, DATE '2024-03-01' + (n_nationkey % 6)::INTEGER AS block_date,
 CASE WHEN n_nationkey % 2 = 0 THEN 'central' ELSE 'harbour' END AS line FROM nation),
b AS (SELECT 'b' || (k % 20)::VARCHAR AS block_id, k >= 20 AS late, * FROM o),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY late) AS r FROM b) WHERE r = 1),
t AS (SELECT block_id, block_date, line, CASE WHEN k % 5 = 0 THEN {STATION.format('k')} END AS from_station,
 CASE WHEN k % 7 = 0 THEN 3600 END::INTEGER AS start_s FROM one)
SELECT * FROM t WHERE from_station IS NOT NULL OR start_s IS NOT NULL OR NOT EXISTS (SELECT 1 FROM t x WHERE x.block_date = t.block_date
 AND x.line = t.line AND (x.from_station IS NOT NULL OR x.start_s IS NOT NULL))"""


@query("save_blocks", BLOCKS)
def save_blocks(s, d):
    """Stored blocks written as JSON, read back, joined by later ones and listed."""
    k = A._read(s, d, "nation").selectExpr("n_nationkey AS k", "date_add(DATE '2024-03-01', CAST(n_nationkey % 6 AS INT)) AS block_date", "CASE WHEN n_nationkey % 2 = 0 THEN 'central' ELSE 'harbour' END AS line")
    b = k.selectExpr("'b' || CAST(k % 20 AS STRING) AS block_id", "k >= 20 AS late", "block_date", "line", "CASE WHEN k % 5 = 0 THEN 'S' || lpad(CAST(k AS STRING), 2, '0') END AS from_station", "CAST(NULL AS STRING) AS to_station", "CAST(CASE WHEN k % 7 = 0 THEN 3600 END AS INT) AS start_s", "CAST(NULL AS INT) AS end_s", "CAST(NULL AS STRING) AS tracks", "CAST(NULL AS STRING) AS direction", "'manual' AS source", "CAST(NULL AS STRING) AS summary")
    path = shared_folder(s, "blocks")
    files.write_blocks(b.filter("NOT late").drop("late"), path)
    stored = files.read_blocks(s, path)
    return files.list_blocks(files.save_blocks(stored, b.filter("late").select(*stored.columns))).select("block_id", "block_date", "line", "from_station", "start_s")
