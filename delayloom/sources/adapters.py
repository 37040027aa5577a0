"""Transport tables derived from the star schema: every row of the source table becomes a row here.

Two tables leave rows out by what they mean: requests and favourite routes need
two ends, so customers whose two stations are the same have none; and the second
line of ``places`` runs through the nations of two regions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "supplier").selectExpr(
        "CASE WHEN s_suppkey % 6 = 5 THEN 'harbour' ELSE 'central' END || '-' || CAST(95000 + s_suppkey AS STRING) AS train_id",
        "CAST(95000 + s_suppkey AS STRING) AS number",
        "CASE WHEN s_suppkey % 6 = 5 THEN 'harbour' ELSE 'central' END AS line",
        "CASE WHEN s_suppkey % 2 = 0 THEN 'up' ELSE 'down' END AS direction",
        "CASE WHEN s_suppkey % 3 = 0 THEN 'fast' ELSE 'slow' END AS train_type",
        "CAST((240 + s_suppkey * 67) % 1440 AS INT) AS run_start_min",
        "s_suppkey % 4 = 0 AS is_ac", "s_suppkey % 8 = 0 AS ac_weekdays_only", "s_suppkey % 20 = 7 AS is_ladies_special",
        "CASE WHEN s_suppkey % 5 = 0 THEN 15 ELSE 12 END AS car_count",
        "CASE WHEN s_suppkey % 7 = 6 THEN 'NNNNNNY' WHEN s_suppkey % 7 = 5 THEN 'YYYYYNN' ELSE 'YYYYYYY' END AS days",
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations of each line in order; the second line has the nations of the first two regions."""
    nation = _read(spark, sf_dir, "nation").selectExpr("'S' || lpad(CAST(n_nationkey AS STRING), 2, '0') AS code", "n_name AS name", "n_nationkey", "n_regionkey")
    place = lambda df, line: df.select("code", "name", F.lit(line).alias("line"), F.row_number().over(Window.orderBy("n_nationkey")).alias("seq"))
    return place(nation, "central").unionByName(place(nation.filter("n_regionkey < 2"), "harbour"))


def scheduled_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops of every train: four minutes a station, fast trains of the first line pass every third one."""
    at = places(spark, sf_dir).withColumn("last", F.max("seq").over(Window.partitionBy("line")))
    rows = trains(spark, sf_dir).join(at, "line").withColumn("minutes", F.expr("4 * CASE WHEN direction = 'down' THEN seq - 1 ELSE last - seq END"))
    rows = rows.filter("NOT (line = 'central' AND train_type = 'fast' AND seq % 3 = 2)")
    order = Window.partitionBy("train_id").orderBy("minutes")
    rows = rows.withColumn("stop_seq", F.row_number().over(order)).withColumn("stops", F.count("*").over(Window.partitionBy("train_id")))
    clock = "((run_start_min + minutes) % 1440) * 60"
    return rows.selectExpr("train_id", "code AS station_code", "stop_seq", "seq AS station_seq", "minutes", f"CASE WHEN stop_seq > 1 THEN {clock} END AS arrival_s", f"CASE WHEN stop_seq < stops THEN {clock} END AS departure_s", "days")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of trains: one per event; a fifth of the trains is unknown to the timetable."""
    e = _read(spark, sf_dir, "events").withColumn("k", F.expr("user_id div 5")).withColumn("at", F.col("ts").cast("timestamp"))
    e = e.withColumn("event", F.expr("CASE event_type WHEN 'click' THEN 'arrival' WHEN 'purchase' THEN 'arrival' WHEN 'view' THEN 'departure' WHEN 'signup' THEN 'between' ELSE CASE WHEN event_id % 5 = 0 THEN 'cancelled' ELSE 'unknown' END END"))
    e = e.withColumn("number", F.expr("CASE WHEN user_id % 5 = 4 THEN '11' || lpad(CAST(k AS STRING), 4, '0') ELSE CAST(95000 + k AS STRING) END"))
    e = e.withColumn("slot", F.expr("timestamp_seconds(unix_seconds(at) - unix_seconds(at) % 900)"))
    return e.selectExpr(
        "event_id AS id", "at AS observed_at",
        "CASE WHEN user_id % 5 = 4 THEN number WHEN k % 6 = 5 THEN 'harbour-' || number ELSE 'central-' || number END AS train_id",
        "number AS train_number", "'S' || lpad(CAST((k * 7 + event_id % 2) % 25 AS STRING), 2, '0') AS station_code", "event",
        "event = 'cancelled' AS cancelled",
        "CASE WHEN event <> 'cancelled' THEN floor(value / 6) - 3 + CASE WHEN event_id % 11 = 0 THEN 0.5D ELSE 0D END END AS delay_minutes",
        "at + make_dt_interval(0, 0, CAST(event_id % 61 - 20 AS INT), 0) AS actual_or_expected_time",
        "CASE WHEN event_id % 97 = 0 THEN 'synthetic' WHEN event_id % 10 = 0 THEN 'mobond' ELSE 'ntes' END AS source",
        "event_id % 3 = 0 AS less_accurate",
        "date_format(slot, \"yyyyMMdd'T'HHmmss'Z'\") || '-00000' || CAST(event_id % 2 AS STRING) AS batch_id",
    )


def repeated_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings together with exact repeats of some, near repeats of others, and some with wild delays, for the quality flags."""
    o = observations(spark, sf_dir)
    exact = o.filter("id % 50 = 0").withColumn("id", F.col("id") + 10_000_000)
    near = o.filter("id % 53 = 0").withColumn("id", F.col("id") + 20_000_000).withColumn("observed_at", F.col("observed_at") + F.expr("INTERVAL 2 MINUTES")).withColumn("batch_id", F.lit("20240101T000000Z-late00"))
    wild = o.filter("id % 61 = 0").withColumn("id", F.col("id") + 30_000_000).withColumn("delay_minutes", F.expr("CAST((id % 7 - 2) * 100 AS DOUBLE)")).withColumn("observed_at", F.col("observed_at") + F.expr("INTERVAL 1 MINUTE"))
    return o.unionByName(exact).unionByName(near).unionByName(wild)


def crowd_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Riders' reports: one per order."""
    o = _read(spark, sf_dir, "orders").withColumn("at", F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST((o_orderkey * 37) % 43200 AS INT), 0)"))
    return o.selectExpr(
        "o_orderkey AS id", "at AS reported_at", "'S' || lpad(CAST(o_custkey % 25 AS STRING), 2, '0') AS station_code",
        "date_format(at + INTERVAL 330 MINUTES - make_dt_interval(0, 0, CAST(o_orderkey % 9 AS INT), 0), 'HH:mm') || CASE WHEN o_orderkey % 3 = 0 THEN ' fast' ELSE ' slow' END || ' from S' || lpad(CAST(o_custkey % 25 AS STRING), 2, '0') AS train_description",
        "CAST(1 + o_orderkey % 5 AS INT) AS crowd_level", "'rider' || CAST(o_custkey AS STRING) AS source",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journey requests: one per customer whose ends differ."""
    c = _read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS req_id", "'S' || lpad(CAST(c_custkey % 25 AS STRING), 2, '0') AS origin", "'S' || lpad(CAST((c_custkey * 3 + 5) % 25 AS STRING), 2, '0') AS destination",
        "TIMESTAMP '2024-01-10 00:00:00' + make_dt_interval(0, 0, CAST((c_custkey * 61) % 2880 AS INT), 0) AS at",
    )
    return c.filter("origin <> destination")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engineering blocks of one month: one per nation."""
    return _read(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS block_no", "date_add(DATE '2024-01-01', CAST(n_nationkey % 30 AS INT)) AS block_date", "CASE WHEN n_nationkey % 3 = 0 THEN 'harbour' ELSE 'central' END AS line",
        "'S' || lpad(CAST(n_nationkey % 10 AS STRING), 2, '0') AS from_station", "'S' || lpad(CAST(n_nationkey % 10 + 8 AS STRING), 2, '0') AS to_station",
        "CASE WHEN n_nationkey % 5 <> 0 THEN (n_nationkey * 53) % 1440 END AS start_min", "CASE WHEN n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 0 THEN (n_nationkey * 53 + 300) % 1440 END AS end_min",
        "CASE WHEN n_nationkey % 4 = 0 THEN 'fast' WHEN n_nationkey % 4 = 1 THEN 'slow' WHEN n_nationkey % 4 = 2 THEN 'both' END AS tracks",
    )


def collector_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls: one per batch and source seen in the readings."""
    o = observations(spark, sf_dir).groupBy("batch_id", "source").agg(F.count("*").alias("readings"), F.min("observed_at").alias("started_at"))
    return o.selectExpr("batch_id", "source", "started_at", "readings", "CASE WHEN CAST(substr(batch_id, 10, 4) AS INT) % 7 = 0 THEN 'failed' WHEN readings % 5 = 0 THEN 'partial' WHEN CAST(substr(batch_id, 10, 4) AS INT) % 11 = 0 THEN 'skipped_disabled' ELSE 'ok' END AS status")


def favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Favourite routes: one per customer whose ends differ, and the way back for every third."""
    c = _read(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "'S' || lpad(CAST(c_custkey % 25 AS STRING), 2, '0') AS a", "'S' || lpad(CAST((c_custkey * 3 + 5) % 25 AS STRING), 2, '0') AS b").filter("a <> b")
    same = ["CASE WHEN k % 4 = 0 THEN 'YYYYYYY' ELSE 'YYYYYNN' END AS weekdays", "k % 5 <> 0 AS notify", "k % 7 <> 0 AS nudge"]
    out = c.selectExpr("k AS user_id", "'home' AS name", "a AS from_station", "b AS to_station", "CASE WHEN k % 11 <> 0 THEN (k * 37) % 1440 END AS usual", "k % 2 = 0 AS is_default", *same)
    back = c.filter("k % 3 = 0").selectExpr("k AS user_id", "'return' AS name", "b AS from_station", "a AS to_station", "CASE WHEN k % 11 <> 0 THEN (k * 37 + 540) % 1440 END AS usual", "k % 2 <> 0 AS is_default", *same)
    return out.unionByName(back)


def broken_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops of every train, half of the trains with a fault: one stop only, no departure at the start, no arrival at the end, a long step, a long run."""
    last = F.max("stop_seq").over(Window.partitionBy("train_id"))
    s = scheduled_stops(spark, sf_dir).withColumn("last", last).withColumn("k", F.expr("CAST(split(train_id, '-')[1] AS INT) % 10"))
    clock = lambda c: f"CASE WHEN k = 4 AND stop_seq >= 3 THEN ({c} + 10800) % 86400 WHEN k = 5 AND {c} IS NOT NULL THEN ((stop_seq * 100) % 1440) * 60 ELSE {c} END"
    s = s.filter("NOT (k = 1 AND stop_seq > 1)")
    return s.selectExpr("train_id", "station_code", "stop_seq", f"CASE WHEN NOT (k = 3 AND stop_seq = last) THEN {clock('arrival_s')} END AS arrival_s", f"CASE WHEN NOT (k = 2 AND stop_seq = 1) THEN {clock('departure_s')} END AS departure_s")


#: Names that status texts are written with; the last one is in no directory.
FEED_NAMES = ("CSMT", "DADAR", "KURLA", "Ulhas Nagar", "AMBARNATH", "Badlapur", "VILLAGE  HALT")


def status_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed answers ``body, fetched_at, poll``: each event is one train's status text, a hundred to an answer."""
    name = lambda n: f"element_at(array({', '.join(repr(x) for x in FEED_NAMES)}), CAST(({n}) % {len(FEED_NAMES)} + 1 AS INT))"
    body = f"""CASE k % 8 WHEN 0 THEN 'Cancellation Reported' WHEN 1 THEN 'Rake at ' || {name('k')} WHEN 2 THEN 'At ' || {name('k')} WHEN 3 THEN 'Crossed ' || {name('k')} WHEN 4 THEN 'Arriving ' || {name('k')}
        WHEN 5 THEN 'Between ' || {name('k')} || ' - ' || {name('k + 3')} WHEN 6 THEN 'Reaching ' || {name('k + 3')} || ' (at ' || {name('k')} || ' now)' ELSE 'Waiting somewhere' END"""
    delay = "CASE WHEN k % 5 <> 0 AND k % 8 <> 0 THEN ', ' || CAST(k % 47 AS STRING) || ' min ' || CASE WHEN k % 4 = 1 THEN 'Early' ELSE 'Late' END ELSE '' END"
    ago = "CASE WHEN k % 3 = 0 THEN '[' || CAST(k % 14 AS STRING) || ' min ago] ' ELSE '' END"
    e = _read(spark, sf_dir, "events").selectExpr("event_id AS k", "event_id div 100 AS poll")
    e = e.withColumn("text", F.expr(f"{ago} || {body} || {delay} || CASE WHEN k % 6 = 0 THEN ' (Less Accurate)' ELSE '' END")).withColumn("number", F.expr("CAST(90000 + k % 10000 AS STRING)"))
    feed = e.groupBy("poll").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("number", "text")))).alias("body"))
    return feed.select("body", F.expr("TIMESTAMP '2024-01-05 00:00:00' + make_dt_interval(0, 0, CAST(poll AS INT), 0)").alias("fetched_at"), "poll")


def crowd_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Riders' messages ``id, text``: one per order, the words in three orders; some say "from", some say both fast and slow."""
    p = places(spark, sf_dir).filter("line = 'central'").select("code", F.lower("name").alias("name"), (F.col("seq") - 1).alias("n"))
    o = _read(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey % 25 AS n", "(o_custkey + 7) % 25 AS m")
    o = o.join(p, "n").join(p.select(F.col("n").alias("m"), F.col("name").alias("to_name")), "m")
    clock = "CASE k % 3 WHEN 0 THEN format_string('%d:%02d', t div 60, t % 60) WHEN 1 THEN format_string('%02d.%02d', t div 60, t % 60) ELSE format_string('%d:%02d %s', (t div 60 + 11) % 12 + 1, t % 60, CASE WHEN t < 720 THEN 'am' ELSE 'PM' END) END"
    words = [clock, "CASE WHEN k % 5 IN (1, 2) THEN 'Fast' WHEN k % 5 > 2 THEN 'slow' ELSE '' END", "CASE WHEN k % 13 = 5 THEN 'from ' ELSE '' END || CASE WHEN k % 2 = 0 THEN code ELSE name END", "element_at(array('empty', 'seats', 'standing', 'packed!', \"can't board\", ''), CAST(k % 6 + 1 AS INT))",
             "CASE WHEN k % 4 = 0 THEN 'to ' || to_name ELSE '' END", "CASE k % 7 WHEN 0 THEN '15car' WHEN 1 THEN '12-car' ELSE '' END", "CASE k % 8 WHEN 0 THEN 'AC' WHEN 1 THEN 'non-ac' ELSE '' END", "CASE WHEN k % 9 = 0 THEN 'ladies special' ELSE '' END", "CASE WHEN k % 10 = 3 THEN 'hello' ELSE '' END", "CASE WHEN k % 17 = 4 THEN 'slow, fast' ELSE '' END"]
    o = o.withColumn("t", F.expr("(k * 13) % 1440")).withColumn("w", F.array(*map(F.expr, words)))
    turned = F.when(F.col("k") % 3 == 0, F.col("w")).when(F.col("k") % 3 == 1, F.reverse("w")).otherwise(F.concat(F.slice("w", 5, 6), F.slice("w", 1, 4)))
    return o.select(F.col("k").alias("id"), F.array_join(turned, " ").alias("text"))


def told_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crowd reports whose riders say more of the train: where to, AC, cars, ladies' special, line."""
    said = "struct(CASE WHEN id % 4 = 0 THEN 'S' || lpad(CAST(id % 25 AS STRING), 2, '0') END AS destination, CASE id % 6 WHEN 0 THEN true WHEN 1 THEN false END AS ac, CAST(CASE id % 7 WHEN 0 THEN 15 WHEN 1 THEN 12 END AS INT) AS cars, CASE WHEN id % 9 = 0 THEN true END AS ladies)"
    return crowd_reports(spark, sf_dir).withColumn("said", F.expr(said)).withColumn("line", F.expr("CASE WHEN id % 11 = 0 THEN 'harbour' END"))


def block_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices of blocks ``notice, text, block_date, line``: one per nation, two sections each."""
    n = _read(spark, sf_dir, "nation").selectExpr("n_nationkey AS k")
    way = "element_at(array('up and down', 'Up', 'dn', 'Down & Up'), CAST(k % 4 + 1 AS INT))"
    tracks = "element_at(array('fast ', 'slow ', '', 'harbour '), CAST(k div 4 % 4 + 1 AS INT))"
    text = f"'Also on the Matunga-Mulund ' || {way} || ' ' || {tracks} || 'lines from ' || CAST(k % 12 + 1 AS STRING) || '.05 am to 3.55 p.m. and Halt  Road to KURLA dn lines  from 23:10 hrs to ' || CAST(k % 5 AS STRING) || ':15. Passengers are asked to note.'"
    return n.selectExpr("k AS notice", f"{text} AS text", "date_add(DATE '2024-02-01', CAST(k AS INT)) AS block_date", "'central' AS line")


def announcement_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of announcement cards ``page, html``: one page per region, one card per nation."""
    n = _read(spark, sf_dir, "nation").selectExpr("n_nationkey AS k", "n_regionkey AS page")
    day = "CAST(k % 28 + 1 AS STRING) || element_at(array('st', 'th', ''), CAST(k % 3 + 1 AS INT)) || ' ' || element_at(array('Jan', 'February', 'dec'), CAST(k % 3 + 1 AS INT))"
    line = "element_at(array('Central', 'Main line and Trans-Harbour', 'Harbour', 'some', 'Western'), CAST(k % 5 + 1 AS INT))"
    posted = "CASE WHEN k % 11 = 10 THEN 'soon' ELSE 'Sat, ' || CAST(k % 9 + 20 AS STRING) || ' Dec 23 10:55AM' END"
    card = f"""'<div class="' || CASE WHEN k % 2 = 0 THEN '2' ELSE '5' END || ' col-md-4"><div class="row card-box"><div><p class="t"> ' || CASE WHEN k % 2 = 0 OR k % 3 = 0 THEN 'Mega  Block' ELSE 'Fair' END || ' on ' || {line} || ' on ' || {day} || '</p>
<p>' || {posted} || '</p><p>See <b>app</b></p></div></div></div>'"""
    return n.groupBy("page").agg(F.concat(F.lit("<html><div class='top'>"), F.array_join(F.array_sort(F.collect_list(F.expr(card))), " "), F.lit("</div></html>")).alias("html"))


def movable_holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movable holidays ``date, name, status``: one per nation."""
    return _read(spark, sf_dir, "nation").selectExpr("date_add(DATE '2024-01-01', CAST((n_nationkey * 3) % 31 AS INT)) AS date", "n_name AS name", "element_at(array('confirmed', 'reported', 'tentative'), CAST(n_nationkey % 3 + 1 AS INT)) AS status")
