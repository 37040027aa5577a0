"""Boards written from the readings of each poll and station, and parsed again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.boards import station_board
from ..functions.calendar import local_time
from ..sources import adapters as A
from .base_sql import BASE

QUERIES, SQL = {}, {}


def parse_station_board(s, d):
    o = A.observations(s, d).filter("event IN ('arrival', 'departure', 'cancelled')")
    local = local_time(F.col("actual_or_expected_time"))
    due = local - F.make_dt_interval(mins=F.floor("delay_minutes").cast("int"))
    timed = F.concat(F.lit('<font color="red">'), F.date_format(local, "HH:mm"), F.when(F.col("less_accurate"), "*").otherwise(""), F.lit('</font><br>\n<font size="1">&nbsp;'), F.date_format(due, "HH:mm"), F.lit("</font>"))
    cell = F.when(F.col("cancelled"), "Cancelled").otherwise(timed)
    blank = F.lit('<font size="2">Source</font>')
    row = F.concat(F.lit("<tr><td>1</td><td nowrap><b>"), "train_number", F.lit("</b>&nbsp;|\n<b> X </b></td><td>"), F.when(F.col("event") != "departure", cell).otherwise(blank), F.lit("</td><td>"), F.when(F.col("event") == "departure", cell).otherwise(blank), F.lit("</td><td>1</td></tr>"))
    pages = o.groupBy("batch_id", "station_code").agg(F.max("observed_at").alias("fetched_at"), F.count("*").alias("n"), F.array_join(F.collect_list(row), "\n").alias("rows"))
    body = F.concat(F.lit("<table><th>"), F.col("n").cast("string"), F.lit(" Trains departing from/arriving at</th>"), "rows", F.lit("</table>"))
    out = station_board(pages.select("batch_id", "station_code", "fetched_at", body.alias("body")))
    return out.select("batch_id", "station_code", "train_number", "event", F.unix_seconds("actual_or_expected_time").alias("at_s"), "time_kind", "delay_minutes", "cancelled")


QUERIES["parse_station_board"] = parse_station_board
SQL["parse_station_board"] = BASE + """SELECT batch_id, station_code, train_number, CASE event WHEN 'departure' THEN 'departure' ELSE 'arrival' END AS event,
 CASE WHEN NOT cancelled THEN floor(epoch(date_trunc('minute', actual_or_expected_time)))::BIGINT END AS at_s,
 CASE WHEN NOT cancelled THEN CASE WHEN less_accurate THEN 'expected' ELSE 'actual' END END AS time_kind, floor(delay_minutes) AS delay_minutes, cancelled
 FROM observations WHERE event IN ('arrival', 'departure', 'cancelled')"""
