"""Timetable rows into dimensions: validation, order of stations, replacement of trains."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import clock_seconds, days_mask, yes_no


#: Notes that are flags of a train: fixed values.
NOTES = {"is_ladies_special": "ladies_special", "ac_weekdays_only": "non_ac_weekends"}


def parse_timetable(rows: DataFrame) -> DataFrame:
    """Text cells as typed columns; cells that can't be read are null and named in ``bad``. A column notes, if there is one, gives the flags it lists."""
    typed = {"arrival_s": clock_seconds(F.col("scheduled_arrival")), "departure_s": clock_seconds(F.col("scheduled_departure")), "mask": days_mask(F.col("days")), "is_ac": yes_no(F.col("ac")), "car_count": F.col("cars").try_cast("int")}
    source = {"arrival_s": "scheduled_arrival", "departure_s": "scheduled_departure", "mask": "days", "is_ac": "ac", "car_count": "cars"}
    if "notes" in rows.columns:
        notes = F.transform(F.split(F.lower(F.coalesce("notes", F.lit(""))), r"\|"), lambda x: F.trim(x))
        typed |= {flag: F.array_contains(notes, note) for flag, note in NOTES.items()}
    out = rows.withColumns(typed)
    wrong = F.array(*[F.when((F.trim(F.coalesce(F.col(c), F.lit(""))) != "") & F.col(k).isNull(), F.lit(c)) for k, c in source.items()], F.when(~F.col("car_count").between(1, 30), F.lit("cars")))
    return out.withColumn("bad", F.array_distinct(F.filter(wrong, lambda x: x.isNotNull())))


def validate_rows(rows: DataFrame) -> DataFrame:
    """``line_no, message`` of every problem in parsed rows, alone and across rows."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    by_station, by_train = Window.partitionBy("station_code"), Window.partitionBy("train_number")
    checks = [F.when(blank(c), F.lit(f"{c} is blank")) for c in ("train_number", "station_code", "station_name", "days")]
    checks += [F.when(~F.lower("service_type").isin("fast", "slow"), F.lit("service_type is neither fast nor slow")), F.when(~F.lower("direction").isin("up", "down"), F.lit("direction is neither up nor down")), F.when(blank("scheduled_arrival") & blank("scheduled_departure"), F.lit("no time"))]
    checks += [F.when(F.min("station_name").over(by_station) != F.max("station_name").over(by_station), F.lit("station has two names"))]
    checks += [F.when(F.min(c).over(by_train) != F.max(c).over(by_train), F.lit(f"{c} differs within the train")) for c in ("direction", "service_type", "destination")]
    checks += [F.when(F.count("*").over(Window.partitionBy("train_number", "station_code")) > 1, F.lit("station twice in the train"))]
    found = rows.withColumn("messages", F.concat(F.filter(F.array(*checks), lambda x: x.isNotNull()), F.transform("bad", lambda b: F.concat(b, F.lit(" can't be read")))))
    return found.select("line_no", F.explode("messages").alias("message"))


def validate_runs(stops: DataFrame, step_s: int = 7200, run_s: int = 43200) -> DataFrame:
    """Trains whose times can't be a run: fewer than two stops, times missing at the ends, a step over two hours, twelve hours or more in all."""
    times = stops.select("train_id", "stop_seq", F.posexplode(F.array("arrival_s", "departure_s")).alias("k", "t")).filter("t IS NOT NULL")
    step = F.pmod(F.col("t") - F.lag("t").over(Window.partitionBy("train_id").orderBy("stop_seq", "k")), F.lit(86400))
    total = times.withColumn("step", F.coalesce(step, F.lit(0))).groupBy("train_id").agg(F.max("step").alias("longest"), F.sum("step").alias("whole"))
    ends = stops.groupBy("train_id").agg(F.count("*").alias("stops"), F.min_by("departure_s", "stop_seq").alias("first"), F.max_by("arrival_s", "stop_seq").alias("last"))
    bad = F.array(F.when(F.col("stops") < 2, F.lit("fewer than two stops")), F.when(F.col("first").isNull(), F.lit("no departure at the start")), F.when(F.col("last").isNull(), F.lit("no arrival at the end")), F.when(F.col("longest") > step_s, F.lit("a step takes over two hours")), F.when(F.col("whole") >= run_s, F.lit("the run takes twelve hours or more")))
    return ends.join(total, "train_id", "left").select("train_id", F.explode(F.filter(bad, lambda x: x.isNotNull())).alias("message"))


def station_pairs(stops: DataFrame, trains: DataFrame) -> DataFrame:
    """Neighbouring stations of each line in the down direction with the trains that say so, and how many say the opposite."""
    order = Window.partitionBy("train_id").orderBy("stop_seq")
    steps = stops.join(trains.select("train_id", "line", "direction"), "train_id").withColumn("next", F.lead("station_code").over(order)).filter("next IS NOT NULL")
    down = F.col("direction") == "down"
    p = steps.select("line", F.when(down, F.col("station_code")).otherwise(F.col("next")).alias("a"), F.when(down, F.col("next")).otherwise(F.col("station_code")).alias("b")).groupBy("line", "a", "b").agg(F.count("*").alias("trains"))
    back = p.select("line", F.col("b").alias("a"), F.col("a").alias("b"), F.col("trains").alias("against"))
    return p.join(back, ["line", "a", "b"], "left").na.fill(0, ["against"])


def station_order(pairs: DataFrame) -> DataFrame:
    """One order per line from its station pairs: what comes first whatever the train; ties follow the last station placed.

    A line's pairs are as many as its stations' neighbours, so a line is one small group.
    """

    def sort(group: pd.DataFrame) -> pd.DataFrame:
        after: dict[str, set] = {}
        before: dict[str, set] = {}
        for a, b in zip(group["a"], group["b"], strict=True):
            after.setdefault(a, set()).add(b)
            before.setdefault(b, set()).add(a)
            after.setdefault(b, set())
            before.setdefault(a, set())
        out: list[str] = []
        while before:
            free = sorted(s for s, need in before.items() if not need)
            if not free:  # a cycle: its stations get no place; see order_cycles
                break
            follow = [s for s in free if out and s in after[out[-1]]]
            s = (follow or free)[0]
            out.append(s)
            del before[s]
            for need in before.values():
                need.discard(s)
        return pd.DataFrame({"line": pd.Series([group["line"].iloc[0]] * len(out), dtype=object), "code": pd.Series(out, dtype=object), "seq": pd.Series(range(1, len(out) + 1), dtype="int32")})

    return pairs.filter("against = 0 OR trains > against").groupBy("line").applyInPandas(sort, "line string, code string, seq int")


def order_cycles(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """Stations of a line that ``station_order`` gave no place, since each comes after another of them."""
    named = pairs.select("line", F.explode(F.array("a", "b")).alias("code")).distinct()
    return named.join(order.select("line", "code"), ["line", "code"], "left_anti")


def upsert_timetable(current: DataFrame, incoming: DataFrame, replace_line: str | None = None) -> DataFrame:
    """Trains of ``incoming`` replace those of the same id; with ``replace_line`` the line's absent trains go too."""
    kept = current.join(incoming.select("train_id").distinct(), "train_id", "left_anti")
    if replace_line is not None:
        kept = kept.filter(F.col("line") != replace_line)
    return kept.unionByName(incoming)


def upsert_stops(stops: DataFrame, current: DataFrame, incoming_stops: DataFrame, incoming: DataFrame, replace_line: str | None = None) -> DataFrame:
    """Stops after the trains were replaced: an incoming train's stops are its only ones, and trains that went take theirs along."""
    kept = upsert_timetable(current, incoming, replace_line).join(incoming.select("train_id"), "train_id", "left_anti").select("train_id")
    return stops.join(kept, "train_id", "left_semi").unionByName(incoming_stops)


def upsert_stations(stations: DataFrame, incoming: DataFrame, order: DataFrame, main: str = "central") -> DataFrame:
    """``code, name, line, seq`` after a load of ``incoming(code, name, line)``, with ``order(line, code, seq)`` of all lines.

    A station's home line is the main line where it is on it, else the first by
    name; its name is its home line's, so another line never renames it.
    """
    home = order.groupBy("code").agg(F.min_by(F.struct("line", "seq"), F.struct(F.col("line") != main, "line")).alias("home"))
    old = stations.select("code", F.col("name").alias("old_name"), F.col("line").alias("old_line"))
    new = incoming.groupBy("code").agg(F.max_by(F.struct("name", "line"), F.struct("line", "name")).alias("new"))
    both = old.join(new, "code", "full").join(home, "code", "left")
    name = F.when(F.col("old_name").isNull() | (F.col("new.line") == F.col("old_line")), F.coalesce("new.name", "old_name")).otherwise(F.col("old_name"))
    return both.select("code", name.alias("name"), F.coalesce("home.line", "old_line", "new.line").alias("line"), F.coalesce("home.seq", F.lit(0)).cast("int").alias("seq"))


def order_conflicts(pairs: DataFrame) -> DataFrame:
    """Neighbouring stations that trains of one line call at both ways round as often, so that neither order holds."""
    return pairs.filter("against > 0 AND trains <= against AND (trains < against OR a < b)").select("line", "a", "b", "trains", "against")


def reconcile_listings(listings: DataFrame) -> DataFrame:
    """Trains listed several times: kept once if all listings agree, else rejected.

    ``listings`` has number and detail columns; with a column ``unreadable``, a
    train is rejected if any of its listings couldn't be read.
    """
    detail = F.sha2(F.to_json(F.struct(*[c for c in listings.columns if c not in ("number", "page", "unreadable")])), 256)
    lost = F.coalesce("unreadable", F.lit(False)) if "unreadable" in listings.columns else F.lit(False)
    k = listings.withColumn("detail", detail).withColumn("lost", lost)
    return k.groupBy("number").agg(F.countDistinct("detail").alias("kinds"), F.count("*").alias("pages"), F.max("lost").alias("lost")).select("number", "pages", F.when((F.col("kinds") == 1) & ~F.col("lost"), "kept").otherwise("rejected").alias("verdict"))


def apply_supplement(trains: DataFrame, supplement: DataFrame) -> DataFrame:
    """A newer edition by number: stated attributes win, unstated ones stay; each train is added, changed, unchanged or missing."""
    attributes = [c for c in trains.columns if c != "number"]
    s = supplement.select("number", *[F.col(c).alias(f"new_{c}") for c in attributes if c in supplement.columns], F.lit(True).alias("new_"))
    t = trains.withColumn("old_", F.lit(True)).join(s, "number", "full")
    given = [c for c in attributes if c in supplement.columns]
    differs = F.lit(False)
    for c in given:
        differs = differs | (F.col(f"new_{c}").isNotNull() & ~F.col(f"new_{c}").eqNullSafe(F.col(c)))
    change = F.when(F.col("old_").isNull(), "added").when(F.col("new_").isNull(), "missing").when(differs, "changed").otherwise("unchanged")
    return t.select("number", *[(F.coalesce(f"new_{c}", c) if c in given else F.col(c)).alias(c) for c in attributes], change.alias("change"))


def supplement_report(applied: DataFrame) -> DataFrame:
    """How many trains ``apply_supplement`` added, changed, left as they were or found missing from the newer edition."""
    return applied.groupBy("change").agg(F.count("*").alias("trains"))


def station_places(station_lines: DataFrame, stations: DataFrame) -> DataFrame:
    """``code, name, line, seq``: every line each station is on; a station that no line lists is on its home line."""
    listed = station_lines.join(stations.select("code", "name"), "code", "left").select("code", "name", "line", "seq")
    return listed.unionByName(stations.join(station_lines.select("code").distinct(), "code", "left_anti").select("code", "name", "line", "seq"))


def run_info(trains: DataFrame, stops: DataFrame) -> DataFrame:
    """Trains with the minute of the day their run starts and the place of its first station, both from the first stop."""
    first = stops.groupBy("train_id").agg(F.min_by(F.struct(F.coalesce("departure_s", "arrival_s").alias("at"), F.col("station_seq").alias("seq")), "stop_seq").alias("first"))
    return trains.drop("run_start_min").join(first, "train_id").select(*[c for c in trains.columns if c != "run_start_min"], F.floor(F.col("first.at") / 60).cast("int").alias("run_start_min"), F.col("first.seq").alias("origin_seq"))


def override_problems(trains: DataFrame, stops: DataFrame, overrides: DataFrame, changes: DataFrame) -> DataFrame:
    """``number, problem`` of everything in the corrections that can't be applied; see ``apply_overrides``.

    The resulting stops are checked as in ``validate_runs``, and no station may
    come twice in a train.
    """
    o = overrides.join(trains.select("number", F.lit(True).alias("known")), "number", "left")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    listed = changes.filter("kind = 'stop'").groupBy("number").agg(F.count("*").alias("listed"))
    o = o.join(listed, "number", "left")
    rules = [
        F.when(blank("reason"), "no reason"), F.when(~F.col("action").isin("set", "add", "remove"), "unknown action"), F.when((F.col("action") == "add") & F.col("known"), "the train already exists"),
        F.when(F.col("action").isin("set", "remove") & F.col("known").isNull(), "no such train"), F.when((F.col("action") == "add") & (blank("direction") | blank("train_type") | F.col("listed").isNull()), "direction, type and stops are needed"),
    ]
    alone = o.select("number", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("problem"))
    gone = changes.filter("kind = 'remove_stop'").join(stops.join(trains.select("train_id", "number"), "train_id").select("number", "station_code"), ["number", "station_code"], "left_anti")
    gone = gone.join(overrides.filter("action = 'set'").select("number"), "number", "left_semi").select("number", F.concat(F.lit("no stop to remove at "), "station_code").alias("problem"))
    after = _stops_after(trains, stops, overrides, changes)
    touched = after.join(overrides.filter("action <> 'remove'").select("number"), "number", "left_semi")
    twice = touched.groupBy("number", "station_code").agg(F.count("*").alias("n")).filter("n > 1").select("number", F.lit("a station appears twice").alias("problem")).distinct()
    runs = validate_runs(touched.withColumn("train_id", F.col("number"))).select(F.col("train_id").alias("number"), F.col("message").alias("problem"))
    return alone.unionByName(gone).unionByName(twice).unionByName(runs).distinct()


def _stops_after(trains: DataFrame, stops: DataFrame, overrides: DataFrame, changes: DataFrame) -> DataFrame:
    """All trains' stops by number once the corrections are in force, in route order."""
    columns = ["number", "station_code", "station_seq", "arrival_s", "departure_s", "at_"]
    old = stops.join(trains.select("train_id", "number"), "train_id").withColumn("at_", F.col("stop_seq"))
    old = old.join(overrides.filter("action = 'remove'").select("number"), "number", "left_anti")
    whole = changes.filter("kind = 'stop'").withColumn("at_", F.col("stop_seq"))
    old = old.join(whole.select("number").distinct(), "number", "left_anti")
    old = old.join(changes.filter("kind = 'remove_stop'").select("number", "station_code"), ["number", "station_code"], "left_anti")
    timed = changes.filter("kind = 'stop_time'").withColumn("at_", F.lit(None).cast("int"))
    old = old.select(*columns).join(timed.select("number", "station_code"), ["number", "station_code"], "left_anti").unionByName(timed.select(*columns)).unionByName(whole.select(*columns))
    way = trains.select("number", "direction").unionByName(overrides.filter("action = 'add'").select("number", "direction"))
    resorted = timed.select("number").distinct().withColumn("resort_", F.lit(True))
    old = old.join(way, "number").join(resorted, "number", "left")
    along = F.when(F.col("resort_"), F.when(F.col("direction") == "down", F.col("station_seq")).otherwise(-F.col("station_seq"))).otherwise(F.col("at_"))
    order = Window.partitionBy("number").orderBy(along, "station_code")
    return old.withColumn("stop_seq", F.row_number().over(order)).select("number", "station_code", "station_seq", "stop_seq", "arrival_s", "departure_s")


def apply_overrides(trains: DataFrame, stops: DataFrame, overrides: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hand-made corrections, applied all or none: (trains, stops by number, report).

    ``overrides(number, action, reason, direction, train_type, days, is_ac,
    car_count)``: one entry per train; action "set" changes the attributes it
    states, "add" brings a new train, "remove" drops one. ``changes(number,
    kind, station_code, station_seq, stop_seq, arrival_s, departure_s)``: kind
    "stop" rows are a train's whole new list, "stop_time" changes or adds one
    stop (the train is then sorted along the line), "remove_stop" drops one.
    Any problem (``override_problems``) raises, with all of them named. The
    report says what each entry did, "no change" included.
    """
    problems = override_problems(trains, stops, overrides, changes).orderBy("number", "problem").limit(1000).collect()
    if problems:
        raise ValueError("; ".join(f"{r['number']}: {r['problem']}" for r in problems))
    stated = ["train_type", "days", "is_ac", "car_count"]
    o = overrides.select("number", "action", F.col("direction").alias("new_direction"), *[F.col(c).alias(f"new_{c}") for c in stated])
    both = trains.join(o, "number", "full").filter("action IS NULL OR action <> 'remove'")
    value = {c: F.coalesce(f"new_{c}", c) for c in stated} | {"direction": F.when(F.col("action") == "add", F.col("new_direction")).otherwise(F.col("direction"))}
    new_trains = both.withColumn("days", F.coalesce("days", F.lit("YYYYYYY"))).select(*[value.get(c, F.col(c)).alias(c) for c in trains.columns])
    new_stops = _stops_after(trains, stops, overrides, changes)
    state = lambda t, s: t.select("number", F.struct(*stated).alias("attributes")).join(s.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("stop_seq", "station_code", "arrival_s", "departure_s"))).alias("stops")), "number", "left")
    was = state(trains, stops.join(trains.select("train_id", "number"), "train_id")).select("number", F.sha2(F.to_json(F.struct("attributes", "stops")), 256).alias("was"))
    now = state(new_trains, new_stops).select("number", F.sha2(F.to_json(F.struct("attributes", "stops")), 256).alias("now"))
    outcome = F.when(F.col("action") == "add", "added").when(F.col("action") == "remove", "removed").when(F.col("was") == F.col("now"), "no change").otherwise("changed")
    report = overrides.select("number", "action", "reason").join(was, "number", "left").join(now, "number", "left").select("number", outcome.alias("outcome"), "reason")
    return new_trains, new_stops, report


def timetable_summary(trains: DataFrame, stops: DataFrame) -> DataFrame:
    reach = stops.join(trains.select("train_id", "line"), "train_id").groupBy("line").agg(F.countDistinct("station_code").alias("stations"), F.count("*").alias("stops"))
    n = lambda c: F.count_if(c)
    return trains.groupBy("line").agg(F.count("*").alias("trains"), n(F.col("is_ac")).alias("ac"), n(F.col("car_count") == 15).alias("fifteen_car"), n(F.col("is_ladies_special")).alias("ladies"), n(F.col("train_type") == "fast").alias("fast")).join(reach, "line")


def rematch_trains(obs: DataFrame, trains: DataFrame) -> DataFrame:
    """Readings under a raw number get the train's id where exactly one train has the number."""
    one = trains.groupBy("number").agg(F.count("*").alias("n"), F.first("train_id").alias("found")).filter("n = 1").select(F.col("number").alias("train_number"), "found")
    return obs.join(one, "train_number", "left").withColumn("train_id", F.coalesce("found", "train_id")).drop("found")
