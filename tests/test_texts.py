"""Texts of feeds, riders and notices."""

import difflib
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from delayloom.functions import crowd_text, notices, stations, status

PLACES = [("CSMT", "CSMT", 1), ("DR", "Dadar", 8), ("KJRD", "Kanjur Marg", 15), ("TNA", "Thane", 20), ("KYN", "Kalyan", 26)]


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame([(c, n, "central", s) for c, n, s in PLACES], "code string, name string, line string, seq int")


def test_status_sentences(spark):
    cases = {
        "[7 min ago] Between AMBARNATH - BADLAPUR, 36 min Late (Less Accurate)": ("between", "AMBARNATH", 7, 36.0, True),
        "Reaching CSMT (at VIDYAVIHAR now), 39 min Late": ("at", "VIDYAVIHAR", 0, 39.0, False),
        "Cancellation Reported": ("cancelled", None, 0, None, False),
        "Rake at KALYAN": ("rake_at", "KALYAN", 0, None, False),
        "  Crossed MULUND, 3 min Early ": ("crossed", "MULUND", 0, -3.0, False),
        "Arriving DADAR (Less Accurate)": ("arriving", "DADAR", 0, None, True),
        "At CURREY ROAD, 0 min Late": ("at", "CURREY ROAD", 0, 0.0, False),
        "At DADAR, late": ("unknown", None, 0, None, False),
        "": ("unknown", None, 0, None, False),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").withColumn("said", status.status_sentence(F.col("t")))
    assert {r["t"]: (r["said"]["event"], r["said"]["place"], r["said"]["minutes_ago"], r["said"]["delay_minutes"], r["said"]["less_accurate"]) for r in df.collect()} == cases


def test_status_feed(spark):
    at = datetime(2026, 9, 27, 4, 0)
    raw = spark.createDataFrame([('{"95101": "[5 min ago] At Ulhas Nagar, 4 min Late", "91001": "At DADAR", "95102": "Cancellation Reported", "95103": null}', at), ("not json", at), (None, at)], "body string, fetched_at timestamp")
    got = {r["train_number"]: (r["station_code"], r["event"], r["observed_at"], r["actual_or_expected_time"]) for r in status.status_feed(raw).collect()}
    five = datetime(2026, 9, 27, 3, 55)
    assert got["95101"] == ("ULNR", "at", five, five) and got["91001"] == ("DADAR", "at", at, at) and got["95102"] == ("", "cancelled", at, None)
    assert set(got) <= {"95101", "91001", "95102", "95103"}


def test_crowd_messages(spark):
    codes = {"csmt": "CSMT", "cst": "CSMT", "dr": "DR", "dadar": "DR", "kjrd": "KJRD", "kanjur": "KJRD", "kanjurmarg": "KJRD", "tna": "TNA", "thane": "TNA", "kyn": "KYN", "kalyan": "KYN"}
    empty = {f: None for f in crowd_text.FIELDS} | {"unrecognised": [], "conflicts": []}
    cases = [
        ("8:12 fast KYN packed", dict(minute=492, service="fast", station="KYN", level=4)),
        ("packed kalyan 08.12 slow to Kanjur Marg, 15car", dict(minute=492, service="slow", station="KYN", level=4, destination="KJRD", cars=15)),
        ("8 pm from Kanjur Marg can’t board non-ac", dict(minute=1200, station="KJRD", level=5, ac=False)),
        ("cst 5 ladies special", dict(station="CSMT", level=5, ladies=True)),
        ("near the ladies coach at thane 12:30am", dict(station="TNA", minute=30, unrecognised=["near", "the", "ladies", "coach", "at"])),
        ("KYN DR 8:12 8:13 fast slow", dict(conflicts=["station", "minute", "service"])),
        ("KYN to Kalyan 25:00", dict(station="KYN", destination="KYN", unrecognised=["25:00"], conflicts=["destination is the station"])),
        ("to nowhere", dict(unrecognised=["to", "nowhere"])),
        ("from kalyan at 12am, full!", dict(station="KYN", minute=0, level=4, unrecognised=["at"])),
        ("from Kanjur Marg 13pm 0am 24:00 8 8:5", dict(station="KJRD", unrecognised=["13pm", "0am", "24:00", "8", "8:5"])),
        ("Couldn't  board (DR) ladies-special 12:05PM. 12car 15-car ac nonac", dict(station="DR", level=5, ladies=True, minute=725, conflicts=["ac", "cars"])),
        ("to kanjur marg; to dadar", dict(conflicts=["destination"])),
        ("cannot boards hello hello", dict(unrecognised=["cannot", "boards", "hello", "hello"])),
        ("", {}),
        (None, {}),
    ]
    rows = [(k, text, 1) for k, (text, _) in enumerate(cases)] + [(99, cases[0][0], 2)]
    df = spark.createDataFrame(rows, "id int, text string, i int")
    got = {r["id"]: r["said"].asDict() for r in crowd_text.parse_crowd_reports(df, "text", spark.createDataFrame(list(codes.items()), "key string, code string")).collect()}
    assert len(got) == len(rows) and got[99] == got[0]
    for k, (text, want) in enumerate(cases):
        assert got[k] == empty | want, text


def test_station_names(spark, places):
    known = stations.directory(places)
    df = spark.createDataFrame([("kyn",), ("Kanjur-Marg.",), ("V T",), ("kalwa",), ("",), (None,)], "t string")
    assert {r["t"]: r["station_code"] for r in stations.station_lookup(df, "t", known).collect()} == {"kyn": "KYN", "Kanjur-Marg.": "KJRD", "V T": "CSMT", "kalwa": None, "": None, None: None}
    keys = stations.bounded_directory(known)
    typos = ["kym", "kalyn", "x", "thanne", "dadr", "kanjur mrg", ""]
    got = {r["t"]: r["suggestions"] for r in stations.station_suggest(spark.createDataFrame([(t,) for t in typos], "t string"), "t", known).collect()}
    for t in typos:
        key = t.replace(" ", "")
        like = difflib.get_close_matches(key, keys, 9, 0.6 if len(key) > 3 else 0.65) if key else []
        assert got[t] == list(dict.fromkeys(keys[k] for k in like))[:3], t
    assert got["kalyn"] == ["KYN"] and got["x"] == []
    with pytest.raises(ValueError):
        stations.bounded_directory(known, 2)


def test_block_notices(spark):
    text = "Matunga-Mulund Up and Down fast lines from 11.05 am to 3.55 pm and on CSMT to Chunabhatti Dn harbour line from 10:40 to 25:10."
    df = spark.createDataFrame([(text, date(2026, 3, 1), "central"), ("No blocks this Sunday.", date(2026, 3, 1), "central"), (None, None, None)], "text string, block_date date, line string")
    got = [tuple(r[c] for c in ("line", "from_station", "to_station", "start_s", "end_s", "tracks", "direction")) for r in notices.parse_block_notice(df).orderBy("start_s").collect()]
    assert got == [("harbour", "CSMT", "Chunabhatti", 38400, None, None, "down"), ("central", "MTN", "MLND", 39900, 57300, "fast", "both")]


def test_announcements(spark):
    card = lambda c, *p: f'<div class="{c} col-md-4 x"><div class="card-box"><div>{"".join(f"<p>{x}</p>" for x in p)}</div></div></div>'
    html = card(2, "Megablock on Harbour line 3rd / 4th Jan", "Sat, 26 Dec 26 10:55AM", "see app") + card(1, "New timetable", "Sat, 26 Dec 26", "") + card(7, "Night block, Main line, 30 Dec", "Sat, 26 Dec 26", "") + card(2, "Block", "Sat, 26 Dec 26", "") + card(2, "Western 1 Jan", "today", "")
    df = spark.createDataFrame([(html,), ("<p>nothing</p>",), (None,)], "html string")
    got = sorted(((r["block_date"], r["line"], r["warning"]) for r in notices.announced_blocks(notices.announcement_cards(df)).collect()), key=str)
    assert got == sorted([(date(2027, 1, 3), "harbour", None), (date(2026, 12, 30), "central", None), (None, None, "no readable date"), (None, None, "can't read when this was posted")], key=str)
