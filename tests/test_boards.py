from datetime import datetime, timezone

from delayloom.functions.boards import station_board


def test_board_cells(spark):
    cell = lambda x: f"<td nowrap>{x}</td>"
    row = lambda number, a, b: f"<tr><td>1</td>\n<td><b>{number}</b>&nbsp;|\n<b> X </b></td>{cell(a)}{cell(b)}<td>4</td></tr>"
    timed = '<font color="red">00:05*</font><br><span style="padding: 1px 4px;">9 Mins.</span><font size="1">&nbsp;23:50</font>'
    badge = '<font color="green">23:40</font><span style="padding: 1px 4px;">On Time</span>'
    body = f"<table>2 Trains departing from/arriving at<tr><td>x</td></tr>{row(12164, 'Source', timed)}{row(95413, badge, 'Cancelled')}</table><tr>{row(95999, badge, badge)}"
    at = datetime(2024, 1, 5, 18, 20, tzinfo=timezone.utc)  # 23:50 local
    pages = spark.createDataFrame([(body, at, 1), ("no table", at, 2), (None, at, 3)], "body string, fetched_at timestamp, page int")
    got = {(r.page, r.train_number, r.event): (r.time_kind, r.delay_minutes, r.cancelled) for r in station_board(pages).collect()}
    assert got == {(1, "12164", "departure"): ("expected", 15.0, False), (1, "95413", "arrival"): ("actual", 0.0, False), (1, "95413", "departure"): (None, None, True)}
