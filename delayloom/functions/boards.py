"""Live station boards (HTML) as readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parsing import delay_from_text, nearest_clock

#: Formats of a board's row and cells: fixed values.
NUMBER = r"<b>(\d{4,6})</b>&nbsp;\|"
LIVE = r'<font color="\w+">\s*(\d{1,2}:\d{2})(\*?)\s*</font>'
SCHEDULED = r'<font size="1">(?:&nbsp;|\s)*(\d{1,2}:\d{2})\s*</font>'
BADGE = r'padding: ?1px 4px;">\s*([^<]*?)\s*</span>'


def station_board(pages: DataFrame) -> DataFrame:
    """One reading per listed train and timed cell of ``pages(body, fetched_at, ...)``; other columns stay.

    The delay is live less scheduled time, else the badge's. A star marks an
    expected time. A cell without a time gives a reading only where it says
    that the train is cancelled. A page without a table, or null, gives none.
    """
    other = [c for c in pages.columns if c not in ("body", "fetched_at")]
    inside = F.regexp_extract("body", r"(?s)\d+ Trains departing from/arriving at(.*?)</table>", 1)
    rows = pages.select(*other, "fetched_at", F.explode(F.slice(F.split(inside, "<tr>"), F.lit(2), F.lit(2**31 - 1))).alias("row_"))
    cells = F.regexp_extract_all("row_", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), 1)
    listed = rows.withColumn("train_number", F.regexp_extract("row_", NUMBER, 1)).withColumn("cells_", cells).filter((F.col("train_number") != "") & (F.size("cells_") >= 4))
    both = F.array(F.struct(F.lit("arrival").alias("event"), F.col("cells_")[2].alias("cell")), F.struct(F.lit("departure").alias("event"), F.col("cells_")[3].alias("cell")))
    each = listed.withColumn("x_", F.explode(both)).withColumn("cell_", F.col("x_.cell"))
    clock = F.nullif(F.regexp_extract("cell_", LIVE, 1), F.lit(""))
    each = each.withColumn("at_", nearest_clock(clock, F.col("fetched_at"))).withColumn("cancelled", clock.isNull() & F.lower("cell_").contains("cancel")).filter(F.col("cancelled") | F.col("at_").isNotNull())
    due = nearest_clock(F.nullif(F.regexp_extract("cell_", SCHEDULED, 1), F.lit("")), F.col("at_"))
    delay = F.coalesce((F.unix_seconds("at_") - F.unix_seconds(due)) / 60, delay_from_text(F.regexp_extract("cell_", BADGE, 1)))
    kind = F.when(F.col("at_").isNotNull(), F.when(F.regexp_extract("cell_", LIVE, 2) == "*", "expected").otherwise("actual"))
    return each.select(*other, F.col("fetched_at").alias("observed_at"), "train_number", F.col("x_.event").alias("event"), F.col("at_").alias("actual_or_expected_time"), kind.alias("time_kind"), F.when(F.col("at_").isNotNull(), delay).alias("delay_minutes"), "cancelled")
