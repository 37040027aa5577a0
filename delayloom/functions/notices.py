"""Announcements of engineering blocks, from a page's cards or a notice's wording, as block rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parsing import block_id, name_key
from .stations import CODES

#: Month names by number: fixed values.
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6, "july": 7, "jul": 7,
    "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}
#: Card class of the page's block filter, and forms of titles, dates and notices: fixed values.
BLOCK_CLASS = "2"
BLOCK_WORD = r"(?i)\b(?:mega|jumbo|special|night)?\s*-?\s*block\b"
POSTED = r"(\d{1,2}) ([A-Za-z]{3,9}) (\d{2,4})"
DAY_MONTH = r"(?i)(\d{1,2})(?:st|nd|rd|th)?(?:\s*/\s*\d{1,2}(?:st|nd|rd|th)?)?\s+([A-Za-z]{3,9})"
TIME = r"\d{1,2}[.:]\d{2}\s*(?:am|pm|a\.m\.|p\.m\.|hrs|hours)?"
NOTICE = (
    r"(?i)([A-Za-z][A-Za-z. ]*?)\s*(?:-|–|to)\s*([A-Za-z][A-Za-z. ]*?)\s+"
    r"(up\s*(?:and|&)\s*(?:down|dn)|(?:down|dn)\s*(?:and|&)\s*up|up|down|dn)\s+"
    rf"(fast|slow|harbour|trans[- ]?harbour)?\s*lines?\s+from\s+({TIME})\s+to\s+({TIME})"
)
LEADING = r"(?i)^(?:(?:and|also|on|the|between)\s+)+"
#: How long before its posting a block may have been: fixed value.
DAYS_BACK = 7


def _month(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair]), F.lower(name))


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]*>", ""), r"\s+", " "))


def station_code(text: Column) -> Column:
    """The code of a known name, else the name with single blanks; null if blank."""
    clean = F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))
    codes = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    return F.coalesce(F.element_at(codes, F.coalesce(name_key(clean), F.lit(""))), clean)


def announcement_cards(pages: DataFrame) -> DataFrame:
    """``category, title, posted, teaser`` of each card of ``pages(html, ...)``; other columns stay. A page without cards, or null, gives none."""
    other = [c for c in pages.columns if c != "html"]
    column = r'<div[^>]*class="(?=[^"]*\bcol-)(\d+)[\s"]'
    parts = F.slice(F.split("html", column.replace(r"(\d+)", r"\d+")), F.lit(2), F.lit(2**31 - 1))
    each = pages.select(*other, F.explode(F.arrays_zip(F.regexp_extract_all("html", F.lit(column), 1).alias("category"), parts.alias("body"))).alias("x"))
    inside = F.regexp_extract(F.col("x.body"), r'(?s)<div[^>]*class="[^"]*\bcard-box\b[^"]*"[^>]*>(.*)', 1)
    told = F.transform(F.regexp_extract_all(inside, F.lit(r"(?s)<p[^>]*>(.*?)</p>"), 1), _squeezed)
    cards = each.withColumn("inside", inside).withColumn("told", told).filter("inside <> ''")
    at = lambda i: F.coalesce(F.get("told", F.lit(i)), F.lit(""))
    return cards.select(*other, F.col("x.category").alias("category"), at(0).alias("title"), at(1).alias("posted"), at(2).alias("teaser"))


def announced_blocks(cards: DataFrame) -> DataFrame:
    """One row per block card and line it names: ``block_date, line, posted_on`` and, where something can't be read, ``warning`` instead.

    The date is the first one in the title, in the year that puts it on or
    after a week before the posting. Other columns than the cards' own stay.
    """
    other = [c for c in cards.columns if c not in ("category", "title", "posted", "teaser")]
    c = cards.filter((F.col("category") == BLOCK_CLASS) | F.col("title").rlike(BLOCK_WORD))
    year = F.regexp_extract("posted", POSTED, 3).try_cast("int")
    posted = _day(F.when(year < 100, year + 2000).otherwise(year), _month(F.regexp_extract("posted", POSTED, 2)), F.regexp_extract("posted", POSTED, 1).try_cast("int"))
    c = c.withColumn("posted_on", posted)
    named = F.arrays_zip(F.regexp_extract_all("title", F.lit(DAY_MONTH), 1).alias("day"), F.regexp_extract_all("title", F.lit(DAY_MONTH), 2).alias("month"))
    options = F.flatten(F.transform(named, lambda x: F.transform(F.array(F.lit(0), F.lit(1)), lambda y: _day(F.year("posted_on") + y, _month(x["month"]), x["day"].cast("int")))))
    c = c.withColumn("block_date", F.get(F.filter(options, lambda d: d >= F.date_sub("posted_on", DAYS_BACK)), F.lit(0)))
    low, trans = F.lower("title"), r"trans[- ]?harbour"
    rest = F.regexp_replace(low, trans, " ")
    lines = F.array(F.when(low.rlike(r"\bcentral\b|\bmain line\b"), "central"), F.when(low.rlike(trans), "transharbour"), F.when(rest.contains("harbour"), "harbour"), F.when(rest.contains("western"), "western"))
    c = c.withColumn("lines", F.filter(lines, lambda x: x.isNotNull()))
    warning = F.when(F.col("posted_on").isNull(), "can't read when this was posted").when(F.col("block_date").isNull(), "no readable date").when(F.size("lines") == 0, "no readable line")
    c = c.withColumn("warning", warning).withColumn("line", F.explode(F.when(F.col("warning").isNull(), F.col("lines")).otherwise(F.array(F.lit(None).cast("string")))))
    return c.select(*other, F.when(F.col("warning").isNull(), F.col("block_date")).alias("block_date"), "line", "posted_on", "warning")


def _clock_seconds(text: Column) -> Column:
    """Seconds of the day of "11.05 am" or "15:55 hrs"; null if it is no time."""
    form = r"(?i)(\d{1,2})[.:](\d{2})\s*([ap]?)"
    hour, minute, half = F.regexp_extract(text, form, 1).cast("int"), F.regexp_extract(text, form, 2).cast("int"), F.lower(F.regexp_extract(text, form, 3))
    on = F.when(half == "", F.when(hour < 24, hour)).otherwise(F.when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0)))
    return F.when(minute < 60, on * 3600 + minute * 60)


def parse_block_notice(notices: DataFrame) -> DataFrame:
    """Blocks in the usual wording of ``notices(text, block_date, line, ...)``: section, hours, tracks and direction; other columns stay.

    A harbour or trans-harbour notice sets the line. Sentences of other forms
    give no row; a time that is none gives a row without it.
    """
    other = [c for c in notices.columns if c not in ("text", "block_date", "line")]
    group = lambda i, name: F.regexp_extract_all("text", F.lit(NOTICE), i).alias(name)
    each = notices.select(*other, "block_date", F.col("line").alias("said_line"), F.explode(F.arrays_zip(group(1, "a"), group(2, "b"), group(3, "way"), group(4, "tracks"), group(5, "start"), group(6, "end"))).alias("x"))
    tracks = F.regexp_replace(F.lower("x.tracks"), "[- ]", "")
    way = F.lower("x.way")
    out = each.select(
        *other, "block_date", F.when(tracks.isin("harbour", "transharbour"), tracks).otherwise(F.col("said_line")).alias("line"),
        station_code(F.regexp_replace("x.a", LEADING, "")).alias("from_station"), station_code(F.col("x.b")).alias("to_station"),
        _clock_seconds(F.col("x.start")).alias("start_s"), _clock_seconds(F.col("x.end")).alias("end_s"), F.when(tracks.isin("fast", "slow"), tracks).alias("tracks"),
        F.when(way.rlike("and|&"), "both").when(way == "up", "up").otherwise("down").alias("direction"),
    )
    key = block_id(*[F.col(c) for c in ("block_date", "line", "from_station", "to_station", "start_s", "end_s", "tracks", "direction")])
    return out.withColumn("block_id", F.concat_ws("-", F.date_format("block_date", "yyyyMMdd"), "line", key))
