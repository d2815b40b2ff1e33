"""Date parsing and the date windows of the query tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tried in this order, after / has become a dot.
FORMATS = ["dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "dd.MM.yy HH:mm:ss", "dd.MM.yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd"]


#: A date anywhere in a text, with or without a time: day first, year first, and with the month's English name.
CLOCK = r"(?:[\sT,]+(\d{1,2}):(\d{2})(?::(\d{2}))?)?"
LENIENT = [
    (rf"(?<!\d)(\d{{1,2}})[./-](\d{{1,2}})[./-](\d{{4}}|\d{{2}})(?!\d){CLOCK}", (3, 2, 1)),
    (rf"(?<!\d)(\d{{4}})[./-](\d{{1,2}})[./-](\d{{1,2}})(?!\d){CLOCK}", (1, 2, 3)),
    (rf"(?i)(?<!\d)(\d{{1,2}})\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?,?\s+(\d{{4}}){CLOCK}", (3, 2, 1)),
]
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def found_date(c: Column, pattern: str, places: tuple[int, int, int]) -> Column:
    part = lambda i: F.regexp_extract(c, pattern, i)
    number = lambda i: F.when(part(i) != "", part(i).cast("int")).otherwise(0)
    year, month, day = (part(i) for i in places)
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year).cast("int")
    named = (F.position(F.lower(F.substring(month, 1, 3)), F.lit(MONTHS)) + 2) / 3
    month = F.when(month.rlike("[A-Za-z]"), named.cast("int")).otherwise(month.try_cast("int"))
    return F.when(part(0) != "", F.try_make_timestamp_ntz(year, month, day.try_cast("int"), number(4), number(5), number(6).cast("decimal(16,6)")))


def parse_date(c: Column, lenient: bool = True) -> Column:
    """A timestamp without zone for text of a known shape, day first; else (``lenient``) for the first date found in the text; else null."""
    text = F.translate(F.trim(c), "/", ".")
    strict = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in FORMATS]
    return F.coalesce(*strict, *([found_date(c, p, places) for p, places in LENIENT] if lenient else []))


def date_text(c: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` where the text is a date, else the text as it is."""
    return dated_text(parse_date(c), c)


def dated_text(ts: Column, c: Column) -> Column:
    """``date_text`` of a text whose ``parse_date`` is at hand."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), c)


def between_days(ts: Column, date_from: str, date_to: str) -> Column:
    """From the start of one day to the end of another."""
    return (ts >= F.lit(date_from).cast("timestamp_ntz")) & (ts < (F.lit(date_to).cast("date") + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz"))


def last_days(ts: Column, n: int, as_of: str) -> Column:
    """Not more than n days before ``as_of``; later times too."""
    return ts >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(n))


def longest_runs(df: DataFrame, ts: str, least: int, by: list[str] | None = None) -> DataFrame:
    """first_day, last_day and days of the longest run of active days, the earliest of equals, if it has ``least`` days.

    Days are made distinct first: what is ordered is a row for each day (and each of ``by``), however many rows came in.
    """
    by = by or []
    days = df.select(*by, F.to_date(ts).alias("day")).filter("day is not null").distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy(*by).orderBy("day")))
    runs = days.withColumn("island", island).groupBy(*by, "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"))
    best = F.max_by(F.struct("first_day", "last_day", "days"), F.struct("days", -F.unix_date("first_day"))).alias("r")
    return runs.filter(F.col("days") >= least).groupBy(*by).agg(best).select(*by, "r.*")


def filter_by_date(df: DataFrame, date_from: str | None = None, date_to: str | None = None, last_n_days: int | None = None, consecutive_days: int | None = None, as_of: str | None = None, ts: str = "event_ts", by: list[str] | None = None) -> DataFrame:
    """One window: the longest run of active days, else the last days, else a range that needs both ends, else none.

    Rows without a date go in any case; a table that has the text column ``date`` alone is filtered by that, and one without
    either stays as it is. A run keeps its rows up to and with the midnight after its last day. With ``by`` each of its values has its own run.
    """
    if ts not in df.columns:
        if "date" not in df.columns:
            return df
        dated = df.withColumn(ts, parse_date(F.col("date").cast("string")))
        return filter_by_date(dated, date_from, date_to, last_n_days, consecutive_days, as_of, ts, by).drop(ts)
    df = df.filter(F.col(ts).isNotNull())
    if consecutive_days:
        run = longest_runs(df, ts, consecutive_days, by)
        ends = (F.col(ts) >= F.col("first_day").cast("timestamp_ntz")) & (F.col(ts) <= F.date_add("last_day", 1).cast("timestamp_ntz"))
        if by:
            return df.join(run, by).filter(ends).select(*df.columns)
        # One row at most.
        return df.join(F.broadcast(run), ends, "left_semi")
    if last_n_days:
        return df.filter(last_days(F.col(ts), last_n_days, as_of) if as_of else F.col(ts) >= F.localtimestamp() - F.make_dt_interval(F.lit(last_n_days)))
    if date_from and date_to:
        return df.filter(between_days(F.col(ts), date_from, date_to))
    return df
