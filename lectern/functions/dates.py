"""Dates of sources, windows and start dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import squeeze

# Forms of dates, tried in this order.
FORMS = ["d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy", "yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "MMM yyyy", "MMMM yyyy", "yyyy"]


def date_score(value: Column | str) -> Column:
    """yyyymmdd of a date in one of FORMS, missing parts 1; else of its first year; else 0."""
    c = F.regexp_replace(squeeze(value), ",", " ")
    c = F.regexp_replace(c, r"(?i)\bsept\.", "Sep")
    c = squeeze(F.regexp_replace(c, r"(?i)\b(jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)\.", "$1"))
    c = F.initcap(F.lower(c))
    parsed = F.coalesce(*(F.try_to_date(c, f) for f in FORMS))
    score = F.year(parsed) * 10000 + F.month(parsed) * 100 + F.dayofmonth(parsed)
    year = F.nullif(F.regexp_extract(c, r"\b(?:19|20)[0-9]{2}\b", 0), F.lit("")).try_cast("int")
    return F.coalesce(score, year * 10000 + 101, F.lit(0))


def date_windows(spark: SparkSession, start: str | None, end: str, days: int = 90) -> DataFrame:
    """Windows (window, first, last) that cover start to end, newest first; no start: one open window."""
    if not start:
        return spark.range(1).select(F.lit(0).alias("window"), F.lit(None).cast("date").alias("first"), F.lit(None).cast("date").alias("last"))
    days = max(1, days)
    n = F.floor(F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) / days)
    rows = spark.range(1).where(F.lit(end).cast("date") >= F.lit(start).cast("date")).select(F.explode(F.sequence(F.lit(0), n.cast("int"))).alias("window"))
    last = F.date_sub(F.lit(end).cast("date"), F.col("window") * days)
    return rows.select("window", F.greatest(F.date_sub(last, days - 1), F.lit(start).cast("date")).alias("first"), last.alias("last"))


def start_date(last_checked: Column, generation: Column, initial: Column, lookback_days: Column, lookback_years: Column, today: Column) -> Column:
    """Where an incremental read begins: the day checked last (after it in generation 1), else the first start, a look-back, or 2015."""
    checked = F.when(generation >= 2, last_checked).otherwise(F.date_add(last_checked, 1))
    return F.coalesce(checked, initial, F.date_sub(today, lookback_days), F.add_months(today, -12 * lookback_years), F.lit("2015-01-01").cast("date"))


def next_month_window(last_month: Column, target: Column, conference: Column) -> tuple[Column, Column]:
    """First and last day of the batch after ``last_month``: a month, for conferences their year."""
    start = F.least(F.add_months(F.trunc(last_month, "month"), 1), F.trunc(target, "month"))
    return F.when(conference, F.trunc(start, "year")).otherwise(start), F.when(conference, F.last_day(F.add_months(F.trunc(start, "year"), 11))).otherwise(F.last_day(start))
