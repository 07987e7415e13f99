"""Grouped statistics of a corpus and of its updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relevance_buckets(hits: DataFrame) -> DataFrame:
    s = F.col("similarity")
    return hits.agg(F.count_if(s >= 0.6).alias("rare"), F.count_if((s >= 0.4) & (s < 0.6)).alias("perfect"), F.count_if((s >= 0.25) & (s < 0.4)).alias("valuable"), F.count_if(s < 0.25).alias("other"))


def year_histogram(rows: DataFrame, year: str = "year") -> DataFrame:
    return rows.where(F.col(year) > 1900).groupBy(year).agg(F.count("*").alias("n"))


def venue_years(rows: DataFrame) -> DataFrame:
    """Rows of each venue and year from 1900, without venue Other."""
    return rows.where((F.col("year") >= 1900) & (F.col("venue") != "Other")).groupBy("venue", "year").agg(F.count("*").alias("n"))


def taxonomy_matrix(rows: DataFrame, years: list[int], least: int = 50) -> DataFrame:
    """A column for each year and ``earlier``; venues of at least ``least`` rows."""
    per = venue_years(rows)
    columns = [F.sum(F.when(F.col("year") == y, F.col("n")).otherwise(0)).alias(f"y{y}") for y in years]
    earlier = F.sum(F.when(F.col("year") < min(years), F.col("n")).otherwise(0)).alias("earlier")
    return per.groupBy("venue").agg(*columns, earlier, F.sum("n").alias("total")).where(F.col("total") >= least)


def purge_set(rows: DataFrame, least: int = 50) -> DataFrame:
    """Rows of venue Other, or of venues with fewer than ``least`` rows from 1900."""
    small = venue_years(rows).groupBy("venue").agg(F.sum("n").alias("total")).where(F.col("total") < least).select("venue")
    return rows.where("venue = 'Other'").unionByName(rows.where("venue <> 'Other'").join(small, "venue", "left_semi").select(*rows.columns))


def latest_updates(files: DataFrame, group: str, time: str, name: str, rows: str) -> DataFrame:
    """For each group: last time, sum of rows, files and the file of the last time."""
    return files.groupBy(group).agg(F.max(time).alias("last_time"), F.sum(rows).alias("rows"), F.countDistinct(name).alias("files"), F.min_by(name, F.struct(-F.unix_micros(F.col(time).cast("timestamp")), name)).alias("last_file"))


def coverage(rows: DataFrame, year: Column) -> DataFrame:
    """One row: count, first and last year, rows of the last year."""
    y = rows.select(year.alias("y")).where("y > 0").groupBy("y").count()
    return y.agg(F.sum("count").alias("n"), F.min("y").alias("first_year"), F.max("y").alias("last_year"), F.max_by("count", "y").alias("in_last_year"))
