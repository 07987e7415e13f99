"""Year scopes of a library, names and sizes for people."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import year_of


def scope_names(presets: DataFrame, years: str = "years") -> DataFrame:
    """``presets`` with ``scope_key`` and ``scope_label`` of each row's array of years; one without years is the whole library."""
    newest = F.sort_array(F.array_distinct(F.col(years)), asc=False).cast("array<string>")
    listed = lambda sign: F.array_join(newest, sign)
    label = F.when(F.size(newest) == 0, "Full library").when(F.size(newest) == 1, F.concat(listed(""), F.lit(" only"))).otherwise(F.concat(F.lit("Years: "), listed(", ")))
    return presets.withColumns({"scope_key": F.when(F.size(newest) == 0, "all").otherwise(F.concat(F.lit("years_"), listed("_"))), "scope_label": label})


def available_years(papers: DataFrame, year: str = "year") -> DataFrame:
    """Distinct known years (1900 or later)."""
    return papers.select(year_of(F.col(year).cast("string")).alias("year")).distinct().where("year >= 1900")


def within_years(papers: DataFrame, years: Iterable[int], year: str = "year") -> DataFrame:
    return papers.where(year_of(F.col(year).cast("string")).isin(sorted({int(y) for y in years})))


def latest_years(papers: DataFrame, n: int, year: str = "year") -> DataFrame:
    """Rows of the ``n`` newest years that the library has (not of the last n calendar years)."""
    newest = available_years(papers, year).orderBy(F.desc("year")).limit(n)
    return papers.join(F.broadcast(newest.withColumnRenamed("year", "_year")), year_of(F.col(year).cast("string")) == F.col("_year"), "left_semi")


def scope_presets(papers: DataFrame, year: str = "year") -> DataFrame:
    """``(preset, years)``: the latest year, the latest three available ones, and all (no years)."""
    newest = available_years(papers, year).orderBy(F.desc("year")).limit(3)
    three = newest.agg(F.sort_array(F.collect_list("year"), asc=False).alias("y"))
    rows = F.array(
        F.struct(F.lit("latest_year").alias("preset"), F.slice("y", 1, 1).alias("years")), F.struct(F.lit("latest_three_years").alias("preset"), F.col("y").alias("years")),
        F.struct(F.lit("full_library").alias("preset"), F.slice("y", 1, 0).alias("years")),
    )
    return three.select(F.inline(rows))


def ready_stores(stores: DataFrame, scopes: list[str], models: list[str], selected: str = "") -> DataFrame:
    """For each other model its first ready scope, in the order of ``scopes``; models in their order.

    stores: model, scope, ready.
    """
    place = lambda c, names: F.array_position(F.lit(names), c)
    some = stores.where(F.col("ready") & F.col("scope").isin(scopes) & F.col("model").isin(models) & (F.col("model") != selected))
    first = Window.partitionBy("model").orderBy(place(F.col("scope"), scopes))
    best = some.withColumn("n", F.row_number().over(first)).where("n = 1")
    return best.select("model", "scope", place(F.col("model"), models).cast("int").alias("priority"))


def safe_name(text: Column) -> Column:
    """A name for a file or folder: runs of other characters than letters, digits, dot and dash as one underscore."""
    name = F.regexp_replace(F.regexp_replace(F.trim(text), r"[^A-Za-z0-9.-]+", "_"), r"^[_.]+|[_.]+$", "")
    return F.when(name == "", "unnamed").otherwise(F.substr(name, F.lit(1), F.lit(80)))


def size_text(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"


def time_text(seconds: float) -> str:
    s = max(0, round(seconds))
    return f"{s}s" if s < 60 else f"{s // 60}m {s % 60:02d}s" if s < 3600 else f"{s // 3600}h {s % 3600 // 60:02d}m"


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """``wanted``, or with the first number behind it that isn't taken."""
    name = re.sub(r"[^A-Za-z0-9.-]+", "_", wanted.strip()).strip("_.")[:80] or "unnamed"
    used, at = set(taken), 2
    while name in used:
        name, at = re.sub(r"_\d+$", "", name) + f"_{at}", at + 1
    return name
