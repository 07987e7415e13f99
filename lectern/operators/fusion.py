"""De-duplication, fusion of many result lists, yields and saturation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.durable import ranked


def first_wins(rows: DataFrame, key: list[str], position: str) -> DataFrame:
    """One row of each key: the first by position."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), position).alias("r")).select(*key, "r.*").select(*rows.columns)


def last_wins(rows: DataFrame, key: list[str], position: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), position).alias("r")).select(*key, "r.*").select(*rows.columns)


def filled(c: str) -> Column:
    """Null where a text is empty."""
    return F.nullif(F.col(c), F.lit(""))


def merge_records(rows: DataFrame, key: str, position: str, fill: list[str], longest: str) -> DataFrame:
    """One row of each key: each field from the first row that has it, the longest text of all (the first of equals)."""
    first = [F.min_by(c, F.when(filled(c).isNotNull(), F.col(position))).alias(c) for c in fill]
    best = F.max_by(longest, F.struct(F.length(F.coalesce(longest, F.lit(""))), -F.col(position))).alias(longest)
    return rows.groupBy(key).agg(*first, best, F.min(position).alias(position))


def resolve_publications(rows: DataFrame) -> DataFrame:
    """``rows(title_key, year, doi)`` with ``publication``.

    Rows with a DOI are one publication for each DOI. A row without joins the publication
    of its title and year if this has exactly one DOI, else those of its title without a
    year that allow it, else it is one by its title and year.
    """
    by_year = rows.where("doi <> ''").groupBy("title_key", "year").agg(F.countDistinct("doi").alias("n"), F.min("doi").alias("d"))
    by_title = rows.where("doi <> ''").groupBy("title_key").agg(F.countDistinct("doi").alias("nt"), F.min("doi").alias("dt"), F.max(F.when(F.col("year") == 0, F.col("doi"))).alias("d0"))
    joined = rows.join(by_year, ["title_key", "year"], "left").join(by_title, "title_key", "left")
    some = F.when(F.col("doi") != "", F.col("doi")).when(F.col("n") == 1, F.col("d")).when((F.col("n").isNull()) & (F.col("nt") == 1) & ((F.col("year") == 0) | F.col("d0").isNotNull()), F.col("dt"))
    return joined.withColumn("publication", F.coalesce(F.concat(F.lit("doi:"), some), F.concat_ws("|", F.lit("title"), "title_key", F.col("year").cast("string")))).drop("n", "d", "nt", "dt", "d0")


def first_seen(retrievals: DataFrame, key: str = "key", query: str = "query_pos") -> DataFrame:
    """Retrievals with ``is_new``: the first query, in order, that found the key."""
    return retrievals.withColumn("is_new", F.col(query) == F.min(query).over(Window.partitionBy(key)))


def query_yield(retrievals: DataFrame) -> DataFrame:
    """For each query: results, distinct keys and keys that no earlier query had."""
    once = first_seen(retrievals.select("query_pos", "key").distinct())
    n = retrievals.groupBy("query_pos").agg(F.count("*").alias("raw_results"))
    return once.groupBy("query_pos").agg(F.count("*").alias("distinct_keys"), F.count_if("is_new").alias("new_unique")).join(n, "query_pos")


def zero_yield_tail(yields: DataFrame) -> DataFrame:
    """Completed queries after the last that found anything new."""
    last = yields.agg(F.max(F.when(F.col("new_unique") > 0, F.col("query_pos"))).alias("last"))
    after = F.col("last").isNull() | (F.col("query_pos") > F.col("last"))
    return yields.join(F.broadcast(last)).agg(F.count_if(after).cast("int").alias("tail"))


def saturation(families: Column, productive: Column, tail: Column) -> Column:
    return F.when((families >= 4) & (productive >= 2) & (tail >= 2), "strong").when((families >= 3) & (tail >= 1), "moderate").when(families >= 1, "weak").otherwise("insufficient")


def fuse(retrievals: DataFrame) -> DataFrame:
    """One row of each key with counts over its retrievals, ranked.

    retrievals: key, query_pos, family, mode, similarity, year, literal.
    """
    each = retrievals.groupBy("key").agg(
        F.count("*").alias("retrievals"), F.countDistinct("family").alias("families"), F.countDistinct("mode").alias("modes"),
        F.max("literal").alias("literal"), F.max("similarity").alias("similarity"), F.max("year").alias("year"),
    )
    return ranked(each, [F.desc("families"), F.desc("modes"), F.desc("literal"), F.desc("similarity"), F.desc("year"), F.col("key")])


def coverage(queries: DataFrame) -> DataFrame:
    """Queries for each dimension and value of ``queries(query_id, covers map<string, array<string>>)``."""
    each = queries.select("query_id", F.explode("covers").alias("dimension", "values")).select("query_id", "dimension", F.explode("values").alias("value"))
    return each.groupBy("dimension", "value").agg(F.array_sort(F.collect_set("query_id")).alias("queries"))


def retained(decision: Column) -> Column:
    return F.lower(F.trim(F.coalesce(decision, F.lit("")))).isin("include", "included", "retain", "retained")


def compare_sets(current: DataFrame, prior: DataFrame, resident: DataFrame | None = None, key: str = "key") -> DataFrame:
    """One row: retained, added and removed keys, and rates (null without a denominator)."""
    a = current.select(key).distinct().withColumn("now", F.lit(True))
    b = prior.select(key).distinct().withColumn("before", F.lit(True))
    both = a.join(b, key, "full")
    if resident is not None:
        both = both.join(resident.select(key).distinct().withColumn("here", F.lit(True)), key, "left")
    now, before = F.coalesce("now", F.lit(False)), F.coalesce("before", F.lit(False))
    here = F.coalesce("here", F.lit(False)) if resident is not None else F.lit(True)
    counts = both.agg(
        F.count_if(now & before).alias("retained"), F.count_if(now & ~before).alias("added"), F.count_if(before & ~now).alias("removed"),
        F.count_if(before).alias("prior"), F.count_if(before & here).alias("prior_resident"), F.count_if(before & here & now).alias("recalled"), F.count_if(before & ~here).alias("external_gaps"),
    )
    rate = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 6)
    return counts.select("retained", "added", "removed", "external_gaps", rate("retained", "prior").alias("retention_rate"), rate("recalled", "prior_resident").alias("resident_recall"))
