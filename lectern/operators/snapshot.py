"""Differences between snapshots, deltas, upserts and purges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str = "key", fingerprint: str = "fingerprint") -> DataFrame:
    """``(key, change)``: added, changed or removed."""
    a, b = old.select(key, F.col(fingerprint).alias("o")), new.select(key, F.col(fingerprint).alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change is not null")


def upsert(base: DataFrame, delta: DataFrame, key: str = "key") -> DataFrame:
    """``base`` with the rows of ``delta`` in place of those with the same key."""
    return base.join(delta.select(key), key, "left_anti").unionByName(delta)


def apply_delta(base: DataFrame, delta: DataFrame, removed: DataFrame, key: str = "key") -> DataFrame:
    return upsert(base, delta, key).join(removed.select(key), key, "left_anti")


def delta_counts(base: DataFrame, delta: DataFrame, key: str = "key", fingerprint: str = "fingerprint") -> DataFrame:
    """One row: rows of the delta that insert, replace or are skipped as equal."""
    old = base.select(key, F.col(fingerprint).alias("o"))
    j = delta.join(old, key, "left")
    return j.agg(F.count_if(F.col("o").isNull()).alias("inserted"), F.count_if(F.col("o") != F.col(fingerprint)).alias("replaced"), F.count_if(F.col("o") == F.col(fingerprint)).alias("skipped"))


def append_vectors(store: DataFrame, delta: DataFrame, expected: DataFrame) -> DataFrame:
    """``store`` with ``delta``, if its fingerprints are those ``expected``; else an error and no change."""
    a, b = store.select("fingerprint").distinct(), expected.select("fingerprint").distinct()
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ValueError("the store isn't the one that the delta was made for")
    return store.unionByName(delta)


def purge(rows: DataFrame, selected: DataFrame, key: str = "key", title: str = "title") -> DataFrame:
    """Rows of which neither key nor title is selected."""
    return rows.join(selected.select(key).where(f"{key} <> ''").distinct(), key, "left_anti").join(selected.select(title).where(f"{title} <> ''").distinct(), title, "left_anti").select(*rows.columns)


def uncovered(rows: DataFrame, others: DataFrame, key: str = "key") -> DataFrame:
    """Rows that no other source has."""
    return rows.join(others.select(key).distinct(), key, "left_anti")


def lost_sources(before: DataFrame, present: DataFrame, valid: DataFrame, path: str = "path") -> DataFrame:
    """Sources that were valid and are present, but aren't valid now."""
    return before.select(path).intersect(present.select(path)).exceptAll(valid.select(path).distinct())


def merge_registry(template: DataFrame, current: DataFrame, keep: list[str], key: str = "id", revision: str = "revision") -> DataFrame:
    """Template rows over current ones of a smaller revision; ``keep`` columns stay the current's; own rows stay."""
    columns = [c for c in template.columns if c != key]
    t = template.select(key, F.struct(*columns).alias("t"))
    c = current.select(key, F.struct(*columns).alias("c"))
    newer = F.col("c").isNull() | (F.col(f"t.{revision}") > F.col(f"c.{revision}"))
    pick = lambda n: F.when(F.col("t").isNull(), F.col(f"c.{n}")).when(F.lit(n in keep) & F.col("c").isNotNull(), F.col(f"c.{n}")).when(newer, F.col(f"t.{n}")).otherwise(F.col(f"c.{n}"))
    return t.join(c, key, "full").select(key, *(pick(n).alias(n) for n in columns)).select(*template.columns)
