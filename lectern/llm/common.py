"""Helpers shared by the operators: durable tables, Arrow batch bounds, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.durable import drop_tables, materialize, shared_dir, temporary_tables
from lectern.operators.graph import components

__all__ = [
    "bound_batches", "boxed", "checked_broadcast", "components", "crc_mod", "drop_tables", "join_skewed", "large_batches", "materialize", "quoted", "release_memory", "row_key", "shared_dir",
    "single_threaded", "temporary_tables", "unboxed",
]

#: Rows in one Arrow batch at most; texts may be long, so far below Spark's default.
BATCH_ROWS = 1000
#: Rows of a side at most that a join sends to every task; beyond, both sides shuffle.
BROADCAST_ROWS = 500_000


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small enough for very long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def large_batches(batches: Iterator[pa.RecordBatch], size: int = 8 << 20) -> Iterator[pa.Table]:
    """Arrow batches joined to tables of about ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def release_memory() -> None:
    """At the end of a Python task: hand freed memory back, as the worker lives on for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def single_threaded() -> None:
    """For Python workers: one core each, no thread pools of native libraries."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def row_key(df_id: str = "doc_id", text: str = "text") -> Column:
    """Rows with the same id and text are one document."""
    return F.xxhash64(F.coalesce(F.col(df_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast only if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def boxed(df: DataFrame, *columns: Column) -> DataFrame:
    """``df`` as one struct column ``_row`` beside own ``columns``: no name of a table's own columns can clash with these."""
    return df.select(F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("_row"), *columns)


def unboxed(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The ``columns`` that ``boxed`` put away; those of ``new`` with new values."""
    return df.select(*(new[c].alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in columns))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def join_skewed(left: DataFrame, right: DataFrame, key: str, total: int, share: int = 1000) -> DataFrame:
    """``left`` left-joined with ``right``, which has one row a key and ``n``, the key's rows in ``left``.

    Keys with more than 1 / ``share`` of the ``total`` rows are fewer than ``share``, so their
    rows of ``right`` are broadcast. The shuffle goes by ``_slot``: for other keys their hash,
    for rows that already have their answer (or a null key) a number of their own, so that
    these are dealt evenly. ``_slot`` is computed on either side, so no side of the condition is
    a constant that the optimiser could take out of the shuffle.
    """
    names = [c for c in right.columns if c not in (key, "n")]
    value = F.struct(*names)
    hot = right.where(F.col("n") > total / share).select(F.col(key).alias("_hot_key"), value.alias("_hot"))
    rest = right.where(F.col("n") <= total / share).select(F.xxhash64(key).alias("_slot"), F.col(key).alias("_key"), value.alias("_rest"))
    met = boxed(left, F.col(quoted(key)).alias("_own")).join(F.broadcast(hot), F.col("_own") == F.col("_hot_key"), "left")
    done = F.col("_hot").isNotNull() | F.col("_own").isNull()
    met = met.select("_row", "_hot", F.when(~done, F.col("_own")).alias("_key"), F.when(done, F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("_own")).alias("_slot"))
    out = met.join(rest, ["_slot", "_key"], "left")
    return out.select(*(F.col("_row").getField(c).alias(c) for c in left.columns), *(F.coalesce(F.col("_hot").getField(n), F.col("_rest").getField(n)).alias(n) for n in names))
