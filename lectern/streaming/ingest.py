"""Incremental ingestion: available files as micro-batches, keyed upserts, resumable runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.buckets import BUCKET, BucketTable, Commit, key_bucket
from lectern.operators.durable import materialize
from lectern.operators.fusion import first_wins
from lectern.operators.keyword import all_of
from lectern.operators.snapshot import upsert
from lectern.sources.remote import PagedSource


def ingest_files(
    spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, key: str = "key", position: str = "position", form: str = "parquet", clean: Callable[[DataFrame], DataFrame] | None = None, buckets: int = 64,
) -> StreamingQuery:
    """Reads the files that are new, keeps the first row of a key in each batch and upserts it into the bucketed table ``target``.

    A batch rewrites the buckets of its keys; its number is committed with them, so one that runs again
    after a lost driver or executor changes nothing once it is in.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        table = BucketTable(batch.sparkSession, target)
        done = table.last().facts.get("batches", {})
        if done.get(checkpoint, -1) >= batch_id:
            return
        rows = first_wins(clean(batch) if clean else batch, [key], position)
        table.upsert(materialize(rows, "batch"), key, buckets, batches=done | {checkpoint: batch_id})

    stream = spark.readStream.format(form).schema(schema).load(folder)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_remote(spark: SparkSession, options: dict[str, str], schema: str, target: str, checkpoint: str, key: str, buckets: int = 64) -> StreamingQuery:
    """New windows of the paged source into the bucketed table ``target``, one row a ``key``: rows of known keys are dropped.

    What the table holds is the state that tells duplicates across batches, read by the buckets of a batch's keys only. Windows
    that failed or that have more pages are listed in the commit's ``errors``; a batch that runs again changes nothing.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        table = BucketTable(batch.sparkSession, target)
        before = table.last()
        done = before.facts.get("batches", {})
        if done.get(checkpoint, -1) >= batch_id:
            return
        batch = materialize(batch, "remote")
        errors = sorted(r["error"] for r in batch.where("error IS NOT NULL").select("error").collect())  # one a window at most
        rest = [c for c in batch.columns if c not in (key, "error")]
        rows = batch.where(F.col("error").isNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")
        n = before.facts.get("buckets", buckets)
        new = rows.withColumn(BUCKET, key_bucket(F.col(key).cast("string"), n))
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]
        if (old := table.read(touched, before)) is not None:
            new = new.join(old.select(key), key, "left_anti")
        table.commit(new, touched, [key], keep=True, buckets=n, batches=done | {checkpoint: batch_id}, errors=[*before.facts.get("errors", []), *errors])

    spark.dataSource.register(PagedSource)
    stream = spark.readStream.format("paged").options(**options).schema(schema).load()
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The last version of a target."""
    rows = BucketTable(spark, target).read()
    if rows is None:
        raise FileNotFoundError(f"{target} has no version yet")
    return rows.drop(BUCKET)


def commit_window(spark: SparkSession, target: str, rows: DataFrame, source: str, covered_to: str, complete: bool = True, key: str = "key", buckets: int = 64) -> Commit:
    """Upsert what a source gave for a window and, if the window is complete, move the source's checkpoint, in one commit; it never moves back.

    A window that ran before and gives the same rows again leaves the table as it is.
    """
    table = BucketTable(spark, target)
    before = table.last()
    known = before.facts.get("checkpoints", {})
    after = known | ({source: max(covered_to, known.get(source, covered_to))} if complete else {})
    rows = materialize(rows, "window")
    old = table.read(commit=before)
    columns = [c for c in rows.columns if c != key]
    if old is not None:
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns]
        unchanged = rows.alias("r").join(old.drop(BUCKET).alias("o"), key).where(all_of(same)).select(key)
        rows = materialize(rows.join(unchanged, key, "left_anti"), "window")
    if not before.schema or not rows.isEmpty():
        return table.upsert(rows, key, buckets, checkpoints=after)
    return before if after == known else table.commit(old.limit(0), [], checkpoints=after)


def checkpoints(spark: SparkSession, target: str) -> dict[str, str]:
    """How far each source is covered, as of the last commit."""
    return BucketTable(spark, target).last().facts.get("checkpoints", {})


def advance_checkpoints(control: DataFrame, runs: DataFrame) -> DataFrame:
    """``control(source, last_checked)`` after ``runs(source, complete, covered_to)``: complete runs move on, never back."""
    done = runs.where("complete").groupBy("source").agg(F.max("covered_to").alias("to"))
    return control.join(done, "source", "full").select("source", F.greatest("last_checked", "to").alias("last_checked"))


def run_state(items: DataFrame) -> DataFrame:
    """State of each run of ``items(run_id, status)``."""
    n, done, failed, waiting = F.count("*"), F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed"), F.count_if(F.col("status").isin("pending", "running"))
    state = F.when(done == n, "completed").when((waiting > 0) & (done + failed > 0), "running").when(waiting == n, "queued").otherwise("partial")
    return items.groupBy("run_id").agg(state.alias("state"), done.alias("completed"), failed.alias("failed"))


def recover(output: DataFrame, retried: DataFrame, key: str = "key") -> DataFrame:
    """The output with retried rows, the last of a key."""
    return upsert(output, retried, key)


def search_counters(events: DataFrame) -> DataFrame:
    """User state from a log of searches: how often, and what the user found relevant."""
    return events.groupBy("state_key").agg(F.count("*").alias("search_count"), F.array_sort(F.collect_set(F.when(F.col("similarity") >= 0.25, F.col("query")))).alias("queries"))


def windowed_counts(stream: DataFrame, time: str, window: str, late: str, by: list[str]) -> DataFrame:
    """Counts of each window with a watermark; late rows beyond it are left out by Spark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"))
