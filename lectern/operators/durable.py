"""Durable tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    On a local master that names none, a temporary folder of this process; elsewhere an error,
    as no machine's own folder would do.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it comes in fewer partitions than these (few or small files); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt_by(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over all cores, a few tasks each, for work that costs far more a row than a shuffle.

    Parts of a file count as partitions, but all rows of a row group go to one of them: a large file of few groups keeps few cores busy.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the place of each row in ``order``, from 1: rows are sorted by ranges over all tasks, never in one."""
    spark = df.sparkSession
    at = F.monotonically_increasing_id()
    held = df.orderBy(*order).withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))})
    held = materialize(held, "ranked")
    sizes = sorted((r["_part"], r["n"]) for r in held.groupBy("_part").agg(F.max("_at").alias("n")).collect())
    offsets, total = [], 0
    for part, last in sizes:
        offsets.append((part, total))
        total += last + 1
    if not offsets:
        return held.drop("_part", "_at").withColumn(name, F.lit(0).cast("int"))
    before = F.broadcast(spark.createDataFrame(offsets, "_part long, _before long"))
    return held.join(before, "_part").withColumn(name, (F.col("_before") + F.col("_at") + 1).cast("int")).drop("_part", "_at", "_before")


#: Folders that ``materialize`` made within ``temporary_tables``, innermost last.
_made: list[list[str]] = []


@contextlib.contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[list[str]]:
    """The folders of the tables that are materialised meanwhile, in order, for ``drop_tables``; they count as made in the outer block, too."""
    _made.append([])
    try:
        yield _made[-1]
    finally:
        inner = _made.pop()
        for outer in _made[-1:]:
            outer.extend(inner)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more, through the file system that holds them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a new Parquet table in the shared folder and read it back.

    Cuts the lineage durably: a lost executor never causes a rerun of what lies before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _made[-1:]:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)
