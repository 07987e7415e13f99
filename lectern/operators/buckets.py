"""Tables in buckets with a version pointer: a commit rewrites the buckets that it touches, and nothing else.

Layout of a folder: ``data/_set=<id>/_bucket=<n>`` holds the rows of a bucket as one commit wrote
them; ``commits/<version>`` says which set each bucket is read from, with facts of the writer (a
batch, a checkpoint) that so become visible together with the rows. A commit counts once its
pointer is complete; sets of a commit that failed are read by no one. Two writers of
one version collide at its pointer, and the second is told. An append adds a set to its buckets and
reads nothing; compaction writes buckets of many sets as one.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"


def key_bucket(key: Column, n: int) -> Column:
    """The bucket of a key among ``n``, by its hash."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


@dataclass
class Commit:
    """A version: the sets that each bucket is read from (a bucket without rows has none), and the writer's facts."""

    version: int
    sets: dict[int, list[str]] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)
    schema: str = ""


class BucketTable:
    """A table under ``folder``, on any file system that Spark writes; the driver holds one entry a bucket."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _children(self, path: str) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def last(self) -> Commit:
        """The newest complete version; version -1 without buckets before the first."""
        for name in sorted(self._children(f"{self.folder}/commits"), reverse=True):
            if "_SUCCESS" in self._children(f"{self.folder}/commits/{name}"):
                found = json.loads(self.spark.read.text(f"{self.folder}/commits/{name}", wholetext=True).first()["value"])
                return Commit(int(name), {int(b): s for b, s in found["sets"].items()}, found["facts"], found["schema"])
        return Commit(-1)

    def read(self, buckets: list[int] | None = None, commit: Commit | None = None) -> DataFrame | None:
        """Rows of the newest (or the given) version, of all or of some ``buckets``, with ``_bucket``; None before the first."""
        commit = commit or self.last()
        if not commit.schema:
            return None
        base = f"{self.folder}/data"
        paths = [f"{base}/_set={s}/{BUCKET}={b}" for b, own in sorted(commit.sets.items()) if buckets is None or b in set(buckets) for s in own]
        if not paths:
            return self.spark.createDataFrame([], f"{commit.schema}, {BUCKET} int")
        return self.spark.read.schema(f"{commit.schema}, {BUCKET} int").option("basePath", base).parquet(*paths).drop("_set")

    def commit(self, rows: DataFrame, touched: list[int], sort: list[str] = (), per_bucket: int = 1, keep: bool = False, dealt: bool = False, kept: DataFrame | None = None, **facts) -> Commit:
        """Replace the ``touched`` buckets by ``rows`` (with ``_bucket``, of these buckets alone); a touched bucket without rows becomes empty.

        ``keep``: add the rows to what the buckets hold.

        ``sort``: order within a bucket's files, for statistics that leave out parts of a file;
        ``per_bucket``: tasks that write a bucket; ``dealt``: the rows' partitions already hold whole buckets or few parts of them.
        ``kept``: more rows of these buckets, as read from this table, that are written by the tasks that read them.
        """
        before = self.last()
        if not before.schema or touched:
            name, schema = uuid.uuid4().hex, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != BUCKET)
            deal = [F.col(BUCKET)] + ([F.pmod(F.xxhash64(*(F.col(c) for c in rows.columns if c != BUCKET)), F.lit(per_bucket))] if per_bucket > 1 else [])
            placed = rows if dealt else rows.repartition(max(1, len(touched) * per_bucket), *deal)
            path = f"{self.folder}/data/_set={name}"
            placed.sortWithinPartitions(BUCKET, *sort).write.partitionBy(BUCKET).parquet(path)
            if kept is not None:
                kept.select(*rows.columns).sortWithinPartitions(BUCKET, *sort).write.mode("append").partitionBy(BUCKET).parquet(path)
            written = {int(x.partition("=")[2]) for x in self._children(path) if x.startswith(f"{BUCKET}=")}
            if extra := written - set(touched):
                raise ValueError(f"rows of buckets that the commit doesn't touch: {sorted(extra)[:5]}")
            sets = {b: s for b, s in before.sets.items() if b not in set(touched)} | {b: [*(before.sets.get(b, []) if keep else []), name] for b in written}
            if keep:
                sets = before.sets | sets
        else:
            schema, sets = before.schema, before.sets
        after = Commit(before.version + 1, sets, before.facts | facts, schema)
        text = json.dumps({"sets": after.sets, "facts": after.facts, "schema": schema})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("error").text(f"{self.folder}/commits/{after.version:012d}")
        return after

    def compact(self, most: int = 4, sort: list[str] = ()) -> Commit:
        """Write buckets of more than ``most`` sets as one set each; others stay as they are."""
        before = self.last()
        many = [b for b, s in before.sets.items() if len(s) > most]
        return self.commit(self.read(many, before), many, sort) if many else before

    def upsert(self, rows: DataFrame, key: str, buckets: int = 64, **facts) -> Commit:
        """Insert or replace ``rows`` (one a ``key``); reads and rewrites the buckets of their keys.

        ``buckets`` counts for the first commit; later ones keep its number.
        """
        before = self.last()
        n = before.facts.get("buckets", buckets)
        new = rows.withColumn(BUCKET, key_bucket(F.col(key).cast("string"), n))
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # ``buckets`` numbers at most
        if (old := self.read(touched, before)) is not None:
            new = new.unionByName(old.join(rows.select(key), key, "left_anti"), allowMissingColumns=True)
        return self.commit(new, touched, [key], buckets=n, **facts)
