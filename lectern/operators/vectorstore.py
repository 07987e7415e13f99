"""A store of vectors by model and fingerprint, with scopes of years as views and appends that read no vector."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.buckets import BUCKET, BucketTable, Commit, key_bucket
from lectern.operators.durable import materialize
from lectern.operators.vector import encode_with_retries

COLUMNS = ["model", "fingerprint", "year", "embedding"]


class VectorStore:
    """Vectors under ``folder``, bucketed by fingerprint; one for each model and fingerprint, however many records have that text."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.table, self.buckets = BucketTable(spark, folder), buckets

    def read(self, model: str, years: Iterable[int] | None = None) -> DataFrame | None:
        """The vectors of a model, all or those of a scope of years: a view, nothing is copied."""
        rows = self.table.read()
        if rows is None:
            return None
        rows = rows.where(F.col("model") == model).drop(BUCKET)
        return rows if years is None else rows.where(F.col("year").isin(sorted({int(y) for y in years})))

    def missing(self, papers: DataFrame, model: str) -> DataFrame:
        """Rows of ``papers(fingerprint, ...)`` without a vector; only fingerprints of the store are read."""
        held = self.read(model)
        return papers if held is None else papers.join(held.select("fingerprint"), "fingerprint", "left_anti")

    def append(self, vectors: DataFrame, model: str) -> Commit:
        """Add the ``vectors(fingerprint, year, embedding)`` that the model lacks, one a fingerprint (of the least year); what is there stays as it is."""
        before = self.table.last()
        n = before.facts.get("buckets", self.buckets)
        new = self.missing(vectors.where("embedding IS NOT NULL AND fingerprint IS NOT NULL"), model)
        new = new.groupBy("fingerprint").agg(F.min(F.struct("year", "embedding")).alias("v")).select(F.lit(model).alias("model"), "fingerprint", F.col("v.year").cast("int").alias("year"), F.col("v.embedding").cast("array<float>").alias("embedding"))
        rows = new.withColumn(BUCKET, key_bucket(F.col("fingerprint"), n))
        touched = [r[0] for r in rows.select(BUCKET).distinct().collect()]
        return self.table.commit(rows, touched, ["model", "year"], keep=True, buckets=n)

    def fill(self, papers: DataFrame, encode: Callable[[list[str]], object], model: str, **retries) -> DataFrame:
        """Encode and append what ``papers(fingerprint, year, text)`` lack; gives ``(fingerprint, error)`` of texts that failed, which a later call tries again."""
        lacking = self.missing(papers.where("fingerprint IS NOT NULL"), model).groupBy("fingerprint").agg(F.min(F.struct("year", "text")).alias("p")).select("fingerprint", "p.*")
        lacking = materialize(lacking, "lacking")
        found = materialize(encode_with_retries(lacking, encode, **retries), "encoded")
        self.append(found.where("error IS NULL").join(lacking.select("fingerprint", "year"), "fingerprint"), model)
        return found.where("error IS NOT NULL").select("fingerprint", "error")

    def compact(self, most: int = 4) -> Commit:
        """Buckets of more than ``most`` appends as one set each."""
        return self.table.compact(most, ["model", "year"])
