"""From raw documents to packed training sequences, in durable stages.

Each stage reads what the one before wrote. All but the last return the columns of
``documents``; columns beside these are not carried on, whatever their names.

Edge cases, stage by stage: an empty table gives an empty table. A null or empty text is
scored like any other by quality; near_dedup keeps one of them, and a row with a null doc_id
where no other text is like its own; decontam and pii keep such rows as they are; packing gives each a
piece that holds the end id. Texts of any length are read whole. Equal rows are one
document after near_dedup. Ties go to the smallest doc_id, then to the smallest hash of id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import drop_tables, materialize, temporary_tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects (score below 0.7); equal rows share their fate."""
    from lectern.llm.quality import keep_good

    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each component of near copies: fingerprints within two bits, or
    five-word shingle sets of 0.8 similarity; of rows with that id the one of the least hash, of equal rows one."""
    from lectern.llm.simhash import keep_representatives

    return keep_representatives(docs).select(*COLUMNS)


def decontam(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item; rows that share a doc_id are judged by their own texts."""
    from lectern.llm.decontam import decontaminate

    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by surrogates; n_chars follows the new text (null for a null one).

    The key is the session's ``lectern.pii.key``; without it each run draws its own.
    """
    from lectern.llm.pii import pseudonymize

    return pseudonymize(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of 2048 tokens; a null doc_id stays null."""
    from lectern.llm.packing import pack

    return pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontam", decontam), ("pii", pii), ("packing", packing)]

#: Classifier, fingerprints and tokenizer are beyond SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again.

    What a stage kept for itself is deleted once its output is committed, and so is the output of the one before.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held: list[str] = []
    for at, (name, stage) in enumerate(STAGES):
        with temporary_tables(spark) as made:
            docs = stage(spark, docs, sf_dir)
            if at < len(STAGES) - 1:
                docs = materialize(docs, f"stage-{name}")
        if at < len(STAGES) - 1:
            drop_tables(spark, [*made[:-1], *held])
            held = made[-1:]
    return docs
