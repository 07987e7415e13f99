"""The registered queries of the operators: each reads its whole table under ``sf_dir``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import audit
from lectern.llm.urls import oracle_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back by byte ranges."""
    from lectern.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicate components of all documents."""
    from lectern.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it leaks."""
    from lectern.llm.decontam import find_leaks

    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "position", "windows")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harmonic packing of all documents into sequences of 2048 tokens."""
    from lectern.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors to each hundredth one."""
    from lectern.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL by rules, else by the n-gram model."""
    from lectern.llm.urls import judge

    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by regularised quadratic discriminants."""
    from lectern.llm.quality import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for personal data, and what kinds were replaced."""
    from lectern.llm.pii import pseudonymize

    found = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.size("pii_kinds").alias("n_entities"), F.array_join("pii_kinds", ",").alias("kinds"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document by deleted interpolation."""
    from lectern.llm.lm import score

    return score(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, without what its site repeats."""
    from lectern.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters does to each part of all documents, in every order."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit packing of all documents into few sequences of 2048 tokens; only longer documents are cut."""
    from lectern.llm.bestfit import pack

    return pack(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers aligned in every document, with corpus-wide counts of their pairs."""
    from lectern.llm.alignment import align_documents

    return align_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_simhash": op2_simhash,
    "op3_decontam": op3_decontam,
    "op4_packing": op4_packing,
    "op5_ann": op5_ann,
    "op6_urls": op6_urls,
    "op7_quality": op7_quality,
    "op8_pii": op8_pii,
    "op9_lm": op9_lm,
    "op10_html": op10_html,
    "op11_audit": op11_audit,
    "op12_bestfit": op12_bestfit,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op6_urls": oracle_sql(),
    "op11_audit": audit.oracle_sql(),
    "op1_warc": """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS hex, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages
), d AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d""",
}
