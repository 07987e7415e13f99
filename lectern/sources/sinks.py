"""Exports: CSV, BibTeX, reports and response documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import text_of, year_of
from lectern.operators.durable import ranked


def export_rows(papers: DataFrame) -> DataFrame:
    return papers.select(F.col("title").alias("Title"), F.array_join("authors", "; ").alias("Authors"), F.col("year").alias("Year"), F.col("venue").alias("Venue"), F.col("doi").alias("DOI"), F.col("abstract").alias("Abstract"))


def write_csv(df: DataFrame, path: str) -> None:
    """One commit: readers see the whole new output or the old one."""
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def bibtex(c=F.col) -> Column:
    """BibTeX entry of a record; empty fields are left out."""
    text = lambda n: F.trim(F.regexp_replace(text_of(c(n)), "\n", " "))
    suffix = F.element_at(F.split(text("doi"), "/"), -1)
    authors = F.coalesce(c("authors"), F.array().cast("array<string>"))
    last = F.regexp_replace(F.element_at(F.split(F.coalesce(F.get(authors, F.lit(0)), F.lit("Anon")), " "), -1), "-", "")
    word = F.initcap(F.get(F.split(F.trim(F.regexp_replace(text("title"), r"[^a-zA-Z0-9\s]", "")), r"\s+"), F.lit(0)))
    key = F.when(text("article_number") != "", F.regexp_replace(text("article_number"), "[^A-Za-z0-9:_-]", "")).when(suffix.rlike("^[A-Za-z0-9._:-]+$"), suffix).otherwise(F.concat(last, year_of(c("year").cast("string")).cast("string"), word))
    venue = F.lower(text("venue"))
    kind = F.when(F.lower(text("document_identifier")).contains("conference") | venue.contains("conference") | venue.contains("symposium"), "INPROCEEDINGS").otherwise("ARTICLE")
    pages = F.when(text("pages") != "", text("pages")).otherwise(F.concat_ws("-", F.nullif(text("start_page"), F.lit("")), F.nullif(text("end_page"), F.lit(""))))
    none = F.array().cast("array<string>")
    terms = F.filter(F.transform(F.concat(F.coalesce(c("ieee_terms"), none), F.coalesce(c("keywords"), none)), lambda x: F.trim(x)), lambda x: x != "")
    words = F.array_join(F.array_distinct(terms), ";")
    line = lambda n, v: F.when(v != "", F.concat(F.lit("  "), n if isinstance(n, Column) else F.lit(n), F.lit("={"), v, F.lit("}")))
    fields = [
        line("author", F.array_join(authors, " and ")), line(F.when(kind == "INPROCEEDINGS", "booktitle").otherwise("journal"), text("venue")), line("title", text("title")), line("year", text_of(c("year").cast("string"))),
        line("volume", text("volume")), line("number", F.coalesce(F.nullif(text("number"), F.lit("")), text("issue"))), line("pages", pages), line("keywords", words), line("doi", text("doi")),
    ]
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.concat_ws(",\n", *fields), F.lit("\n}\n"))


def report_order(papers: DataFrame, position: str = "position") -> DataFrame:
    """``papers`` numbered by venue, year and title; the numbers come from a sort by ranges, not from one task."""
    return ranked(papers, [F.lower(text_of("venue")), year_of(F.col("year").cast("string")), F.lower(text_of("title")), F.col(position)], "number")


def report_sections(papers: DataFrame, position: str = "position") -> DataFrame:
    """Numbered sections by venue, year and title; empty fields are left out."""
    line = lambda label, v: F.when(v != "", F.concat(F.lit(f"{label}: "), v))
    body = F.concat_ws("\n", F.concat(F.col("number").cast("string"), F.lit(". "), text_of("title")), line("Authors", F.array_join("authors", "; ")), line("Venue", text_of("venue")), line("Year", text_of(F.col("year").cast("string"))), line("DOI", text_of("doi")), line("Abstract", text_of("abstract")))
    return report_order(papers, position).select("number", body.alias("section"))


def response(hits: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON document a hit, as it goes out."""
    return hits.select("rank", F.to_json(F.struct("rank", *columns)).alias("document"))
