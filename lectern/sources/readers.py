"""Readers of CSV exports, JSON records, feeds and article pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import distinct_values, squeeze, split_values, strip_tags, text_of

# Header names that tell sources apart.
REQUIRED = ["Document Title", "Abstract"]
EXPORT_SIGNALS = ["Date Added To Xplore", "IEEE Terms", "Article Citation Count", "Patent Citation Count", "Reference Count", "Document Identifier", "Publisher"]
GENERIC_SIGNALS = ["Authors", "Publication Year", "Publication Title", "DOI", "PDF Link", "Source URL"]


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as text; a byte-order mark before the first header goes."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8", mode="PERMISSIVE")
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))


def classify_headers(headers: Column) -> Column:
    """Kind of source of an array of header names."""
    has = lambda names: F.arrays_overlap(headers, F.lit(names))
    missing = F.size(F.array_except(F.lit(REQUIRED), headers)) > 0
    web = F.array_contains(headers, "Source URL") & (F.array_contains(headers, "Publication Title") | F.array_contains(headers, "Publication Year"))
    return F.when(missing, "unsupported").when(has(EXPORT_SIGNALS), "ieee_xplore").when(web, "web_grabber").when(has(GENERIC_SIGNALS), "generic_paper_source").otherwise("unsupported")


def header_names(line: Column) -> Column:
    """Names of a CSV header line; quoted ones may hold commas and doubled quotes."""
    cells = F.regexp_extract_all(line, F.lit(r'(?:^|,)(?:"((?:[^"]|"")*)"|([^",]*))'), F.lit(0))
    plain = F.transform(cells, lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^,", ""), r'^\s*"|"\s*$', ""), '""', '"'), r"\s+", " ")))
    return F.filter(plain, lambda c: c != "")


def cached_articles(rows: DataFrame, key: str = "url", position: str = "position") -> DataFrame:
    """The last row of each article that has a title and an abstract: what a new crawl needn't fetch again."""
    some = rows.where((squeeze("title") != "") & (squeeze("abstract") != "") & (F.col(key) != ""))
    return some.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), position).alias("r")).select(key, "r.*").select(*rows.columns)


def source_records(rows: DataFrame, position: str = "position") -> DataFrame:
    """CSV rows for a review of conflicts, without junk, with their row number in the file (the header is row 1).

    rows: title, abstract, source_file and their order in it.
    """
    from lectern.operators.filters import is_junk

    numbered = rows.withColumn("row_number", (F.row_number().over(Window.partitionBy("source_file").orderBy(position)) + 1).cast("int"))
    return numbered.where(~is_junk("title", "abstract"))


#: Bytes of a control file at most, as the driver reads it.
CONTROL_BYTES = 64 << 20


class ControlTooLarge(ValueError):
    pass


def load_control(spark: SparkSession, path: str, default):
    """A JSON control file, or ``default`` where it is missing or not JSON; one of over CONTROL_BYTES is an error."""
    import json

    try:
        found = spark.read.format("binaryFile").load(path).select("length").first()
        if found is not None and found["length"] > CONTROL_BYTES:
            raise ControlTooLarge(f"{path} has {found['length']} bytes")
        return json.loads(spark.read.text(path, wholetext=True).first()["value"])
    except ControlTooLarge:
        raise
    except Exception:  # noqa: BLE001 - missing and broken files are alike here
        return default


MANIFEST = "path string, size long, modificationTime timestamp, sha1 string, kind string, category string"


def manifest(spark: SparkSession, folder: str, former: DataFrame | None = None) -> DataFrame:
    """One row a CSV file: size, time, digest, kind, and the first file with the same content.

    Names, sizes and times come from a listing. Only files that ``former``, an earlier manifest, doesn't have with the same size and
    time are opened; the driver holds their names.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
    listed = files.load(folder).select("path", F.col("length").alias("size"), "modificationTime")
    known = spark.createDataFrame([], MANIFEST)
    if former is not None:
        known = listed.join(former.select(*known.columns), ["path", "size", "modificationTime"]).select(*known.columns)
        changed = [r["path"] for r in listed.join(known.select("path"), "path", "left_anti").collect()]
        files = files.load(changed) if changed else None
    else:
        files = files.load(folder)
    if files is not None:
        headers = header_names(F.regexp_extract(F.decode(F.substr("content", F.lit(1), F.lit(65_536)), "UTF-8"), r"^\ufeff?([^\r\n]*)", 1))
        name = F.element_at(F.split("path", "/"), -1)
        opened = files.select("path", F.col("length").alias("size"), "modificationTime", F.sha1("content").alias("sha1"), classify_headers(headers).alias("kind"), F.when(F.lower(name).startswith("export"), "export").otherwise("other").alias("category"))
        known = known.unionByName(opened)
    valid = F.col("kind") != "unsupported"
    first = F.first(F.when(valid, F.col("path")), True).over(Window.partitionBy("sha1").orderBy("path").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return known.withColumn("duplicate_of", F.when(valid & (first != F.col("path")), first)).withColumn("valid", valid & F.col("duplicate_of").isNull())


def read_records(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Rows of JSON files that are a list, or hold one as results, papers or decisions."""
    text = spark.read.text(path, wholetext=True)
    parse = lambda p: F.from_json(p, f"array<struct<{schema}>>")
    parts = [parse(F.get_json_object("value", f"$.{n}")) for n in ("results", "papers", "decisions")]
    listed = F.when(F.ltrim("value").startswith("["), parse(F.col("value"))).otherwise(F.coalesce(*parts))
    return text.select(F.explode(listed).alias("r")).where("r is not null").select("r.*")


FEED = "entry array<struct<id:string,title:string,summary:string,published:string,updated:string,author:array<struct<name:string>>,category:array<struct<_term:string>>,`arxiv:doi`:string,`arxiv:journal_ref`:string>>"


def parse_feed(feeds: DataFrame, start: str | None = None, column: str = "feed") -> DataFrame:
    """One row an entry of Atom feeds, without entries that lack id, title or abstract or are older than ``start``."""
    entries = feeds.select(F.explode(F.from_xml(column, FEED)["entry"]).alias("e")).select("e.*")
    day = F.coalesce(F.nullif(text_of("updated"), F.lit("")), F.col("published"))
    rows = entries.select(
        F.regexp_replace(F.element_at(F.split(text_of("id"), "/abs/"), -1), r"v[0-9]+$", "").alias("feed_id"), squeeze("title").alias("title"), squeeze("summary").alias("abstract"),
        F.to_date(F.substr(day, F.lit(1), F.lit(10))).alias("effective_date"), F.transform("author", lambda a: squeeze(a["name"])).alias("authors"),
        F.array_sort(F.array_distinct(F.transform("category", lambda c: c["_term"]))).alias("keywords"), text_of("`arxiv:doi`").alias("doi"),
    )
    rows = rows.where("feed_id <> '' and title <> '' and abstract <> ''")
    return rows.where(F.col("effective_date") >= F.lit(start).cast("date")) if start else rows


def article_links(html: Column | str, mark: str = "/articles/", base: str = "") -> Column:
    """Distinct links of a search page that hold ``mark``, without queries, in order."""
    links = F.regexp_extract_all(text_of(html), F.lit(r'<a\b[^>]*?href="([^"]*)"[^>]*>(?=\s*(?:<[^>]*>\s*)*[^<\s])'), F.lit(1))
    clean = F.transform(F.filter(links, lambda u: u.contains(mark)), lambda u: F.regexp_replace(u, r"[?#].*$", ""))
    return F.array_distinct(F.transform(clean, lambda u: F.when(u.startswith("/"), F.concat(F.lit(base), u)).otherwise(u)))


def meta(html: Column | str, name: str) -> Column:
    """Contents of all meta tags of a name."""
    import re

    return F.regexp_extract_all(text_of(html), F.lit(rf'(?i)<meta\b[^>]*?name="{re.escape(name)}"[^>]*?content="([^"]*)"'), F.lit(1))


def article_fields(html: Column | str) -> list[Column]:
    one = lambda name: F.coalesce(F.get(meta(html, name), F.lit(0)), F.lit(""))
    words = F.flatten(F.transform(F.concat(meta(html, "keywords"), meta(html, "dc.subject")), lambda k: F.split(k, "[;,]")))
    return [
        squeeze(one("dc.title")).alias("title"), strip_tags(one("dc.description")).alias("abstract"), one("prism.publicationName").alias("venue"), one("citation_doi").alias("doi"),
        F.substr(one("dc.date"), F.lit(1), F.lit(4)).alias("year"), meta(html, "dc.creator").alias("authors"), F.array_distinct(F.filter(F.transform(words, lambda x: F.trim(x)), lambda w: w != "")).alias("keywords"),
    ]


ITEM = "title:array<string>,`container-title`:array<string>,abstract:string,DOI:string,URL:string,subject:array<string>,author:array<struct<given:string,family:string>>,`published-print`:struct<`date-parts`:array<array<int>>>,`published-online`:struct<`date-parts`:array<array<int>>>,published:struct<`date-parts`:array<array<int>>>,issued:struct<`date-parts`:array<array<int>>>"


def parse_items(items: DataFrame, column: str = "item") -> DataFrame:
    """Rows of an API's JSON items: first title and container, authors, first date there is."""
    r = items.select(F.from_json(column, f"struct<{ITEM}>").alias("i")).select("i.*")
    year = F.coalesce(*(F.get(F.get(F.col(f"`{n}`.`date-parts`"), F.lit(0)), F.lit(0)) for n in ("published-print", "published-online", "published", "issued")))
    link = F.coalesce(F.nullif(text_of("URL"), F.lit("")), F.concat(F.lit("https://doi.org/"), "DOI"))
    return r.select(
        strip_tags(F.get("title", F.lit(0))).alias("title"), strip_tags("abstract").alias("abstract"), strip_tags(F.get("`container-title`", F.lit(0))).alias("venue"), text_of("DOI").alias("doi"),
        year.cast("string").alias("year"), F.transform("author", lambda a: squeeze(F.concat_ws(" ", a["given"], a["family"]))).alias("authors"), F.coalesce("subject", F.array().cast("array<string>")).alias("keywords"), link.alias("url"),
    )


# The columns of an export, and the record fields that they fill.
CSV_FIELDS = {
    "title": "Document Title", "abstract": "Abstract", "year": "Publication Year", "venue": "Publication Title", "doi": "DOI", "pdf_link": "PDF Link", "volume": "Volume", "number": "Issue", "issue": "Issue",
    "start_page": "Start Page", "end_page": "End Page", "issn": "ISSN", "isbn": "ISBNs", "publisher": "Publisher", "document_identifier": "Document Identifier", "date_added_to_xplore": "Date Added To Xplore",
    "online_date": "Online Date", "issue_date": "Issue Date", "meeting_date": "Meeting Date", "funding_information": "Funding Information", "article_citation_count": "Article Citation Count",
    "patent_citation_count": "Patent Citation Count", "reference_count": "Reference Count", "license": "License",
}
CSV_LISTS = {"authors": "Authors", "keywords": "Author Keywords", "ieee_terms": "IEEE Terms"}


def csv_to_records(rows: DataFrame) -> DataFrame:
    """Records of CSV rows with the usual headers: 24 texts, three lists, both ends of the authors, pages and the article's number; what is absent is empty."""
    c = lambda n: squeeze(n) if n in rows.columns else F.lit("")
    number = F.coalesce(*(F.nullif(c(n), F.lit("")) for n in ("Article Number", "Document Number", "Accession Number")), F.regexp_extract(c("PDF Link"), r"(?:arnumber=|/document/)([0-9]+)", 1))
    pages = F.concat_ws("-", F.nullif(c("Start Page"), F.lit("")), F.nullif(c("End Page"), F.lit("")))
    listed = {name: distinct_values(F.transform(split_values(c(header)), squeeze)) for name, header in CSV_LISTS.items()}
    ends = [F.coalesce(F.try_element_at(listed["authors"], F.lit(i)), F.lit("Unknown")).alias(n) for n, i in (("first_author", 1), ("last_author", -1))]
    return rows.select(*(c(header).alias(name) for name, header in CSV_FIELDS.items()), *(v.alias(n) for n, v in listed.items()), *ends, pages.alias("pages"), number.alias("article_number"))
