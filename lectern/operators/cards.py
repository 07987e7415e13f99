"""What a search shows: orders, cards, views, response documents, packs and reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.keys import detail_key, state_key
from lectern.functions.scoring import badge, paper_score
from lectern.functions.text import doi_link, split_values, text_of, year_of
from lectern.operators.fusion import last_wins
from lectern.plans.query import parse_expression

#: Columns of the short view of a result.
TITLES = (
    "rank", "similarity", "title", "authors", "venue", "year", "doi", "doi_link", "pdf_link", "source_links", "source_in_current_corpus", "abstract_kind",
    "llm_score", "llm_reason", "exact_score", "matched_fields", "matched_terms",
)


def authors_display(papers: DataFrame) -> Column:
    """The list of authors, else first and last author, else Unknown."""
    types = dict(papers.dtypes)
    listed = F.lit(None).cast("array<string>")
    if "authors" in types:
        listed = F.col("authors") if types["authors"].startswith("array") else split_values("authors")
    listed = F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda a: F.trim(a) != "")
    ends = F.array_distinct(F.array_compact(F.array(*(F.nullif(F.trim(text_of(c)), F.lit("")) for c in ("first_author", "last_author") if c in types)))) if {"first_author", "last_author"} & set(types) else F.array().cast("array<string>")
    return F.coalesce(F.nullif(F.array_join(listed, ", "), F.lit("")), F.nullif(F.array_join(F.filter(ends, lambda a: a != "Unknown"), ", "), F.lit("")), F.lit("Unknown"))


def terms_display(values: Column) -> Column:
    """Distinct terms in their order, case kept."""
    clean = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.array_distinct(F.coalesce(clean, F.array().cast("array<string>"))), "; ")


def highlight_terms(expression: str) -> list[str]:
    """All alternatives of all groups of an expression, in order."""
    return list(dict.fromkeys(t for group in parse_expression(expression) for t in group))


def highlight_any(value: Column | str, terms: list[str], before: str = "<mark>", after: str = "</mark>") -> Column:
    """Marks each appearance of any of the terms, longer ones first, whatever signs lie between their words."""
    words = [re.findall(r"[A-Za-z0-9+]+", t) for t in terms]
    patterns = sorted({r"[^A-Za-z0-9+]*".join(map(re.escape, w)) for w in words if w}, key=lambda p: (-len(p), p))
    if not patterns:
        return text_of(value)
    return F.regexp_replace(text_of(value), f"(?i)(?<![A-Za-z0-9])({'|'.join(patterns)})(?![A-Za-z0-9])", f"{before}$1{after}")


def result_order(hits: DataFrame, order: str, score: Column | None = None, has_query: bool = True, position: str = "position") -> DataFrame:
    """``year``: by year and similarity, descending. ``comprehensive``: by ``score``, without
    weak hits of a query (similarity below 0.25). Anything else: as it was."""
    if order == "year":
        return hits.orderBy(F.desc(year_of(F.col("year").cast("string"))), F.desc("similarity"), position)
    if order == "comprehensive":
        some = hits.where("similarity >= 0.25") if has_query else hits
        return some.withColumn("comp_score", score).orderBy(F.desc("comp_score"), position)
    return hits.orderBy(position)


def with_citations(papers: DataFrame, citations: DataFrame) -> DataFrame:
    """``papers`` with ``citation_count`` by upper-case DOI from ``citations(doi, citations)``, 0 where none is known."""
    known = citations.groupBy(F.upper(F.trim("doi")).alias("_doi")).agg(F.max("citations").alias("citation_count"))
    own = papers.withColumn("_doi", F.nullif(F.upper(F.trim(text_of("doi"))), F.lit("")))
    return own.join(known, "_doi", "left").drop("_doi").withColumn("citation_count", F.coalesce("citation_count", F.lit(0)))


def with_user_state(papers: DataFrame, states: DataFrame) -> DataFrame:
    """``papers`` with rating, comments and counters of ``states(state_key, rating, comments, open_count, search_count)``."""
    joined = papers.withColumn("state_key", state_key()).join(states, "state_key", "left")
    empty = {"rating": F.lit("Unrated"), "comments": F.lit(""), "open_count": F.lit(0), "search_count": F.lit(0)}
    return joined.withColumns({c: F.coalesce(F.col(c), v) for c, v in empty.items()})


def cards(hits: DataFrame, terms: list[str], now: int, has_query: bool = True) -> DataFrame:
    """Columns of result cards.

    hits: rank, similarity, title, abstract, venue, venue_score, year, doi, citation_count and,
    if there are any, authors, first and last author, llm_score, rating and comments.
    """
    have = set(hits.columns)
    year = year_of(F.col("year").cast("string"))
    total = paper_score(F.col("venue_score"), year, F.col("citation_count"), now)
    delta = F.col("llm_score") - 100 * F.col("similarity") if "llm_score" in have else F.lit(None).cast("double")
    marked = lambda c: highlight_any(c, terms)
    return hits.select(
        "rank", marked(F.coalesce("title", F.lit("Untitled"))).alias("title_html"), F.replace(marked(F.coalesce("abstract", F.lit("No abstract"))), F.lit("\n"), F.lit("<br>")).alias("abstract_html"),
        marked(authors_display(hits)).alias("authors_html"), F.col("venue"), year.alias("year"), "doi", doi_link("doi").alias("doi_link"),
        F.format_string("%.1f", F.col("similarity").cast("double") * 100).alias("similarity_percent"), badge(F.col("similarity"), has_query).alias("badge"), F.format_string("%.1f", total.cast("double")).alias("score_text"),
        F.when(delta.isNotNull(), F.format_string("%+.1f", delta.cast("double"))).otherwise("").alias("rerank_delta"), "citation_count", *(F.col(c) for c in ("rating", "comments") if c in have),
    )


def view(results: DataFrame, name: str = "standard") -> DataFrame:
    if name not in ("standard", "titles"):
        raise ValueError("a view is 'titles' or 'standard'")
    return results if name == "standard" else results.select(*(c for c in results.columns if c in TITLES))


def response_document(results: DataFrame, query: str, mode: str, filters: dict, candidates: int, name: str = "standard") -> DataFrame:
    """One JSON document: query, filters as given, counts and the ranked results of a limited search."""
    some = view(results, name)
    listed = some.agg(F.array_sort(F.collect_list(F.struct("rank", *(c for c in some.columns if c != "rank")))).alias("results"))
    echo = F.struct(*(F.lit(v).alias(k) for k, v in sorted(filters.items()))) if filters else F.struct(F.lit(None).alias("none"))
    return listed.select(F.to_json(F.struct(
        F.lit(mode).alias("mode"), F.lit(query).alias("query"), F.lit(name).alias("result_view"), echo.alias("filters"), F.lit(candidates).alias("candidate_count"),
        F.size("results").alias("result_count"), "results",
    )).alias("document"))


def attach_details(hits: DataFrame, matches: DataFrame) -> DataFrame:
    """Semantic hits with the matched fields and terms of a literal search of the same records, the last of equal ones."""
    details = matches.select(detail_key().alias("_detail"), "position", "matched_fields", "matched_terms")
    one = last_wins(details, ["_detail"], "position").drop("position")
    return hits.withColumn("_detail", detail_key()).join(one, "_detail", "left").drop("_detail")


def rerank_candidates(hits: DataFrame, limit: int) -> DataFrame:
    """What a reranker reads of the first hits: twelve terms, 900 characters of abstract."""
    listed = lambda c: F.array_join(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, 12), "; ")
    return hits.where(F.col("rank") <= limit).select(
        F.col("rank").alias("id"), "title", "venue", "year", listed(F.col("keywords")).alias("keywords"), listed(F.col("ieee_terms")).alias("ieee_terms"),
        F.substring("abstract", 1, 900).alias("abstract"), F.round("similarity", 4).alias("semantic_similarity"),
    )


def conflict_item(records: DataFrame) -> DataFrame:
    """A source record as a review of conflicts shows it."""
    return records.select("title", "year", "doi", "venue", F.substring(text_of("abstract"), 1, 220).alias("abstract_preview"), "source_file", "row_number")


def conflict_order(found: DataFrame) -> DataFrame:
    return found.orderBy("kind", F.lower("headline"), "id")


def provenance(c=F.col) -> Column:
    """Struct: where a record and its abstract come from."""
    return F.struct(
        F.coalesce(c("source_in_current_corpus"), F.lit(False)).alias("source_in_current_corpus"), F.when(text_of(c("abstract")) != "", "source_abstract").otherwise("missing").alias("abstract_kind"),
        doi_link(c("doi")).alias("doi_link"), text_of(c("pdf_link")).alias("pdf_link"), text_of(c("url")).alias("source_url"),
    )


def evidence_text(papers: DataFrame) -> Column:
    """All texts that may hold evidence, between blanks."""
    types = dict(papers.dtypes)
    names = "title abstract abstract_summary technology_process physical_temperature record_type frequency_range_ghz lna_band_ghz system_band_ghz keywords ieee_terms".split()
    one = lambda n: F.array_join(F.coalesce(F.col(n), F.array().cast("array<string>")), " ") if types[n].startswith("array") else text_of(F.col(n).cast("string"))
    return F.concat(F.lit(" "), F.concat_ws(" ", *(one(n) for n in names if n in types)), F.lit(" "))


def context_pack(papers: DataFrame, label: str) -> DataFrame:
    """``(rank, section)`` of a Markdown pack: 0 the heading, then a section a paper with rating and comments."""
    note = F.when(text_of("comments") != "", F.concat(F.lit("- **My Comments:** "), F.col("comments"), F.lit("\n"))).otherwise("")
    body = F.concat(
        F.lit("## "), text_of("title"), F.lit("\n- **Authors:** "), authors_display(papers), F.lit("\n- **Venue & Year:** "), text_of("venue"), F.lit(" ("), text_of(F.col("year").cast("string")), F.lit(")\n- **My Rating:** "),
        F.coalesce("rating", F.lit("Unrated")), F.lit("\n"), note, F.lit("### Abstract\n"), text_of("abstract"), F.lit("\n\n---\n"),
    )
    head = papers.sparkSession.range(1).select(F.lit(0).alias("rank"), F.lit(f"# Papers Context for '{label}'\n").alias("section"))
    return head.unionByName(papers.select(F.col("rank").cast("int").alias("rank"), body.alias("section")))


def html_report(shown: DataFrame, limit: int = 50) -> DataFrame:
    """``(rank, html)``: one block for each of the first cards."""
    safe = lambda c: F.replace(F.replace(text_of(c), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    link = F.when(F.col("doi_link") != "", F.concat(F.lit('<a href="'), safe(F.col("doi_link")), F.lit('">'), text_of("doi"), F.lit("</a>"))).otherwise("")
    delta = F.when(F.col("rerank_delta") != "", F.concat(F.lit('<span class="delta">'), F.col("rerank_delta"), F.lit("</span>"))).otherwise("")
    block = F.concat(
        F.lit('<article><h2>'), F.col("rank").cast("string"), F.lit(". "), F.col("title_html"), F.lit('</h2><p class="badge">'), F.col("badge"), F.lit(" "), F.col("similarity_percent"), F.lit("% "), F.col("score_text"), delta,
        F.lit("</p><p>"), F.col("authors_html"), F.lit("</p><p>"), text_of("venue"), F.lit(", "), F.col("year").cast("string"), F.lit(" "), link, F.lit("</p><p>"), F.col("abstract_html"), F.lit("</p></article>"),
    )
    return shown.where(F.col("rank") <= limit).select("rank", block.alias("html"))


def batch_select(hits: DataFrame, mode: str, has_query: bool, threshold: float = 0.25) -> DataFrame:
    """Hits with ``selected``: by threshold, rare (0.60 and more), perfect (0.40 and more), valuable (0.25 to 0.40, only of a query), none.

    Without a query the first three take all.
    """
    s = F.col("similarity")
    tests = {"threshold": s >= threshold, "rare": s >= 0.60, "perfect": s >= 0.40}
    if mode in tests:
        test = tests[mode] if has_query else F.lit(True)
    elif mode == "valuable":
        test = (s >= 0.25) & (s < 0.40) & F.lit(has_query)
    elif mode == "none":
        test = F.lit(False)
    else:
        raise ValueError(f"unknown selection {mode!r}")
    return hits.withColumn("selected", test)
