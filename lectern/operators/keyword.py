"""Literal search: predicates over normalised fields, scores, order."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.scoring import match_score
from lectern.functions.text import doi_selector, normalize, text_of, year_of
from lectern.operators.durable import spread
from lectern.plans.query import KeywordQuery, parse_expression

PREFIX = "_n_"


def plain(term: str) -> str:
    """The search form of a query's term, on the driver."""
    import unicodedata

    from lectern.functions.text import SYMBOLS

    for symbol, word in SYMBOLS.items():
        term = term.replace(symbol, word)
    term = "".join(c for c in unicodedata.normalize("NFKD", term) if not unicodedata.combining(c))
    term = re.sub("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", " ", term).lower()
    return re.sub("[^a-z0-9+]+", " ", term).strip()


def plain_doi(doi: str) -> str:
    """The search form of a query's DOI, on the driver."""
    return re.sub(r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "", doi.strip().lower()).strip()


def term_test(normal: Column, term: str) -> Column:
    """Whether a normalised text holds a term: phrases between blanks, single words as words."""
    t = plain(term)
    if not t:
        return F.lit(False)
    if " " in t:
        return F.concat(F.lit(" "), normal, F.lit(" ")).contains(f" {t} ")
    return normal.contains(t) & normal.rlike(rf"\b{re.escape(t)}\b")


def search_field(papers: DataFrame, name: str) -> Column:
    """The normalised text of a field, '' for a column that isn't there; ready fields of ``search_table`` as they are."""
    types = dict(papers.dtypes)
    if PREFIX + name in types:
        return F.col(PREFIX + name)
    if name == "authors" and name not in types:
        return normalize(F.concat_ws(" ", *(F.col(c) for c in ("first_author", "last_author") if c in types)))
    if name not in types:
        return F.lit("")
    if name == "doi":
        return doi_selector(name)
    if types[name].startswith("array"):
        listed = F.array_join(F.coalesce(F.col(name), F.array().cast("array<string>")), " ")
        if name == "authors" and ("first_author" in types or "last_author" in types):
            ends = F.concat_ws(" ", *(F.col(c) for c in ("first_author", "last_author") if c in types))
            listed = F.when(listed != "", listed).otherwise(ends)
        return normalize(listed)
    if name == "venue":
        return normalize(F.concat_ws(" ", *(F.col(c).cast("string") for c in ("venue", "venue_name", "venue_tier") if c in types)))
    return normalize(F.col(name).cast("string"))


def search_table(papers: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``papers`` with the normalised text of each field as columns, to be written once and searched often."""
    return papers.withColumns({PREFIX + name: search_field(papers, name) for name in fields})


def judged(query: KeywordQuery, test: Callable[[str, str], Column], title: Column | None, doi: Column | None) -> Column:
    """Struct (matched_fields, matched_terms) of a record that matches, else null.

    ``test(field, term)``: whether a field holds a term; ``title`` and ``doi``: whether the record is one of the selected ones.
    """
    conditions: list[Column] = []
    hit: dict[str, list[Column]] = {}
    terms: list[Column] = []
    if query.titles or query.dois:
        conditions.append(title | doi)
        hit.setdefault("title", []).append(title)
        hit.setdefault("doi", []).append(doi)
        terms += [F.when(title, "exact_title"), F.when(doi, "doi")]
    if query.authors:
        each = [test("authors", a) for a in query.authors]
        conditions.append(_any(each))
        hit.setdefault("authors", []).append(_any(each))
        terms.append(F.coalesce(*(F.when(t, F.lit(f"author:{a}")) for t, a in zip(each, query.authors))))

    def alternatives(label: str, options: list[str]) -> None:
        tests = [{n: test(n, t) for n in query.fields} for t in options]
        found = [_any(list(x.values())) for x in tests]
        conditions.append(_any(found))
        before = F.lit(False)
        for x, any_field in zip(tests, found):
            for n, one in x.items():
                hit.setdefault(n, []).append(one & ~before)
            before = before | any_field
        terms.append(F.coalesce(*(F.when(f, F.lit(f"{label}:{t}")) for f, t in zip(found, options))))

    for group in parse_expression(query.expression):
        alternatives("expression", group)
    for term in query.all_terms:
        alternatives("all_term", [term])
    if query.any_terms:
        alternatives("any_term", list(query.any_terms))
    order = [*query.fields, *(n for n in ("title", "doi", "authors") if n not in query.fields)]
    matched = F.array_compact(F.array(*(F.when(_any(hit[n]), F.lit(n)) for n in order if n in hit))) if hit else F.array().cast("array<string>")
    named = F.array_compact(F.array(*terms)) if terms else F.array().cast("array<string>")
    return F.when(all_of(conditions), F.struct(matched.alias("matched_fields"), named.alias("matched_terms")))


def fields_of(query: KeywordQuery) -> tuple[str, ...]:
    """The fields that a query reads."""
    return tuple(dict.fromkeys([*query.fields, *(["title", "doi"] if query.titles or query.dois else []), *(["authors"] if query.authors else [])]))


def match(papers: DataFrame, query: KeywordQuery) -> DataFrame:
    """Rows of ``papers`` that match, with ``matched_fields`` and ``matched_terms``.

    Title or DOI selectors, one of the authors, each group of the expression, all terms and
    one of the any-terms must match; the first alternative that matches is reported. Each
    field is normalised once a row: the tests read it from a struct that a generator binds,
    which the optimiser doesn't copy into every test.
    """
    needed = fields_of(query)

    def tested(fields: Column) -> Column:
        title = fields["title"].isin([plain(t) for t in query.titles] or [""]) & (fields["title"] != "") if query.titles or query.dois else None
        doi = fields["doi"].isin([plain_doi(d) for d in query.dois] or [""]) & (fields["doi"] != "") if query.titles or query.dois else None
        return judged(query, lambda n, t: term_test(fields[n], t), title, doi)

    normal = F.array(F.struct(*(search_field(papers, n).alias(n) for n in needed)))
    rows = papers.select("*", F.inline(F.array_compact(F.transform(normal, tested))))
    return rows.drop(*(c for c in rows.columns if c.startswith(PREFIX)))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def all_of(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def within(papers: DataFrame, years: tuple[int, int] | None = None, venues: tuple[str, ...] = (), venue: str = "venue") -> DataFrame:
    """Rows of the years (an unknown year is 0) and of the canonical venues."""
    if years:
        papers = papers.where(year_of(F.col("year").cast("string")).between(*years))
    return papers.where(F.col(venue).isin(list(venues))) if venues else papers


def search(papers: DataFrame, query: KeywordQuery, limit: int = 0, position: str = "position") -> DataFrame:
    """Matches by score, year and title, all descending; 0: all of them, else 1 to 5000."""
    if not 0 <= limit <= 5000:
        raise ValueError("limit must be from 0 to 5000")
    found = match(spread(within(papers, query.years, query.venues)), query)
    found = found.withColumn("exact_score", match_score(F.col("matched_fields")))
    ordered = found.orderBy(F.desc("exact_score"), F.desc(year_of(F.col("year").cast("string"))), F.desc(F.lower(text_of("title"))), position)
    return ordered.limit(limit) if limit else ordered


def compact(papers: DataFrame, characters: int) -> DataFrame:
    """Shorter abstracts, and whether they were cut."""
    return papers.withColumn("abstract_truncated", F.length("abstract") > characters).withColumn("abstract", F.substring("abstract", 1, characters))
