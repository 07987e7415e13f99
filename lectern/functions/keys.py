"""Identity keys. Each use has its own rule; they are not interchangeable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import doi_selector, loose_doi, loose_title, normalize, squeeze, text_of, year_of


def _tagged(tag: str, *parts: Column, sign: str = "|") -> Column:
    return F.concat(F.lit(tag), F.concat_ws(sign, *parts))


def publication_key(doi="doi", title="title", year="year", authors="authors", venue="venue", abstract="abstract") -> Column:
    """DOI, else title and year, else title, else a digest of the other fields."""
    d, t, y = doi_selector(doi), normalize(title), year_of(year)
    rest = F.concat_ws("|", F.array_join(F.coalesce(F.col(authors), F.array().cast("array<string>")), ";"), text_of(venue), text_of(year), text_of(abstract))
    return (
        F.when(d != "", F.concat(F.lit("doi:"), d)).when((t != "") & (y > 0), _tagged("title_year:", t, y.cast("string")))
        .when(t != "", F.concat(F.lit("title:"), t)).otherwise(F.concat(F.lit("metadata:"), F.substr(F.sha1(rest.cast("binary")), F.lit(1), F.lit(16))))
    )


def identity_levels(doi="doi", title="title", year="year") -> Column:
    """All keys of a record, strongest first."""
    d, t, y = loose_doi(doi), loose_title(title), squeeze(year)
    return F.array_compact(F.array(
        F.when(d != "", _tagged("doi::", d)), F.when((t != "") & (y != ""), _tagged("title_year::", t, y, sign="::")), F.when(t != "", _tagged("title::", t)),
    ))


def identity_key(doi="doi", title="title", year="year") -> Column:
    """The strongest key of a record, '' without any."""
    return F.coalesce(F.get(identity_levels(doi, title, year), F.lit(0)), F.lit(""))


def snapshot_key(doi="doi", title="title", year="year", venue="venue") -> Column:
    """As ``identity_key``, without the DOI of textbooks, whose parts share one."""
    levels = identity_levels(doi, title, year)
    book = F.lower(text_of(venue)).contains("textbook")
    levels = F.when(book, F.filter(levels, lambda k: ~k.startswith("doi::"))).otherwise(levels)
    return F.coalesce(F.get(levels, F.lit(0)), F.lit(""))


def match_key(doi="doi", title="title", year="year", fingerprint="fingerprint") -> Column:
    """Key of a search candidate: upper-case DOI, title and year, title, fingerprint."""
    d, t, y = F.upper(squeeze(doi)), F.lower(squeeze(title)), squeeze(year)
    return F.when(d != "", _tagged("doi:", d)).when((t != "") & (y != ""), _tagged("title_year:", t, y)).when(t != "", _tagged("title:", t)).otherwise(_tagged("fingerprint:", text_of(fingerprint)))


def detail_key(doi="doi", title="title", year="year") -> Column:
    d = doi_selector(doi)
    return F.when(d != "", _tagged("doi:", d)).otherwise(_tagged("title_year:", normalize(title), year_of(year).cast("string")))


def staging_key(doi="doi", url="url", title="title", year="year") -> Column:
    d, u = loose_doi(doi), F.lower(squeeze(url))
    return F.when(d != "", _tagged("doi:", d)).when(u != "", _tagged("url:", u)).otherwise(_tagged("title:", loose_title(title), squeeze(year)))


def state_key(doi="doi", title="title", year="year") -> Column:
    d, t, y = F.upper(squeeze(doi)), squeeze(title), squeeze(year)
    return F.when(d != "", d).when((t != "") & (y != ""), F.concat_ws("|", t, y)).otherwise(t)


def curation_key(doi="doi", title="title") -> Column:
    d = loose_doi(doi)
    return F.when(d != "", _tagged("doi::", d)).otherwise(_tagged("title::", loose_title(title)))


def fingerprint(title="title", abstract="abstract") -> Column:
    """SHA-1 of the text that is embedded: title and abstract."""
    return F.sha1(F.trim(F.concat(text_of(title), F.lit(" "), text_of(abstract))).cast("binary"))


def record_fingerprint(columns: list[str]) -> Column:
    """SHA-1 of the JSON of all columns in the order of their names."""
    return F.sha1(F.to_json(F.struct(*sorted(columns))).cast("binary"))


# The fields whose change makes a record another one, in order; lists count as they are.
SIGNATURE = (
    "title abstract year venue doi pdf_link authors keywords ieee_terms volume number issue start_page end_page pages issn isbn publisher document_identifier date_added_to_xplore online_date issue_date"
    " meeting_date funding_information article_citation_count patent_citation_count reference_count license article_number"
).split()


def record_signature(types: dict[str, str]) -> Column:
    """SHA-1 of a record's SIGNATURE fields, texts squeezed; ``types``: those of its columns, of which absent ones count as empty."""
    empty = F.array().cast("array<string>")

    def part(name: str) -> Column:
        listed = name in ("authors", "keywords", "ieee_terms")
        if name not in types:
            return empty if listed else F.lit("")
        return F.coalesce(F.col(name).cast("array<string>"), empty) if listed else squeeze(F.col(name).cast("string"))

    return F.sha1(F.to_json(F.struct(*(part(n).alias(n) for n in SIGNATURE))).cast("binary"))
