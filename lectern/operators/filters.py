"""Junk, relevance and record-type rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import loose_doi, loose_title, squeeze, text_of

# Titles and words that mark records that aren't papers.
ADMINISTRATIVE_TITLES = [
    "information for authors",
    "ieee journal of solid state circuits",
    "introducing ieee collabratec",
    "techrxiv share your preprint research with the world",
    "ieee transactions on microwave theory and techniques publication information",
    "ieee transactions on microwave theory and techniques information for authors",
    "ieee transactions on circuits and systems i regular papers information for authors",
    "ieee transactions on circuits and systems i regular papers publication information",
    "ieee circuits and systems society information",
    "ieee journal of solid state circuits information for authors",
    "ieee journal of solid state circuits publication information",
    "ieee open access publishing",
    "ceda currents ieee news",
    "contributors",
    "copyright notice",
    "title page",
    "staff list",
    "society listing",
    "patent abstracts",
    "new associate editor",
]
HARD_JUNK = [
    "table of contents", "front cover", "back cover", "frontmatter", "author index", "message from", "call for papers", "committee list", "reviewers list", "index of authors",
    "issue information", "editor's note", "list of reviewers", "masthead", "advertisement", "publisher's note", "information for authors", "publication information",
]
USEFUL_INTRODUCTIONS = ["introduction", "overview", "technical session", "plenary session", "session", "tutorial", "forum", "keynote", "panel", "invited", "special issue on", "guest editorial"]
SOFT_JUNK = ["guest editorial", "editorial:", "special issue on", "special event", "student research preview", "srp", "technical session", "plenary session"]
NO_ABSTRACT = ["", "na", "n/a", "no abstract available.", "no abstract"]


def _has(title: Column, words: list[str]) -> Column:
    """Short words as words, others anywhere."""
    out = F.lit(False)
    for w in words:
        out = out | (title.rlike(rf"\b{re.escape(w)}\b") if w.isalnum() and len(w) <= 4 else title.contains(w))
    return out


def is_junk(title: Column | str, abstract: Column | str, doi: Column | str | None = None, administrative: list[str] = ADMINISTRATIVE_TITLES) -> Column:
    """First rule that fits decides; ``administrative`` may name more exact titles."""
    t, a = F.lower(text_of(title)), F.lower(squeeze(abstract))
    with_doi = loose_doi(doi) != "" if doi is not None else F.lit(False)
    none = a.isin(NO_ABSTRACT)
    return (
        F.when(loose_title(title).isin(administrative), True).when(_has(t, HARD_JUNK), True)
        .when(with_doi & _has(t, USEFUL_INTRODUCTIONS) & ~none & (F.length(a) >= 30), False)
        .when(_has(t, SOFT_JUNK), True).when((F.length(a) < 50) | none, True).otherwise(False)
    )


def importable(title: Column | str, abstract: Column | str) -> Column:
    return (squeeze(title) != "") & (squeeze(abstract) != "") & (squeeze(abstract) != "NA")


def labels(title: Column | str, text: Column, scopes: dict[str, dict[str, list[str]]], veto: list[str] = ()) -> Column:
    """Array of the scopes whose terms occur, in their order; none where a veto term occurs.

    scopes: name -> {any: terms of title or text, title: terms of the title, title_all:
    a second list of which one must be in the title too, without: terms that mustn't}.
    """
    t, whole = F.lower(text_of(title)), F.lower(F.concat_ws(" ", text_of(title), text))
    has = lambda c, words: c.rlike("|".join(re.escape(w) for w in words)) if words else F.lit(False)
    found = []
    for name, rule in scopes.items():
        test = has(whole, rule.get("any", [])) | (has(t, rule.get("title", [])) & (has(t, rule["title_all"]) if rule.get("title_all") else F.lit(True)) & ~has(t, rule.get("without", [])))
        found.append(F.when(test, F.lit(name)))
    return F.when(has(whole, list(veto)), F.slice(F.array(F.lit("")), 1, 0)).otherwise(F.array_compact(F.array(*found)))


def relevant(found: Column, scopes: list[str]) -> Column:
    return F.arrays_overlap(found, F.lit(scopes))
