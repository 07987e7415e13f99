"""Scores, badges, venue rules and bands."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import squeeze, text_of

# Weight of each field that a literal query matched.
FIELD_WEIGHTS = {"title": 100, "authors": 90, "keywords": 70, "ieee_terms": 60, "doi": 55, "venue": 40, "abstract": 25, "year": 10}


def paper_score(venue_score: Column, year: Column, citations: Column, now: int) -> Column:
    """Venue score, up to ten points for recent years, up to fifteen for citations."""
    recent = F.when((year > 1900) & (F.lit(now) - year < 10), 10 - (F.lit(now) - year)).otherwise(0)
    cited = F.when(citations > 0, F.least(F.lit(15.0), F.log10(citations + 1) * 6)).otherwise(F.lit(0.0))
    return venue_score + recent + cited


def match_score(matched: Column) -> Column:
    """Sum of the weights of the matched fields."""
    return sum((F.when(F.array_contains(matched, name), w).otherwise(0) for name, w in FIELD_WEIGHTS.items()), F.lit(0))


def badge(similarity: Column, has_query: bool = True) -> Column:
    if not has_query:
        return F.lit("Rare")
    return F.when(similarity >= 0.60, "Rare").when(similarity >= 0.40, "Perfect").when(similarity >= 0.25, "Highly Valuable").when(similarity >= 0.15, "Relevant").otherwise("Noise")


@dataclass(frozen=True)
class VenueRule:
    """First rule whose keyword is in the venue text, and none of ``excluded``, names it."""

    keywords: tuple[str, ...]
    name: str
    tier: str = "C"
    score: int = 50
    kind: str = "Journal"
    domains: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict, compare=False)


OTHER = VenueRule((), "Other", domains=("Other",))


def load_venue_rules(path: str) -> tuple[list[VenueRule], VenueRule]:
    """Rules and default of a JSON file ``{venues: [{k, ex, n, t, s, ty, d, ...}], default_venue}``."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    one = lambda v: VenueRule(tuple(v.get("k", ())), v["n"], v.get("t", "C"), v.get("s", 50), v.get("ty", "Journal"), tuple(v.get("d", ())), tuple(v.get("ex", ())), {"if": v.get("if"), "q": v.get("q"), "u": v.get("u")})
    return [one(v) for v in data["venues"]], one(data["default_venue"]) if "default_venue" in data else OTHER


def keyword_test(text: Column, keyword: str, short: int) -> Column:
    """Short keywords as whole words, others anywhere, in lower-case ``text``."""
    if len(keyword) <= short:
        return text.rlike(rf"\b{re.escape(keyword)}\b")
    return text.contains(keyword)


def venue_of(venue: Column | str, rules: list[VenueRule], default: VenueRule = OTHER) -> Column:
    """Struct (name, tier, score, kind) by the first rule that fits; evaluate on distinct venues."""
    text = F.lower(text_of(venue))
    cases = None
    for r in rules:
        test = F.lit(False)
        for k in r.keywords:
            test = test | keyword_test(text, k.lower(), 6)
        for x in r.excluded:
            test = test & ~text.contains(x.lower())
        value = F.struct(F.lit(r.name).alias("name"), F.lit(r.tier).alias("tier"), F.lit(r.score).alias("score"), F.lit(r.kind).alias("kind"))
        cases = F.when(test, value) if cases is None else cases.when(test, value)
    fallback = F.struct(F.lit(default.name).alias("name"), F.lit(default.tier).alias("tier"), F.lit(default.score).alias("score"), F.lit(default.kind).alias("kind"))
    return fallback if cases is None else cases.otherwise(fallback)


def completeness(c=F.col) -> Column:
    """Points for bibliographic fields that are filled."""
    full = lambda name: squeeze(c(name)) != ""
    parts = [
        (full("volume"), 20), (full("issue") | full("number"), 20), (full("start_page"), 10), (full("end_page"), 10),
        (full("pages") & ~squeeze(c("pages")).isin("1", "1-1"), 10), (full("issue_date"), 20), (full("date_added_to_xplore"), 5),
        (full("online_date"), 5), (full("article_number"), 5), (full("publisher"), 2), (full("document_identifier"), 2),
    ]
    return sum((F.when(test, points).otherwise(0) for test, points in parts), F.lit(0))


def parse_band(text: Column | str) -> Column:
    """Struct (low, high) of the first two numbers; null unless 0 <= low < high."""
    found = F.transform(F.regexp_extract_all(text_of(text), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))
    low, high = F.get(found, F.lit(0)), F.get(found, F.lit(1))
    return F.when((low >= 0) & (high > low), F.struct(low.alias("low"), high.alias("high")))


def band_overlap(low: Column, high: Column, target_low: Column, target_high: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(high, target_high) - F.greatest(low, target_low))


def band_relation(low: Column, high: Column, target_low: Column, target_high: Column) -> Column:
    touching = (high == target_low) | (low == target_high)
    return (
        F.when((band_overlap(low, high, target_low, target_high) == 0) & touching, "endpoint_only")
        .when(band_overlap(low, high, target_low, target_high) == 0, "outside")
        .when((low <= target_low) & (high >= target_high), "full_cover")
        .when((low >= target_low) & (high <= target_high), "inside_target")
        .otherwise("partial_overlap")
    )


# A range's separator that was read in a wrong encoding, ranges, temperatures, the band that is known by name.
RANGE_SEPARATOR = r"(?<=\d)\s*每\s*(?=\d)"
RANGE = r"(?i)(?<![\d.])(\d+(?:\.\d+)?)\s*(?:-|–|—|to)\s*(\d+(?:\.\d+)?)\s*(g|m)hz\b"
TEMPERATURE = r"(?i)(?<![\d.])(\d+(?:\.\d+)?)\s*(?:k|kelvin)\b"
NAMED_BAND = r"(?i)\bc[ -]?band\b"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once a row, however often ``body`` names it: as the variable of a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def frequency_mentions(text: Column | str) -> Column:
    """Distinct (low, high, text, inferred) of ``a-b GHz`` and ``a-b MHz``, in GHz, broken separators repaired; C-band as 4 to 8, inferred.

    Mentions that differ in the case of their text only are one, with the last text.
    """
    given = text_of(text)
    repaired = F.when(F.contains(given, F.lit("每")), F.regexp_replace(given, RANGE_SEPARATOR, "-")).otherwise(given)
    band = F.struct(F.lit(4.0).alias("low"), F.lit(8.0).alias("high"), F.lit("C-band").alias("text"), F.lit(True).alias("inferred"))
    ghz = lambda x, unit: F.round(x.cast("double") * F.when(F.lower(unit) == "m", 0.001).otherwise(1.0), 6)

    def mention(said: Column) -> Column:
        part = lambda i: F.regexp_extract(said, RANGE, i)
        return F.struct(ghz(part(1), part(3)).alias("low"), ghz(part(2), part(3)).alias("high"), said.alias("text"), F.lit(False).alias("inferred"))

    def mentions(c: Column) -> Column:
        stated = F.filter(F.transform(F.regexp_extract_all(c, F.lit(RANGE), F.lit(0)), mention), lambda m: m["high"] > m["low"])
        return F.concat(stated, F.when(c.rlike(NAMED_BAND), F.array(band)).otherwise(F.slice(F.array(band), 1, 0)))

    same = lambda m: F.struct(m["low"], m["high"], F.lower(m["text"]))

    def distinct(found: Column) -> Column:
        def of_all(names: Column) -> Column:
            first = F.filter(F.transform(found, lambda m, i: m.withField("at", i)), lambda m: F.array_position(names, same(m)) == m["at"] + 1)
            return F.transform(first, lambda m: F.element_at(F.filter(found, lambda x: same(x) == same(m)), -1))

        return F.when(F.size(found) < 2, found).otherwise(bound(F.transform(found, same), of_all))

    return bound(bound(repaired, mentions), distinct)


def temperature_mentions(text: Column | str) -> Column:
    """Temperatures in kelvin of a text, above 0 and at most 400."""
    found = F.transform(F.regexp_extract_all(text_of(text), F.lit(TEMPERATURE), F.lit(1)), lambda x: x.cast("double"))
    return F.filter(found, lambda x: (x > 0) & (x <= 400))


def temperature_bucket(t: Column) -> Column:
    return F.when(t <= 4.2, "<=4.2K").when(t <= 20, "4.2-20K").when(t <= 77, "20-77K").when(t <= 120, "77-120K").otherwise(">120K")


def venue_display(name: Column, kind: Column, factor: Column, quartile: Column) -> Column:
    """Name with impact factor and quartile of a journal, or with its kind."""
    facts = F.concat_ws(", ", F.when(factor.isNotNull(), F.concat(F.lit("IF "), factor.cast("string"))), quartile)
    return F.when((kind == "Journal") & (facts != ""), F.concat(name, F.lit(" ("), facts, F.lit(")"))).when(kind == "Journal", name).otherwise(F.concat(name, F.lit(" ("), kind, F.lit(")")))


def expand_terms(terms: Column, groups: list[tuple[str, list[str]]]) -> Column:
    """Terms with all synonyms of the groups that hold one of them, distinct, in order."""
    low = F.transform(terms, lambda t: F.lower(t))
    parts = [terms]
    for canonical, words in groups:
        every = [canonical, *words]
        parts.append(F.when(F.arrays_overlap(low, F.lit([w.lower() for w in every])), F.lit(every)).otherwise(F.slice(F.lit(every), 1, 0)))
    return F.array_distinct(F.concat(*parts))


def record_type(title: Column, text: Column, focus: list[str], container: list[str], device: list[str], frontend: list[str]) -> Column:
    """Kind of a record by the terms of its normalised title and text, first rule that fits."""
    has = lambda c, terms: F.exists(F.lit(terms), lambda t: F.contains(F.concat(F.lit(" "), c, F.lit(" ")), t))
    in_title, boxed = has(title, focus), has(title, container)
    return (
        F.when(boxed & (in_title | has(text, focus)), "container_with_focus").when(in_title, "focus").when(boxed & has(text, frontend), "container_with_frontend")
        .when(boxed, "container_to_verify").when(has(title, device), "device").otherwise("unclassified")
    )


def evidence_axes(technologies: Column, cryogenic: Column, circuit: Column, overlaps: Column) -> Column:
    """Map of axes to evidenced, unknown or, for bands without any overlap, contradicted."""
    known = lambda test: F.when(test, "evidenced").otherwise("unknown")
    band = F.when(F.exists(overlaps, lambda o: o > 0), "evidenced").when(F.size(overlaps) > 0, "contradicted").otherwise("unknown")
    return F.create_map(F.lit("technology"), known(F.size(technologies) > 0), F.lit("cryogenic"), known(cryogenic), F.lit("circuit"), known(circuit), F.lit("frequency"), band)
