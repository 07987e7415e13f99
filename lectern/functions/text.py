"""Text normalisation and token sets as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Symbols and what they become before accents are removed.
SYMBOLS = {"µ": "u", "μ": "u", "Ω": " ohm ", "Ω": " ohm ", "ω": " omega ", "×": "x", "–": "-", "—": "-", "−": "-", "‑": "-"}
#: The letters of the search form one by one: a class of single letters is a table in Java's expressions, one of ranges a chain of tests that takes four times as long.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789+"
STOPWORDS = "a an and for from in of on the to using with".split()


def text_of(value: Column | str) -> Column:
    """Null as the empty text."""
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))


def accent_pairs(first: int = 0xC0, last: int = 0x24F) -> tuple[str, str]:
    """Letters of the range that decompose to one base letter, and these letters."""
    pairs = []
    for code in range(first, last + 1):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_FROM, _TO = accent_pairs()


def normalize(value: Column | str) -> Column:
    """Search form: symbols mapped, accents removed, letters and digits apart, lower case,
    everything but ``a-z 0-9 +`` a single blank. Covers letters up to U+024F natively.

    One pass of characters maps signs, accents and case (with the Kelvin and Angstrom signs),
    one regular expression sets letters and digits apart and squeezes the rest."""
    single = {k: v for k, v in SYMBOLS.items() if len(v) == 1} | {"\u212a": "k", "\u212b": "a"}
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    c = text_of(value)
    for symbol, word in SYMBOLS.items():
        if len(word) > 1:
            c = F.replace(c, F.lit(symbol), F.lit(word))
    c = F.translate(c, "".join(single) + _FROM + upper, "".join(single.values()) + _TO.lower() + upper.lower())
    c = F.regexp_replace(c, r"\p{Mn}+", "")
    return F.trim(F.regexp_replace(c, f"[^{LETTERS}]+|(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", " "))


@F.pandas_udf(StringType())
def _decomposed(values):
    return values.map(lambda v: "".join(c for c in unicodedata.normalize("NFKD", v or "") if not unicodedata.combining(c)))


def normalize_any_script(value: Column | str) -> Column:
    """As ``normalize``, with the full compatibility decomposition (an Arrow function)."""
    c = text_of(value)
    for symbol, word in SYMBOLS.items():
        c = F.replace(c, F.lit(symbol), F.lit(word))
    return normalize(_decomposed(c))


def doi_selector(value: Column | str) -> Column:
    """Lower-case DOI without resolver address or ``doi:``."""
    return F.trim(F.regexp_replace(F.lower(F.trim(text_of(value))), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""))


def squeeze(value: Column | str) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text_of(value), r"\s+", " "))


def loose_title(value: Column | str) -> Column:
    """Lower case, runs of signs and blanks as one blank (Unicode-aware)."""
    return F.trim(F.regexp_replace(F.lower(text_of(value)), r"(?U)[\W_]+", " "))


def loose_doi(value: Column | str) -> Column:
    """Squeezed lower case; a resolver address stays."""
    return F.lower(squeeze(value))


def strip_tags(value: Column | str) -> Column:
    return squeeze(F.regexp_replace(text_of(value), "<[^>]+>", " "))


def split_values(value: Column | str, sign: str = ";") -> Column:
    """Trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(text_of(value), sign), lambda x: F.trim(x)), lambda x: x != "")


def distinct_values(values: Column) -> Column:
    """First of values that are equal without case, order kept."""
    keep = lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x))
    return F.aggregate(values, F.array().cast("array<string>"), keep)


def join_values(values: Column) -> Column:
    return F.array_join(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""), " ")


def year_of(value: Column | str) -> Column:
    """First four digits in a row, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(text_of(value), r"[0-9]{4}", 0), F.lit("")).try_cast("int"), F.lit(0))


def tokens(value: Column | str, stopwords: list[str] = STOPWORDS) -> Column:
    """Distinct words of the search form, longer than one letter, without stop words."""
    found = F.array_distinct(F.split(normalize(value), " "))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(stopwords))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Common tokens as a share of the smaller set."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    return F.greatest(jaccard(a, b), containment(a, b))


def author_keys(authors: Column, loose: bool = False) -> Column:
    """Search forms of full names; ``loose`` adds the last word of each."""
    full = F.filter(F.transform(authors, normalize), lambda x: x != "")
    if not loose:
        return F.array_distinct(full)
    return F.array_distinct(F.concat(full, F.transform(full, lambda x: F.element_at(F.split(x, " "), -1))))


def author_richness(authors: Column) -> Column:
    """Letters, long words and few initials make a list of authors rich."""
    value = lambda a: F.length(a) + 8 * F.regexp_count(a, F.lit("[A-Za-zÀ-ž]{3,}")) - 4 * F.regexp_count(a, F.lit(r"\b[A-ZÀ-Ž]\."))
    return F.aggregate(authors, F.lit(0), lambda s, a: s + value(a))


def highlight(value: Column | str, keyword: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Marks each appearance of the keyword's words in a row, whatever signs lie between."""
    import re

    words = re.findall(r"[A-Za-z0-9+]+", keyword)
    if not words:
        return text_of(value)
    pattern = "(?i)(?<![A-Za-z0-9])(" + "[^A-Za-z0-9+]*".join(re.escape(w) for w in words) + ")(?![A-Za-z0-9])"
    return F.regexp_replace(text_of(value), pattern, f"{before}$1{after}")


def doi_link(doi: Column | str) -> Column:
    """Resolver address with percent signs where they are needed."""
    c = F.url_encode(doi_selector(doi))
    for code, sign in (("%2F", "/"), ("%28", "("), ("%29", ")"), ("%3A", ":"), ("\\+", "%20")):
        c = F.regexp_replace(c, code, sign)
    return F.when(doi_selector(doi) == "", "").otherwise(F.concat(F.lit("https://doi.org/"), c))


def first_json_array(value: Column | str, schema: str = "array<string>") -> Column:
    """The first ``[...]`` of a free text, parsed; empty where it can't be."""
    return F.coalesce(F.from_json(F.regexp_extract(text_of(value), r"(?s)\[.*\]", 0), schema), F.array().cast(schema))
