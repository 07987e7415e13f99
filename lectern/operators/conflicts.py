"""Conflicts among source records: years, abstracts and titles that disagree."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from os.path import commonprefix

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import jaccard, loose_doi, loose_title, squeeze, tokens
from lectern.operators.durable import materialize


def ratio(a: Column, b: Column) -> Column:
    """Sequence-matcher ratio (Ratcliff and Obershelp) in Arrow batches; for few pairs."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p or "", q or "", autojunk=False).ratio() for p, q in zip(x, y)])

    return run(a, b)


def comparable_title(title: Column | str) -> Column:
    return F.trim(F.regexp_replace(loose_title(title), "[^a-z0-9]+", " "))


def year_conflicts(records: DataFrame) -> DataFrame:
    """Titles without a DOI that appear with several years."""
    rows = records.select(loose_title("title").alias("title_key"), loose_doi("doi").alias("d"), squeeze(F.col("year").cast("string")).alias("y")).where("title_key <> '' and d = '' and y <> ''")
    years = rows.groupBy("title_key").agg(F.array_sort(F.collect_set("y")).alias("years"))
    return years.where(F.size("years") > 1).select(F.concat(F.lit("title_year::"), "title_key").alias("id"), F.lit("same_title_different_year").alias("kind"), F.array_join("years", ", ").alias("signals"))


def _variants(records: DataFrame, value: Column) -> DataFrame:
    """``(doi_key, v, a)``: the values of each DOI with more than one, with its least value; DOIs of books only are left out.

    Values are made once, and only DOIs meet in aggregations: equal values stay apart.
    """
    book = F.lower(F.coalesce(F.col("venue"), F.lit(""))).rlike("book|handbook") | F.lower(F.coalesce(F.col("title"), F.lit(""))).rlike(r"\bchapter\b")
    rows = records.select(loose_doi("doi").alias("doi_key"), value.alias("v"), book.alias("book")).where("doi_key <> '' and v <> ''")
    rows = materialize(rows, "values")
    own = F.when(~F.col("v").startswith("\x00"), F.col("v"))  # a text without any words or signs counts for books only
    many = rows.groupBy("doi_key").agg(F.min(own).alias("a"), F.max(own).alias("z"), F.min("book").alias("books")).where("a <> z and not books")
    return rows.where(own.isNotNull()).select("doi_key", "v").join(materialize(many.select("doi_key", "a"), "variants"), "doi_key")


#: Values of a block; two blocks of a DOI meet in a task.
BLOCK = 500


def _apart(pairs: DataFrame, differ: Callable[[str, str], bool]) -> DataFrame:
    """``(doi_key)`` of the rows of ``pairs(doi_key, a, b)`` whose values differ; a task compares no more for a DOI that it has found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[str] = set()
        for batch in batches:
            found = []
            for key, a, b in zip(*(batch.column(c) for c in ("doi_key", "a", "b"))):
                if (name := key.as_py()) not in known and differ(a.as_py(), b.as_py()):
                    known.add(name)
                    found.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["doi_key"])

    return pairs.select("doi_key", "a", "b").mapInArrow(run, "doi_key string").distinct()


def _blocks_apart(each: DataFrame, differ: Callable[[str, str], bool], agree: Callable[[str, str, str, int], bool]) -> DataFrame:
    """``(doi_key)`` of the DOIs of ``each(doi_key, v, n)`` with two values that differ, compared in blocks that are dealt over the tasks.

    Values go to blocks by their hash, two blocks of a DOI to one task, where each value is compared with those
    before it until two differ. A task holds the values of a block; no pair leaves it. ``agree`` tells from the first and
    the last in order of these, and the length of the longest, that a value differs from none of them.
    """
    blocks = F.ceil(F.col("n") / BLOCK)
    own = each.withColumn("block", F.pmod(F.xxhash64("v"), blocks))
    met = own.select("doi_key", "v", "block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    met = met.select("doi_key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, longest, done = None, [], 0, False
        for batch in batches:
            found = []
            for key, i, j, block, value in zip(*(batch.column(c).to_pylist() for c in ("doi_key", "i", "j", "block", "v"))):
                if (key, i, j) != now:
                    now, held, longest, done = (key, i, j), [], 0, False
                if done:
                    continue
                meets = held and (i == j or block == j) and not agree(value, held[0], held[-1], longest)
                if meets and any(differ(min(x, value), max(x, value)) for x in held):
                    found.append(key)
                    held, done = [], True
                elif block == i:
                    held.append(value)
                    longest = max(longest, len(value))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["doi_key"])

    met = met.repartition("doi_key", "i", "j").sortWithinPartitions("doi_key", "i", "j", "block", "v")
    return met.mapInArrow(run, "doi_key string").distinct()


def _in_conflict(each: DataFrame, differ: Callable[[str, str], bool], agree: Callable[[str, str, str, int], bool] = lambda value, first, last, longest: False) -> DataFrame:
    """``(doi_key)`` of the DOIs of ``each(doi_key, v, a)`` with two values that differ.

    The values of a DOI are compared with its least one first. DOIs of three and more values of which none differs
    from that one are compared pair by pair, in blocks; only their values are shuffled.
    """
    found = materialize(_apart(each.where("v <> a").withColumnRenamed("v", "b"), differ), "variants")
    rest = materialize(each.select("doi_key", "v").join(F.broadcast(found) if found.limit(100_001).count() <= 100_000 else found, "doi_key", "left_anti").distinct(), "variants")
    many = rest.groupBy("doi_key").agg(F.count("*").alias("n")).where("n > 2")
    return found.unionByName(_blocks_apart(rest.join(many, "doi_key"), differ, agree))


def ratio_below(a: str, b: str, least: float) -> bool:
    """Whether the sequence-matcher ratio of two texts is below ``least``.

    It is at most what their lengths and their letters allow, and at least what the longer of their common start and end
    gives, as the longest common part counts first; the matcher decides the rest.
    """
    both = (len(a) + len(b)) or 1
    if 2.0 * min(len(a), len(b)) / both < least:
        return bool(a or b)
    same = max(len(commonprefix((a, b))), len(commonprefix((a[::-1], b[::-1]))))
    if 2.0 * same / both >= least:
        return False
    return 2.0 * sum((Counter(a) & Counter(b)).values()) / both < least or SequenceMatcher(None, a, b, autojunk=False).ratio() < least


def title_conflicts(records: DataFrame, least: float = 0.82) -> DataFrame:
    """DOIs with two titles whose sequence-matcher ratio is below ``least``."""

    def agree(value: str, first: str, last: str, longest: int) -> bool:
        # all titles between first and last begin with what these two share
        return 2.0 * len(commonprefix((value, first, last))) / (len(value) + longest) >= least

    found = _in_conflict(_variants(records, comparable_title("title")), lambda a, b: ratio_below(a, b, least), agree)
    return found.select(F.concat(F.lit("doi_title::"), "doi_key").alias("id"), F.lit("same_doi_different_title").alias("kind"))


def materially_different(a: Column, b: Column, least: float = 0.55) -> Column:
    """Abstracts of which neither holds the other and whose words differ."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return ~((F.length(short) >= 120) & F.contains(long, short)) & (jaccard(tokens(a, ["-"]), tokens(b, ["-"])) < least)


def abstract_conflicts(records: DataFrame, least: float = 0.55) -> DataFrame:
    """DOIs with two materially different abstracts; words are compared in the search form."""
    words = F.array_join(tokens(squeeze("abstract"), ["-"]), " ")
    each = _variants(records, F.concat(F.lower(squeeze("abstract")), F.lit("\x00"), words))

    def differ(x: str, y: str) -> bool:
        (a, _, p), (b, _, q) = x.partition("\x00"), y.partition("\x00")
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        if len(short) >= 120 and short in long:
            return False
        p, q = set(p.split()), set(q.split())
        return len(p & q) < least * len(p | q) if p | q else True

    return _in_conflict(each, differ).select(F.concat(F.lit("doi_abstract::"), "doi_key").alias("id"), F.lit("same_doi_different_abstract").alias("kind"))


def open_conflicts(found: DataFrame, dismissed: DataFrame) -> DataFrame:
    return found.join(dismissed.select("id"), "id", "left_anti")


