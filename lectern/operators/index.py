"""An inverted index for literal search: words of normalised fields to records, kept up by deltas.

A posting is a word of one field of one record and its places there. Postings lie in
buckets by ranges of record positions (a frequent word has rows in all of them, and in no
task more than a bucket's), sorted by word, so that a query reads the parts of files that hold
its words; the few words with a plus sign lie apart, as a search also finds what stands between such signs. An
update rewrites the buckets of the records that changed. Texts are shuffled, postings aren't. Queries give what ``keyword.search``
gives, and read no text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.scoring import match_score
from lectern.functions.text import text_of, year_of
from lectern.operators import keyword
from lectern.operators.buckets import BUCKET, BucketTable, Commit
from lectern.operators.durable import materialize
from lectern.plans.query import FIELDS, KeywordQuery, parse_expression

#: Record positions of one bucket.
ROWS = 1_000_000
#: Record positions that a task turns into postings, and bytes of text that it does at once.
TASK, PIECE = 5_000, 8_000_000
#: Updates after which a bucket's files become one again, and blocks of 64 positions that are sent to all tasks at most.
COMPACT, BLOCKS = 8, 4_000_000
#: Whole fields by which records are looked up.
WHOLE = ("title", "doi")


def postings(papers: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``(plus, term, field, position, places)`` of all words of the fields, and whole titles and DOIs as fields ``title=`` and ``doi=``."""
    return _postings(papers.withColumn(BUCKET, F.lit(0)), fields).drop(BUCKET)


def _postings(papers: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``postings`` with the bucket of each record, without a shuffle: a record's words meet in its own task, in pieces that come sorted."""
    ready = keyword.search_table(papers, tuple(dict.fromkeys([*fields, *WHOLE])))
    names = [*fields, *(f"{n}=" for n in WHOLE)]
    texts = ready.select(BUCKET, "position", *(F.col(keyword.PREFIX + n.rstrip("=")).alias(f"t{i}") for i, n in enumerate(names)))
    schema = f"{BUCKET} int, plus boolean, term string, field string, position {dict(papers.dtypes)['position']}, places array<int>"
    return texts.mapInArrow(lambda batches: (_grouped(p, names, len(fields)) for b in batches for p in _pieces(b)), schema)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``PIECE`` bytes of text, a record at least."""
    sizes = sum(pc.binary_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[2:])
    starts = np.flatnonzero(np.diff(np.cumsum(sizes) // PIECE, prepend=-1))
    for start, end in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(start, end - start)


def _grouped(piece: pa.RecordBatch, names: list[str], n_fields: int) -> pa.RecordBatch:
    """Postings of the records of a piece, sorted by bucket, sign and term; ``names``: fields, of which those after ``n_fields`` are taken whole."""
    rows, kinds, places, terms = [], [], [], []
    for kind in range(len(names)):
        text = piece.column(2 + kind)
        at = np.flatnonzero(pc.not_equal(text, "").to_numpy(zero_copy_only=False))
        words = text.take(pa.array(at))
        counts, place = np.ones(len(at), np.int64), np.zeros(len(at), np.int32)
        if kind < n_fields:
            split = pc.split_pattern(words, " ")
            words, counts = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
            place = (np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
        rows.append(np.repeat(at, counts))
        kinds.append(np.full(len(words), kind))
        places.append(place)
        terms.append(words)
    row, kind, place, term = np.concatenate(rows), np.concatenate(kinds), np.concatenate(places), pa.concat_arrays(terms).dictionary_encode()
    signed = pc.match_substring(term.dictionary, "+").to_numpy(zero_copy_only=False)
    rank = np.empty(len(signed), np.int64)
    rank[pc.sort_indices(term.dictionary).to_numpy()] = np.arange(len(rank))
    rank[np.lexsort((rank, signed))] = np.arange(len(rank))
    code = term.indices.to_numpy(zero_copy_only=False)
    _, bucket = np.unique(piece.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
    key = ((bucket[row] * (len(rank) + 1) + rank[code]) * len(names) + kind) * piece.num_rows + row
    order = np.argsort(key, kind="stable")  # places of one word stay in order
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    at, of, word = row[order][first], kind[order][first], code[order][first]
    sizes = np.where(of < n_fields, np.diff(np.append(first, len(order))), 0)
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.RecordBatch.from_arrays([
        piece.column(0).take(pa.array(at)), pa.array(signed[word] & (of < n_fields)), term.dictionary.take(pa.array(word)), pa.array(names, pa.string()).take(pa.array(of)),
        piece.column(1).take(pa.array(at)), pa.ListArray.from_arrays(offsets, place[order][kind[order] < n_fields]),
    ], [BUCKET, "plus", "term", "field", "position", "places"])


def _bucketed(rows: DataFrame, size: int) -> DataFrame:
    return rows.withColumn(BUCKET, F.floor(F.col("position") / size).cast("int"))


def _dealt(papers: DataFrame, touched: list[int], size: int) -> DataFrame:
    """Records dealt by bucket, before their words are told apart: texts are shuffled once, postings never.

    A task has a few small buckets or a part of a large one, about ``TASK`` positions.
    """
    tasks = max(papers.sparkSession.sparkContext.defaultParallelism, len(touched) * size // TASK)
    each = max(1, -(-tasks // max(1, len(touched))))
    n = len(touched) * each if each > 1 else tasks
    return _bucketed(papers, size).repartitionById(max(1, n), F.pmod(F.col(BUCKET).cast("long") * each + F.pmod("position", F.lit(each)), F.lit(max(1, n))).cast("int"))


def build(papers: DataFrame, folder: str, fields: tuple[str, ...] = FIELDS, size: int = ROWS) -> Commit:
    """A new index of ``papers(position, ...)`` under ``folder``."""
    table = BucketTable(papers.sparkSession, folder)
    touched = [r[0] for r in _bucketed(papers.select("position"), size).select(BUCKET).distinct().collect()]
    return table.commit(_postings(_dealt(papers, touched, size), fields), touched, ["plus", "term"], dealt=True, fields=list(fields), size=size, updates=0)


def update(folder: str, changed: DataFrame, removed: DataFrame | None = None) -> Commit:
    """Records ``changed`` (new or other texts) and positions ``removed``: reads and rewrites their buckets.

    Postings that stay are copied by the tasks that read them; each ``COMPACT``-th update deals them, so that a bucket doesn't come to lie in many files.
    """
    table = BucketTable(changed.sparkSession, folder)
    before = table.last()
    size, fields, updates = before.facts["size"], tuple(before.facts["fields"]), before.facts.get("updates", 0) + 1
    gone = changed.select("position")
    if removed is not None:
        gone = gone.unionByName(removed.select("position"))
    touched = [r[0] for r in _bucketed(gone, size).select(BUCKET).distinct().collect()]
    new, kept = _postings(_dealt(changed, touched, size), fields), without(table.read(touched, before), gone)
    if updates % COMPACT == 0:
        return table.commit(new.unionByName(kept), touched, ["plus", "term"], updates=updates)
    return table.commit(new, touched, ["plus", "term"], dealt=True, kept=kept, updates=updates)


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` whose position isn't among those of ``gone``, which travel as a bit each, 64 in a row of a small table; ``rows`` aren't shuffled."""
    block, bit = F.shiftright(F.col("position").cast("long"), 6).alias("_block"), F.expr("shiftleft(1L, cast(position & 63 AS int))")
    bits = materialize(gone.groupBy(block).agg(F.bit_or(bit).alias("_bits")), "gone")
    if bits.count() <= BLOCKS:
        bits = F.broadcast(bits)
    held = rows.withColumn("_block", block).join(bits, "_block", "left").withColumn("_bit", bit)
    return held.where("_bits IS NULL OR _bits & _bit = 0").select(*rows.columns)


def hits(spark: SparkSession, folder: str, query: KeywordQuery) -> DataFrame:
    """``(position, matched_fields, matched_terms)`` of a query with constraints, from postings alone."""
    table = BucketTable(spark, folder)
    commit = table.last()
    if missing := set(query.fields) - set(commit.facts["fields"]):
        raise ValueError(f"the index doesn't hold {', '.join(sorted(missing))}")
    options = [t for group in parse_expression(query.expression) for t in group] + [*query.all_terms, *query.any_terms]
    asked = {n: dict.fromkeys(keyword.plain(t) for t in options) for n in query.fields}
    if query.authors:
        asked["authors"] = asked.get("authors", {}) | dict.fromkeys(keyword.plain(a) for a in query.authors)
    terms = [t for t in dict.fromkeys(t for own in asked.values() for t in own) if t]
    words, phrases = [t for t in terms if " " not in t], [t for t in terms if " " in t]
    whole = {"title=": [keyword.plain(t) for t in query.titles], "doi=": [keyword.plain_doi(d) for d in query.dois]}
    rows = table.read(commit=commit)
    term, field = F.col("term"), F.col("field")
    exact = dict.fromkeys([*(w for w in words if "+" not in w), *(w for t in phrases for w in t.split(" ") if "+" not in w)])
    signed = dict.fromkeys(w for t in phrases for w in t.split(" ") if "+" in w)
    wanted = (~F.col("plus") & term.isin(list(exact)) & field.isin(list(asked))) | (F.col("plus") & field.isin(list(asked)))
    for name, values in whole.items():
        if values:
            wanted = wanted | (~F.col("plus") & (field == name) & term.isin(values))
    rows = rows.where(wanted)
    # what each posting says: words that it is, or that stand in it between plus signs
    says = [(F.lit("+" not in w) & (term == w)) | (F.col("plus") & term.rlike(rf"\b{re.escape(w)}\b")) for w in words]
    is_id = field.isin(list(whole))
    per_field = rows.groupBy("position", "field").agg(
        F.max(is_id).alias("is_id"),
        *(F.max(~is_id & s).alias(f"w{i}") for i, s in enumerate(says)),
        *(F.first(F.when(~is_id & (term == w), F.col("places")), ignorenulls=True).alias(f"p_{w}") for w in ({**exact, **signed} if phrases else {})),
    )

    def in_a_row(phrase: str) -> Column:
        first, *rest = [F.col(f"`p_{w}`") for w in phrase.split(" ")]
        after = lambda p: keyword.all_of([F.array_contains(places, p + i) for i, places in enumerate(rest, 1)])
        return F.coalesce(F.exists(first, lambda p: F.coalesce(after(p), F.lit(False))), F.lit(False))

    found = [F.when(F.col(f"w{i}"), F.lit(w)) for i, w in enumerate(words)] + [F.when(in_a_row(t), F.lit(t)) for t in phrases] + [F.when(F.col("is_id"), F.lit("="))]
    each = per_field.select("position", F.explode(F.array_compact(F.array(*found))).alias("term"), "field")
    # one row a record: the terms that each field holds, as many as the query has at most
    held = each.groupBy("position").agg(F.collect_set(F.concat("field", F.lit("\x1f"), "term")).alias("held"))
    holds = lambda n, t: F.array_contains("held", f"{n}\x1f{t}") if t else F.lit(False)
    tested = keyword.judged(query, lambda n, t: holds(n, keyword.plain(t)), holds("title=", "="), holds("doi=", "="))
    return held.select("position", F.inline(F.array_compact(F.array(tested))))


def search(papers: DataFrame, folder: str, query: KeywordQuery, limit: int = 0) -> DataFrame:
    """``keyword.search`` by the index: only records that are hit are read, for years, venues and order."""
    if not query.has_constraints:
        return keyword.search(papers, query, limit)
    if not 0 <= limit <= 5000:
        raise ValueError("limit must be from 0 to 5000")
    found = keyword.within(papers.join(hits(papers.sparkSession, folder, query), "position"), query.years, query.venues)
    found = found.withColumn("exact_score", match_score(F.col("matched_fields")))
    ordered = found.orderBy(F.desc("exact_score"), F.desc(year_of(F.col("year").cast("string"))), F.desc(F.lower(text_of("title"))), "position")
    return ordered.limit(limit) if limit else ordered
