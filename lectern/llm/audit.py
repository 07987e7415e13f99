"""Audit of how document filters interact: which failures overlap, in any order of the filters.

Each document gets a failure mask, a bit a filter. Four filters look at one text; the fifth
fails a text that some smaller doc_id also has, table-wide. Such copies are found by sorting:
documents are range-sorted by text fingerprint, full text and doc_id, each is compared with
its predecessor, and a small table of the texts at either end of each range settles the runs that
go on over a boundary. Ranges are cut by fingerprint and doc_id, so a text that a third of
all documents share lies in many ranges. Masks are then counted by part; these counters add up,
and all orders of the filters are answered from them.

Edge cases: a null text is the empty text (no words, so it fails A, and E like any other copy); a
null source is the part of the empty string; a row without doc_id fails E never, nor makes
another fail it; repeated rows of one doc_id aren't copies of one another, but each counts; labels may
be null, absent or repeated (a document is good or toxic if any of its labels says 1); empty
tables give no rows; other columns are ignored, whatever their names. Memory of a task: an Arrow
batch and the texts at the ends of its range.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import bound_batches, checked_broadcast, materialize, release_memory

#: Least words; distinct words and capitals in percent; signs that no clean text holds.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SIGNS = 50, 65, 5, "[#$%&*|]"
LETTERS = "ABCDE"
BLANKS = " \t\n\x0b\x0c\r"
MARKED = "part int, run long, doc_id long, part_name string, mask int, fp long, text string, first_id long, edge boolean"


def text_mask(text: Column) -> Column:
    """The failures that a text shows on its own: bits 0 to 3 for A to D."""
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    failures = [n < MIN_WORDS, F.lit(100) * distinct < F.lit(MIN_DISTINCT) * n, F.lit(100) * capitals > F.lit(MAX_CAPITALS) * F.length(text), text.rlike(SIGNS)]
    mask = F.lit(0)
    for bit, failed in enumerate(failures):
        mask = mask + F.when(failed, 1 << bit).otherwise(0)
    return mask


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted range, without their texts: the run of equal texts that each is in, and the run's first id.

    Only the runs of the range's first fingerprint keep their number, as only these may have
    begun in an earlier range. Those of the first and the last fingerprint are given as edges, with their texts.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = [f.split()[0] for f in MARKED.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    first_fp = last_fp = last_text = first_id = None
    run = -1
    heads: dict[int, tuple] = {}
    tails: dict[int, tuple] = {}
    for b in batches:
        if not b.num_rows:
            continue
        text, ids, fps = b.column("text"), b.column("doc_id"), b.column("fp").to_numpy()
        new = np.ones(len(fps), dtype=bool)
        new[1:] = ~pc.equal(text.slice(1), text.slice(0, len(fps) - 1)).to_numpy(zero_copy_only=False)
        new[0] = last_text is None or text[0] != last_text
        runs = run + np.cumsum(new)
        begins = np.flatnonzero(new)
        firsts = ids.take(pa.array(begins))
        first_ids = pa.concat_arrays([pa.array([first_id], pa.int64()), firsts]).take(pa.array(runs - run))
        first_fp = int(fps[0]) if first_fp is None else first_fp
        if fps[-1] != last_fp:
            tails = {}
        for edge, fp in ((heads, first_fp), (tails, fps[-1])):
            for i in begins[fps[begins] == fp]:
                edge[int(runs[i])] = (int(fp), text[int(i)].as_py(), ids[int(i)].as_py())
        n = len(fps)
        known = pa.array(runs, mask=fps != first_fp)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), known, ids, b.column("part_name"), b.column("mask"), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), first_ids, pa.array(np.zeros(n, bool))], names)
        run, last_fp, last_text, first_id = int(runs[-1]), int(fps[-1]), text[n - 1], first_ids[n - 1].as_py()
    rows = [(part, r, None, None, None, fp, t, i, True) for r, (fp, t, i) in sorted((heads | tails).items())]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    release_memory()


def failure_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of each row of ``docs(doc_id, text, source)``: bits 0 to 4 for A to E."""
    bound_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce("source", F.lit("")).alias("part_name")).withColumn("fp", F.xxhash64("text"))
    by_id = F.col("doc_id").asc_nulls_last()
    ordered = plain.repartitionByRange("fp", by_id).sortWithinPartitions("fp", "text", by_id)
    marked = materialize(ordered.select("doc_id", "part_name", "fp", "text", text_mask(F.col("text")).alias("mask")).mapInArrow(_runs, MARKED), "audit-runs")
    # at most the runs of two fingerprints a range: the earliest id of each text before a range
    before = Window.partitionBy("fp", "text").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    edges = marked.where("edge").select("part", "run", F.min("first_id").over(before).alias("earlier")).where("earlier IS NOT NULL")
    rows = marked.where("NOT edge").join(checked_broadcast(edges), ["part", "run"], "left")
    copy = F.least("first_id", "earlier") < F.col("doc_id")
    return rows.select("doc_id", F.col("part_name").alias("part"), (F.col("mask") + F.when(copy, 1 << 4).otherwise(0)).alias("mask"))


def mask_counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Additive counters: rows, good ones and toxic ones of each part and mask."""
    alike = masks.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    says = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality"), says("toxic"))
    return alike.join(known, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("quality", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic")
    )


def interactions(counters: DataFrame, letters: str = LETTERS) -> DataFrame:
    """What each filter does at each step of each order, from ``counters(part, mask, n, good, toxic)``.

    A filter after a set of others does the same in any order of that set: a part's masks meet each
    such pair once, and orders read the sums. A mask of k failures is removed by each of its filters
    in one k-th of all orders.
    """
    every = list(permutations(range(len(letters))))
    pairs = sorted({(sum(1 << f for f in order[:i]), order[i]) for order in every for i in range(len(order))})
    steps = [(pairs.index((sum(1 << f for f in order[:i]), order[i])), "".join(letters[f] for f in order), i + 1) for order in every for i in range(len(order))]
    spark = counters.sparkSession
    numbers = lambda values: F.array(*(F.lit(v) for v in values))
    each = counters.select("*", F.posexplode(numbers(before for before, _ in pairs)).alias("pair", "before"))
    met = each.withColumn("filter", numbers(1 << f for _, f in pairs)[F.col("pair")])
    fails, earlier = F.col("mask").bitwiseAND(F.col("filter")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda value, where: F.sum(F.when(where, F.col(value)).otherwise(0)).cast("long")
    share = F.sum(F.when(fails, F.col("n") * F.lit(len(every)) / F.greatest(F.bit_count("mask"), F.lit(1))).otherwise(0)).cast("long")
    sums = met.groupBy("part", "pair").agg(
        total("n", ~fails & ~earlier).alias("kept"), total("n", fails & ~earlier).alias("removed"), total("n", fails & earlier).alias("redundant"),
        total("n", F.col("mask") == F.col("filter")).alias("unique_fails"), total("good", fails & ~earlier).alias("good_lost"),
        total("toxic", fails & ~earlier).alias("toxic_lost"), share.alias("shapley"),
    )
    orders = F.broadcast(spark.createDataFrame(steps, "pair int, filter_order string, step int"))
    return sums.join(orders, "pair").select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step."""
    return interactions(mask_counters(failure_masks(docs), labels))


def oracle_sql() -> str:
    """DuckDB SQL for ``audit``'s rows."""
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d
), f AS (
  SELECT part, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND l.quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND l.toxic = 1) AS toxic,
    [len(words) < {MIN_WORDS}, 100 * len(list_distinct(words)) < {MIN_DISTINCT} * len(words),
     100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(t), regexp_matches(t, '{SIGNS}'), coalesce(first < doc_id, false)] AS failed
  FROM w
), l AS (SELECT unnest(range(1, 6)) AS i), o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS places FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), m AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL
), s AS (
  SELECT part, places, step, n, good, toxic, failed[places[step]] AS fails, len(list_filter(list_slice(places, 1, step - 1), lambda p: failed[p])) > 0 AS earlier,
    len(list_filter(failed, lambda x: x)) AS k, places[step] AS filter
  FROM m, o, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, places, step, filter, coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT earlier), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND k = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT earlier), 0)::BIGINT AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT part, array_to_string(list_transform(places, lambda p: '{LETTERS}'[p]), '') AS filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM r"""
