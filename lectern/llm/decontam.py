"""Benchmark decontamination with native expressions.

A document leaks an item if a window of it, as long as the item, has a multiset Jaccard
similarity of THRESHOLD or more on word shingles (WIDTH words; a shorter item is one
shingle). Steps, all lossless but the stated radius:

1. Hashes of the documents' shingles meet those of the items. A window of the threshold
   shares at least 2 m t / (1 + t) of its m shingles with the item, so documents with
   fewer hits for an item are out, and so are windows with fewer.
2. The item-sized windows that are left get a SimHash of their shingles (64 bits).
3. Multi-index Hamming blocks: fingerprints of a window and of its item that differ in at most
   RADIUS bits agree in one of RADIUS + 1 blocks of bits at least; the others are out, then
   those beyond the radius. At this similarity blocks are short, so on their own they
   would let most pairs pass: it is the shingles of step 1 that keep the number of windows
   small, and a window meets only the items that it shares them with.
4. The exact weighted similarity verifies each candidate.

RADIUS is far beyond the distance at the threshold: a window of similarity 0.8 differs in
about 10 bits (standard deviation below 3), so fewer than one in a million lies beyond.
Texts are compared by lower-cased runs of letters, marks and digits.

Edge cases: null and empty texts have no words and leak nothing; items without words match
nothing; a document shorter than an item counts as one window; texts of any length are
searched whole, windows cost in proportion to the hits; of equally similar windows the first
counts; equal rows are judged alike, rows that share a doc_id by their own texts; an empty
benchmark keeps every document; extra columns are ignored, or kept by ``decontaminate``,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import boxed, checked_broadcast, drop_tables, materialize, row_key, temporary_tables, unboxed

WIDTH, THRESHOLD, RADIUS = 5, 0.8, 24


def words(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits, perhaps with an empty first or last."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+")


def shingle_hashes(w: Column, width: int) -> Column:
    """Hash of each run of ``width`` words in the array ``w``."""
    starts = F.when(F.size(w) >= width, F.sequence(F.lit(0), F.size(w) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(width))))


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of an array of hashes, repeats included."""

    def bit(acc: Column, b: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda c, x: c + F.expr("0") + F.call_function("shiftright", x, b).bitwiseAND(F.lit(1)).cast("int"))
        return acc.bitwiseOR(F.when(ones * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)


def share_a_block(differ: Column, radius: int = RADIUS) -> Column:
    """Whether one of ``radius + 1`` blocks that cover the 64 bits is zero in ``differ``, the XOR of two fingerprints."""
    edges = [i * 64 // (radius + 1) for i in range(radius + 2)]
    masks = [((1 << b) - (1 << a)) - (1 << 64 if b == 64 else 0) for a, b in zip(edges, edges[1:])]
    return F.exists(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: differ.bitwiseAND(m) == 0)


def window_starts(hits: Column, m: Column, last: Column, need: Column) -> Column:
    """Starts, from 0 to ``last``, of the windows of ``m`` places that hold ``need`` of the sorted ``hits`` or more.

    Such a window holds need hits in a row, from the first of them that it holds; so the
    starts are runs that end at a hit, and each run begins behind the one before.
    """

    def run(at: Column, i: Column) -> Column:
        low = F.greatest(F.get(hits, i + need - 1) - m + 1, F.coalesce(F.get(hits, i - 1) + 1, F.lit(0)), F.lit(0))
        low, high = F.when(i == 0, F.least(low, last)).otherwise(low), F.least(at, last)
        return F.when((F.get(hits, i + need - 1) - at < m) & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.slice(hits, 1, F.greatest(F.size(hits) - need + 1, F.lit(0))), run))


def _need(m: Column, threshold: float) -> Column:
    return F.ceil(m * F.lit(2 * threshold / (1 + threshold)) - F.lit(1e-9))


def prepare_items(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(item_id, width, m, hashes, fp)`` of every item with words."""
    clean = benchmark.select("item_id", F.filter(words(F.col("text")), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(width))
    hashed = clean.withColumn("width", size).withColumn("hashes", F.coalesce(*(F.when(F.col("width") == k, shingle_hashes(F.col("w"), k)) for k in range(1, width + 1))))
    return hashed.select("item_id", "width", F.size("hashes").alias("m"), "hashes", simhash(F.col("hashes")).alias("fp"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """``(key, doc_id, item_id, similarity, position, windows)`` for each document and item that it leaks.

    key: see row_key; position: first word of the most similar window; windows: how many reach the threshold.
    """
    items = materialize(prepare_items(benchmark, width), "items")
    widths = [r[0] for r in items.select("width").distinct().orderBy("width").collect()]
    keyed = docs.select("doc_id", row_key().alias("key"), words(F.col("text")).alias("w"))
    parts = []
    for k in widths:
        grams = F.arrays_zip(*(F.slice("w", j + 1, F.greatest(F.size("w") - j, F.lit(0))).alias(f"w{j}") for j in range(k)))
        each = keyed.select("key", F.posexplode(grams).alias("pos", "s")).where(F.col(f"s.w{k - 1}").isNotNull())
        hashed = each.select("key", "pos", F.xxhash64(*(F.col(f"s.w{j}") for j in range(k))).alias("h"))
        own = items.where(F.col("width") == k)
        shingles = own.select("item_id", "m", F.explode(F.array_distinct("hashes")).alias("h"))
        hits = hashed.join(checked_broadcast(shingles), "h").groupBy("key", "item_id", "m").agg(F.collect_set("pos").alias("hits"))
        parts.append(hits.where(F.size("hits") >= _need(F.col("m"), threshold)).withColumn("width", F.lit(k)))
    if not parts:
        return docs.sparkSession.createDataFrame([], "key long, doc_id long, item_id long, similarity double, position int, windows long")
    hits = parts[0]
    for more in parts[1:]:
        hits = hits.unionByName(more)
    hits = materialize(hits, "hits")
    keys = hits.select("key").distinct()
    some = keyed.join(checked_broadcast(keys), "key").dropDuplicates(["key"])
    shingled = some.select("key", "doc_id", *(shingle_hashes(F.col("w"), k).alias(f"h{k}") for k in widths))
    met = hits.join(shingled, "key").select("key", "doc_id", "item_id", "m", "width", F.array_sort("hits").alias("hits"), F.coalesce(*(F.when(F.col("width") == k, F.col(f"h{k}")) for k in widths)).alias("h"))
    last = F.greatest(F.size("h") - F.col("m"), F.lit(0))
    starts = window_starts(F.col("hits"), F.col("m"), last, F.greatest(_need(F.col("m"), threshold).cast("int"), F.lit(1)))
    windows = met.select("key", "doc_id", "item_id", "m", "h", F.explode(starts).alias("position"))
    windows = windows.select("key", "doc_id", "item_id", "position", F.slice("h", F.col("position") + 1, F.col("m")).alias("window"))
    windows = materialize(windows.withColumn("fp", simhash(F.col("window"))), "windows")
    aims = items.select("item_id", "hashes", F.col("fp").alias("item_fp"))
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    pairs = windows.join(checked_broadcast(aims), "item_id").where(share_a_block(differ, radius) & (F.bit_count(differ) <= radius))
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    common = F.aggregate(F.array_distinct("hashes"), F.lit(0), lambda acc, x: acc + F.least(count("window", x), count("hashes", x)))
    exact = pairs.select("key", "doc_id", "item_id", "position", (common / (F.size("window") + F.size("hashes") - common)).alias("similarity"))
    best = exact.where(F.col("similarity") >= threshold).groupBy("key", "doc_id", "item_id")
    return best.agg(F.max("similarity").alias("similarity"), F.min_by("position", F.struct(-F.col("similarity"), "position")).alias("position"), F.count("*").alias("windows"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that leak no item."""
    with temporary_tables(docs.sparkSession) as made:
        leaks = materialize(find_leaks(docs, benchmark, **options).select("key").distinct(), "leaks")
        drop_tables(docs.sparkSession, made[:-1])
    return unboxed(boxed(docs, row_key().alias("key")).join(checked_broadcast(leaks), "key", "left_anti"), docs.columns)
