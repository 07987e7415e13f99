"""Bulk-synchronous best-fit packing of tokenised documents into as few sequences as it can.

Rounds go down the lengths in bands. In each, the documents of the band and the gaps of open
sequences are range-sorted together, longest first, and a sweep gives every document its
successor: the smallest free gap that holds it. A range settles what meets within it; what is
left over, gaps of earlier ranges and documents of later ones, is paired by its rank on the
stack that the ranges make up, which takes two counts a range. Longer documents come first, so
conflicts go to the longer one, then to the smaller row number. Documents that found no gap
try again in the next round, and then open new sequences by rank, as many to one as surely fit. Gaps
are what placed documents leave; a gap that holds several of the band's length enters as several.

Edge cases: a null or empty text is the end id alone; repeated rows are packed each; texts of any
length are cut into full sequences and one rest; a null doc_id stays null; tables may be empty; other
columns are ignored, whatever their names. Memory of a task: a batch of texts, or the free gaps of its range
as pairs of numbers. The driver holds a count for each length, and some numbers a range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import bound_batches, drop_tables, large_batches, materialize, release_memory, temporary_tables
from lectern.llm.packing import WordTokenizer

CAPACITY, END_ID = 2048, 0
#: Bands of lengths end at these parts of a sequence.
PARTS = (1, 2, 3, 4, 5, 6, 8, 11, 16, 24, 32, 64, 256)
#: A gap enters a sweep as this many at most, or as many as give each document of the round some.
SLOTS, SPARE = 8, 4
PIECES = "id long, doc_id long, piece int, start long, length int, ids_crc32 long"
SWEPT = "gap boolean, part int, rank long, bin long, " + PIECES

_tokenizers: dict[str | None, WordTokenizer] = {}


def cut(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Numbered pieces of ``docs(doc_id, text)``, see PIECES: full sequences and one rest of each document."""
    bound_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if tokenizer_path not in _tokenizers:
            _tokenizers[tokenizer_path] = WordTokenizer(tokenizer_path)
        number = TaskContext.get().partitionId() << 40
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        for table in large_batches(batches, 6 << 20):
            rows = []
            for doc_id, ids in zip(table.column("doc_id").to_pylist(), _tokenizers[tokenizer_path].encode_many(table.column("text"))):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((number, doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own)))
                    number += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [f.split()[0] for f in PIECES.split(", ")])
        _tokenizers[tokenizer_path].forget()
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def sweep(gaps: DataFrame, docs: DataFrame) -> DataFrame:
    """One successor sweep of ``gaps(bin, length)`` and ``docs`` (see PIECES) over sorted ranges.

    Documents that met a gap within their range have its ``bin``; others, and gaps that stay free,
    have their ``rank`` among such rows of their ``part``.
    """
    columns = [f.split()[0] for f in SWEPT.split(", ")]
    free = gaps.select(F.lit(True).alias("gap"), F.col("bin").alias("id"), F.col("length").cast("int").alias("length"))
    rows = free.unionByName(docs.select(F.lit(False).alias("gap"), "id", "doc_id", "piece", "start", "length", "ids_crc32"), allowMissingColumns=True)
    order = [F.col("length").desc(), F.col("gap").desc(), F.col("id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, stack, behind = TaskContext.get().partitionId(), [], 0
        for b in batches:
            bins, ranks, at = [], [], []
            for i, (gap, number, length) in enumerate(zip(*(b.column(c).to_pylist() for c in ("gap", "id", "length")))):
                if gap:
                    stack.append((number, length))
                    continue
                at.append(i)
                bins.append(stack.pop()[0] if stack else None)
                ranks.append(behind if bins[-1] is None else None)
                behind += bins[-1] is None
            own = b.take(pa.array(at, pa.int64()))
            new = {"part": pa.array([part] * len(at), pa.int32()), "rank": pa.array(ranks, pa.int64()), "bin": pa.array(bins, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else own.column(c) for c in columns], columns)
        for i in range(0, len(stack), 100_000):
            some = stack[i : i + 100_000]
            n = len(some)
            kept = {"gap": pa.array([True] * n), "part": pa.array([part] * n, pa.int32()), "rank": pa.array(range(i, i + n), pa.int64()), "bin": pa.array([x[0] for x in some], pa.int64()), "length": pa.array([x[1] for x in some], pa.int32())}
            yield pa.RecordBatch.from_arrays([kept.get(c, pa.nulls(n, pa.int32() if c == "piece" else pa.int64())) for c in columns], columns)

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, SWEPT)


@dataclass
class Pairing:
    """How what ranges left over meets: documents ``[first, end)`` of a part take gaps of ``other`` from rank ``top`` downwards; where
    ``other`` is None none is left for them, and ``top`` is the place of the first one among all such."""

    spans: list[tuple[int, int, int, int | None, int]]
    without: int
    earlier_without: int


def pair_up(counts: list[tuple[int, int, int, int]]) -> Pairing:
    """From (part, documents left, those of them that failed before, gaps left) of each part, in order."""
    spans, stack, without, earlier = [], [], 0, 0
    for part, docs, old, gaps in counts:
        at = 0
        while at < docs and stack:
            other, n = stack.pop()
            take = min(docs - at, n)
            spans.append((part, at, at + take, other, n - 1))
            at += take
            if take < n:
                stack.append((other, n - take))
        if at < docs:
            spans.append((part, at, docs, None, without))
            without += docs - at
            earlier += max(0, old - at)
        if gaps:
            stack.append((part, gaps))
    return Pairing(spans, without, earlier)


def place(swept: DataFrame, pairing: Pairing, known: int, bins: int, each: int) -> DataFrame:
    """Documents of a sweep with their ``bin``: the gap's, or for those longer than ``known`` that found none a new
    one from number ``bins`` on, ``each`` to one; null for the others."""
    docs, gaps = swept.where("NOT gap"), swept.where("gap").select(F.col("part").alias("other"), F.col("rank").alias("gap_rank"), F.col("bin").alias("gap_bin"))
    spans = F.broadcast(docs.sparkSession.createDataFrame(pairing.spans, "span_part int, first long, end long, other int, top long"))  # at most two a range, and one more
    met = docs.join(spans, (F.col("part") == F.col("span_part")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")), "left")
    met = met.withColumn("gap_rank", F.when(F.col("other").isNotNull(), F.col("top") - (F.col("rank") - F.col("first"))))
    new = F.when(F.col("rank").isNotNull() & F.col("other").isNull() & (F.col("length") > known), F.lit(bins) + F.floor((F.col("top") + F.col("rank") - F.col("first")) / each))
    found = met.join(gaps, ["other", "gap_rank"], "left")
    return found.select(*(f.split()[0] for f in PIECES.split(", ")), F.coalesce("bin", "gap_bin", new).cast("long").alias("bin"))


def _slots(gaps: DataFrame, longest: int, most: int) -> DataFrame:
    """A gap that holds several documents of ``longest`` as so many gaps; the first of them takes the rest of it."""
    n = F.greatest(F.lit(1), F.least(F.floor(F.col("length") / longest), F.lit(most))).cast("int")
    each = gaps.withColumn("n", n).select("bin", "length", "n", F.explode(F.sequence(F.lit(1), "n")).alias("slot"))
    return each.select("bin", F.when(F.col("slot") == 1, F.col("length") - (F.col("n") - 1) * longest).otherwise(longest).alias("length"))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The bin of each of the durable ``pieces`` below ``capacity``; columns PIECES and ``bin``."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.where(F.col("length") < capacity).groupBy("length").agg(F.count("*").alias("n")).collect()}
    edges = sorted({capacity // k for k in PARTS} | {0}, reverse=True)
    bands = [(high, low) for high, low in zip(edges, edges[1:])]
    done: list[DataFrame] = []
    waiting, waiting_high, bins = 0, capacity, 0
    carried = None
    while bands or waiting:
        high, low = bands.pop(0) if bands else (0, 0)
        within = {length: n for length, n in counts.items() if low < length <= high}
        own, longest = sum(within.values()), max(within, default=waiting_high)
        if not own and not waiting:
            continue
        docs = pieces.where((F.col("length") > low) & (F.col("length") <= min(high, capacity - 1)))
        if carried is not None:
            docs = docs.unionByName(carried)
        used = [d.where("bin IS NOT NULL").select("bin", "length") for d in done]
        with temporary_tables(spark) as made:
            gaps = spark.createDataFrame([], "bin long, length int")
            if used:
                taken = used[0]
                for more in used[1:]:
                    taken = taken.unionByName(more)
                gaps = taken.groupBy("bin").agg((F.lit(capacity) - F.sum("length")).cast("int").alias("length")).where(F.col("length") > low)
                gaps = _slots(gaps, longest, max(SLOTS, -(-SPARE * (own + waiting) // max(bins, 1))))
            swept = materialize(sweep(gaps, docs), "bestfit-swept")
            left = swept.where("rank IS NOT NULL").groupBy("part").agg(
                F.count_if(~F.col("gap")).alias("docs"), F.count_if(~F.col("gap") & (F.col("length") > high)).alias("old"), F.count_if("gap").alias("gaps")
            )
            pairing = pair_up(sorted((r["part"], r["docs"], r["old"], r["gaps"]) for r in left.collect()))
            each = max(1, capacity // waiting_high)
            held = materialize(place(swept, pairing, high, bins, each), "bestfit-placed")
        drop_tables(spark, made[:1])
        bins += -(-pairing.earlier_without // each)
        waiting, waiting_high = pairing.without - pairing.earlier_without, longest
        done.append(held)
        carried = held.where("bin IS NULL").drop("bin")
    placed = spark.createDataFrame([], PIECES + ", bin long")
    for part in done:
        placed = placed.unionByName(part.where("bin IS NOT NULL"))
    return placed


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    pieces = materialize(cut(docs, capacity, tokenizer_path, end_id), "bestfit-pieces")
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("id"))
    placed = full.unionByName(pack_pieces(pieces, capacity).withColumnRenamed("bin", "sequence_id"))
    so_far = Window.partitionBy("sequence_id").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most ``capacity`` rows
    offset = F.sum("length").over(so_far) - F.col("length")
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", offset.cast("long").alias("offset"))
