"""Nearest neighbours by an inverted file with an adaptive dimension scan.

Vectors are assigned to the nearest of at most MAX_LISTS centroids, which k-means fits on a
sample of SAMPLE rows (smallest hashes of vec_id); every vector is indexed. Probes: the share
of lists that holds TARGET of the true neighbours of sample queries within the sample, and
so many lists that enough rows are met.

In a list, vectors (less the sample's mean) are multiplied by one random rotation and scanned
in column blocks of DIMS. After each block a hypothesis test on the partial distance (Gao and
Long, 2023) abandons candidates whose full distance exceeds the query's current k-th best with
confidence; the first limit comes from the sample's rows in the probed lists, so candidates
are abandoned from the start. Only survivors read the next block. What is left at the end gets
its exact distance from the original vectors in double precision.

Hot keys. Of equal vectors only those of the k + 1 smallest ids are indexed: others can be
nobody's neighbour, as ties go to the smaller id and one of these at most is the query's own.
Lists are dealt in parts of PART vectors; each vector goes to its part once, or once for each
ASKED queries of its list. A task holds the vectors of one part and reads its queries as a
stream, QUERIES at a time against TILE vectors, so its memory has a bound.

Edge cases: vectors that are null, empty, zero, hold null or non-finite components or
differ from the most common dimension take no part, nor do rows without a vec_id; equal
distances go to the smaller vec_id; repeated rows are candidates each, but one query; an
id with several different vectors gets the k nearest of each of them, ranked apart; rows with
the query's vec_id are its own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import bound_batches, materialize, release_memory

SAMPLE, MAX_LISTS, LIST_ROWS = 20_000, 4096, 1000
#: Vectors of a part; queries of a list for each copy of its vectors; queries and vectors compared at once; columns of a block.
PART, ASKED, QUERIES, TILE, DIMS = 4096, 16_384, 256, 512, 16
#: Rows of the sample that give a query its first limit; numbers held at once when exact distances are computed.
LIMITS, NUMBERS = 2048, 1 << 21
#: Share of the true neighbours that probes shall meet; rows to meet for each neighbour asked for.
TARGET, ROWS_EACH = 0.97, 20
#: Confidence of the test that abandons a candidate.
EPSILON = 2.1


def usable(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vectors take part, with vectors as array<double>."""
    v = F.col(column).cast("array<double>")
    fine = df.select(F.col("vec_id").cast("long"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    )
    common = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return fine.where(F.size("v") == (common["d"] if common else 0))


def nearest_lists(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances to the centroids, without the term of ``x`` alone."""
    return (centroids * centroids).sum(axis=1)[None] - 2 * x @ centroids.T


def train_lists(sample: np.ndarray, n: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), n, replace=False)].copy()
    for _ in range(rounds):
        own = nearest_lists(sample, centroids).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        sizes = np.bincount(own, minlength=n)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], sample[rng.choice(len(sample), n)])
    return centroids


def probes_for(sample: np.ndarray, centroids: np.ndarray, k: int, target: float = TARGET) -> int:
    """Lists to probe so that ``target`` of the neighbours of sample queries lie in them."""
    queries = sample[:: max(1, len(sample) // 256)]
    own = nearest_lists(sample, centroids).argmin(axis=1)
    gap = (sample * sample).sum(axis=1)[None] - 2 * queries @ sample.T
    near = np.argsort(gap, axis=1)[:, 1 : 1 + min(k, max(1, len(sample) - 1))]
    place = nearest_lists(queries, centroids).argsort(axis=1).argsort(axis=1)
    ranks = np.take_along_axis(place, own[near], axis=1).ravel()
    return int(np.quantile(ranks, target, method="higher")) + 1 if len(ranks) else 1


def rotation(d: int, seed: int = 1) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def scan(vectors: np.ndarray, queries: np.ndarray, own: np.ndarray, order: np.ndarray, k: int, turn: np.ndarray, center: np.ndarray, limits: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of ``vectors`` to each of ``queries``: (place of the query, place of the vector, exact distance).

    own: whether a vector is the query's own; order: rank of the vectors among equal
    distances; limits: distances beyond which no candidate counts.
    """
    d = vectors.shape[1]
    rotated, aim = (vectors - center) @ turn, (queries - center) @ turn
    blocks = [(i, min(i + DIMS, d)) for i in range(0, d, DIMS)]
    best, best_at = np.full((len(queries), k), np.inf), np.full((len(queries), k), len(vectors))
    rank = np.r_[order, np.iinfo(np.int64).max]
    slack = 1e-11 * ((aim * aim).sum(axis=1) + (rotated * rotated).sum(axis=1).max(initial=0.0)) + 1e-300
    for at in range(0, len(vectors), TILE):
        tile = slice(at, at + TILE)
        limit = np.minimum(best[:, -1], limits) ** 2
        (i, j), c = blocks[0], rotated[tile]
        part = (c[:, i:j] ** 2).sum(axis=1)[None] + (aim[:, i:j] ** 2).sum(axis=1)[:, None] - 2 * aim[:, i:j] @ c[:, i:j].T
        factor = (j / d) * (1 + epsilon / np.sqrt(j)) ** 2 if j < d else 1.0
        q, v = np.nonzero((part <= (limit * factor + slack)[:, None]) & ~own[:, tile])
        part = part[q, v]
        for i, j in blocks[1:]:
            for s in range(0, len(q), NUMBERS // DIMS):
                some = slice(s, s + NUMBERS // DIMS)
                part[some] += ((c[v[some], i:j] - aim[q[some], i:j]) ** 2).sum(axis=1)
            factor = (j / d) * (1 + epsilon / np.sqrt(j)) ** 2 if j < d else 1.0
            keep = part <= limit[q] * factor + slack[q]
            q, v, part = q[keep], v[keep], part[keep]
        v, exact = v + at, np.empty(len(q))
        for s in range(0, len(q), max(1, NUMBERS // d)):
            some = slice(s, s + max(1, NUMBERS // d))
            exact[some] = np.sqrt(((vectors[v[some]] - queries[q[some]]) ** 2).sum(axis=1))
        row = np.r_[np.repeat(np.arange(len(queries)), k), q]
        score, place = np.r_[best.ravel(), exact], np.r_[best_at.ravel(), v]
        by = np.lexsort((rank[place], score, row))
        first = np.searchsorted(row[by], np.arange(len(queries)))
        take = by[(first[:, None] + np.arange(k)).ravel()]
        best, best_at = score[take].reshape(-1, k), place[take].reshape(-1, k)
    q, r = np.nonzero(np.isfinite(best))
    return q, best_at[q, r], best[q, r]


def search(base: DataFrame, is_query: Column, k: int = 10, list_rows: int = LIST_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found for each row with ``is_query`` (of its vec_id)."""
    spark = base.sparkSession
    bound_batches(spark, 2000)
    schema = "query_id long, rank int, vec_id long, score double"
    pairs = materialize(usable(base).groupBy("vec_id", "v").agg(F.count("*").alias("n")), "ann-pairs")
    lead = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("nth") <= k + 1).drop("nth")
    distinct = materialize(lead, "ann-distinct")
    sample = distinct.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "v").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], schema)

    def matrix(column, d: int) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d) if len(column) else np.zeros((0, d))

    first = sample.column("v").combine_chunks()
    d = len(first[0])
    points, point_ids = matrix(first, d), sample.column("vec_id").to_numpy()
    center = points.mean(axis=0)
    points = points - center
    total = distinct.count()
    n_lists = int(np.clip(total // list_rows, 1, min(MAX_LISTS, len(points))))
    centroids = train_lists(points, n_lists)
    probes, turn = probes_for(points, centroids, k), rotation(d)
    guides, guide_ids = points[:LIMITS], point_ids[:LIMITS]
    guide_list = nearest_lists(guides, centroids).argmin(axis=1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = nearest_lists(matrix(b.column("v"), d) - center, centroids).argmin(axis=1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), b.column("vec_id"), b.column("n"), b.column("v")], ["list", "vec_id", "n", "v"])

    index = materialize(distinct.mapInArrow(assign, "list int, vec_id long, n long, v array<double>"), "ann")
    sizes = np.zeros(n_lists, dtype=np.int64)
    for at, n in index.groupBy("list").count().collect():
        sizes[at] = n

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = (guides * guides).sum(axis=1)
        for b in batches:
            for s in range(0, b.num_rows, 64):
                some = b.slice(s, 64)
                ids, x = some.column("vec_id").to_numpy(), matrix(some.column("v"), d) - center
                order = nearest_lists(x, centroids).argsort(axis=1)
                met = np.cumsum(sizes[order], axis=1) - sizes[order]
                q, place = np.nonzero((np.arange(n_lists)[None] < probes) | (met < ROWS_EACH * k))
                lists = order[q, place]
                probed = np.zeros((len(ids), n_lists), dtype=bool)
                probed[q, lists] = True
                own = (x * x).sum(axis=1)
                gap = norms[None] + own[:, None] - 2 * x @ guides.T
                gap = np.where(probed[:, guide_list] & (guide_ids[None] != ids[:, None]), np.maximum(gap, 0) + 1e-9 * (norms.max() + own[:, None]), np.inf)
                limit = np.sqrt(np.partition(gap, k - 1, axis=1)[:, k - 1]) if len(guides) >= k else np.full(len(ids), np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), some.column("vec_id").take(q), some.column("nth").take(q), pa.array(limit[q]), some.column("v").take(q)], ["list", "vec_id", "nth", "bound", "v"])

    asked = pairs.where(is_query).select("vec_id", "v", (F.row_number().over(Window.partitionBy("vec_id").orderBy("v")) - 1).alias("nth"))
    met = materialize(asked.select("vec_id", "nth", "v").mapInArrow(probe, "list int, vec_id long, nth int, bound double, v array<double>"), "ann-asked")
    copies = {r["list"]: -(-r["count"] // ASKED) for r in met.groupBy("list").count().collect()}
    shape = [(i, max(1, -(-int(sizes[i]) // PART)), copies.get(i, 0)) for i in range(n_lists)]
    lists = F.broadcast(spark.createDataFrame(shape, "list int, parts int, copies int"))
    none = F.lit(None)
    vectors = index.join(lists, "list").select(
        "list", F.pmod(F.xxhash64("vec_id", "v"), "parts").cast("int").alias("part"), F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1))).alias("block"),
        F.lit(0).alias("asks"), "vec_id", "n", none.cast("int").alias("nth"), none.cast("double").alias("bound"), "v",
    )
    queries = met.join(lists, "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("vec_id", "nth"), "copies").cast("int").alias("block"),
        F.lit(1).alias("asks"), "vec_id", none.cast("long").alias("n"), "nth", "bound", "v",
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids, points, times = None, [], None, None, None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("list", "part", "block", "asks")], axis=1)
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.zeros(0, int)
            for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)]):
                some, key = b.slice(s, e - s), tuple(keys[s, :3])
                if key != now:
                    now, held, ids = key, [], None
                if not keys[s, 3]:
                    held.append(some)
                    continue
                if ids is None and held:
                    ids, times = (np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("vec_id", "n"))
                    points = np.concatenate([matrix(h.column("v"), d) for h in held])
                    held = []
                if ids is None:
                    continue
                for i in range(0, some.num_rows, QUERIES):
                    part = some.slice(i, QUERIES)
                    asks, nth = part.column("vec_id").to_numpy(), part.column("nth").to_numpy()
                    q, v, score = scan(points, matrix(part.column("v"), d), asks[:, None] == ids[None], ids, k, turn, center, part.column("bound").to_numpy())
                    again = np.minimum(times[v], k)
                    q, v, score = np.repeat(q, again), np.repeat(v, again), np.repeat(score, again)
                    yield pa.RecordBatch.from_arrays([pa.array(asks[q]), pa.array(nth[q]), pa.array(ids[v]), pa.array(score)], ["query_id", "nth", "vec_id", "score"])
        release_memory()

    dealt = vectors.unionByName(queries).repartition(F.col("list"), F.col("part"), F.col("block")).sortWithinPartitions("list", "part", "block", "asks")
    found = dealt.mapInArrow(compare, "query_id long, nth int, vec_id long, score double")
    order = Window.partitionBy("query_id", "nth").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
