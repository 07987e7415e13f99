"""Exact cosine search and its combinations with filters and other scores."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.durable import materialize

#: Queries that may be part of an expression; queries of a block that travel as one matrix.
LITERAL, QUERY_BLOCK = 8, 8192
# Arrow types of query ids, where they are not what Arrow takes Python's values for.
ARROW = {"int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "bigint": pa.int64(), "string": pa.string()}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def _unit(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def top_k(base: DataFrame, query: list[float], k: int, vector: str = "embedding", position: str = "vec_id") -> DataFrame:
    """The k rows most similar to one query, ties by position; none for a zero query."""
    if not any(query):
        return base.withColumn("similarity", F.lit(0.0)).limit(0)
    q = F.lit([float(x) for x in query])
    return base.withColumn("similarity", cosine(F.col(vector), q)).orderBy(F.desc("similarity"), position).limit(k)


def top_k_many(base: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", position: str = "vec_id") -> DataFrame:
    """The k most similar rows for each of ``queries(query_id, query_vector)``, ties by position, none for a zero query.

    Up to LITERAL queries are part of the expression. More are taken in blocks of QUERY_BLOCK,
    each a matrix that every task gets once: a task multiplies its rows with it and keeps the
    k best of each query, so only these are shuffled. ``position`` names a row then.
    """
    real = queries.select("query_id", "query_vector").where(F.exists("query_vector", lambda x: x != 0))
    asked = real.limit(LITERAL + 1).collect()
    kind = dict(queries.dtypes)["query_id"]
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), position)
    if not asked:
        return base.limit(0).select(F.lit(None).cast(kind).alias("query_id"), "*", F.lit(0.0).alias("similarity"), F.lit(0).alias("rank"))
    if len(asked) <= LITERAL:
        rows = [F.struct(F.lit(i).cast(kind).alias("query_id"), cosine(F.col(vector), F.lit([float(x) for x in q])).alias("similarity")) for i, q in asked]
        scored = base.select("*", F.inline(F.array(*rows)))
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    held = materialize(real, "asked")
    blocks = -(-held.count() // QUERY_BLOCK)
    part = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    found = None
    for at in range(blocks):
        some = held.where(part == at).orderBy("query_id").collect()
        if some:
            best = _best_of_block(base, [r["query_id"] for r in some], np.array([r["query_vector"] for r in some], dtype=float), k, vector, position, kind)
            found = best if found is None else found.unionByName(best)
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return base.join(ranked, position).select("query_id", *base.columns, "similarity", "rank")


def _first_of(values: np.ndarray, owners: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest values of each row, ties to the smaller owner, and their owners."""
    n = min(k, values.shape[1])
    if n < values.shape[1]:
        order = np.where(np.isnan(values), -np.inf, values)
        least = np.partition(order, values.shape[1] - n, axis=1)[:, values.shape[1] - n]
        row, at = np.nonzero(order >= least[:, None])  # n a row, more with ties
        by = np.lexsort((owners[row, at], -order[row, at], row))
        row, at = row[by], at[by]
        first = np.searchsorted(row, np.arange(len(values)))
        at = at[first[:, None] + np.arange(n)]
    else:
        at = np.lexsort((owners, -values), axis=1)
    return np.take_along_axis(values, at, axis=1), np.take_along_axis(owners, at, axis=1)


class _Best:
    """The k best rows so far of each query of a matrix of unit vectors.

    What can't be among them, as k rows are better already, is passed over in one comparison; the rest waits until it is
    worth a sort. Of rows with equal similarities the smaller owner stays, whatever the order they come in.
    """

    def __init__(self, units: np.ndarray, k: int) -> None:
        self.units, self.k, self.waiting, self.held = units, k, 0, []
        self.best, self.names = np.full((len(units), 0), 0.0), None

    def add(self, x: np.ndarray, norms: np.ndarray, owners: np.ndarray) -> None:
        near = self.units @ x.T
        if (norms > 0).all():
            near /= norms
        else:
            near = np.where(norms > 0, near / np.where(norms > 0, norms, 1.0), 0.0)
        if self.names is None or self.best.shape[1] < self.k:
            names = np.broadcast_to(owners, near.shape)
            every, names = (near, names) if self.names is None else (np.c_[self.best, near], np.c_[self.names, names])
            self.best, self.names = _first_of(every, names, self.k)
            return
        # only what is surely worse is left out: a number that is none stays for the sort
        row, at = np.nonzero(~(near < self.best[:, -1:]))
        self.held.append((row, near[row, at], owners[at]))
        self.waiting += len(row)
        if self.waiting > 2 * self.best.size:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        n = self.best.shape[1]
        row, value, owner = (np.concatenate(part) for part in zip((np.repeat(np.arange(len(self.best)), n), self.best.ravel(), self.names.ravel()), *self.held))
        by = np.lexsort((owner, -value, row))
        row = row[by]
        first = by[np.searchsorted(row, np.arange(len(self.best)))[:, None] + np.arange(n)]
        self.best, self.names, self.held, self.waiting = value[first], owner[first], [], 0

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        return self.best, self.names if self.names is not None else np.full((len(self.best), 0), 0)


def _best_of_block(base: DataFrame, ids: list, matrix: np.ndarray, k: int, vector: str, position: str, kind: str) -> DataFrame:
    """(query_id, position, similarity): in each task the k best rows of each query."""
    units = matrix / np.sqrt((matrix * matrix).sum(axis=1))[:, None]
    d, place = units.shape[1], dict(base.dtypes)[position]

    def matrix_of(column: pa.ListArray) -> np.ndarray:
        values = column.flatten()
        if not column.null_count and not values.null_count and len(values) == d * len(column) and (np.diff(column.offsets.to_numpy()) == d).all():
            return values.to_numpy().reshape(-1, d)
        rows = [None if v is None or len(v) != d or None in v else v for v in column.to_pylist()]
        return np.array([np.zeros(d) if v is None else v for v in rows], dtype=float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_Best(units[q : q + 1024], k) for q in range(0, len(ids), 1024)]
        kept = None
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                some = batch.slice(s, 1024)
                kept = some.column("p").type
                x = matrix_of(some.column("v"))
                norms, owners = np.sqrt((x * x).sum(axis=1)), some.column("p").to_numpy(zero_copy_only=False)
                for part in parts:
                    part.add(x, norms, owners)
        found = [part.result() for part in parts]
        best, names = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        n = best.shape[1]
        for q in range(0, len(ids) if n else 0, 512):
            own = [i for i in ids[q : q + 512] for _ in range(n)]
            columns = [pa.array(own, ARROW.get(kind)), pa.array(names[q : q + 512].ravel().tolist(), kept), pa.array(best[q : q + 512].ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", position, "similarity"])

    rows = base.select(F.col(position).alias("p"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"query_id {kind}, {position} {place}, similarity double")


def over_fetch(k: int, filtered: bool, factor: int = 10, low: int = 200, high: int = 2000) -> int:
    """Rows to fetch before filters: more if there are any."""
    return max(low, min(high, factor * k)) if filtered else k


def fetch_then_filter(base: DataFrame, query: list[float], k: int, condition: Column | None = None, factor: int = 10, low: int = 200, high: int = 2000) -> DataFrame:
    """Nearest rows first, then the filter, then k: results may be fewer than k."""
    hits = top_k(base, query, over_fetch(k, condition is not None, factor, low, high))
    if condition is not None:
        hits = hits.where(condition)
    return hits.orderBy(F.desc("similarity"), "vec_id").limit(k)


def filter_then_rank(candidates: DataFrame, vectors: DataFrame, query: list[float], k: int, key: str = "vec_id") -> DataFrame:
    """All candidates of a structured filter, ranked by similarity."""
    return top_k(candidates.join(vectors, key), query, k)


def rerank(hits: DataFrame, scores: DataFrame, window: int, limit: int, key: str = "vec_id") -> DataFrame:
    """The first ``window`` hits by given scores (missing: 100 similarity), then the rest as it was."""
    order = Window.orderBy(F.desc("similarity"), key)
    placed = hits.orderBy(F.desc("similarity"), key).limit(max(limit, window)).withColumn("place", F.row_number().over(order))
    joined = placed.join(scores.select(key, "score"), key, "left")
    in_window = F.col("place") <= window
    joined = joined.withColumn("rerank_score", F.when(in_window, F.coalesce(F.col("score").cast("double"), F.round(100 * F.col("similarity")))))
    joined = joined.withColumn("rerank_reason", F.when(in_window & F.col("score").isNull(), "similarity"))
    best = joined.orderBy(F.desc(in_window), F.desc("rerank_score"), F.desc("similarity"), key).limit(limit)
    return best.drop("score")


def missing_vectors(papers: DataFrame, store: DataFrame, model: str) -> DataFrame:
    """Rows whose fingerprint has no vector of the model yet."""
    return papers.join(store.where(F.col("model") == model).select("fingerprint"), "fingerprint", "left_anti")


def cache_state(papers: DataFrame, store: DataFrame) -> DataFrame:
    """One row: exact, append, partial or none, and how many rows can be reused (repeats count)."""
    want = papers.groupBy("fingerprint").agg(F.count("*").alias("wanted"))
    have = store.groupBy("fingerprint").agg(F.count("*").alias("stored"))
    both = want.join(have, "fingerprint", "full").select(F.coalesce("wanted", F.lit(0)).alias("w"), F.coalesce("stored", F.lit(0)).alias("s"))
    total = both.agg(F.sum("w").alias("rows"), F.sum("s").alias("stored"), F.sum(F.least("w", "s")).alias("reusable"))
    state = F.when((F.col("reusable") == F.col("rows")) & (F.col("stored") == F.col("rows")), "exact").when(F.col("reusable") == F.col("stored"), "append").when(F.col("reusable") > 0, "partial").otherwise("none")
    return total.select(F.when(F.coalesce("stored", F.lit(0)) == 0, "none").otherwise(state).alias("state"), "rows", "stored", "reusable")


def embed(papers: DataFrame, encoder, text: Column, dims: int) -> DataFrame:
    """``papers`` with a vector from ``encoder(list of texts) -> array``, in Arrow batches."""
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out = np.asarray(encoder(texts.fillna("").tolist()), dtype=np.float32)
        if out.shape != (len(texts), dims):
            raise ValueError(f"the encoder gave {out.shape}, not {(len(texts), dims)}")
        return pd.Series(list(out))

    return papers.withColumn("embedding", run(text))


def encode_with_retries(rows: DataFrame, encode: Callable[[list[str]], object], key: str = "fingerprint", text: str = "text", batch: int = 64, tries: int = 3, pause: float = 1.0) -> DataFrame:
    """``(key, embedding, error)`` of each row: a batch that fails is tried again after growing pauses, then row by row, so that only
    rows that fail by themselves have an error and no vector."""
    plain = rows.select(F.col(key).cast("string").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def attempt(texts: list[str]) -> tuple[list | None, str]:
        error = ""
        for at in range(tries):
            try:
                found = np.asarray(encode(texts), dtype=np.float32)
                if found.ndim != 2 or len(found) != len(texts) or not np.isfinite(found).all():
                    raise ValueError(f"the encoder gave {found.shape} for {len(texts)} texts, or no numbers")
                return list(found), ""
            except Exception as e:  # noqa: BLE001 - whatever an encoder raises is the row's error
                error = f"{type(e).__name__}: {str(e)[:300]}"
                if at < tries - 1:
                    time.sleep(pause * 2**at)
        return None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, batch):
                keys, texts = (b.column(i).slice(s, batch).to_pylist() for i in (0, 1))
                found, error = attempt(texts)
                rows = [(k, v.tolist(), None) for k, v in zip(keys, found)] if found is not None else []
                if found is None:
                    for k, t in zip(keys, texts):
                        one, why = attempt([t]) if len(texts) > 1 else (None, error)
                        rows.append((k, one[0].tolist(), None) if one is not None else (k, None, why))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.float32())), pa.array([r[2] for r in rows], pa.string())], [key, "embedding", "error"])

    return plain.mapInArrow(run, f"{key} string, embedding array<float>, error string")
