import os
import tracemalloc

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern.llm import ann


def brute(ids, x, queries, k):
    out = {}
    for i in queries:
        q = x[list(ids).index(i)]
        d = sorted((float(np.sqrt(((v - q) ** 2).sum())), int(j)) for j, v in zip(ids, x) if j != i)
        out[int(i)] = [(j, s) for s, j in d[:k]]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2500, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[500:900] = x[500]  # one vector many times
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").withColumn("list", F.lit(1)).withColumn("rank", F.lit(1))
    found = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    want = brute(range(2500), x.astype(float), range(0, 2500, 100), 10)
    hits = [len({j for j, _ in found[q]} & {j for j, _ in want[q]}) for q in want]
    assert set(found) == set(want) and sum(hits) >= 0.95 * 10 * len(want)
    exact = {(q, j): s for q in want for j, s in want[q]}
    assert all(abs(exact[q, j] - s) < 1e-12 for q in found for j, s in found[q] if (q, j) in exact)
    assert [j for j, _ in found[600]] == [500, 501, 502, 503, 504, 505, 506, 507, 508, 509]


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (100, [1.0, 0.5]), (1, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, F.col("vec_id") % 100 == 0).collect())
    assert found == [(0, 1, 100), (0, 2, 1), (0, 3, 1), (100, 1, 0), (100, 2, 1), (100, 3, 1)]
    assert ann.search(df.where("vec_id = 3"), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.search(df.where("vec_id = 1"), F.col("vec_id") % 100 == 0).count() == 0


def whole_scan(x, n, k, **options):
    own = np.arange(n)[:, None] == np.arange(len(x))[None]
    return ann.scan(x, x[:n], own, np.arange(len(x)), k, ann.rotation(x.shape[1]), x.mean(axis=0), np.full(n, np.inf), **options)


def test_scan_abandons_no_neighbour_with_certainty():
    rng = np.random.default_rng(1)
    for offset, spread in ((0, 1), (100, 0.1), (1000, 1), (1e6, 1e-2)):
        x = rng.standard_normal((700, 40)) * spread + offset
        x[350:] -= 2 * offset * (offset < 1e4)  # two far clusters: no mean is near either
        q, v, _ = whole_scan(x, 20, 5, epsilon=50.0)
        want = brute(np.arange(700), x, range(20), 5)
        assert sorted(zip(q.tolist(), v.tolist())) == sorted((i, j) for i in want for j, _ in want[i])


def test_scan_of_many_queries_takes_little_memory():
    x = np.random.default_rng(4).standard_normal((4096, 768))
    tracemalloc.start()
    whole_scan(x[:, :], ann.QUERIES, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6, peak  # the rotated vectors alone are 25 MB


def recall(spark, x, k=10, **options):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0, k, **options).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute(range(len(x)), x, range(0, len(x), 100), k)
    assert set(found) == set(want)
    return sum(len(found[q] & {j for j, _ in want[q]}) for q in want) / (k * len(want))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_embeddings_with_many_lists(spark, sf):
    path = f"/root/testdata/{sf}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    x = np.array(pq.read_table(path).to_pandas().sort_values("vec_id")["embedding"].tolist(), dtype=float)
    assert recall(spark, x, list_rows=max(10, len(x) // 50)) >= 0.95


def test_recall_with_a_common_offset(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 16)) + rng.standard_normal((30, 16))[rng.integers(0, 30, 3000)] * 4
    assert recall(spark, x + 1000, list_rows=60) >= 0.95


def test_lists_in_parts_and_queries_in_blocks_give_the_same(spark, monkeypatch):
    x = np.random.default_rng(5).standard_normal((1500, 8))
    monkeypatch.setattr(ann, "PART", 100)
    monkeypatch.setattr(ann, "ASKED", 3)
    monkeypatch.setattr(ann, "QUERIES", 2)
    assert recall(spark, x, list_rows=300) >= 0.95


def test_repeated_queries_count_once(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[0]] * 12 + [(100, x[7].tolist())]  # one query thirteen times, one id with two vectors
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    near = lambda i, skip: sorted((float(np.sqrt(((v - x[i]) ** 2).sum())), j) for j, v in enumerate(x) if j != skip)
    assert [j for _, j in near(0, 0)[:10]] == [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == 0), key=lambda r: r["rank"])]
    both = sorted((r["rank"], r["vec_id"]) for r in found if r["query_id"] == 100)
    assert both == sorted((k + 1, j) for i in (100, 7) for k, (_, j) in enumerate(near(i, 100)[:10]))
