import os
import random
import re
from itertools import permutations

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import audit, queries

SF = "/root/testdata/sf0.001"


def plain(rows, labels):
    """All figures by a loop over documents, orders and steps."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    ids = {}
    for d, t, _ in rows:
        if d is not None:
            ids[t or ""] = min(d, ids.get(t or "", d))
    docs = []
    for d, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and ids[t] < d}
        docs.append((s or "", fails, d in good, d in toxic))
    out = {}
    for part in {p for p, *_ in docs}:
        own = [x for x in docs if x[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [f, len(left), len(gone), sum(x[1][f] for x in own) - len(gone), sum(x[1][f] and sum(x[1].values()) == 1 for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for key, value in out.items():
            if key[0] == part:
                value.append(shapley[value[0]])
    return {k: tuple(v[1:]) for k, v in out.items()}


def found(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


def sample(n=400, seed=3):
    rng = random.Random(seed)
    words = "the quiet River walks along OLD stone bridge lamp evening boats home café 数字 x|y 5% a&b".split()
    texts = [" ".join(rng.choice(words) + (str(rng.randrange(400)) if rng.random() < 0.7 else "") for _ in range(rng.randrange(20, 90))) for _ in range(n // 3)]
    texts += [None, "", " \t\x0b\n", "A", "word " * 5000, "\x85one\xa0two three"]
    rows = [(rng.randrange(n), rng.choice(texts), rng.choice(["a", "b", None, ""])) for _ in range(n)]
    rows += [(1000 + i, texts[0], "hot") for i in range(n // 2)] + [(None, texts[0], "a"), (None, "only here " * 30, "b"), rows[0], rows[0]]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, n, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1)]
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("part", "run", "mask", "fp", "edge", "part_name", "first_id", "n")})
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit("clash") for c in ("part", "mask", "n", "good")})


@pytest.mark.parametrize("partitions, batch", [("1", "1000"), ("7", "3"), ("40", "1000")])
def test_equals_a_plain_loop(spark, monkeypatch, partitions, batch):
    """Few and many ranges, and batches within runs; a hot text goes over many ranges."""
    keys = {"spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": batch}
    before = {k: spark.conf.get(k) for k in keys}
    rows, labels = sample()
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        assert found(audit.audit(*frames(spark, rows, labels))) == plain(rows, labels)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_equal_fingerprints_of_different_texts(spark, monkeypatch):
    """All texts under one fingerprint: full texts decide, over range boundaries too."""
    monkeypatch.setattr(audit.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows, labels = sample(90, 5)
        assert found(audit.audit(*frames(spark, rows, labels))) == plain(rows, labels)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@given(st.lists(st.tuples(st.integers(0, 6) | st.none(), st.sampled_from([None, "", "A b", "a b a", "#", "a"]), st.sampled_from([None, "p"])), min_size=1, max_size=12))
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_small_tables(spark, rows):
    assert found(audit.audit(*frames(spark, rows, [(1, 1, 0)]))) == plain(rows, [(1, 1, 0)])


def test_empty_tables(spark):
    docs, labels = frames(spark, [], [])
    assert audit.audit(docs, labels).count() == 0
    rows = [(1, "a", "s")]
    assert len(found(audit.audit(frames(spark, rows, [])[0], labels))) == 600


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL["op11_audit"]).df()
    got = queries.QUERIES["op11_audit"](spark, SF).toPandas()[list(want.columns)]
    order = ["part", "filter_order", "step"]
    assert len(want) and got.sort_values(order).reset_index(drop=True).astype(str).equals(want.sort_values(order).reset_index(drop=True).astype(str))
