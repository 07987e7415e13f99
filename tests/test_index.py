"""Inverted index and bucketed tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import index, keyword
from lectern.operators.buckets import BUCKET, BucketTable, key_bucket
from lectern.plans.query import KeywordQuery
from lectern.streaming import ingest

WORDS = "low noise amplifier c++ a+b lna 5g 22nm µm the of bulk-cmos Élan +".split()


def records(spark, n=150, seed=1):
    rng = random.Random(seed)
    some = lambda k: " ".join(rng.choice(WORDS) + rng.choice(["", ",", ".", "-x"]) for _ in range(rng.randrange(k)))
    rows = [(i, some(6), some(30) if i % 9 else None, [some(3), "Ann Lee"] if i % 4 else None, rng.choice(["v1", "v2"]), str(2010 + i % 12), f"https://doi.org/10.1/X{i % 40}" if i % 3 else None) for i in range(n)]
    return spark.createDataFrame(rows, "position long, title string, abstract string, authors array<string>, venue string, year string, doi string")


QUERIES = [
    KeywordQuery.build(expression="low noise/lna, cmos"), KeywordQuery.build(expression="the of/noise amplifier & a"), KeywordQuery.build(all_terms=["c++"], any_terms=["a+b", "b"]), KeywordQuery.build(expression="c++ a+b/+/a+b lna"),
    KeywordQuery.build(authors=["Ann Lee"], expression="5 g/22nm", fields="title,abstract"), KeywordQuery.build(dois=["doi:10.1/x4", "10.1/X5"], titles=["low noise"]), KeywordQuery.build(titles=["Low-Noise", "lna"]),
    KeywordQuery.build(any_terms=["elan", "um"], years=(2012, 2016), venues=["v1"]), KeywordQuery.build(expression="nowhere"), KeywordQuery.build(expression="2015", fields="year"), KeywordQuery.build(expression="?!/lna"), KeywordQuery.build(),
]


def same(spark, papers, folder):
    for q in QUERIES:
        columns = ["position", "matched_fields", "matched_terms", "exact_score"]
        assert index.search(papers, folder, q).select(*columns).collect() == keyword.search(papers, q).select(*columns).collect(), q


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    papers = records(spark)
    index.build(papers, f"file://{tmp_path}/i", size=40)
    same(spark, papers, f"file://{tmp_path}/i")
    q = KeywordQuery.build(expression="low noise/lna")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = index.hits(spark, f"file://{tmp_path}/i", q)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert plan.count("FileScan") == 1 and "In(term, [" in plan and "EqualTo(term,lna)" not in plan.split("PushedFilters")[0]
    with pytest.raises(ValueError):
        index.build(papers, f"file://{tmp_path}/j", fields=("title",))
        index.hits(spark, f"file://{tmp_path}/j", q)


def test_updates_rewrite_the_buckets_that_they_touch(spark, tmp_path):
    papers, folder = records(spark), f"file://{tmp_path}/i"
    first = index.build(papers, folder, size=10)
    changed = records(spark, seed=2).where("position in (3, 4, 148)").unionByName(records(spark, 153, 2).where("position >= 150"))
    after = index.update(folder, changed, spark.createDataFrame([(57,)], "position long"))
    assert {b for b in after.sets if after.sets[b] != first.sets.get(b)} == {0, 5, 14, 15}
    assert sorted(int(d.partition("=")[2]) for d in os.listdir(tmp_path / "i" / "data" / f"_set={after.sets[0][0]}") if d.startswith(BUCKET)) == [0, 5, 14, 15]
    now = papers.where("position not in (3, 4, 148, 57)").unionByName(changed)
    same(spark, now, folder)


def test_updates_shuffle_texts_and_no_postings(spark, tmp_path, monkeypatch):
    """Words meet in their record's task, what stays is copied by the tasks that read it, and every so many updates a bucket's files become one."""
    papers, folder = records(spark), f"file://{tmp_path}/i"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(index.postings(papers))
    rows = spark.range(-300, 300).withColumnRenamed("id", "position")
    left = index.without(rows, rows.where("position % 7 = 0 OR position = 63"))
    assert {r[0] for r in left.collect()} == {i for i in range(-300, 300) if i % 7 and i != 63}
    assert "Exchange hashpartitioning" not in plan(left) and "SortMergeJoin" not in plan(left)
    index.build(papers, folder, size=40)
    monkeypatch.setattr(index, "COMPACT", 2)
    for seed, files in ((2, 2), (3, 1)):
        changed = records(spark, seed=seed).where("position in (3, 44)")
        papers = papers.where("position not in (3, 44)").unionByName(changed)
        after = index.update(folder, changed)
        written = len(list((tmp_path / "i" / "data" / f"_set={after.sets[1][0]}" / f"{BUCKET}=1").glob("*.parquet")))
        assert written == 1 if files == 1 else written > 1
    same(spark, papers, folder)


def test_empty_index(spark, tmp_path):
    papers = records(spark).limit(0)
    index.build(papers, f"file://{tmp_path}/i")
    assert index.search(papers, f"file://{tmp_path}/i", QUERIES[0]).count() == 0


def test_bucket_tables(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    table = BucketTable(spark, folder)
    rows = spark.range(200).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.col("id").alias("v"))
    assert table.read() is None and table.last().version == -1
    table.upsert(rows, "key", 16, note="a")
    after = table.upsert(spark.createDataFrame([("k7", -7), ("new", 1)], "key string, v long"), "key")
    assert {r["key"]: r["v"] for r in table.read().collect()} == {f"k{i}": i for i in range(200)} | {"k7": -7, "new": 1}
    touched = {r[0] for r in spark.createDataFrame([("k7",), ("new",)], "key string").select(key_bucket(F.col("key"), 16)).collect()}
    assert {b for b, s in after.sets.items() if list(after.sets.values()).count(s) == len(touched)} == touched and all(len(s) == 1 for s in after.sets.values()) and after.facts == {"note": "a", "buckets": 16}
    # a commit that broke off before its pointer was complete
    os.makedirs(tmp_path / "t" / "commits" / "000000000002")
    assert table.last().version == 1
    with pytest.raises(ValueError):
        table.commit(rows.withColumn(BUCKET, F.lit(3)), [4])
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        table.commit(table.read([0]).limit(0), [0])


def test_batches_that_run_again_change_nothing(spark, tmp_path):
    base = f"file://{tmp_path}"
    schema = "key string, position long, v long"
    for at, part in enumerate([[("a", 1, 1), ("b", 2, 2), ("a", 3, 9)], [("b", 4, 5), ("c", 5, 6)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{base}/in/{at}")
        ingest.ingest_files(spark, f"{base}/in/*", schema, f"{base}/out", f"{base}/log").awaitTermination()
    read = lambda: {r["key"]: r["v"] for r in ingest.current(spark, f"{base}/out").collect()}
    assert read() == {"a": 1, "b": 5, "c": 6}
    version = BucketTable(spark, f"{base}/out").last().version
    # the second batch again, as after a driver that was lost between the table's commit and the stream's
    os.remove(tmp_path / "log" / "commits" / "1")
    for f in (tmp_path / "log" / "commits").glob(".1*"):
        f.unlink()
    ingest.ingest_files(spark, f"{base}/in/*", schema, f"{base}/out", f"{base}/log").awaitTermination()
    assert read() == {"a": 1, "b": 5, "c": 6} and BucketTable(spark, f"{base}/out").last().version == version


def test_windows_move_their_checkpoint_with_their_rows(spark, tmp_path):
    target = f"file://{tmp_path}/t"
    rows = lambda *r: spark.createDataFrame(list(r), "key string, v long")
    ingest.commit_window(spark, target, rows(("a", 1)), "s", "2024-01-31")
    ingest.commit_window(spark, target, rows(("a", 2), ("b", None)), "s", "2024-02-29", complete=False)
    assert ingest.checkpoints(spark, target) == {"s": "2024-01-31"}
    again = ingest.commit_window(spark, target, rows(("a", 2), ("b", None)), "s", "2024-02-29")
    assert ingest.checkpoints(spark, target) == {"s": "2024-02-29"} and again.version == 2
    assert len({s for own in again.sets.values() for s in own}) <= 2
    assert ingest.commit_window(spark, target, rows(("b", None)), "s", "2024-01-01").version == 2
    ingest.commit_window(spark, target, rows(), "t", "2023-01-01")
    assert ingest.checkpoints(spark, target) == {"s": "2024-02-29", "t": "2023-01-01"}
    assert sorted(map(tuple, ingest.current(spark, target).collect())) == [("a", 2), ("b", None)]
