"""Streams of remote windows, incremental manifests, interval joins and the vector store."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import keys
from lectern.operators import ingest as ingest_ops
from lectern.operators.buckets import BucketTable
from lectern.operators.intervals import interval_join
from lectern.operators.vector import encode_with_retries, top_k
from lectern.operators.vectorstore import VectorStore
from lectern.sources import readers
from lectern.sources.crawl import crawl
from lectern.streaming import ingest

WINDOWS = ["2024-01-01:2024-01-31", "2024-02-01:2024-02-29", "2024-03-01:2024-03-31"]


def test_remote_windows_come_once(spark, tmp_path):
    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(__file__), "fetchers.py"))
    base, flag = f"file://{tmp_path}", tmp_path / "flag"
    schema = "doi string, title string, error string"
    run = lambda windows, query=str(flag), **more: ingest.follow_remote(spark, {"fetcher": "fetchers:needs_file", "windows": ",".join(windows), "query": query, "pause": "0", **more}, schema, f"{base}/out", f"{base}/log", "doi", 4).awaitTermination()
    read = lambda: sorted(r["doi"] for r in ingest.current(spark, f"{base}/out").collect())
    table = BucketTable(spark, f"{base}/out")
    with pytest.raises(Exception, match="broke off"):
        run(WINDOWS[:2])
    assert table.last().version == -1
    flag.write_text("")
    run(WINDOWS[:2])
    assert read() == sorted(["10.1/all", *(f"10.1/{m}/{p}" for m in ("2024-01-01", "2024-02-01") for p in (0, 1))])
    flag.unlink()  # windows that are done aren't asked again
    run(WINDOWS)
    assert len(read()) == 7 and table.last().facts["errors"] == []
    # another query starts with its first window; its pages end early
    other = tmp_path / "other"
    other.write_text("")
    run(WINDOWS[:1], str(other), pages="1")
    assert len(read()) == 7 and table.last().facts["errors"] == ["2024-01-01:2024-01-31:incomplete, goes on at 1"]
    assert {r["title"] for r in ingest.current(spark, f"{base}/out").collect()} == {str(flag), "shared"}


def test_manifest_opens_changed_files_only(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    for name, text in (("a.csv", "Title,Abstract,DOI\nx,y,z\n"), ("b b.csv", "Title,Abstract,DOI\nx,y,z\n"), ("c.csv", "one,two\n1,2\n")):
        (folder / name).write_text(text)
    first = spark.createDataFrame(readers.manifest(spark, str(folder)).collect(), readers.MANIFEST + ", duplicate_of string, valid boolean")
    before = os.stat(folder / "a.csv")
    (folder / "a.csv").write_text("Title,Abstract,DOI\nX,Y,Z\n")  # other bytes, same size and time: not opened
    os.utime(folder / "a.csv", ns=(before.st_atime_ns, before.st_mtime_ns))
    (folder / "c.csv").write_text("Title,Abstract,DOI\nnew,er,file\n")
    (folder / "d.csv").write_text("q\n")
    digests = lambda m: {r["path"].rsplit("/", 1)[1]: (r["sha1"], r["size"]) for r in m.collect()}
    old, new, fresh = digests(first), digests(readers.manifest(spark, str(folder), first)), digests(readers.manifest(spark, str(folder)))
    names = {n.replace("%20", " ") for n in new}
    assert names == {"a.csv", "b b.csv", "c.csv", "d.csv"} and new["a.csv"] == old["a.csv"] != fresh["a.csv"] and new["c.csv"] == fresh["c.csv"] != old["c.csv"]
    again = spark.createDataFrame(readers.manifest(spark, str(folder), first).collect(), readers.MANIFEST + ", duplicate_of string, valid boolean")
    assert digests(readers.manifest(spark, str(folder), again)) == new
    os.remove(folder / "d.csv")
    assert "d.csv" not in digests(readers.manifest(spark, str(folder), again))


@pytest.mark.parametrize("width", [0.5, 3.0, 1000.0])
def test_interval_join_equals_all_pairs(spark, width):
    rng = random.Random(4)

    def some(n):
        out = []
        for i in range(n):
            low = rng.choice([rng.uniform(-50, 50), float(rng.randrange(-20, 20)), 7.0])
            out.append((i, low, low + rng.choice([0.0, rng.uniform(0, 2), float(rng.randrange(9)), rng.uniform(0, 5000)])))
        return [*out, (n, 3.0, 1.0), (n + 1, None, 2.0), (n + 2, 1.0, None)]

    x, y = some(120), some(90)
    frame = lambda rows: spark.createDataFrame(rows, "id int, low double, high double")
    joined = interval_join(frame(x), frame(y), width)
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in joined._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["a"]["id"], r["b"]["id"]) for r in joined.collect())
    fits = lambda r: r[1] is not None and r[2] is not None and r[1] <= r[2]
    assert got == sorted((a[0], b[0]) for a in x for b in y if fits(a) and fits(b) and a[1] <= b[2] and b[1] <= a[2])


def test_vector_store(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"f{i % 50}", 2010 + i % 10, [rng.random() for _ in range(4)]) for i in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, "fingerprint string, year int, embedding array<double>")
    store = VectorStore(spark, f"file://{tmp_path}/v", 8)
    assert store.read("m") is None and store.missing(frame(rows), "m").count() == 60
    store.append(frame(rows[:30]), "m")
    first = store.table.last()
    store.append(frame(rows), "m")
    store.append(frame(rows[:5]), "other")
    assert store.read("m").count() == 50 and store.read("other").count() == 5 and store.missing(frame(rows), "m").isEmpty()
    kept = store.table.last()
    assert all(kept.sets[b][: len(s)] == s for b, s in first.sets.items())
    # an append reads fingerprints, no vectors
    plan = store.missing(frame(rows).select("fingerprint"), "m")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and "embedding" not in plan.split("FileScan", 1)[1].split("Batched")[0]
    want = {f: (y, v) for f, y, v in sorted(rows[:30], key=lambda r: r[1], reverse=True)}
    scope = [2011, 2013]
    near = lambda df: [r["fingerprint"] for r in top_k(df, [1.0, 0.0, 0.5, 0.0], 5, position="fingerprint").collect()]
    whole = store.read("m")
    assert near(store.read("m", scope)) == near(whole.where(F.col("year").isin(scope))) and {r["fingerprint"] for r in store.read("m", scope).collect()} >= {f for f, (y, _) in want.items() if y in scope}
    before = sorted((r["model"], r["fingerprint"], r["year"]) for r in store.table.read().collect())
    packed = store.compact(1)
    assert all(len(s) == 1 for s in packed.sets.values()) and sorted((r["model"], r["fingerprint"], r["year"]) for r in store.table.read().collect()) == before


def test_crawl_equals_breadth_first_search(spark):
    rng = random.Random(6)
    site = {f"u{i}": [f"u{rng.randrange(90)}" for _ in range(rng.randrange(4))] + ([None] if i % 9 == 0 else []) for i in range(70)}  # some links lead nowhere
    broken = {f"u{i}" for i in range(0, 70, 13)}
    table = spark.createDataFrame([(u, v, "500" if u in broken else None) for u, v in site.items()], "url string, links array<string>, error string")
    fetch = lambda frontier: table.join(frontier, "url")
    seeds = spark.createDataFrame([("u1",), ("u2",), ("u1",), (None,)], "url string")
    seen, round_, frontier = {"u1": 0, "u2": 0}, 0, ["u1", "u2"]
    while frontier:
        round_ += 1
        new = {x for u in frontier if u in site and u not in broken for x in site[u] if x and x not in seen}
        seen |= dict.fromkeys(new, round_)
        frontier = list(new)
    got = crawl(seeds, fetch)
    rows = got.pages.collect()
    assert {r["url"]: r["round"] for r in rows} == seen and len(rows) == len(seen)
    assert {r["url"]: r["error"] for r in rows if r["error"]} == {u: "500" if u in broken else "no answer" for u in seen if u in broken or u not in site}
    assert all(r["url"] in site[r["parent"]] for r in rows if r["parent"]) and got.status.first()["completed"] is False
    cut = crawl(seeds, fetch, max_pages=5).status.first()
    assert cut["truncated"] and cut["pages"] <= 5 and cut["left_over"] > 0
    assert crawl(seeds.limit(0), fetch).status.first()["completed"]
    whole = crawl(spark.createDataFrame([("a",)], "url string"), lambda f: f.select("url", F.array(F.lit("a"), F.lit("b")).alias("links"), F.lit(None).cast("string").alias("error")))
    assert whole.status.first()["completed"] and [r["pages"] for r in whole.rounds] == [1, 1]


def test_an_encoder_that_fails_on_some_rows_loses_only_these(spark, tmp_path):
    rows = [(f"f{i}", 2020, f"text {i}" if i else None) for i in range(30)]
    papers = spark.createDataFrame(rows, "fingerprint string, year int, text string").repartition(3)

    def encode(texts):
        if any(t.endswith("7") for t in texts):
            raise OSError("no answer")
        return [[float(len(t)), 1.0] for t in texts]

    store = VectorStore(spark, f"file://{tmp_path}/v", 4)
    failed = {r["fingerprint"]: r["error"] for r in store.fill(papers, encode, "m", batch=4, tries=2, pause=0.0).collect()}
    assert set(failed) == {"f7", "f17", "f27"} and set(failed.values()) == {"OSError: no answer"}
    assert store.read("m").count() == 27
    assert store.fill(papers, lambda texts: [[0.5, 0.5] for _ in texts], "m", pause=0.0).isEmpty()
    vectors = {r["fingerprint"]: list(r["embedding"]) for r in store.read("m").collect()}
    assert len(vectors) == 30 and vectors["f7"] == [0.5, 0.5] and vectors["f8"] == [6.0, 1.0] and vectors["f0"] == [0.0, 1.0]
    wrong = encode_with_retries(papers, lambda texts: [[float("nan")]] * len(texts), tries=1, pause=0.0)
    assert wrong.where("error IS NULL").isEmpty()


def test_whole_records_signatures_and_enrichment(spark):
    row = {"Document Title": " A  title ", "Authors": "Ann Lee; ann lee;Bo Ray ;", "Issue": "4", "ISBNs": "1", "License": "CC", "Start Page": "7", "PDF Link": "x?arnumber=123"}
    record = readers.csv_to_records(spark.createDataFrame([tuple(row.values())], [*row])).first()
    assert len(record) == 31 and record["authors"] == ["Ann Lee", "Bo Ray"] and (record["first_author"], record["last_author"], record["number"], record["pages"], record["article_number"], record["isbn"]) == ("Ann Lee", "Bo Ray", "4", "7", "123", "1")
    frame = spark.createDataFrame([("a  b", "x", ["q"]), ("a b", "x", ["q"]), ("a b", "y", ["q"]), ("a b", "x", None)], "title string, license string, authors array<string>")
    s = [r[0] for r in frame.select(keys.record_signature(dict(frame.dtypes))).collect()]
    assert s[0] == s[1] and len(set(s)) == 3 and len(keys.SIGNATURE) == 29
    schema = "position long, title string, abstract string, year string, doi string, authors array<string>, publisher string, venue string"
    corpus = spark.createDataFrame([(0, "One work", "t", "2020", "10.1/a", ["A. B"], "", "old"), (1, "Same title", "t", "2020", "", None, "", "old"), (2, "Same title", "t", "2020", "", None, "", "old")], schema)
    sources = spark.createDataFrame([(0, "One work", "new text " * 9, "2020", "10.1/a", ["Alice Brown"], "P", "new"), (1, "Same title", "x" * 60, "2020", "", None, "Q", "new"), (2, "One work", "", "2020", "10.1/a", None, "R", "new"), (3, "Elsewhere", "x" * 60, "", "", None, "S", "new"), (4, "One work", "short", "2020", "10.1/a", None, "T", "new")], schema)
    done = ingest_ops.enrich(corpus, sources)
    assert {r["position"]: (r["publisher"], r["venue"], r["abstract"]) for r in done.corpus.collect()} == {0: ("P", "old", "t"), 1: ("", "old", "t"), 2: ("", "old", "t")}
    assert {r["position"]: r["status"] for r in done.rows.collect()} == {0: "matched", 1: "ambiguous", 3: "missing"} and [r[0] for r in done.changed.collect()] == [0]
