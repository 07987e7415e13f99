import random

from pyspark.sql import functions as F

from lectern.operators import family, fusion, graph, ingest, keyword, snapshot, vector
from lectern.plans.query import KeywordQuery
from lectern.sources import readers, sinks
from lectern.streaming import ingest as streaming

FIELDS = "position long, title string, abstract string, authors array<string>, year string, venue string, doi string, keywords array<string>, ieee_terms array<string>, volume string, pages string, publisher string"


def record(position, title="", doi="", year="", authors=(), abstract="", volume="", pages=""):
    return (position, title, abstract, list(authors), year, "v", doi, [], [], volume, pages, "")


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(1, 200)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_literal_match_selectors(spark):
    df = spark.createDataFrame([record(0, "Low noise amplifier", "10.1/a", "2020", ["Ann Lee"]), record(1, "Mixer", "", "2021", ["Bo Ray"], "a low noise design"), record(2, "LNA2 chip")], FIELDS)
    find = lambda **k: [(r["position"], r["matched_fields"], r["matched_terms"]) for r in keyword.match(df, KeywordQuery.build(**k)).orderBy("position").collect()]
    assert find(expression="low noise/lna", fields="title,abstract") == [(0, ["title"], ["expression:low noise"]), (1, ["abstract"], ["expression:low noise"]), (2, ["title"], ["expression:lna"])]
    assert [x[0] for x in find(dois=["https://doi.org/10.1/A"])] == [0]
    assert find(authors=["ray"], any_terms=["design"], fields="abstract") == [(1, ["abstract", "authors"], ["author:ray", "any_term:design"])]
    assert find(titles=["mixer"], all_terms=["absent"]) == []
    assert keyword.search(df, KeywordQuery.build(expression="low noise"), 1).count() == 1


def test_vectors(spark):
    e = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)] + [(6, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in vector.top_k(e, [1.0, 0.0], 3).collect()] == [5, 4, 3]
    assert vector.top_k(e, [0.0, 0.0], 3).count() == 0
    assert [r["vec_id"] for r in vector.fetch_then_filter(e, [1.0, 0.0], 2, F.col("vec_id") % 2 == 0).collect()] == [4, 2]
    many = vector.top_k_many(e, spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, query_vector array<double>"), 2)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in many.collect()) == [(1, 1, 5), (1, 2, 4), (2, 1, 0), (2, 2, 1)]
    out = vector.embed(spark.createDataFrame([("a",), (None,)], "t string"), lambda ts: [[len(t), 1.0] for t in ts], F.col("t"), 2)
    assert [r["embedding"] for r in out.collect()] == [[1.0, 1.0], [0.0, 1.0]]


def test_merge_follows_the_fold(spark):
    rows = spark.createDataFrame([
        record(0, "A", "10.1/a", "2020", ["A. B."], "old", volume="1", pages="1-1"), record(1, "A", "10.1/a", "2020", ["Anna Bell"], "new"),
        record(2, "A", "", "2020", [], "", volume="9", pages="3-7"), record(3, "Other"),
    ], FIELDS)
    merged = {r["canonical"]: r for r in ingest.merge_sources(ingest.resolve_keys(rows)).collect()}
    assert set(merged) == {0, 3}
    assert (merged[0]["abstract"], merged[0]["authors"], merged[0]["volume"], merged[0]["pages"]) == ("new", ["Anna Bell"], "9", "3-7")
    corpus = rows.where("position in (0, 3)")
    sources = rows.where("position = 2").withColumn("position", F.lit(0).cast("long"))
    assert ingest.sync(corpus, sources).count() == 1
    assert ingest.sync(corpus, sources, complete=False).count() == 2


def one_by_one(corpus, sources):
    """Record of each position, rows taken one at a time: ``(position, title, doi, year)``."""
    holder, records, out = {}, {}, {}

    def keys(title, doi, year):
        return [k for k in (doi and f"doi::{doi}", title and year and f"title_year::{title}::{year}", title and f"title::{title}") if k]

    def claim(name, values):
        for k in keys(*values):
            holder[k] = name if holder.get(k, name) == name else None  # None: held by no record any more

    for rows, own in ((corpus, True), (sources, False)):
        for position, *values in rows:
            mine = keys(*values)
            if not mine or own and mine[0] in records:
                continue
            name = next((holder[k] for k in mine if not own and holder.get(k)), mine[0])
            start, state = records.get(name, (position, ["", "", ""]))
            state = [new or old for new, old in zip(values, state)]
            records[name] = start, state
            claim(name, state)
            out[position] = name
    return {position: records[name][0] for position, name in out.items()}


def test_keys_resolve_as_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(ingest, "RANGE", 7)
    rng = random.Random(11)
    pick = lambda values, empty: "" if rng.random() < empty else rng.choice(values)
    titles, dois = [f"t{i}" for i in range(20)], [f"10.1/{i}" for i in range(20)]
    rows = [(i, pick(titles, 0.2), pick(dois, 0.6), pick(["2020", "2021", "2022"], 0.4)) for i in range(60)]
    rows += [(60 + i, "t0", "", "") for i in range(30)]  # a title on a third of the rows
    df = spark.createDataFrame([record(i, t, d, y) for i, t, d, y in rows], FIELDS).repartition(5)
    for small in (0, 10_000):  # all groups in rounds, all in order
        found = {r["position"]: r["canonical"] for r in ingest.resolve_keys(df, F.col("position") < 20, small=small).collect()}
        assert found == one_by_one(rows[:20], rows[20:])
    # another DOI resolves by title and year; a key of two records resolves nothing any more; a missing year is the record's
    late = [(0, "a", "10.1/x", "2020"), (1, "a", "10.1/y", "2020"), (2, "b", "10.1/z", "2020"), (3, "a", "10.1/z", "2020"), (4, "a", "", "2020"), (5, "c", "10.1/z", ""), (6, "c", "10.1/q", "2020")]
    df = spark.createDataFrame([record(i, t, d, y) for i, t, d, y in late], FIELDS)
    found = {r["position"]: r["canonical"] for r in ingest.resolve_keys(df, small=0).collect()}
    assert found == one_by_one([], late) == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 2, 6: 2}
    assert ingest.resolve_keys(df.where("false")).count() == 0


def test_families_and_closure(spark):
    rows = [
        record(0, "A cryogenic low noise amplifier in CMOS", "10.1/a", "2018", ["Ann Lee", "Bo Ray"]), record(1, "A cryogenic low noise amplifier in CMOS", "10.1/b", "2019", ["Ann Lee"]),
        record(2, "Cryogenic low noise amplifier in bulk CMOS", "10.1/c", "2020", ["Ann Lee", "Bo Ray"]), record(3, "Unrelated topic of photonics", "10.1/d", "2020", ["Zed Qu"]),
    ]
    df = spark.createDataFrame(rows, FIELDS)
    sizes = {r["position"]: r["work_family_size"] for r in family.assign_families(df).collect()}
    assert sizes == {0: 3, 1: 3, 2: 3, 3: 1}
    found = {r["key"]: r["round"] for r in family.closure(df.where("position = 0"), df.where("position > 0")).collect()}
    assert found == {"doi:10.1/a": 0, "doi:10.1/b": 1, "doi:10.1/c": 1}
    assert family.expand_seed(df.where("position = 0"), df).count() == 2


def test_fusion_and_publications(spark):
    rows = spark.createDataFrame([("t", 2020, "d1", 0), ("t", 2020, "", 1), ("u", 2020, "d2", 2), ("u", 2020, "d3", 3), ("u", 2020, "", 4), ("w", 0, "", 5)], "title_key string, year int, doi string, position long")
    found = {r["position"]: r["publication"] for r in fusion.resolve_publications(rows).collect()}
    assert found == {0: "doi:d1", 1: "doi:d1", 2: "doi:d2", 3: "doi:d3", 4: "title|u|2020", 5: "title|w|0"}
    yields = spark.createDataFrame([(0, 3), (1, 0), (2, 0)], "query_pos int, new_unique long")
    assert fusion.zero_yield_tail(yields).first()[0] == 2


def test_snapshots(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "key string, fingerprint string")
    new = spark.createDataFrame([("b", "2"), ("c", "1")], "key string, fingerprint string")
    assert sorted((r[0], r[1]) for r in snapshot.diff(old, new).collect()) == [("a", "removed"), ("b", "changed"), ("c", "added")]
    assert tuple(snapshot.delta_counts(old, new).first()) == (1, 1, 0)


def test_sources(spark, tmp_path):
    (tmp_path / "export1.csv").write_text("﻿Document Title,Abstract,IEEE Terms\nT,A,x\n", encoding="utf-8")
    (tmp_path / "two.csv").write_text("Document Title,Abstract,Publication Year,Source URL\nT,A,2020,u\n")
    (tmp_path / "three.csv").write_text("Document Title,Abstract,Publication Year,Source URL\nT,A,2020,u\n")
    (tmp_path / "bad.csv").write_text("x,y\n1,2\n")
    found = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["category"], r["valid"]) for r in readers.manifest(spark, str(tmp_path)).collect()}
    assert found == {"export1.csv": ("ieee_xplore", "export", True), "two.csv": ("web_grabber", "other", False), "three.csv": ("web_grabber", "other", True), "bad.csv": ("unsupported", "other", False)}
    assert readers.csv_to_records(readers.read_csv(spark, str(tmp_path / "export1.csv"))).first()["ieee_terms"] == ["x"]
    (tmp_path / "r.json").write_text('{"results": [{"title": "a"}, {"title": "b"}]}')
    assert sorted(r["title"] for r in readers.read_records(spark, str(tmp_path / "r.json"), "title string").collect()) == ["a", "b"]
    feed = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://x/abs/1v2</id><title>T</title><summary>S</summary><published>2024-01-02T00:00:00Z</published><author><name>N</name></author><category term="c"/></entry><entry><id>http://x/abs/2</id><title></title><summary>S</summary><published>2024-01-02T00:00:00Z</published></entry></feed>'
    row = readers.parse_feed(spark.createDataFrame([(feed,)], "feed string"), "2024-01-01").collect()
    assert [(r["feed_id"], r["authors"], r["keywords"]) for r in row] == [("1", ["N"], ["c"])]
    item = '{"title":["<b>T</b>"],"DOI":"10.1/x","author":[{"given":"A","family":"B"}],"issued":{"date-parts":[[2021,3]]}}'
    row = readers.parse_items(spark.createDataFrame([(item,)], "item string")).first()
    assert (row["title"], row["year"], row["authors"], row["url"]) == ("T", "2021", ["A B"], "https://doi.org/10.1/x")
    html = '<meta name="dc.title" content="T"><meta name="dc.creator" content="A"><meta name="dc.creator" content="B"><a href="/articles/1?x=1">l</a><a href="/articles/1">m</a>'
    row = spark.createDataFrame([(html,)], "h string").select(*readers.article_fields("h"), readers.article_links("h", base="https://n").alias("links")).first()
    assert (row["title"], row["authors"], row["links"]) == ("T", ["A", "B"], ["https://n/articles/1"])


def test_bibtex(spark):
    df = spark.createDataFrame([record(0, "A title", "10.1/ab", "2020", ["Ann Lee"])], FIELDS)
    df = df.withColumns({n: F.lit("") for n in ("article_number", "document_identifier", "start_page", "end_page", "number", "issue")})
    assert df.select(sinks.bibtex()).first()[0] == "@ARTICLE{ab,\n  author={Ann Lee},\n  journal={v},\n  title={A title},\n  year={2020},\n  doi={10.1/ab}\n}\n"


def test_stream_upserts_batches(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 1, 2)], "key string, v1 int, position long").coalesce(1).write.parquet(str(source))
    run = lambda: streaming.ingest_files(spark, str(source), "key string, v1 int, position long", target, str(tmp_path / "cp")).awaitTermination()
    run()
    assert sorted((r["key"], r["v1"]) for r in streaming.current(spark, target).collect()) == [("a", 1), ("b", 1)]
    spark.createDataFrame([("b", 9, 0), ("c", 1, 1)], "key string, v1 int, position long").coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert sorted((r["key"], r["v1"]) for r in streaming.current(spark, target).collect()) == [("a", 1), ("b", 9), ("c", 1)]


def test_paged_source(spark):
    from lectern.sources import remote

    spark.dataSource.register(remote.PagedSource)
    reader = spark.read.format("paged").option("windows", "2024-01-01:2024-01-31,2024-02-01:2024-02-29").option("query", "q").option("pause", "0")
    spark.sparkContext.addPyFile(__file__.replace("test_operators", "fetchers"))
    rows = reader.option("fetcher", "fetchers:three_pages").load().collect()
    assert len(rows) == 6 and sorted(r["title"] for r in rows)[0] == "q 2024-01-01 0"
    short = reader.option("fetcher", "fetchers:three_pages").option("pages", "2").load().collect()
    assert len(short) == 6 and sorted(r["error"] for r in short if r["error"])[0] == "2024-01-01:2024-01-31:incomplete, goes on at 2"
    failed = reader.option("fetcher", "fetchers:broken").load().collect()
    assert [r["title"] for r in failed] == [None, None] and all("no network" in r["error"] for r in failed)
    assert remote.build_query("low noise|lna", ["eess.SP"], "2024-01-01", "2024-01-31") == '(all:"low noise" OR all:lna) AND (cat:eess.SP) AND submittedDate:[202401010000 TO 202401312359]'


def test_evidence(spark):
    from lectern.functions import scoring

    row = spark.range(1).select(
        scoring.evidence_axes(F.array(F.lit("x")), F.lit(False), F.lit(True), F.array(F.lit(0.0))).alias("axes"),
        scoring.record_type(F.lit("a receiver chip"), F.lit("with an lna inside"), [" lna "], [" receiver "], [" device "], [" front end "]).alias("kind"),
        scoring.expand_terms(F.array(F.lit("LNA")), [("low noise amplifier", ["lna"]), ("mixer", ["x"])]).alias("terms"),
        scoring.venue_display(F.lit("J"), F.lit("Journal"), F.lit(3.5), F.lit("Q1")).alias("venue"),
    ).first()
    assert row["axes"] == {"technology": "evidenced", "cryogenic": "unknown", "circuit": "evidenced", "frequency": "contradicted"}
    assert (row["kind"], row["terms"], row["venue"]) == ("container_with_focus", ["LNA", "low noise amplifier", "lna"], "J (IF 3.5, Q1)")


def test_more_than_a_thousand_queries(spark):
    e = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(1100)] + [(2000, [0.0, 0.0]), (2001, None)], "query_id long, query_vector array<double>")
    found = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in vector.top_k_many(e, asked, 2).collect())
    assert found == [(i, k + 1, j) for i in range(1100) for k, j in enumerate((5, 4) if i % 2 else (0, 1))]


def test_the_best_rows_of_a_block_are_those_of_a_full_sort():
    import numpy as np

    from lectern.operators.vector import _Best

    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (5000, 4)).astype(float)  # few values: many ties and some zero rows
    x[1234] = np.nan
    owners = rng.permutation(5000)
    units = rng.integers(-2, 3, (30, 4)) + 0.5
    units /= np.sqrt((units * units).sum(axis=1))[:, None]
    norms = np.sqrt((x * x).sum(axis=1))
    for k in (1, 7, 1500):
        best = _Best(units, k)
        for s in range(0, 5000, 1000):
            best.add(x[s : s + 1000], norms[s : s + 1000], owners[s : s + 1000])
        values, names = best.result()
        near = np.concatenate([np.where(norms[s : s + 1000] > 0, units @ x[s : s + 1000].T / np.where(norms[s : s + 1000] > 0, norms[s : s + 1000], 1), 0) for s in range(0, 5000, 1000)], axis=1)
        for q in range(30):
            order = np.lexsort((owners, -np.nan_to_num(near[q], nan=-np.inf)))[:k]
            assert names[q].tolist() == owners[order].tolist() and np.array_equal(values[q], near[q][order])
