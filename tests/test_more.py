import random
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lectern.functions import scope
from lectern.operators import cards, collect, conflicts, control, keyword
from lectern.operators.durable import drop_tables, materialize, ranked, spread, temporary_tables
from lectern.plans.query import KeywordQuery, Query, build_spec
from lectern.sources import readers


def test_scope_names(spark):
    named = scope.scope_names(spark.createDataFrame([([],), ([2020],), ([2020, 2024, 2020],)], "years array<int>")).collect()
    assert [r["scope_key"] for r in named] == ["all", "years_2020", "years_2024_2020"]
    assert [r["scope_label"] for r in named] == ["Full library", "2020 only", "Years: 2024, 2020"]
    assert scope.size_text(512) == "512 B" and scope.size_text(3 << 20) == "3.0 MB" and [scope.time_text(s) for s in (5, 65, 3700)] == ["5s", "1m 05s", "1h 01m"]
    assert scope.free_name("A b/c", ["A_b_c", "A_b_c_2"]) == "A_b_c_3"


def test_ranks_and_spread(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"))
    got = [(r["v"], r["rank"]) for r in ranked(df, [F.desc("v")]).collect()]
    assert sorted(got) == [(v, 1000 - v) for v in range(1000)]
    assert ranked(df.where("v < 0"), [F.col("v")]).count() == 0
    assert spread(df.coalesce(1)).rdd.getNumPartitions() == 4 and spread(df.repartition(9)).rdd.getNumPartitions() == 9


def test_tables_of_a_block_are_dropped(spark):
    with temporary_tables(spark) as outer:
        with temporary_tables(spark) as inner:
            kept = materialize(spark.range(3), "a")
            materialize(spark.range(5), "b")
        assert outer == inner and len(inner) == 2
    drop_tables(spark, inner[1:])
    assert kept.count() == 3
    with pytest.raises(Exception, match="(?i)path"):
        spark.read.parquet(inner[1])


def test_change_detection(spark):
    files = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "path string, modified long, size long")
    one = control.source_token(files).first()
    assert one == control.source_token(files.orderBy(F.desc("path"))).first() and one["files"] == 2
    assert one["token"] != control.source_token(files.withColumn("size", F.col("size") + 1)).first()["token"] != control.source_token(files.where("false")).first()["token"]
    state = {"library_sync": {"library": "x", "token": "t"}, "enrich": {"library": "x", "token": "t", "version": 2}}
    assert not control.sync_required(state, "t", "x", True) and control.sync_required(state, "u", "x", True) and control.sync_required(state, "t", "x", False) and control.sync_required({}, "t", "x", True)
    assert not control.enrich_required(state, "t", "x", True, 2) and control.enrich_required(state, "t", "x", True, 3) and not control.enrich_required({}, "t", "x", False, 1)


def test_migrations_and_sources():
    steps = {2: lambda s: s | {"b": s["a"]}, 1: lambda s: s | {"a": 1}}
    assert control.migrate({}, steps) == {"a": 1, "b": 1, "version": 2} and control.migrate({"version": 1, "a": 5}, steps)["b"] == 5
    assert control.fetch_source({"provider": "p", "n": 1, "m": None}, {"p": lambda o: o}, {"p": {"n": 9, "m": 2}}) == {"provider": "p", "n": 1, "m": 2}
    with pytest.raises(ValueError, match="no reader"):
        control.fetch_source({"provider": "q"}, {})


def test_tasks(spark):
    tasks = control.Tasks(spark, workers=1, keep=2)

    def boom():
        raise ValueError("api_key=abc123 is wrong")

    slow, future = tasks.submit("slow", lambda: time.sleep(0.5) or "late")
    good, done = tasks.submit("good", lambda: spark.range(5).count())
    bad, failed = tasks.submit("bad", boom)
    gone, never = tasks.submit("gone", lambda: 1)
    time.sleep(0.1)
    assert tasks.cancel(slow) and tasks.cancel(gone)
    for f in (future, done, failed, never):
        f.result(timeout=60)
    assert [tasks.status(t) for t in (slow, good, bad, gone)] == ["canceled", "completed", "failed", "canceled"]
    assert tasks.result(slow) is None and tasks.result(good) == 5 and len(tasks.history) == 2 and not tasks.cancel(good)
    assert "abc123" not in tasks._now[bad].error and control.masked('{"token": "xyz"}') == '{"token": "***"}'


def test_query_families(spark):
    spec = [{"expression": "low noise amplifier"}, {"mode": "lite", "text": "noise amplifier"}, {"mode": "pro", "text": "amplifier noise"}, {"expression": "amplifier/noise"}, {"titles": ["a"]}, {"authors": ["Ann  LEE"]}, {"expression": "x", "family": "own"}, {"expression": "of"}, {"expression": "of"}]
    families = [q.family for q in collect.infer_families(spark, build_spec({"queries": spec}))]
    assert families == ["keyword:1", "semantic:2", "semantic:2", "keyword:1", "identity", "author:ann lee", "own", "keyword:3", "keyword:4"]


def test_filtered_queries_are_not_cut_short_by_others(spark):
    """A query with a filter fetches more hits, also beside one without a filter."""
    papers = spark.createDataFrame([(i, f"title {i}", 2020 if i % 20 == 7 else 2010, "v") for i in range(400)], "position long, title string, year int, venue string")
    vectors = spark.createDataFrame([(i, [1.0, i / 400.0]) for i in range(400)], "position long, embedding array<double>")
    ask = lambda texts: [[1.0, 0.0] for _ in texts]
    free, bound = Query("a", "lite", "x", limit=5), Query("b", "lite", "x", limit=5, keyword=KeywordQuery.build(years=(2020, 2020)))
    alone = collect.run_queries(papers, vectors, [bound], ask)
    both = collect.run_queries(papers, vectors, [free, bound], ask)
    positions = lambda run, q: [r["position"] for r in run.results.where(F.col("query_id") == q).orderBy("rank").collect()]
    assert positions(alone, "b") == positions(both, "b") == [7, 27, 47, 67, 87] and len(positions(both, "a")) == 5


def test_rescue_and_control_files(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("photon", "Science"), ("photon", "Science Robotics"), ("photon", None)], "title string, venue string")
    assert [r[0] for r in rows.select(collect.should_rescue(F.col("title"), F.lit(False), F.col("venue"), [], ["photon"])).collect()] == [False, True, True]
    (tmp_path / "c.json").write_text('{"a":\n 1}')
    assert readers.load_control(spark, str(tmp_path / "c.json"), 0) == {"a": 1} and readers.load_control(spark, str(tmp_path / "none"), 0) == 0
    monkeypatch.setattr(readers, "CONTROL_BYTES", 3)
    with pytest.raises(ValueError):
        readers.load_control(spark, str(tmp_path / "c.json"), 0)


def test_packs(spark, tmp_path):
    folder = f"file://{tmp_path}/pack"
    made = control.write_pack(folder, {"papers": spark.range(7), "stores": spark.range(2)})
    manifest, tables = control.read_pack(spark, folder)
    assert manifest == made and tables["papers"].count() == 7
    spark.range(3).write.mode("overwrite").parquet(f"{folder}/stores")
    with pytest.raises(ValueError, match="stores"):
        control.read_pack(spark, folder)
    spark.range(5, 7).write.mode("overwrite").parquet(f"{folder}/stores")
    with pytest.raises(ValueError, match="other rows"):
        control.read_pack(spark, folder)


def test_cards_and_reports(spark):
    assert cards.highlight_terms("low noise/lna, cmos and cmos") == ["low noise", "lna", "cmos"]
    rows = [(1, 0.7, "A low-noise LNA", "About LNA & more\nhere", "V", 60, "2025", "10.1/x", 0, None, "First A", "Last B", 75.0), (2, 0.1, None, None, "W", 50, "", "", 10, ["X Y", " "], "", "", None)]
    df = spark.createDataFrame(rows, "rank int, similarity double, title string, abstract string, venue string, venue_score int, year string, doi string, citation_count int, authors array<string>, first_author string, last_author string, llm_score double")
    shown = cards.cards(df, ["low noise", "lna"], 2026)
    a, b = shown.orderBy("rank").collect()
    assert a["title_html"] == "A <mark>low-noise</mark> <mark>LNA</mark>" and a["authors_html"] == "First A, Last B" and a["rerank_delta"] == "+5.0" and a["badge"] == "Rare" and "<br>" in a["abstract_html"] and a["score_text"] == "69.0"
    assert b["title_html"] == "Untitled" and b["authors_html"] == "X Y" and b["rerank_delta"] == "" and b["badge"] == "Noise"
    page = cards.html_report(shown, 1).collect()
    assert len(page) == 1 and "https://doi.org/10.1/x" in page[0]["html"]
    with pytest.raises(ValueError, match="view"):
        cards.view(df, "short")
    assert cards.evidence_text(df.select("title", "abstract")) is not None
    assert [r["selected"] for r in cards.batch_select(df, "perfect", False).collect()] == [True, True] and not any(r["selected"] for r in cards.batch_select(df, "valuable", False).collect())


PAPERS = [(1, "Low noise amplifier", "text one", "V", 2020), (2, "Power amplifier", "text two", "V", 2021), (3, "Antenna", "text three", "W", 2022)]


def test_runs_of_queries(spark, tmp_path):
    p = spark.createDataFrame(PAPERS, "position long, title string, abstract string, venue string, year int")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0])], "position long, embedding array<double>")
    calls = []

    def encode(texts):
        calls.append(list(texts))
        if "broken" in texts:
            raise RuntimeError("no vector for broken")
        return [[1.0, 0.1] if t == "east" else [0.1, 1.0] for t in texts]

    queries = [
        Query("a", "lite", "east", limit=2), Query("b", "lite", "broken", limit=2), Query("c", "lite", "north", limit=2), Query("d", "keyword", limit=5, keyword=KeywordQuery.build(expression="amplifier")),
        Query("e", "filtered_lite", "north", limit=5, keyword=KeywordQuery.build(expression="amplifier", years=(2021, 2022))),
    ]
    assert collect.group_queries(queries) == [[0, 1, 2], [3], [4]]
    run = collect.run_queries(p, v, queries, encode)
    assert [s["status"] for s in run.summary] == ["completed", "failed", "completed", "completed", "completed"] and run.completed == 4 and "broken" in run.summary[1]["error"]
    found = {}
    for r in run.results.orderBy("query_pos", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["position"])
    assert found == {"a": [1, 2], "c": [3, 2], "d": [2, 1], "e": [2]} and calls[0] == ["east", "broken", "north"]
    assert [s["results"] for s in run.summary] == [2, 0, 2, 2, 1]
    path = collect.write_by_query(run.results, f"file://{tmp_path}/out")
    assert spark.read.json(path).where("query_id = 'd'").count() == 2
    assert collect.run_queries(p, v, [Query("x", "lite", "broken")], encode).results.count() == 0


def test_legacy_arguments_and_pro_search(spark):
    assert [e["query_id"] for e in collect.legacy_entries(["k"], ["t"])] == ["keyword-1", "lite-1"] and collect.legacy_entries(authors=["X"]) == [{"query_id": "keyword-1", "mode": "keyword", "authors": ["X"]}]
    p = spark.createDataFrame(PAPERS, "position long, title string, abstract string, venue string, year int")
    v = spark.createDataFrame([(i, [1.0, i / 10]) for i in (1, 2, 3)], "position long, embedding array<double>")
    with pytest.raises(ValueError, match="model"):
        collect.pro_search(p, v, "q", lambda t: [[1.0, 0.0]], [" "], None)

    def fail(model, hits):
        raise RuntimeError("down")

    with pytest.raises(RuntimeError, match="down"):
        collect.pro_search(p, v, "q", lambda t: [[1.0, 0.0]], ["m"], fail)
    found, log = collect.pro_search(p, v, "q", lambda t: [[1.0, 0.0]], ["m"], lambda m, h: h.where("position = 3").select("position", F.lit(100).alias("llm_score"), F.lit("best").alias("llm_reason")), condition=F.col("year") >= 2021)
    assert [r["position"] for r in found.collect()] == [3, 2] and log == [{"model": "m", "status": "completed", "rerank_limit": 30}]


def test_search_tables_give_what_a_search_gives(spark):
    p = spark.createDataFrame([(1, "Low-Noise Amplifier", ["Ann B. Cee"], "x", 2020), (2, "Power", [], "Low noise", 2021)], "position long, title string, authors array<string>, abstract string, year int")
    q = KeywordQuery.build(expression="low noise", fields="title,abstract")
    plain, ready = keyword.search(p, q), keyword.search(keyword.search_table(p, q.fields), q)
    assert [tuple(r) for r in plain.collect()] == [tuple(r) for r in ready.collect()] and plain.columns == ready.columns
    only = p.drop("authors").withColumn("first_author", F.lit("Ann B. Cee"))
    assert [r["position"] for r in keyword.match(only, KeywordQuery.build(authors=["cee"])).collect()] == [1, 2]


def test_headers_and_control_files(spark, tmp_path):
    line = spark.createDataFrame([('"Title, long", Abstract ,"a ""b""",,x',)], "l string")
    assert line.select(readers.header_names(F.col("l"))).first()[0] == ["Title, long", "Abstract", 'a "b"', "x"]
    (tmp_path / "s.json").write_text('{"a": [1]}')
    (tmp_path / "bad.json").write_text("{")
    assert readers.load_control(spark, f"file://{tmp_path}/s.json", {}) == {"a": [1]} and readers.load_control(spark, f"file://{tmp_path}/bad.json", 7) == 7 and readers.load_control(spark, f"file://{tmp_path}/none.json", None) is None
    rows = spark.createDataFrame([("f", 1, "Masthead", "x"), ("f", 2, "A paper", "Its abstract is long enough to be taken for one, with many words.")], "source_file string, position int, title string, abstract string")
    assert [r["row_number"] for r in readers.source_records(rows).collect()] == [3]


def test_any_pair_of_variants_is_a_conflict(spark):
    rows = [("10.1/a", t, "V", f"Abstract {t}") for t in ("deep learning of circuits", "deep learning of circuit", "deep learning for circuits", "zebra crossing of antennas")]
    rows += [("10.1/b", "one title of a paper", "V", "x"), ("10.1/b", "one title of a papers", "V", "x"), ("10.1/c", "Chapter 1", "Handbook", "p"), ("10.1/c", "Something else here", "Handbook", "q")]
    df = spark.createDataFrame(rows, "doi string, title string, venue string, abstract string").withColumn("year", F.lit("2020"))
    assert [r["id"] for r in conflicts.title_conflicts(df).collect()] == ["doi_title::10.1/a"]
    long = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([("10.1/a", "t", "V", long), ("10.1/a", "t", "V", long + " and more"), ("10.1/b", "t", "V", long), ("10.1/b", "t", "V", "other things altogether")], "doi string, title string, venue string, abstract string")
    assert [r["id"] for r in conflicts.abstract_conflicts(df).collect()] == ["doi_abstract::10.1/b"]


def test_ratio_bounds_agree_with_the_matcher():
    rng = random.Random(8)
    words = "deep noise low amplifier of in cmos design a the wide band".split()
    for _ in range(3000):
        a = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))
        b = rng.choice([a + "s", a[2:], a[::-1], " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))), a.replace("e", "x", 2), "new " + a])
        for least in (0.5, 0.82):
            assert conflicts.ratio_below(a, b, least) == (SequenceMatcher(None, a, b, autojunk=False).ratio() < least), (a, b)


def test_variants_in_blocks_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(conflicts, "BLOCK", 4)
    rng = random.Random(9)
    base = "wide band low noise amplifier in bulk cmos"
    rows, want = [], set()
    for d in range(40):
        titles = {base[: rng.randrange(30, 43)] + rng.choice(["", " x", " of yy", " chip"]) for _ in range(rng.choice([2, 3, 12, 30]))}
        rows += [(f"10.1/{d}", t, "V", "x") for t in titles]
        keys = sorted({" ".join(t.split()) for t in titles})
        if any(SequenceMatcher(None, x, y, autojunk=False).ratio() < 0.82 for i, x in enumerate(keys) for y in keys[i + 1 :]):
            want.add(f"doi_title::10.1/{d}")
    df = spark.createDataFrame(rows, "doi string, title string, venue string, abstract string").repartition(3)
    assert {r["id"] for r in conflicts.title_conflicts(df).collect()} == want and 3 < len(want) < 40
    assert conflicts.title_conflicts(df.where("false")).count() == 0


def test_a_doi_of_many_variants_that_agree(spark):
    n = 20_000
    df = spark.range(n).selectExpr("'10.1/hot' as doi", "concat('a long title of a paper on wide band low noise amplifiers, version ', id) as title", "'V' as venue", "'x' as abstract")
    assert conflicts.title_conflicts(df).count() == 0


def test_evidence_of_records(spark):
    from lectern.functions import scoring
    from lectern.operators import evidence

    said = ["18 每 26 GHz and 18-26 ghz, 18-26 GHz", "1.5 to 900 MHz; 26–18 GHz; C band", "v1.2-3 GHz and 4-5GHz", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").orderBy("i")
    found = [[tuple(m) for m in r[0]] for r in df.select(scoring.frequency_mentions("t")).collect()]
    assert found == [[(18.0, 26.0, "18-26 GHz", False)], [(0.0015, 0.9, "1.5 to 900 MHz", False), (4.0, 8.0, "C-band", True)], [(1.2, 3.0, "1.2-3 GHz", False), (4.0, 5.0, "4-5GHz", False)], []]
    rows = [
        (0, "A cryogenic low-noise amplifier in InP", "Measured at 4 K over 4-8 GHz and in C-band.", ["HEMT"], "4-8"), (1, "A CMOS mixer preprint", "Simulations at 300 K, 30-40 GHz.", [], None),
        (2, None, None, None, None), (3, "An InPut buffer", "Experimental 2-4 GHz at 77 K", [], "bad"),
    ]
    r = {x["position"]: x for x in evidence.snapshot(spark.createDataFrame(rows, "position long, title string, abstract string, keywords array<string>, lna_band_ghz string"), (4, 8)).collect()}
    assert (r[0]["technologies"], r[0]["temperature_buckets"], r[0]["measurement"], r[0]["missing"], r[0]["credibility_flags"]) == (["InP"], ["<=4.2K"], "measured", [], [])
    assert (r[0]["best"]["text"], r[0]["best"]["relation"], r[0]["best"]["field"], len(r[0]["frequencies"])) == ("4-8 GHz", "full_cover", "", 3)
    assert (r[1]["technologies"], r[1]["missing"], r[1]["credibility_flags"]) == (["CMOS"], ["cryogenic", "circuit", "frequency"], ["preprint_requires_primary_evidence_check", "simulation_only"])
    assert r[1]["axes"]["frequency"] == "contradicted" and r[1]["best"]["relation"] == "outside"
    assert (r[2]["frequencies"], r[2]["best"], r[2]["measurement"], r[2]["axes"]["frequency"]) == ([], None, "unknown", "unknown")
    assert (r[3]["technologies"], r[3]["best"]["relation"], r[3]["axes"]["cryogenic"], r[3]["missing"]) == ([], "endpoint_only", "evidenced", ["technology", "circuit", "frequency"])
    plain = evidence.snapshot(spark.createDataFrame([(0, "4-8 GHz")], "position long, title string")).first()
    assert plain["best"] is None and plain["axes"]["frequency"] == "unknown" and plain["frequencies"][0]["high"] == 8.0
