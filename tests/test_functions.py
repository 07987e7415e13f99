import pytest
from pyspark.sql import functions as F

from lectern.functions import dates, keys, scoring, text
from lectern.operators import conflicts, filters
from lectern.plans.query import KeywordQuery, build_spec, parse_expression, parse_fields, parse_year_range


def values(spark, column, rows, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_normalize_matches_known_forms(spark):
    rows = ["Rücker 12 μW", "GF SiGe130nm at 4K", None, "", "C++ ß × 3–4", "10 Ω"]
    expected = ["rucker 12 u w" if False else "rucker 12 uw", "gf sige 130 nm at 4 k", "", "", "c++ x 3 4", "10 ohm"]
    assert values(spark, text.normalize("v"), rows) == expected
    assert values(spark, text.normalize_any_script("v"), rows) == expected


def test_doi_year_and_lists(spark):
    assert values(spark, text.doi_selector("v"), ["https://doi.org/10.1/A", " doi: 10.1/a ", None]) == ["10.1/a", "10.1/a", ""]
    assert values(spark, text.year_of("v"), ["12345", "in 2019", "x", None]) == [1234, 2019, 0, 0]
    assert values(spark, text.distinct_values(text.split_values("v")), ["A; b;a ;; B", None]) == [["A", "b"], []]
    assert values(spark, text.doi_link("v"), ["10.1/a(b) c", ""]) == ["https://doi.org/10.1/a(b)%20c", ""]
    assert values(spark, text.first_json_array("v"), ['say ["a","b"] ok', "none"]) == [["a", "b"], []]


def test_dates(spark):
    rows = ["5 Mar. 2020", "March 2021", "Sept. 3, 2019", "2018-04-09", "3/14/2017", "about 2015 or so", "1999", "x", None]
    assert values(spark, dates.date_score("v"), rows) == [20200305, 20210301, 20190903, 20180409, 20170314, 20150101, 19990101, 0, 0]
    found = dates.date_windows(spark, "2024-01-01", "2024-04-10", 60).collect()
    assert [(str(r["first"]), str(r["last"])) for r in found] == [("2024-02-11", "2024-04-10"), ("2024-01-01", "2024-02-10")]
    assert dates.date_windows(spark, "2025-01-01", "2024-01-01").count() == 0
    assert dates.date_windows(spark, None, "2024-01-01").collect()[0]["first"] is None


def test_parsers():
    assert parse_expression("LNA/amplifier, 'low noise' and x & y") == [["LNA", "amplifier"], ["low noise"], ["x"], ["y"]]
    assert parse_year_range("2019:2021") == (2019, 2021) and parse_year_range("2020") == (2020, 2020) and parse_year_range("", 2026) == (2000, 2026)
    with pytest.raises(ValueError):
        parse_year_range("2022-2020")
    assert parse_fields("author, ieee") == ("authors", "ieee_terms")
    with pytest.raises(ValueError):
        parse_fields("nothing")


def test_specification():
    queries = build_spec({"defaults": {"limit": 5}, "queries": [{"expression": "a"}, {"mode": "lite", "text": "noise amplifier"}, {"mode": "pro", "text": "amplifier noise", "enabled": True}, {"expression": "b", "enabled": False}]})
    assert [q.limit for q in queries] == [5, 5, 5]
    for bad in ({"mode": "x"}, {"mode": "lite"}, {"mode": "keyword"}, {"expression": "a", "limit": True}):
        with pytest.raises(ValueError):
            build_spec({"queries": [bad]})
    assert not KeywordQuery.build().has_constraints


def test_scores_and_bands(spark):
    assert values(spark, scoring.badge(F.col("v")), [0.7, 0.5, 0.3, 0.2, 0.1], "v double") == ["Rare", "Perfect", "Highly Valuable", "Relevant", "Noise"]
    assert [None if b is None else (b.low, b.high) for b in values(spark, scoring.parse_band("v"), ["4-8 GHz", "8 to 4", "x", None])] == [(4.0, 8.0), None, None, None]
    rel = lambda a, b: scoring.band_relation(F.lit(a), F.lit(b), F.lit(4.0), F.lit(8.0))
    row = spark.range(1).select(rel(4.0, 8.0), rel(5.0, 6.0), rel(1.0, 4.0), rel(9.0, 10.0), rel(6.0, 10.0)).first()
    assert list(row) == ["full_cover", "inside_target", "endpoint_only", "outside", "partial_overlap"]
    said = values(spark, scoring.frequency_mentions("v"), ["3-5 GHz and 800-900 MHz at C-band, 9-2 GHz"])[0]
    assert [(m["low"], m["high"]) for m in said] == [(3.0, 5.0), (0.8, 0.9), (4.0, 8.0)]


def test_junk_rules(spark):
    rows = [("Table of Contents", "x" * 100, ""), ("Guest editorial", "y" * 40, "10.1/a"), ("Guest editorial", "y" * 60, ""), ("A paper", "short", ""), ("A paper", "z" * 60, ""), ("Contributors", "z" * 60, ""), (None, None, None)]
    df = spark.createDataFrame(rows, "t string, a string, d string")
    assert [r[0] for r in df.select(filters.is_junk("t", "a", "d")).collect()] == [True, False, True, True, False, True, True]


def test_keys(spark):
    df = spark.createDataFrame([("10.1/A", "T", "2020"), ("", "A Title", "2020"), ("", "A Title", ""), ("", "", "")], "doi string, title string, year string")
    df = df.withColumn("authors", F.array(F.lit("x"))).withColumn("venue", F.lit("v")).withColumn("abstract", F.lit("a"))
    found = [r[0] for r in df.select(keys.publication_key()).collect()]
    assert found[:3] == ["doi:10.1/a", "title_year:a title|2020", "title:a title"] and found[3].startswith("metadata:")
    assert [len(r[0]) for r in df.select(keys.identity_levels()).collect()] == [3, 2, 1, 0]


def test_sequence_ratio(spark):
    from difflib import SequenceMatcher

    df = spark.createDataFrame([("abcd", "bcde"), ("", "x")], "a string, b string")
    assert [r[0] for r in df.select(conflicts.ratio(F.col("a"), F.col("b"))).collect()] == [SequenceMatcher(None, "abcd", "bcde", autojunk=False).ratio(), 0.0]
