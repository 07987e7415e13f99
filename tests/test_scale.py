"""Steps that must not grow with the square of their input, and keep their results."""

import random

from pyspark.sql import functions as F

from lectern.functions import scoring
from lectern.operators import collect, conflicts, ingest, vector
from lectern.operators.collect import ALIKE


def test_many_queries_with_short_ids_are_one_block(spark):
    """More queries than an expression takes, with ids that aren't long, and ties at the last place."""
    rows = [(i, [float(i % 7), 1.0]) for i in range(300)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(q, [float(q % 5), 1.0]) for q in range(20)], "query_id int, query_vector array<double>")
    got = {}
    for r in vector.top_k_many(base, asked, 4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    near = lambda q, i: (q % 5 * (i % 7) + 1) / ((q % 5) ** 2 + 1) ** 0.5 / ((i % 7) ** 2 + 1) ** 0.5
    for q in range(20):
        assert [v for _, v in sorted(got[q])] == sorted(range(300), key=lambda i: (-round(near(q, i), 12), i))[:4]


def test_families_are_those_of_one_query_at_a_time(spark):
    random.seed(3)
    texts = [" ".join(random.sample("red green blue cold warm low high noise".split(), random.randint(1, 4))) for _ in range(80)] + ["of", ""]
    modes = [random.choice(["keyword", "lite"]) for _ in texts]
    rows = [(i, m, "", [], [], [], t) for i, (m, t) in enumerate(zip(modes, texts))]
    asked = spark.createDataFrame(rows, "query_pos int, mode string, family string, titles array<string>, dois array<string>, authors array<string>, text string")
    leads, wanted = [], {}
    for i, (m, t) in enumerate(zip(modes, texts)):
        kind, words = "keyword" if m == "keyword" else "semantic", set(t.split()) - {"of"}
        alike = [name for name, k, w in leads if k == kind and w and words and len(w & words) / min(len(w), len(words)) >= ALIKE]
        wanted[i] = alike[0] if alike else f"{kind}:{len(leads) + 1}"
        if not alike:
            leads.append((wanted[i], kind, words))
    assert {r["query_pos"]: r["family"] for r in collect.query_families(asked).collect()} == wanted
    assert collect.query_families(asked.where(F.lit(False))).count() == 0


def test_rows_of_a_common_title_settle_in_few_rounds(spark):
    """Rows of one title in one record, of others by other keys, are decided together, not one a round."""
    random.seed(5)
    rows, holder, wanted, state = [], {}, {}, {}
    for i in range(400):
        doi = random.choice(["", "", f"d{random.randrange(4)}"])
        title, year = random.choice(["one", "one", "two", f"t{random.randrange(30)}", ""]), random.choice(["", "2001", "2002", "2003"])
        rows.append((i, doi, title, year))
        keys = [f"doi::{doi}"] * bool(doi) + [f"title_year::{title}::{year}"] * bool(title and year) + [f"title::{title}"] * bool(title)
        if not keys:
            continue
        name = next((holder[k] for k in keys if holder.get(k)), keys[0])
        start, t, y = state.get(name, (i, "", ""))
        state[name] = start, title or t, year or y
        for k in keys + [f"title_year::{title or t}::{year or y}"] * bool((title or t) and (year or y)):
            if holder.setdefault(k, name) != name:
                holder[k] = None
        wanted[i] = start
    df = spark.createDataFrame(rows, "position long, doi string, title string, year string")
    assert {r["position"]: r["canonical"] for r in ingest.resolve_keys(df, small=1, max_rounds=12).collect()} == wanted


def test_mentions_are_read_once_a_text(spark):
    """The plan holds each regular expression as often as the text is read: once; results are those of all mentions, the last of equal ones."""
    df = spark.createDataFrame([("1-2 GHz, 1-2 ghz, 3 每 4 MHz, 9-5 GHz and c-band",), ("none",), (None,)], "t string").select(scoring.frequency_mentions("t").alias("f"))
    got = [[(m["low"], m["high"], m["text"], m["inferred"]) for m in r["f"]] for r in df.collect()]
    assert got == [[(1.0, 2.0, "1-2 ghz", False), (0.003, 0.004, "3-4 MHz", False), (4.0, 8.0, "C-band", True)], [], []]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_values_of_a_doi_are_made_once(spark):
    """Texts are prepared in one pass; empty abstracts conflict with none, and an empty one that is no book counts for books."""
    a, b = "cold low noise amplifier of two stages", "a survey of antennas"
    rows = [("d1", a, "v", "t"), ("d1", "", "v", "t"), ("d1", a + " ", "v", "t"), ("d2", a, "v", "t"), ("d2", b, "v", "t"), ("d3", a, "book", "t"), ("d3", b, "book", "t"), ("d4", a, "book", "t"), ("d4", b, "book", "t"), ("d4", " ", "v", "t")]
    df = spark.createDataFrame(rows, "doi string, abstract string, venue string, title string")
    assert sorted(r["id"] for r in conflicts.abstract_conflicts(df).collect()) == ["doi_abstract::d2", "doi_abstract::d4"]
    plan = conflicts._variants(df, F.lower(F.regexp_replace("abstract", "x+", "y")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_lines_of_one_row_group_are_read_by_all_cores(spark):
    """Evidence costs far more a row than a shuffle: lines of a file with one row group don't stay in one task."""
    from lectern.plans.catalogue import QUERIES
    from lectern.plans import catalogue_more  # noqa: F401

    found = QUERIES["evidence_snapshots"](spark, "/root/testdata/sf0.001")
    sizes = [r["n"] for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 4 and max(sizes) < sum(sizes) / 4
