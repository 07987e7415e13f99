import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if at < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == corpus_pipeline.COLUMNS
            counts.append(out.count())
            docs = out
    assert counts[0] > counts[1] > counts[2] > counts[3] * 0.99 and counts[3] == counts[4] > 0.5 * counts[0]
    pieces = spark.read.parquet(str(tmp_path / "packing"))
    assert pieces.select("doc_id").distinct().count() == counts[4]


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run_and_queries(spark):
    import __spark_entry__

    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] > 0
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_stages_take_odd_rows(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns of clashing names."""
    long = " ".join(f"word{i % 977} and more of it" for i in range(20_000))
    prose = "The quiet river walks along the old stone bridge in the evening, and the lamps are lit one by one while the boats come home."
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n ", None, None, 3), (4, prose, "en", "a", len(prose)), (4, prose, "en", "a", len(prose)), (5, prose, "de", "b", len(prose))]
    rows += [(6, long, "en", "a", len(long)), (None, prose + " No id.", "en", "a", 9), (7, prose + " Mail to jane@mail.example.com today.", "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({n: F.lit("clash") for n in ("row_key", "leak", "key", "kind", "pii_kinds", "pii_row", "found", "vertex", "equal_rows", "start", "score", "_row")})
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        kept[name] = out.collect()
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
    ids = lambda name: sorted((r["doc_id"] for r in kept[name]), key=str)
    assert 1 <= len(kept["quality"]) <= len(rows) and set(ids("quality")) <= {r[0] for r in rows}
    assert ids("near_dedup").count(4) == 1 and 5 not in ids("near_dedup") and ids("near_dedup").count(1) == 1 and not {2, 3} & set(ids("near_dedup"))
    assert len(kept["decontam"]) == len(kept["pii"]) == len(rows)
    mails = [r["text"] for r in kept["pii"] if r["doc_id"] == 7]
    assert "jane" not in mails[0] and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in kept["pii"])
    pieces = {}
    for r in kept["packing"]:
        pieces.setdefault(r["doc_id"], []).append(r["length"])
    assert set(pieces) == {r[0] for r in rows} and pieces[1] == pieces[2] == pieces[3] == [1] and sum(pieces[6]) > 60_000
