import math
import os
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import quality

SF = "/root/testdata/sf0.01"


def made(seed=0, n=160):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice("the and river stone walks along quiet evening lamp of with".split()) for _ in range(rng.randrange(5, 200))]
        good = i % 3 > 0
        rows.append((i, " ".join(words).capitalize() + "." if good else "!! ".join(w.upper() for w in words)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = made()
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (902, "word " * 50000), (None, "No id here."), (5, rows[5][1])], "doc_id long, text string").withColumn("x", F.lit("clash")).withColumn("score", F.lit(1))
    labs = spark.createDataFrame(labels + [(901, None, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.score_documents(docs, labs).collect()
    assert len(found) == len(rows) + 5
    truth = dict((a, b) for a, b, _ in labels)
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([truth[r["doc_id"]] == r["predicted"] for r in held]) >= 0.95
    kept = quality.keep_good(docs, labs)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in found)


def test_held_out_labels_change_nothing(spark):
    rows, labels = made()
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    score = lambda ls: sorted((r["doc_id"], r["score"]) for r in quality.score_documents(docs, spark.createDataFrame(ls, "doc_id long, quality int, toxic int")).collect())
    assert score(labels) == score(flipped)


def test_without_labels(spark):
    rows, _ = made(n=10)
    docs, none = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score_documents(docs, none).collect()} == {0.5}
    assert quality.score_documents(docs.where("false"), none).count() == 0


def test_moments_equal_numpy(spark):
    rng = np.random.default_rng(0)
    d = len(quality.FEATURES)
    x, y = rng.standard_normal((200, d)), rng.integers(0, 2, 200)
    model = quality.fit(spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "x array<double>, label int"), pooled=0.0, identity=0.0)
    for c in (0, 1):
        assert np.allclose(model.means[c], x[y == c].mean(axis=0))
        cov = np.cov(x[y == c].T, bias=True) + 1e-9 * np.eye(d)
        assert np.allclose(model.factors[c].T @ model.factors[c], np.linalg.inv(cov))


def plain_statistics(text):
    """The statistics again, counted sign by sign."""
    text = text or ""
    words = re.findall(r"\S+", text)
    if not words:
        return [0.0] * len(quality.FEATURES)
    n = sum(len(c.encode()) for c in text)
    count = lambda signs: sum(c in signs for c in text) / n
    lines = [x for x in re.split("\n", text) if re.search(r"\S", x)]
    long = [x for x in lines if len(x) > 20]
    log = lambda v: math.log(v) / math.log(10)
    share = lambda test: sum(map(bool, map(test, words))) / len(words)
    signs = set("#$%&*!|@<>{}[]\\^~=+_/")
    return [
        log(1 + len(words)) / 5, min(sum(len(w) for w in words) / len(words), 20) / 10, count(set(string.ascii_uppercase)) ** 0.5, count(set(string.digits)) ** 0.5,
        (count({","}) + count({"."})) ** 0.5, count({"!"}) ** 0.5, count({"|"}) ** 0.5, count(set("#$%&*@<>{}[]\\^~=+_/")) ** 0.5, count(set(" \n\t\r")),
        share(lambda w: set(w) <= signs | set(".,;:-0123456789")) ** 0.5, share(lambda w: w[-1] in signs) ** 0.5, share(str.isupper) ** 0.5,
        len({*words}) / len(words) * log(1 + len(words)) / 5, 1 - len({*long}) / len(long) if long else 0.0, log(1 + len(words) / max(len(lines), 1)) / 4, share(lambda w: len(w) < 4),
    ]


def test_scores_equal_brute_force(spark):
    """Statistics sign by sign, densities by inverse and determinant of each covariance."""
    rows, labels = made(seed=4)
    rng = random.Random(5)
    rows = [(i, t + rng.choice(["", " #1 | two", "\nA line that is repeated.\nA line that is repeated.", " ok? 12.5% <b> MORE", " été ñ"])) for i, t in rows] + [(900, None), (901, " \n")]
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    x = {i: np.array(plain_statistics(t)) for i, t in rows}
    assert all(np.allclose(x[i], quality.statistics(t), atol=1e-12) for i, t in rows)
    known = [(i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    groups = [np.array([x[i] for i, q in known if q == c]) for c in (0, 1)]
    d, total = len(quality.FEATURES), sum(map(len, groups))
    pooled = sum(np.cov(g.T, bias=True) * len(g) for g in groups) / total
    parts = []
    for g in groups:
        cov = (1 - quality.POOLED) * np.cov(g.T, bias=True) + quality.POOLED * pooled
        cov = (1 - quality.IDENTITY) * cov + quality.IDENTITY * np.trace(cov) / d * np.eye(d) + 1e-9 * np.eye(d)
        parts.append((g.mean(axis=0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1], math.log(len(g) / total)))
    for i, v in x.items():
        a, b = (p - 0.5 * (v - m) @ inv @ (v - m) - 0.5 * det for m, inv, det, p in parts)
        assert abs(got[i] - 1 / (1 + math.exp(min(700, max(-700, a - b))))) < 1e-6


def test_bounded_training_sample(spark):
    rows, labels = made()
    docs, labs = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert quality.train(docs, labs, rows=40).prior != quality.train(docs, labs).prior or len(quality.train(docs, labs, rows=40).means) == 2


def test_training_takes_one_python_worker_a_task(spark):
    rows, labels = made()
    docs, labs = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    parts = quality.labelled_moments(docs, labs)
    plan = parts.groupBy("label", "at").agg(F.sum("v"))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("MapInArrow|ArrowEvalPython|MapInPandas|BatchEvalPython", plan)) == 1
    known = [(quality.statistics(dict(rows)[i]), q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    one, whole = quality.train(docs, labs), quality.fit(spark.createDataFrame(known, "x array<double>, label int"))
    assert np.allclose(one.means, whole.means) and np.allclose(one.factors, whole.factors) and one.prior == whole.prior


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_accuracy_on_the_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = quality.score_documents(docs, labels).where("held_out").join(labels, "doc_id")
    assert held.select(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] >= 0.97
