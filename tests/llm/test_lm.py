import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import lm


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    out = [""]
    for c in low:
        out = out + [""] if c in " \t\n\x0b\x0c\r" else out[:-1] + [out[-1] + c]
    return [w for w in out if w] + ["</s>"]


def fold(i):
    return 1 if i is None else zlib.crc32(str(i).encode()) % 10


def context(a, b, counts):
    """Bucket of the tokens before: seen pairs by their magnitude, else the last word by its."""
    pair, last = counts[1][a, b] if a else counts[0][b], counts[0][b]
    return (0, len(bin(pair)) - 2) if pair else (1, len(bin(last)) - 2 if last else 0)


def grams(w):
    """(u, v, w) of each token; the first follows an end alone."""
    return list(zip([None, "</s>", *w], ["</s>", *w], w))


def estimate(a, b, c, counts, n):
    one, two, three = counts
    before = two[a, b] if a else one[b]
    return three[a, b, c] / max(before, 1), two[b, c] / max(one[b], 1), one[c] / max(n, 1)


def em(dev, uniform, rounds):
    """Weights by plain expectation-maximisation over tokens: {bucket: [(estimates), ...]} to {bucket: weights}."""
    out = {}
    for bucket, tokens in dev.items():
        may = [bucket[0] == 0, bucket != (1, 0), True, True]
        w = [d * m for d, m in zip(lm.DEFAULT, may)]
        w = [x / sum(w) for x in w]
        if len(tokens) >= lm.LEAST:
            for _ in range(rounds):
                sums = [0.0] * 4
                for t in tokens:
                    joint = [x * y for x, y in zip(w, (*t, uniform))]
                    for k in range(4):
                        sums[k] += joint[k] / sum(joint)
                w = [max(x / len(tokens), lm.FLOOR) if m else 0.0 for x, m in zip(sums, may)]
                w = [x / sum(w) for x in w]
            out[bucket] = w
    return out


def brute(rows):
    """Counts, weights and scores by dictionaries, token by token."""
    every, dev = [Counter(), Counter(), Counter()], [Counter(), Counter(), Counter()]
    for i, t in rows:
        for into in [every] * (fold(i) != 0) + [dev] * (fold(i) == lm.DEVELOPMENT):
            for a, b, c in grams(words(t)):
                into[0][c] += 1
                into[1][b, c] += 1
                into[2][a, b, c] += 1
    n, v = sum(every[0].values()), len(every[0])
    uniform, rest = 1 / (v + 1), [x - y for x, y in zip(every, dev)]
    m, seen = sum(rest[0].values()), {}
    for i, t in rows:
        if fold(i) == lm.DEVELOPMENT:
            for a, b, c in grams(words(t)):
                seen.setdefault(context(a, b, rest), []).append(estimate(a, b, c, rest, m))
    weights = em(seen, uniform, 50)
    out = []
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((every[0][x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = 0.0
        for a, b, c in grams(w):
            x = weights.get(bucket := context(a, b, every))
            if x is None:
                near = [k for k in weights if k[0] == bucket[0] and (k == (1, 0)) == (bucket == (1, 0))]
                x = weights[min(near, key=lambda k: (abs(k[1] - bucket[1]), k[1]))] if near else em({bucket: []}, uniform, 0).get(bucket)
            if x is None:
                may = [bucket[0] == 0, bucket != (1, 0), True, True]
                x = [d * ok for d, ok in zip(lm.DEFAULT, may)]
                x = [d / sum(x) for d in x]
            score += math.log10(sum(p * q for p, q in zip(x, (*estimate(a, b, c, every, n), uniform))))
        out.append((i, fold(i) == 0, len(w), sum(every[0][x] > 0 for x in w), n, base, score))
    return out


def corpus():
    rng = random.Random(7)
    vocabulary = ["The", "cat", "sat", "on", "mat", "été", "dog,", "ran", "far"] + [f"w{i}" for i in range(300)]
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(vocabulary[min(int(rng.expovariate(0.05)), 308)] for _ in range(rng.randrange(60)))) for i in range(200)]
    return rows + [(300, None), (301, ""), (302, "  lead and trail  "), (None, "no id"), (3, rows[3][1]), (303, "long " * 20000), (304, "a\u00a0b nbsp")]


def test_scores_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("score", F.lit("clash")).withColumn("dev", F.lit(1))
    got = sorted((tuple(r) for r in lm.score(df).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    # the operator learns its weights from likelihood ratios in steps, the brute force from exact ones
    error = max(abs(g[6] - w[6]) / g[2] for g, w in zip(got, want))  # digits a token
    assert error < 0.03, error


def test_fine_steps_give_the_exact_weights(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEP", 1e-4)
    rows = corpus()
    got = sorted((tuple(r) for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert np.allclose([g[6] for g in got], [w[6] for w in sorted(brute(rows), key=str)], rtol=1e-5)


def test_many_blocks_and_levels_change_nothing(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = sorted((tuple(r) for r in lm.score(df).collect()), key=str)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 600)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    made = lm.materialize(lm.blocks(df), "t")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert made.count() > 30
    counts = {bits: {(r["src"], r["kind"]): [] for r in made.selectExpr("block src", "explode(array(1, 2, 3)) kind").collect()} for bits in (8, 2)}
    distinct = Counter()
    for bits, found in counts.items():  # one level, and three levels of four blocks and intervals each
        for r in sorted(lm.corpus_counts(made, bits).collect(), key=lambda r: r["path"]):
            found[r["src"], r["kind"]] += lm.unpack_ints(r["total"]).tolist() + (lm.unpack_ints(r["less"]).tolist() if r["less"] else [])
            distinct[bits, r["kind"]] += r["distinct"]
    assert all(sorted(counts[8][k]) == sorted(counts[2][k]) for k in counts[8]) and all(distinct[8, k] == distinct[2, k] for k in (1, 2, 3))
    total = lm.corpus_counts
    monkeypatch.setattr(lm, "corpus_counts", lambda made: total(made, 2))
    assert np.allclose([g[5:] for g in sorted((tuple(r) for r in lm.score(df).collect()), key=str)], [w[5:] for w in whole], rtol=1e-9)


def test_held_out_text_is_likelier_than_under_the_base(spark):
    found = lm.score(spark.createDataFrame(corpus(), "doc_id long, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > found[1]


def test_probabilities_sum_to_one():
    m = lm.MAGNITUDES
    cells = np.array([[3, 6.0, 5.0, 2.0, 40], [3, -np.inf, -np.inf, 1.0, 60], [m, -np.inf, -np.inf, -np.inf, 30], [m + 2, -np.inf, 3.0, 2.0, 50], [5, 4.0, 3.0, 1.0, 5]])
    weights = lm.learn_weights(cells)
    assert np.allclose(weights.sum(axis=1), 1) and (weights[m:, 0] == 0).all() and weights[m, 1] == 0 and (weights[:, 3] > 0).all()
    assert (weights[5] == weights[3]).all() and (weights[m + 1] == weights[m + 2]).all()


def test_coding():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (lm.unpack_sorted(lm.pack_sorted(keys)) == keys).all()
    for values in (np.array([0, 1, 255, 70000]), np.zeros(0, dtype=int)):
        assert (lm.unpack_ints(lm.pack_ints(values)) == values).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(none).count() == 0
    only = [i for i in range(100) if fold(i) == 0][:1]
    row = lm.score(spark.createDataFrame([(only[0], "held out only")], "doc_id long, text string")).first()
    assert (row["train_tokens"], row["n_known"], row["n_tokens"]) == (0, 0, 4) and abs(row["score"]) < 1e-12
