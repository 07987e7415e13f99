import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lectern.llm import decontam


def brute(docs, items, threshold=0.8, width=5):
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    out = {}
    for d, t in docs:
        w = words(t)
        for i, x in items:
            y = words(x)
            if not y:
                continue
            k = min(width, len(y))
            aim = Counter(tuple(y[j : j + k]) for j in range(len(y) - k + 1))
            m = sum(aim.values())
            grams = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
            for s in range(max(1, len(grams) - m + 1)):
                win = Counter(grams[s : s + m])
                common = sum((win & aim).values())
                total = sum((win | aim).values())
                if total and common / total >= threshold:
                    out[d, i] = max(out.get((d, i), 0), round(common / total, 9))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz éa ñb".split()) + rng.choice("xyz")
    items = [(i, " ".join(word() for _ in range(rng.randrange(12, 50)))) for i in range(12)] + [(20, "Tiny item"), (21, ""), (22, None), (23, "repeat repeat repeat repeat repeat repeat repeat")]
    docs = []
    for d in range(60):
        text = [word() for _ in range(rng.randrange(0, 150))]
        if d % 3 == 0:
            own = items[rng.randrange(12)][1].split()
            if d % 2:
                own[rng.randrange(len(own))] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = own
        docs.append((d, ", ".join(text).upper() if d % 4 == 0 else "\n".join(text)))
    docs += [(100, None), (101, ""), (102, "a TINY, item here"), (103, "repeat " * 40), (104, items[0][1]), (104, "clean"), (105, "x " * 20000 + items[1][1]), (None, items[2][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({n: F.lit(1) for n in ("key", "m", "leak", "_row")})
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontam.find_leaks(df, bench).collect()}
    assert found == brute(docs, items)
    kept = decontam.decontaminate(df, bench)
    leaky = {d for d, _ in found}
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == sorted([str(d) for d, _ in docs if d not in leaky] + ["104"])
    assert kept.columns == df.columns


def test_starts_of_windows_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        size, m = rng.randrange(1, 40), rng.randrange(1, 12)
        hits = sorted(rng.sample(range(size), rng.randrange(1, size + 1)))
        rows.append((hits, m, max(size - m, 0), rng.randrange(1, m + 1)))
    df = spark.createDataFrame(rows, "hits array<int>, m int, last int, need int")
    for (hits, m, last, need), r in zip(rows, df.select(decontam.window_starts(*(F.col(c) for c in df.columns)).alias("s")).collect()):
        assert r["s"] == [s for s in range(last + 1) if sum(s <= h < s + m for h in hits) >= need]


def test_blocks_guarantee_the_radius(spark):
    rng = random.Random(5)
    rows = [(sum(1 << b for b in rng.sample(range(64), n)),) for n in range(25) for _ in range(20)]
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x, in rows], "differ long")
    assert df.where(decontam.share_a_block(F.col("differ"))).count() == len(rows)
    assert spark.createDataFrame([(-1,)], "differ long").where(decontam.share_a_block(F.col("differ"))).count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(docs, none).count() == 0 and decontam.decontaminate(docs, none).count() == 1
    assert decontam.find_leaks(docs.where("false"), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
