import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lectern.llm import simhash


def brute(text, width=3):
    words = []
    now = ""
    for ch in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""):
        if ch in " \t\n\x0b\x0c\r":
            words, now = (words + [now] if now else words), ""
        else:
            now += ch
    words += [now] if now else []
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(rows, threshold=2):
    """Components by comparing all pairs."""
    fps = [brute(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold:
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", ids.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(rng.randrange(30))
    rows = []
    for i in range(n):
        base = [word() for _ in range(rng.randrange(1, 120))]
        rows.append((i * 3, " ".join(base)))
        for k in range(rng.randrange(3)):
            copy = list(base)
            if k:
                copy[rng.randrange(len(copy))] = word()
            rows.append((1000 + len(rows), "\n".join(copy)))
    return rows


def test_every_near_pair_shares_an_anchor():
    rng = random.Random(0)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(3)):
            b ^= 1 << bit
        pair = np.array([a, b], dtype=np.uint64).view(np.int64)
        key, owner = simhash.anchors(pair)
        sets = [set(key[owner == x].tolist()) for x in pair]
        assert sets[0] & sets[1] and len(key) <= 2 * 32 + 64
        home = [k for k in sets[0] if simhash._home(np.array([k]), pair[:1])[0]]
        assert len(home) == 2 and (set(home) & sets[1])


def test_components_equal_brute_force(spark):
    rows = corpus() + [(7001, None), (7000, ""), (7002, " \t "), (7003, "Tie tie"), (7003, "tie Tie"), (None, "lonely words of nobody"), (None, "tie tie"), (8000, "long " * 30000 + "end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    found = simhash.near_duplicates(df).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    assert sorted((tuple(r) for r in found.collect()), key=str) == groups(rows)


def test_large_groups_of_near_copies():
    rng = random.Random(5)
    base = rng.getrandbits(64)
    near = list({base ^ sum(1 << b for b in rng.sample(range(10), rng.randrange(4))) for _ in range(400)})
    fps = np.array(near, dtype=np.uint64).view(np.int64)
    key, owner = simhash.anchors(fps)
    order = np.argsort(key, kind="stable")
    found = simhash.links_by_anchor(key[order], owner[order])
    parent = {int(x): int(x) for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        parent[find(a)] = find(b)
    for i, a in enumerate(near):
        for j in range(i):
            if (a ^ near[j]).bit_count() <= 2:
                assert find(int(fps[i])) == find(int(fps[j]))
    assert len(found) < len(near) and all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in found)


def test_hot_anchors_are_compared_in_blocks(spark):
    rng = random.Random(6)
    base = rng.getrandbits(63)
    near = list({base ^ sum(1 << b for b in rng.sample(range(12), rng.randrange(4))) for _ in range(300)} | {rng.getrandbits(63) for _ in range(50)})
    df = spark.createDataFrame([(x,) for x in near], "fp long")

    def joined(pairs):
        parent = {x: x for x in near}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in pairs:
            parent[find(r[0])] = find(r[1])
        roots = {}
        return [roots.setdefault(find(x), x) for x in near]

    whole = [(a, b) for i, a in enumerate(near) for b in near[:i] if (a ^ b).bit_count() <= 2]
    for home_rows in (5, 40, 4096):
        found = simhash.links(df, home_rows).collect()
        assert all((r["a"] ^ r["b"]).bit_count() <= 2 for r in found) and joined(found) == joined(whole)


def test_partners_are_verified_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PARTNERS", 7)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    sets = {i: np.r_[base[: 200 - i], rng.integers(0, 1 << 62, i).astype(np.uint64)] for i in range(60)}
    rows = spark.createDataFrame([(i, bytearray(simhash._as_set(x))) for i, x in sets.items()], "vertex long, shingles binary")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(5, 9), (3, 59)], "a long, b long")
    near = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
    assert sorted(map(tuple, simhash.verified(pairs, rows).collect())) == sorted((r["a"], r["b"]) for r in pairs.collect() if near(r["a"], r["b"]))


def test_clusters_in_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CLUSTER", 40)
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    sets = []
    for f in range(12):  # families that are alike below the threshold, with members that reach it
        own = np.r_[base[rng.permutation(300)[:200]], rng.integers(0, 1 << 62, 100).astype(np.uint64)]
        sets += [np.r_[own[rng.permutation(300)[: 300 - c]], rng.integers(0, 1 << 62, c).astype(np.uint64)] for c in (0, 10, 20, 28, 34, 60, 90, 15, 5, 12)]
    data = [simhash._as_set(x) for x in sets]
    real = [simhash._from_set(x) for x in data]
    near = [(i, j) for j in range(len(real)) for i in range(j) if len(np.intersect1d(real[i], real[j])) >= 0.8 * len(np.union1d(real[i], real[j]))]
    crowd = spark.createDataFrame([(t, i, i) for i in range(len(sets)) for t in (1, 2 + i % 3)], "token long, vertex long, root long")
    found, leads = simhash.cluster_links(crowd, spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(data)], "vertex long, shingles binary"))
    links = [tuple(sorted(r)) for r in found.collect()]
    assert set(links) <= set(near) and {r["lead"] for r in leads.collect()} == {0}

    def groups(pairs):
        parent = list(range(len(sets)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
        return [find(i) for i in range(len(sets))]

    assert groups(links) == groups(near) and len(near) > 100 and len(links) < 6 * len(sets)


def test_one_row_of_each_group_stays(spark):
    rows = [(2, "a b c d e f"), (1, "A b c d e f"), (1, "A b c d e f"), (5, "quite another text here now"), (None, "nobody has this one text"), (None, "nobody has this one text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("clash") for n in ("row_key", "equal_rows", "vertex", "_row", "a.b")})
    kept = simhash.keep_representatives(df)
    clash = ("clash",) * 5
    assert kept.columns == df.columns
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([(1, "A b c d e f", *clash), (5, "quite another text here now", *clash), (None, "nobody has this one text", *clash)], key=str)
    assert simhash.keep_representatives(df.where("doc_id < 0")).count() == 0
    assert simhash.near_duplicates(df.where("doc_id < 0")).count() == 0


def test_similar_texts_join_and_others_stay(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr st".split()) + str(rng.randrange(500))
    rows, families = [], []
    for f in range(25):
        base = [word() for _ in range(rng.randrange(60, 200))]
        family = [base]
        for k in range(4):
            copy = list(base)
            if k == 1:
                copy[rng.randrange(len(copy))] = word()
            elif k == 2:
                copy = copy[: int(len(copy) * 0.93)]
            elif k == 3:
                at = rng.randrange(len(copy) // 2)
                copy[at : at + len(copy) // 3] = [word() for _ in range(len(copy) // 3)]
            family.append(copy)
        for copy in family:
            rows.append((len(rows), " ".join(copy)))
        families.append(range(len(rows) - 5, len(rows)))

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [grams(t) for _, t in rows]
    want = set()
    for own in families:
        groups = []
        for i in own:
            near = [g for g in groups if any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in g)]
            groups = [g for g in groups if g not in near] + [sum(near, [i])]
        want |= {min(g) for g in groups}
    kept = simhash.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == want


def edited(rng, base, word, kind):
    cut = rng.randrange(int(len(base) * 0.08), int(len(base) * 0.2))
    if kind == 0:
        return base[:-cut]
    at = rng.randrange(len(base) - cut)
    half = cut // 2
    return base[:at] + [word() for _ in range(half)] + base[at + half :]


def test_cut_tails_and_replaced_blocks_all_meet(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr st".split()) + str(rng.randrange(400))
    rows, near = [], 0
    for f in range(250):
        base = [word() for _ in range(rng.randrange(80, 400))]
        copy = edited(rng, base, word, f % 2)
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, copy))
        if len(x & y) >= 0.8 * len(x | y):
            near += 1
            rows += [(2 * f, " ".join(base)), (2 * f + 1, " ".join(copy))]
    kept = simhash.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert near > 150 and {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows if i % 2 == 0}


def test_large_groups_lose_no_similar_pair(spark):
    rng = random.Random(8)
    parts = [[f"w{k}x{i}" for i in range(16)] for k in range(10)]  # all texts have the same words, every shingle is in many
    orders = []
    for _ in range(400):
        base = rng.sample(range(10), 10)
        at = rng.randrange(9)
        orders += [base, base[:at] + [base[at + 1], base[at]] + base[at + 2 :]]
    texts = [[w for k in order for w in parts[k]] for order in orders]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for j in range(len(texts)):
        for i in range(j):
            if len(sets[i] & sets[j]) * 9 >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    docs = spark.createDataFrame([(i, " ".join(w), i) for i, w in enumerate(texts)], "doc_id long, text string, row_key long")
    marked = simhash.materialize(simhash.sketches(docs), "t")
    at = {r["vertex"]: r["doc_id"] for r in marked.collect()}
    want = [find(i) for i in range(len(texts))]
    parent = list(range(len(texts)))
    for r in simhash.similar_links(marked, docs).collect():
        a, b = sorted((find(at[r["a"]]), find(at[r["b"]])))
        parent[b] = a
    assert len(at) == len(texts) and [find(i) for i in range(len(texts))] == want


def test_pairs_of_large_groups_equal_brute_force():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    sets = []
    for f in range(60):
        base = rng.choice(pool, 100, replace=False)
        sets += [np.unique(base), *(np.unique(np.r_[base[: 100 - c], rng.choice(pool, c)]) for c in (5, 8, 20))]
    signs, sizes = np.stack([simhash.signature(x) for x in sets]), np.array([len(x) for x in sets])
    owners, roots = np.arange(len(sets)), np.arange(len(sets)) // 8
    found = set()
    for b in simhash._pairs_apart(np.zeros(len(sets), np.int64), owners, sizes, roots, signs, 0.8):
        found |= set(zip(b.column("a").to_pylist(), b.column("b").to_pylist()))
    alone = set()
    for b in simhash._pairs_apart(np.zeros(len(sets), np.int64), owners, sizes, owners, signs, 0.8):
        alone |= set(zip(b.column("a").to_pylist(), b.column("b").to_pylist()))
    near = {(i, j) for j in owners.tolist() for i in range(j) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert len(near) >= 60 and near <= alone and {(i, j) for i, j in near if i // 8 != j // 8} <= found
    assert all(i // 8 != j // 8 for i, j in found) and len(alone) < 0.1 * len(sets) ** 2 / 2


def test_signs_rule_out_only_pairs_below_the_threshold():
    rng = np.random.default_rng(4)
    for size in (1, 7, 60, 300, 2500):
        base = rng.integers(0, 1 << 48, size, dtype=np.uint64)
        for other in (size, max(1, int(size * 0.83)), int(size * 1.2) + 1):
            for kept in range(0, min(size, other) + 1, max(1, size // 12)):
                x, y = np.unique(base), np.unique(np.r_[base[:kept], rng.integers(0, 1 << 48, other - kept, dtype=np.uint64)])
                common = len(np.intersect1d(x, y))
                similarity = common / (len(x) + len(y) - common)
                passes = simhash.signs_may_reach(simhash.sign(x), simhash.sign(y), 0.8)
                assert passes or similarity < 0.8
                assert not passes or similarity > 0.7 or size < 60
        assert len(simhash.sign(base)) <= size / 2 + 16


def test_sets_travel_only_for_pairs_that_signs_leave(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    common = [[word() for _ in range(1800)] for _ in range(4)]  # pairs of long texts that share two thirds, where short signatures tell nothing
    texts = [common[i // 2] + [word() for _ in range(900)] for i in range(8)] + [[word() for _ in range(2000)]]
    texts.append(texts[-1][:-100])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    seen, real = [], simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda pairs, sets, threshold: seen.append(pairs.count()) or real(pairs, sets, threshold))
    kept = simhash.keep_representatives(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(9)) and 1 <= sum(seen) <= 2
