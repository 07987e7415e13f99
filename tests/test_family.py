"""Families of works over a corpus, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import family

FIELDS = "position long, title string, abstract string, authors array<string>, venue string, year string, doi string"


def linked(a, b):
    """Relation of two records by plain sets: (linked, confidence)."""
    stop = set("a an and for from in of on the to using with".split())
    words = lambda r: {w for w in r[1].lower().split() if len(w) > 1 and w not in stop}
    x, y, shared = words(a), words(b), len({n.lower() for n in a[3]} & {n.lower() for n in b[3]})
    if a[1] and a[1].lower() == b[1].lower():
        return 1.0 if shared else 0.95
    if not x or not y or not shared or abs(int(a[5]) - int(b[5])) > 5:
        return 0
    common, jac = len(x & y), len(x & y) / len(x | y)
    cont = common / min(len(x), len(y))
    return round(min(0.98, 0.55 + 0.25 * cont + 0.15 * jac + 0.03 * shared), 4) if cont >= 0.85 and jac >= 0.62 else 0


def plain_closure(seeds, candidates):
    chosen, rest, at = {r[0]: (None, 1.0, 0) for r in seeds}, {r[0]: r for r in candidates if r[0] not in {s[0] for s in seeds}}, 0
    held = {r[0]: r for r in seeds}
    while rest:
        at += 1
        new = {}
        for k, r in rest.items():
            best = max(((linked(p, r), f"doi:10.1/{i}", i) for i, p in held.items()), default=(0, "", None))
            if best[0]:
                new[k] = (best[1], best[0], at)
        if not new:
            break
        chosen |= new
        held |= {k: rest.pop(k) for k in new}
    return chosen


def plain_corpus(seeds, corpus, limit, near=lambda k: ()):
    met, done, frontier = {s[0]: s for s in seeds}, set(), list(seeds)
    by = {}
    for r in corpus:
        for a in {x.lower() for x in r[3]}:
            by.setdefault(a, []).append(r)
    while frontier:
        for f in frontier:
            own = {x.lower() for x in f[3]}
            for r in corpus:
                common = own & {x.lower() for x in r[3]}
                if (f[1] and f[1].lower() == r[1].lower()) or any(len(by[a]) <= limit for a in common) or len(common) >= 2 or r[0] in near(f[0]):
                    met[r[0]] = r
        done |= {f[0] for f in frontier}
        found = plain_closure(seeds, list(met.values()))
        frontier = [met[k] for k in found if k not in done]
    return plain_closure(seeds, list(met.values())), met


def sample(n=160, seed=5):
    rng = random.Random(seed)
    words = "cryogenic low noise amplifier bulk cmos receiver mixer wide band gain filter tunable compact array".split()
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            title = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(3)):
                title[rng.randrange(len(title))] = rng.choice(words)
            title = title[: rng.choice([len(title), len(title) - 1]) or 1]
        else:
            title = rng.sample(words, rng.randrange(4, 9))
        authors = rng.sample([f"Name {c}" for c in "abcdefghijklm"], rng.randrange(3)) + (["Hot One"] if rng.random() < 0.5 else []) + (["Hot Two"] if rng.random() < 0.4 else [])
        rows.append((i, " ".join(title), "", authors, "v", str(2010 + rng.randrange(12)), f"10.1/{i}"))
    return rows


def chain(n):
    """Each record an extension of the one before, with one author in common."""
    words = ["word" + "abcdefgh"[i // 8] + "abcdefgh"[i % 8] for i in range(40)]
    return [(1000 + i, " ".join(words[i : i + 9]), "", ["Chain Author"], "v", "2020", f"10.1/{1000 + i}") for i in range(n)]


def found(df):
    return {int(r["key"].rsplit("/", 1)[1]): (r["parent"], r["confidence"], r["round"]) for r in df.collect()}


def test_closure_equals_a_plain_loop(spark):
    rows = sample() + chain(5)
    df = spark.createDataFrame(rows, FIELDS)
    seeds = [r for r in rows if r[0] % 40 == 0]
    assert found(family.closure(df.where("position % 40 = 0"), df)) == plain_closure(seeds, rows)


@pytest.mark.parametrize("limit", [3, 20])
def test_corpus_closure_equals_a_plain_loop(spark, limit):
    rows = sample(110, 8) + chain(5)
    df = spark.createDataFrame(rows, FIELDS)
    seeds = [r for r in rows if r[0] in (4, 9, 1000)]
    near = {1002: {1004}, 4: {11, 12}}
    table = spark.createDataFrame([(f"doi:10.1/{a}", f"doi:10.1/{b}") for a, bs in near.items() for b in bs], "key string, other string")
    leg = lambda frontier: table.join(frontier, "key").select(F.col("other").alias("key"))
    got = family.corpus_closure(df.where("position in (4, 9, 1000)"), df, leg, limit)
    want, met = plain_corpus(seeds, rows, limit, lambda k: near.get(k, ()))
    assert found(got.members) == want and {r[0] for r in got.candidates.collect()} == {f"doi:10.1/{k}" for k in met}
    counts = {a: sum(a in [x.lower() for x in r[3]] for r in rows) for a in {x.lower() for r in rows for x in r[3]}}
    own = {x.lower() for r in rows if r[0] in want for x in r[3]}
    assert {r["author"]: r["candidate_count"] for r in got.skipped.collect()} == {a: counts[a] for a in own if counts[a] > limit}
    assert got.rounds[-1]["new_members"] == 0 and not got.warnings


def test_chains_need_both_legs_and_a_failed_leg_leaves_the_other(spark):
    rows = chain(5) + [(i, f"other {i} title", "", ["Chain Author"], "v", "2020", f"10.1/{i}") for i in range(6)]
    df = spark.createDataFrame(rows, FIELDS)
    seed = df.where("position = 1000")
    ids = lambda c: sorted(found(c.members))
    assert ids(family.corpus_closure(seed, df)) == [1000, 1001, 1002, 1003, 1004]
    assert ids(family.corpus_closure(seed, df, limit=3)) == [1000]
    vectors = spark.createDataFrame([(f"doi:10.1/{r[0]}", [float(r[0] == 1000 + i) + 0.9 * float(abs(r[0] - 1000 - i) == 1) for i in range(8)] + [float(r[0] < 1000)]) for r in rows], "key string, embedding array<float>")
    assert ids(family.corpus_closure(seed, df, family.vector_neighbours(vectors, 3), 3)) == [1000, 1001, 1002, 1003, 1004]

    def broken(frontier):
        raise OSError("no vectors")

    got = family.corpus_closure(seed, df, broken)
    assert ids(got) == [1000, 1001, 1002, 1003, 1004] and len(got.warnings) == 1 and "no vectors" in got.warnings[0]


def test_a_failure_of_the_semantic_leg_does_not_look_like_a_result(spark, monkeypatch):
    from lectern.plans import catalogue_index

    df = spark.createDataFrame(chain(2), FIELDS)
    seed = df.where("position = 1000")

    def fails(error):
        def leg(*_):
            raise error

        return leg

    with pytest.raises(ValueError, match="wrong shape"):
        family.corpus_closure(seed, df, fails(ValueError("wrong shape")))
    with pytest.raises(Exception, match="(?s)no vectors in a task"):
        family.corpus_closure(seed, df, lambda frontier: frontier.select(F.udf(fails(OSError("no vectors in a task")), "string")("key").alias("key")))
    with pytest.raises(OSError, match="no vectors"):
        family.corpus_closure(seed, df, fails(OSError("no vectors")), strict=True)
    # the registered query returns members only, so no warning would be seen
    monkeypatch.setattr(catalogue_index, "family_records", lambda *_: df.withColumn("position", F.col("position") - 1000))
    monkeypatch.setattr(catalogue_index, "table", lambda *_: spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>"))
    monkeypatch.setattr(family, "vector_neighbours", lambda *_: fails(OSError("no vectors")))
    with pytest.raises(OSError, match="no vectors"):
        catalogue_index.corpus_families(spark, "")


def test_a_corpus_judges_each_pair_once_whatever_its_rounds(spark, monkeypatch):
    rows = chain(6)
    df = spark.createDataFrame(rows, FIELDS)
    real, counted = family.relation, spark.sparkContext.accumulator(0)

    def spy(*sides):
        note = F.udf(lambda x: counted.add(1) or x, "string").asNondeterministic()
        value = real(*sides)
        return F.struct(note(value["relation"]).alias("relation"), value["confidence"].alias("confidence"))

    monkeypatch.setattr(family, "relation", spy)
    got = found(family.corpus_closure(df.where("position = 1000"), df).members)
    assert got == plain_closure(rows[:1], rows) and max(r[2] for r in got.values()) == 5
    assert 5 <= counted.value <= 12  # nine pairs of neighbours and next ones; each growth and the closing one judged them anew


def test_an_author_of_half_the_rows_forms_no_square(spark):
    """Titles of a frequent author meet by rare words: far fewer pairs than records of the author, squared."""
    rows = [(i, f"study {i} of thing {i % 500} part {i * 7 % 1000}", "", ["Hot One", "Hot Two"], "v", "2020", f"10.1/{i}") for i in range(1000)]
    df = family.with_rare_words(family.prepare(spark.createDataFrame(rows, FIELDS))).cache()
    blocks = family._author_words(df, family.EXTENSION)
    pairs = blocks.alias("x").join(blocks.alias("y"), ["author", "word"]).where("x.key < y.key").count()
    assert pairs < 20_000
    sizes = family.author_sizes(df)
    own = family.literal_blocks(df, sizes)
    assert own.where("block like 'p:%'").count() == 1000
    assert family.literal_candidates(df.limit(1), own, own).count() == 1000


def test_records_travel_only_for_pairs_that_may_relate(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]
    titles = [" ".join(rng.sample(words, 12)) for _ in range(61)]
    titles += [" ".join(t.split()[:-1]) for t in titles[:10]]  # extensions, and copies of all that differ in nothing but their keys
    rows = [(i, t, "", ["Ann Frequent"], "v", "2020", f"10.1/{i}") for i, t in enumerate(titles * 6)]
    df = family.with_rare_words(family.prepare(spark.createDataFrame(rows, FIELDS))).localCheckpoint()
    number = F.substring_index("key", "/", -1).cast("int")
    seen, real = [], family.relation
    counted = spark.sparkContext.accumulator(0)

    def spy(*sides):
        seen.append(sides)
        note = F.udf(lambda x: counted.add(1) or x, "string").asNondeterministic()
        value = real(*sides)
        return F.struct(note(value["relation"]).alias("relation"), value["confidence"].alias("confidence"))

    monkeypatch.setattr(family, "relation", spy)
    found = family.related_pairs(df.where(number % 2 == 0), df.where(number % 2 == 1), family.EXTENSION, ("likely_extension",)).collect()
    at = lambda key: int(key.rpartition("/")[2])
    best = {}
    for i, r in enumerate(rows):
        if i % 2:
            near = max(((linked(p, r), f"doi:10.1/{j}") for j, p in enumerate(rows) if j % 2 == 0 and p[1] != r[1]), default=(0, ""))
            best |= {i: near} if near[0] else {}
    assert len(best) >= 20 and {at(r["key"]): (r["confidence"], r["parent"]) for r in found} == best
    assert seen and counted.value <= 200  # each pair of copies would be over 3000
