import bisect
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import bestfit

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " \n\t", "Hello, World's it'LL <b>", "été Ünï ñ\xa0b\x85c", "<|endoftext|> x", "数字 12ab 3½", "word " * 9000, "x" * 3000]


def sequential(lengths, capacity):
    """Sequences that best fit makes of lengths one by one, longest first."""
    gaps, n = [], 0
    for length in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, length)
        if i < len(gaps):
            gap = gaps.pop(i)
        else:
            gap, n = capacity, n + 1
        if gap > length:
            bisect.insort(gaps, gap - length)
    return n


def pieces_of(spark, lengths):
    return spark.createDataFrame([(i, i, 0, 0, n, 0) for i, n in enumerate(lengths)], bestfit.PIECES).repartition(4)


def bins_of(rows):
    bins = defaultdict(list)
    for r in rows:
        bins[r["bin"]].append(r)
    return bins


def test_pieces_hold_every_id_and_only_long_documents_are_cut(spark):
    rng = random.Random(4)
    texts = TEXTS + [" ".join(rng.choice("lorem ipsum Dolor, sit! amet? élan".split()) + str(rng.randrange(99)) for _ in range(rng.randrange(900))) for _ in range(80)]
    rows = list(enumerate(texts)) + [(3, TEXTS[3]), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("start", "bin", "id", "length", "part", "piece")}).repartition(3)
    found = bestfit.pack(df).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in found:
        docs[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    assert set(docs) == {i for i, _ in rows}
    for i, t in set(rows):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want = [(n, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for n, s in enumerate(range(0, len(ids), 2048))]
        assert sorted((p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in docs[i]) == sorted(want * (2 if i == 3 else 1))
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    lengths = [p["length"] for p in found]
    assert len(sequences) <= sequential(lengths, 2048) + 1


@pytest.mark.parametrize("partitions", ["1", "3", "23"])
def test_sweep_and_pairing_equal_a_plain_stack(spark, partitions):
    """Longest first, every document takes the smallest free gap that holds it, over all ranges."""
    rng = random.Random(int(partitions))
    keys = {"spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        for low, high in ((1, 60), (20, 30), (30, 30)):
            gaps, lengths = [rng.randint(low, high) for _ in range(300)], [rng.randint(low, high) for _ in range(400)]
            swept = bestfit.sweep(spark.createDataFrame(list(enumerate(gaps)), "bin long, length int"), pieces_of(spark, lengths)).cache()
            left = swept.where("rank IS NOT NULL").groupBy("part").agg(F.count_if(~F.col("gap")).alias("docs"), F.count_if(~F.col("gap") & (F.col("length") > 40)).alias("old"), F.count_if("gap").alias("gaps")).collect()
            pairing = bestfit.pair_up(sorted(tuple(r) for r in left))
            got = {r["id"]: r["bin"] for r in bestfit.place(swept, pairing, 40, 1000, 3).collect()}
            want, stack, lost = {}, [], []
            for size, kind, i in sorted([(-g, 0, i) for i, g in enumerate(gaps)] + [(-n, 1, i) for i, n in enumerate(lengths)]):
                if not kind:
                    stack.append(i)
                elif stack:
                    want[i] = stack.pop()
                else:
                    lost.append(i)
                    want[i] = 1000 + (len(lost) - 1) // 3 if -size > 40 else None
            assert got == want and pairing.without == len(lost) and pairing.earlier_without == sum(lengths[i] > 40 for i in lost)
            assert len(pairing.spans) <= 3 * max(1, len(left))
            swept.unpersist()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("kind", ["mixed", "halves", "sand", "one", "equal", "prose"])
def test_nearly_as_few_as_one_by_one(spark, kind):
    rng = random.Random(9)
    lengths = {
        "mixed": [rng.randint(1, 127) for _ in range(900)], "halves": [rng.choice([64, 65, 63]) for _ in range(500)], "sand": [rng.randint(100, 127) for _ in range(150)] + [rng.randint(1, 3) for _ in range(700)],
        "one": [1] * 300, "equal": [43] * 301, "prose": [min(127, int(rng.lognormvariate(3.6, 0.9)) + 1) for _ in range(900)],
    }[kind]
    bins = bins_of(bestfit.pack_pieces(pieces_of(spark, lengths), 128).collect())
    assert sorted(r["id"] for own in bins.values() for r in own) == list(range(len(lengths)))
    assert all(sum(r["length"] for r in own) <= 128 for own in bins.values())
    assert len(bins) <= 1.01 * sequential(lengths, 128) + 1


def test_empty_table(spark):
    assert bestfit.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query(spark):
    from lectern.llm import queries

    rows = queries.QUERIES["op12_bestfit"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert len({r["sequence_id"] for r in rows}) <= 1.01 * sequential([r["length"] for r in rows], 2048) + 1
