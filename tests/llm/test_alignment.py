import hashlib
import os
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import alignment

SF = "/root/testdata/sf0.001"
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
TEXTS = [None, "", " ", "a", " a  b ", "plain text, twice: plain text", "tabs\tand\n\n  lines \r\n x", "it's I'LL 12,345.67 ½", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ sign ▁", "été naïve Ünï é", "数字 と 한국어 текст العربية", "😀 👩‍👩‍👧 x\x1fy z", "nbsp here 　 wide", "\x00\x01 \x7f", "x" * 3000, "word " * 3000 + "end", "﻿bom �"]


def spans_of(text):
    """Tokens of either side as (id, begin, end) in bytes; None where they don't give the text back."""
    text, whole = text or "", (" " + (text or "")).encode()
    if not text:
        return None
    alphabet = alignment.byte_level()
    ids = A.encode(" " + text, add_special_tokens=False).ids
    own = [(i, bytes(alphabet[c] for c in A.id_to_token(i)) if i != 50256 else b"<|endoftext|>") for i in ids]
    other = [(i, bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    out = []
    for tokens in (own, other):
        if b"".join(t for _, t in tokens) != whole:
            return None
        at, spans = 0, []
        for i, t in tokens:
            spans.append((i, at, at + len(t)))
            at += len(t)
        out.append(spans)
    return out


def plain(rows):
    """All figures from all pairs of tokens of each text."""
    links, found = Counter(), []
    for d, t in rows:
        spans = spans_of(t)
        if spans is None:
            found.append((d, None, None, []))
            continue
        a, b = spans
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, begin = [], 0
        for end in ends:
            inside = lambda side: ",".join(str(i) for i, s, e in side if begin <= s and e <= end)  # noqa: E731, B023
            groups.append(f"{inside(a)}|{inside(b)}")
            begin = end
        first, own = 0, []
        for i, s, e in a:
            while first < len(b) and b[first][2] <= s:
                first += 1
            j = first
            while j < len(b) and b[j][1] < e:
                own.append((i, b[j][0]))
                j += 1
        links.update(own)
        found.append((d, spans, groups, own))
    best = {}
    for (_, j), n in links.items():
        best[j] = max(n, best.get(j, 0))
    out = []
    for d, spans, groups, own in found:
        if spans is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((d, len(spans[0]), len(spans[1]), len(groups), len(own), sum(links[x] == best[x[1]] for x in own), sum(links[x] for x in own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def sample(n=120, seed=2):
    rng = random.Random(seed)
    words = "the Quiet river unbelievable walks tokenization's 12 4,096 über straße naïve 東京 x=y; http://a.b/c \n \t".split(" ")
    return TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 80))) + rng.choice(["", " ", "\n", ".  "]) for _ in range(n)]


@pytest.mark.parametrize("spill, partitions", [(alignment.SPILL, "4"), (300, "9")])
def test_equals_all_pairs_of_tokens(spark, monkeypatch, spill, partitions):
    rows = list(enumerate(sample())) + [(5, TEXTS[5]), (5, TEXTS[5]), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("key", "n", "part", "first", "b", "file")}).repartition(5)
    keys = {"spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    counts = alignment.partial_counts
    monkeypatch.setattr(alignment, "partial_counts", lambda docs, a, b: counts(docs, a, b, spill))
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = sorted((tuple(r) for r in alignment.align_documents(df).collect()), key=str)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == plain(rows)


@given(st.lists(st.text(st.sampled_from("ab .,'’\n\t\r1é▁\x1f  数😀-S"), max_size=30), max_size=6))
@settings(max_examples=150, deadline=None)
def test_segments_have_the_tokens_of_whole_texts(texts):
    a, b = alignment.sides(None, None)
    x = alignment.align(pa.array(texts, pa.string()), a, b)
    for i, (text, ok) in enumerate(zip(texts, x.texts())):
        spans = spans_of(text)
        assert ok == (spans is not None)
        if spans:
            codes = x.codes[x.bounds[i] : x.bounds[i + 1]]
            assert (x.n_a[codes].sum(), x.n_b[codes].sum()) == (len(spans[0]), len(spans[1]))
            whole = b"".join(x.groups[int(c)].as_py() for c in codes)
            assert [int(n) for n in whole.replace(b";", b",").replace(b"|", b",").split(b",")[:-1]] and whole.count(b";") == len({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})


def test_shards_are_looked_up(spark, tmp_path):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 500, 3000) << 32 | rng.integers(0, 40, 3000)
    partial = spark.createDataFrame([(int(k), 2) for k in keys], alignment.COUNTED).repartition(3)
    made = alignment.write_shards(partial, f"file://{tmp_path}/s").collect()
    parts = sorted((r for r in made if r["file"]), key=lambda r: r["first"])
    shards = alignment.Shards(np.array([r["first"] for r in parts]), [r["file"] for r in parts])
    want = Counter(keys.tolist())
    asked = np.array(sorted({*want, 0, 7 << 32 | 41, 1 << 60}))
    assert shards.counts(asked).tolist() == [2 * want[int(k)] for k in asked]
    assert all(isinstance(k, np.memmap) for k, _ in shards.open.values())
    best = {}
    for r in made:
        if r["b"] is not None:
            best[r["b"]] = max(r["best"], best.get(r["b"], 0))
    assert best == {b: 2 * max(n for k, n in want.items() if k >> 32 == b) for b in {k >> 32 for k in want}}


def test_long_blanks_and_words():
    a, b = alignment.sides(None, None)
    texts = [" " * 200_000 + "x", "\n" * 200_000, "x" * 200_000]
    assert alignment.align(pa.array(texts), a, b).texts().all()


def test_empty_tables(spark):
    assert alignment.align_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in alignment.align_documents(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_equals_all_pairs_of_tokens(spark):
    from lectern.llm import queries

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in queries.QUERIES["op13_alignment"](spark, SF).collect()), key=str) == plain([tuple(r) for r in docs])
