"""Language-model scoring by deleted interpolation of trigrams, bigrams and unigrams.

P(w | u v) = l3 f(w | u v) + l2 f(w | v) + l1 f(w) + l0 / (V + 1): maximum-likelihood
estimates and the uniform distribution over the V training tokens and one class for all
others. The weights depend on the bucket of the context's frequency: the binary magnitude of
the count of (u, v), or, where that pair is unseen, of v. They are learnt by
expectation-maximisation on the tokens of the development documents (every tenth), with the
counts of those documents deleted from the model; the final model counts all training
documents. A document starts as if after an end token.

Dataflow. Documents become blocks of about 6 MB, written once. A block's distinct n-grams
(words by 64-bit hashes, pairs and triples by 48-bit ones) are sorted, delta-coded and cut
into 2 ** BITS intervals of hashes; an interval of 2 ** BITS blocks is added up in one
group, which holds about as much as one block. Where there are more blocks, the sums are cut
and added up again, level by level, until one group has an interval of all; the totals go
back the same way, as small integers in the order of the keys. So each block sends and gets a
fixed number of rows at each level, whatever the size of the corpus, levels grow with its
logarithm, no n-gram burdens a task, however frequent, and nothing is gathered in one place.

Edge cases: a null or empty text is the end token alone; texts of any length count whole; a
null doc_id counts as a training row; repeated rows count and score each; without training
rows every token has probability 1 / (V + 1) = 1; without development rows the weights are
DEFAULT; a bucket with fewer than LEAST development tokens takes the weights of the nearest
one that has as many (of two the less frequent one); no possible weight is below FLOOR;
extra columns are ignored. Weights are learnt from cells of likelihood ratios (STEP wide, each
at the mean of its tokens), so that the driver gets a table of bounded size; the error is
of the second order of STEP, and finer steps give the exact weights (tests).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bound_batches, crc_mod, materialize, release_memory

#: Bytes of a block; intervals of hashes, and blocks that are added up in one group: 2 ** BITS.
BLOCK_BYTES, BITS = 6 << 20, 8
#: Bits of the hashes of words, pairs and triples.
WIDTH = {1: 64, 2: 48, 3: 48}
#: Development documents: this remainder by 10; held-out ones have remainder 0.
DEVELOPMENT = 9
#: Weights of triple, pair, word and uniform estimates before learning, and least weight.
DEFAULT, FLOOR = (0.3, 0.3, 0.3, 0.1), 1e-4
#: Magnitudes of counts: buckets of seen pairs, then of the words after which an unseen pair ends.
MAGNITUDES = 48
LEAST = 20
#: Step of the logarithms of likelihood ratios that expectation-maximisation tells apart, and what stands for that of zero.
STEP, NEVER = 0.25, -(1 << 40)
START = np.uint64(0x5A17_9C33_0E4D_2B81)
END = np.uint64(0x9D3F_5A7B_1C2E_4F61)
ALPHA = 0.1


def _narrow(values: np.ndarray) -> bytes:
    """Unsigned integers without the high bytes that none of them uses."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _wide(data: bytes) -> np.ndarray:
    width, planes = data[0], np.frombuffer(data, np.uint8, offset=1)
    out = np.zeros((len(planes) // width, 8), dtype=np.uint8)
    out[:, :width] = planes.reshape(width, -1).T
    return out.view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return _narrow(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_wide(data), dtype=np.uint64)


def pack_ints(values: np.ndarray) -> bytes:
    return zlib.compress(_narrow(values), 1)


def unpack_ints(data: bytes) -> np.ndarray:
    return _wide(zlib.decompress(data)).astype(np.int64)


def bigram_keys(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    k = context * np.uint64(0x9E3779B97F4A7C15) + (token << np.uint64(31) | token >> np.uint64(33))
    k ^= k >> np.uint64(29)
    k *= np.uint64(0xBF58476D1CE4E5B9)
    return k ^ (k >> np.uint64(32))


def tokenise(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end, and the number of tokens of each."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    lists = pa.chunked_array([lists]) if isinstance(lists, pa.Array) else lists
    lists = lists.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, bounds = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = flat.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    words = coded.dictionary.to_pylist()
    hashes = np.fromiter((digest(w) if w else 0 for w in words), np.uint64, len(words))
    word = hashes[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    blank = np.array([w == "" for w in words], dtype=bool)
    real = ~blank[coded.indices.to_numpy()] if len(flat) else np.zeros(0, bool)
    sizes = np.diff(np.r_[0, np.cumsum(real)][bounds])
    ends = np.cumsum(sizes + 1) - 1
    tokens = np.empty(int(sizes.sum()) + len(sizes), dtype=np.uint64)
    is_end = np.zeros(len(tokens), dtype=bool)
    is_end[ends] = True
    tokens[is_end] = END
    tokens[~is_end] = word[real]
    return tokens, sizes + 1


class Block:
    """Documents of one block: ``tokens`` of all in order, ``sizes``, ``fold`` of each.

    keys, index: by kind of n-gram (1 word, 2 pair, 3 triple), distinct keys and their place for each token.
    """

    def __init__(self, row):
        self.fold, self.sizes = np.frombuffer(row["fold"], np.int8), unpack_ints(row["sizes"])
        words, self.word = unpack_sorted(row["words"]), unpack_ints(row["sequence"])
        self.tokens = words[self.word]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.end = int(np.searchsorted(words, END))
        two = bigram_keys(np.r_[END, self.tokens[:-1]], self.tokens)
        before = np.r_[START, two[:-1]]
        before[self.starts] = START
        three = bigram_keys(before, self.tokens)
        self.keys, self.index = {1: words}, {1: self.word}
        for kind, key in ((2, two), (3, three)):
            self.keys[kind], self.index[kind] = np.unique(key >> np.uint64(64 - WIDTH[kind]), return_inverse=True)
        self.trains = np.repeat(self.fold != 0, self.sizes)

    def estimates(self, counts: dict[int, np.ndarray], total: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and maximum-likelihood estimates (triple, pair, word) of each token."""
        one, two, three = (counts[k][self.index[k]] for k in (1, 2, 3))
        last = counts[1][np.r_[self.end, self.word[:-1]]]  # of the token before; an end before each document
        pair = np.r_[0, two[:-1]]
        pair[self.starts] = last[self.starts]
        return bucket_of(pair, last), np.c_[three / np.maximum(pair, 1), two / np.maximum(last, 1), one / max(total, 1)]


BLOCK_SCHEMA = "block long, dev boolean, doc_ids array<long>, fold binary, sizes binary, words binary, sequence binary, n_train long"


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of tokens; development documents lie in blocks of their own."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.when(F.col("doc_id").isNull(), 1).otherwise(crc_mod(F.col("doc_id"), 10)).cast("byte").alias("fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        held: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}

        def block(dev: bool) -> pa.RecordBatch:
            nonlocal at
            table = pa.Table.from_batches(held[dev])
            held[dev] = []
            tokens, sizes = tokenise(table.column("text"))
            folds = table.column("fold").to_numpy().astype(np.int8)
            keys, index = np.unique(tokens, return_inverse=True)
            at += 1
            return pa.RecordBatch.from_pylist([{
                "block": at, "dev": dev, "doc_ids": table.column("doc_id").to_pylist(), "fold": folds.tobytes(), "sizes": pack_ints(sizes),
                "words": pack_sorted(keys), "sequence": pack_ints(index), "n_train": int(sizes[folds != 0].sum()),
            }], schema=arrow_schema)

        for batch in batches:
            is_dev = pc.equal(batch.column("fold"), DEVELOPMENT)
            for dev, own in ((True, is_dev), (False, pc.invert(is_dev))):
                some = batch.filter(own)
                if some.num_rows:
                    held[dev].append(some)
                    if sum(b.nbytes for b in held[dev]) >= BLOCK_BYTES:
                        yield block(dev)
        for dev in (True, False):
            if held[dev]:
                yield block(dev)
        release_memory()

    arrow_schema = pa.schema([("block", pa.int64()), ("dev", pa.bool_()), ("doc_ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("fold", "sizes", "words", "sequence")), ("n_train", pa.int64())])
    return rows.mapInArrow(run, BLOCK_SCHEMA)


PIECES = "kind int, path long, grp long, src long, dev boolean, keys binary, counts binary, less binary"
TOTALS = "kind int, src long, path long, total binary, less binary, distinct long"


def _cut(kind: int, path: int, depth: int, bits: int, keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(path, slice) of the intervals of depth ``depth + 1`` within the interval ``path``, of sorted keys."""
    at = (keys >> np.uint64(WIDTH[kind] - bits * (depth + 1))).astype(np.int64)
    inner = (path << bits) + np.arange((1 << bits) + 1)
    cuts = np.searchsorted(at, inner)
    for p, s, e in zip(inner.tolist(), cuts.tolist(), cuts[1:].tolist()):
        if e > s:
            yield p, slice(s, e)


def _merge(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of the pieces of a group, their counts, counts without development documents, places of each piece."""
    own = [unpack_sorted(k) for k in group["keys"]]
    counts = [unpack_ints(c) for c in group["counts"]]
    less = [unpack_ints(x) if x is not None else np.zeros_like(c) if d else c for x, d, c in zip(group["less"], group["dev"], counts)]
    keys, index = np.unique(np.concatenate(own), return_inverse=True)
    sums = [np.bincount(index, weights=np.concatenate(c), minlength=len(keys)).astype(np.int64) for c in (counts, less)]
    ends = np.cumsum([len(k) for k in own])
    return keys, *sums, [index[e - len(k) : e] for e, k in zip(ends, own)]


def _answers(group: pd.DataFrame, places: list[np.ndarray], total: np.ndarray, less: np.ndarray, distinct: int) -> pd.DataFrame:
    out = group[["kind", "src", "path"]].copy()
    out["total"] = [pack_ints(total[p]) for p in places]
    out["less"] = [pack_ints(less[p]) if d else None for p, d in zip(places, group["dev"])]
    out["distinct"] = [distinct, *[0] * (len(out) - 1)]
    return out


def _resolve(pieces: DataFrame, groups: int, depth: int, bits: int) -> DataFrame:
    """TOTALS for the sources of ``pieces`` (PIECES) of intervals of depth ``depth``, which lie in ``groups`` groups."""

    def top(group: pd.DataFrame) -> pd.DataFrame:
        _, total, less, places = _merge(group)
        return _answers(group, places, total, less, int((total > 0).sum()))

    def up(group: pd.DataFrame) -> pd.DataFrame:
        keys, total, less, _ = _merge(group)
        kind, path, grp = (int(group[c].iloc[0]) for c in ("kind", "path", "grp"))
        rows = [(kind, p, grp >> bits, path * groups + grp, True, pack_sorted(keys[s]), pack_ints(total[s]), pack_ints(less[s])) for p, s in _cut(kind, path, depth, bits, keys)]
        return pd.DataFrame(rows, columns=["kind", "path", "grp", "src", "dev", "keys", "counts", "less"])

    def down(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        _, _, _, places = _merge(group)
        above = above.sort_values("path")
        total, less = (np.concatenate([unpack_ints(x) for x in above[c]]) for c in ("total", "less"))
        return _answers(group.drop(columns="node"), places, total, less, int(above["distinct"].sum()))

    if groups == 1:
        return pieces.groupBy("kind", "path", "grp").applyInPandas(top, TOTALS)
    pieces = materialize(pieces, "lm-pieces")
    above = _resolve(pieces.groupBy("kind", "path", "grp").applyInPandas(up, PIECES), (groups + (1 << bits) - 1) >> bits, depth + 1, bits)
    noded = pieces.withColumn("node", F.col("path") * groups + F.col("grp"))
    return noded.groupBy("kind", "node").cogroup(above.withColumnRenamed("src", "node").groupBy("kind", "node")).applyInPandas(down, TOTALS)


def corpus_counts(made: DataFrame, bits: int = BITS) -> DataFrame:
    """TOTALS: for each block (src), kind and interval (path) the corpus counts of its keys.

    less: counts without the development documents, for their own blocks only; distinct:
    distinct training keys of the interval, in one row of each.
    """
    groups = max(1, (made.count() + (1 << bits) - 1) >> bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                grp = (row["block"] * 0x9E3779B97F4A7C15 >> 16 & 0xFFFFFFFF) % groups
                for kind in (1, 2, 3):
                    keys, counts = b.keys[kind], np.bincount(b.index[kind][b.trains], minlength=len(b.keys[kind]))
                    found = [(kind, p, grp, row["block"], row["dev"], pack_sorted(keys[s]), pack_ints(counts[s]), None) for p, s in _cut(kind, 0, 0, bits, keys)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], ["kind", "path", "grp", "src", "dev", "keys", "counts", "less"])
        release_memory()

    return _resolve(made.mapInArrow(send, PIECES), groups, 1, bits)


def _gather(counts: pd.DataFrame, column: str) -> dict[int, np.ndarray]:
    """Corpus counts of the n-grams of one block by kind, in its order."""
    counts = counts.sort_values("path")
    return {kind: np.concatenate([unpack_ints(c) for c in counts[column][counts["kind"] == kind]]) for kind in (1, 2, 3)}


def bucket_of(pair: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The binary magnitude (from 1) of the count of the two tokens before; if 0, MAGNITUDES and that of the token before."""
    magnitude = lambda c: np.minimum(np.frexp(c.astype(float))[1], MAGNITUDES - 1)
    return np.where(pair > 0, magnitude(pair), MAGNITUDES + magnitude(last))


def learn_weights(cells: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights (triple, pair, word, uniform) of each bucket by expectation-maximisation.

    cells: rows of bucket, ln(estimate / uniform) of triple, pair and word, tokens; -inf for zero.
    """
    weights = np.tile(np.array(DEFAULT), (2 * MAGNITUDES, 1))
    weights[MAGNITUDES:, 0] = 0.0  # no triple of a pair that is unseen
    weights[MAGNITUDES, 1] = 0.0  # no pair of a word that is unseen
    weights /= weights.sum(axis=1, keepdims=True)
    order = np.argsort(cells[:, 0], kind="stable")
    cells = cells[order]
    cuts = np.searchsorted(cells[:, 0], np.arange(2 * MAGNITUDES + 1))
    learnt = []
    for bucket in range(2 * MAGNITUDES):
        own = cells[cuts[bucket] : cuts[bucket + 1]]
        if own[:, 4].sum() < LEAST:
            continue
        like, n, w, may = np.c_[np.exp(own[:, 1:4]), np.ones(len(own))], own[:, 4], weights[bucket], weights[bucket] > 0
        for _ in range(rounds):
            share = like * w
            share /= share.sum(axis=1, keepdims=True)
            w = np.where(may, np.maximum((share * n[:, None]).sum(axis=0) / n.sum(), FLOOR), 0.0)
            w /= w.sum()
        weights[bucket] = w
        learnt.append(bucket)
    for bucket in set(range(2 * MAGNITUDES)) - set(learnt):
        near = [x for x in learnt if (x < MAGNITUDES) == (bucket < MAGNITUDES) and (x == MAGNITUDES) == (bucket == MAGNITUDES)]
        if near:
            weights[bucket] = weights[min(near, key=lambda x: (abs(x - bucket), x))]
    return weights


def score(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row."""
    made = materialize(blocks(docs), "lm-blocks")
    counts = materialize(corpus_counts(made), "lm-counts")
    n = made.agg(F.sum("n_train")).first()[0] or 0
    n_dev = made.where("dev").agg(F.sum("n_train")).first()[0] or 0
    v = counts.where("kind = 1").agg(F.sum("distinct")).first()[0] or 0
    uniform = 1 / (v + 1)

    def cells(key, block: pd.DataFrame, count: pd.DataFrame) -> pd.DataFrame:
        bucket, like = Block(block.iloc[0]).estimates(_gather(count, "less"), n - n_dev)
        with np.errstate(divide="ignore"):
            logs = np.log(like / uniform)
        grid = np.c_[bucket, np.where(np.isfinite(logs), np.rint(np.where(np.isfinite(logs), logs, 0) / STEP), NEVER).astype(np.int64)]
        found, at, times = np.unique(grid, axis=0, return_inverse=True, return_counts=True)
        sums = [np.bincount(at.ravel(), weights=np.where(np.isfinite(x), x, 0), minlength=len(found)) for x in logs.T]
        return pd.DataFrame({"bucket": found[:, 0], "three": found[:, 1], "two": found[:, 2], "one": found[:, 3], "n": times, "s3": sums[0], "s2": sums[1], "s1": sums[2]})

    def scores(key, block: pd.DataFrame, count: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        b, total = Block(row), _gather(count, "total")
        bucket, like = b.estimates(total, n)
        w = weights[bucket]
        log = np.log10((w[:, :3] * like).sum(axis=1) + w[:, 3] * uniform)
        c = total[1][b.word]
        base = np.log10((c + ALPHA) / (n + ALPHA * (v + 1)))
        return pd.DataFrame({
            "doc_id": pd.array(list(row.doc_ids), dtype="Int64"), "held_out": b.fold == 0, "n_tokens": b.sizes, "n_known": np.add.reduceat((c > 0).astype(np.int64), b.starts),
            "train_tokens": n, "base_score": np.add.reduceat(base, b.starts), "score": np.add.reduceat(log, b.starts),
        })

    def paired(some: DataFrame, count: DataFrame, function, schema: str) -> DataFrame:
        return some.groupBy("block").cogroup(count.withColumnRenamed("src", "block").groupBy("block")).applyInPandas(function, schema)

    grid = paired(made.where("dev"), counts.where("less is not null"), cells, "bucket long, three long, two long, one long, n long, s3 double, s2 double, s1 double") if n_dev else None
    if n and grid is not None:
        means = [F.when(F.col(c) > NEVER, F.sum(s) / F.sum("n")).otherwise(F.lit(float("-inf"))).alias(s) for c, s in (("three", "s3"), ("two", "s2"), ("one", "s1"))]
        table = grid.groupBy("bucket", "three", "two", "one").agg(*means, F.sum("n").alias("n")).toArrow()
        table = np.stack([table.column(c).to_numpy().astype(float) for c in ("bucket", "s3", "s2", "s1", "n")], axis=1)
    else:
        table = np.zeros((0, 5))
    weights = learn_weights(table) if n else np.tile(np.array([0.0, 0.0, 0.0, 1.0]), (2 * MAGNITUDES, 1))
    return paired(made, counts, scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
