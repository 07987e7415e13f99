"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64-bit SimHashes of word shingles. Two fingerprints link at
``THRESHOLD`` = 2 or fewer differing bits. Anchors: the code words of the perfect
Hamming(31, 26) code, whose covering radius is 1, on 31 bits of either half. If two
fingerprints differ in at most 2 bits, they differ in at most 1 bit in one half, and
there each lies within radius + 1 = 2 of the anchor nearest to the other. So every
fingerprint is replicated to all anchors within 2 of either half (16 at most for each
half) and compared only with what shares an anchor: no link is lost.

Rows with the same fingerprint become one vertex before anything is replicated, so a
group of exact copies costs one row. A group of near copies is compared per anchor, and
only a spanning forest of its links leaves the task, never all pairs.

``keep_representatives``, the filter for pipelines, also links by similarity: pairs come
from a prefix filter on five-word shingles, which meets every pair of the threshold, and the
exact Jaccard similarity of the shingle sets verifies them.

Edge cases: a null or empty text has fingerprint zero and links like any other; texts of any
length count whole; repeated rows share a component; a bit that half of the hashes have (a
tie) is 0; a null doc_id keeps its row, and counts for a component's smallest id only if
there is no other; extra columns are ignored, or kept by ``keep_representatives``, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import BROADCAST_ROWS, bound_batches, boxed, checked_broadcast, components, drop_tables, join_skewed, materialize, release_memory, row_key, temporary_tables, unboxed

THRESHOLD = 2
#: Bits of a half that the code covers, and the mask of them.
CODE_BITS, CODE_MASK = 31, (1 << 31) - 1
#: Groups over this size are compared in blocks of rows.
BLOCK = 512
#: Fingerprints for which one anchor is the nearest; beyond, the anchor is compared in blocks of so many.
HOME_ROWS = 4096
#: Near copies by similarity: least Jaccard similarity of sets of shingles of so many words.
SIMILARITY, SIMILAR_WIDTH = 0.8, 5
#: Order of shingles: rows of the sample, rows of it that make a shingle frequent, frequent ones listed.
ORDER_ROWS, FREQUENT, LISTED = 20_000, 3, 100_000
#: Bits of a signature; members of a shingle's group that are paired all with all at once.
SIGNATURE, GROUP = 256, 64
#: Bytes of a shingle's hash in the sets that are compared, and sets that meet their partner in one task.
HASH_BYTES, PARTNERS = 6, 2000
#: Rows and shingles of a block of a cluster of texts with frequent shingles in common; bits of the signatures there.
CLUSTER, SHINGLES, WIDE = 2048, 4_000_000, 2048
#: Times that a vertex takes over the least lead among those it shares a token with.
LEADS = 1


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned SimHash of the shingles of ``width`` words (XXH64, seed 42)."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        line, digest = b" ".join(words), xxhash.xxh64_intdigest
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        hashes = [digest(line[s : e - 1], 42) for s, e in zip(starts, ends[width - 1 :])]
    h = np.array(hashes, dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65536):
        counts += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` with a column ``fp``: the fingerprint as a signed long."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn("fp", udf(F.col("text")))


def _syndrome(x: np.ndarray) -> np.ndarray:
    """XOR of the positions (1..31) of the set bits: 0 for a code word."""
    s = np.zeros(x.shape, dtype=np.int64)
    for bit in range(CODE_BITS):
        s ^= np.where((x >> bit) & 1, bit + 1, 0)
    return s


def _flips() -> np.ndarray:
    """For each syndrome, the masks that lead to every code word within 2; unused ones are -1."""
    table = np.full((32, 16), -1, dtype=np.int64)
    table[0, 0] = 0
    for s in range(1, 32):
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < (i ^ s)]
        masks = [1 << (s - 1), *pairs]
        table[s, : len(masks)] = masks
    return table


FLIPS = _flips()


def _halves(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return fps & CODE_MASK, (fps >> 32) & CODE_MASK


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, fingerprint) for every anchor within covering radius plus threshold."""
    keys, owners = [], []
    for half, x in enumerate(_halves(fps)):
        masks = FLIPS[_syndrome(x)]
        words = (x[:, None] ^ masks) | (half << 32)
        used = masks >= 0
        keys.append(words[used])
        owners.append(np.broadcast_to(fps[:, None], used.shape)[used])
    return np.concatenate(keys), np.concatenate(owners)


def _home(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Whether ``keys`` is the anchor nearest to the fingerprint, in the anchor's half."""
    x = np.where(keys >> 32, (fps >> 32) & CODE_MASK, fps & CODE_MASK)
    s = _syndrome(x)
    return (x ^ np.where(s > 0, np.left_shift(1, np.maximum(s - 1, 0)), 0)) == (keys & CODE_MASK)


def _near(a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= threshold


def _forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of the links."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    kept = []
    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept


def links_by_anchor(keys: np.ndarray, fps: np.ndarray, deal: np.ndarray | None = None, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Links among rows sorted by anchor (and block), a spanning forest for these rows.

    deal: 0, or ``blocks << 24 | block`` where the home rows of an anchor are dealt in blocks:
    a block compares its own home rows with all members.
    """
    out: list[tuple[int, int]] = []
    n = len(keys)
    if n < 2:
        return out
    deal = np.zeros(n, np.int64) if deal is None else deal
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (deal[1:] != deal[:-1])])
    sizes = np.diff(np.r_[first, n])
    small = (sizes <= 16) & (deal[first] == 0)
    keep = np.repeat((sizes > 1) & small, sizes)
    k, f = keys[keep], fps[keep]
    for lag in range(1, int(sizes[small].max(initial=1))):
        if lag >= len(k):
            break
        hit = np.flatnonzero((k[lag:] == k[:-lag]) & _near(f[lag:], f[:-lag], threshold))
        out += zip(f[hit].tolist(), f[hit + lag].tolist())
    for at, size in zip(first[~small], sizes[~small]):
        member = np.unique(fps[at : at + size])
        homes = member[_home(np.full(len(member), keys[at]), member)]
        if deal[at]:
            homes = homes[_block_of(homes, int(deal[at] >> 24)) == (deal[at] & 0xFFFFFF)]
        found: list[tuple[int, int]] = []
        for i in range(0, len(homes), BLOCK):
            for j in range(0, len(member), 64 * BLOCK):
                a, b = homes[i : i + BLOCK], member[j : j + 64 * BLOCK]
                x, y = np.nonzero(_near(a[:, None], b[None, :], threshold) & (a[:, None] != b[None, :]))
                found = _forest(found + list(zip(a[x].tolist(), b[y].tolist())))
        out += found
    return _forest(out)


def _block_of(fps: np.ndarray, blocks: int) -> np.ndarray:
    return (_mix(fps.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)


def links(vertices: DataFrame, home_rows: int = HOME_ROWS) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp``, enough of them to connect all that link.

    Anchors that are the nearest of more than ``home_rows`` fingerprints are compared in
    blocks of these, so no anchor's square meets in one task.
    """
    anchored = "anchor long, fp long"

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp = anchors(batch.column("fp").to_numpy(zero_copy_only=False))
            for i in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 100_000]), pa.array(fp[i : i + 100_000])], ["anchor", "fp"])

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp = anchors(batch.column("fp").to_numpy(zero_copy_only=False))
            own = _home(key, fp)
            yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(fp[own])], ["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple[int, int]] = []

        def rows(found: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = (pa.array(x, pa.int64()) for x in (zip(*found) if found else ([], [])))
            return pa.RecordBatch.from_arrays([a, b], ["a", "b"])

        for key, fp, deal in _by_group(batches, "anchor", ["fp", "deal"], 20_000):
            pending += links_by_anchor(key, fp, deal)
            if len(pending) >= 50_000:
                yield rows(_forest(pending))
                pending = []
        yield rows(_forest(pending))
        release_memory()

    spread = vertices.select("fp").mapInArrow(replicate, anchored)
    crowded = vertices.select("fp").mapInArrow(homes, anchored).groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > home_rows)
    crowded = materialize(crowded.select("anchor", F.ceil(F.col("n") / home_rows).cast("long").alias("blocks")), "simhash-crowded")
    if crowded.isEmpty():
        dealt = spread.withColumn("deal", F.lit(0).cast("long"))
    else:
        each = spread.join(checked_broadcast(crowded), "anchor", "left")
        blocks = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda i: F.shiftleft(F.col("blocks"), 24) + i))
        dealt = each.select("anchor", "fp", F.explode(blocks).alias("deal"))
    return dealt.repartition(F.col("anchor"), F.col("deal")).sortWithinPartitions("anchor", "deal").mapInArrow(compare, "a long, b long")


def _components(marked: DataFrame) -> DataFrame:
    """``(fp, component_id, n)`` of the rows ``marked(doc_id, fp)``; n: rows with the fingerprint."""
    vertices = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-v")
    roots = components(materialize(links(vertices), "simhash-e"))
    joined = materialize(vertices.join(roots.withColumnRenamed("node", "fp"), "fp"), "simhash-r")
    ids = joined.groupBy("root").agg(F.min("least").alias("id"), F.count("*").alias("n"))
    ids = join_skewed(joined.select("fp", "root"), ids, "root", joined.count()).select("fp", "id")
    return vertices.join(ids, "fp", "left").select("fp", F.coalesce("id", "least").alias("component_id"), "n")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs(doc_id, text)``.

    component_id: the smallest doc_id that links reach, itself included.
    """
    marked = materialize(fingerprints(docs.select("doc_id", "text"), width).select("doc_id", "fp"), "simhash")
    return join_skewed(marked, _components(marked), "fp", marked.count()).select("doc_id", "fp", "component_id")


# --- near copies by similarity ------------------------------------------------------------


def batch_words(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and where each text begins (and the last ends)."""
    import xxhash

    column = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    flat, bounds = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(len(lists) + 1, np.int64)
    coded = flat.dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) if w else 0 for w in names), np.uint64, len(names))
    index = coded.indices.to_numpy()
    real = ~np.array([w == "" for w in names])[index]
    return hashes[index][real], np.r_[0, np.cumsum(real)][bounds]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles_of(words: np.ndarray, width: int = SIMILAR_WIDTH) -> np.ndarray:
    """Distinct hashes of the shingles of one text; fewer words than ``width``: of the whole."""
    if not len(words):
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    h = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - width + 1 + k])
    return np.unique(h)


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """The most frequent shingles of a sample, rarest first: they come last in the order of shingles.

    Any order is right; this one keeps common passages out of prefixes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, at = batch_words(b.column("text"))
            found = [shingles_of(words[s:e]) for s, e in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["h"])
        release_memory()

    total = docs.count()
    some = docs.select("text") if total <= ORDER_ROWS else docs.select("text").sample(ORDER_ROWS / total, seed=1)
    counted = some.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= FREQUENT)
    top = counted.orderBy(F.desc("count"), "h").limit(LISTED).select("h").toPandas()["h"]
    return top.to_numpy(np.int64)[::-1].view(np.uint64) if len(top) else np.zeros(0, np.uint64)


def prefix_of(shingles: np.ndarray, listed: np.ndarray, rank: np.ndarray, threshold: float) -> np.ndarray:
    """The first shingles in the common order; two sets of the similarity have one of these in common.

    listed: frequent shingles, sorted; rank: their places in the order, behind all others.
    """
    n = len(shingles)
    length = n - int(np.ceil(threshold * n - 1e-9)) + 1 if n else 0
    if len(listed) and n:
        at = np.minimum(np.searchsorted(listed, shingles), len(listed) - 1)
        shingles = shingles[np.lexsort((shingles, np.where(listed[at] == shingles, rank[at] + 1, 0)))]
    return shingles[:length]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Parities of the shingles in SIGNATURE buckets: two sets differ in at least as many elements as their bits."""
    odd = np.bincount((_mix(shingles) % np.uint64(SIGNATURE)).astype(np.int64), minlength=SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def sketches(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``(rid, doc_id, row_key, fp, vertex, size, prefix, signature)``: vertex: hash of the sequence of words; size: shingles; rid: a number of the row."""
    bound_batches(docs.sparkSession)
    frequent = frequent_shingles(docs)
    rank = np.argsort(frequent, kind="stable")
    listed = frequent[rank]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        longs, rid = pa.list_(pa.int64()), TaskContext.get().partitionId() << 40
        for b in batches:
            words, at = batch_words(b.column("text"))
            fps = np.array([fingerprint(t.as_py()) for t in b.column("text")], dtype=np.uint64).view(np.int64)
            rids = pa.array(range(rid, rid + b.num_rows), pa.int64())
            rid += b.num_rows
            vertex, sizes, prefixes, signatures = np.zeros(b.num_rows, np.uint64), [], [], []
            for i, (s, e) in enumerate(zip(at[:-1], at[1:])):
                own = words[s:e]
                vertex[i] = _mix(_mix(own + np.arange(len(own), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + np.uint64(len(own)))
                h = shingles_of(own)
                sizes.append(len(h))
                prefixes.append(prefix_of(h, listed, rank, threshold).view(np.int64))
                signatures.append(signature(h))
            yield pa.RecordBatch.from_arrays(
                [rids, b.column("doc_id"), b.column("row_key"), pa.array(fps), pa.array(vertex.view(np.int64)), pa.array(sizes, pa.int32()), pa.array(prefixes, longs), pa.array(signatures, longs)],
                ["rid", "doc_id", "row_key", "fp", "vertex", "size", "prefix", "signature"],
            )
        release_memory()

    # fingerprints are made here, too: a second Python function in the stage would be a second worker a core
    return docs.select(F.col("doc_id").cast("long"), "row_key", "text").mapInArrow(run, "rid long, doc_id long, row_key long, fp long, vertex long, size int, prefix array<long>, signature array<long>")


def may_reach(sizes_a: np.ndarray, sizes_b: np.ndarray, signs_a: np.ndarray, signs_b: np.ndarray, threshold: float) -> np.ndarray:
    """False only for pairs whose sizes or signatures rule the similarity out."""
    both = sizes_a + sizes_b
    differ = np.bitwise_count((signs_a ^ signs_b).view(np.uint64)).sum(axis=-1, dtype=np.int64)
    return (np.minimum(sizes_a, sizes_b) >= threshold * np.maximum(sizes_a, sizes_b) - 1e-9) & (differ <= (1 - threshold) / (1 + threshold) * both + 1e-6)


def _pairs_in_groups(keys: np.ndarray, owners: np.ndarray, sizes: np.ndarray, signs: np.ndarray, threshold: float) -> pa.RecordBatch:
    """Pairs to verify among rows sorted by shingle and vertex: all that may reach the threshold.

    In groups over GROUP members, each member with the first one and its neighbour in order;
    ``_pairs_apart`` gives their other pairs, once it is known what these connect.
    """
    n = len(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if n else np.zeros(0, np.int64)
    counts = np.diff(np.r_[first, n])
    large = np.repeat(counts > GROUP, counts)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, lag = np.flatnonzero(~large), 1
    while len(at):
        at = at[at + lag < n]
        at = at[keys[at + lag] == keys[at]]
        hit = at[may_reach(sizes[at], sizes[at + lag], signs[at], signs[at + lag], threshold)]
        a.append(owners[hit])
        b.append(owners[hit + lag])
        lag += 1
    at = np.flatnonzero(large & np.r_[False, keys[1:] == keys[:-1]]) if n else at
    for other in (np.repeat(first, counts)[at], at - 1):
        fine = may_reach(sizes[at], sizes[other], signs[at], signs[other], threshold)
        a.append(owners[other[fine]])
        b.append(owners[at[fine]])
    p, q = np.concatenate(a), np.concatenate(b)
    p, q = np.minimum(p, q), np.maximum(p, q)
    order = np.lexsort((q, p))
    p, q = p[order], q[order]
    new = np.r_[True, (p[1:] != p[:-1]) | (q[1:] != q[:-1])][: len(p)] & (p != q)
    return pa.RecordBatch.from_arrays([pa.array(p[new]), pa.array(q[new])], ["a", "b"])


def _pairs_apart(keys: np.ndarray, owners: np.ndarray, sizes: np.ndarray, labels: np.ndarray, signs: np.ndarray, threshold: float, roots: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """All pairs of members with different labels (and roots) that may reach the threshold, in groups over GROUP members.

    Rows are sorted by shingle. The most frequent label of a group isn't compared with itself,
    so members that share it cost one pass, not its square.
    """
    roots = labels if roots is None else roots
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    for start, end in zip(first, np.r_[first[1:], len(keys)]):
        _, own, members = np.unique(labels[start:end], return_inverse=True, return_counts=True)
        if end - start <= GROUP or len(members) == 1:
            continue
        at = start + np.lexsort((sizes[start:end], own, members[own]))  # labels in order of their members
        r, c, v, n, sign = labels[at], roots[at], owners[at], sizes[at], signs[at]
        last = len(at) - members.max()
        for i in range(0, last, BLOCK):
            x = slice(i, min(i + BLOCK, last))
            for j in range(i, len(at), 16 * BLOCK):
                y = slice(j, j + 16 * BLOCK)
                fine = (r[x, None] != r[None, y]) & (np.minimum(n[x, None], n[None, y]) >= threshold * np.maximum(n[x, None], n[None, y]) - 1e-9)
                p, q = np.nonzero(fine)
                p, q = p + i, q + j
                fine = (p < q) & (c[p] != c[q]) & may_reach(n[p], n[q], sign[p], sign[q], threshold)
                p, q = v[p[fine]], v[q[fine]]
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])


COLUMNS = ["vertex", "size", *(f"s{i}" for i in range(SIGNATURE // 64))]


def _by_group(batches: Iterator[pa.RecordBatch], key: str, columns: list[str], rows: int = 200_000) -> Iterator[list[np.ndarray]]:
    """Columns of batches sorted by ``key``, in pieces that hold whole groups."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < rows:
            continue
        table = pa.Table.from_batches(held)
        k = table.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1]))  # the last group may go on
        held = table.slice(cut).combine_chunks().to_batches()
        rows = max(rows, 2 * len(k) if not cut else rows)
        if cut:
            yield [table.slice(0, cut).column(c).to_numpy() for c in (key, *columns)]
    if held:
        table = pa.Table.from_batches(held)
        yield [table.column(c).to_numpy() for c in (key, *columns)]


def _tokens(members: DataFrame) -> DataFrame:
    signs = [F.col("signature")[i].alias(f"s{i}") for i in range(SIGNATURE // 64)]
    return members.select(F.explode("prefix").alias("token"), "vertex", "size", *signs)


def _as_set(shingles: np.ndarray) -> bytes:
    """Sorted hashes without their high bytes."""
    low = np.unique(shingles & np.uint64((1 << 8 * HASH_BYTES) - 1))
    return np.ascontiguousarray(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]).tobytes()


def _from_set(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    return out.view("<u8").ravel()


def links_in_cluster(vertices: np.ndarray, roots: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Verified links that connect different roots, a spanning forest of all there are, among rows of one or two blocks.

    Rows of one block are compared with each other only if there is no second block. Sizes and
    signatures of WIDE bits rule pairs out before sets are intersected, and so do links found before.
    """
    sizes, bits = np.array([len(x) for x in sets]), np.zeros((len(sets), WIDE // 64), np.int64)
    for i, x in enumerate(sets):
        odd = np.bincount((_mix(x) % np.uint64(WIDE)).astype(np.int64), minlength=WIDE) & 1
        bits[i] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
    names, now = np.unique(roots, return_inverse=True)
    found, two = [], blocks.min() != blocks.max() if len(blocks) else False
    for i in range(0, len(sets), 64):
        for j in range(i, len(sets), 1024):
            a, b = np.arange(i, min(i + 64, len(sets)))[:, None], np.arange(j, min(j + 1024, len(sets)))[None, :]
            fine = (a < b) & (now[a] != now[b]) & (np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]) - 1e-9)
            if two:
                fine &= blocks[a] != blocks[b]
            p, q = np.nonzero(fine)
            p, q = p + i, q + j
            for s in range(0, len(p), 16_384):
                x, y = p[s : s + 16_384], q[s : s + 16_384]
                near = may_reach(sizes[x], sizes[y], bits[x], bits[y], threshold)
                for k, m in zip(x[near].tolist(), y[near].tolist()):
                    if now[k] == now[m]:
                        continue
                    common = len(np.intersect1d(sets[k], sets[m], assume_unique=True))
                    if common >= threshold * (sizes[k] + sizes[m] - common) - 1e-9:
                        found.append((int(vertices[k]), int(vertices[m])))
                        now[now == now[k]] = now[m]
    return found


def cluster_links(crowd: DataFrame, sets: DataFrame, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Verified links within clusters of ``crowd(token, vertex, root)``, and ``(vertex, lead)``, the cluster of each vertex.

    A vertex belongs to the least vertex within LEADS steps from one token's group to another's, so
    texts that share many tokens meet once, not once a token. Clusters over CLUSTER rows or
    SHINGLES shingles are dealt in pairs of blocks. Only a spanning forest of links leaves a task.
    """
    leads = crowd.groupBy("vertex").agg(F.first("root").alias("root")).withColumn("lead", F.col("vertex"))
    for _ in range(LEADS):
        groups = crowd.select("token", "vertex").join(leads, "vertex").groupBy("token").agg(F.min("lead").alias("lead"))
        leads = crowd.join(groups, "token").groupBy("vertex").agg(F.min("lead").alias("lead"), F.first("root").alias("root"))
        leads = materialize(leads, "similar-leads")
    rows = materialize(sets.join(checked_broadcast(leads), "vertex"), "similar-clusters")  # a vertex that is there twice has one root
    shape = rows.groupBy("lead").agg(F.greatest(F.ceil(F.count("*") / CLUSTER), F.ceil(F.sum(F.octet_length("shingles")) / (HASH_BYTES * SHINGLES))).cast("int").alias("blocks"), F.count_distinct("root").alias("roots"))
    shape = materialize(shape.where("roots > 1").select("lead", "blocks"), "similar-shape")
    dealt = rows.join(checked_broadcast(shape), "lead").withColumn("block", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("lead", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "vertex", "root", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            vertices, roots, blocks, sets = zip(*held) if held else ([], [], [], [])
            found = links_in_cluster(np.array(vertices, np.int64), np.array(roots, np.int64), np.array(blocks, np.int64), [_from_set(x) for x in sets], threshold)
            a, b = zip(*found) if found else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for lead, p, q, block, vertex, root, data in zip(*(batch.column(c).to_pylist() for c in ("lead", "p", "q", "block", "vertex", "root", "shingles"))):
                if (lead, p, q) != now:
                    yield done()
                    now, held = (lead, p, q), []
                held.append((vertex, root, block, data))
        yield done()
        release_memory()

    spread = dealt.repartition(F.col("lead"), F.col("p"), F.col("q")).sortWithinPartitions("lead", "p", "q")
    return materialize(spread.mapInArrow(run, "a long, b long"), "similar-within"), leads


def sign(shingles: np.ndarray) -> bytes:
    """The size of a set and the parities of its elements in buckets, two or more an element: a twentieth of the set's bytes."""
    bits = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    odd = np.bincount((_mix(shingles) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.array([len(shingles)], "<u8").tobytes() + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def signs_may_reach(a: bytes, b: bytes, threshold: float) -> bool:
    """False only for sets that can't reach the threshold: they differ in at least as many elements as their parities."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    sizes, x, y = (int(x[0]), int(y[0])), x[1:], y[1:]
    if min(sizes) < threshold * max(sizes) - 1e-9:
        return False
    while len(x) != len(y):  # the buckets of the finer one are folded
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= (1 - threshold) / (1 + threshold) * sum(sizes) + 1e-6


def _sets_reach(a: bytes, b: bytes, threshold: float) -> bool:
    sizes = (len(a) // HASH_BYTES, len(b) // HASH_BYTES)
    if min(sizes) < threshold * max(sizes) - 1e-9:
        return False
    common = len(np.intersect1d(_from_set(a), _from_set(b), assume_unique=True))
    return common >= threshold * (sum(sizes) - common) - 1e-9


def _kept(pairs: DataFrame, sets: DataFrame, column: str, test: Callable[[bytes, bytes, float], bool], threshold: float, tag: str) -> DataFrame:
    """The ``pairs(a, b)`` of which ``column`` of ``sets(vertex, ...)`` passes the test.

    The value of each ``b`` travels to its ``a`` once a pair; partners of an ``a`` are dealt in
    blocks of PARTNERS, each of which gets the value of ``a``.
    """
    leads = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")
    others = pairs.join(checked_broadcast(leads.where("blocks > 1")), "a", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    roles = others.select(F.col("b").alias("vertex"), "a", block.alias("block"), F.lit(1).alias("role"))
    roles = roles.unionByName(leads.select(F.col("a").alias("vertex"), "a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lead = None, None
        for batch in batches:
            a, b = [], []
            for key, part, role, vertex, data in zip(*(batch.column(c).to_pylist() for c in ("a", "block", "role", "vertex")), batch.column(column)):
                if (key, part) != now:
                    now, lead = (key, part), None
                if role == 0:
                    lead = data.as_py()
                elif lead is not None and test(lead, data.as_py(), threshold):
                    a.append(key)
                    b.append(vertex)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        release_memory()

    met = sets.join(checked_broadcast(roles), "vertex").select("a", "block", "role", "vertex", column)
    met = met.repartition(F.col("a"), F.col("block")).sortWithinPartitions("a", "block", "role")
    return materialize(met.mapInArrow(run, "a long, b long"), tag)


def sifted(pairs: DataFrame, sets: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The ``pairs(a, b)`` that ``sets(vertex, sign)`` don't rule out: signs travel once a pair, sets only for what is left."""
    return _kept(pairs, sets, "sign", signs_may_reach, threshold, "similar-sifted")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The ``pairs(a, b)`` whose ``sets(vertex, shingles)`` have the similarity."""
    return _kept(pairs, sets, "shingles", _sets_reach, threshold, "similar-links")


def similar_links(members: DataFrame, docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Verified links (a, b) of ``members(vertex, row_key, size, prefix, signature)``, texts from ``docs(row_key, text)``.

    Two sets of the threshold share a shingle of their prefixes, so every pair meets in the
    group of one; sizes and signatures leave out only pairs that can't reach the threshold.
    Signs, which grow with the sets, then rule out nearly all pairs below the threshold. Each pair
    that is left is verified by the Jaccard similarity of the shingle sets, but for pairs that verified links connect already. Large groups give few pairs at first; then
    their texts that are still apart are compared in clusters, where only links leave the task.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, v, n, *signs in _by_group(batches, "token", COLUMNS):
            order = np.lexsort((v, k))
            k = k[order]
            yield _pairs_in_groups(k, v[order], n[order].astype(np.int64), np.stack(signs, axis=1)[order], threshold)
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            large = k[first[np.diff(np.r_[first, len(k)]) > GROUP]]
            yield pa.RecordBatch.from_arrays([pa.array(large, pa.int64()), pa.nulls(len(large), pa.int64())], ["a", "b"])
        release_memory()

    tokens = _tokens(members).repartition(F.col("token")).sortWithinPartitions("token")
    met = materialize(tokens.mapInArrow(compare, "a long, b long").distinct(), "similar-pairs")
    pairs, large = met.where("b is not null"), met.where("b is null").select(F.col("a").alias("token"))
    crowd = _tokens(members).join(checked_broadcast(large), "token")
    some = pairs.select(F.explode(F.array("a", "b")).alias("vertex")).union(crowd.select("vertex")).distinct()
    some = materialize(members.select("vertex", "row_key").join(some, "vertex", "left_semi"), "similar-some")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, at = batch_words(b.column("text"))
            sets = [_as_set(shingles_of(words[s:e])) for s, e in zip(at[:-1], at[1:])]
            signs = [sign(_from_set(x)) for x in sets]
            yield pa.RecordBatch.from_arrays([b.column("vertex"), pa.array(signs, pa.binary()), pa.array(sets, pa.binary())], ["vertex", "sign", "shingles"])
        release_memory()

    texts = docs.join(checked_broadcast(some), "row_key")
    sets = materialize(texts.select("vertex", "text").mapInArrow(describe, "vertex long, sign binary, shingles binary"), "similar")

    def apart(some_pairs: DataFrame, roots: DataFrame) -> DataFrame:
        left = some_pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
        return materialize(left.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"), "similar-apart")

    def connect(some_pairs: DataFrame, found: DataFrame) -> DataFrame:
        some_pairs = sifted(some_pairs, sets, threshold)
        # one partner of each text first: what that connects needs no further pair
        found = found.unionByName(verified(some_pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets, threshold))
        return found.unionByName(verified(apart(some_pairs, components(found)), sets, threshold))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, v, n, *signs, root, lead in _by_group(batches, "token", [*COLUMNS, "root", "lead"]):
            yield from _pairs_apart(k, v, n.astype(np.int64), lead, np.stack(signs, axis=1), threshold, root)
        release_memory()

    found = connect(pairs, pairs.limit(0))
    if large.isEmpty():
        return found
    named = crowd.join(components(found).withColumnRenamed("node", "vertex"), "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    named = materialize(named, "similar-crowd")
    split = named.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token")
    named = named.join(checked_broadcast(materialize(split, "similar-split")), "token", "left_semi")
    within, leads = cluster_links(named, sets.select("vertex", "shingles"), threshold)
    # texts that share a frequent shingle, but not their cluster
    led = named.join(checked_broadcast(leads.select("vertex", "lead")), "vertex")
    apart_leads = led.groupBy("token").agg(F.min("lead").alias("x"), F.max("lead").alias("y")).where("x <> y").select("token")
    led = led.join(checked_broadcast(materialize(apart_leads, "similar-split")), "token", "left_semi").repartition(F.col("token")).sortWithinPartitions("token")
    across = materialize(led.mapInArrow(rest, "a long, b long").distinct(), "similar-rest")
    found = found.unionByName(within)
    return found if across.isEmpty() else connect(across, found)


def similar_components(marked: DataFrame, docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``(vertex, component_id, group, n)`` of ``marked``: components by equal words, by fingerprints within THRESHOLD and by similarity.

    docs: (row_key, text). group: a vertex of the component, for rows without any id.
    """
    vertices = marked.groupBy("vertex").agg(F.min("doc_id").alias("least"), F.min("rid").alias("rid"), F.min("fp").alias("fp"), F.count("*").alias("n"))
    vertices = materialize(vertices, "similar-v")
    first = vertices.select("rid")
    members = marked.join(checked_broadcast(first), "rid", "left_semi").select("vertex", "row_key", "size", "prefix", "signature")
    if first.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:  # a join with a shuffle is done once
        members = materialize(members, "similar-m")
    lead = vertices.groupBy("fp").agg(F.min("vertex").alias("a"))
    same = vertices.join(lead, "fp").where("a <> vertex").select("a", F.col("vertex").alias("b"))
    linked = links(lead).join(lead.select(F.col("fp").alias("a"), F.col("a").alias("x")), "a").join(lead.select(F.col("fp").alias("b"), F.col("a").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = components(same.unionByName(linked).unionByName(similar_links(members, docs, threshold)))
    named = vertices.join(roots.withColumnRenamed("node", "vertex"), "vertex", "left").withColumn("group", F.coalesce("root", "vertex"))
    ids = named.groupBy("group").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    return materialize(join_skewed(named.select("vertex", "group", "n"), ids, "group", vertices.count()).select("vertex", "component_id", "group", "n"), "similar-c")


def keep_representatives(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row of ``docs``, all columns whatever their names, of each component: that of its smallest doc_id.

    Components join rows with equal words, with fingerprints within THRESHOLD bits, and with
    shingle sets of ``threshold`` similarity or more. Of several rows with the id, the one
    whose row hash is least stays, and of equal rows one.
    """
    with temporary_tables(docs.sparkSession) as made:
        texts = docs.select("doc_id", "text", row_key().alias("row_key"))
        marked = materialize(sketches(texts, threshold), "simhash")
        named = join_skewed(marked.select("doc_id", "row_key", "vertex"), similar_components(marked, texts.select("row_key", "text"), threshold), "vertex", marked.count())
        leads = named.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        kept = leads.groupBy("group").agg(F.min("row_key").alias("row_key"))
        equal = marked.groupBy("row_key").count().where("count > 1").select("row_key", F.lit(True).alias("equal_rows"))
        kept = materialize(kept.select("row_key").join(equal, "row_key", "left"), "simhash-kept")
        drop_tables(docs.sparkSession, made[:-1])
    rows = boxed(docs, row_key().alias("row_key")).join(checked_broadcast(kept), "row_key")
    if kept.where("equal_rows").isEmpty():
        return unboxed(rows, docs.columns)
    alone, equal_rows = rows.where(F.col("equal_rows").isNull()), rows.where("equal_rows").dropDuplicates(["row_key"])
    return unboxed(alone, docs.columns).unionByName(unboxed(equal_rows, docs.columns))
