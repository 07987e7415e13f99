"""Alignment of two tokenizers' tokens over a corpus, and how often each pair of tokens meets.

Each text is a run of segments, cut before blanks where neither tokenizer can join anything; a
batch aligns each different segment once. Tokens A and B are linked where their byte ranges overlap, and
fall into groups between the offsets where tokens of both end. A pair's key is
``B id << 32 | A id``. Tasks count their keys with ``np.unique``; the partial counts are range-sorted by key and
runs of equal keys are summed, each range becoming a sorted shard of keys and counts in the
shared folder, all pairs of a B id in a row. A second pass over the texts looks its pairs up in the
memory-mapped shards.

Edge cases: a text that is null or empty, or that either tokenizer doesn't give back byte by byte
after a blank, has no tokens: zeros, an empty string, and nothing counted; repeated rows count
each; a null doc_id stays null; tables may be empty; other columns are ignored, whatever their
names; a text without blanks is one segment, of any length. Memory of a task: a batch of texts
with its different segments, and SPILL partial counts; of the driver: a row a shard and the highest
count of each B id. Where the shared folder isn't mounted as files, tasks hold the shards that they
look into in memory.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bound_batches, large_batches, materialize, release_memory, shared_dir, single_threaded
from lectern.llm.packing import WordTokenizer

#: Partial counts that a task holds before it gives them out.
SPILL = 4_000_000
#: Segments of more bytes are encoded one by one, others so many in a row. Bytes of texts in a batch.
LONG, RUN, BATCH = 64, 4096, 12 << 20
#: A blank after one of these begins a segment; texts that hold the mark, the sign for a blank, or end in a blank are one segment.
BOUNDARY, MARK, BLANK = "[!-~À-ɏͰ-ϿЀ-ӿ一-鿿぀-ヿ가-힣؀-ۿ]", "\x1f", "▁"
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
COUNTED = "key long, n long"
SHARDS = "part int, first long, last long, b long, best long"


def byte_level() -> dict[str, int]:
    """The bytes that a byte-level vocabulary writes as printable signs."""
    plain = [b for first, last in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(first), ord(last) + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Side:
    """One tokenizer: ids of segments, and the bytes of each id. ``encode`` gives the ids of a segment, ``encode_run`` those of many short ones in a row."""

    def __init__(self, encode: Callable[[str], list[int]], tokens: list[bytes], encode_run: Callable[[str], list[int]] | None = None):
        self.encode, self.encode_run, self.tokens = encode, encode_run or encode, pa.array(tokens, pa.large_binary())
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)

    def _run(self, segments: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.encode_run("".join(segments)), dtype=np.int64)
        ends, stops = np.cumsum(self.sizes[ids]), np.cumsum(sizes)
        cuts = np.searchsorted(ends, stops, "right")
        if len(ids) and (ends[cuts - 1] == stops).all() and cuts[-1] == len(ids):
            return ids, np.diff(np.r_[0, cuts])
        return self._each(segments)

    def _each(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.encode(s) for s in segments]
        return np.array([i for ids in found for i in ids], dtype=np.int64), np.array([len(ids) for ids in found], dtype=np.int64)

    def ids(self, segments: pa.Array, sizes: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``segments`` of ``sizes`` bytes in a row, and how many each has; ``plain`` ones may stand in a row."""
        some, some_sizes = segments.filter(pa.array(plain)).to_pylist(), sizes[plain]
        found = [self._run(some[i : i + RUN], some_sizes[i : i + RUN]) for i in range(0, len(some), RUN)]
        found.append(self._each(segments.filter(pa.array(~plain)).to_pylist()))
        each = np.concatenate([n for _, n in found])
        place = np.empty(len(plain), np.int64)
        place[plain], place[~plain] = np.arange(len(some)), np.arange(len(plain) - len(some)) + len(some)
        out, ends = WordTokenizer._gather(np.concatenate([ids for ids, _ in found]), each, place)
        return out, np.diff(ends)


@cache
def sides(a_path: str | None, b_path: str | None) -> tuple[Side, Side]:
    """A byte-level tokenizer of the ``tokenizers`` library and one of ``sentencepiece``.

    Runs of short segments go through the rank file of the same vocabulary where A is the public one.
    """
    single_threaded()
    import base64

    import public_tokenizers
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(a_path or public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    signs = byte_level()
    of_a = [b""] * a.get_vocab_size()
    special = {i for i, t in a.get_added_tokens_decoder().items() if t.special}
    for token, i in a.get_vocab().items():
        of_a[i] = token.encode() if i in special else bytes(signs[c] for c in token)
    ranked = None
    if a_path is None:
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    b = sentencepiece.SentencePieceProcessor(model_file=b_path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    of_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
    # a segment begins with a blank, which the second tokenizer adds itself
    return Side(lambda text: a.encode(text, add_special_tokens=False).ids, of_a, ranked), Side(lambda text: b.encode(text[1:]), of_b)


@cache
def numerals(n: int) -> pa.Array:
    """``0,`` ... then ``0|`` ... then ``0;`` ..., up to ``n`` of each."""
    return pa.array([f"{i}{sign}" for sign in ",|;" for i in range(n)], pa.large_string()).cast(pa.large_binary())


@dataclass
class Aligned:
    """A batch: texts as runs of segments, and what each different segment holds. Invalid segments have no tokens."""

    bounds: np.ndarray  # of the segments of each text
    codes: np.ndarray  # the different segment that each is
    valid: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    link_bounds: np.ndarray  # of the links of each different segment
    keys: np.ndarray  # of all their links
    groups: pa.LargeBinaryArray

    def texts(self) -> np.ndarray:
        """Which texts have tokens: not empty, and no segment of theirs is invalid."""
        bad = np.r_[0, np.cumsum(~self.valid[self.codes])]
        return (np.diff(self.bounds) > 0) & (bad[self.bounds[1:]] == bad[self.bounds[:-1]])

    def each_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over the segments of each text."""
        total = np.r_[0, np.cumsum(values[self.codes])]
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Segments of all ``texts``, each with a blank before it, and where those of each text begin (and the last ends)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    whole = pc.or_(pc.match_substring_regex(texts, f"[{MARK}{BLANK}]"), pc.ends_with(texts, " "))
    marked = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.replace_substring_regex(texts, pattern=f"({BOUNDARY}) ", replacement=f"\\1{MARK} "), pa.scalar("", pa.large_string()))
    lists = pc.split_pattern(pc.if_else(whole, "", marked), MARK)
    flat, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    odd, empty = whole.to_numpy(zero_copy_only=False), pc.equal(texts, "").to_numpy(zero_copy_only=False)
    if odd.any() or empty.any():  # one segment, or none
        at = bounds[:-1]
        replaced = pa.array([" " + texts[int(i)].as_py() for i in np.flatnonzero(odd)], pa.large_string())
        mask = np.zeros(len(flat), bool)
        mask[at[odd]] = True
        flat = pc.replace_with_mask(flat, pa.array(mask), replaced)
        keep = np.ones(len(flat), bool)
        keep[at[empty]] = False
        flat = flat.filter(pa.array(keep))
        bounds = np.r_[0, np.cumsum(keep)][bounds]
    return flat, bounds


def _same_bytes(side: Side, ids: np.ndarray, each: np.ndarray, data: memoryview, ends: np.ndarray) -> np.ndarray:
    """Whether the tokens of each segment join to its bytes."""
    joined = side.tokens.take(pa.array(ids))
    total = np.r_[0, np.cumsum(side.sizes[ids])]
    stops = total[np.r_[0, np.cumsum(each)]]
    own = memoryview(joined.buffers()[2]) if len(ids) else memoryview(b"")
    if len(own) >= stops[-1] and stops[-1] == ends[-1] and (stops == ends).all() and own[: stops[-1]] == data[: ends[-1]]:
        return np.ones(len(each), bool)
    return np.array([own[s:t] == data[u:v] for s, t, u, v in zip(stops, stops[1:], ends, ends[1:])], bool)


def align(texts: pa.Array, a: Side, b: Side) -> Aligned:
    flat, bounds = split(texts)
    coded = flat.dictionary_encode()
    segments, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    n = len(segments)
    bytes_each = pc.binary_length(segments).to_numpy().astype(np.int64)
    plain = pc.match_substring_regex(segments, f"^ +[^ {MARK}{BLANK}]*{BOUNDARY}$").to_numpy(zero_copy_only=False).astype(bool) & (bytes_each <= LONG)
    (a_ids, a_each), (b_ids, b_each) = a.ids(segments, bytes_each, plain), b.ids(segments, bytes_each, plain)
    offsets = np.frombuffer(segments.buffers()[1], np.int64)[segments.offset : segments.offset + n + 1]
    data = memoryview(segments.buffers()[2])[offsets[0] : offsets[-1]] if n else memoryview(b"")
    place = offsets - offsets[0]
    valid = _same_bytes(a, a_ids, a_each, data, place) & _same_bytes(b, b_ids, b_each, data, place)
    if not valid.all():
        a_ids, b_ids = a_ids[np.repeat(valid, a_each)], b_ids[np.repeat(valid, b_each)]
        a_each, b_each, bytes_each = np.where(valid, a_each, 0), np.where(valid, b_each, 0), np.where(valid, bytes_each, 0)
    a_ends, b_ends, seg_ends = np.cumsum(a.sizes[a_ids]), np.cumsum(b.sizes[b_ids]), np.cumsum(bytes_each)
    both = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
    twice = both[1:] == both[:-1]
    ends, common = both[np.r_[True, ~twice]] if len(both) else both, both[1:][twice]
    keys = b_ids[np.searchsorted(b_ends, ends)] << 32 | a_ids[np.searchsorted(a_ends, ends)]
    a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
    a_upto, b_upto = np.searchsorted(a_ends, common, "right"), np.searchsorted(b_ends, common, "right")
    size = max(len(a.sizes), len(b.sizes))
    signs = np.empty(len(a_ids) + len(b_ids), np.int64)
    if len(common):
        signs[np.arange(len(a_ids)) + np.r_[0, b_upto][a_group]] = a_ids + size * (a_ends == common[a_group])
        signs[np.arange(len(b_ids)) + a_upto[b_group]] = b_ids + 2 * size * (b_ends == common[b_group])
    written = numerals(size).take(pa.array(signs))
    of_token = np.frombuffer(written.buffers()[1], np.int64)[: len(signs) + 1] if len(signs) else np.zeros(1, np.int64)
    of_segment = of_token[np.r_[0, np.cumsum(a_each + b_each)]]
    groups = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.ascontiguousarray(of_segment)), written.buffers()[2] if len(signs) else pa.py_buffer(b"")])
    count = lambda sorted_ends: np.diff(np.r_[0, np.searchsorted(sorted_ends, seg_ends, "right")])
    n_links = count(ends)
    return Aligned(bounds, codes, valid, a_each, b_each, count(common), np.r_[0, np.cumsum(n_links)], keys, groups)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    out = np.zeros(len(found), np.int64)
    np.add.at(out, at, n)
    return found, out


def _batches(**columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    size = len(next(iter(columns.values())))
    for i in range(0, size, 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in columns.values()], list(columns))


def partial_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, spill: int = SPILL) -> DataFrame:
    """``key`` and ``n`` of each task's links; a key comes once a task, or once for each ``spill`` keys."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(a_path, b_path)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = settled = 0
        for table in large_batches(batches, BATCH):
            x = align(table.column("text").combine_chunks(), a, b)
            ok = np.repeat(x.texts(), np.diff(x.bounds))
            times = np.bincount(x.codes[ok], minlength=len(x.valid))
            held.append(_summed(x.keys, np.repeat(times, np.diff(x.link_bounds))))
            waiting += len(held[-1][0])
            if waiting > max(spill // 4, settled):
                held = [_summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))]
                waiting, settled = 0, len(held[0][0])
                if settled > spill:
                    yield from _batches(key=held[0][0], n=held[0][1])
                    held, settled = [], 0
        if held:
            keys, n = _summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
            yield from _batches(key=keys[n > 0], n=n[n > 0])
        release_memory()

    return docs.select("text").mapInArrow(run, COUNTED)


class Shards:
    """Counts of pairs by key, in sorted shards: arrays of a file each, mapped into memory where they are files."""

    def __init__(self, firsts: np.ndarray, paths: list[str]):
        self.firsts, self.paths = firsts, paths
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _shard(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.open:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(self.paths[i])
            if isinstance(store, fs.LocalFileSystem):
                read = lambda name: np.load(f"{path}.{name}.npy", mmap_mode="r")
            else:
                read = lambda name: np.load(pa.PythonFile(store.open_input_file(f"{path}.{name}.npy")))
            self.open[i] = read("keys"), read("counts")
        return self.open[i]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Of sorted ``keys``; 0 for those that never occurred."""
        out = np.zeros(len(keys), np.int64)
        at = np.searchsorted(self.firsts, keys, "right") - 1
        cuts = np.flatnonzero(np.diff(at)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(keys)]):
            if hi > lo and at[lo] >= 0:
                known, n = self._shard(int(at[lo]))
                place = np.minimum(np.searchsorted(known, keys[lo:hi]), len(known) - 1)
                out[lo:hi] = np.where(known[place] == keys[lo:hi], n[place], 0)
        return out


def write_shards(partial: DataFrame, folder: str) -> DataFrame:
    """Sum ``partial`` by key into sorted shards under ``folder``: a row a shard, and rows of the highest count of each B id in it (columns SHARDS, ``file``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        keys, counts = [], []
        for b in batches:  # sorted; runs of equal keys may go on over batches
            if not b.num_rows:
                continue
            k, n = b.column("key").to_numpy(), b.column("n").to_numpy()
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            k, n = k[starts], np.add.reduceat(n, starts)
            if keys and keys[-1][-1] == k[0]:
                counts[-1][-1] += n[0]
                k, n = k[1:], n[1:]
            if len(k):
                keys.append(k)
                counts.append(n)
        if not keys:
            return
        k, n = np.concatenate(keys), np.concatenate(counts)
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}"  # an attempt that fails leaves files that no row names
        for kind, values in (("keys", k), ("counts", n)):
            with store.open_output_stream(f"{base}/{name}.{kind}.npy") as out:
                np.lib.format.write_array(out, values)
        of_b = k >> 32
        starts = np.flatnonzero(np.r_[True, of_b[1:] != of_b[:-1]])
        rows = len(starts)
        first = [int(k[0])] + [None] * rows
        yield pa.RecordBatch.from_arrays(
            [pa.array([task.partitionId()] * (rows + 1), pa.int32()), pa.array(first, pa.int64()), pa.array([int(k[-1])] + [None] * rows, pa.int64()), pa.array([None, *of_b[starts].tolist()], pa.int64()), pa.array([None, *np.maximum.reduceat(n, starts).tolist()], pa.int64()), pa.array([posixpath.join(folder, name)] + [None] * rows, pa.string())],
            ["part", "first", "last", "b", "best", "file"],
        )

    return partial.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, SHARDS + ", file string")


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row a document, see SCHEMA."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/pair-counts-{uuid.uuid4().hex}"
    partial = materialize(partial_counts(docs, a_path, b_path), "pair-counts")  # else the sample of the range sort reads all texts once more
    made = materialize(write_shards(partial, folder), "pair-shards")
    shards = made.where("file IS NOT NULL").orderBy("first").collect()
    best = {r["b"]: r["best"] for r in made.where("b IS NOT NULL").groupBy("b").agg(F.max("best").alias("best")).collect()}  # one for each B id at most
    highest = np.zeros(max(best, default=0) + 1, np.int64)
    highest[list(best)] = list(best.values())
    known = spark.sparkContext.broadcast((np.array([r["first"] for r in shards], np.int64), [r["file"] for r in shards], highest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(a_path, b_path)
        firsts, files, highest = known.value
        counts = Shards(firsts, files)
        for table in large_batches(batches, BATCH):
            x = align(table.column("text").combine_chunks(), a, b)
            keys, at = np.unique(x.keys, return_inverse=True)
            n = counts.counts(keys)
            is_best = n == highest[np.minimum(keys >> 32, len(highest) - 1)]
            each = lambda values: np.diff(np.r_[0, np.cumsum(values[at])][x.link_bounds])  # noqa: E731, B023
            ok = x.texts()
            figures = [np.where(ok, x.each_text(v), 0) for v in (x.n_a, x.n_b, x.n_groups, np.diff(x.link_bounds), each(is_best.astype(np.int64)), each(n))]
            written = x.groups.take(pa.array(x.codes))
            offsets = np.frombuffer(written.buffers()[1], np.int64)[: len(written) + 1][x.bounds] if len(written) else np.zeros(len(x.bounds), np.int64)
            data = memoryview(written.buffers()[2]) if len(written) and written.buffers()[2] is not None else memoryview(b"")
            digests = [hashlib.sha256(data[s : t - 1]).hexdigest() if good else "" for s, t, good in zip(offsets.tolist(), offsets[1:].tolist(), ok.tolist())]
            columns = [table.column("doc_id").combine_chunks().cast(pa.int64()), *(pa.array(f, pa.int64()) for f in figures), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCHEMA.split(", ")])
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
