"""Harmonic packing of tokenised documents into fixed-size sequences.

Document lengths fall into reciprocal-capacity classes: class k takes lengths from over
``capacity // (k + 1)`` to ``capacity // k`` and fills each bin with exactly k whole
documents. What such a bin leaves free is filled with whole documents of the last class
(shorter than ``capacity // CLASSES``), then with pieces of the documents that are cut: the
rests of those longer than a sequence, and, only when these run short, documents of over
half a sequence, which would waste most. Gaps and rests of ``slack`` of a sequence or less
are never filled or cut off, so pieces stay large. Each worker fills its own bins; nothing is
shuffled. At its end, whole documents of open bins go where they fit, the emptiest bins are
cut up for the others, and the last rest goes into powers of two, which need no padding.

Edge cases: a null or empty text is the end id alone; repeated rows are packed each; a text
of any length is cut into full sequences and one rest; equal lengths are placed in the order
of rows; tables may be empty; extra columns are ignored; memory is bounded by one open bin a
class, WAITING bins with gaps and one batch of documents.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lectern.llm.common import bound_batches, large_batches, release_memory, single_threaded

CAPACITY = 2048
END_ID = 1
#: Share of a sequence that may stay free, and below which nothing is cut off.
SLACK = 1 / 128
#: Classes with bins of their own, and bins that may wait for their gap to be filled.
CLASSES, WAITING = 32, 256
#: Words, and pre-tokens, whose ids a Python worker keeps: 30 MB or so each, twice within a task, as the last generation stays.
CACHE_WORDS = 150_000
#: Bytes of documents that are encoded together (one Arrow batch at least): their words and parts take many times as much, beside the cache.
TEXT_BYTES = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


class WordTokenizer:
    """Ids of whole texts by a public tokenizer, a lookup for each distinct word of a batch.

    Blank, tab and line ends never lie inside a token of a tokenizer that removes white
    space, and none of its normalisers composes across them; so the ids of a text are
    those of its words in order. Words of Latin letters, digits and ASCII signs are split into
    their pre-tokens, all others are kept as they are; either go through the tokenizer when
    they are new, many in one call.
    """

    #: Words that fall into pre-tokens as PARTS says: no apostrophe, no "<", no sign beyond ASCII.
    PLAIN = "^[!-&(-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
    PARTS = "[a-z\u00e0-\u00f6\u00f8-\u00ff\u00df]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+"

    def __init__(self, path: str | None = None):
        single_threaded()
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words: list[dict[str, bytes]] = [{}, {}]
        self.parts: list[dict[str, bytes]] = [{}, {}]

    def forget(self) -> None:
        """Drop the older generation, between tasks."""
        self.words[1], self.parts[1] = {}, {}

    def _word_ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _part_ids(self, parts: list[str]) -> list[bytes]:
        """Ids of pre-tokens, encoded together and told apart by the ends of words."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(parts):
            return self._word_ids(parts)
        data, cuts = ids.tobytes(), (cuts * 4).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]

    @staticmethod
    def _lookup(cache: list[dict[str, bytes]], wanted: list[str], encode) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``wanted`` in a row, and how many each has. Two generations: what is still used moves to the new one."""
        found = list(map(cache[0].get, wanted))
        if missing := [w for w, ids in zip(wanted, found) if ids is None]:
            if len(cache[0]) + len(missing) > CACHE_WORDS:
                cache[:] = [{}, cache[0]]
                missing = wanted
            new, old = cache
            new.update((w, old[w]) for w in missing if w in old)
            unseen = [w for w in missing if w not in new]
            for i in range(0, len(unseen), 500):
                new.update(zip(unseen[i : i + 500], encode(unseen[i : i + 500])))
            found = list(map(new.__getitem__, wanted))
        return np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    @staticmethod
    def _gather(pool: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries ``index`` of a pool of entries of ``sizes``, in a row, and where each begins (and the last ends)."""
        starts, each = np.cumsum(sizes) - sizes, sizes[index]
        ends = np.r_[0, np.cumsum(each)]
        return pool[np.repeat(starts[index] - ends[:-1], each) + np.arange(ends[-1])], ends

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marked = pc.replace_substring_regex(pc.utf8_lower(words), pattern=self.PARTS, replacement="\\0\x1f")
        lists = pc.split_pattern(marked, "\x1f")
        coded = lists.flatten().dictionary_encode()
        parts = coded.dictionary.to_pylist()
        real = [p for p in parts if p]
        pool, sizes = self._lookup(self.parts, real, self._part_ids)
        if len(real) < len(parts):
            sizes = np.insert(sizes, parts.index(""), 0)
        pool, ends = self._gather(pool, sizes, coded.indices.to_numpy())
        return pool, np.diff(ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()])

    def encode_many(self, texts: pa.Array | pa.ChunkedArray | list) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without special tokens."""
        array = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.combine_chunks()
        lists = pc.ascii_split_whitespace(pc.fill_null(array.cast(pa.large_string()), ""))
        flat, bounds = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = flat.dictionary_encode()
        words = coded.dictionary
        plain = pc.match_substring_regex(words, self.PLAIN)
        pool, some = self._plain(words.filter(plain))
        more, others = self._lookup(self.words, words.filter(pc.invert(plain)).to_pylist(), self._word_ids)
        is_plain = plain.to_numpy(zero_copy_only=False).astype(bool)
        place = np.empty(len(words), np.int64)
        place[is_plain], place[~is_plain] = np.arange(len(some)), np.arange(len(others)) + len(some)
        out, ends = self._gather(np.r_[pool, more], np.r_[some, others], place[coded.indices.to_numpy()])
        at = (ends[bounds] * 4).tolist()
        data = out.tobytes()
        return [data[i:j] for i, j in zip(at, at[1:])]

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]


Piece = tuple  # (doc_id, start, ids, doc_tokens)


class HarmonicPacker:
    """One worker's bins; gives sequences, each a list of pieces (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int = CAPACITY, slack: float = SLACK, classes: int = CLASSES, waiting: int = WAITING):
        self.capacity, self.least, self.classes, self.limit = capacity, int(slack * capacity), classes, waiting
        self.open: dict[int, list[Piece]] = {}
        self.small: list[Piece] = []
        self.small_tokens = 0
        self.waiting: list[tuple[int, int, list[Piece]]] = []  # heap of (-gap, number, pieces)
        self.gaps = self.number = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[list[Piece]]:
        n, at, total = len(ids) // 4, 0, len(ids) // 4
        while n - at > self.capacity:
            yield [(doc_id, at, ids[4 * at : 4 * (at + self.capacity)], total)]
            at += self.capacity
        piece, n = (doc_id, at, ids[4 * at :], total), n - at
        k = self.capacity // n
        if self.capacity - n > self.least and (at or k == 1 or len(self.waiting) >= self.limit) and self.gaps >= n:
            yield from self._cut(piece)
        elif k >= self.classes:
            self.small.append(piece)
            self.small_tokens += n
            if self.small_tokens >= self.capacity:
                yield from self._close_bin(self._take_small(self.capacity))
        else:
            own = self.open.setdefault(k, [])
            own.append(piece)
            if len(own) == k:
                yield from self._close_bin(self.open.pop(k))

    def _take_small(self, room: int) -> list[Piece]:
        """Whole small documents that fit into ``room`` tokens."""
        taken = []
        while self.small and (size := len(self.small[-1][2]) // 4) <= room:
            room -= size
            self.small_tokens -= size
            taken.append(self.small.pop())
        return taken

    def _close_bin(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        """Give a bin out if it is full enough, else let it wait."""
        gap = self.capacity - sum(len(p[2]) // 4 for p in pieces)
        if self.least < gap:
            more = self._take_small(gap)
            pieces, gap = pieces + more, gap - sum(len(p[2]) // 4 for p in more)
        if gap <= self.least:
            yield pieces
        else:
            self.number += 1
            self.gaps += gap
            heapq.heappush(self.waiting, (-gap, self.number, pieces))

    def _cut(self, piece: Piece) -> Iterator[list[Piece]]:
        """Cut a document into the largest gaps; its end must not be a scrap."""
        doc_id, start, ids, total = piece
        while ids and self.waiting:
            gap, n = -self.waiting[0][0], len(ids) // 4
            take = min(gap, n)
            if 0 < n - take <= self.least and take > 2 * self.least:
                take = min(take, n - self.least - 1)
            _, number, pieces = heapq.heappop(self.waiting)
            self.gaps -= gap
            pieces = [*pieces, (doc_id, start, ids[: 4 * take], total)]
            start, ids, gap = start + take, ids[4 * take :], gap - take
            if gap <= self.least or len(ids):
                yield pieces
            else:
                self.gaps += gap
                heapq.heappush(self.waiting, (-gap, number, pieces))
        if ids:
            yield from self._close_bin([(doc_id, start, ids, total)])

    def close(self) -> Iterator[list[Piece]]:
        """What is open: whole documents where they fit, then the emptiest bins cut up for the others."""
        bins = [[-gap, number, pieces] for gap, number, pieces in self.waiting]
        loose = sorted([*(p for own in self.open.values() for p in own), *self.small], key=lambda p: -len(p[2]))
        self.open, self.small, self.waiting, self.small_tokens, self.gaps = {}, [], [], 0, 0
        gaps = sorted((gap, at) for at, (gap, _, _) in enumerate(bins))
        for p in loose:  # best fit, longest first
            size = len(p[2]) // 4
            i = bisect.bisect_left(gaps, (size, -1))
            if i == len(gaps):
                bins.append([self.capacity, 0, []])
                gaps.append((self.capacity, len(bins) - 1))
            gap, at = gaps.pop(i)
            bins[at][0] -= size
            bins[at][2].append(p)
            bisect.insort(gaps, (gap - size, at))
        bins.sort(key=lambda b: b[0])
        while bins and bins[0][0] <= self.least and (len(bins) > 1 or not bins[0][0]):
            yield bins.pop(0)[2]
        donor: list[Piece] = []
        while bins or donor:  # the fullest bin takes from the emptiest
            if not donor and len(bins) == 1:
                donor = bins.pop()[2]
            if not bins:
                yield from self._powers(donor)
                return
            gap, _, pieces = bins.pop(0)
            while gap > self.least and (donor or bins):
                if not donor:
                    donor = sorted(bins.pop()[2], key=lambda p: -len(p[2]))
                doc_id, start, ids, total = donor.pop()
                take = min(gap, len(ids) // 4)
                pieces.append((doc_id, start, ids[: 4 * take], total))
                gap -= take
                if rest := ids[4 * take :]:
                    donor.append((doc_id, start + take, rest, total))
            if gap <= self.least:
                yield pieces
            else:
                donor = pieces

    def _powers(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        left, room, now = sum(len(p[2]) // 4 for p in pieces), 0, []
        for doc_id, start, ids, total in pieces:
            while ids:
                if not room:
                    room = min(self.capacity, 1 << (left.bit_length() - 1))
                take = min(room, len(ids) // 4)
                now.append((doc_id, start, ids[: 4 * take], total))
                ids, start, room, left = ids[4 * take :], start + take, room - take, left - take
                if not room:
                    yield now
                    now = []


_tokenizers: dict[str | None, WordTokenizer] = {}


def pack(docs: DataFrame, capacity: int = CAPACITY, slack: float = SLACK, tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row a piece, see SCHEMA; sequence_length: tokens that its sequence holds.

    A sequence is padded to ``capacity`` unless its length is a power of two.
    """
    bound_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if tokenizer_path not in _tokenizers:
            _tokenizers[tokenizer_path] = WordTokenizer(tokenizer_path)
        encode, packer = _tokenizers[tokenizer_path].encode_many, HarmonicPacker(capacity, slack)
        sequence = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def put(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset, length = 0, sum(len(p[2]) // 4 for p in pieces)
            for doc_id, start, ids, total in pieces:
                rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, length))
                offset += len(ids) // 4
            sequence += 1

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 8)], names)
            rows.clear()
            return out

        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for table in large_batches(batches, TEXT_BYTES):
            for doc_id, ids in zip(table.column("doc_id").to_pylist(), encode(table.column("text"))):
                for pieces in packer.add(doc_id, ids + end):
                    put(pieces)
            yield batch()
        for pieces in packer.close():
            put(pieces)
        yield batch()
        _tokenizers[tokenizer_path].forget()
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
