"""Byte-level BPE: texts to token ids and back, on padded numpy matrices.

Texts are split by the vocabulary's pattern and every piece is merged by itself. Pieces of chunks not
seen lately are sorted into buckets by byte length; a bucket is one padded matrix of ids, and in each round every row
merges its leftmost pair of least rank. Ranks of pairs come from an open-addressing hash table held in two
arrays. A merge takes one column out of each row, so the matrix is compacted as it shrinks, and rows without
a mergeable pair leave it. Pieces beyond the widest bucket (a text without spaces, say) go through a heap of
the same order, whose cost is n log n.

Defined results: a null or empty text has no ids; repeated texts have equal ids; other columns are kept.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm.common import named, text_slices, tidy

#: Piece lengths in bytes up to which a padded matrix is used; each bound is one bucket.
BUCKETS = (4, 8, 12, 16, 24, 32, 64, 128, 256)
#: Cells of one matrix, chunks a worker remembers between runs of texts, ids decoded in one step: memory bounds, not limits.
MATRIX_CELLS, REMEMBERED, DECODED = 1_000_000, 250_000, 200_000
NO_RANK = np.int32(2**31 - 1)
_HASH = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Rank of the token that two adjacent tokens merge into, by hashing their ids."""

    def __init__(self, pairs: dict[int, int]):
        bits = max(10, (4 * max(1, len(pairs)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NO_RANK, np.int32)
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int32, len(pairs))
        slots = self._home(keys)
        while len(keys):
            # One key per slot is placed in each round; the others move to the next slot.
            free = self.keys[slots] == -1
            first = np.zeros(len(keys), bool)
            first[np.unique(slots, return_index=True)[1]] = True
            put = free & first
            self.keys[slots[put]], self.ranks[slots[put]] = keys[put], ranks[put]
            keys, ranks, slots = keys[~put], ranks[~put], (slots[~put] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _HASH) >> self.shift).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NO_RANK where a side is padding (-1) or the pair does not merge."""
        keys = (left.astype(np.int64) << 32) | right
        keys[(left < 0) | (right < 0)] = -2
        slots = self._home(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.ranks[slots], NO_RANK)
        rest = np.flatnonzero((found != keys) & (found != -1))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & self.mask
            found = self.keys[slots[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.ranks[slots[rest[hit]]]
            rest = rest[~hit & (found != -1)]
        return out


class Vocabulary:
    """Ranks of byte strings as in a rank file: one line per token, base64 and rank."""

    def __init__(self, content: bytes, pattern: str):
        self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        self.pattern = regex.compile(pattern)
        size = max(self.ids.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ids.items():
            tokens[rank] = token
        self.lengths = np.fromiter(map(len, tokens), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.of_byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = PairTable(pairs)

    # --- pieces to ids ---

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each piece has."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        offsets = np.cumsum(lens) - lens
        data = np.frombuffer(b"".join(pieces), np.uint8)
        whole = np.fromiter((self.ids.get(p, -1) for p in pieces), np.int32, len(pieces))
        counts = np.ones(len(pieces), np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = np.flatnonzero(whole >= 0)
        done.append((rows, whole[rows][:, None], counts[rows]))
        low = 0
        for high in BUCKETS:
            rows = np.flatnonzero((whole < 0) & (lens > low) & (lens <= high))
            step = max(1, MATRIX_CELLS // high)
            for at in range(0, len(rows), step):
                self._merge(data, offsets, lens, rows[at : at + step], high, counts, done)
            low = high
        for row in np.flatnonzero((whole < 0) & (lens > low)):
            ids = self._merge_long(data[offsets[row] : offsets[row] + lens[row]])
            counts[row] = len(ids)
            done.append((np.array([row]), ids[None, :], np.array([len(ids)])))
        flat = np.empty(int(counts.sum()), np.int32)
        starts = np.cumsum(counts) - counts
        for rows, ids, n in done:
            columns = np.arange(ids.shape[1])
            filled = columns < n[:, None]
            flat[(starts[rows][:, None] + columns)[filled]] = ids[filled]
        return flat, counts

    def _merge(self, data, offsets, lens, rows, width, counts, done) -> None:
        columns = np.arange(width)
        filled = columns < lens[rows][:, None]
        at = np.minimum(offsets[rows][:, None] + columns, len(data) - 1)
        ids = np.where(filled, self.of_byte[data[at]], np.int32(-1))
        left, n = ids[:, :-1], lens[rows].copy()
        ranks = self.pairs.lookup(left.ravel(), ids[:, 1:].ravel()).reshape(left.shape)
        while len(rows):
            where = ranks.argmin(axis=1)
            every = np.arange(len(rows))
            least = ranks[every, where]
            ended = least == NO_RANK
            if ended.any():
                counts[rows[ended]] = n[ended]
                done.append((rows[ended], ids[ended], n[ended]))
                go = ~ended
                rows, ids, ranks, n, where, least = rows[go], ids[go], ranks[go], n[go], where[go], least[go]
                every = every[: len(rows)]
                if not len(rows):
                    break
            ids[every, where] = least
            keep = np.ones(ids.shape, bool)
            keep[every, where + 1] = False
            ids = ids[keep].reshape(len(rows), -1)
            keep = np.ones(ranks.shape, bool)
            keep[every, where] = False
            ranks = ranks[keep].reshape(len(rows), -1)
            n = n - 1
            if ids.shape[1] < 2:
                counts[rows] = n
                done.append((rows, ids, n))
                break
            # Only the pairs on either side of the merged token are new.
            before = np.flatnonzero(where > 0)
            ranks[before, where[before] - 1] = self.pairs.lookup(ids[before, where[before] - 1], ids[before, where[before]])
            after = np.flatnonzero(where < ranks.shape[1])
            ranks[after, where[after]] = self.pairs.lookup(ids[after, where[after]], ids[after, where[after] + 1])

    def _merge_long(self, piece: np.ndarray) -> np.ndarray:
        ids = self.of_byte[piece].tolist()
        size = len(ids)
        ahead, behind = list(range(1, size + 1)), list(range(-1, size - 1))
        found = self.pairs.lookup(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(found) if r != NO_RANK]
        heapq.heapify(heap)
        rank_of: dict[tuple[int, int], int] = {}

        def offer(i: int) -> None:
            pair = ids[i], ids[ahead[i]]
            if pair not in rank_of:
                rank_of[pair] = int(self.pairs.lookup(np.array(pair[:1], np.int32), np.array(pair[1:], np.int32))[0])
            if rank_of[pair] != NO_RANK:
                heapq.heappush(heap, (rank_of[pair], i, *pair))

        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = ahead[i]
            if ids[i] != left or j >= size or ids[j] != right:
                continue
            ids[i], ids[j] = rank, -1
            ahead[i] = ahead[j]
            if ahead[i] < size:
                behind[ahead[i]] = i
                offer(i)
            if behind[i] >= 0:
                offer(behind[i])
        return np.array([x for x in ids if x >= 0], np.int32)

    # --- ids to bytes ---

    def decode_ids(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids one after another, and how many each id has."""
        lens = self.lengths[ids]
        return self.bytes[ranges(self.starts[ids], lens)], lens


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)


class Memory(dict):
    """Chunks met lately, numbered in order of arrival; a new chunk waits to be encoded."""

    def __init__(self):
        self.waiting: list[str] = []
        self.flat, self.counts = np.empty(0, np.int32), np.empty(0, np.int64)

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        self.waiting.append(chunk)
        return number

    def settle(self, vocabulary: Vocabulary) -> None:
        """Ids of the waiting chunks. Those that begin with white space are split by one pass over all of
        them: the pattern never matches across their first character, and inside they have neither space
        nor line break, so a piece that begins with one begins a chunk."""
        bare = [c[2:] for c in self.waiting if c.startswith(_BARE)]
        led = [c if c[0] == "\n" else " " + c for c in self.waiting if not c.startswith(_BARE)]
        per_bare = [vocabulary.pattern.findall(c) for c in bare]
        pieces = vocabulary.pattern.findall("".join(led))
        begins = np.fromiter((p[0] in " \n" for p in pieces), bool, len(pieces))
        sizes = np.diff(np.append(np.flatnonzero(begins), len(pieces)))
        pieces = [p for found in per_bare for p in found] + pieces
        sizes = np.concatenate([np.fromiter(map(len, per_bare), np.int64, len(bare)), sizes])

        numbers = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
        flat, counts = vocabulary.encode_pieces([p.encode() for p in numbers])
        of_piece = np.fromiter(map(numbers.__getitem__, pieces), np.int64, len(pieces))
        starts = np.cumsum(counts) - counts
        flat = flat[ranges(starts[of_piece], counts[of_piece])]
        ends = np.concatenate([[0], np.cumsum(counts[of_piece])])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        counts = np.diff(ends[edges])

        # Back to the order of arrival: bare chunks were taken first.
        is_bare = np.fromiter((c.startswith(_BARE) for c in self.waiting), bool, len(self.waiting))
        place = np.concatenate([np.flatnonzero(is_bare), np.flatnonzero(~is_bare)])
        order = np.empty(len(place), np.int64)
        order[place] = np.arange(len(place))
        self.flat = np.concatenate([self.flat, flat[ranges((np.cumsum(counts) - counts)[order], counts[order])]])
        self.counts = np.concatenate([self.counts, counts[order]])
        self.waiting = []


#: A chunk that begins a text, or stands by itself, carries this mark instead of a space.
_BARE = "\n\n"
_DOUBLE_SPACE = re.compile(r"\s\s")


def _chunks(text: str, vocabulary: Vocabulary, space_leads: bool) -> list[str]:
    """A text as chunks that the pattern never matches across, so each can be remembered as a whole.

    Where ``space_leads`` holds and no two white spaces meet, every space begins a match and every line
    break is one; a chunk is then a space or line break with what follows it. Any other text is taken
    match by match.
    """
    if space_leads and text and not text[0].isspace() and not text[-1].isspace() and not _DOUBLE_SPACE.search(text):
        return (_BARE + text.replace("\n", " \n")).split(" ")
    return [_BARE + piece for piece in vocabulary.pattern.findall(text)]


_LOADED: dict[str, tuple[Vocabulary, list[Memory]]] = {}


def _loaded(content: bytes, pattern: str) -> tuple[Vocabulary, list[Memory]]:
    key = hashlib.sha256(content + pattern.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(content, pattern), [Memory()]
    return _LOADED[key]


def encode_texts(
    texts: list[str], vocabulary: Vocabulary, memory: Memory, space_leads: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and how many each text has."""
    numbers, per_text = [np.empty(0, np.int64)], []
    for text in texts:
        chunks = _chunks(text, vocabulary, space_leads)
        per_text.append(len(chunks))
        numbers.append(np.fromiter(map(memory.__getitem__, chunks), np.int64, len(chunks)))
    if memory.waiting:
        memory.settle(vocabulary)
    numbers = np.concatenate(numbers)
    counts = memory.counts[numbers]
    starts = np.cumsum(memory.counts) - memory.counts
    ends = np.concatenate([[0], np.cumsum(counts)])
    edges = np.concatenate([[0], np.cumsum(np.array(per_text, np.int64))])
    return memory.flat[ranges(starts[numbers], counts)], np.diff(ends[edges])


def _encoder(shared, pattern: str, space_leads: bool) -> Callable[[pa.Array], pa.Array]:
    def encode(texts: pa.Array) -> pa.Array:
        vocabulary, held = _loaded(shared.value, pattern)
        ids, sizes = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
        for _, run in text_slices(texts):
            if len(held[0]) > REMEMBERED:
                held[0] = Memory()
            flat, counts = encode_texts(run, vocabulary, held[0], space_leads)
            ids.append(flat)
            sizes.append(counts)
        offsets = np.cumsum(np.concatenate(sizes)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))

    return encode


def _decoder(shared, pattern: str) -> Callable[[pa.Array], pa.Array]:
    def decode(lists: pa.Array) -> pa.Array:
        vocabulary, _ = _loaded(shared.value, pattern)
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        edges = np.concatenate([[0], np.cumsum(np.array(lists.value_lengths().fill_null(0), np.int64))])
        data, sizes, row = [], [np.zeros(1, np.int64)], 0
        # A step's index arrays are many times the bytes they gather, so a batch is decoded in steps of whole rows.
        while row < len(lists):
            last = max(row + 1, int(np.searchsorted(edges, edges[row] + DECODED, side="right")) - 1)
            found, lens = vocabulary.decode_ids(ids[edges[row] : edges[last]])
            ends = np.concatenate([[0], np.cumsum(lens)])
            sizes.append(np.diff(ends[edges[row : last + 1] - edges[row]]))
            data.append(found.tobytes())
            row = last
        offsets = np.cumsum(np.concatenate(sizes)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(data))])

    return decode


class Codec:
    """Column functions over one vocabulary. The rank file is read where the driver runs and sent to the
    executors once as a broadcast value; a vocabulary's size is fixed (under 1 MB for 50,000 tokens).

    ``space_leads`` states of the pattern that a space before a visible character always begins a match and
    that a line break between visible characters is a match by itself; it only saves time.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str, space_leads: bool = False):
        with open(path, "rb") as file:
            shared = spark.sparkContext.broadcast(file.read())
        self._encode = F.arrow_udf(tidy(_encoder(shared, pattern, space_leads)), "array<int>")
        self._decode = F.arrow_udf(tidy(_decoder(shared, pattern)), "binary")

    def encode(self, text: Column) -> Column:
        """Token ids of a text (null: none)."""
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        """The bytes that ids stand for."""
        return self._decode(ids)


def encode_documents(docs: DataFrame, codec: Codec, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` in column ``ids`` in place of a column of that name."""
    return docs.withColumn(ids, codec.encode(named(text)))


def decode_documents(encoded: DataFrame, codec: Codec, ids: str = "ids", data: str = "decoded") -> DataFrame:
    return encoded.withColumn(data, codec.decode(named(ids)))
