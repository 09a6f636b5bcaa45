"""Operator 2: packing token sequences into near-equal windows by Karmarkar-Karp differencing.

Every document's ids are cut into pieces.  Whole windows' worth of ids go out as
they are; what is left over joins a pool of pieces, and each time the pool holds
``pool_windows`` windows' worth it is divided by multiway differencing: the two
partial partitions with the largest imbalance are merged, heaviest part with
lightest, until one partition is left.  Should a part exceed the capacity, the
number of windows rises by one and the division is made again.

The work is a narrow map: a pool belongs to one input partition, no row is
shuffled and no key can be hot.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import require, texts

MAX_WORDS = 400_000
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([-.,;:!?|#$%&*()]*)")
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: chr(b) if b in _PRINTABLE else chr(256 + sum(x not in _PRINTABLE for x in range(b))) for b in range(256)}
_CACHE: dict[str, "Encoder"] = {}


def kk_partition(sizes: list[int], k: int) -> np.ndarray:
    """The part, from 0 to k - 1, of each size, by multiway largest differencing."""
    n = len(sizes)
    if k == 1 or n == 0:
        return np.zeros(n, np.int64)
    # A node is a partition of some sizes into k parts, in descending order of their sums.
    sums: list[np.ndarray] = []
    made: list[tuple[int, int, np.ndarray] | None] = []
    heap: list[tuple[int, int]] = []
    for i, size in enumerate(sizes):
        one = np.zeros(k, np.int64)
        one[0] = size
        sums.append(one)
        made.append(None)
        heap.append((-int(size), i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        merged = sums[a] + sums[b][::-1]
        order = np.argsort(-merged, kind="stable")
        merged = merged[order]
        sums[a] = sums[b] = None  # type: ignore[call-overload]
        sums.append(merged)
        made.append((a, b, order))
        heapq.heappush(heap, (int(merged[-1] - merged[0]), len(sums) - 1))
    parts = np.zeros(n, np.int64)
    todo = [(heap[0][1], np.arange(k))]
    while todo:
        node, slots = todo.pop()
        if made[node] is None:
            parts[node] = slots[0]
            continue
        a, b, order = made[node]
        # Sorted part i came from a's part order[i] and b's part k - 1 - order[i].
        of_a = np.empty(k, np.int64)
        of_a[order] = slots
        todo += [(a, of_a), (b, of_a[::-1])]
    return parts


def balanced_windows(sizes: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """Parts within ``capacity`` and their number, the least that differencing can keep to."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = kk_partition(sizes, k)
        if np.bincount(parts, sizes, k).max(initial=0) <= capacity:
            return parts, k
        k += 1


#: What a vocabulary file says of normalization and pre-tokens if its words can be looked up one by one.
NORMALIZERS = ("NFC", "Replace", "Lowercase")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _word_by_word(path: str) -> bool:
    """Whether a file lower-cases and cuts words as ``Encoder`` does when it keeps their ids."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    steps = (told.get("normalizer") or {}).get("normalizers") or []
    cuts = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    blank = [x for x in steps if x["type"] == "Replace"]
    return (
        tuple(x["type"] for x in steps) == NORMALIZERS
        and (blank[0]["pattern"], blank[0]["content"]) == ({"Regex": r"\s+"}, " ")
        and [x.get("type") for x in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["pattern"] == {"Regex": SPLIT}
        and (cuts[0]["behavior"], cuts[0]["invert"], cuts[1]["add_prefix_space"], cuts[1]["use_regex"]) == ("Removed", True, False, False)
        and told.get("post_processor") is None
    )


class Encoder:
    """Ids of a vocabulary file of the ``tokenizers`` library.

    Where the file lower-cases and never joins words across white space, words are
    looked up one by one and kept; any other file is left to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.by_words = _word_by_word(path)
        self.chunks: dict[str, bytes] = _Words(self._chunk)
        self.words: dict[str, bytes] = _Words(self._word)

    @classmethod
    def load(cls, path: str) -> "Encoder":
        if path not in _CACHE:
            _CACHE[path] = cls(path)
        return _CACHE[path]

    def _word(self, word: str) -> bytes:
        piece = word if word.isascii() else "".join([_BYTES[b] for b in word.encode()])
        return np.array([t.id for t in self.model.tokenize(piece)], np.uint32).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if simple := _SIMPLE.fullmatch(chunk):
            word, signs = simple.groups()
            return self.words[word.lower()] + self.words[signs] if signs else self.words[word.lower()]
        return np.array(self.tok.encode(chunk, add_special_tokens=False).ids, np.uint32).tobytes() if chunk else b""

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, special strings as the library takes them by default."""
        if not self.by_words:
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


class _Words(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) >= MAX_WORDS:
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


class Packer:
    """Collects (key, start, length, ...) pieces and gives them places in sequences."""

    def __init__(self, capacity: int, pool_windows: int, first_id: int, piece: int, slack: int):
        self.capacity, self.windows, self.next_id, self.piece = capacity, pool_windows, first_id, piece
        self.target = pool_windows * (capacity - slack)
        self.pool: list[tuple] = []
        self.held = 0

    def add(self, key, ids: bytes) -> Iterator[tuple]:
        n, at, cap = len(ids) // 4, 0, self.capacity
        while n - at >= cap:
            yield self._row(key, ids, at, cap, n, self.next_id, 0)
            self.next_id += 1
            at += cap
        while at < n:
            take = min(self.piece, n - at, self.target - self.held)
            self.pool.append(self._row(key, ids, at, take, n, 0, 0))
            self.held += take
            at += take
            if self.held == self.target:
                yield from self.flush()

    @staticmethod
    def _row(key, ids: bytes, at: int, take: int, n: int, seq: int, offset: int) -> tuple:
        return key, at, take, zlib.crc32(ids[4 * at : 4 * (at + take)]), n, seq, offset

    def flush(self) -> Iterator[tuple]:
        if not self.pool:
            return
        parts, k = balanced_windows([row[2] for row in self.pool], self.capacity)
        filled = [0] * k
        for row, part in zip(self.pool, parts.tolist()):
            yield *row[:5], self.next_id + part, filled[part]
            filled[part] += row[2]
        self.next_id += k
        self.pool, self.held = [], 0


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 2, pool_windows: int = 128, piece: int = 256, slack: int = 16) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    ``docs`` has doc_id and text; further columns are ignored.  A document is its
    ids and then ``end_id``.  Returns a row for each piece: doc_id, start (the
    document's ids before it), length, ids_crc32 (of the little-endian unsigned
    32-bit ids), doc_tokens, sequence_id, offset (in the sequence, gapless from 0).
    Pools are cut to ``pool_windows`` windows of ``capacity - slack`` tokens, so
    that differencing has room to fill them; a partition's last pool holds less
    and costs at most a window.  Sequence ids are unique, not dense.  A null or
    empty text is the one token ``end_id``; a null doc_id stays null; a repeated row
    is packed each time; an empty table gives an empty one.
    """
    require(docs, "doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kind = Encoder.load(tokenizer), None
        packer = Packer(capacity, pool_windows, TaskContext.get().partitionId() << 40, piece, slack)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for key, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                out += packer.add(key, encoder.ids(text) + end)
            if out:
                yield batch_of(out)
        if out := list(packer.flush()):
            yield batch_of(out)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
