"""Operator 6: benchmark decontamination.

The n-grams of the benchmark's normalised items form a hash set that goes to
every worker; documents stream past it, all word windows of an Arrow batch hashed
at once, and every hash hit is verified word by word.

What is broadcast has a bound in words.  Items are cut into sections that overlap
by a window less one word, so no item is too long for it; a benchmark of more
words than the bound is dealt out in slices of sections, by hash.  The documents
are then scanned once a slice, a worker builds a slice's set once, and the hits of
all slices are merged by rows' keys.  The driver holds one slice at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialize, nested, require, texts, with_unique_rows

#: Words of benchmark items that one broadcast may hold, in sections of so many; about 100 bytes each on a worker.
MAX_WORDS, SECTION = 1_000_000, 20_000
#: Bytes normalised and hashed at once.
BLOCK = 4_000_000

#: A-Z to lower case; what separates words to a space; digits, letters and all of non-ASCII as they are.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD_SPAN = re.compile(rb"[^\x20]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


class GramSet:
    """The windows of some items: a hash table of their words, by window length."""

    def __init__(self, sections: list[tuple[str, int, bytes]], n: int):
        self.n = n
        #: window length -> words -> the items that hold it
        self.items: dict[int, dict[tuple[bytes, ...], set]] = defaultdict(lambda: defaultdict(set))
        for item, size, text in sections:
            words = text.split(b" ")
            for i in range(len(words) - size + 1):
                self.items[size][tuple(words[i : i + size])].add(item)
        self.hashes = {size: np.unique(np.array([_window_hash(w) for w in windows], np.uint64)) for size, windows in self.items.items()}
        self.filters = {}
        for size, hashes in self.hashes.items():
            bits = np.zeros(1 << 20, bool)
            bits[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.filters[size] = bits

    def hits(self, docs: list[list[bytes]]) -> Iterator[tuple[int, int, int, set]]:
        """(document, first word, words, items) for each occurrence of a window."""
        sizes = np.array([len(d) for d in docs], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        total = int(bounds[-1])
        if not total:
            return
        flat = [w for d in docs for w in d]
        hashed = np.fromiter(map(hash, flat), np.int64, total).view(np.uint64)
        for size, known in self.hashes.items():
            if total < size:
                continue
            rolled = _roll(hashed, size)
            at = np.flatnonzero(self.filters[size][(rolled >> np.uint64(44)).astype(np.int64)])
            found = rolled[at]
            at = at[known[np.minimum(np.searchsorted(known, found), len(known) - 1)] == found]
            doc = np.searchsorted(bounds, at, "right") - 1
            inside = at + size <= bounds[doc + 1]
            for i, d in zip(at[inside].tolist(), doc[inside].tolist()):
                items = self.items[size].get(tuple(flat[i : i + size]))
                if items:
                    yield d, i - int(bounds[d]), size, items


def _roll(hashed: np.ndarray, size: int) -> np.ndarray:
    n = len(hashed) - size + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out *= _PRIME
            out += hashed[k : k + n]
        out ^= out >> np.uint64(31)
        out *= _PRIME
    return out


def _window_hash(words: tuple[bytes, ...]) -> int:
    return int(_roll(np.array([hash(w) for w in words], np.int64).view(np.uint64), len(words))[0])


def sections(benchmark: DataFrame, n: int, section: int = SECTION) -> DataFrame:
    """(item, size, words, text): items as strings, in sections of words with a window of ``size`` words in each."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for item, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            words = words_of(text)
            size = min(n, len(words))
            for at in range(0, max(1, len(words) - size + 1), section) if size else ():
                part = words[at : at + section + size - 1]
                out.append((item, size, len(part), b" ".join(part)))
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.binary()))], ["item", "size", "words", "text"])

    found = map_arrow(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("None")).alias("item"), "text").distinct(), run, "item string, size int, words bigint, text binary")
    return materialize(found, "sections")


def slices(found: DataFrame, max_words: int) -> list[DataFrame]:
    """The sections in slices of about half of ``max_words`` words, or all as one that has no more."""
    total = found.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    if total <= max_words:
        return [found]
    k = -(-2 * total // max_words)
    return [found.where(F.pmod(F.xxhash64("item", "text"), F.lit(k)) == i) for i in range(k)]


def _batches(rows: list[str]) -> Iterator[tuple[int, list[list[bytes]]]]:
    first, held, docs = 0, 0, []
    for i, text in enumerate(rows):
        docs.append(words_of(text))
        held += len(text)
        if held >= BLOCK:
            yield first, docs
            first, held, docs = i + 1, 0, []
    if docs:
        yield first, docs


def _scanner(part: DataFrame, n: int):
    """The broadcast of a slice, and a function from documents' words to the merged runs of hit words and the items of each document with a hit."""
    shared = part.sparkSession.sparkContext.broadcast([(r["item"], r["size"], bytes(r["text"])) for r in part.select("item", "size", "text").collect()])
    made: list[GramSet] = []

    def scan(words: list[list[bytes]]) -> tuple[dict[int, list[list[int]]], dict[int, set]]:
        if not made:
            made.append(GramSet(shared.value, n))
        hit, items = defaultdict(list), defaultdict(set)
        for d, start, size, of in made[0].hits(words):
            hit[d].append((start, start + size))
            items[d] |= of
        return {d: _runs(found) for d, found in hit.items()}, items

    return scan


def _runs(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


#: Of a batch of the caller's columns, runs of hit words and items of each row (None: no hit) and its number of words: the result's rows.
Finish = Callable[[pa.RecordBatch, list, list, list], pa.RecordBatch]


def _scan_all(docs: DataFrame, benchmark: DataFrame, n: int, max_words: int, finish: Finish, schema: str | T.StructType) -> DataFrame:
    parts = slices(sections(benchmark, n), max_words)
    names = docs.columns

    def hits(scan, column: pa.Array) -> tuple[list, list, list]:
        rows = texts(column)
        spans: list = [None] * len(rows)
        items: list = [None] * len(rows)
        counts = [0] * len(rows)
        for first, words in _batches(rows):
            hit, of = scan(words)
            counts[first : first + len(words)] = map(len, words)
            for d in hit:
                spans[first + d], items[first + d] = hit[d], of[d]
        return spans, items, counts

    if len(parts) == 1:
        # one slice, or an empty benchmark: a narrow map
        scan = _scanner(parts[0], n)
        return map_arrow(docs, lambda batch: finish(batch, *hits(scan, batch.column(names.index("text")))), schema)

    def hit_rows(scan):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            spans, items, _ = hits(scan, batch.column(1))
            at = [i for i, x in enumerate(spans) if x is not None]
            columns = [pa.array([spans[i] for i in at], pa.list_(pa.list_(pa.int32()))), pa.array([sorted(items[i]) for i in at], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], ["row", "spans", "items"])

        return run

    rows, found = with_unique_rows(nested(docs, F.col("text")), "rows"), None
    for part in parts:
        one = materialize(map_arrow(rows.select("row", "text"), hit_rows(_scanner(part, n)), "row bigint, spans array<array<int>>, items array<string>"), "hits")
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = pa.RecordBatch.from_arrays(batch.column(0).flatten(), names)
        spans = [x and _runs(x) for x in batch.column(1).to_pylist()]
        items = [x and set(x) for x in batch.column(2).to_pylist()]
        return finish(own, spans, items, [len(words_of(t)) for t in texts(own.column(names.index("text")))])

    return map_arrow(rows.join(merged, "row", "left").select("doc", "spans", "items"), run, schema)


def _digest(items: set) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, max_words: int = MAX_WORDS) -> DataFrame:
    """Words of documents inside any benchmark window.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; further columns
    are ignored, whatever their names.  A window is ``n`` consecutive words of an
    item; an item of fewer words, but not none, is one window.  Returns a row for
    each row of ``docs``: doc_id, n_words, n_hit, n_items (items with an occurring
    window), items_sha256 (of their ids, sorted as strings, comma-joined), spans
    (maximal runs of hit words, [first, end)), contaminated.  Null and empty texts
    have no words and no hits, and items like that no windows; a null item_id is
    the item "None".  Repeated rows give repeated results, repeated items are one
    item.  Long texts and items are scanned whole.  An empty table gives an empty
    one, an empty benchmark no hits.
    """
    require(docs, "doc_id", "text")
    require(benchmark, "item_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, spans array<array<int>>, contaminated boolean"
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def finish(batch: pa.RecordBatch, spans: list, items: list, n_words: list) -> pa.RecordBatch:
        spans, items = [x or [] for x in spans], [x or () for x in items]
        n_hit = [sum(b - a for a, b in x) for x in spans]
        arrays = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(map(len, items), pa.int64()), pa.array(map(_digest, items), pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array([h > 0 for h in n_hit], pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, names)

    return _scan_all(docs.select("doc_id", "text"), benchmark, n, max_words, finish, schema)


def remove_spans(text: str, spans: list[list[int]]) -> str:
    """``text`` without the words of ``spans``, and without the separators between words of one span."""
    data = text.encode()
    places = [m.span() for m in _WORD_SPAN.finditer(data.translate(_TABLE))]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, data[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, drop_share: float = 0.5, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs``, all columns, with benchmark windows cut out of text.

    A document loses its hit words; one whose hit words are ``drop_share`` or more
    of all is dropped.  Rows without a hit stay as they are, null and empty texts
    too; repeated rows are treated alike, long texts whole.  A column n_chars, if
    there is one, follows the new text; all others stay, whatever their names.  An
    empty table gives an empty one, an empty benchmark changes nothing.
    """
    require(docs, "text")
    require(benchmark, "item_id", "text")
    names = docs.columns

    def finish(batch: pa.RecordBatch, spans: list, items: list, n_words: list) -> pa.RecordBatch:
        arrays, at = list(batch.columns), names.index("text")
        hit = [i for i, x in enumerate(spans) if x is not None]
        if not hit:
            return batch
        new, keep = arrays[at].to_pylist(), np.ones(batch.num_rows, bool)
        for i in hit:
            keep[i] = sum(b - a for a, b in spans[i]) < drop_share * n_words[i]
            new[i] = remove_spans(new[i], spans[i])
        arrays[at] = pa.array(new, arrays[at].type)
        if "n_chars" in names:
            k = names.index("n_chars")
            chars = arrays[k].to_pylist()
            for i in hit:
                chars[i] = len(new[i])
            arrays[k] = pa.array(chars, arrays[k].type)
        out = pa.RecordBatch.from_arrays(arrays, names)
        return out if keep.all() else out.filter(pa.array(keep))

    return _scan_all(docs, benchmark, n, max_words, finish, docs.schema)
