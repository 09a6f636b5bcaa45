"""Operator 5: removal of word runs that an earlier document has, with suffix automata.

``anchors`` narrows the corpus down to stretches that may repeat and deals those
of one anchor to one shard.  A shard builds the suffix automaton of its reference
stretches in the order of their doc_id and streams each later stretch through it
for matching statistics: a window is removed where the match that ends it is as
long as the window.  An automaton of all documents would have no size bound to
broadcast within; a shard's is where its own rows are, and has one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import MAX_CLASSES, NEED, SAMPLED, RangeHash, Scheme, mix, repeated, runs_of
from .common import map_arrow, require, text_buffer, with_unique_rows

#: Bytes of contexts (8 for each word) in a shard, but for one anchor's that are more.
SHARD = 400_000

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


class SuffixAutomaton:
    """The smallest automaton of all substrings of the sequences added."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.last = 0

    def end_sequence(self) -> None:
        self.last = 0

    def add(self, symbol) -> None:
        nxt, link, length = self.next, self.link, self.length
        p = self.last
        q = nxt[p].get(symbol)
        if q is not None and length[q] == length[p] + 1:
            # the sequence so far is in the automaton already, as a state of its own
            self.last = q
            return
        if q is not None:
            self.last = self._clone(p, q, symbol)
            return
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[p] + 1)
        while p >= 0 and symbol not in nxt[p]:
            nxt[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][symbol]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, symbol)
        self.last = new

    def _clone(self, p: int, q: int, symbol) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and nxt[p].get(symbol) == q:
            nxt[p][symbol] = copy
            p = link[p]
        link[q] = copy
        return copy

    def matching(self, sequence) -> list[int]:
        """For each place, the longest string ending there that is in the automaton."""
        nxt, link, length = self.next, self.link, self.length
        state, size, out = 0, 0, []
        for symbol in sequence:
            while state and symbol not in nxt[state]:
                state = link[state]
                size = length[state]
            to = nxt[state].get(symbol)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            out.append(size)
        return out


def earlier_in_shard(window: int):
    """The ``work`` of a shard: windows of contexts that one of a smaller doc has too."""

    def work(doc: np.ndarray, row: np.ndarray, start: np.ndarray, role: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        automaton, which, at = SuffixAutomaton(), [], []
        order = np.argsort(doc, kind="stable")
        for same in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
            sequences = [np.frombuffer(data[i], np.uint64).tolist() for i in same.tolist()]
            for i, sequence in zip(same.tolist(), sequences):
                if role[i] == NEED:
                    ends = [end for end, size in enumerate(automaton.matching(sequence), 1) if size >= window]
                    which += [i] * len(ends)
                    at += [int(start[i]) + end - window for end in ends]
            for sequence in sequences:
                automaton.end_sequence()
                for symbol in sequence:
                    automaton.add(symbol)
        return np.array(which, np.int64), np.array(at, np.int64)

    return work


def _words(data: np.ndarray, offsets: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of words, bounds of documents in words, and ranks that prefer k-grams of long words.

    Long words are rare, so anchors made of them seldom meet by chance.
    """
    space = np.append(_SPACE[data], True)
    inner = np.zeros(len(data) + 1, bool)
    inner[offsets[:-1]] = True
    begins = ~space
    begins[1:] &= space[:-1] | inner[1:]
    start = np.flatnonzero(begins)
    stop = np.zeros(len(data) + 1, bool)
    stop[1:] = ~space[:-1]
    stop[1:] &= space[1:] | inner[1:]
    stop[len(data)] = bool(len(data)) and not space[len(data) - 1]
    end = np.flatnonzero(stop)
    values = RangeHash(data)(start, end) if len(start) else np.zeros(0, np.uint64)
    bounds = np.searchsorted(start, offsets)
    lengths = np.concatenate([[0], np.cumsum(np.minimum(end - start, 40))])
    rank = 255 - np.minimum(255, lengths[gram:] - lengths[:-gram]) if len(start) >= gram else np.zeros(0, np.int64)
    return mix(values), bounds, rank


def remove_earlier(docs: DataFrame, *, window: int = 13, gram: int = 3, max_classes: int = MAX_CLASSES, sampled: int = SAMPLED, keep_text: bool = False) -> DataFrame:
    """Remove each word covered by ``window`` words that also start in a document with a smaller doc_id.

    ``docs`` has doc_id (an integer) and text; further columns are ignored, whatever
    their names.  Words are runs of anything but white space of ASCII, unchanged;
    windows are judged on the input.  Returns a row for each row: doc_id, n_words,
    n_removed, kept_sha256 (lowercase hex; kept words joined by one space) and, with
    ``keep_text``, kept.  Null and empty texts have no words.  Rows of one doc_id,
    repeated rows among them, do not remove each other's words.  A null doc_id is
    below every other, and such rows are rows of one document.  A long text is
    worked on whole by one task, in about 100 bytes of memory a byte.  An empty
    table gives an empty one.
    """
    require(docs, "doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    scheme, rows = Scheme(window, gram), with_unique_rows(docs.select("doc_id", "text"), "rows")
    numbered = rows.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    spans = repeated(numbered, scheme, _words, earlier_in_shard(window), ordered=True, shard=SHARD, max_classes=max_classes, sampled=sampled)
    joined = rows.join(spans, "row", "left").select("doc_id", "text", "starts", "ends")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_buffer(batch.column(1))
        runs_in, whole = runs_of(batch.column(2), batch.column(3)), data.tobytes()
        out: list[tuple] = []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            words = whole[a:b].split()
            runs, kept = runs_in(i, len(words)), words
            if runs:
                cuts = [0, *(x for r in runs for x in r), len(words)]
                kept = [w for x, y in zip(cuts[::2], cuts[1::2]) for w in words[x:y]]
            joined_words = b" ".join(kept)
            out.append((len(words), len(words) - len(kept), hashlib.sha256(joined_words).hexdigest(), joined_words.decode() if keep_text else None))
        cols = list(zip(*out)) or [()] * 4
        arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:2]), pa.array(cols[2], pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if keep_text:
            arrays, names = [*arrays, pa.array(cols[3], pa.string())], [*names, "kept"]
        return pa.RecordBatch.from_arrays(arrays, names)

    return map_arrow(joined, run, f"doc_id {id_type}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * keep_text)
