"""Operator 4: removal of repeated byte strings with suffix arrays built by induced sorting.

``anchors`` narrows the corpus down to stretches that may repeat, and deals those
of one anchor to one shard.  A shard's suffix array is made by induced sorting:
suffixes are classified, leftmost-smaller (LMS) substrings are sorted by
inducing and named, their sequence is sorted by the same function, one level
down, and the whole array is induced from their order.  Each bucket of the array
is worked through in waves of whole arrays, in the order in which the sequential
algorithm would visit its entries.  Common prefixes of neighbours are computed
in text order (permuted): a place shares at least one symbol less than the place
before it, so all that is compared is linear in the text.  They tell which
windows repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import MAX_CLASSES, NEED, SAMPLED, RangeHash, Scheme, repeated, runs_of
from .common import map_arrow, require, text_buffer, with_unique_rows

#: Bytes of contexts in a shard, but for one anchor's that are more; a worker holds about 150 bytes for each.
SHARD = 400_000
#: Where there are more names than one to so many places they are ranked by doubling: a bucket for each would cost more.
PLACES_A_NAME = 100
#: Places of a text whose common prefixes are found at once.
STRIDE = 64


def _deal(lists: list[list[np.ndarray]], chars: np.ndarray, places: np.ndarray) -> None:
    """Append each place to the list of its character, in order."""
    if not len(places):
        return
    order = np.argsort(chars, kind="stable")
    chars, places = chars[order], places[order]
    cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
    for part, c in zip(np.split(places, cuts), chars[np.concatenate([[0], cuts])].tolist()):
        lists[c].append(part)


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """All suffixes in order, given the LMS ones in (some) order, by the two inducing passes."""
    larges: list[list[np.ndarray]] = [[] for _ in range(k)]
    smalls: list[list[np.ndarray]] = [[] for _ in range(k)]
    seeds: list[list[np.ndarray]] = [[] for _ in range(k)]
    _deal(seeds, text[lms], lms)
    done: list[np.ndarray] = []
    empty = np.zeros(0, lms.dtype)

    def spread(places: np.ndarray, to: list[list[np.ndarray]], want_small: bool) -> None:
        before = places[places > 0] - 1
        before = before[small[before] == want_small]
        _deal(to, text[before], before)

    for c in range(k):
        at = 0
        while at < len(larges[c]):
            wave = larges[c][at:]
            at = len(larges[c])
            spread(np.concatenate(wave), larges, False)
        done.append(np.concatenate(larges[c]) if larges[c] else empty)
        if seeds[c]:
            spread(np.concatenate(seeds[c]), larges, False)
    for c in range(k - 1, -1, -1):
        at = 0
        while at < len(smalls[c]):
            wave = smalls[c][at:]
            at = len(smalls[c])
            spread(np.concatenate(wave), smalls, True)
        if len(done[c]):
            spread(done[c][::-1], smalls, True)
    return np.concatenate([x for c in range(k) for x in (done[c], *(p[::-1] for p in reversed(smalls[c])))])


def _rank_names(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a sequence of names: by induced sorting, or by doubling where nearly each place has a name of its own."""
    n = len(names)
    if (int(names.max()) + 1) * PLACES_A_NAME <= n:
        return suffix_array(names)
    rank, step = names.astype(np.int64), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start of each suffix in lexicographic order; the end of the text is below every symbol, which are 0 and more."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    text = np.append(text.astype(np.int32) + 1, 0).astype(np.int32)
    if text.max() < 1 << 16:
        text = text.astype(np.uint16)
    m = n + 1
    # A suffix is small (S) if it is below the one after it: look at the next symbol that differs.
    change = np.flatnonzero(text[:-1] != text[1:])
    small = np.append(np.repeat(text[change] < text[change + 1], np.diff(change, prepend=-1)), True)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    k = int(text.max()) + 1
    if len(lms) > 1:
        first = _induce(text, small, lms, k)
        is_lms = np.zeros(m, bool)
        is_lms[lms] = True
        # the end itself comes first; nothing induces it
        in_order = np.append(n, first[is_lms[first]])
        # Name LMS substrings: neighbours in order are equal or not.
        following = np.append(lms[1:], n)
        end = np.zeros(m, np.int64)
        end[lms] = following + 1
        hashed = RangeHash(text)(in_order, np.minimum(end[in_order], m))
        named = np.concatenate([[0], np.cumsum(hashed[1:] != hashed[:-1])])
        names = np.zeros(m, np.int64)
        names[in_order] = named
        lms = lms[_rank_names(names[lms])]
    return _induce(text, small, lms, k)


def _words(raw: bytes, n: int) -> np.ndarray:
    """The eight bytes from each place on, as one number, first byte lowest."""
    return np.ndarray((n,), "<u8", raw + bytes(8), strides=(1,))


def permuted_lcp(array: np.ndarray, raw: bytes, limit: np.ndarray) -> np.ndarray:
    """For each place, in text order, the bytes its suffix shares with the one before it in ``array``.

    Prefixes end at ``limit``, the end of a place's own stretch.  The shared prefix
    of a place is at least that of the place before it less one, so comparison
    goes on from there: all ``STRIDE``-th places together, then the ones after them.
    """
    n = len(array)
    before = np.zeros(n, np.int64)
    before[array[1:]] = array[:-1]
    end = np.arange(n)
    most = np.minimum(limit - end, limit[before] - before)
    most[array[:1]] = 0
    words, out = _words(raw, n), np.zeros(n, np.int64)
    for first in range(STRIDE):
        at = np.arange(first, n, STRIDE)
        size = np.maximum(out[at - 1] - 1, 0) if first else np.zeros(len(at), np.int64)
        size = np.minimum(size, most[at])
        open_ = np.flatnonzero(size < most[at])
        while len(open_):
            p, done = at[open_], size[open_]
            differ = words[p + done] ^ words[before[p] + done]
            # bytes up to the lowest that differs; all eight if none does
            same = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
            size[open_] = np.minimum(done + same, most[p])
            open_ = open_[(same == 8) & (size[open_] < most[p])]
        out[at] = size
    return out


def repeated_in_shard(window: int):
    """The ``work`` of a shard: windows of contexts that another place has too."""

    def work(doc: np.ndarray, row: np.ndarray, start: np.ndarray, role: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in data], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
        raw = b"\0".join(data) + b"\0"
        text = np.frombuffer(raw, np.uint8).astype(np.uint16) + 1
        text[bounds[1:] - 1] = 0
        array = suffix_array(text)
        limit = np.repeat(bounds[1:] - 1, sizes + 1)
        shared = permuted_lcp(array, raw, limit)
        run = np.zeros(len(array), np.int64)
        run[array] = np.cumsum(shared[array] < window)
        at = np.flatnonzero(limit - np.arange(len(text)) >= window)
        # Only runs of two and more; one place may be there in the contexts of two anchors.
        at = at[np.bincount(run[at])[run[at]] > 1]
        which = np.searchsorted(bounds, at, "right") - 1
        place = at - bounds[which] + start[which]
        sort = np.lexsort((place, row[which], run[at]))
        which, place, runs = which[sort], place[sort], run[at][sort]
        if not len(which):
            return which, place
        new = np.concatenate([[True], runs[1:] != runs[:-1]])
        other = np.concatenate([[False], (row[which[1:]] != row[which[:-1]]) | (place[1:] != place[:-1])])
        several = np.add.reduceat((other & ~new).astype(np.int64), np.flatnonzero(new))[np.cumsum(new) - 1] > 0
        hit = several & (role[which] == NEED)
        return which[hit], place[hit]

    return work


def _bytes(data: np.ndarray, offsets: np.ndarray, gram: int):
    return data, offsets, None


def remove_repeats(docs: DataFrame, *, window: int = 200, gram: int = 48, max_classes: int = MAX_CLASSES, sampled: int = SAMPLED, keep_text: bool = False) -> DataFrame:
    """Remove each byte covered by a ``window``-byte string that also starts anywhere else.

    ``docs`` has doc_id, of any type, and text; further columns are ignored, whatever
    their names.  Texts are UTF-8 bytes, matches never cross rows, strings are
    judged on the input.  Returns a row for each row: doc_id, n_bytes, n_removed,
    n_spans (maximal removed runs), kept_sha256 (lowercase hex) and, with
    ``keep_text``, kept: the remaining bytes.  A null or empty text is no bytes.
    Rows are told apart by a key of their own: they may share a doc_id or have none,
    and a repeated row repeats itself, so it loses all its bytes if it has
    ``window`` or more.  A long text is worked on whole by one task, in about 100
    bytes of memory a byte.  An empty table gives an empty one.
    """
    require(docs, "doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    scheme, rows = Scheme(window, gram), with_unique_rows(docs.select("doc_id", "text"), "rows")
    spans = repeated(rows.withColumn("doc", F.lit(0).cast("long")), scheme, _bytes, repeated_in_shard(window), ordered=False, shard=SHARD, max_classes=max_classes, sampled=sampled)
    joined = rows.join(spans, "row", "left").select("doc_id", "text", "starts", "ends")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_buffer(batch.column(1))
        runs_in, whole = runs_of(batch.column(2), batch.column(3)), data.tobytes()
        out: list[tuple] = []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            runs, kept = runs_in(i, b - a), whole[a:b]
            if runs:
                cuts = [0, *(x for r in runs for x in r), b - a]
                kept = b"".join([kept[x:y] for x, y in zip(cuts[::2], cuts[1::2])])
            out.append((b - a, b - a - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
        cols = list(zip(*out)) or [()] * 5
        arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        return pa.RecordBatch.from_arrays(arrays + [pa.array(cols[4], pa.binary())] * keep_text, names + ["kept"] * keep_text)

    return map_arrow(joined, run, f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text)
