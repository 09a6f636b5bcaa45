"""Where repeated windows can be: content-chosen anchors, and what surrounds them.

In every window of W symbols the k-gram with the least hash is chosen, so equal
windows choose the same one, wherever they are.  The windows that choose an anchor
follow one another, and each window chooses one anchor.  Only occurrences of one
anchor can hold one window, and an anchor's context, the stretch of the windows
that choose it, tells which do:

* occurrences with equal contexts repeat each other whole;
* a context that has the anchor and half of the rest of a window in common with
  another needs a closer look, in a shard of bounded size that holds each
  different context once; any other shares no window.

Copies are merged where they are read, before anything is shuffled, so a passage
in a third of all documents is a few rows for each batch of input.  Anchors with
very many different contexts are known from a sample of the rows before anything
is dealt; theirs are dealt by context, and settled window by window.

A row is known by a key of its own, made when the input is first written to the
shared folder; rows may share a doc_id or have none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, text_buffer

#: Bytes of text worked on at once, but for one text that is longer; a worker holds about 100 bytes for each.
BLOCK = 500_000
#: Occurrences that are merged and handed on at once.
MERGED = 200_000
#: Different contexts of one anchor that go to one task; an anchor with more goes window by window.
MAX_CLASSES = 20_000
#: One row in so many is looked at to find such anchors, and so many of them are broadcast at most, the largest.
SAMPLED, MAX_HOT = 64, 100_000
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

# What an occurrence is when it is dealt: itself, a sure repeat, one that stands for copies; of an anchor with very many contexts.
SURE, COPIES, SPREAD = 1, 2, 4
#: Where in a place its parts begin, above the kind: how far before the anchor the last and the first of its windows start, and where it is.
LAST, FIRST, POS = 3, 15, 27
REACH = 4095
# What becomes of an occurrence.
WHOLE, NEED, REFERENCE, HOT = 0, 1, 2, 4


class _Powers:
    def __init__(self, base: int):
        self.base, self.table = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            full = np.full(n, self.base, np.uint64)
            full[0] = 1
            full = np.multiply.accumulate(full)
            if n > 2 * BLOCK:
                return full
            self.table = full
        return self.table[:n]


_UP, _DOWN = _Powers(BASE), _Powers(INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RangeHash:
    """64-bit polynomial hashes of any stretch of a sequence of symbols."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(symbols.astype(np.uint64) + np.uint64(0x51)) * _UP.upto(n), out=self.sums[1:])
        self.down = _DOWN.upto(n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values."""
    n = len(x)
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    padded = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


@dataclass(frozen=True)
class Scheme:
    """Windows of ``window`` symbols, anchors of ``gram``."""

    window: int
    gram: int

    def __post_init__(self):
        if not 0 < self.gram <= self.window <= REACH + self.gram:
            raise ValueError("anchors must fit into windows, and windows into places")

    @property
    def reach(self) -> int:
        """How far before an anchor a window that chooses it can start."""
        return self.window - self.gram

    @property
    def half(self) -> int:
        """A window that chooses an anchor goes on for so many symbols before or after it."""
        return (self.reach + 1) // 2

    def choose(self, hashed: RangeHash, bounds: np.ndarray, rank: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Places of chosen k-grams, the documents they are in, and the first and last starts of windows that choose them.

        ``bounds`` cuts symbols into documents.
        """
        total = int(bounds[-1])
        if total < self.window:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        grams = hashed.grams(self.gram)
        order = (grams >> np.uint64(32)) << np.uint64(32)
        if rank is not None:
            order = (rank[: len(grams)].astype(np.uint64) << np.uint64(56)) | ((order >> np.uint64(8)) & np.uint64(0x00FFFFFF00000000))
        least = sliding_min(order | np.arange(len(grams), dtype=np.uint64), self.reach + 1)
        left = np.repeat(bounds[1:], np.diff(bounds))[: len(least)] - np.arange(len(least))
        start = np.flatnonzero(left >= self.window)
        chosen = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # of equal k-grams the first is chosen, so choices never go back within a document
        head = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]])) if len(chosen) else np.zeros(0, np.int64)
        at = chosen[head]
        return at, np.searchsorted(bounds, at, "right") - 1, start[head], start[np.append(head[1:], len(start)) - 1] if len(head) else head


def blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of stretches of rows with about ``BLOCK`` bytes."""
    data, offsets = text_buffer(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


#: Symbols of a block: (values, bounds of documents in symbols, rank of each k-gram or None).
Symbols = Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray | None]]


def _half(hashed: RangeHash, start: np.ndarray, end: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """32 bits of the hashes of stretches, never 0; 0 for those that pass their document's ends."""
    out = np.zeros(len(start), np.uint64)
    out[inside] = (hashed(start[inside], end[inside]) >> np.uint64(32)) | np.uint64(1)
    return out


def _found(data: np.ndarray, offsets: np.ndarray, scheme: Scheme, symbols: Symbols) -> tuple[np.ndarray, ...] | None:
    """anchor, context, halves, document and packed place of the anchors of a block."""
    values, bounds, rank = symbols(data, offsets, scheme.gram)
    hashed = RangeHash(values)
    at, d, first, last = scheme.choose(hashed, bounds, rank)
    if not len(at):
        return None
    low, high, most, least = bounds[d], bounds[d + 1], at - first, at - last
    anchor = mix(hashed(at, at + scheme.gram)).view(np.int64)
    ctx = mix(hashed(first, last + scheme.window) + most.astype(np.uint64)).view(np.int64)
    # a half counts only if some window of its own has all of it
    before = _half(hashed, at - scheme.half, at + scheme.gram, (at - scheme.half >= low) & (most >= scheme.half))
    after = _half(hashed, at, at + scheme.gram + scheme.half, (at + scheme.gram + scheme.half <= high) & (least < scheme.half))
    return anchor, ctx, ((before << np.uint64(32)) | after).view(np.int64), d, ((at - low) << POS) | (most << FIRST) | (least << LAST)


def occurrences(rows: DataFrame, scheme: Scheme, symbols: Symbols, ordered: bool, hot: np.ndarray) -> DataFrame:
    """(key, ctx, halves, doc, row, at): anchors, contexts and places; copies within a batch are settled here.

    ``rows`` has row, doc (a long) and text.  ``at`` holds place, windows and kind.  Sure
    repeats are dealt by a scattered key, the occurrences of ``hot`` anchors by
    their contexts, others by their anchors.  ``ordered``: only what repeats a
    smaller doc counts; otherwise doc is 0.
    """
    shared = rows.sparkSession.sparkContext.broadcast(np.sort(hot))

    def merge(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        anchor, ctx, halves, doc, row, pos = (np.concatenate(x) for x in zip(*parts))
        known = shared.value
        spread = known[np.minimum(np.searchsorted(known, anchor), len(known) - 1)] == anchor if len(known) else np.zeros(len(anchor), bool)
        anchor = np.where(spread, mix(ctx.view(np.uint64) ^ np.uint64(BASE)).view(np.int64), anchor)
        sort = np.lexsort((pos, row, doc, ctx, anchor))
        anchor, ctx, halves, doc, row, pos, spread = (x[sort] for x in (anchor, ctx, halves, doc, row, pos, spread))
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (ctx[1:] != ctx[:-1])])
        start = np.flatnonzero(new)
        cls, size = np.cumsum(new) - 1, np.diff(np.append(start, len(new)))
        sure = doc > doc[start][cls] if ordered else size[cls] > 1
        key = np.where(sure, mix(row.view(np.uint64) * np.uint64(31) + pos.view(np.uint64)).view(np.int64), anchor)
        columns = [key, ctx, halves, doc, row, pos | np.where(sure, SURE, 0) | np.where(spread, SPREAD, 0)]
        if not ordered:
            rep = start[size > 1]
            stands = [anchor[rep], ctx[rep], halves[rep], doc[rep], row[rep], pos[rep] | COPIES | np.where(spread[rep], SPREAD, 0)]
            columns = [np.concatenate(x) for x in zip(columns, stands)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["key", "ctx", "halves", "doc", "row", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            row_of, doc_of = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, data, offsets in blocks(batch.column(2)):
                found = _found(data, offsets, scheme, symbols)
                if found is None:
                    continue
                anchor, ctx, halves, d, pos = found
                parts.append((anchor, ctx, halves, doc_of[first + d], row_of[first + d], pos))
                held += len(pos)
                if held >= MERGED:
                    yield merge(parts)
                    parts, held = [], 0
        if parts:
            yield merge(parts)

    return rows.select("row", "doc", "text").mapInArrow(run, "key bigint, ctx bigint, halves bigint, doc bigint, row bigint, at bigint")


def hot_anchors(rows: DataFrame, scheme: Scheme, symbols: Symbols, max_classes: int, sampled: int) -> np.ndarray:
    """Anchors with more than about ``max_classes`` different contexts, by those in one row of ``sampled``.

    How an anchor is dealt depends on it, not what is found.
    """
    some = occurrences(rows.where(F.pmod(F.xxhash64("row"), F.lit(sampled)) == 0), scheme, symbols, False, np.zeros(0, np.int64))
    counts = some.where(F.col("at").bitwiseAND(F.lit(SURE)) == 0).groupBy("key", "ctx").agg(F.lit(1)).groupBy("key").count()
    most = counts.where(F.col("count") > max_classes / sampled).orderBy(F.desc("count"), "key").limit(MAX_HOT)
    return np.array([r["key"] for r in most.collect()], np.int64)


def _shared_halves(group: np.ndarray, halves: np.ndarray) -> np.ndarray:
    """Which classes have a half in common with another of their group."""
    out = np.zeros(len(group), bool)
    for half in (halves.view(np.uint64) >> np.uint64(32), halves.view(np.uint64) & np.uint64(0xFFFFFFFF)):
        sort = np.lexsort((half, group))
        same = (group[sort][1:] == group[sort][:-1]) & (half[sort][1:] == half[sort][:-1]) & (half[sort][1:] > 0)
        out[sort[1:][same]] = True
        out[sort[:-1][same]] = True
    return out


def settle(found: DataFrame, ordered: bool) -> DataFrame:
    """(anchor, row, doc, at, role) of all occurrences that repeat something or may do so."""

    def decide(key: np.ndarray, ctx: np.ndarray, halves: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        sure = at & SURE > 0
        out = [(key[sure], row[sure], doc[sure], at[sure], np.full(sure.sum(), WHOLE))]
        key, ctx, halves, doc, row, at = (x[~sure] for x in (key, ctx, halves, doc, row, at))
        if len(key):
            sort = np.lexsort((at, row, doc, ctx, key))
            key, ctx, halves, doc, row, at = (x[sort] for x in (key, ctx, halves, doc, row, at))
            new_key = np.concatenate([[True], key[1:] != key[:-1]])
            new = new_key | np.concatenate([[True], ctx[1:] != ctx[:-1]])
            start = np.flatnonzero(new)
            cls, group = np.cumsum(new) - 1, np.cumsum(new_key) - 1
            spread = at & SPREAD > 0
            hot = np.where(spread, HOT, 0)
            closer = _shared_halves(group[start], halves[start])[cls] | spread
            role = np.full(len(key), -1)
            if ordered:
                own = doc[start][cls]
                least = np.minimum.reduceat(doc, np.flatnonzero(new_key))[group]
                role[doc > own] = WHOLE
                rest = closer & (doc == own)
                role[rest] = np.where((own[rest] > least[rest]) | spread[rest], NEED, REFERENCE) | hot[rest]
                picked = np.flatnonzero(role >= 0)
            else:
                copies = at & COPIES > 0
                weight = np.bincount(cls) + np.bincount(cls, copies).astype(np.int64)
                repeats = weight[cls] > 1
                role[repeats & ~copies] = WHOLE
                role[closer & ~repeats] = NEED | hot[closer & ~repeats]
                picked = np.flatnonzero(role >= 0)
                rep = start[closer[start] & (weight > 1)]
                out.append((key[rep], row[rep], doc[rep], at[rep], REFERENCE | hot[rep]))
            out.append((key[picked], row[picked], doc[picked], at[picked], role[picked]))
        columns = [np.concatenate(c) for c in zip(*out)]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.int32())], ["anchor", "row", "doc", "at", "role"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(6)]
            key = columns[0]
            cut = int(np.searchsorted(key, key[-1], "left"))
            if held and (cut or held[-1][0][-1] != key[0]):
                yield decide(*(np.concatenate(x) for x in zip(*held, [x[:cut] for x in columns])))
                held = []
            elif cut:
                yield decide(*(x[:cut] for x in columns))
            held.append([x[cut:] for x in columns])
        if held:
            yield decide(*(np.concatenate(x) for x in zip(*held)))

    return found.repartition("key").sortWithinPartitions("key").mapInArrow(run, "anchor bigint, row bigint, doc bigint, at bigint, role int")


def contexts(rows: DataFrame, reps: DataFrame, scheme: Scheme, symbols: Symbols) -> DataFrame:
    """(anchor, doc, row, start, role, data): the symbols around each occurrence, as 64-bit or 8-bit values."""
    places = reps.groupBy("row").agg(F.collect_list(F.struct("anchor", "at", "role")).alias("places"))
    joined = rows.join(places, "row").select("row", "doc", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_of, doc_of, lists = batch.column(0), batch.column(1), batch.column(3)
            ends = lists.offsets.to_numpy()
            anchor, at, role = (lists.values.field(i).to_numpy() for i in range(3))
            for first, data, offsets in blocks(batch.column(2)):
                values, bounds, _ = symbols(data, offsets, scheme.gram)
                values = values if values.dtype == np.uint64 else values.astype(np.uint8)
                last = first + len(bounds) - 1
                own = slice(ends[first], ends[last])
                d = np.repeat(np.arange(len(bounds) - 1), np.diff(ends[first : last + 1]))
                low, p = bounds[d], bounds[d] + (at[own] >> POS)
                a, b = p - (at[own] >> FIRST & REACH), p - (at[own] >> LAST & REACH) + scheme.window
                pieces = [values[i:j].tobytes() for i, j in zip(a.tolist(), b.tolist())]
                taken = pa.array(first + d, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[own], pa.int64()), doc_of.take(taken), row_of.take(taken), pa.array(a - low, pa.int64()), pa.array(role[own], pa.int32()), pa.array(pieces, pa.binary())],
                    ["anchor", "doc", "row", "start", "role", "data"],
                )

    return joined.mapInArrow(run, "anchor bigint, doc bigint, row bigint, start bigint, role int, data binary")


#: Of contexts' docs, rows, starts, roles and data: the numbers of contexts and the window starts, counted in the row, that are repeated.
Shard = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]], tuple[np.ndarray, np.ndarray]]


def shards(ctx: DataFrame, scheme: Scheme, work: Shard, size: int) -> DataFrame:
    """(row, s, e): repeated stretches that ``work`` finds among whole anchors, ``size`` bytes of contexts at a time."""

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        _, doc, row, start, role, data = zip(*rows)
        doc, row, start, role = (np.array(x, np.int64) for x in (doc, row, start, role))
        which, at = work(doc, row, start, role, list(data))
        if not len(which):
            return None
        sort = np.lexsort((at, which))
        which, at = which[sort], at[sort]
        new = np.concatenate([[True], (which[1:] != which[:-1]) | (at[1:] > at[:-1] + scheme.window)])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(at)) - 1
        return pa.RecordBatch.from_arrays([pa.array(row[which[head]]), pa.array(at[head], pa.int64()), pa.array(at[tail] + scheme.window, pa.int64())], ["row", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held >= size and row[0] != last:
                    if (out := solve(rows)) is not None:
                        yield out
                    rows, held = [], 0
                rows.append(row)
                held, last = held + len(row[5]), row[0]
        if rows and (out := solve(rows)) is not None:
            yield out

    return ctx.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "row bigint, s bigint, e bigint")


def by_windows(ctx: DataFrame, scheme: Scheme, ordered: bool) -> DataFrame:
    """As ``shards``, for anchors with very many different contexts: a row for each window, grouped by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row, start = (batch.column(i).to_numpy() for i in (1, 2, 3))
            parts, held = [], 0
            for i, data in enumerate(batch.column(5)):
                grams = RangeHash(np.frombuffer(data.as_py(), np.uint64 if ordered else np.uint8)).grams(scheme.window)
                n = len(grams)
                parts.append((grams.view(np.int64), np.full(n, doc[i]), np.full(n, row[i]), start[i] + np.arange(n)))
                held += n
                if held >= MERGED or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*parts)], ["w", "doc", "row", "s"])
                    parts, held = [], 0

    windows = ctx.mapInArrow(run, "w bigint, doc bigint, row bigint, s bigint")
    place = F.struct("doc", "row", "s")
    seen = windows.groupBy("w").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    if ordered:
        seen = seen.where(F.col("first.doc") < F.col("last.doc")).select("w", F.col("first.doc").alias("least"))
        hit = windows.join(seen, "w").where(F.col("doc") > F.col("least"))
    else:
        hit = windows.join(seen.where(F.col("first") < F.col("last")).select("w"), "w")
    return hit.select("row", "s", (F.col("s") + scheme.window).alias("e"))


def repeated(rows: DataFrame, scheme: Scheme, symbols: Symbols, work: Shard, *, ordered: bool, shard: int, max_classes: int = MAX_CLASSES, sampled: int = SAMPLED) -> DataFrame:
    """(row, starts, ends): for rows with repeats, stretches that may overlap or pass the row's ends."""
    hot = hot_anchors(rows, scheme, symbols, max_classes, sampled)
    roles = materialize(settle(occurrences(rows, scheme, symbols, ordered, hot), ordered), "roles")
    ctx = materialize(contexts(rows, roles.where(F.col("role") > WHOLE), scheme, symbols), "contexts")
    closer = shards(ctx.where(F.col("role") < HOT), scheme, work, shard)
    if len(hot):
        closer = closer.union(by_windows(ctx.where(F.col("role") >= HOT), scheme, ordered))
    closer = materialize(closer, "closer")
    release(ctx)
    part = lambda shift: F.shiftright("at", shift).bitwiseAND(F.lit(REACH))
    place = F.shiftright("at", POS)
    whole = roles.where(F.col("role") == WHOLE).select("row", (place - part(FIRST)).alias("s"), (place - part(LAST) + scheme.window).alias("e"))
    spans = materialize(whole.union(closer).groupBy("row").agg(F.collect_list("s").alias("starts"), F.collect_list("e").alias("ends")), "spans")
    release(roles, closer)
    return spans


def merged(starts: np.ndarray, ends: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Maximal runs of stretches, within 0 and n."""
    if not len(starts):
        return []
    sort = np.argsort(starts, kind="stable")
    s, e = np.maximum(starts[sort], 0), np.maximum.accumulate(np.minimum(ends[sort], n))
    head = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    return list(zip(s[head].tolist(), e[np.append(head[1:], len(s)) - 1].tolist()))


def runs_of(starts: pa.Array, ends: pa.Array) -> Callable[[int, int], list[tuple[int, int]]]:
    """Of the columns of stretches of a batch: a function from a row's number and its length to ``merged`` runs."""
    cuts, valid = starts.offsets.to_numpy(), starts.is_valid().to_numpy(zero_copy_only=False)
    s, e = starts.values.to_numpy(), ends.values.to_numpy()
    other = ends.offsets.to_numpy()

    def runs(i: int, n: int) -> list[tuple[int, int]]:
        return merged(s[cuts[i] : cuts[i + 1]], e[other[i] : other[i + 1]], n) if valid[i] else []

    return runs
