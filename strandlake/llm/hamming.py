"""Links between 64-bit fingerprints within a Hamming distance, by pivot distance tables.

Every distinct fingerprint gets a table, made once and kept with it: its distances
to many reference fingerprints.  By the triangle inequality two fingerprints
within ``limit`` bits have tables that differ by ``limit`` at most in every
coordinate.  Pairs are formed only among those whose first coordinates are near
enough, by a range search; a pair goes on while no coordinate differs by more;
survivors are verified bit by bit.

Who meets whom is settled by the pigeonhole principle: of ``limit + 2`` blocks of
bits, fingerprints within the limit agree in two at least, so they share one of
the buckets made of two blocks, and no link is missed.  (References alone would
not do for that: a random pair passes one with a chance of a third, and cells of
their distances would have to overlap.)
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize
from .components import Forest

#: Reference fingerprints, drawn once and for all.
REFERENCES = 32
#: Rows of a bucket that one task takes; larger buckets are dealt as pairs of chunks.
CHUNK = 4096
#: Large buckets that are broadcast with their sizes; more are joined by a shuffle.
BROADCAST_BUCKETS = 100_000
#: Pairs that are formed at once.
PAIRS = 1_000_000


def references() -> np.ndarray:
    return np.random.default_rng(64).integers(0, 2**64, REFERENCES, np.uint64)


def distance_table(codes: np.ndarray) -> np.ndarray:
    """Hamming distances of each code to each reference: (n, ``REFERENCES``) bytes."""
    return np.bitwise_count(codes[:, None] ^ references()[None, :]).astype(np.uint8)


def with_tables(codes: DataFrame) -> DataFrame:
    """(code, id) with a column ``distances``: a code's distances to all references."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = distance_table(_words(batch.column(0)))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in found], pa.binary())], ["code", "id", "distances"])

    return map_arrow(codes.select("code", "id"), run, "code binary, id bigint, distances binary")


def bucket_keys(limit: int) -> Column:
    """The buckets of column code: a key for each two of ``limit + 2`` blocks of its bits."""
    word = F.conv(F.hex("code"), 16, -10).cast("long")
    edges = [64 * k // (limit + 2) for k in range(limit + 3)]
    keys = []
    for k, (i, j) in enumerate(combinations(range(limit + 2), 2)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in (i, j))
        keys.append(F.xxhash64(F.lit(k), word.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.array(*keys)


def _words(codes) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_pylist()), ">u8").astype(np.uint64)


def near_pairs(group: np.ndarray, codes: np.ndarray, tables: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group (numbers from 0 on) whose codes are within ``limit`` bits."""
    first = group.astype(np.int64) * 256 + tables[:, 0]
    order = np.argsort(first, kind="stable")
    first = first[order]
    later = np.searchsorted(first, first + limit, "right") - np.arange(len(first)) - 1
    ends = np.cumsum(later)
    at, n = 0, len(first)
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        own = np.repeat(np.arange(at, stop), later[at:stop])
        step = np.arange(len(own)) - np.repeat(ends[at:stop] - later[at:stop] - (ends[at - 1] if at else 0), later[at:stop])
        a, b = order[own], order[own + step + 1]
        for k in range(1, tables.shape[1]):
            if not len(a):
                break
            near = np.abs(tables[a, k].astype(np.int16) - tables[b, k]) <= limit
            a, b = a[near], b[near]
        close = np.bitwise_count(codes[a] ^ codes[b]) <= limit
        yield a[close], b[close]
        at = stop


def whole_groups(batches: Iterator[pa.RecordBatch], size: int = 40_000) -> Iterator[pa.Table]:
    """Tables of whole buckets from rows sorted by (key, part)."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < size:
            continue
        table = pa.Table.from_batches(held)
        key, part = table.column("key").to_numpy(), table.column("part").to_numpy()
        same = (key == key[-1]) & (part == part[-1])
        cut = len(key) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
        held, rows = table.slice(cut).to_batches(), len(key) - cut
    if rows:
        yield pa.Table.from_batches(held)


def hamming_links(codes: DataFrame, limit: int) -> DataFrame:
    """Links (a, b) that connect the ids of fingerprints within ``limit`` bits.

    ``codes`` has code (binary, 8 bytes, distinct), id (long) and distances.  A bucket
    above ``CHUNK`` rows is dealt as all pairs of its chunks, whose tasks hold twice
    ``CHUNK`` rows at most.  A task gives a link for each row that isn't the first
    of its component.
    """
    members = codes.select(F.explode(bucket_keys(limit)).alias("key"), "id", "code", "distances").where(F.col("id").isNotNull())
    # Only large buckets need a number of chunks, so members are dealt once and not joined with all sizes.
    counts = codes.where(F.col("id").isNotNull()).select(F.explode(bucket_keys(limit)).alias("key")).groupBy("key").count()
    large = materialize(counts.where(F.col("count") > CHUNK).select("key", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")), "large")
    known = F.broadcast(large) if large.count() <= BROADCAST_BUCKETS else large
    dealt = members.join(known, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    # pair (i, j), i <= j, is part i * chunks + j; a lone chunk is part 0
    parts = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: (F.col("chunks") == 1) | (j != F.col("chunk"))),
            lambda j: F.least(j, F.col("chunk")) * F.col("chunks") + F.greatest(j, F.col("chunk")),
        )
    )
    spread = dealt.select("key", F.explode(parts).alias("part"), "id", "code", "distances")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            key, part, ids = (table.column(c).to_numpy() for c in ("key", "part", "id"))
            group = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
            # a bucket of one row pairs with nothing
            size = np.bincount(group)[group]
            rows = np.flatnonzero(size > 1)
            if not len(rows):
                continue
            few = table.select(["code", "distances"]).take(pa.array(rows))
            found = _words(few.column("code"))
            tables = np.frombuffer(b"".join(few.column("distances").to_pylist()), np.uint8).reshape(len(rows), -1)
            forest = Forest(len(rows))
            for a, b in near_pairs(group[rows], found, tables, limit):
                forest.join(a, b)
            root = forest.roots()
            own = np.flatnonzero(root != np.arange(len(rows)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows[own]], pa.int64()), pa.array(ids[rows[root[own]]], pa.int64())], ["a", "b"])

    return spread.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(run, "a bigint, b bigint")
