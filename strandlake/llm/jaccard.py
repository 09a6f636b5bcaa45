"""Links between texts whose shingle sets have a Jaccard similarity of a threshold or more.

Equal sets are merged first.  Then SimHash fingerprints within a few bits, found by
their tables of distances to reference fingerprints (``hamming``), propose pairs,
and MinHash bands propose those that fingerprints are too far apart for.  Pairs of
bands whose signatures agree in far fewer places than the threshold lets expect go no
further; in either case a link is made only where the two sets themselves, compared in
whole, reach the threshold.  As components are asked for, a text that fingerprints
did not connect is compared with the first text that it shares a bucket with.  Pairs of
buckets that are not connected by then are no rows: a bucket gives the few that connect
all members with such pairs, and what they connect is dealt once, and compared as a whole
in one task.  What is too large for a task is dealt in chunks, and there only texts outside
its largest component meet all others.  A task gives a link for each text at most; no pair is left out.

Texts are sifted where they are (``sieve``), so only those that are compared are
dealt; joins that move texts or signatures are of one kind at any size.

A text is known by the unique key of its row, so rows may share an id or have none.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, texts
from .components import Forest, components
from .hamming import hamming_links, whole_groups, with_tables
from .sieve import sieve

#: Thirty bands of five: a pair at 0.8 shares none with a chance of (1 - 0.8 ** 5) ** 30 = 7e-6.
BANDS, ROWS = 30, 5
#: Members of a center that one task compares; a center of more is sent to several.
DEALT = 256
#: Texts, and shingles of them, in a chunk; a task compares two chunks at most (or a text and a chunk, where it has more shingles).
CHUNK, SHINGLES = 1024, 1_000_000
#: Members of a bucket that signatures are compared of; all of a larger one are taken to be fitting.
LARGE = 4096
#: Pairs, and columns of a matrix, that are counted at once.
PAIRS, COLUMNS = 1_000_000, 4096
SIGMAS = 6

_R = np.random.default_rng(42)
_XOR = _R.integers(0, 2**64, BANDS * ROWS, np.uint64)
_ODD = _R.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
_FOLD = _R.integers(0, 2**64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def band_keys(found: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A key for each band of the set's min-hashes, and a byte of each of them; sets that agree in a band have its key in common."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 2048):
        least = np.minimum(least, ((found[at : at + 2048, None] ^ _XOR) * _ODD).min(0))
    mixed = least ^ (least >> np.uint64(31))
    keys = ((mixed.reshape(BANDS, ROWS) * _FOLD).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
    return keys, mixed.astype(np.uint8).tobytes()


def least_agreement(similarity: float) -> int:
    """Places in which signatures of sets at ``similarity`` agree, less six standard deviations: one pair in 10^9 agrees in fewer."""
    n = BANDS * ROWS
    return int(n * similarity - SIGMAS * (n * similarity * (1 - similarity)) ** 0.5)


def reaches(a: np.ndarray, b: np.ndarray, least: Fraction) -> bool:
    """Whether two sets (sorted, without repeats) have a Jaccard similarity of ``least`` or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * least.denominator >= (len(a) + len(b) - both) * least.numerator


def shingle_sets(rows: DataFrame, hashes, fold) -> DataFrame:
    """(row, id, code, n, keys, sig, print) of (row, id, text): digest and size of the set of ``hashes(text)``, its band keys and signature; ``fold`` of the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashes(t) for t in texts(batch.column(2))]
            sets = [np.unique(h) for h in found]
            keys, sigs = zip(*[band_keys(s) if len(s) else (np.zeros(0, np.int64), b"") for s in sets]) if sets else ((), ())
            codes = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            made = [pa.array(codes, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), pa.array([fold(h) for h in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], ["row", "id", "code", "n", "keys", "sig", "print"])

    return rows.select("row", "id", "text").mapInArrow(run, "row bigint, id bigint, code binary, n bigint, keys array<bigint>, sig binary, print binary")


def fingerprint_pairs(nodes: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b) of (node, print): each node with the first of its fingerprint, and that with the first that fingerprints within ``limit`` bits lead to."""
    distinct = materialize(with_tables(nodes.groupBy(F.col("print").alias("code")).agg(F.min("node").alias("id"))), "codes")
    same = nodes.join(distinct.select(F.col("code").alias("print"), F.col("id").alias("a")), "print").where(F.col("a") != F.col("node"))
    far = hamming_links(distinct, limit).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return same.select("a", F.col("node").alias("b")).unionByName(far).distinct()


def _bounds(key: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))


def _buckets(members: DataFrame) -> DataFrame:
    """Rows (key, node, component) of buckets with members of two components or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            bounds, component = _bounds(table.column("key").to_numpy()), table.column("component").to_numpy()
            keep = np.minimum.reduceat(component, bounds[:-1]) < np.maximum.reduceat(component, bounds[:-1])
            yield from table.select(["key", "node", "component"]).filter(pa.array(np.repeat(keep, np.diff(bounds)))).combine_chunks().to_batches()

    dealt = members.select("key", F.lit(0).alias("part"), "node", "component").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key bigint, node bigint, component bigint")


def _pairs(shared: DataFrame, first: bool, least: Fraction) -> DataFrame:
    """Pairs (a, b) of each bucket's members that may be linked: of other components, fitting sizes and signatures.

    ``first``: those of its first member; else as many as connect all members that any such
    pairs connect, so a bucket never gives more pairs than it has members.
    """
    num, den, agree = least.numerator, least.denominator, least_agreement(float(least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            key, node, n, component = (table.column(c).to_numpy() for c in ("key", "node", "n", "component"))
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(key), -1)
            bounds = _bounds(key)
            left, right = [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if not first and hi - lo > LARGE:
                    left.append(np.full(hi - lo - 1, node[lo]))
                    right.append(node[lo + 1 : hi])
                    continue
                forest, a, b, held = Forest(hi - lo), [], [], 0
                for i in range(lo, lo + 1 if first else hi - 1):
                    later = slice(i + 1, hi)
                    fits = np.minimum(n[later], n[i]) * den >= np.maximum(n[later], n[i]) * num
                    may = i + 1 + np.flatnonzero(fits & (component[later] != component[i]))
                    other = may[(sig[may] == sig[i]).sum(1) >= agree] - lo
                    a.append(np.full(len(other), i - lo))
                    b.append(other)
                    held += len(other)
                    if held > 200_000:
                        forest.join(np.concatenate(a), np.concatenate(b))
                        a, b, held = [], [], 0
                if held:
                    forest.join(np.concatenate(a), np.concatenate(b))
                root = forest.roots()
                own = np.flatnonzero(root != np.arange(hi - lo))
                left.append(node[lo + root[own]])
                right.append(node[lo + own])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (left, right)], ["a", "b"])

    dealt = shared.select("key", F.lit(0).alias("part"), "node", "n", "component", "sig").repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _links(pairs: DataFrame, wanted: DataFrame, hashes, least: Fraction) -> DataFrame:
    """Those pairs (a, b) of nodes, a written table, whose sets reach the threshold; ``wanted`` has node and text."""
    n = pairs.count()
    compared = sieve(pairs.select(F.explode(F.array("a", "b"))), 2 * n)
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / DEALT).alias("chunks"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"))
    centers = dealt.select("a", "chunk", F.lit(-1).cast("long").alias("b"), F.col("a").alias("node")).distinct()
    met = dealt.withColumn("node", F.col("b")).unionByName(centers).join(wanted.where(compared("node")).hint("merge"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            left, right = [], []
            for a, b, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = np.unique(hashes(text or ""))
                if b < 0:
                    own = found
                elif reaches(own, found, least):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return met.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "b").select("a", "b", "text").mapInArrow(run, "a bigint, b bigint")


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two sets (without repeats) have in common."""
    m = len(sets)
    whole = np.concatenate(sets)
    _, place, size = np.unique(whole, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(place, kind="stable")
    owner, starts = owner[order], np.cumsum(size) - size
    both = np.zeros((m, m), np.int32)
    # members of few sets are counted pair by pair of their sets
    few = np.flatnonzero((size > 1) & (size <= max(2, m // 16)))
    for k in np.unique(size[few]).tolist():
        of = few[size[few] == k]
        i, j = np.triu_indices(k, 1)
        step = max(1, PAIRS // len(i))
        for at in range(0, len(of), step):
            held = owner[starts[of[at : at + step], None] + np.arange(k)]
            both += np.bincount((held[:, i] * m + held[:, j]).ravel(), minlength=m * m).reshape(m, m).astype(np.int32)
    # those of many by a product of matrices; owners ascend, so all pairs so far are above the diagonal
    many = np.flatnonzero((size > 1) & (size > max(2, m // 16)))
    for at in range(0, len(many), COLUMNS):
        of = many[at : at + COLUMNS]
        has = np.zeros((m, len(of)), np.float32)
        column = np.repeat(np.arange(len(of)), size[of])
        entry = np.repeat(starts[of] - (np.cumsum(size[of]) - size[of]), size[of]) + np.arange(size[of].sum())
        has[owner[entry], column] = 1
        both += np.triu((has @ has.T).astype(np.int32), 1)
    return both


def set_links(sets: list[np.ndarray], least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the sets (sorted, without repeats) whose Jaccard similarity is ``least`` or more: one for each set that isn't the first of its component."""
    if len(sets) == 2:
        found = np.arange(int(reaches(*sets, least)))
        return found, found + 1
    size, both = np.array([len(s) for s in sets]), common(sets)
    forest = Forest(len(sets))
    for i in range(len(sets) - 1):
        shared = both[i, i + 1 :].astype(np.int64)
        j = i + 1 + np.flatnonzero(shared * least.denominator >= (size[i] + size[i + 1 :] - shared) * least.numerator)
        forest.join(np.full(len(j), i), j)
    root = forest.roots()
    own = np.flatnonzero(root != np.arange(len(sets)))
    return root[own], own


def _groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(key, part, node), written: the texts that ``pairs``, a written table, connect, by the tasks that compare them.

    A group is what pairs connect, or where that is large, a bucket of ``members``.  The
    largest component in it needs no comparing with itself: chunks of the others meet one
    another and the chunks of that one, two chunks in a task.
    """
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    joined = materialize(components(pairs).withColumnRenamed("component", "group"), "joined")
    known = ends.join(joined, "node", "left").withColumn("group", F.coalesce("group", "node"))
    large = known.groupBy("group").count().where(F.col("count") > BANDS * CHUNK).select("group", F.lit(True).alias("large"))
    named = members.join(known.join(large, "group", "left"), "node").withColumn("key", F.when(F.col("large"), F.col("key")).otherwise(F.col("group")))
    rows = materialize(named.groupBy("key", "node").agg(F.first("component").alias("component"), F.first("n").alias("n")), "grouped")
    each = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
    total = each.groupBy("key").agg(F.max(F.struct("rows", "n", "component")).alias("most"), F.sum("rows").alias("rows"), F.sum("n").alias("n"))
    chunks = lambda count, n: F.greatest(F.lit(1), F.ceil(count / CHUNK), F.ceil(n / SHINGLES)).cast("int")
    sizes = total.where(F.col("most.rows") < F.col("rows")).select("key", F.col("most.component").alias("main"), chunks(F.col("rows") - F.col("most.rows"), F.col("n") - F.col("most.n")).alias("others"), chunks(F.col("most.rows"), F.col("most.n")).alias("own"))
    dealt = rows.join(sizes, "key").withColumn("in_main", F.col("component") == F.col("main")).withColumn("all", F.col("others") + F.col("own"))
    own = F.when(F.col("in_main"), F.col("others") + F.pmod(F.xxhash64("node"), F.col("own"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others"))).cast("int")
    met = F.filter(F.sequence(F.lit(0), F.when(F.col("in_main"), F.col("others")).otherwise(F.col("all")) - 1), lambda k: k != F.col("chunk"))
    parts = F.transform(met, lambda k: F.least(k, F.col("chunk")) * F.col("all").cast("long") + F.greatest(k, F.col("chunk")))
    groups = materialize(dealt.withColumn("chunk", own).select("key", F.explode(parts).alias("part"), "node"), "groups")
    release(joined, rows)
    return groups


def _group_links(groups: DataFrame, wanted: DataFrame, hashes, least: Fraction) -> DataFrame:
    """Links (a, b) that connect the texts of each part of ``groups``, a written table, whose sets reach the threshold."""
    compared = sieve(groups.select("node").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 1):
            key, part, node = (table.column(c).to_numpy() for c in ("key", "part", "node"))
            bounds = np.append(np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])), len(key))
            left, right = [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if hi - lo > 1:
                    a, b = set_links([np.unique(hashes(t)) for t in texts(table.column("text").slice(lo, hi - lo))], least)
                    left.append(node[lo + a])
                    right.append(node[lo + b])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (left, right)], ["a", "b"])

    met = groups.join(wanted.where(compared("node")).hint("merge"), "node").select("key", "part", "node", "text")
    return met.repartition("key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(run, "a bigint, b bigint")


def representatives(rows: DataFrame, hashes, fold, similarity: float, limit: int = 2) -> DataFrame:
    """(row): of each class of (row, id, text) the row with the least id, or where none has one, or several, the least row.

    A set is that of ``hashes(text)``; rows are of one class that have equal sets or
    are connected by sets whose Jaccard similarity is ``similarity`` or more.
    ``fold`` makes a fingerprint of the hashes; those within ``limit`` bits are tried first.
    """
    least = Fraction(similarity).limit_denominator(10**6)
    coded = materialize(shingle_sets(rows, hashes, fold), "sets")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row", "n", "keys", "sig", "print")
    merged = coded.groupBy("code").agg(F.min(order).alias("first"))
    nodes = materialize(merged.select(F.col("first.row").alias("node"), *[f"first.{c}" for c in ("none", "id", "n", "keys", "sig", "print")]), "nodes")
    release(coded)
    alone = nodes.select(F.explode("keys").alias("key"), "node", F.col("node").alias("component"))
    met = materialize(_buckets(alone), "met")
    pairs = materialize(fingerprint_pairs(nodes.select("node", "print"), limit), "pairs")
    # only texts that are proposed anywhere need their signatures and words there
    proposed = sieve(met.select("node").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("node"))).distinct())
    signed = materialize(nodes.select("node", "n", "sig").where(proposed("node")), "signed")
    wanted = materialize(rows.select(F.col("row").alias("node"), "text").where(proposed("node")), "wanted")

    links = materialize(_links(pairs, wanted, hashes, least), "links")
    release(pairs)
    found = materialize(components(links), "found")
    for first in (True, False):
        # buckets whose members are of two components or more
        before, now = met, met.select("key", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        met = materialize(_buckets(now), "open")
        release(before)
        if met.isEmpty():
            break
        shared = met.join(signed.hint("merge"), "node")
        pairs = _pairs(shared, first, least)
        pairs = materialize(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b") if first else pairs.distinct(), "pairs")
        if first:
            made = _links(pairs, wanted, hashes, least)
        else:
            groups = _groups(pairs, shared.select("key", "node", "component", "n"))
            made = _group_links(groups, wanted, hashes, least)
        links = links.unionByName(materialize(made, "links"))
        release(pairs)
        if not first:
            release(groups)
        found = materialize(components(links), "found")
    release(wanted, signed)
    classes = nodes.join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("component"))
    return materialize(classes.agg(F.min(F.struct("none", "id", "node")).alias("first")).select(F.col("first.node").alias("row")), "first")
