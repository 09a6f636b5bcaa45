"""Operator 1: near-duplicate embeddings by randomly rotated binary codes.

A unit vector is rotated at random and kept as its signs, one packed bit a
dimension, with two stored factors.  Codes and factors are made once for each
different vector and go with it from then on.  A pair is settled in three steps:

* ``limit``, the number of signs in which a vector can differ from any that is
  near enough: where signs differ, the rotated vectors are apart by at least this
  vector's coordinate, and the squares of its smallest coordinates soon add up to
  more than the distance that the threshold allows.  The bits of a pair are
  compared (exclusive or, population count) with the smaller of both limits.
* ``factor``, the inner product of a vector and its code, by which the inner product
  with another vector is estimated from the code without bias; the pair's upper
  bound on it has to reach the threshold.
* What is left is computed exactly, in double precision.

Both bounds hold for sure and not with high probability, so no link is lost.

Vectors of a label are dealt to cells around pivots; a vector also visits each
cell whose boundary is within reach of the threshold, so no link is missed.
Cells are compared in blocks of bounded size.  A block gives a count for each
vector and links that connect what it found linked, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, require
from .components import Forest, components

#: Vectors in a block; a task compares two blocks.
BLOCK = 2048
#: Pivots of all labels together, at most, and their bytes: fixed bounds on what is broadcast.
MAX_PIVOTS, MAX_PIVOT_BYTES = 4096, 32_000_000
PER_CELL = 4096
#: Rows of one block that are compared with all of the other at once.
SLAB = 256


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix; a worker makes it once."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs (in whole 64-bit words), factors and limits of rows of length one."""
    n, dim = unit.shape
    rotated = unit @ rotation(dim).T
    bits = np.zeros((n, -(-dim // 64) * 64), bool)
    bits[:, :dim] = rotated >= 0
    factor = np.abs(rotated).sum(1) / math.sqrt(dim)
    # the most signs that can differ within the distance of the threshold; a little more for rounding
    reach = 2 - 2 * threshold + 1e-9
    limit = (np.cumsum(np.sort(rotated * rotated, 1), 1) <= reach).sum(1)
    return np.packbits(bits, axis=1).view(np.uint64), factor, limit


def near_codes(codes: np.ndarray, limit: np.ndarray, other: np.ndarray, other_limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows whose codes differ in no more bits than either's limit, a slab of rows at a time."""
    for at in range(0, len(codes), SLAB):
        rows = slice(at, at + SLAB)
        apart = np.zeros((len(codes[rows]), len(other)), np.uint16)
        for w in range(codes.shape[1]):
            apart += np.bitwise_count(codes[rows, w, None] ^ other[None, :, w])
        a, b = np.nonzero(apart <= np.minimum(limit[rows, None], other_limit[None, :]))
        yield a + at, b


def may_reach(q: np.ndarray, codes: np.ndarray, factor: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the upper bound on the inner products of vectors (unit, rotated) with coded ones reaches the threshold, row by row.

    <q, v> = (<q, code> - <q, rest of code>) / factor: the estimate <q, code> / factor
    is unbiased under a random rotation.  With c = <q, v>, the rest of the code has
    length sqrt(1 - factor^2) and is orthogonal to v, so its product with q is at
    most that times sqrt(1 - c^2).  A pair at the threshold or above is thus within
    that bound, at c the threshold, of its estimate.
    """
    dim = q.shape[1]
    signs = np.unpackbits(codes.view(np.uint8).reshape(len(codes), -1), axis=1)[:, :dim]
    estimate = (2 * np.einsum("ij,ij->i", q, signs) - q.sum(1)) / math.sqrt(dim) / factor
    error = np.sqrt(np.maximum(0.0, 1 - factor**2) * max(0.0, 1 - threshold * threshold)) / factor
    return estimate + error + 1e-9 >= threshold


class Block:
    """Some vectors of one length, with what is stored of them."""

    def __init__(self, vectors: np.ndarray, codes: np.ndarray, factor: np.ndarray, limit: np.ndarray):
        self.vectors, self.codes, self.factor, self.limit = vectors, codes, factor, limit
        self.norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))

    def rotated(self, rows: np.ndarray) -> np.ndarray:
        return (self.vectors[rows] / self.norm[rows, None]) @ rotation(self.vectors.shape[1]).T


def link_blocks(x: Block, y: Block | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y) with cosine of at least ``threshold``; y None: pairs of x, first below second."""
    within, y = y is None, y or x
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a, b in near_codes(x.codes, x.limit, y.codes, y.limit):
        if within:
            a, b = a[a < b], b[a < b]
        for at in range(0, len(a), 20_000):
            i, j = a[at : at + 20_000], b[at : at + 20_000]
            rows, place = np.unique(i, return_inverse=True)
            may = may_reach(x.rotated(rows)[place], y.codes[j], y.factor[j], threshold)
            i, j = i[may], j[may]
            linked = np.einsum("ij,ij->i", x.vectors[i], y.vectors[j]) / (x.norm[i] * y.norm[j]) >= threshold
            found.append((i[linked], j[linked]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _coded(rows: DataFrame, threshold: float) -> DataFrame:
    """(vec_id, label, digest, vector, code, factor, most) of (vec_id, label, embedding): null from digest on where a vector links with nothing.

    Vectors are scaled by their largest component, as doubles in bytes, so that
    their length neither overflows nor vanishes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            n, offsets = batch.num_rows, lists.offsets.to_numpy()
            flat = lists.values
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64) if len(flat) else np.zeros(0)
            sizes, known = np.diff(offsets), lists.is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            out: list[list] = [[None] * n for _ in range(5)]
            for size in np.unique(sizes[known & (sizes > 0)]).tolist():
                at = np.flatnonzero(known & (sizes == size))
                found = values[offsets[at][:, None] + np.arange(size)]
                largest = np.abs(found).max(1)
                ok = np.isfinite(largest) & (largest > 0)
                at, found = at[ok], found[ok] / largest[ok, None]
                if not len(at):
                    continue
                codes, factor, limit = encode(found / np.sqrt(np.einsum("ij,ij->i", found, found))[:, None], threshold)
                for k, i in enumerate(at.tolist()):
                    data = (found[k] + 0.0).tobytes()
                    out[0][i], out[1][i], out[2][i] = blake2b(data, digest_size=16).digest(), data, codes[k].tobytes()
                    out[3][i], out[4][i] = float(factor[k]), int(limit[k])
            types = (pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(out, types))], ["vec_id", "label", "digest", "vector", "code", "factor", "most"])

    return rows.mapInArrow(run, "vec_id bigint, label string, digest binary, vector binary, code binary, factor double, most int")


def _unit(data: bytes) -> np.ndarray:
    v = np.frombuffer(data, np.float64)
    return v / np.sqrt(v @ v)


def _cells(vectors: DataFrame, threshold: float) -> DataFrame:
    """``vectors`` with cell and home: each vector in its own cell and as a visitor of those in reach."""
    sizes = {r["label"]: r["count"] for r in vectors.groupBy("label").count().where(F.col("count") > PER_CELL).orderBy(F.desc("count")).limit(MAX_PIVOTS // 2).collect()}
    pivots: dict[str, list[np.ndarray]] = {}
    if sizes:
        widest = vectors.agg(F.max(F.length("vector"))).first()[0]
        most = max(1, min(MAX_PIVOTS, MAX_PIVOT_BYTES // widest))
        share = min(1.0, most / sum(math.ceil(n / PER_CELL) for n in sizes.values()))
        wanted = {label: max(1, int(math.ceil(n / PER_CELL) * share)) for label, n in sizes.items()}
        # a few more than are wanted of each label by their hash, the first of those taken
        rate = F.create_map(*[F.lit(x) for label, n in sizes.items() for x in (label, min(1.0, 4.0 * wanted[label] / n + 20.0 / n))])
        drawn = vectors.where(F.col("label").isin(list(wanted)) & (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.try_element_at(rate, "label") * (1 << 20)))
        for r in drawn.select("label", "vector", F.xxhash64("id").alias("h")).orderBy("h").limit(2 * most).collect():
            own = pivots.setdefault(r["label"], [])
            if len(own) < wanted[r["label"]] and (not own or 8 * len(own[0]) == len(r["vector"])):
                own.append(_unit(bytes(r["vector"])))
    radius = math.sqrt(2 - 2 * threshold) + 1e-6
    shared = vectors.sparkSession.sparkContext.broadcast({k: np.array(v) for k, v in pivots.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cells, homes = [], [], []
            for i, (label, data) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist())):
                own = shared.value.get(label)
                if own is None or own.shape[1] * 8 != len(data):
                    rows.append(i), cells.append(0), homes.append(True)
                    continue
                dots = own @ _unit(data)
                home = int(np.argmax(dots))
                rows.append(i), cells.append(home), homes.append(True)
                # distance to the plane between two pivots; of two cells, the later is visited
                gap = np.linalg.norm(own - own[home], axis=1)
                near = np.flatnonzero((dots[home] - dots <= radius * gap) & (np.arange(len(own)) > home))
                rows += [i] * len(near)
                cells += near.tolist()
                homes += [False] * len(near)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cells, pa.int32()), pa.array(homes, pa.bool_())], [*batch.schema.names, "cell", "home"])

    schema = vectors.select("label", "id", "copies", "vector", "code", "factor", "most").schema
    return vectors.select(*schema.names).mapInArrow(run, schema.add("cell", T.IntegerType()).add("home", T.BooleanType()))


def _compare(threshold: float):
    """Of one task's vectors: a row for each that is linked, with a link that connects it and its count."""

    def block(group: pa.Table, rows: np.ndarray) -> Block:
        some = group.take(pa.array(rows))
        vectors, codes = (b"".join(some.column(c).to_pylist()) for c in ("vector", "code"))
        return Block(np.frombuffer(vectors, np.float64).reshape(len(rows), -1), np.frombuffer(codes, np.uint64).reshape(len(rows), -1), some.column("factor").to_numpy(), some.column("most").to_numpy())

    def run(group: pa.Table) -> pa.Table:
        side, ids, copies = (group.column(c).to_numpy() for c in ("side", "id", "copies"))
        sizes = np.array([len(x) for x in group.column("vector").to_pylist()])
        counts, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
        whole = group.column("within")[0].as_py()
        for size in np.unique(sizes):
            x, y = np.flatnonzero((sizes == size) & (side == 0)), np.flatnonzero((sizes == size) & (side == 1))
            if not len(x) or not whole and not len(y):
                continue
            a, b = link_blocks(block(group, x), None if whole else block(group, y), threshold)
            a, b = x[a], x[b] if whole else y[b]
            counts += (np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))).astype(np.int64)
            forest.join(a, b)
        own, root = np.flatnonzero(counts), forest.roots()
        return pa.table({"a": pa.array(ids[own], pa.int64()), "b": pa.array(ids[root[own]], pa.int64()), "n": pa.array(counts[own], pa.int64())})

    return run


def _links(vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): links that connect what is linked, and parts of the numbers of other vectors linked with a."""
    cells = materialize(_cells(vectors, threshold), "cells")
    sizes = cells.groupBy("label", "cell").agg(*[F.ceil(F.sum((F.col("home") == own).cast("int")) / BLOCK).cast("int").alias(name) for own, name in ((True, "hb"), (False, "vb"))])
    part = cells.join(sizes, ["label", "cell"]).withColumn("c", F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("hb")).otherwise(F.col("vb"))).cast("int"))

    def blocks(n: str, make) -> Column:
        # sequence(0, -1) runs backwards, so an empty one is filtered
        return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0))), lambda k: k < F.col(n)), make)

    def task(visit: bool, i, j, side) -> Column:
        return F.struct(F.lit(visit).alias("visit"), i.alias("i"), j.alias("j"), side.alias("side"))

    c = F.col("c")
    at_home = F.concat(
        blocks("hb", lambda k: task(False, F.least(k, c), F.greatest(k, c), F.when(k >= c, 0).otherwise(1))),
        blocks("vb", lambda k: task(True, c, k, F.lit(0))),
    )
    own = ("id", "copies", "vector", "code", "factor", "most")
    dealt = part.select("label", "cell", *own, F.explode(F.when(F.col("home"), at_home).otherwise(blocks("hb", lambda k: task(True, k, c, F.lit(1))))).alias("t"))
    dealt = dealt.select("label", "cell", "t.*", *own, (~F.col("t.visit") & (F.col("t.i") == F.col("t.j"))).alias("within"))
    return dealt.groupBy("label", "cell", "visit", "i", "j").applyInArrow(_compare(threshold), "a bigint, b bigint, n bigint")


def embedding_classes(embeddings: DataFrame, *, threshold: float = 0.98) -> DataFrame:
    """Near-duplicate classes of the vectors of each label.

    ``embeddings`` has vec_id (an integer), embedding (array of numbers) and label
    (of any plain type); further columns are ignored, whatever their names.
    Vectors with equal, non-null labels whose cosine, in double precision, is
    ``threshold`` or more are linked, one just at it too.  Returns a row for each
    row: vec_id, n_links (other vectors linked directly), component_id (smallest
    vec_id reachable), kept (vec_id is component_id).  Vectors that are null, empty
    or zero, hold nulls or non-finite numbers, or have no label or vec_id, are
    linked with nothing (without a vec_id: component_id null, kept); nor are vectors
    of different lengths with each other.  Vectors that are equal but for a factor
    are merged first; rows that share a vec_id are one node.  An empty table gives
    an empty one.
    """
    require(embeddings, "vec_id", "embedding", "label")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    coded = materialize(_coded(rows, threshold), "coded")
    classes = coded.where(F.col("digest").isNotNull()).groupBy("label", "digest", "vector", "code", "factor", "most")
    classes = materialize(classes.agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")), "vectors")
    links = materialize(_links(classes, threshold), "links")
    counts = links.groupBy("a").agg(F.sum("n").alias("n"))
    found = components(links.select("a", "b"))
    known = classes.select("label", "digest", "id", "copies").join(counts, F.col("id") == F.col("a"), "left").join(found, F.col("id") == F.col("node"), "left")
    known = materialize(known.select("label", "digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "known")
    joined = coded.select("vec_id", "label", "digest").join(known, ["label", "digest"], "left")
    out = joined.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
