"""Connected components over link tables, without driver-side state.

A round first joins what each partition can join by itself, then makes a
large-star and a small-star step over all: each joins every node with the smallest
of its neighbours, so chains shorten by a constant factor a round and no step
makes more rows than there are links.  Once no more links are left than one task
may hold, one executor task joins them all.  Rounds are cut by tables in the
shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: Links that a partition holds before it joins them.
HELD = 1_000_000
#: Links that are left to one task at most: 8 MB.
FEW = 500_000


class Forest:
    """Union-find over the rows 0 to n - 1; a root is the least member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            nxt = self.up[self.up]
            if (nxt == self.up).all():
                return self.up
            self.up = nxt

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Connect a[i] with b[i]."""
        while len(a):
            r = self.roots()
            x, y = r[a], r[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of links that are not the least of their component, and that least node."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(nodes))
    forest.join(place[: len(a)], place[len(a) :])
    root = forest.roots()
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _local(edges: DataFrame) -> DataFrame:
    """(u, v): the links of each partition, as links to the least node that they reach there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            held += batch.num_rows
            if held >= HELD:
                parts = [least_reachable(*(np.concatenate(x) for x in zip(*parts)))]
                held = 0
        if parts:
            u, v = least_reachable(*(np.concatenate(x) for x in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u bigint, v bigint")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u > v).  large: neighbours above a node move to its least neighbour; small: those below it do."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b) that are not their own: the smallest node reachable.

    Links may come in either order, repeat, or join a node with itself; a link with
    a null end is none.  No links give no rows.  Nodes that no row is given for are
    components by themselves, or the smallest of one.
    """
    edges, state = links.where(F.col("a") != F.col("b")).select(F.col("a").alias("u"), F.col("b").alias("v")), None
    for k in range(max_rounds):
        # what a partition has of links is joined where it is; from then on links are dealt by node
        before, edges = edges, materialize(_local(edges.repartition("u") if k else edges), "local")
        if k:
            release(before)
        if edges.count() <= few:
            before, edges = edges, materialize(_local(edges.coalesce(1)), "few")
            release(before)
            break
        before, edges = edges, materialize(_star(_star(edges, True), False), "stars")
        release(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
