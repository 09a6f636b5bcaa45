"""Sequencing channel: how often each strand is read, and what goes wrong in a read.

Every draw is a function of ids, so a channel gives the same reads in any
partitioning and on any retry.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.convert import indexes
from ..functions.gf import crc8_table
from ..functions.rng import RANGE, grid, threshold, u32
from ..functions.strand import at, reverse_complement


def poisson_cdf(mean: float, tail: float = 1e-9) -> list[float]:
    p = total = math.exp(-mean)
    out, k = [total], 0
    while total < 1 - tail and k < 10_000:
        k += 1
        p *= mean / k
        total += p
        out.append(total)
    return out


def negative_binomial_cdf(mean: float, variance: float, tail: float = 1e-9) -> list[float]:
    """Of the distribution with this mean and (larger) variance."""
    if variance <= mean:
        raise ValueError("the variance must exceed the mean")
    r, p = mean * mean / (variance - mean), mean / variance
    q = total = p**r
    out, k = [total], 0
    while total < 1 - tail and k < 100_000:
        q *= (k + r) / (k + 1) * (1 - p)
        k += 1
        total += q
        out.append(total)
    return out


def draw_count(cdf: list[float], draw: Column) -> Column:
    """The first k whose cumulative probability exceeds the draw; integer steps, so no float decides."""
    steps = F.array(*[F.lit(int(c * RANGE)) for c in cdf])
    return F.size(F.filter(steps, lambda s: s <= draw)).cast("bigint")


def bernoulli_count(draw: Column, p: float, n: int) -> Column:
    return F.when(draw < threshold(p), n).otherwise(0).cast("bigint")


def replicate(pool: DataFrame, count: Column, *, id_column: str = "id", flip_seed: int | None = None) -> DataFrame:
    """A row for each read with copy_no; half of the reads reversed and complemented if a seed is given."""
    reads = pool.withColumn("copy_no", F.explode(indexes(count)))
    if flip_seed is None:
        return reads.withColumn("is_reversed", F.lit(False))
    flip = u32(flip_seed, "flip", F.col(id_column), F.col("copy_no")) % 2 == 1
    return reads.withColumn("is_reversed", flip).withColumn("dna", F.when(F.col("is_reversed"), reverse_complement(F.col("dna"))).otherwise(F.col("dna")))


def mutate(dna: Column, limit: Column | int, seed: int, *ids: Column, rates: Column | None = None) -> Column:
    """Substitute, delete or insert before each base with a chance of limit / 2^32, one kind in three each.

    ``rates`` gives a limit for each place instead.
    """

    def change(i: Column) -> Column:
        b = at(dna, i)
        hit = u32(seed, "site", *ids, i) < (F.coalesce(F.try_element_at(rates, i + 1), F.lit(0)) if rates is not None else limit)
        kind, base = u32(seed, "site", *ids, i, lane=1) % 3, u32(seed, "site", *ids, i, lane=2)
        other = F.substr(F.replace(F.lit("ACGT"), b, F.lit("")), (base % 3).cast("int") + 1, F.lit(1))
        extra = F.substr(F.lit("ACGT"), (base % 4).cast("int") + 1, F.lit(1))
        return F.when(~hit, b).when(kind == 0, other).when(kind == 1, "").otherwise(F.concat(extra, b))

    return F.concat_ws("", F.transform(indexes(F.length(dna)), change))


def substitute_only(dna: Column, limit: int, seed: int, *ids: Column) -> Column:
    """Substitutions alone: the next base in ACGT order after a drawn step."""

    def change(i: Column) -> Column:
        b = at(dna, i)
        step = (u32(seed, "sub", *ids, i, lane=1) % 3 + 1).cast("int")
        other = F.substr(F.lit("ACGTACGT"), F.instr(F.lit("ACGT"), b) + step, F.lit(1))
        return F.when(u32(seed, "sub", *ids, i) < limit, other).otherwise(b)

    return F.concat_ws("", F.transform(indexes(F.length(dna)), change))


def substitute_digits(digits: np.ndarray, limit: int, seed: int, ids: list[int | None]) -> np.ndarray:
    """``substitute_only`` on strands of one length as rows of digits 0 to 3, with the same draws."""
    draw, step = grid(seed, "sub", ids, digits.shape[1], (0, 1))
    return np.where(draw < limit, (digits + (step % 3 + 1).astype(digits.dtype)) % 4, digits)


def _crc8(rows: np.ndarray) -> np.ndarray:
    table, out = crc8_table().astype(np.uint8), np.zeros(len(rows), np.uint8)
    for column in rows.T:
        out = table[out ^ column]
    return out


#: Strands that are stored and read at once.
STRANDS = 4096


def store_and_read(files: DataFrame, size: int, limit: int, seed: int) -> DataFrame:
    """(doc_id, strands, passed, wrong_bytes) of (doc_id, data): ``size``-byte strands with a checksum, in base 4, after substitutions.

    A strand's id is doc_id * 100000 and its number; it passes if its checksum does.
    A strand goes through all steps in the task that has its file, so only counts are
    dealt.  Files without bytes have no strands and no row.
    """
    shifts = np.array([0, 2, 4, 6], np.uint8)

    def some(data: np.ndarray, ids: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
        coded = np.concatenate([data, _crc8(data)[:, None]], 1)
        digits = (coded[:, :, None] >> shifts & 3).reshape(len(coded), -1)
        noisy = substitute_digits(digits, limit, seed, ids).reshape(len(coded), -1, 4)
        got = (noisy << shifts).sum(2, dtype=np.uint8)
        return _crc8(got) == 0, (got[:, :size] != data).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(i, x, n) for i, x in zip(*(c.to_pylist() for c in batch.columns)) if x and (n := -(-len(x) // size))]
            if not kept:
                continue
            data = np.frombuffer(b"".join(x.ljust(n * size, b"\0") for _, x, n in kept), np.uint8).reshape(-1, size)
            ids = [None if i is None else i * 100_000 + k for i, _, n in kept for k in range(n)]
            parts = [some(data[at : at + STRANDS], ids[at : at + STRANDS]) for at in range(0, len(data), STRANDS)]
            ok, wrong = (np.concatenate(x) for x in zip(*parts))
            counts = np.array([n for _, _, n in kept])
            first = np.cumsum(counts) - counts
            found = [counts, np.add.reduceat(ok.astype(np.int64), first), np.add.reduceat(np.where(ok, wrong, 0), first)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in kept], pa.int64()), *(pa.array(x, pa.int64()) for x in found)], names)

    names = ["doc_id", "strands", "passed", "wrong_bytes"]
    counted = files.select(F.col("doc_id").cast("bigint").alias("doc_id"), "data").mapInArrow(run, ", ".join(f"{n} bigint" for n in names))
    return counted.groupBy("doc_id").agg(*[F.sum(n).alias(n) for n in names[1:]])


def apply_pattern(dna: Column, start: Column, pattern: str) -> Column:
    """A burst of I, D and R at consecutive places from ``start``."""
    n = len(pattern)

    def change(i: Column) -> Column:
        b = at(dna, i)
        op = F.substr(F.lit(pattern), i - start + 1, F.lit(1))
        inside = (i >= start) & (i < start + n)
        return F.when(~inside, b).when(op == "D", "").when(op == "R", F.translate(b, "ACGT", "CGTA")).otherwise(F.concat(F.translate(b, "ACGT", "GTAC"), b))

    return F.concat_ws("", F.transform(indexes(F.length(dna)), change))


def kmer_channel(dna: Column, k: int, seed: int, *ids: Column) -> Column:
    """Error chances that follow from the k-mer before a base: twice the rate inside runs, half elsewhere."""

    def change(i: Column) -> Column:
        b = at(dna, i)
        context = F.substr(dna, F.greatest(i - k + 2, F.lit(1)), F.least(i + 1, F.lit(k)))
        limit = F.when(context.rlike(r"(.)\1\1"), threshold(0.10)).otherwise(threshold(0.025))
        kind = u32(seed, "kmer", *ids, i, lane=1) % 2
        return F.when(u32(seed, "kmer", *ids, i) >= limit, b).when(kind == 0, "").otherwise(F.translate(b, "ACGT", "GTAC"))

    return F.concat_ws("", F.transform(indexes(F.length(dna)), change))


def downsample(df: DataFrame, share: float, seed: int, *ids: str) -> DataFrame:
    """Without a share of the rows: ceil((1 - share) * n) stay, those with the least draws; the same rows in every partitioning.

    The draw that the last of them has is found by counting draws in ever smaller
    ranges, so no row is ranked against all others in one place.
    """
    drawn = df.withColumn("_draw", u32(seed, "down", *[F.col(i) for i in ids]))
    total = drawn.count()
    wanted, low, width = math.ceil(round((1 - share) * total, 9)), 0, RANGE
    before = 0
    while width > 1:
        step = max(1, width // 256)
        counts = {r["s"]: r["n"] for r in drawn.where((F.col("_draw") >= low) & (F.col("_draw") < low + width)).groupBy(F.floor((F.col("_draw") - low) / step).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
        if before + sum(counts.values()) <= wanted:
            return drawn.where(F.col("_draw") < low + width).drop("_draw")
        for s in sorted(counts):
            if before + counts[s] > wanted:
                low, width = low + s * step, step
                break
            before += counts[s]
    # rows of one draw, a few at most: by their ids
    tied = drawn.where(F.col("_draw") == low).orderBy(*ids).limit(wanted - before)
    return drawn.where(F.col("_draw") < low).unionByName(tied).drop("_draw")


def simulations(coded: DataFrame, n: int) -> DataFrame:
    """``coded`` once for each simulation, with its number."""
    return coded.withColumn("sim", F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(n)])))


def split_counts(pool: DataFrame, count: str, share: float, seed: int, *ids: str) -> DataFrame:
    """``pool`` of strands with a count of reads, with clean and faulty: each read is faulty by its own draw; no row a read is made."""
    hit = F.filter(indexes(F.col(count)), lambda k: u32(seed, "pick", *[F.col(i) for i in ids], k) < threshold(share))
    return pool.withColumn("faulty", F.size(hit).cast("bigint")).withColumn("clean", (F.col(count) - F.col("faulty")).cast("bigint"))


def _least_draws(n: Column, k: int, seed: int, stream: str, *ids: Column) -> Column:
    """The ``k`` places of [0, n) with the least draws."""
    ranked = F.array_sort(F.transform(indexes(n), lambda i: F.struct(u32(seed, stream, *ids, i).alias("u"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda p: p["i"])


def mutate_at_distance(dna: Column, distance: int, seed: int, *ids: Column) -> Column:
    """Exactly ``distance`` substitutions (or as many as there are bases), at the places with the least draws."""
    # bound as variables: named in the inner function, strand and places would be made anew for each base
    strand = F.transform(F.array(dna), lambda d: F.struct(d.alias("d"), _least_draws(F.length(d), distance, seed, "place", *ids).alias("places")))
    new = lambda s: F.concat_ws("", F.transform(indexes(F.length(s["d"])), lambda i: F.when(F.array_contains(s["places"], i), F.translate(at(s["d"], i), "ACGT", "CGTA")).otherwise(at(s["d"], i))))
    return F.element_at(F.transform(strand, new), 1)


def mutate_same_length(dna: Column, seed: int, *ids: Column) -> Column:
    """One base deleted and one inserted far from it, so that two edits are the least and the length stays.

    The base goes from a place in the first third and comes in the last third; it
    is inserted next to a base of another kind than the one that went would shift
    there.  Strands of fewer than twelve bases have two substitutions instead.
    """
    n = F.length(dna)
    third = F.floor(n / 3).cast("int")
    gone = (u32(seed, "gone", *ids) % F.greatest(third, F.lit(1))).cast("int")
    come = (n - 1 - u32(seed, "come", *ids) % F.greatest(third, F.lit(1))).cast("int")
    shifted = F.concat(F.substr(dna, F.lit(1), gone), F.substr(dna, gone + 2, come - gone), F.translate(at(dna, come), "ACGT", "GTAC"), F.substr(dna, come + 2, n))
    # a stretch of like bases shifts onto itself: where that leaves fewer than two edits, substitute
    plain = mutate_at_distance(dna, 2, seed, *ids)
    return F.when((n >= 12) & (F.levenshtein(dna, shifted) == 2), shifted).otherwise(plain)


def replay(records: DataFrame, mapping: DataFrame, library: DataFrame) -> DataFrame:
    """Reads of an experiment with the strand each came from: record to index, index to strand."""
    return records.join(mapping, "record_id").join(library, "index")


#: Distributions of read counts by name: options to the cumulative probabilities that ``draw_count`` takes.
DISTRIBUTIONS = {"poisson": poisson_cdf, "negative_binomial": negative_binomial_cdf}
#: Channels by name: (dna, seed, ids, options) to a strand with faults.
CHANNELS = {
    "fixed_rate": lambda dna, seed, ids, rate=0.01: mutate(dna, threshold(rate), seed, *ids),
    "substitutions": lambda dna, seed, ids, rate=0.01: substitute_only(dna, threshold(rate), seed, *ids),
    "rates": lambda dna, seed, ids, rates=(): mutate(dna, 0, seed, *ids, rates=F.array(*[F.lit(threshold(r)) for r in rates]).cast("array<bigint>")),
    "pattern": lambda dna, seed, ids, pattern="D": apply_pattern(dna, (u32(seed, "start", *ids) % F.greatest(F.length(dna), F.lit(1))).cast("int"), pattern),
    "kmer": lambda dna, seed, ids, k=6: kmer_channel(dna, k, seed, *ids),
}


def open_distribution(name: str, draw: Column, **options) -> Column:
    """How often a strand is read, by the name of a distribution."""
    if name == "bernoulli":
        return bernoulli_count(draw, options["p"], options["n"])
    if name not in DISTRIBUTIONS:
        raise ValueError(f"unknown distribution {name}; known: bernoulli, {', '.join(DISTRIBUTIONS)}")
    return draw_count(DISTRIBUTIONS[name](**options), draw)


def open_channel(name: str, dna: Column, seed: int, *ids: Column, **options) -> Column:
    """A strand after a channel, by the channel's name."""
    if name not in CHANNELS:
        raise ValueError(f"unknown channel {name}; known: {', '.join(CHANNELS)}")
    return CHANNELS[name](dna, seed, ids, **options)


def channel_names() -> dict[str, list[str]]:
    return {"channels": sorted(CHANNELS), "distributions": sorted([*DISTRIBUTIONS, "bernoulli"])}
