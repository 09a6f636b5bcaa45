"""Which rows may have one of a set of keys, told where the rows are.

A Bloom filter of the keys spares rows without them a shuffle.  It lets through all
that have one and few others, more the fuller it is, so an exact join follows
wherever others would matter: no result depends on its size, which is bounded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for a key, and of a whole filter at most (8 MB).
EACH, MOST = 16, 1 << 26
HASHES = 3


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    h = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    step = (h >> np.uint64(31)) | np.uint64(1)
    return (h[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(bits - 1)


def sieve(keys: DataFrame, most: int | None = None) -> Callable[[str], Column]:
    """A condition on a column of longs: true for every key of ``keys`` (one column), and for few others; ``most`` keys or fewer, if known."""
    spark = keys.sparkSession
    n = keys.count() if most is None else most
    bits = min(MOST, 1 << max(16, (EACH * n - 1).bit_length()))

    def run(batches):
        for batch in batches:
            place = np.unique(_places(batch.column(0).to_numpy(), bits))
            if len(place):
                word = (place >> np.uint64(6)).astype(np.int64)
                starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                held = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), starts)
                yield pa.RecordBatch.from_arrays([pa.array(word[starts]), pa.array(held.view(np.int64))], ["word", "held"])

    made = keys.mapInArrow(run, "word bigint, held bigint").groupBy("word").agg(F.bit_or("held").alias("held")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[made.column("word").to_numpy()] = made.column("held").to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast(words)

    @F.arrow_udf("boolean")
    def may(column: pa.Array) -> pa.Array:
        place = _places(column.to_numpy(zero_copy_only=False), bits)
        return pa.array(((sent.value[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).all(1))

    return lambda column: may(F.col(column))
