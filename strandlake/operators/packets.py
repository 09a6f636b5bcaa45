"""Files as fixed-size packets and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.convert import indexes


def packetize(files: DataFrame, size: int, *, key: str = "file_id", content: str = "content") -> DataFrame:
    """(key, packet_id, data): packets of ``size`` bytes, the last one filled up with zeros.  An empty file has none."""
    n = F.ceil(F.octet_length(content) / F.lit(size))
    piece = F.posexplode(F.transform(indexes(n), lambda i: F.substr(F.col(content), i * size + 1, F.lit(size)))).alias("packet_id", "data")
    return files.select(key, piece).withColumn("data", F.expr(f"rpad(data, {size}, X'00')"))


def packet_count(n_bytes: Column, size: int) -> Column:
    return F.ceil(n_bytes / F.lit(size)).cast("bigint")


def last_packet_size(n_bytes: Column, size: int) -> Column:
    return F.when(n_bytes > 0, (n_bytes - 1) % size + 1).otherwise(0).cast("bigint")


def missing_packets(sizes: DataFrame, packets: DataFrame, size: int, *, key: str = "file_id") -> DataFrame:
    """(key, packet_id) that a file of known n_bytes lacks."""
    wanted = sizes.select(key, F.explode(indexes(packet_count(F.col("n_bytes"), size))).alias("packet_id"))
    return wanted.join(packets.select(key, "packet_id"), [key, "packet_id"], "left_anti")


def reassemble(sizes: DataFrame, packets: DataFrame, size: int, *, key: str = "file_id", fill_missing: bool = False) -> DataFrame:
    """(key, content, complete): packets in order, cut to n_bytes; those out of range are ignored.

    A missing packet is left out, or zeros with ``fill_missing``.
    """
    wanted = sizes.select(key, "n_bytes", F.explode_outer(indexes(packet_count(F.col("n_bytes"), size))).alias("packet_id"))
    # equal keys for both: a file's packets meet once, in the join, and are not dealt again for the aggregate
    whole = wanted.join(packets.select(key, "packet_id", F.expr(f"substring(data, 1, {size})").alias("data")), [key, "packet_id"], "left")
    part = F.struct("packet_id", (F.coalesce("data", F.expr(f"rpad(X'', {size}, X'00')")) if fill_missing else F.col("data")).alias("data"))
    joined = whole.groupBy(key).agg(F.first("n_bytes").alias("n_bytes"), F.array_sort(F.collect_list(part)).alias("parts"), F.count_if(F.col("data").isNull() & F.col("packet_id").isNotNull()).alias("gaps"))
    content = F.unhex(F.concat_ws("", F.transform("parts", lambda p: F.hex(p["data"]))))
    return joined.select(key, F.substr(content, F.lit(1), F.col("n_bytes").cast("int")).alias("content"), (F.col("gaps") == 0).alias("complete"))
