"""Outer code: index layout, dense grids for gaps, parity strands across sub-packets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rs
from ..functions.convert import indexes


@dataclass(frozen=True)
class Layout:
    """Sizes of one packet: bytes a packet, bytes a strand, data and parity sub-packets."""

    packet_bytes: int
    strand_bytes: int
    data: int
    parity: int = 0

    @property
    def strands(self) -> int:
        return math.ceil(self.packet_bytes / self.strand_bytes)

    @property
    def slots(self) -> int:
        """Strands in a sub-packet."""
        return math.ceil(self.strands / self.data)

    @property
    def total(self) -> int:
        return self.data + self.parity

    def index_bits(self, packets: int) -> list[int]:
        """Width of packet, sub-packet and slot numbers."""
        return [math.ceil(math.log2(n)) if n > 1 else 0 for n in (packets, self.total, self.slots)]


def strandize(packets: DataFrame, layout: Layout, key: list[str]) -> DataFrame:
    """(key, strand, sub, slot, data): strands of a packet with their place, the last filled up with zeros."""
    size = layout.strand_bytes
    piece = F.posexplode(F.transform(indexes(layout.strands), lambda i: F.substr(F.col("data"), i * size + 1, F.lit(size)))).alias("strand", "data")
    rows = packets.select(*key, piece).withColumn("data", F.expr(f"rpad(data, {size}, X'00')"))
    return rows.select(*key, "strand", (F.col("strand") / layout.slots).cast("int").alias("sub"), (F.col("strand") % layout.slots).alias("slot"), "data")


def fill_gaps(keys: DataFrame, strands: DataFrame, layout: Layout, key: list[str]) -> DataFrame:
    """All places of each key: what there is, zeros where only padding belongs, null where a strand is lost."""
    grid = keys.select(*key, F.explode(indexes(layout.total * layout.slots)).alias("place"))
    grid = grid.select(*key, (F.col("place") / layout.slots).cast("int").alias("sub"), (F.col("place") % layout.slots).alias("slot"))
    zero = (F.col("sub") < layout.data) & (F.col("sub") * layout.slots + F.col("slot") >= layout.strands)
    joined = grid.join(strands.select(*key, "sub", "slot", "data"), [*key, "sub", "slot"], "left")
    return joined.withColumn("is_zero", zero).withColumn("data", F.when(zero, F.expr(f"rpad(X'', {layout.strand_bytes}, X'00')")).otherwise(F.col("data")))


def is_parity(sub: Column, layout: Layout) -> Column:
    return sub >= layout.data


def is_valid(sub: Column, slot: Column, layout: Layout) -> Column:
    return sub.between(0, layout.total - 1) & slot.between(0, layout.slots - 1)


#: Packets that are worked on at once.
PACKETS = 1024


def _bounds(columns: list[pa.Array], rows: int) -> np.ndarray:
    """Where runs of equal rows begin, and the number of rows."""
    new = np.zeros(rows, bool)
    new[:1] = True
    for column in columns:
        code = column.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.append(np.flatnonzero(new), rows)


def _binary(data: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """Rows of bytes as binary values."""
    n, width = data.shape
    found = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(np.ascontiguousarray(data).tobytes())])
    found = found.cast(pa.binary())
    return found if null is None or not null.any() else pc.if_else(pa.array(~null), found, None)


def _fields(df: DataFrame, key: list[str]) -> str:
    return "".join(f"`{c}` {t}, " for c, t in df.select(*key).dtypes)


def _packed(strands: DataFrame, layout: Layout, key: list[str]) -> DataFrame:
    """(key, subs, slots, there, data): a row for each run of strands of one packet, so that few rows are dealt; ``there`` is 0 for a null."""
    size, n = layout.strand_bytes, len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = _bounds(batch.columns[:n], batch.num_rows)
            sub, slot = (batch.column(n + i).to_numpy(zero_copy_only=False).astype(np.int32) for i in range(2))
            data = batch.column(n + 2)
            there = data.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
            whole = b"".join(b"\0" * size if x is None else x if len(x) == size else x.ljust(size, b"\0")[:size] for x in data.to_pylist())
            parts = [[buffer[w * i : w * j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())] for buffer, w in ((sub.tobytes(), 4), (slot.tobytes(), 4), (there.tobytes(), 1), (whole, size))]
            first = pa.array(at[:-1])
            yield pa.RecordBatch.from_arrays([*(c.take(first) for c in batch.columns[:n]), *(pa.array(x, pa.binary()) for x in parts)], [*key, "subs", "slots", "there", "data"])

    typed = strands.select(*key, F.col("sub").cast("int").alias("sub"), F.col("slot").cast("int").alias("slot"), "data")
    return typed.mapInArrow(run, _fields(strands, key) + "subs binary, slots binary, there binary, data binary")


def _by_packet(packed: DataFrame, layout: Layout, key: list[str], work, schema: str, wanted: bool = False) -> DataFrame:
    """``work(words, lost, slot)`` of all packets' slots, to arrays of the columns after the key, as many rows for each slot.

    ``words`` are (slots, sub-packets, bytes).  ``wanted`` packets are those that have a
    row without subs, and have all slots of the layout; else a packet has those that came.
    """
    size, n, names = layout.strand_bytes, len(key), [x.split()[0] for x in schema.split(", ")]

    def some(table: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = np.repeat(np.arange(len(at) - 1), np.diff(at))
        subs, slots, there, data = (table.column(n + i).to_pylist() for i in range(4))
        if wanted:
            asked = np.zeros(len(at) - 1, bool)
            asked[group[[x is None for x in subs]]] = True
        came = [x is not None for x in subs]
        counts = np.array([len(x) for x, c in zip(there, came) if c], np.int64)
        of = np.repeat(group[came], counts)
        sub, slot = (np.frombuffer(b"".join(x for x in column if x is not None), np.int32) for column in (subs, slots))
        here = np.frombuffer(b"".join(x for x in there if x is not None), np.uint8).astype(bool)
        body = np.frombuffer(b"".join(x for x in data if x is not None), np.uint8).reshape(-1, size)
        if wanted:
            own = np.flatnonzero(asked)
            place = np.full(len(at) - 1, -1)
            place[own] = np.arange(len(own))
            fits = (place[of] >= 0) & (slot >= 0) & (slot < layout.slots)
            of, sub, slot, here, body = of[fits], sub[fits], slot[fits], here[fits], body[fits]
            row = place[of] * layout.slots + slot
            packet, number = np.repeat(own, layout.slots), np.tile(np.arange(layout.slots), len(own))
        else:
            pairs, row = np.unique(of * (1 << 32) + (slot.astype(np.int64) + (1 << 31)), return_inverse=True)
            packet, number = pairs >> 32, (pairs & 0xFFFFFFFF) - (1 << 31)
        words, lost = np.zeros((len(packet), layout.total, size), np.uint8), np.ones((len(packet), layout.total), bool)
        good = here & (sub >= 0) & (sub < layout.total)
        words[row[good], sub[good]] = body[good]
        lost[row[good], sub[good]] = False
        if not len(packet):
            return
        found = work(words, lost, number)
        each = len(found[0]) // len(packet)
        first = pa.array(np.repeat(at[packet], each))
        yield from pa.table([*(table.column(i).take(first) for i in range(n)), *found], [*key, *names]).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < PACKETS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            at = _bounds([table.column(i).combine_chunks() for i in range(n)], table.num_rows)
            # the last packet may go on in the next batch
            for i in range(0, len(at) - 2, PACKETS):
                part = at[i : min(i + PACKETS, len(at) - 2) + 1]
                yield from some(table.slice(part[0], part[-1] - part[0]), part - part[0])
            held = table.slice(at[-2]).to_batches()
        if held and (table := pa.Table.from_batches(held).combine_chunks()).num_rows:
            at = _bounds([table.column(i).combine_chunks() for i in range(n)], table.num_rows)
            for i in range(0, len(at) - 1, PACKETS):
                part = at[i : i + PACKETS + 1]
                yield from some(table.slice(part[0], part[-1] - part[0]), part - part[0])

    return packed.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, _fields(packed, key) + schema)


def _words(words: np.ndarray) -> np.ndarray:
    """Code words, a row for each byte of each slot."""
    return words.transpose(0, 2, 1).reshape(-1, words.shape[1])


def add_parity(strands: DataFrame, layout: Layout, key: list[str]) -> DataFrame:
    """(key, sub, slot, data) with parity sub-packets: each byte column of a slot is a code word across sub-packets."""

    def work(words: np.ndarray, lost: np.ndarray, slot: np.ndarray) -> list[pa.Array]:
        full = words
        if layout.parity:
            coded = rs.encode(_words(words[:, : layout.data]), layout.parity).astype(np.uint8)
            full = coded.reshape(len(words), layout.strand_bytes, layout.total).transpose(0, 2, 1)
        return _numbered(slot, layout.total) + [_binary(full.reshape(-1, layout.strand_bytes))]

    return _by_packet(_packed(strands, layout, key), layout, key, work, "sub int, slot int, data binary")


def _by_row(packets: DataFrame, layout: Layout, key: list[str], width: int, work, schema: str, each: int = 1) -> DataFrame:
    """``work`` of the bytes of whole packets, (packets, width) with zeros for what a packet lacks, to columns of ``each`` rows a packet; a narrow map."""
    n, names = len(key), [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACKETS):
                part = batch.slice(at, PACKETS)
                data = b"".join((x or b"").ljust(width, b"\0")[:width] for x in part.column(n).to_pylist())
                found = work(np.frombuffer(data, np.uint8).reshape(part.num_rows, width))
                rows = pa.array(np.repeat(np.arange(part.num_rows), each))
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in part.columns[:n]), *found], [*key, *names])

    return packets.select(*key, "data").mapInArrow(run, _fields(packets, key) + schema)


def code_packets(packets: DataFrame, layout: Layout, key: list[str]) -> DataFrame:
    """(key, data): packets with their parity, the strands of ``add_parity`` by sub-packet and slot; a packet is a row, so none is dealt."""
    n, size = layout.data, layout.strand_bytes

    def work(data: np.ndarray) -> list[pa.Array]:
        plain = np.zeros((len(data), n * layout.slots * size), np.uint8)
        plain[:, : data.shape[1]] = data
        words = plain.reshape(len(data), n, layout.slots * size).transpose(0, 2, 1).reshape(-1, n)
        coded = rs.encode(words, layout.parity).astype(np.uint8) if layout.parity else words
        return [_binary(coded.reshape(len(data), -1, layout.total).transpose(0, 2, 1).reshape(len(data), -1))]

    return _by_row(packets, layout, key, layout.packet_bytes, work, "data binary")


def packet_syndromes(coded: DataFrame, layout: Layout, key: list[str]) -> DataFrame:
    """(key, slot, worst) as ``syndromes`` gives them, of what ``code_packets`` gives; missing bytes are zeros."""
    width = layout.total * layout.slots * layout.strand_bytes

    def work(data: np.ndarray) -> list[pa.Array]:
        words = data.reshape(len(data), layout.total, -1).transpose(0, 2, 1).reshape(-1, layout.total)
        worst = rs.syndromes(words, layout.parity).reshape(len(data) * layout.slots, -1).max(1)
        return [pa.array(np.tile(np.arange(layout.slots, dtype=np.int32), len(data))), pa.array(worst.astype(np.int32))]

    return _by_row(coded, layout, key, width, work, "slot int, worst int", layout.slots)


def _numbered(slot: np.ndarray, n: int) -> list[pa.Array]:
    return [pa.array(np.tile(np.arange(n, dtype=np.int32), len(slot))), pa.array(np.repeat(slot, n).astype(np.int32))]


def _corrected(layout: Layout):
    """Data sub-packets with lost ones restored from parity."""

    def work(words: np.ndarray, lost: np.ndarray, slot: np.ndarray) -> list[pa.Array]:
        n = layout.data
        if layout.parity:
            plain, ok = rs.decode(_words(words), layout.parity, np.repeat(lost, layout.strand_bytes, 0))
            plain, ok = plain.astype(np.uint8).reshape(len(words), -1, n).transpose(0, 2, 1), ok.reshape(len(words), -1).all(1)
        else:
            plain, ok = words, ~lost.any(1)
        gone = lost[:, :n] & ~ok[:, None]
        return _numbered(slot, n) + [_binary(plain.reshape(-1, layout.strand_bytes), gone.reshape(-1)), pa.array(np.repeat(ok, n))]

    return work


def correct(grid: DataFrame, layout: Layout, key: list[str]) -> DataFrame:
    """(key, sub, slot, data, ok): data sub-packets with lost ones restored from parity; not ``ok``: too many were lost."""
    return _by_packet(_packed(grid, layout, key), layout, key, _corrected(layout), "sub int, slot int, data binary, ok boolean")


def restore(keys: DataFrame, strands: DataFrame, layout: Layout, key: list[str]) -> DataFrame:
    """What ``correct`` makes of ``fill_gaps``: all data strands of each key, without a row for each place that is empty."""
    place = np.arange(layout.total * layout.slots).reshape(layout.total, layout.slots)
    # padding is known and never lost
    zero = (np.arange(layout.total) < layout.data)[:, None] & (place >= layout.strands)
    mend = _corrected(layout)

    def work(words: np.ndarray, lost: np.ndarray, slot: np.ndarray) -> list[pa.Array]:
        padding = zero[:, slot].T
        words[padding], lost[padding] = 0, False
        return mend(words, lost, slot)

    none = F.lit(None).cast("binary")
    asked = keys.select(*key, *[none.alias(c) for c in ("subs", "slots", "there", "data")])
    packed = _packed(strands, layout, key)
    return _by_packet(packed.unionByName(asked), layout, key, work, "sub int, slot int, data binary, ok boolean", wanted=True)


def syndromes(strands: DataFrame, layout: Layout, key: list[str]) -> DataFrame:
    """(key, slot, worst): the largest syndrome of all code words of a slot; 0 if all are right."""

    def work(words: np.ndarray, lost: np.ndarray, slot: np.ndarray) -> list[pa.Array]:
        found = rs.syndromes(_words(words), layout.parity).reshape(len(words), -1)
        return [pa.array(slot.astype(np.int32)), pa.array(found.max(1).astype(np.int32))]

    return _by_packet(_packed(strands, layout, key), layout, key, work, "slot int, worst int")


def join_strands(strands: DataFrame, layout: Layout, key: list[str]) -> DataFrame:
    """(key, data): packets of strands in order, lost ones as zeros."""
    zero = F.expr(f"rpad(X'', {layout.strand_bytes}, X'00')")
    parts = F.array_sort(F.collect_list(F.struct("sub", "slot", F.hex(F.coalesce("data", zero)).alias("h"))))
    joined = strands.where(F.col("sub") < layout.data).groupBy(*key).agg(parts.alias("parts"))
    return joined.select(*key, F.substr(F.unhex(F.concat_ws("", F.transform("parts", lambda p: p["h"]))), F.lit(1), F.lit(layout.packet_bytes)).alias("data"))
