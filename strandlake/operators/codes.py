"""Inner codes on codeword arrays and the hash code on strands; Arrow batches where built-ins end."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rs
from ..functions.gf import crc8
from ..functions.hedges import Hedges

CODEWORDS = T.ArrayType(T.IntegerType())


def with_column(df: DataFrame, name: str, kind: T.DataType, source: str | tuple[str, ...], fn: Callable[..., list]) -> DataFrame:
    """``df`` with a column that ``fn`` makes of lists of the source columns, a batch at a time."""
    sources = (source,) if isinstance(source, str) else source
    at = [df.columns.index(s) for s in sources]
    keep = [c for c in df.columns if c != name]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            values = fn(*(batch.column(i).to_pylist() for i in at))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values, to_arrow_type(kind))], [*keep, name])

    return df.mapInArrow(run, schema)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores, four tasks to each: for work that takes long a row, as files of short rows are few."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def crc8_append(cw: Column) -> Column:
    return F.concat(cw, F.array(crc8(cw)))


def crc8_verify(cw: Column) -> Column:
    """Payload without the checksum; all nulls, one shorter, if it fails or a codeword is lost."""
    good = ~F.exists(cw, lambda x: x.isNull()) & (crc8(cw) == 0)
    n = F.size(cw) - 1
    return F.when(F.coalesce(good, F.lit(False)), F.slice(cw, F.lit(1), n)).otherwise(F.transform(F.slice(cw, F.lit(1), n), lambda x: F.lit(None).cast("int")))


def crc8_index_insert(cw: Column, index_bytes: int) -> Column:
    head = F.slice(cw, 1, index_bytes)
    return F.concat(head, F.array(crc8(head)), F.slice(cw, F.lit(index_bytes + 1), F.size(cw)))


def crc8_index_verify(cw: Column, index_bytes: int) -> Column:
    head = F.slice(cw, 1, index_bytes + 1)
    good = ~F.exists(head, lambda x: x.isNull()) & (crc8(head) == 0)
    plain = F.concat(F.slice(cw, 1, index_bytes), F.slice(cw, F.lit(index_bytes + 2), F.size(cw)))
    return F.when(F.coalesce(good, F.lit(False)), plain).otherwise(F.transform(plain, lambda x: F.lit(None).cast("int")))


def randomize(df: DataFrame, column: str, index_bytes: int) -> DataFrame:
    """XOR the payload with a mask that its index seeds; the same again undoes it.  A strand with a lost codeword stays."""

    def fn(rows: list) -> list:
        out = []
        for cw in rows:
            if cw is None or None in cw:
                out.append(cw)
                continue
            mask = np.random.RandomState(cw[:index_bytes]).bytes(len(cw) - index_bytes)
            out.append(cw[:index_bytes] + [a ^ b for a, b in zip(cw[index_bytes:], mask)])
        return out

    return with_column(df, column, CODEWORDS, column, fn)


def _by_length(rows: list) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, cw in enumerate(rows):
        if cw is not None:
            groups.setdefault(len(cw), []).append(i)
    return groups


def rs_encode(df: DataFrame, column: str, nsym: int) -> DataFrame:
    """Append ``nsym`` Reed-Solomon symbols; strands over 255 symbols stay as they are."""

    def fn(rows: list) -> list:
        out = list(rows)
        for n, members in _by_length(rows).items():
            if n and n + nsym <= 255:
                for i, word in zip(members, rs.encode(np.array([rows[i] for i in members]), nsym).tolist()):
                    out[i] = word
        return out

    return with_column(df, column, CODEWORDS, column, fn)


def rs_decode(df: DataFrame, column: str, nsym: int) -> DataFrame:
    """Correct and strip; nulls (and -1) are erasures; what can't be corrected becomes all nulls."""

    def fn(rows: list) -> list:
        out = list(rows)
        for n, members in _by_length(rows).items():
            if n <= nsym:
                continue
            lost = np.array([[x is None or x < 0 for x in rows[i]] for i in members])
            words = np.array([[0 if x is None or x < 0 else x for x in rows[i]] for i in members])
            plain, ok = rs.decode(words, nsym, lost)
            for i, word, good in zip(members, plain.tolist(), ok.tolist()):
                out[i] = word if good else [None] * (n - nsym)
        return out

    return with_column(df, column, CODEWORDS, column, fn)


def hedges_encode(df: DataFrame, column: str, out: str, code: Hedges) -> DataFrame:
    """Codewords (sequence bytes first) to a strand."""

    def fn(rows: list) -> list:
        known = [cw is not None and None not in cw for cw in rows]
        made = iter(code.encode_all([bytes(cw) for cw, k in zip(rows, known) if k]))
        return [next(made) if k else None for k in known]

    return with_column(df, out, T.StringType(), column, fn)


def hedges_decode(df: DataFrame, column: str, out: str, code: Hedges, max_guesses: int = 100_000) -> DataFrame:
    """A strand to codewords, the best that the search finds; what it did not reach is null.

    A strand may be as near to other words as to its own, and no search can tell which
    is meant: the word whose bytes are the likeliest at their places is taken, by how
    often they are there in those strands of ``df`` that are nearest to one word only,
    the first found of equally likely ones.  In a stream it is the first found.
    """
    alike, chances, counts = "_alike", "_chances", "_counts"
    while {alike, chances, counts} & {c.lower() for c in (*df.columns, out)}:
        alike, chances, counts = f"_{alike}", f"_{chances}", f"_{counts}"

    def search(rows: list) -> list:
        return [None if s is None else [[x for part in word for x in part] for word in code.decode_all(s, max_guesses, settle=True)[0]] for s in rows]

    def likeliest(rows: list, found: list) -> list:
        return [words and words[0 if p is None else p.index(max(p))] for words, p in zip(rows, found)]

    def chance(word: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(word) - 1)
        return F.aggregate(places, F.lit(0.0), lambda p, i: p + F.log(F.coalesce(F.try_element_at(F.col(counts), i * 256 + F.get(word, i)), F.lit(0)) + F.lit(1.0)))

    found = with_column(spread(df), alike, T.ArrayType(CODEWORDS), column, search)
    if df.isStreaming:
        return found.drop(out).withColumn(out, F.get(alike, F.lit(0))).drop(alike)
    # dealt again, so that strands are searched once for the counts and the result: both are Arrow maps, which take all
    # columns, so Spark prunes neither and finds the two exchanges to be the same
    found = spread(found)
    ranked = found.withColumn(counts, _byte_counts(found, alike).scalar()).withColumn(chances, F.when(F.size(alike) > 1, F.transform(alike, chance)))
    return with_column(ranked.drop(counts), out, CODEWORDS, (alike, chances), likeliest).drop(alike, chances)


def _byte_counts(found: DataFrame, words: str) -> DataFrame:
    """One row: how many whole words that are the only one of their strand have a byte at a place; keys are 256 x place + byte."""
    at = found.columns.index(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            sole = [w[0] for w in batch.column(at).to_pylist() if w is not None and len(w) == 1 and None not in w[0]]
            for n, members in _by_length(sole).items():
                keys = np.array([sole[i] for i in members]) + 256 * np.arange(n)
                new = np.bincount(keys.ravel(), minlength=len(total))
                new[: len(total)] += total
                total = new
        keys = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(total[keys], pa.int64())], ["key", "n"])

    counted = found.mapInArrow(run, "key int, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return counted.agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("counts"))


_COMPLEMENT = str.maketrans("ACGT", "TGCA")


def hedges_orient(df: DataFrame, column: str, out: str, code: Hedges, forward: int = 1_000, backward: int = 5_000) -> DataFrame:
    """The strand, or its reverse complement if that decodes with fewer losses."""

    def lost(s: str, guesses: int) -> int:
        seq, message, _, _ = code.decode(s, guesses)
        return seq.count(None) + message.count(None)

    def fn(rows: list) -> list:
        result = []
        for s in rows:
            if s is None:
                result.append(None)
                continue
            ahead = lost(s, forward)
            other = s[::-1].translate(_COMPLEMENT)
            result.append(other if ahead and lost(other, backward) < ahead else s)
        return result

    return with_column(spread(df), out, T.StringType(), column, fn)


def hedges_pick_rate(df: DataFrame, column: str, out: str, codes: dict[str, Hedges], max_guesses: int = 5_000) -> DataFrame:
    """The name of the code that decodes a strand with the fewest losses; the first of equals.

    Nothing is better than the first code that reaches the end, so codes after it are
    not tried.  Those before it are shown not to reach it for many strands at once
    (``never_ends``); only a strand that no code reads is searched for its losses.
    """

    def fn(rows: list) -> list:
        result, left = [None] * len(rows), [i for i, s in enumerate(rows) if s is not None]
        for name, code in codes.items():
            if not left:
                break
            never = code.never_ends([rows[i] for i in left], max_guesses)
            ends = {i for i, no in zip(left, never.tolist()) if not no and code.decode(rows[i], max_guesses)[3]}
            for i in ends:
                result[i] = name
            left = [i for i in left if i not in ends]
        for i in left if codes else ():
            lost = {name: sum(x is None for part in code.decode(rows[i], max_guesses)[:2] for x in part) for name, code in codes.items()}
            result[i] = min(lost, key=lost.get)
        return result

    return with_column(spread(df), out, T.StringType(), column, fn)
