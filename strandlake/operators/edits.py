"""Edit scripts between what was stored and what was read, and the error statistics that follow from them.

A script is made for many pairs at once: the distance table of a batch of pairs is
filled row by row, and all pairs are traced back together.  Everything after that
(positions, bursts, patterns, rates) is grouping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.convert import indexes

#: Cells of distance tables that a batch of pairs may take.
CELLS = 4_000_000
MATCH, REPLACE, DELETE, INSERT = b"MRDI"
SCRIPT = "script array<struct<op:string,src:int,dst:int>>, visual string"


def _letters(texts: list[str], width: int, pad: int) -> np.ndarray:
    out = np.full((len(texts), width), pad, np.int32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.int32)
    return out


def align_pairs(source: list[str], target: list[str]) -> list[bytes]:
    """For each pair the columns of a shortest alignment: M, R, D (only in source) or I (only in target).

    Of equally short ones, read from the end, that which matches or replaces first,
    then deletes: an edit in a run of like letters is thus at the run's start.
    """
    n, m = np.array([len(s) for s in source]), np.array([len(t) for t in target])
    rows, width = int(n.max(initial=0)), int(m.max(initial=0))
    a, b = _letters(source, rows, -1), _letters(target, width, -2)
    table = np.zeros((rows + 1, len(source), width + 1), np.int16)
    place = np.arange(width + 1, dtype=np.int16)
    table[0] = place
    for i in range(1, rows + 1):
        above = table[i - 1]
        here = np.minimum(above[:, 1:] + 1, above[:, :-1] + (a[:, i - 1, None] != b))
        whole = np.concatenate([np.full((len(source), 1), i, np.int16), here], 1)
        # an insertion costs one a column: the least over all columns before
        table[i] = np.minimum.accumulate(whole - place, 1) + place
    at = np.arange(len(source))
    i, j, steps = n.copy(), m.copy(), []
    while True:
        open_ = (i > 0) | (j > 0)
        if not open_.any():
            break
        here = table[i, at, j]
        both = (i > 0) & (j > 0)
        differ = a[at, i - 1] != b[at, j - 1] if rows and width else both
        across = both & (here == table[np.maximum(i - 1, 0), at, np.maximum(j - 1, 0)] + differ)
        down = ~across & (i > 0) & (here == table[np.maximum(i - 1, 0), at, j] + 1)
        steps.append(np.where(~open_, 0, np.where(across, np.where(differ, REPLACE, MATCH), np.where(down, DELETE, INSERT))).astype(np.uint8))
        i = i - (open_ & (across | down))
        j = j - (open_ & ~down)
    if not steps:
        return [b""] * len(source)
    columns = np.stack(steps[::-1], 1)
    return [row[row > 0].tobytes() for row in columns]


def script_of(columns: bytes) -> list[dict]:
    """(op, src, dst) of each edit, with 0-based places in both strings."""
    c = np.frombuffer(columns, np.uint8)
    src, dst = np.cumsum(c != INSERT) - (c != INSERT), np.cumsum(c != DELETE) - (c != DELETE)
    return [{"op": chr(c[k]), "src": int(src[k]), "dst": int(dst[k])} for k in np.flatnonzero(c != MATCH)]


def edit_scripts(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """``pairs`` with script (op, src, dst of each edit) and visual (a letter for each column); null where a string is."""
    names = pairs.columns
    schema = T.StructType([*pairs.schema.fields, *T._parse_datatype_string(SCRIPT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(names.index(c)).to_pylist() for c in (source, target))
            found: list[bytes | None] = [None] * len(x)
            known = [i for i in range(len(x)) if x[i] is not None and y[i] is not None]
            # pairs of about one length together, as many as the bound allows
            known.sort(key=lambda i: max(len(x[i]), len(y[i])))
            while known:
                side = max(len(x[known[-1]]), len(y[known[-1]])) + 1
                known, some = known[: -max(1, CELLS // side**2)], known[-max(1, CELLS // side**2) :]
                for i, columns in zip(some, align_pairs([x[i] for i in some], [y[i] for i in some])):
                    found[i] = columns
            scripts = pa.array([c if c is None else script_of(c) for c in found], pa.list_(pa.struct([("op", pa.string()), ("src", pa.int32()), ("dst", pa.int32())])))
            visual = pa.array([c if c is None else c.decode() for c in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, scripts, visual], schema=pa.schema([*batch.schema, ("script", scripts.type), ("visual", pa.string())]))

    return pairs.mapInArrow(run, schema)


def edit_counts(visual: Column) -> Column:
    """(edits, insertions, deletions, substitutions) of a ``visual``."""
    count = lambda c: F.length(visual) - F.length(F.translate(visual, c, ""))
    return F.struct(count("IDR").alias("edits"), count("I").alias("insertions"), count("D").alias("deletions"), count("R").alias("substitutions"))


def densest_window(visual: Column, k: int) -> Column:
    """The most edits in ``k`` consecutive columns (all columns if there are fewer)."""
    edits = F.transform(indexes(F.greatest(F.length(visual) - (k - 1), F.lit(1))), lambda i: F.length(F.translate(F.substr(visual, i + 1, F.lit(k)), "M", "")))
    return F.array_max(edits)


def patterns(visual: Column) -> Column:
    """Maximal runs of edits, in order."""
    return F.regexp_extract_all(visual, F.lit("[IDR]+"), F.lit(0))


def bursts(visual: Column, op: str) -> Column:
    """Lengths of maximal runs of one kind of edit."""
    return F.transform(F.regexp_extract_all(visual, F.lit(f"{op}+"), F.lit(0)), F.length)


def error_positions(scripts: DataFrame) -> DataFrame:
    """(pos, op, n): edits by place in the source and kind; partial counts go over the wire."""
    return scripts.select(F.explode("script").alias("e")).groupBy(F.col("e.src").alias("pos"), F.col("e.op").alias("op")).agg(F.count(F.lit(1)).alias("n"))


def position_rates(scripts: DataFrame, source: str) -> DataFrame:
    """(pos, rate): edits at a place over the strands that have it."""
    reach = scripts.groupBy(F.length(source).alias("n")).count()
    strands = reach.select(F.explode(indexes(F.col("n"))).alias("pos"), "count").groupBy("pos").agg(F.sum("count").alias("strands"))
    edits = error_positions(scripts).groupBy("pos").agg(F.sum("n").alias("edits"))
    return strands.join(edits, "pos", "left").select("pos", (F.coalesce("edits", F.lit(0)) / F.col("strands")).alias("rate"))


def pattern_histogram(scripts: DataFrame) -> DataFrame:
    return scripts.select(F.explode(patterns(F.col("visual"))).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def error_rates(scripts: DataFrame, source: str) -> DataFrame:
    """(length, strands, intact, edits, rate) by strand length: edits over letters."""
    c = edit_counts(F.col("visual"))
    rows = scripts.select(F.length(source).alias("length"), c["edits"].alias("edits"))
    return rows.groupBy("length").agg(F.count(F.lit(1)).alias("strands"), F.count_if(F.col("edits") == 0).alias("intact"), F.sum("edits").cast("bigint").alias("edits")).withColumn("rate", F.col("edits") / (F.col("strands") * F.col("length")))


def first_error(stored: Column, read: Column) -> Column:
    """0-based place of the first value that is wrong or lost; null if none is."""
    wrong = F.filter(F.transform(F.arrays_zip(stored.alias("x"), read.alias("y")), lambda p, i: F.when(p["x"].eqNullSafe(p["y"]), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())
    return F.try_element_at(wrong, F.lit(1))
