"""Codes put together: typed stages, checked when the plan is built, folded left to encode and right to decode."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import convert as C
from ..functions.hedges import Hedges
from ..functions.strand import nearest_window, reverse_complement
from . import codes as K

Step = Callable[[DataFrame], DataFrame]


class Kind(IntEnum):
    """In this order from file to strand."""

    OUTER, CODEWORDS, TO_STRAND, STRAND = range(4)


class Policy(IntEnum):
    PERMISSIVE, FAILFAST = range(2)


class ConstructionError(ValueError):
    """Stages that do not fit together."""


@dataclass(frozen=True)
class Stage:
    name: str
    kind: Kind
    encode: Step
    decode: Step
    state: dict = field(default_factory=dict)


class Pipeline:
    """Encodes (id, cw) to (id, dna) and back; reads that no stage can place are in ``rejected``."""

    def __init__(self, stages: list[Stage], policy: Policy = Policy.PERMISSIVE):
        kinds = [s.kind for s in stages]
        if kinds != sorted(kinds):
            raise ConstructionError("stages must go from outer codes over codewords to strands: " + ", ".join(s.name for s in stages))
        if kinds.count(Kind.TO_STRAND) != 1:
            raise ConstructionError("exactly one stage must turn codewords into strands")
        self.stages, self.policy = stages, policy

    def encode(self, df: DataFrame) -> DataFrame:
        for stage in self.stages:
            df = stage.encode(df)
        return df

    def _strand_side(self, df: DataFrame) -> DataFrame:
        for stage in reversed([s for s in self.stages if s.kind == Kind.STRAND]):
            df = stage.decode(df)
        return df

    def oriented(self, reads: DataFrame) -> DataFrame:
        """Strands stripped, forward or else as the reverse complement; null dna where neither works."""
        ahead = self._strand_side(reads.withColumn("_read", F.col("dna")))
        both = self._strand_side(ahead.withColumns({"_ahead": F.col("dna"), "dna": reverse_complement(F.col("_read"))}))
        # Always so, but not known to be: a filter on dna stays above.  Below, it would search all windows anew for each mention of a strand.
        here = F.spark_partition_id() >= 0
        return both.select(*[c for c in reads.columns if c != "dna"], F.when(here, F.coalesce("_ahead", "dna")).alias("dna"), (F.col("_ahead").isNull() & F.col("dna").isNotNull()).alias("is_reversed"))

    def decode(self, reads: DataFrame) -> DataFrame:
        df = self.oriented(reads).where(F.col("dna").isNotNull())
        for stage in reversed([s for s in self.stages if s.kind != Kind.STRAND]):
            df = stage.decode(df)
        if self.policy == Policy.FAILFAST:
            df = df.withColumn("cw", F.when(F.exists("cw", lambda x: x.isNull()), F.raise_error(F.lit("a strand could not be decoded"))).otherwise(F.col("cw")))
        return df

    def rejected(self, reads: DataFrame) -> DataFrame:
        return self.oriented(reads).where(F.col("dna").isNull()).select(*[c for c in reads.columns if c != "dna"])

    def header(self) -> str:
        return json.dumps([{"name": s.name, "state": s.state} for s in self.stages], sort_keys=True)


def crc8_stage() -> Stage:
    return Stage("crc8", Kind.CODEWORDS, lambda df: df.withColumn("cw", K.crc8_append(F.col("cw"))), lambda df: df.withColumn("cw", K.crc8_verify(F.col("cw"))))


def reed_solomon_stage(nsym: int) -> Stage:
    return Stage("reed_solomon", Kind.CODEWORDS, lambda df: K.rs_encode(df, "cw", nsym), lambda df: K.rs_decode(df, "cw", nsym), {"nsym": nsym})


def randomize_stage(index_bytes: int) -> Stage:
    return Stage("randomize", Kind.CODEWORDS, lambda df: K.randomize(df, "cw", index_bytes), lambda df: K.randomize(df, "cw", index_bytes), {"index_bytes": index_bytes})


def hedges_stage(code: Hedges, max_guesses: int = 100_000) -> Stage:
    return Stage("hedges", Kind.TO_STRAND, lambda df: K.hedges_encode(df, "cw", "dna", code).drop("cw"), lambda df: K.hedges_decode(df, "dna", "cw", code, max_guesses).drop("dna"), {"rate": code.rate, "seq_bytes": code.seq_bytes, "message_bytes": code.message_bytes})


def identity_stage(name: str = "identity", kind: Kind = Kind.CODEWORDS) -> Stage:
    return Stage(name, kind, lambda df: df, lambda df: df)


def snapshot_stage(name: str, column: str = "cw", kind: Kind = Kind.CODEWORDS) -> Stage:
    """Keeps what a strand is at this point under a name of its own, for probes."""
    return Stage(f"snapshot {name}", kind, lambda df: df.withColumn(name, F.col(column)), lambda df: df, {"column": column})


def barcode_stage(*barcode: int) -> Stage:
    """Bytes in front of every strand's codewords; a strand with others is lost on decoding."""
    n = len(barcode)
    head = F.array(*map(F.lit, barcode))
    own = lambda c: F.slice(c, 1, n) == head
    return Stage("barcode", Kind.CODEWORDS, lambda df: df.withColumn("cw", F.concat(head, "cw")), lambda df: df.where(own(F.col("cw"))).withColumn("cw", F.slice("cw", F.lit(n + 1), F.size("cw"))), {"barcode": list(barcode)})


def base4_stage() -> Stage:
    return Stage("base4", Kind.TO_STRAND, lambda df: df.withColumn("dna", C.base4_encode(F.col("cw"))).drop("cw"), lambda df: df.withColumn("cw", C.base4_decode(F.col("dna"))).drop("dna"))


def strip_primer(df: DataFrame, primer: str, *, back: bool = False, search: int = 10, tolerance: int = 5) -> DataFrame:
    """``df`` with what follows (or precedes) a primer in dna: exact anywhere, else the nearest window at that end; null if none is near.

    Each step is a column of its own, so no window is searched twice.
    """
    n, p = len(primer), primer[::-1] if back else primer
    df = df.withColumn("_strand", F.reverse("dna") if back else F.col("dna"))
    strand = F.col("_strand")
    df = df.withColumn("_near", F.when(F.instr(strand, p) == 0, nearest_window(strand, F.lit(p), 0, F.least(F.lit(search), F.length(strand) - n))))
    near, exact = F.col("_near"), F.instr(strand, p)
    rest = F.when(exact > 0, F.substr(strand, exact + n, F.length(strand))).when(near["distance"] <= tolerance, F.substr(strand, near["place"] + n + 1, F.length(strand)))
    return df.withColumn("dna", F.reverse(rest) if back else rest).drop("_strand", "_near")


def primer_stage(front: str, back: str, search: int = 10, tolerance: int = 5) -> Stage:
    return Stage(
        "primers",
        Kind.STRAND,
        lambda df: df.withColumn("dna", F.concat(F.lit(front), F.col("dna"), F.lit(back))),
        lambda df: strip_primer(strip_primer(df, front, search=search, tolerance=tolerance), back, back=True, search=search, tolerance=tolerance),
        {"front": front, "back": back},
    )


#: Known architectures by id and short name.
FORMATS = {0x0703: "BasicHedges", 0x0704: "RS+Base4"}


def rs_base4(primer5: str = "A" * 20, primer3: str = "A" * 20, inner_ecc: int = 0, index_bytes: int = 2, tolerance: int = 5) -> Pipeline:
    inner = [reed_solomon_stage(inner_ecc)] if inner_ecc else []
    return Pipeline([randomize_stage(index_bytes), *inner, base4_stage(), primer_stage(primer5, primer3, tolerance=tolerance)])


def hedges_line(primer5: str = "A" * 20, primer3: str = "A" * 20, *, rate: float = 0.5, index_bytes: int = 2, strand_bytes: int = 15, crc: bool = True, tolerance: int = 5, max_guesses: int = 100_000) -> Pipeline:
    """The hash code behind a checksum: index bytes are its sequence, the rest its message."""
    code = Hedges(rate, seq_bytes=index_bytes, message_bytes=strand_bytes + crc)
    return Pipeline([*([crc8_stage()] if crc else []), hedges_stage(code, max_guesses), primer_stage(primer5, primer3, tolerance=tolerance)])


#: Lines by short name.
LINES = {"RS+Base4": rs_base4, "BasicHedges": hedges_line}


def line_of(name: str | int, **options) -> Pipeline:
    """The line of a format, by id or short name."""
    name = FORMATS.get(name, name)
    if name not in LINES:
        raise ConstructionError(f"unknown format {name}; known: {', '.join(LINES)}")
    return LINES[name](**options)


def parity_for(strand_bytes: int, block_bytes: int, symbols: int = 255) -> int:
    """Parity strands of a block: what the field's symbols leave beside the block's data strands."""
    strands = -(-block_bytes // strand_bytes)
    if strands >= symbols:
        raise ConstructionError(f"{strands} strands leave no parity among {symbols} symbols")
    return symbols - strands


def decode_chain(reads: DataFrame, lines: dict[str, Pipeline]) -> tuple[DataFrame, DataFrame]:
    """What several lines read, each of what the ones before it rejected: (line, id columns, cw), and the reads that none takes."""
    found, rest = None, reads
    for name, line in lines.items():
        mine = line.decode(rest)
        one = mine.select(F.lit(name).alias("line"), *[c for c in mine.columns if c != "is_reversed"])
        found = one if found is None else found.unionByName(one)
        kept = line.oriented(rest).withColumn("_taken", F.col("dna").isNotNull()).drop("dna", "is_reversed")
        # the reads themselves, for the next line: those that this one could not place
        ids = [c for c in reads.columns if c != "dna"]
        rest = rest.join(kept.where(~F.col("_taken")).select(*ids), ids, "left_semi")
    return found, rest
