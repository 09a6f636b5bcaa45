"""Operator 3: SimHash fingerprints and near-duplicate classes.

Fingerprints are made where the documents are (a narrow map).  Equal ones are
merged first, so copies of any number are one row from then on.  Each distinct
one gets a table of its distances to reference fingerprints; pairs whose tables
differ too much in any coordinate are discarded, and the others verified
(``hamming``).  Classes are connected components of the links.

The pipeline's stage asks for a similarity of shingle sets, which fingerprints
only estimate; near fingerprints propose pairs there, the sets themselves decide, and
bands find the pairs whose fingerprints are farther apart (``jaccard``).
"""

from __future__ import annotations

from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, require, texts, with_unique_rows
from .components import components
from .hamming import hamming_links, with_tables
from .jaccard import representatives
from .sieve import sieve

SEED = 42


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words of the text, A-Z lower-cased; of all words if fewer."""
    found = text.encode().lower().split()
    n = len(found)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
    runs = map(b" ".join, zip(*(found[i:] for i in range(words))))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, n - words + 1)


def fold(hashes: np.ndarray) -> bytes:
    """A bit is 1 if it is set in over half of the hashes, and 0 in a tie; 64 bits, most significant first."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, code) of (doc_id, text): the binary SimHash of text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = pa.array([fold(shingle_hashes(t, shingle)) for t in texts(batch.column(1))], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), codes], ["doc_id", "code"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, code binary")


def simhash_classes(docs: DataFrame, *, shingle: int = 3, limit: int = 2) -> DataFrame:
    """Fingerprint and class of each document; codes within ``limit`` bits are linked, none is missed.

    ``docs`` has doc_id (an integer) and text; further columns are ignored, whatever
    their names.  Returns a row for each row: doc_id, fingerprint (16 hex digits) and
    component_id, the smallest doc_id reachable by links.  A text of fewer words
    than a shingle is one shingle; a text without words, or null, has fingerprint
    zero and is linked like any other; a bit set in just half of the shingles is 0.
    Rows that share a doc_id, repeated rows among them, are rows of one node each.
    A null doc_id takes part only as a copy: it never names a class unless all its
    class is null.  Long texts are hashed whole; an empty table gives an empty one.
    """
    require(docs, "doc_id", "text")
    coded = materialize(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle), "fingerprints")
    distinct = materialize(with_tables(coded.groupBy("code").agg(F.min("doc_id").alias("id"))), "codes")
    found = components(hamming_links(distinct, limit)).withColumnRenamed("node", "id")
    classes = distinct.select("code", "id").join(found, "id", "left").select("code", F.coalesce("component", "id").alias("component"))
    return coded.join(materialize(classes, "classes"), "code").select("doc_id", F.lower(F.hex("code")).alias("fingerprint"), F.col("component").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs``, all columns, with one row of each class of near duplicates: that of the smallest doc_id.

    Documents are linked when their sets of shingles have a Jaccard similarity of
    ``similarity`` or more, just that too, and by nothing else.  Fingerprints within two
    bits propose pairs; bands of fingerprints short enough to find all such pairs would
    also bring together most of a large corpus, so ``jaccard`` finds the rest.  A text of fewer words than a shingle is one shingle; texts
    without words, null ones too, are copies of one another.  Every class keeps
    exactly one row: rows without doc_id come after all that have one, and of rows
    that share the smallest doc_id, repeated rows among them, any one stays.  Long
    texts are compared whole; columns stay whatever their names; an empty table
    gives an empty one.
    """
    require(docs, "doc_id", "text")
    other = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = with_unique_rows(docs.select(F.col("doc_id").cast("long").alias("id"), "text", other.alias("doc")), "rows")
    first = representatives(rows, partial(shingle_hashes, words=shingle), fold, similarity)
    # rows that are surely kept stay where they are; only those that may be dropped are dealt
    doubtful = sieve(materialize(rows.select("row").join(first, "row", "left_anti"), "dropped"))
    kept = rows.where(~doubtful("row")).unionByName(rows.where(doubtful("row")).join(first.hint("merge"), "row", "left_semi"))
    return kept.select(*[F.col("text" if c == "text" else f"doc.`{c}`") for c in docs.columns])
