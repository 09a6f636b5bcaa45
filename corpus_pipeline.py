"""From raw documents to packed training sequences, in five stages.

Each stage takes all that the one before it kept and gives a table with the
columns of ``documents``; the last gives the pieces of packed sequences.

In all stages columns stay whatever their names, null doc_ids are allowed, null
texts are texts without words, long texts are worked on whole, and an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm.common import materialize, prepare, table
from strandlake.llm.decontaminate import decontaminate
from strandlake.llm.packing import pack_documents
from strandlake.llm.quality import keep_good
from strandlake.llm.queries import vocabulary
from strandlake.llm.secrets import redact_secrets
from strandlake.llm.simhash import drop_near_duplicates

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier rejects: low quality, or toxic.

    A probability just at the bound is good quality, or toxic.  Null texts and null
    hosts are judged like any other; repeated rows are judged alike.
    """
    prepare(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates: five-word shingles, similarity 0.8 or more.

    That of the smallest doc_id stays; repeated rows, and all rows without words, are
    one document; rows without doc_id stay only where no copy has one.
    """
    prepare(spark)
    return drop_near_duplicates(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out of texts; drop documents that are half benchmark or more.

    Rows without a passage stay as they are, null texts too; n_chars follows the text.
    """
    prepare(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), n=10, drop_share=0.5)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark; no row is dropped, null texts stay null, n_chars follows the text."""
    prepare(spark)
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 tokens; a null text is the end token alone, a repeated row is packed each time."""
    prepare(spark)
    return pack_documents(docs, vocabulary("word_bpe_49k.json"), capacity=4096, end_id=2)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: A learned classifier, fingerprints over bits and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
