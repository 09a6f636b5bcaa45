"""Strand text files: ``%`` comments, then one strand a line, with or without its index."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strand import clean_read


def strand_line(index: Column, dna: Column) -> Column:
    """``(i, j):ACGT``"""
    return F.concat(F.lit("("), F.array_join(index.cast("array<string>"), ", "), F.lit("):"), dna)


def parse_lines(lines: DataFrame) -> DataFrame:
    """(index_ints, dna) of a column ``value``; comments and blank lines go, a line without index has null."""
    text = F.trim("value")
    kept = lines.where((text != "") & ~text.startswith("%")).select(text.alias("t"))
    index = F.regexp_extract("t", r"^\(([^)]*)\):", 1)
    numbers = F.transform(F.filter(F.split(index, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))
    return kept.select(F.when(F.col("t").startswith("("), numbers).alias("index_ints"), F.regexp_replace("t", r"^\([^)]*\):", "").alias("dna"))


def read_strands(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def write_strands(strands: DataFrame, path: str, comments: dict[str, str] | None = None) -> None:
    """Lines of (index_ints, dna), with the comments at the head of every file."""
    head = [f"% {k} : {v}" for k, v in (comments or {}).items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started = not head
        for batch in batches:
            if not started:
                yield pa.RecordBatch.from_arrays([pa.array(head, batch.schema.field(0).type)], schema=batch.schema)
                started = True
            yield batch

    strands.select(strand_line(F.col("index_ints"), F.col("dna")).alias("value")).mapInArrow(run, "value string").write.text(path)


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the comments of strand files, once each."""
    lines = spark.read.text(path).select(F.trim("value").alias("t")).where(F.col("t").startswith("%"))
    parts = F.regexp_extract("t", r"^%\s*(.*?)\s*:\s*(.*)$", 1), F.regexp_extract("t", r"^%\s*(.*?)\s*:\s*(.*)$", 2)
    return lines.select(parts[0].alias("key"), parts[1].alias("value")).where("key <> ''").distinct()


def read_primers(spark: SparkSession, path: str) -> DataFrame:
    """One primer a line; comments and blanks go."""
    return parse_lines(spark.read.text(path)).select(F.col("dna").alias("primer"))


def parse_fastq(records: DataFrame) -> DataFrame:
    """(record_id, seq, quality, is_rna) of a column ``value`` that holds whole files or records of four lines."""
    lines = F.split(F.regexp_replace(F.rtrim("value"), "\r", ""), "\n")
    n = F.floor(F.size(lines) / 4).cast("int")
    four = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(lines, i * 4 + 1, F.lit(4)))
    rows = records.select(F.explode(four).alias("r"))
    seq = F.rtrim(F.regexp_replace(F.col("r")[1], "\\x00+$", ""))
    return rows.select(F.regexp_extract(F.col("r")[0], r"^@(\S+)", 1).alias("record_id"), clean_read(seq).alias("seq"), F.col("r")[3].alias("quality"), (F.instr(seq, "U") > 0).alias("is_rna"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """A FASTQ folder or file, one row a record; a file is read whole, so split large ones."""
    return parse_fastq(spark.read.text(path, wholetext=True))


def read_fast5(spark: SparkSession, path: str) -> DataFrame:
    raise NotImplementedError("FAST5 needs h5py, which this installation lacks; convert to FASTQ first")


READERS = {"fastq": read_fastq, "DNA": read_strands, "fast5": read_fast5}


def open_reads(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """The reader registered for a format name."""
    if kind not in READERS:
        raise ValueError(f"unknown format {kind}; known: {', '.join(READERS)}")
    return READERS[kind](spark, path)
