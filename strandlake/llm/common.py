"""Session helpers shared by the operators: shared scratch tables, column checks, Arrow plumbing."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROOT = str(Path(__file__).resolve().parents[2])
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver was started from."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *parts])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset, a temporary one of a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        base = f"file://{tempfile.mkdtemp(prefix='strandlake-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back.

    Cuts lineage with files every executor can read, so a lost executor costs a
    task retry only.  What the write shuffled is deleted with it; the files go
    when they are released or the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/strandlake-{name}-{uuid.uuid4().hex}"
    kept = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if kept is None else spark.conf.set(_CLEANUP, kept)
    files, jpath = _filesystem(spark, path)
    files.deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` gave and nothing reads any more."""
    for df in tables:
        files, jpath = _filesystem(df.sparkSession, df.scratch_path)
        files.delete(jpath, True)


def nested(docs: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` and doc, a struct of all columns of ``docs``: no name of the caller's can clash with ours."""
    return docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def with_unique_rows(df: DataFrame, name: str) -> DataFrame:
    """``df`` and row, a key of its own for each row; written, so that it is the same whenever it is read."""
    return materialize(df.withColumn("row", F.monotonically_increasing_id()), name)


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str | T.StructType) -> DataFrame:
    """Apply ``fn`` to each Arrow batch of ``df``; narrow, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is None:
                continue
            if isinstance(out, pa.Table):
                yield from out.combine_chunks().to_batches()
            else:
                yield out

    return df.mapInArrow(run, schema)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array) -> list[str]:
    return [x if x is not None else "" for x in column.to_pylist()]


def ascii_lower(column: str):
    """Lower-case A-Z only."""
    return F.translate(F.col(column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
