"""Clusters of reads: connected components of near pairs, and star alignment to a centre."""

from __future__ import annotations

import tempfile

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .aggregate import column_consensus
from .edits import DELETE, INSERT, MATCH, align_pairs


def _ensure_checkpoint_dir(spark) -> None:
    """Checkpoints go to the folder of ``spark.checkpoint.dir``; where that is unset, to a temporary one of a local master only."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="strandlake-"))


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """(id, cluster): the smallest id reachable, by label propagation with pointer jumping.

    Each round takes the least label among neighbours and then the label of that
    label; lineage is cut by reliable checkpoints.
    """
    spark = pairs.sparkSession
    _ensure_checkpoint_dir(spark)
    edges = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).union(pairs.select(F.col(b), F.col(a))).distinct().checkpoint()
    labels = edges.groupBy(F.col("x").alias("id")).agg(F.least(F.col("x"), F.min("y")).alias("cluster")).checkpoint()
    for _ in range(max_rounds):
        near = edges.join(labels.select(F.col("id").alias("y"), "cluster"), "y").groupBy(F.col("x").alias("id")).agg(F.min("cluster").alias("near"))
        lower = labels.join(near, "id").select("id", F.least("cluster", "near").alias("cluster"))
        jumped = lower.join(lower.select(F.col("id").alias("cluster"), F.col("cluster").alias("root")), "cluster").select("id", "root")
        new = jumped.withColumnRenamed("root", "cluster").checkpoint()
        changed = new.join(labels.withColumnRenamed("cluster", "old"), "id").where("cluster < old").limit(1).count()
        labels = new
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def cluster_reads(members: DataFrame, pairs: DataFrame, min_size: int = 4) -> DataFrame:
    """(id, cluster) of clusters with at least ``min_size`` reads.

    ``members`` has id and first, the read that stands for its copies; ``pairs``
    links such reads (a, b), so copies are never paired with each other.
    """
    labels = connected_components(pairs).withColumnRenamed("id", "first")
    placed = members.join(labels, "first", "left").select("id", F.coalesce("cluster", "first").alias("cluster"))
    large = placed.groupBy("cluster").count().where(F.col("count") >= min_size).select("cluster")
    return placed.join(large, "cluster").select("id", "cluster")


def star_rows(reads: list[str]) -> list[str]:
    """Reads aligned to the one with the least total edit distance to the others; inserts are merged column by column."""
    if not reads:
        return []
    n = len(reads)
    apart = [sum(x != MATCH for x in c) for c in align_pairs([r for r in reads for _ in reads], reads * n)]
    centre = reads[min(range(n), key=lambda i: (sum(apart[i * n : i * n + n]), i))]
    rows, room = [], [0] * (len(centre) + 1)
    for read, columns in zip(reads, align_pairs([centre] * n, reads)):
        # what stands before each base of the centre, and the base that is read there
        before, bases, at = [""], [], 0
        for c in columns:
            if c == INSERT:
                before[-1] += read[at]
            else:
                bases.append("-" if c == DELETE else read[at])
                before.append("")
            at += c != DELETE
        room = [max(x, len(y)) for x, y in zip(room, before)]
        rows.append((before, bases))
    return ["".join(x.ljust(r, "-") + y for x, r, y in zip(before, room, [*bases, ""])) for before, bases in rows]


def star_alignment(reads: DataFrame, cluster: str, order: str, text: str, sample: int = 15) -> DataFrame:
    """(cluster, row_no, aligned): the first ``sample`` reads of each cluster, aligned; a sampling operator by design.

    The sample is drawn before reads meet, so a task holds ``sample`` strands of a cluster.
    """
    firsts = reads.withColumn("_r", F.row_number().over(Window.partitionBy(cluster).orderBy(order))).where(F.col("_r") <= sample).select(cluster, "_r", text)
    kind = dict(reads.dtypes)[cluster]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("_r").to_pylist(), table.column(text).to_pylist()))
        made = star_rows([t for _, t in rows])
        return pa.table({cluster: pa.array([key[0].as_py()] * len(made), table.schema.field(cluster).type), "row_no": pa.array([r for r, _ in rows], pa.int32()), "aligned": pa.array(made, pa.string())})

    return firsts.groupBy(cluster).applyInArrow(run, f"{cluster} {kind}, row_no int, aligned string")


def cluster_consensus(reads: DataFrame, cluster: str, order: str, text: str, sample: int = 15) -> DataFrame:
    """(cluster, consensus, weight): what the aligned reads of a cluster say, and how many there are."""
    sizes = reads.groupBy(cluster).agg(F.count(F.lit(1)).alias("weight"))
    said = column_consensus(star_alignment(reads, cluster, order, text, sample), cluster, "aligned")
    return said.join(sizes, cluster).select(cluster, "consensus", "weight")
