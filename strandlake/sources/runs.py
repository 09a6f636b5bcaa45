"""Run directories: settings, results and statistics of experiments as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = "string path, string dir, bigint length"


def list_files(spark: SparkSession, root: str, pattern: str | None = None, *, directories: bool = False) -> DataFrame:
    """(path, dir, length) of the files below ``root`` whose path matches a regular expression; ``directories``: their directories, once each.

    Only names and sizes are read, by the executors, through Spark's own file index.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), "length")
    if pattern is not None:
        found = found.where(F.col("path").rlike(pattern))
    return found.groupBy("dir").agg(F.count(F.lit(1)).alias("files")) if directories else found


def find_runs(spark: SparkSession, root: str, match_file: str) -> DataFrame:
    """(dir, files): directories with a file whose path holds ``match_file``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return files.where(F.contains("path", F.lit(match_file))).groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("dir")).agg(F.count(F.lit(1)).alias("files"))


def read_settings(spark: SparkSession, root: str, pattern: str, prefix: str | None = None) -> DataFrame:
    """(dir, settings): JSON files as maps, keys as ``prefix::key`` if a prefix is given; a file that is not JSON is an empty map."""
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("dir"), "value")
    found = F.coalesce(F.from_json("value", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return texts.select("dir", (F.transform_keys(found, lambda k, v: F.concat(F.lit(f"{prefix}::"), k)) if prefix else found).alias("settings"))


def collect_runs(*parts: DataFrame) -> DataFrame:
    """(dir, settings): the maps of each directory as one, later parts before earlier ones."""
    ranked = None
    for i, part in enumerate(parts):
        one = part.select("dir", F.explode("settings").alias("key", "value")).withColumn("rank", F.lit(i))
        ranked = one if ranked is None else ranked.unionByName(one)
    last = ranked.groupBy("dir", "key").agg(F.max_by("value", "rank").alias("value"))
    return last.groupBy("dir").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("settings"))


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.csv(path, header=options.pop("header", True), **options)


def read_rates(spark: SparkSession, path: str, label: str) -> DataFrame:
    """(pos, rate) of the line named ``label`` in a CSV file of error rates: a label, then a value for each place."""
    lines = spark.read.text(path).select(F.split("value", ",").alias("cells")).where(F.trim(F.element_at("cells", 1)) == label)
    cells = lines.select(F.posexplode(F.slice("cells", F.lit(2), F.size("cells"))).alias("pos", "rate"))
    return cells.select("pos", F.expr("try_cast(trim(rate) AS double)").alias("rate")).where(F.col("rate").isNotNull())


def write_results(rows: DataFrame, path: str) -> None:
    """Results as CSV (arrays and maps as JSON) and as Parquet, side by side."""
    flat = [F.to_json(c).alias(c) if dict(rows.dtypes)[c].startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c in rows.columns]
    rows.write.mode("overwrite").parquet(f"{path}/parquet")
    rows.select(*flat).write.mode("overwrite").csv(f"{path}/csv", header=True)


def stat_lines(stats: DataFrame) -> DataFrame:
    """(value): ``name=value`` lines of (name, value), by name."""
    return stats.select(F.concat_ws("=", "name", F.col("value").cast("string")).alias("value")).orderBy("value")


def write_stats(stats: DataFrame, path: str, files: DataFrame | None = None) -> None:
    """Lines of (name, value) in one file; names listed in ``files`` (name, file) go to files of their own.

    A store of counters is small by nature: it has a row for each name.
    """
    if files is None:
        stat_lines(stats).coalesce(1).write.mode("overwrite").text(f"{path}/stats")
        return
    placed = stats.join(F.broadcast(files), "name", "left").withColumn("file", F.coalesce("file", F.lit("stats")))
    lines = placed.select("file", F.concat_ws("=", "name", F.col("value").cast("string")).alias("value"))
    lines.repartition("file").sortWithinPartitions("file", "value").write.mode("overwrite").partitionBy("file").text(path)
