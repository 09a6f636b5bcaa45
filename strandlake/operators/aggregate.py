"""Votes, consensus, probes, statistics and the analytics over run results."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.convert import indexes


def majority_vote(reads: DataFrame, key: str, values: str, weight: Column | None = None) -> DataFrame:
    """(key, values): the heaviest value at each place of a group's arrays; the smallest of equals.

    Partial counts per (key, place, value) go over the wire, not reads.
    """
    cells = reads.select(key, (weight if weight is not None else F.lit(1)).alias("w"), F.posexplode(values).alias("pos", "v")).where(F.col("v").isNotNull())
    counted = cells.groupBy(key, "pos", "v").agg(F.sum("w").alias("n"))
    best = counted.groupBy(key, "pos").agg(F.min_by("v", F.struct((-F.col("n")).alias("n"), F.col("v").alias("v"))).alias("v"))
    return best.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda c: c["v"]).alias(values))


def last_vote(reads: DataFrame, key: str, order: str | Column, *columns: str) -> DataFrame:
    return reads.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in columns])


def column_consensus(aligned: DataFrame, key: str, text: str) -> DataFrame:
    """(key, consensus): plurality of each column of aligned strings, A before C, G, T and the gap; gaps drop out."""
    places = aligned.select(key, F.posexplode(F.filter(F.split(text, ""), lambda c: c != "")).alias("pos", "b"))
    counted = places.groupBy(key, "pos", "b").count()
    best = counted.groupBy(key, "pos").agg(F.min_by("b", F.struct((-F.col("count")).alias("n"), F.instr(F.lit("ACGT-"), F.col("b")).alias("r"))).alias("b"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "b")))
    return best.groupBy(key).agg(F.regexp_replace(F.array_join(F.transform(ordered, lambda c: c["b"]), ""), "-", "").alias("consensus"))


def purity(members: DataFrame, cluster: str, truth: str) -> DataFrame:
    counted = members.groupBy(cluster, truth).count()
    return counted.groupBy(cluster).agg(F.sum("count").alias("size"), (F.max("count") / F.sum("count")).alias("purity"))


def islands(rows: DataFrame, key: list[str], pos: str) -> DataFrame:
    """(key, start, length) of runs of consecutive places."""
    w = W.partitionBy(*key).orderBy(pos)
    marked = rows.withColumn("_g", F.col(pos) - F.row_number().over(w))
    return marked.groupBy(*key, "_g").agg(F.min(pos).alias("start"), F.count(F.lit(1)).alias("length")).drop("_g")


def histogram_auto(df: DataFrame, column: str) -> DataFrame:
    """(bin, low, high, n): equal bins, as narrow as the rules of Sturges and Freedman-Diaconis ask."""
    x = F.col(column).cast("double")
    s = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.percentile(x, 0.25).alias("q1"), F.percentile(x, 0.75).alias("q3")).first()
    if not s["n"]:
        return df.sparkSession.createDataFrame([], "bin bigint, low double, high double, n bigint")
    span = s["hi"] - s["lo"]
    sturges = span / (math.log2(s["n"]) + 1)
    fd = 2 * (s["q3"] - s["q1"]) * s["n"] ** (-1 / 3)
    width = min(sturges, fd) if fd else sturges
    bins = max(1, math.ceil(span / width)) if width else 1
    step = span / bins if span else 1.0
    lo = s["lo"]
    bin_of = F.least(F.floor((x - lo) / step), F.lit(bins - 1)).cast("bigint")
    found = df.where(x.isNotNull()).groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return grid.join(F.broadcast(found), "bin", "left").select("bin", (F.lit(lo) + F.col("bin") * step).alias("low"), (F.lit(lo) + (F.col("bin") + 1) * step).alias("high"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def fixed_bins(df: DataFrame, column: str, width: float) -> DataFrame:
    return df.groupBy(F.floor(F.col(column) / width).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def merge_stats(*stores: DataFrame) -> DataFrame:
    """Long-form stores (name, kind, pos, key, value): counters, positions and keys add up."""
    both = stores[0]
    for s in stores[1:]:
        both = both.unionByName(s, allowMissingColumns=True)
    return both.groupBy("name", "kind", "pos", "key").agg(F.sum("value").alias("value"))


def name_runs(stats: DataFrame, base: str, run: int) -> DataFrame:
    """Names of a run's own: ``base::run::name``."""
    return stats.withColumn("name", F.concat_ws("::", F.lit(base), F.lit(str(run)), "name"))


def stat_appends(rows: DataFrame, name: str, value: str, order: str) -> DataFrame:
    """(name, values): the values of each name in their order, where raw values are wanted; a row for each name."""
    return rows.groupBy(name).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("values"))


def merge_arrays(*stores: DataFrame) -> DataFrame:
    """(name, values): arrays of counts by name, added place by place; shorter ones count as zero beyond their end."""
    both = stores[0]
    for s in stores[1:]:
        both = both.unionByName(s)
    added = both.select("name", F.posexplode("values").alias("pos", "v")).groupBy("name", "pos").agg(F.sum("v").alias("v"))
    return added.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("values"))


def keep_first(*stores: DataFrame) -> DataFrame:
    """(name, value): of names that several stores have, what the first says."""
    ranked = None
    for i, s in enumerate(stores):
        one = s.select("name", "value", F.lit(i).alias("rank"))
        ranked = one if ranked is None else ranked.unionByName(one)
    return ranked.groupBy("name").agg(F.min_by("value", "rank").alias("value"))


def combined_frontier(families: dict[str, DataFrame], x: str, y: str, label: str) -> DataFrame:
    """The frontier over several families of designs, with the family each point is of."""
    both = None
    for name, points in families.items():
        one = points.select(x, y, F.concat_ws("/", F.lit(name), F.col(label).cast("string")).alias(label))
        both = one if both is None else both.unionByName(one)
    found = pareto_frontier(both.fillna(0, [x, y]), x, y, label)
    return found.withColumn("family", F.substring_index(label, "/", 1)).orderBy(F.col(y).desc())


def rolling_means(df: DataFrame, key: list[str], order: list[str], value: str, window: int) -> DataFrame:
    """Arithmetic, geometric and harmonic mean of each full window that starts at a row."""
    w = W.partitionBy(*key).orderBy(*order).rowsBetween(0, window - 1)
    x = F.col(value)
    out = df.withColumns({"_n": F.count(x).over(w), "arithmetic": F.avg(x).over(w), "geometric": F.exp(F.avg(F.log(x)).over(w)), "harmonic": F.lit(float(window)) / F.sum(1 / x).over(w)})
    return out.where(F.col("_n") == window).drop("_n")


def block_probability(block: int, data: int, p: Column) -> Column:
    """Chance that at least ``data`` of ``block`` strands are there, each with chance p: 1 - sum of binomial terms."""
    logs = [0.0]
    for k in range(1, data):
        logs.append(logs[-1] + math.log(block - k + 1) - math.log(k))
    terms = [F.exp(F.lit(c) + F.lit(k) * F.log(p) + F.lit(block - k) * F.log(1 - p)) for k, c in enumerate(logs)]
    return 1 - F.aggregate(F.array(*terms), F.lit(0.0), lambda a, x: a + x)


def outer_code_search(designs: DataFrame, *, block: int = 255, file_bytes: int = 1_000_000, target: float = 1e6) -> DataFrame:
    """For each (p, strand_bytes): the least parity with a mean time to failure of ``target`` reads or more."""
    p = F.col("p")
    ratio = p / (1 - p)
    # chance of k strands for all k at once, from its neighbour: a running array of terms
    first = F.lit(float(block)) * F.log(1 - p)
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(block)),
        F.array(first),
        lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) + F.log((F.lit(float(block + 1)) - k) / k) + F.log(ratio))),
    )
    spread = designs.withColumn("_terms", terms).withColumn("parity", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    miss = F.aggregate(F.slice("_terms", F.lit(1), F.lit(block) - F.col("parity")), F.lit(0.0), lambda a, t: a + F.exp(t))
    blocks = F.ceil(F.lit(float(file_bytes)) / ((F.lit(block) - F.col("parity")) * F.col("strand_bytes")))
    # 1 - (1 - miss)^blocks, kept exact for small misses
    fail = -F.expm1(blocks * F.log1p(-F.least(miss, F.lit(1 - 1e-15))))
    good = spread.withColumn("mttf", F.when(fail > 0, 1 / fail).otherwise(F.lit(float("inf")))).where(F.col("mttf") >= target)
    return good.groupBy("p", "strand_bytes").agg(F.min("parity").alias("parity"))


def pareto_frontier(points: DataFrame, x: str, y: str, label: str) -> DataFrame:
    """Points no other beats in both: by falling y, those with a new largest x.

    A point's rivals are the best x of each y, so the window runs over one row for each y.
    """
    best = points.groupBy(y).agg(F.max(x).alias(x), F.min_by(label, F.struct((-F.col(x)).alias("x"), F.col(label).alias("l"))).alias(label))
    above = F.max(x).over(W.orderBy(F.col(y).desc()).rowsBetween(W.unboundedPreceding, -1))
    return best.withColumn("_above", above).where(F.col("_above").isNull() | (F.col(x) > F.col("_above"))).drop("_above")


def sweep(spark, **axes: list) -> DataFrame:
    """Every combination of the given values, a column an axis."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return out


def expand_settings(settings: dict) -> list[dict]:
    """Every combination of nested settings: a dictionary with ``value_list`` or ``range`` is an axis, a list of dictionaries is merged, all else is itself."""
    if "value_list" in settings:
        return [v for v in settings["value_list"]]
    if "range" in settings:
        return list(range(*settings["range"]))
    out: list[dict] = [{}]
    for key, value in settings.items():
        options = expand_settings(value) if isinstance(value, dict) else [value]
        out = [{**one, key: option} for one in out for option in options]
    return out


def byte_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, mismatches, length_gap): bytes that differ up to the shorter end of two binary columns ``data``."""
    both = a.select(key, F.col("data").alias("x")).join(b.select(key, F.col("data").alias("y")), key)
    hx, hy = F.hex("x"), F.hex("y")
    n = F.least(F.octet_length("x"), F.octet_length("y"))
    differ = F.size(F.filter(indexes(n), lambda i: F.substr(F.col("hx"), 2 * i + 1, F.lit(2)) != F.substr(F.col("hy"), 2 * i + 1, F.lit(2))))
    return both.withColumns({"hx": hx, "hy": hy}).select(key, differ.cast("bigint").alias("mismatches"), F.abs(F.octet_length("x") - F.octet_length("y")).cast("bigint").alias("length_gap"))
