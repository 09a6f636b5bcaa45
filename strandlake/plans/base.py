"""What the query modules share: tables, the strands made of part names, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.convert import base4_encode, base_lut, utf8_bytes

Query = Callable[[SparkSession, str], DataFrame]


class Family:
    """Collects queries and the SQL that checks them."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(fn: Query) -> Query:
            self.queries[name] = fn
            if sql:
                self.oracles[name] = sql
            return fn

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, txt, dna: part names as base-4 strands."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("txt"), base4_encode(utf8_bytes(F.col("p_name"))).alias("dna"))


def sql_bytes(hexed: str) -> str:
    return f"list_transform(range(0, length({hexed}) // 2), lambda i: ('0x' || substr({hexed}, (2 * i + 1)::INT, 2))::INT)"


#: strands(id, txt, dna) for the checking engine
STRANDS = f"""s0 AS (SELECT p_partkey AS id, p_name AS txt, hex(encode(p_name)) AS h FROM part),
strands AS (SELECT id, txt, array_to_string(list_transform({sql_bytes('h')}, lambda b: substr('{base_lut(4, 4)}', 4 * b + 1, 4)), '') AS dna FROM s0)"""


def big(c: Column, name: str) -> Column:
    return c.cast("bigint").alias(name)
