"""All queries of the library by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FAMILIES = ("scalar", "codes", "channel", "results", "archive", "edits")


def _all(kind: str) -> dict:
    return {k: v for name in FAMILIES for k, v in getattr(import_module(f"strandlake.plans.{name}").family, kind).items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("queries")


def oracle_sql() -> dict[str, str]:
    return _all("oracles")
