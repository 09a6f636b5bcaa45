"""Every query with SQL gives what the SQL gives, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest
from strandlake import catalog

SMALL = "/root/testdata/sf0.001"
SLOW = {"archive_roundtrip", "rs_outer_decode"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def rows(values, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(repr(tuple(r[i] for i in order)) for r in values)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="sample tables are not here")
@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - SLOW))
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SMALL)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), columns)


def test_strand_lines(spark):
    from strandlake.sources.dna import parse_fastq, parse_lines

    lines = spark.createDataFrame([("% arch : rs",), ("(3, 1):ACGT",), (" ACCA ",), ("",)], "value string")
    assert [tuple(r) for r in parse_lines(lines).collect()] == [([3, 1], "ACGT"), (None, "ACCA")]
    fastq = spark.createDataFrame([("@r1 x\nACUN\n+\n!!!!\n@r2\nAC\n+\n##\n",)], "value string")
    assert [tuple(r) for r in parse_fastq(fastq).collect()] == [("r1", "ACTA", "!!!!", True), ("r2", "AC", "##", False)]
