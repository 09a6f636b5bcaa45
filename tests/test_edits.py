"""Edit scripts against the textbook distance, and star alignment."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from strandlake.operators import channel as N
from strandlake.operators import cluster as G
from strandlake.operators import edits as E

R = random.Random(3)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def strand(n):
    return "".join(R.choices("ACGT", k=n))


def test_scripts_are_shortest_and_lead_from_one_to_the_other():
    a, b = [strand(R.randint(0, 30)) for _ in range(200)], [strand(R.randint(0, 30)) for _ in range(200)]
    for x, y, columns in zip(a, b, E.align_pairs(a, b)):
        script = E.script_of(columns)
        assert len(script) == distance(x, y)
        at, out = 0, []
        for e in script:
            out.append(x[at : e["src"]])
            at = e["src"] + (e["op"] != "I")
            if e["op"] != "D":
                out.append(y[e["dst"]])
        assert "".join(out) + x[at:] == y
    assert E.align_pairs(["", ""], ["", "A"]) == [b"", b"I"]


def test_script_columns(spark):
    rows = [(1, "ACGT", "ACGT"), (2, "AAAC", "AAC"), (3, None, "A"), (4, "", ""), (5, "ACGTACGT", "TCGTTTACG")]
    got = {r["id"]: r for r in E.edit_scripts(spark.createDataFrame(rows, "id long, a string, b string"), "a", "b").collect()}
    assert got[1]["visual"] == "MMMM" and got[1]["script"] == []
    assert got[2]["visual"] == "DMMM" and tuple(got[2]["script"][0]) == ("D", 0, 0)
    assert got[3]["script"] is None and got[4]["visual"] == ""
    frame = spark.createDataFrame([("MMDDMIRMMD",)], "v string")
    r = frame.select(E.edit_counts(F.col("v")).alias("c"), E.densest_window(F.col("v"), 4).alias("w"), E.patterns(F.col("v")).alias("p"), E.bursts(F.col("v"), "D").alias("d")).first()
    assert tuple(r["c"]) == (5, 1, 3, 1) and r["w"] == 3 and r["p"] == ["DD", "IR", "D"] and r["d"] == [2, 1]


def test_star_rows_keep_their_reads():
    for _ in range(30):
        base = strand(25)
        reads = ["".join(c for c in base if R.random() > 0.1) + strand(R.randint(0, 2)) for _ in range(5)]
        rows = G.star_rows(reads)
        assert len({len(r) for r in rows}) == 1 and [r.replace("-", "") for r in rows] == reads
    assert G.star_rows([]) == []


def test_mutations_at_a_distance(spark):
    rows = [(i, strand(R.randint(3, 60))) for i in range(60)]
    made = spark.createDataFrame(rows, "id long, dna string")
    made = made.select("dna", N.mutate_at_distance(F.col("dna"), 3, 1, F.col("id")).alias("three"), N.mutate_same_length(F.col("dna"), 2, F.col("id")).alias("two"))
    for r in made.collect():
        assert sum(a != b for a, b in zip(r["dna"], r["three"])) == 3 and len(r["three"]) == len(r["dna"])
        assert len(r["two"]) == len(r["dna"]) and (len(r["dna"]) < 12 or distance(r["dna"], r["two"]) == 2)


def test_downsampling_keeps_an_exact_share(spark):
    rows = spark.range(1000)
    for share in (0.0, 0.3, 0.999, 1.0):
        kept = {r["id"] for r in N.downsample(rows.repartition(3), share, 5, "id").collect()}
        assert len(kept) == -(-round((1 - share) * 1000) // 1)
    assert {r["id"] for r in N.downsample(rows, 0.3, 5, "id").collect()} == {r["id"] for r in N.downsample(rows.repartition(7), 0.3, 5, "id").collect()}


def test_channels_and_distributions_by_name(spark):
    rows = spark.createDataFrame([(i, strand(40)) for i in range(20)], "id long, dna string")
    for name in N.channel_names()["channels"]:
        options = {"rates": [0.1] * 40} if name == "rates" else {}
        assert rows.select(N.open_channel(name, F.col("dna"), 1, F.col("id"), **options).alias("x")).where("x is null").count() == 0
    counts = rows.select(N.open_distribution("poisson", N.u32(1, "n", F.col("id")), mean=5.0).alias("n"), N.open_distribution("bernoulli", N.u32(1, "n", F.col("id")), p=0.5, n=3).alias("b"))
    assert 1 < counts.agg(F.avg("n")).first()[0] < 10 and {r["b"] for r in counts.collect()} <= {0, 3}
    for opener in (lambda: N.open_channel("none", F.col("dna"), 1), lambda: N.open_distribution("none", F.lit(1))):
        try:
            opener()
        except ValueError as e:
            assert "known" in str(e)
        else:
            raise AssertionError


def test_places_are_drawn_once_a_strand(spark):
    import time

    from pyspark.sql import functions as F
    from strandlake.operators.channel import mutate_at_distance

    rows = spark.range(8).select("id", F.repeat(F.lit("ACGTTGCA"), 500).alias("dna"))
    began = time.time()
    got = rows.select("dna", mutate_at_distance(F.col("dna"), 3, 1, F.col("id")).alias("new")).collect()
    assert all(sum(a != b for a, b in zip(r["dna"], r["new"])) == 3 and len(r["new"]) == 4000 for r in got)
    # 128 million draws if they were made anew for each base
    assert time.time() - began < 15
