"""Files in strands and back, headers, decode chains, run directories."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from strandlake.functions.strand import reverse_complement
from strandlake.operators import archive as R
from strandlake.operators import pipeline as P
from strandlake.operators.outer import Layout
from strandlake.sources import runs
from strandlake.sources.dna import read_comments

DESIGN = R.Design(layout=Layout(120, 15, 5, 3), header_layout=Layout(160, 20, 8, 3))


def test_headers_round_trip():
    h = R.Header(12, hashlib.md5(b"x").hexdigest(), "ä.txt", params={"a": 1})
    assert R.Header.from_bytes(h.to_bytes() + b"\0\0") == h
    with pytest.raises(ValueError):
        R.Header.from_bytes(R.Header(1, "0" * 32, version=(9, 0)).to_bytes())
    with pytest.raises(ValueError):
        R.Header.from_bytes(R.Header(1, "0" * 32, format_id=1).to_bytes())


@pytest.fixture(scope="module")
def files(spark):
    r = random.Random(1)
    rows = [(1, bytearray(r.randbytes(700)), "a.bin"), (2, bytearray(b"short"), None), (3, bytearray(), "empty")]
    return spark.createDataFrame(rows, "file_id long, content binary, filename string")


def test_files_survive_losses_and_reversals(spark, files):
    coded = R.write(files, DESIGN)
    lost = F.element_at(F.split("id", "/"), 3).cast("int").isin(1, 4)
    seen = coded.where(~lost).withColumn("dna", F.when(F.xxhash64("id") % 2 == 0, reverse_complement(F.col("dna"))).otherwise(F.col("dna")))
    got = {r["file_id"]: r for r in R.read(seen.select("file_id", "dna"), DESIGN).collect()}
    for r in files.collect():
        assert bytes(got[r["file_id"]]["content"]) == bytes(r["content"]) and got[r["file_id"]]["sound"] and got[r["file_id"]]["filename"] == (r["filename"] or "")


def test_too_many_losses_are_seen(spark, files):
    coded = R.write(files, DESIGN)
    lost = F.col("id").startswith("204/") & F.element_at(F.split("id", "/"), 3).cast("int").isin(0, 1, 2, 3)
    got = {r["file_id"]: r["sound"] for r in R.read(coded.where(~lost).select("file_id", "dna"), DESIGN).collect()}
    assert not got[1] and not got[2] and got[3]
    assert R.read(coded.where("id like '204/%'").select("file_id", "dna"), DESIGN).count() == 0


def test_strand_files(spark, files, tmp_path):
    archive = R.Archive.open(spark, f"file://{tmp_path}/pool", layout=Layout(120, 15, 5, 3), header_layout=Layout(160, 20, 8, 3))
    archive.write(files)
    assert sorted((r["file_id"], bytes(r["content"]), r["sound"]) for r in archive.read().collect()) == sorted((r["file_id"], bytes(r["content"]), True) for r in files.collect())
    assert {r["key"]: r["value"] for r in read_comments(spark, f"file://{tmp_path}/pool").collect()} == {"format": "0x704", "version": "0.5"}
    for part in (tmp_path / "pool").glob("part-*"):
        lines = part.read_text().split("\n")
        assert len(lines) < 2 or lines[0].startswith("% format")
    with pytest.raises(ValueError):
        R.Archive.open(spark, "x", "nothing")


def test_hash_code_line(spark):
    line = P.line_of(0x0703, index_bytes=2, strand_bytes=6)
    rows = spark.createDataFrame([(i, [i, 7, *b"abcdef"]) for i in range(5)], "id long, cw array<int>")
    coded = line.encode(rows)
    at = F.col("id") + 30
    worn = coded.withColumn("dna", F.concat(F.substr("dna", F.lit(1), at), F.translate(F.substr("dna", at + 1, F.lit(1)), "ACGT", "CGTA"), F.substr("dna", at + 2, F.length("dna"))))
    assert {r["id"]: r["cw"] for r in line.decode(worn).collect()} == {i: [i, 7, *b"abcdef"] for i in range(5)}
    with pytest.raises(P.ConstructionError):
        P.line_of("nothing")
    assert P.parity_for(55, 10_000) == 255 - 182


def test_stages_by_name(spark):
    line = P.Pipeline([P.identity_stage(), P.snapshot_stage("stored"), P.barcode_stage(7, 9), P.base4_stage()])
    rows = spark.createDataFrame([(1, [1, 2, 3]), (2, [4, 5, 6])], "id long, cw array<int>")
    coded = line.encode(rows)
    assert {tuple(r["stored"]) for r in coded.collect()} == {(1, 2, 3), (4, 5, 6)}
    other = P.Pipeline([P.barcode_stage(7, 8), P.base4_stage()])
    assert line.decode(coded.drop("stored")).count() == 2 and other.decode(coded.drop("stored")).count() == 0


def test_run_directories(spark, tmp_path):
    for k in range(3):
        d = tmp_path / "runs" / f"r{k}"
        d.mkdir(parents=True)
        (d / "params.json").write_text(json.dumps({"depth": k, "arch": "rs"}))
        if k < 2:
            (d / "stats.json").write_text(json.dumps({"depth": 10 * k}) if k else "not json")
    root = f"file://{tmp_path}/runs"
    assert {r["dir"].rsplit("/", 1)[1]: r["files"] for r in runs.find_runs(spark, root, "stats").collect()} == {"r0": 1, "r1": 1}
    assert runs.list_files(spark, root, r"r[12]/params\.json$").count() == 2
    both = runs.collect_runs(runs.read_settings(spark, root, "params.json"), runs.read_settings(spark, root, "stats.json"), runs.read_settings(spark, root, "params.json", "p"))
    got = {r["dir"].rsplit("/", 1)[1]: r["settings"] for r in both.collect()}
    assert got["r1"] == {"arch": "rs", "depth": "10", "p::arch": "rs", "p::depth": "1"} and got["r0"]["depth"] == "0"


def test_result_and_stat_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1, 2])], "id long, xs array<int>")
    runs.write_results(rows, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out/parquet").first()["xs"] == [1, 2]
    assert runs.read_csv(spark, f"file://{tmp_path}/out/csv").first()["xs"] == "[1,2]"
    stats = spark.createDataFrame([("b", 2), ("a", 1), ("hist", 9)], "name string, value long")
    runs.write_stats(stats, f"file://{tmp_path}/stats")
    assert [r["value"] for r in spark.read.text(f"file://{tmp_path}/stats/stats").collect()] == ["a=1", "b=2", "hist=9"]
    runs.write_stats(stats, f"file://{tmp_path}/split", spark.createDataFrame([("hist", "h")], "name string, file string"))
    assert [r["value"] for r in spark.read.text(f"file://{tmp_path}/split/file=h").collect()] == ["hist=9"]
    (tmp_path / "rates.csv").write_text("Overall Error,0.1,0.2,0.3\n,,,\nDel,0.01,,0.03\n")
    assert [tuple(r) for r in runs.read_rates(spark, f"file://{tmp_path}/rates.csv", "Del").orderBy("pos").collect()] == [(0, 0.01), (2, 0.03)]


def test_restoring_is_correcting_a_filled_grid(spark):
    from pyspark.sql import functions as F
    from strandlake.operators import outer as O

    layout, key = O.Layout(packet_bytes=70, strand_bytes=8, data=4, parity=3), ["f", "p"]
    keys = spark.createDataFrame([(f, p) for f in (1, 2, None) for p in range(40)], "f long, p int")
    strands = keys.select("f", "p", F.explode(F.sequence(F.lit(0), F.lit(layout.strands - 1))).alias("strand"))
    strands = strands.select(*key, (F.col("strand") / layout.slots).cast("int").alias("sub"), (F.col("strand") % layout.slots).alias("slot"), F.unhex(F.substring(F.md5(F.concat_ws(":", "f", "p", "strand")), 1, 16)).alias("data"))
    coded = O.add_parity(strands, layout, key)
    assert coded.count() == 120 * layout.total * layout.slots and O.syndromes(coded, layout, key).where("worst > 0").count() == 0
    # out of order, some lost, some null, packets without any strand
    arrived = coded.where("p % 10 < 9 and abs(hash(f, p, sub, slot)) % 5 > 1").withColumn("data", F.when(F.expr("hash(p, sub, slot) % 11 != 0"), F.col("data"))).repartition(7)
    rows = lambda df: sorted((r["f"] or 0, r["p"], r["slot"], r["sub"], r["data"], r["ok"]) for r in df.withColumn("data", F.hex("data")).na.fill("none", ["data"]).collect())
    found = O.restore(keys, arrived, layout, key)
    got = rows(found)
    # fill_gaps joins by key, where a null finds nothing
    plain = [r for r in rows(O.correct(O.fill_gaps(keys.where("f is not null"), arrived, layout, key), layout, key))]
    assert [r for r in got if r[0]] == plain and {r[5] for r in got} == {True, False}
    whole = found.where("ok").join(strands.withColumnRenamed("data", "was"), [*key, "sub", "slot"])
    assert whole.count() > 100 and whole.where("data <> was").count() == 0


def test_syndromes_tell_damaged_slots(spark):
    from pyspark.sql import functions as F
    from strandlake.operators import outer as O

    layout = O.Layout(packet_bytes=40, strand_bytes=5, data=4, parity=2)
    strands = spark.range(60).select((F.col("id") % 20).alias("f"), F.col("id").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("strand"))
    coded = O.add_parity(strands.select("f", "p", (F.col("strand") / 2).cast("int").alias("sub"), (F.col("strand") % 2).alias("slot"), F.unhex(F.substring(F.md5(F.concat("p", "strand")), 1, 10)).alias("data")), layout, ["f", "p"])
    # the last byte of one strand of a slot
    worn = coded.withColumn("data", F.when(F.expr("p % 3 = 0 and sub = 5 and slot = 1"), F.unhex(F.concat(F.substring(F.hex("data"), 1, 8), F.lit("00")))).otherwise(F.col("data")))
    wrong = coded.join(worn.withColumnRenamed("data", "now"), ["f", "p", "sub", "slot"]).where("data <> now").select("p", "slot").distinct()
    found = O.syndromes(worn, layout, ["f", "p"])
    assert found.count() == 120 and {(r["p"], r["slot"]) for r in found.where("worst > 0").collect()} == {(r["p"], r["slot"]) for r in wrong.collect()} != set()


def test_draws_and_strands_in_arrays_are_those_of_columns(spark):
    from pyspark.sql import functions as F
    from strandlake.functions import convert as C
    from strandlake.functions import gf
    from strandlake.functions.rng import grid, threshold, u32
    from strandlake.operators import channel as N
    from strandlake.operators.codes import crc8_append

    ids = [0, 7, None, -3, 10**14]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(ids)], "k int, id long").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(120))))
    for lane, found in enumerate(grid(11, "sub", ids, 121, (0, 1, 2, 3))):
        assert all(int(found[r["k"], r["i"]]) == r["u"] for r in frame.select("k", "i", u32(11, "sub", F.col("id"), F.col("i"), lane=lane).alias("u")).collect())
    files = spark.createDataFrame([(1, b"x" * 100), (1, b"y"), (2, b""), (3, None), (None, b"z" * 41), (-4, bytes(range(200)))], "doc_id long, data binary")
    cut = files.where("length(data) > 0").select("doc_id", F.posexplode(F.transform(C.indexes(F.ceil(F.octet_length("data") / F.lit(40))), lambda i: F.expr("data").substr(i * 40 + 1, F.lit(40)))).alias("strand", "piece"))
    rows = cut.select("doc_id", (F.col("doc_id") * 100000 + F.col("strand")).alias("id"), F.transform(C.indexes(40), lambda i: F.conv(F.substr(F.hex(F.expr("rpad(piece, 40, X'00')")), 2 * i + 1, F.lit(2)), 16, 10).cast("int")).alias("b"))
    seen = rows.select("doc_id", "b", C.base4_decode(N.substitute_only(C.base4_encode(crc8_append(F.col("b"))), threshold(0.02), 11, F.col("id"))).alias("got"))
    wrong = F.size(F.filter(F.arrays_zip("b", F.slice("got", 1, 40).alias("g")), lambda p: p["b"] != p["g"]))
    want = seen.select("doc_id", (gf.crc8(F.col("got")) == 0).alias("ok"), wrong.alias("w")).groupBy("doc_id").agg(F.count("*"), F.count_if("ok"), F.sum(F.when(F.col("ok"), F.col("w")).otherwise(0)))
    got = N.store_and_read(files, 40, threshold(0.02), 11)
    key = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    assert key(got) == key(want) and got.count() == 3
