"""Whole pipelines, streams, clusters and what is left of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import convert as C
from ..functions.rng import sql_u32, threshold
from ..functions.strand import reverse_complement
from ..operators import aggregate as A
from ..operators import archive as R
from ..operators import channel as N
from ..operators import cluster as G
from ..operators import pipeline as P
from ..operators.codes import spread
from ..operators.outer import Layout
from ..streaming import reads as S
from .base import STRANDS, Family, big, strands, table
from .results import _BANDS, _NEAR, _SEARCH, _pairs, distinct_strands

family = Family()
add = family.add
P5, P3 = "TAAAGGAAAAAGCCTTCGAT", "CAAAATATAAAACGTTACCG"


@add("pipeline_roundtrip", f"SELECT p_partkey AS id, p_name AS txt, 4 * (length(p_name) + 6) + 40 AS bases, '{P5}' || '|' || '{P3}' AS ends FROM part")
def pipeline_roundtrip(spark, sf):
    line = P.rs_base4(P5, P3, inner_ecc=6)
    coded = line.encode(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), C.utf8_bytes(F.col("p_name")).alias("cw")))
    seen = coded.withColumns({"bases": big(F.length("dna"), "bases"), "ends": F.concat_ws("|", F.substring("dna", 1, 20), F.substring("dna", -20, 20))})
    turned = seen.withColumn("dna", F.when(F.col("id") % 2 == 0, reverse_complement(F.col("dna"))).otherwise(F.col("dna")))
    return line.decode(turned).select("id", C.bytes_to_text(F.col("cw")).alias("txt"), "bases", "ends")


@add("rejected_reads", "SELECT p_partkey AS id FROM part WHERE p_partkey % 4 = 0")
def rejected_reads(spark, sf):
    line = P.rs_base4(P5, P3)
    coded = line.encode(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), C.utf8_bytes(F.col("p_name")).alias("cw")))
    return line.rejected(coded.withColumn("dna", F.when(F.col("id") % 4 == 0, F.lit("GC" * 60)).otherwise(F.col("dna")))).select("id")


@add("decode_chain", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'none' END AS line, CASE WHEN p_partkey % 3 < 2 THEN p_name END AS txt FROM part")
def decode_chain(spark, sf):
    """Two lines with primers of their own read one pool in turn; strands of neither are left."""
    lines = {"first": P.rs_base4(P5, P3), "second": P.rs_base4(P3[::-1], P5[::-1])}
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), C.utf8_bytes(F.col("p_name")).alias("cw"))
    pool = lines["first"].encode(rows.where("id % 3 = 0")).unionByName(lines["second"].encode(rows.where("id % 3 = 1")))
    pool = pool.unionByName(rows.where("id % 3 = 2").select("id", F.lit("GC" * 60).alias("dna")))
    found, rest = P.decode_chain(pool, lines)
    return found.select("id", "line", C.bytes_to_text(F.col("cw")).alias("txt")).unionByName(rest.select("id", F.lit("none").alias("line"), F.lit(None).cast("string").alias("txt")))


ARCHIVE = R.Design(layout=Layout(packet_bytes=60, strand_bytes=12, data=5, parity=2), header_layout=Layout(packet_bytes=160, strand_bytes=20, data=8, parity=3))


@add("archive_file", "SELECT s_suppkey AS file_id, s_name AS text, md5(s_name) AS md5, 's' || s_suppkey || '.txt' AS filename, TRUE AS sound FROM supplier")
def archive_file(spark, sf):
    """Files to strands and back, header first: one sub-packet in five is lost, half of the reads are reversed."""
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("file_id"), F.encode("s_name", "UTF-8").alias("content"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".txt")).alias("filename"))
    coded = R.write(names, ARCHIVE)
    place = F.split("id", "/")
    arrived = coded.where((F.element_at(place, 3).cast("int") + F.col("file_id")) % 5 != 4)
    turned = arrived.withColumn("dna", F.when(F.length("id") % 2 == 0, reverse_complement(F.col("dna"))).otherwise(F.col("dna")))
    return R.read(turned.select("file_id", "dna"), ARCHIVE).select("file_id", F.decode("content", "UTF-8").alias("text"), "md5", "filename", "sound")


@add("archive_strands", "SELECT s_suppkey AS file_id, 7::BIGINT AS data, 11 * ceil((34 + length('s' || s_suppkey || '.txt') + length('{\"inner_ecc\":4,\"layout\":{\"data\":5,\"packet_bytes\":60,\"parity\":2,\"strand_bytes\":12}}')) / 160.0)::BIGINT AS header, 40 + 4 * (5 + 12 + 4)::BIGINT AS bases FROM supplier")
def archive_strands(spark, sf):
    """How many strands files and headers take, and how long they are."""
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("file_id"), F.encode("s_name", "UTF-8").alias("content"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".txt")).alias("filename"))
    coded = R.write(names, ARCHIVE)
    data = F.col("id").startswith(f"{R.DATA_BARCODE}/")
    return coded.groupBy("file_id").agg(F.count_if(data).alias("data"), F.count_if(~data).alias("header"), big(F.max(F.when(data, F.length("dna"))), "bases"))


@add("lsh_cluster", f"{_BANDS.replace('WITH s0', 'WITH RECURSIVE s0')}, n AS ({_NEAR}), e AS (SELECT a AS x, b AS y FROM n UNION SELECT b, a FROM n), r(id, root) AS (SELECT DISTINCT x, x FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id WHERE r.root < e.y), c AS (SELECT id, min(root) AS cluster FROM r GROUP BY id), m AS (SELECT s.id, coalesce(c.cluster, u.id) AS cluster FROM strands s JOIN u ON s.dna = u.dna LEFT JOIN c ON c.id = u.id) SELECT id, cluster FROM m QUALIFY count(*) OVER (PARTITION BY cluster) >= 4")
def lsh_cluster(spark, sf):
    first = distinct_strands(spark, sf).withColumnRenamed("id", "first")
    members = strands(spark, sf).join(first, "dna").select("id", "first")
    return G.cluster_reads(members, _pairs(spark, sf), 4)


@add("msa_star")
def msa_star(spark, sf):
    pool = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), C.base4_encode(C.utf8_bytes(F.col("s_name"))).alias("dna"))
    reads = pool.select("id", F.explode(C.indexes(4)).alias("copy"), "dna").withColumn("dna", N.mutate(F.col("dna"), 1 << 27, 12, F.col("id"), F.col("copy")))
    return G.star_alignment(reads, "id", "copy", "dna")


@add("cluster_consensus", "SELECT s_suppkey AS cluster, s_name AS txt, 5::BIGINT AS weight FROM supplier")
def cluster_consensus(spark, sf):
    """Five reads a strand, each with another base wrong: aligned, voted, decoded."""
    pool = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), C.base4_encode(C.utf8_bytes(F.col("s_name"))).alias("dna"))
    at = F.col("copy") * 11 + F.col("id") % 7 + 3
    worn = F.concat(F.substr("dna", F.lit(1), at), F.translate(F.substr("dna", at + 1, F.lit(1)), "ACGT", "CGTA"), F.substr("dna", at + 2, F.length("dna")))
    reads = pool.select("id", F.explode(C.indexes(5)).alias("copy"), "dna").select("id", "copy", worn.alias("dna"))
    found = G.cluster_consensus(reads, "id", "copy", "dna")
    return found.select(F.col("id").alias("cluster"), C.bytes_to_text(C.base4_decode(F.col("consensus"))).alias("txt"), "weight")


_PLACES = f"(list_transform(list_sort(list_transform(range(0, length(dna)), lambda i: {{'u': {sql_u32(13, 'place', 'id', 'i')}, 'i': i}})), lambda x: x.i))[1:3]"


@add("mutate", f"WITH {STRANDS}, p AS (SELECT id, dna, {_PLACES} AS places FROM strands) SELECT id, array_to_string(list_transform(range(0, length(dna)), lambda i: CASE WHEN list_contains(places, i) THEN translate(substr(dna, (i + 1)::INT, 1), 'ACGT', 'CGTA') ELSE substr(dna, (i + 1)::INT, 1) END), '') AS dna FROM p")
def mutate(spark, sf):
    """Exactly three substitutions, at the three places with the least draws."""
    s = spread(strands(spark, sf).select("id", "dna"))
    return s.select("id", N.mutate_at_distance(F.col("dna"), 3, 13, F.col("id")).alias("dna"))


@add("mutate_ed", f"WITH {STRANDS} SELECT id, length(dna)::BIGINT AS n, 2::BIGINT AS edits FROM strands")
def mutate_ed(spark, sf):
    """A base goes and another comes elsewhere: the length stays, the edit distance is two."""
    s = strands(spark, sf).select("id", "dna").withColumn("new", N.mutate_same_length(F.col("dna"), 14, F.col("id")))
    return s.select("id", big(F.length("new"), "n"), big(F.levenshtein("dna", "new"), "edits"))


@add("inject_compressed", f"WITH {STRANDS}, c AS (SELECT id, unnest(range(0, id % 4)) AS k FROM strands), f AS (SELECT id, k, {sql_u32(14, 'pick', 'id', 'k')} < {threshold(0.25)} AS hit FROM c) SELECT id, sum((NOT hit)::INT)::BIGINT AS clean, sum(hit::INT)::BIGINT AS faulty FROM f GROUP BY id")
def inject_compressed(spark, sf):
    """A quarter of the reads of a pool of (strand, count) becomes faulty; their strands' clean counts fall."""
    pool = strands(spark, sf).select("id", (F.col("id") % 4).alias("count"))
    return N.split_counts(pool, "count", 0.25, 14, "id").where("count > 0").select("id", "clean", "faulty")


@add("chi_square", "WITH o AS (SELECT l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS total, count(*) AS bins FROM o) SELECT round(sum((n - total / bins) ** 2 / (total / bins))::DOUBLE, 6) AS chi2 FROM o, t")
def chi_square(spark, sf):
    o = table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return o.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("bins"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares")).select(F.round(F.col("squares") * F.col("bins") / F.col("total") - F.col("total"), 6).alias("chi2"))


@add("cost_curve", f"WITH RECURSIVE designs AS (SELECT n_nationkey AS d, 0.6 + n_nationkey / 64.0::DOUBLE AS p, 47 AS s FROM nation), {_SEARCH} SELECT round(p, 9) AS p, parity, u.depth, round((255 - parity) * 47 * 8 / (255 * 240.0::DOUBLE), 9) AS write_density, round((255 - parity) * 47 * 8 / (255 * 240.0::DOUBLE) / u.depth, 9) AS read_density FROM f, (VALUES (3), (5), (10)) u(depth)")
def cost_curve(spark, sf):
    designs = table(spark, sf, "nation").select((0.6 + F.col("n_nationkey") / 64).alias("p"), F.lit(47).alias("strand_bytes"))
    found = A.outer_code_search(designs)
    depth = F.explode(F.array(*map(F.lit, (3, 5, 10)))).alias("depth")
    density = (255 - F.col("parity")) * F.col("strand_bytes") * 8 / (255 * 240.0)
    rows = found.select(F.round("p", 9).alias("p"), "parity", depth, density.alias("write_density"))
    return rows.select("p", "parity", "depth", F.round("write_density", 9).alias("write_density"), F.round(F.col("write_density") / F.col("depth"), 9).alias("read_density"))


@add("stats_persist", "SELECT event_type || '=' || count(*) AS line FROM events GROUP BY event_type ORDER BY 1")
def stats_persist(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").count().select(F.concat_ws("=", "event_type", F.col("count").cast("string")).alias("line")).orderBy("line")


@add("run_collect", "SELECT s_suppkey AS id, s_acctbal AS balance, NULL::INT AS size FROM supplier UNION ALL SELECT p_partkey, NULL, p_size FROM part")
def run_collect(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    b = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    return a.unionByName(b, allowMissingColumns=True)


@add("lsh_bands", "SELECT n_nationkey, (1 / power(0.5, n_nationkey % 6))::BIGINT AS bands FROM nation")
def lsh_bands(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", (1 / F.pow(F.lit(0.5), F.col("n_nationkey") % 6)).cast("bigint").alias("bands"))


@add("stream_decode", "SELECT event_id, user_id * 2 AS strand FROM events WHERE event_type <> 'error'")
def stream_decode(spark, sf):
    stream = S.read_stream(spark, f"{sf}/events.parquet")
    return S.run_to_end(S.decode_arriving(stream, lambda df: df.where("event_type <> 'error'").select("event_id", (F.col("user_id") * 2).alias("strand"))))


@add("stream_windows", "WITH d AS (SELECT date_trunc('day', ts) AS d, event_type FROM events), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS late FROM events) SELECT strftime(d, '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n FROM d, m WHERE d + INTERVAL 1 DAY <= late GROUP BY 1, 2")
def stream_windows(spark, sf):
    """Windows that the watermark has closed."""
    counted = S.window_counts(S.read_stream(spark, f"{sf}/events.parquet"), "ts", "event_type")
    return S.run_to_end(counted).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")
