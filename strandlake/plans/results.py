"""Votes, probes, statistics, sweeps and analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import convert as C
from ..functions.strand import at
from ..operators import aggregate as A
from .base import STRANDS, Family, big, strands, table

family = Family()
add = family.add


ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount"]


def lines(spark, sf):
    return table(spark, sf, "lineitem")


@add("majority_vote", "WITH c AS (SELECT l_orderkey, pos, v, count(*) AS n FROM (SELECT l_orderkey, unnest([0, 1, 2]) AS pos, unnest([l_linenumber::BIGINT % 2, l_partkey % 3, l_suppkey % 2]) AS v FROM lineitem) GROUP BY ALL), b AS (SELECT l_orderkey, pos, v FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey, pos ORDER BY n DESC, v) = 1) SELECT l_orderkey, string_agg(v::VARCHAR, ',' ORDER BY pos) AS vote FROM b GROUP BY l_orderkey")
def majority_vote(spark, sf):
    reads = lines(spark, sf).select("l_orderkey", F.array((F.col("l_linenumber") % 2).cast("bigint"), F.col("l_partkey") % 3, F.col("l_suppkey") % 2).alias("cw"))
    return A.majority_vote(reads, "l_orderkey", "cw").select("l_orderkey", F.array_join(F.col("cw").cast("array<string>"), ",").alias("vote"))


@add("last_vote", "SELECT l_orderkey, max_by(l_partkey, (l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY l_orderkey")
def last_vote(spark, sf):
    return A.last_vote(lines(spark, sf), "l_orderkey", F.struct("l_linenumber", "l_partkey"), "l_partkey")


@add("column_consensus", f"WITH {STRANDS}, l AS (SELECT id // 5 AS cluster, dna, max(length(dna)) OVER (PARTITION BY id // 5) AS n FROM strands), m AS (SELECT cluster, rpad(dna, n::INT, '-') AS a, n FROM l), p AS (SELECT cluster, pos, substr(a, (pos + 1)::INT, 1) AS b FROM (SELECT cluster, a, unnest(range(0, n)) AS pos FROM m)), c AS (SELECT cluster, pos, b, count(*) AS n FROM p GROUP BY ALL), w AS (SELECT cluster, pos, b FROM c QUALIFY row_number() OVER (PARTITION BY cluster, pos ORDER BY n DESC, instr('ACGT-', b)) = 1) SELECT cluster, replace(string_agg(b, '' ORDER BY pos), '-', '') AS consensus FROM w GROUP BY cluster")
def column_consensus(spark, sf):
    members = strands(spark, sf).select(F.floor(F.col("id") / 5).cast("bigint").alias("cluster"), "dna")
    longest = members.groupBy("cluster").agg(F.max(F.length("dna")).alias("n"))
    return A.column_consensus(members.join(longest, "cluster").select("cluster", F.rpad("dna", F.col("n"), F.lit("-")).alias("a")), "cluster", "a")


@add("cluster_purity", "WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, sum(n)::BIGINT AS size, round((max(n) / sum(n))::DOUBLE, 9) AS purity FROM c GROUP BY l_suppkey")
def cluster_purity(spark, sf):
    return A.purity(lines(spark, sf), "l_suppkey", "l_returnflag").select("l_suppkey", "size", F.round("purity", 9).alias("purity"))


@add("ideal_cluster", "SELECT l_orderkey, count(*)::BIGINT AS size FROM lineitem GROUP BY l_orderkey")
def ideal_cluster(spark, sf):
    return lines(spark, sf).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("size"))


_KMER = "list_transform(range(0, length(dna) - 4), lambda i: list_sum(list_transform(range(0, 5), lambda j: (instr('AGCT', substr(dna, (i + j + 1)::INT, 1)) - 1) * (4 ** j)::BIGINT))::BIGINT)"


def _kmers(dna):
    """5-mers as little-endian base-4 numbers over A, G, C, T."""
    return F.transform(C.indexes(F.length(dna) - 4), lambda i: C.from_digits(F.substr(dna, i + 1, F.lit(5)), 4, "AGCT"))


@add("kmer_shingles", f"WITH {STRANDS}, k AS (SELECT id, {_KMER} AS k FROM strands) SELECT id, len(k)::BIGINT AS n, len(list_distinct(k))::BIGINT AS different, list_sum(k)::BIGINT AS total FROM k")
def kmer_shingles(spark, sf):
    k = strands(spark, sf).select("id", "dna").select("id", _kmers(F.col("dna")).alias("k"))
    return k.select("id", big(F.size("k"), "n"), big(F.size(F.array_distinct("k")), "different"), F.aggregate("k", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


PRIME = 4294967291
#: Fifty min-hashes; sixteen bands of four of them, which wrap around.
M, N_BANDS, SAMPLES = 50, 16, 4
HASHES = [((2654435761 * (2 * h + 1)) % (1 << 31), (40503 * (h + 7) ** 3) % (1 << 31)) for h in range(M)]
_SIG = ", ".join(f"list_min(list_transform(k, lambda x: ({a} * x + {b}) % {PRIME}))" for a, b in HASHES)
# Copies of a strand are one row, its smallest id, from here on.
_BANDS = f"WITH {STRANDS}, u AS (SELECT min(id) AS id, dna FROM strands GROUP BY dna), k AS (SELECT id, dna, {_KMER} AS k FROM u), s AS (SELECT id, dna, [{_SIG}] AS sig FROM k), b AS (SELECT id, dna, unnest(range(0, {N_BANDS})) AS band, sig FROM s), g AS (SELECT id, dna, band, array_to_string(list_transform(range(0, {SAMPLES}), lambda j: sig[({SAMPLES} * band + j) % {M} + 1]::VARCHAR), ':') AS key FROM b), p AS (SELECT DISTINCT x.id AS a, y.id AS b, x.dna AS da, y.dna AS db FROM g x JOIN g y ON x.band = y.band AND x.key = y.key AND x.id < y.id)"


def _least_hash(a, b):
    return F.array_min(F.transform("k", lambda x: (F.lit(a) * x + b) % PRIME))


def distinct_strands(spark, sf):
    return strands(spark, sf).groupBy("dna").agg(F.min("id").alias("id"))


def _signatures(reads):
    k = reads.select("id", "dna").select("id", "dna", _kmers(F.col("dna")).alias("k"))
    sig = F.array(*[_least_hash(a, b) for a, b in HASHES])
    return k.select("id", "dna", sig.alias("sig"))


@add("minhash_sig", f"WITH {STRANDS}, k AS (SELECT id, {_KMER} AS k FROM strands) SELECT id, array_to_string(list_transform([{_SIG}], lambda v: v::VARCHAR), ',') AS sig FROM k")
def minhash_sig(spark, sf):
    """Copies of a strand have one signature, made once."""
    made = _signatures(distinct_strands(spark, sf)).select("dna", F.array_join(F.col("sig").cast("array<string>"), ",").alias("sig"))
    return strands(spark, sf).select("id", "dna").join(made, "dna").select("id", "sig")


def _pairs(spark, sf):
    """Pairs of different strands that share a band and are near by edit distance."""
    bands = _signatures(distinct_strands(spark, sf)).select("id", "dna", F.posexplode(F.transform(C.indexes(N_BANDS), lambda b: F.array_join(F.transform(C.indexes(SAMPLES), lambda j: F.element_at("sig", F.pmod(b * SAMPLES + j, F.lit(M)) + 1).cast("string")), ":"))).alias("band", "key"))
    x, y = bands.alias("x"), bands.alias("y")
    met = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")))
    pairs = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.dna").alias("da"), F.col("y.dna").alias("db")).distinct()
    return pairs.where(F.levenshtein("da", "db") < 0.338 * F.length("da")).select("a", "b")


_NEAR = "SELECT a, b FROM p WHERE levenshtein(da, db) < 0.338 * length(da)"


@add("lsh_pairs", f"{_BANDS} {_NEAR}")
def lsh_pairs(spark, sf):
    return _pairs(spark, sf)


@add("position_counts", "SELECT l_linenumber::BIGINT AS pos, l_returnflag AS op, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def position_counts(spark, sf):
    return lines(spark, sf).groupBy(big(F.col("l_linenumber"), "pos"), F.col("l_returnflag").alias("op")).agg(F.count(F.lit(1)).alias("n"))


@add("del_bursts", "WITH r AS (SELECT event_type, event_id, event_id - row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY event_id) AS g, user_id % 3 AS lane FROM events) SELECT event_type, lane, min(event_id) AS start, count(*)::BIGINT AS length FROM r GROUP BY event_type, lane, g")
def del_bursts(spark, sf):
    rows = table(spark, sf, "events").select("event_type", (F.col("user_id") % 3).alias("lane"), "event_id")
    return A.islands(rows, ["event_type", "lane"], "event_id")


@add("filtered_count", "SELECT count(*)::BIGINT AS total, sum((event_type = 'error')::INT)::BIGINT AS filtered FROM events")
def filtered_count(spark, sf):
    return table(spark, sf, "events").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "error").alias("filtered"))


@add("index_distribution", "SELECT user_id, count(*)::BIGINT AS reads, sum((event_type = 'view')::INT)::BIGINT AS views FROM events GROUP BY user_id")
def index_distribution(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("reads"), F.count_if(F.col("event_type") == "view").alias("views"))


@add("strand_check", f"WITH {STRANDS}, w AS (SELECT id, list_transform(range(0, length(dna) - 12), lambda i: len(list_filter(range(1, 13), lambda j: substr(dna, (i + j)::INT, 1) <> substr('ACGTTGCAACGT', j::INT, 1)))) AS d FROM strands) SELECT min(list_min(d))::BIGINT AS distance, min_by(id, (list_min(d), id)) AS id FROM w")
def strand_check(spark, sf):
    probe = "ACGTTGCAACGT"
    d = F.transform(C.indexes(F.length("dna") - 12), lambda i: F.size(F.filter(C.indexes(12), lambda j: F.substr("dna", i + j + 1, F.lit(1)) != F.substr(F.lit(probe), j + 1, F.lit(1)))))
    best = strands(spark, sf).select("id", "dna").select("id", F.array_min(d).alias("d"))
    return best.agg(big(F.min("d"), "distance"), F.min_by("id", F.struct("d", "id")).alias("id"))


@add("stats_counter", "SELECT event_type AS name, sum(value)::BIGINT AS total, count(*)::BIGINT AS n FROM (SELECT event_type, 2 AS value FROM events) GROUP BY event_type")
def stats_counter(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(big(F.sum(F.lit(2)), "total"), F.count(F.lit(1)).alias("n"))


@add("stats_merge", "SELECT event_type AS name, 'keyed' AS kind, user_id % 5 AS key, 2 * count(*)::BIGINT AS value FROM events GROUP BY ALL")
def stats_merge(spark, sf):
    store = table(spark, sf, "events").groupBy(F.col("event_type").alias("name"), F.lit("keyed").alias("kind"), F.lit(None).cast("int").alias("pos"), (F.col("user_id") % 5).alias("key")).agg(F.count(F.lit(1)).alias("value"))
    return A.merge_stats(store, store).select("name", "kind", "key", "value")


@add("histogram_auto", "WITH s AS (SELECT count(*) AS n, min(s_acctbal) AS lo, max(s_acctbal) AS hi, quantile_cont(s_acctbal, 0.25) AS q1, quantile_cont(s_acctbal, 0.75) AS q3 FROM supplier), w AS (SELECT *, ceil((hi - lo) / least((hi - lo) / (log2(n) + 1), 2 * (q3 - q1) * n ** (-1.0 / 3)))::BIGINT AS bins FROM s), g AS (SELECT unnest(range(0, bins)) AS bin FROM w), c AS (SELECT least(floor((s_acctbal - lo) / ((hi - lo) / bins)), bins - 1)::BIGINT AS bin, count(*) AS n FROM supplier, w GROUP BY 1) SELECT g.bin, coalesce(c.n, 0)::BIGINT AS n FROM g LEFT JOIN c ON g.bin = c.bin")
def histogram_auto(spark, sf):
    return A.histogram_auto(table(spark, sf, "supplier"), "s_acctbal").select("bin", "n")


@add("bins", "SELECT floor(value / 10)::BIGINT AS bin, count(*)::BIGINT AS n FROM events GROUP BY 1")
def bins(spark, sf):
    return A.fixed_bins(table(spark, sf, "events"), "value", 10.0)


@add("rolling_means", "WITH w AS (SELECT l_orderkey, l_linenumber, count(*) OVER q AS n, avg(l_quantity) OVER q AS a, exp(avg(ln(l_quantity)) OVER q) AS g, 3.0 / sum(1 / l_quantity) OVER q AS h FROM lineitem WINDOW q AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) SELECT l_orderkey, l_linenumber, round(a, 6) AS arithmetic, round(g, 6) AS geometric, round(h, 6) AS harmonic FROM w WHERE n = 3")
def rolling_means(spark, sf):
    out = A.rolling_means(lines(spark, sf).select("l_orderkey", *ORDER), ["l_orderkey"], ORDER, "l_quantity", 3)
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in ("arithmetic", "geometric", "harmonic")])


@add("kmer_ratio", "WITH w AS (SELECT l_orderkey, l_linenumber, count(*) OVER q AS n, sum(l_discount) OVER q / sum(l_quantity) OVER q AS r FROM lineitem WINDOW q AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) SELECT l_orderkey, l_linenumber, round(r, 12) AS ratio FROM w WHERE n = 4")
def kmer_ratio(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy(*ORDER).rowsBetween(0, 3)
    out = lines(spark, sf).select("l_orderkey", "l_linenumber", F.count(F.lit(1)).over(w).alias("n"), (F.sum("l_discount").over(w) / F.sum("l_quantity").over(w)).alias("r"))
    return out.where("n = 4").select("l_orderkey", "l_linenumber", F.round("r", 12).alias("ratio"))


@add("block_probability", "WITH RECURSIVE t(k, c) AS (SELECT 0, 1.0::DOUBLE UNION ALL SELECT k + 1, c * (40 - k) / (k + 1) FROM t WHERE k < 29), p AS (SELECT n_nationkey, 0.6 + n_nationkey / 100.0::DOUBLE AS p FROM nation) SELECT n_nationkey, round(1 - sum(c * p ** k * (1 - p) ** (40 - k)), 9) AS chance FROM t, p GROUP BY n_nationkey, p")
def block_probability(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.round(A.block_probability(40, 30, F.lit(0.6) + F.col("n_nationkey") / 100.0), 9).alias("chance"))


@add("depth_sweep", "SELECT n_nationkey, d::BIGINT AS depth, round(1 - (1 - 0.02 * (n_nationkey + 1)) ** d, 9) AS p FROM nation, range(1, 25) t(d)")
def depth_sweep(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(1), F.lit(24))).alias("d"))
    return rows.select("n_nationkey", big(F.col("d"), "depth"), F.round(1 - F.pow(1 - 0.02 * (F.col("n_nationkey") + 1), F.col("d")), 9).alias("p"))


_TERMS = "t(d, k, term) AS (SELECT d, 0, 255 * ln(1 - p) FROM designs UNION ALL SELECT t.d, k + 1, term + ln((255 - k) / (k + 1)) + ln(p / (1 - p)) FROM t JOIN designs USING (d) WHERE k < 254), m AS (SELECT d, p, s, a.parity, (SELECT sum(exp(term)) FROM t WHERE t.d = g.d AND k < 255 - a.parity) AS miss, ceil(1e6 / ((255 - a.parity) * s)) AS blocks FROM designs g, range(0, 255) a(parity))"
#: The least parity by summing binomial terms in a loop, for designs (d, p, s).
_SEARCH = f"{_TERMS}, f AS (SELECT p, s, min(parity)::INT AS parity FROM m WHERE 1 / greatest(1 - power(1 - miss, blocks), 1e-300) >= 1e6 AND miss < 1e-6 GROUP BY p, s)"


@add("outer_code_search", f"WITH RECURSIVE designs AS (SELECT n_nationkey AS d, 0.5 + n_nationkey / 51.0::DOUBLE AS p, n_nationkey + 30 AS s FROM nation), {_SEARCH} SELECT round(p, 9) AS p, s AS strand_bytes, parity FROM f")
def outer_code_search(spark, sf):
    designs = table(spark, sf, "nation").select((0.5 + F.col("n_nationkey") / 51).alias("p"), (F.col("n_nationkey") + 30).alias("strand_bytes")).distinct()
    return A.outer_code_search(designs).select(F.round("p", 9).alias("p"), "strand_bytes", "parity")


@add("pareto_frontier", "WITH b AS (SELECT p_size AS y, max(p_retailprice) AS x FROM part GROUP BY p_size), w AS (SELECT x, y, max(x) OVER (ORDER BY y DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM b) SELECT x, y::BIGINT AS y FROM w WHERE above IS NULL OR x > above")
def pareto_frontier(spark, sf):
    points = table(spark, sf, "part").select(F.col("p_retailprice").alias("x"), big(F.col("p_size"), "y"), F.col("p_brand").alias("label"))
    return A.pareto_frontier(points, "x", "y", "label").select("x", "y")


@add("blank_to_null", "SELECT doc_id, CASE WHEN NOT regexp_full_match(text, '[ \\t\\n\\r\\f]*') THEN text END AS t FROM documents")
def blank_to_null(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.when(~F.col("text").rlike(r"^[ \t\n\r\f]*$"), F.col("text")).alias("t"))


@add("arch_summary", "SELECT p_brand, count(*)::BIGINT AS n, min(p_size)::BIGINT AS low, max(p_size)::BIGINT AS high, sum(p_size)::BIGINT AS total FROM part GROUP BY p_brand")
def arch_summary(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), big(F.min("p_size"), "low"), big(F.max("p_size"), "high"), big(F.sum("p_size"), "total"))


@add("arch_filter", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice < 1500")
def arch_filter(spark, sf):
    return table(spark, sf, "part").where(F.col("p_size").between(10, 20) & (F.col("p_retailprice") < 1500)).select("p_partkey")


@add("decode_rate", "SELECT l_returnflag, l_linestatus, round(1 - sum((l_quantity > 40)::INT) / count(*)::DOUBLE, 9) AS rate FROM lineitem GROUP BY ALL")
def decode_rate(spark, sf):
    return lines(spark, sf).groupBy("l_returnflag", "l_linestatus").agg(F.round(1 - F.count_if(F.col("l_quantity") > 40) / F.count(F.lit(1)), 9).alias("rate"))


@add("speedup_quantiles", "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.85), 6) AS q85 FROM events GROUP BY event_type")
def speedup_quantiles(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(*[F.round(F.percentile("value", q), 6).alias(n) for q, n in ((0.25, "q25"), (0.85, "q85"))])


@add("unpivot_ranks", "SELECT l_orderkey, l_linenumber, u.kind, u.x FROM lineitem, LATERAL (VALUES ('l_discount', l_discount), ('l_quantity', l_quantity), ('l_tax', l_tax)) u(kind, x)")
def unpivot_ranks(spark, sf):
    return lines(spark, sf).unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "kind", "x")


@add("param_sweep", "SELECT a::BIGINT AS faults, b::BIGINT AS depth, c AS arch FROM (VALUES (1), (5), (10)) x(a), (VALUES (3), (5), (10), (15)) y(b), (VALUES ('rs'), ('hash')) z(c)")
def param_sweep(spark, sf):
    return A.sweep(spark, faults=[1, 5, 10], depth=[3, 5, 10, 15], arch=["rs", "hash"]).select(big(F.col("faults"), "faults"), big(F.col("depth"), "depth"), "arch")


@add("job_matrix", "SELECT r_name, n_name, substr(md5(n_name || ':' || r_name), 1, 8) AS run_dir FROM region, nation")
def job_matrix(spark, sf):
    r, n = table(spark, sf, "region").select("r_name"), table(spark, sf, "nation").select("n_name")
    # both axes are lists of settings, a few rows by nature
    return n.crossJoin(F.broadcast(r)).select("r_name", "n_name", F.substring(F.md5(F.concat_ws(":", "n_name", "r_name")), 1, 8).alias("run_dir"))


@add("byte_diff", "SELECT p_partkey AS id, (length(p_name) - length(translate(p_name, 'aeo', '')))::BIGINT AS mismatches, (p_partkey % 3)::BIGINT AS length_gap FROM part")
def byte_diff(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("t"))
    a = part.select("id", F.encode("t", "UTF-8").alias("data"))
    b = part.select("id", F.encode(F.concat(F.translate("t", "aeo", "XYZ"), F.repeat(F.lit("~"), (F.col("id") % 3).cast("int"))), "UTF-8").alias("data"))
    return A.byte_diff(a, b, "id")


@add("unindexed_lengths", "SELECT round(avg(length(p_name)), 9) AS mean, round(stddev_pop(length(p_name)), 9) AS deviation FROM part")
def unindexed_lengths(spark, sf):
    n = F.length("p_name")
    return table(spark, sf, "part").agg(F.round(F.avg(n), 9).alias("mean"), F.round(F.stddev_pop(n), 9).alias("deviation"))


@add("json_prefix", "SELECT event_id, 'run::' || k AS key, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_prefix(spark, sf):
    m = F.transform_keys(F.from_json("props", "map<string,string>"), lambda k, v: F.concat(F.lit("run::"), k))
    return table(spark, sf, "events").select("event_id", F.explode(m).alias("key", "value"))