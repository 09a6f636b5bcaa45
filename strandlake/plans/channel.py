"""The whole path of a strand through a noisy channel, and its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import convert as C
from ..functions.gf import crc8_table
from ..functions.rng import RANGE, sql_u32, threshold, u32
from ..operators import channel as N
from ..operators.codes import spread
from .base import STRANDS, Family, big, sql_bytes, strands, table

family = Family()
add = family.add
LIMIT = threshold(0.02)

_TABLE = str(crc8_table().tolist())
_HIT = sql_u32(11, "sub", "id", "i")
_STEP = sql_u32(11, "sub", "id", "i", lane=1)


@add(
    "archive_roundtrip",
    f"""WITH d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
s AS (SELECT doc_id, unnest(range(0, (length(h) + 79) // 80)) AS strand, h FROM d),
p AS (SELECT doc_id, strand, doc_id * 100000 + strand AS id, rpad(substr(h, (80 * strand + 1)::INT, 80), 80, '0') AS h FROM s),
b AS (SELECT doc_id, strand, id, {sql_bytes('h')} AS b FROM p),
c AS (SELECT doc_id, strand, id, b, list_append(b, list_reduce(list_prepend(0, b), lambda a, x: ({_TABLE})[xor(a, x) + 1])) AS cw FROM b),
e AS (SELECT doc_id, strand, id, b, array_to_string(list_transform(cw, lambda v: substr('{C.base_lut(4, 4)}', 4 * v + 1, 4)), '') AS dna FROM c),
n AS (SELECT doc_id, id, b, array_to_string(list_transform(range(0, length(dna)), lambda i: CASE WHEN {_HIT} < {threshold(0.003)} THEN substr('ACGTACGT', (instr('ACGT', substr(dna, (i + 1)::INT, 1)) + {_STEP} % 3 + 1)::INT, 1) ELSE substr(dna, (i + 1)::INT, 1) END), '') AS noisy FROM e),
v AS (SELECT doc_id, b, list_transform(range(0, 41), lambda k: list_sum(list_transform(range(0, 4), lambda j: (instr('ACGT', substr(noisy, (4 * k + j + 1)::INT, 1)) - 1) * (4 ** j)::INT))::INT) AS got FROM n),
w AS (SELECT doc_id, list_reduce(list_prepend(0, got), lambda a, x: ({_TABLE})[xor(a, x) + 1]) = 0 AS ok, len(list_filter(range(1, 41), lambda k: got[k] <> b[k])) AS wrong FROM v)
SELECT doc_id, count(*)::BIGINT AS strands, sum(ok::INT)::BIGINT AS passed, sum(CASE WHEN ok THEN wrong ELSE 0 END)::BIGINT AS wrong_bytes FROM w GROUP BY doc_id""",
)
def archive_roundtrip(spark, sf):
    """Documents to 40-byte strands with checksum, base-4, substitutions, and back: what passes, and how right it is."""
    docs = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    return N.store_and_read(spread(docs), 40, threshold(0.003), 11)


def _sql_count(cdf, draw):
    return f"len(list_filter([{', '.join(str(int(c * RANGE)) for c in cdf)}]::BIGINT[], lambda s: s <= {draw}))::BIGINT"


POISSON, NEGBIN = N.poisson_cdf(10), N.negative_binomial_cdf(10, 30)


@add("reads_poisson", f"SELECT p_partkey AS id, {_sql_count(POISSON, sql_u32(1, 'reads', 'p_partkey'))} AS n FROM part")
def reads_poisson(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), N.draw_count(POISSON, u32(1, "reads", F.col("p_partkey"))).alias("n"))


@add("reads_negbin", f"SELECT p_partkey AS id, {_sql_count(NEGBIN, sql_u32(2, 'reads', 'p_partkey'))} AS n FROM part")
def reads_negbin(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), N.draw_count(NEGBIN, u32(2, "reads", F.col("p_partkey"))).alias("n"))


@add("reads_bernoulli", f"SELECT p_partkey AS id, CASE WHEN {sql_u32(3, 'reads', 'p_partkey')} < {threshold(0.8)} THEN 5 ELSE 0 END::BIGINT AS n FROM part WHERE p_size IN (SELECT n_nationkey FROM nation)")
def reads_bernoulli(spark, sf):
    listed = table(spark, sf, "nation").select(F.col("n_nationkey").alias("p_size"))
    return table(spark, sf, "part").join(listed, "p_size", "left_semi").select(F.col("p_partkey").alias("id"), N.bernoulli_count(u32(3, "reads", F.col("p_partkey")), 0.8, 5).alias("n"))


_FLIP = sql_u32(4, "flip", "id", "copy_no")


@add("replicate", f"WITH {STRANDS}, r AS (SELECT id, dna, unnest(range(0, id % 4)) AS copy_no FROM strands) SELECT id, copy_no, {_FLIP} % 2 = 1 AS is_reversed, CASE WHEN {_FLIP} % 2 = 1 THEN reverse(translate(dna, 'ACGT', 'TGCA')) ELSE dna END AS dna FROM r")
def replicate(spark, sf):
    reads = N.replicate(strands(spark, sf).select("id", "dna"), F.col("id") % 4, flip_seed=4)
    return reads.select("id", big(F.col("copy_no"), "copy_no"), "is_reversed", "dna")


@add("replicate_compressed", f"WITH {STRANDS} SELECT dna, count(*)::BIGINT AS pool FROM strands GROUP BY dna")
def replicate_compressed(spark, sf):
    return strands(spark, sf).groupBy("dna").agg(F.count(F.lit(1)).alias("pool"))


def _sql_mutate(limit: str, seed: int) -> str:
    hit, kind, base = (sql_u32(seed, "site", "id", "i", lane=k) for k in range(3))
    b = "substr(dna, (i + 1)::INT, 1)"
    return f"array_to_string(list_transform(range(0, length(dna)), lambda i: CASE WHEN NOT ({hit} < {limit}) THEN {b} WHEN {kind} % 3 = 0 THEN substr(translate('ACGT', {b}, ''), ({base} % 3)::INT + 1, 1) WHEN {kind} % 3 = 1 THEN '' ELSE substr('ACGT', ({base} % 4)::INT + 1, 1) || {b} END), '')"


@add("inject_fixed", f"WITH {STRANDS} SELECT id, {_sql_mutate(str(LIMIT), 5)} AS dna FROM strands")
def inject_fixed(spark, sf):
    return strands(spark, sf).select("id", "dna").select("id", N.mutate(F.col("dna"), LIMIT, 5, F.col("id")).alias("dna"))


RATES = [threshold(min(0.2, 0.002 * k)) for k in range(60)]


@add("inject_position", f"WITH {STRANDS} SELECT id, {_sql_mutate(f'coalesce(({RATES}::BIGINT[])[i + 1], 0)', 6)} AS dna FROM strands")
def inject_position(spark, sf):
    rates = F.array(*map(F.lit, RATES)).cast("array<bigint>")
    return strands(spark, sf).select("id", "dna").select("id", N.mutate(F.col("dna"), 0, 6, F.col("id"), rates=rates).alias("dna"))


@add("inject_pattern", f"WITH {STRANDS} SELECT id, substr(dna, 1, 10) || translate(substr(dna, 12, 1), 'ACGT', 'CGTA') || translate(substr(dna, 13, 1), 'ACGT', 'GTAC') || substr(dna, 13) AS dna FROM strands")
def inject_pattern(spark, sf):
    return strands(spark, sf).select("id", N.apply_pattern(F.col("dna"), F.lit(10), "DRI").alias("dna"))


_HITK, _KINDK = sql_u32(8, "kmer", "id", "i"), sql_u32(8, "kmer", "id", "i", lane=1)


@add("inject_kmer", f"WITH {STRANDS} SELECT id, array_to_string(list_transform(range(0, length(dna)), lambda i: CASE WHEN {_HITK} >= CASE WHEN regexp_matches(substr(dna, greatest(i - 4, 1)::INT, least(i + 1, 6)::INT), 'AAA|CCC|GGG|TTT') THEN {threshold(0.10)} ELSE {threshold(0.025)} END THEN substr(dna, (i + 1)::INT, 1) WHEN {_KINDK} % 2 = 0 THEN '' ELSE translate(substr(dna, (i + 1)::INT, 1), 'ACGT', 'GTAC') END), '') AS dna FROM strands")
def inject_kmer(spark, sf):
    return strands(spark, sf).select("id", "dna").select("id", N.kmer_channel(F.col("dna"), 6, 8, F.col("id")).alias("dna"))


@add("downsample", f"SELECT p_partkey AS id FROM part QUALIFY row_number() OVER (ORDER BY {sql_u32(0, 'down', 'p_partkey')}, p_partkey) <= ceil(0.6 * count(*) OVER ())")
def downsample(spark, sf):
    return N.downsample(table(spark, sf, "part"), 0.4, 0, "p_partkey").select(F.col("p_partkey").alias("id"))


@add("seq_replay", "SELECT event_id, p_name FROM events JOIN part ON p_partkey = user_id")
def seq_replay(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.col("event_id").alias("record_id"))
    mapping = table(spark, sf, "events").select(F.col("event_id").alias("record_id"), F.col("user_id").alias("index"))
    return N.replay(events, mapping, table(spark, sf, "part").select(F.col("p_partkey").alias("index"), "p_name")).select("event_id", "p_name")


@add("channel", f"WITH {STRANDS}, r AS (SELECT id * 10 + k AS id, dna FROM (SELECT id, dna, unnest(range(0, id % 4)) AS k FROM strands)) SELECT id, {_sql_mutate(str(LIMIT), 9)} AS dna FROM r")
def channel(spark, sf):
    reads = N.replicate(strands(spark, sf).select("id", "dna"), F.col("id") % 4)
    return reads.select((F.col("id") * 10 + F.col("copy_no")).alias("id"), "dna").select("id", N.mutate(F.col("dna"), LIMIT, 9, F.col("id")).alias("dna"))


_BACK = "list_transform(range(0, length(dna) // 4), lambda k: list_sum(list_transform(range(0, 4), lambda j: (instr('ACGT', substr(noisy, (4 * k + j + 1)::INT, 1)) - 1) * (4 ** j)::INT))::INT)"


@add("monte_carlo", f"WITH {STRANDS}, r AS (SELECT id * 100 + k AS id, k AS sim, dna FROM (SELECT id, dna, unnest(range(0, 3)) AS k FROM strands)), n AS (SELECT sim, dna, array_to_string(list_transform(range(0, length(dna)), lambda i: CASE WHEN {_HIT} < {threshold(0.003)} THEN substr('ACGTACGT', (instr('ACGT', substr(dna, (i + 1)::INT, 1)) + {_STEP} % 3 + 1)::INT, 1) ELSE substr(dna, (i + 1)::INT, 1) END), '') AS noisy FROM r), b AS (SELECT sim, dna = noisy AS same, {_BACK} AS got, {_BACK.replace('noisy', 'dna')} AS stored FROM n) SELECT sim, count(*)::BIGINT AS strands, sum(same::INT)::BIGINT AS intact, sum(len(stored))::BIGINT AS bytes, sum(len(list_filter(range(1, len(stored) + 1), lambda k: got[k] <> stored[k])))::BIGINT AS wrong FROM b GROUP BY sim")
def monte_carlo(spark, sf):
    """Encode once; for each simulation channel, decode and compare byte by byte."""
    coded = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), C.utf8_bytes(F.col("p_name")).alias("cw"))
    coded = coded.select("id", "cw", C.base4_encode(F.col("cw")).alias("dna"))
    sims = N.simulations(coded, 3).withColumn("noisy", N.substitute_only(F.col("dna"), threshold(0.003), 11, F.col("id") * 100 + F.col("sim")))
    back = sims.select("sim", "cw", (F.col("dna") == F.col("noisy")).alias("same"), C.base4_decode(F.col("noisy")).alias("got"))
    wrong = F.size(F.filter(F.arrays_zip("cw", "got"), lambda p: ~p["cw"].eqNullSafe(p["got"])))
    return back.groupBy("sim").agg(F.count(F.lit(1)).alias("strands"), F.count_if("same").alias("intact"), big(F.sum(F.size("cw")), "bytes"), big(F.sum(wrong), "wrong"))