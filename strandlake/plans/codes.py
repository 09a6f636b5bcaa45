"""Packets, checksums, field arithmetic, inner and outer codes, the hash code."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import convert as C
from ..functions import gf
from ..functions.hedges import PATTERNS, Hedges
from ..functions.rng import u32
from ..functions.strand import reverse_complement
from ..operators import codes as K
from ..operators import outer as O
from ..operators import packets as P
from .base import Family, big, sql_bytes, strands, table

family = Family()
add = family.add
SIZE = 120
FILE_SQL = "SELECT doc_id AS file_id, encode(text) AS content, octet_length(encode(text))::BIGINT AS n_bytes FROM documents"


def files(spark, sf):
    content = F.encode("text", "UTF-8")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), content.alias("content"), big(F.octet_length(content), "n_bytes"))


@add("packetize", f"WITH f AS ({FILE_SQL}), p AS (SELECT file_id, hex(content) AS h, n_bytes, unnest(range(0, (n_bytes + {SIZE - 1}) // {SIZE})) AS packet_id FROM f) SELECT file_id, packet_id::BIGINT AS packet_id, rpad(substr(h, ({2 * SIZE} * packet_id + 1)::INT, {2 * SIZE}), {2 * SIZE}, '0') AS data FROM p")
def packetize(spark, sf):
    return P.packetize(files(spark, sf), SIZE).select("file_id", big(F.col("packet_id"), "packet_id"), F.hex("data").alias("data"))


@add("packet_count", f"WITH f AS ({FILE_SQL}) SELECT file_id, (n_bytes + {SIZE - 1}) // {SIZE} AS packets, (n_bytes - 1) % {SIZE} + 1 AS last FROM f")
def packet_count(spark, sf):
    return files(spark, sf).select("file_id", P.packet_count(F.col("n_bytes"), SIZE).alias("packets"), P.last_packet_size(F.col("n_bytes"), SIZE).alias("last"))


@add("missing_packets", f"WITH f AS ({FILE_SQL}), p AS (SELECT file_id, unnest(range(0, (n_bytes + {SIZE - 1}) // {SIZE})) AS packet_id FROM f) SELECT file_id, packet_id FROM p WHERE (file_id + packet_id) % 7 = 0")
def missing_packets(spark, sf):
    f = files(spark, sf)
    arrived = P.packetize(f, SIZE).where((F.col("file_id") + F.col("packet_id")) % 7 != 0)
    return P.missing_packets(f, arrived, SIZE).select("file_id", big(F.col("packet_id"), "packet_id"))


@add("reassemble", "SELECT doc_id AS file_id, text, TRUE AS complete FROM documents")
def reassemble(spark, sf):
    f = files(spark, sf)
    return P.reassemble(f, P.packetize(f, SIZE), SIZE).select("file_id", F.decode("content", "UTF-8").alias("text"), "complete")


@add("dna_lines", "SELECT p_partkey AS id, '(' || (p_partkey // 16) || ', ' || (p_partkey % 16) || '):' || p_name AS line FROM part")
def dna_lines(spark, sf):
    from ..sources.dna import strand_line

    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), strand_line(F.array(F.floor(F.col("p_partkey") / 16), F.col("p_partkey") % 16), F.col("p_name")).alias("line"))


CRC_TABLE = str(gf.crc8_table().tolist())
PART_BYTES = f"SELECT p_partkey AS id, {sql_bytes('hex(encode(p_name))')} AS b FROM part"


def codewords(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("txt"), C.utf8_bytes(F.col("p_name")).alias("cw"))


@add("crc8_encode", f"SELECT id, list_reduce(list_prepend(0, b), lambda a, x: ({CRC_TABLE})[xor(a, x) + 1])::BIGINT AS crc FROM ({PART_BYTES})")
def crc8_encode(spark, sf):
    return codewords(spark, sf).select("id", big(gf.crc8(F.col("cw")), "crc"))


@add("crc8_check", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS txt FROM part")
def crc8_check(spark, sf):
    coded = codewords(spark, sf).select("id", K.crc8_append(F.col("cw")).alias("cw"))
    worn = coded.select("id", F.when(F.col("id") % 3 == 0, F.transform("cw", lambda x, i: F.when(i == 2, x.bitwiseXOR(F.lit(64))).otherwise(x))).otherwise(F.col("cw")).alias("cw"))
    plain = worn.select("id", K.crc8_verify(F.col("cw")).alias("cw"))
    return plain.select("id", F.when(~F.exists("cw", lambda x: x.isNull()), C.bytes_to_text(F.col("cw"))).alias("txt"))


@add("crc8_index", f"WITH p AS (SELECT id, b, list_reduce(list_prepend(0, b[1:3]), lambda a, x: ({CRC_TABLE})[xor(a, x) + 1]) AS crc FROM ({PART_BYTES})) SELECT p_partkey AS id, p_name AS txt, array_to_string(b[1:3] || [crc] || b[4:], ',') AS coded FROM part JOIN p ON p.id = p_partkey")
def crc8_index(spark, sf):
    coded = codewords(spark, sf).select("id", K.crc8_index_insert(F.col("cw"), 3).alias("cw"))
    return coded.select("id", C.bytes_to_text(K.crc8_index_verify(F.col("cw"), 3)).alias("txt"), F.array_join(F.col("cw").cast("array<string>"), ",").alias("coded"))


@add("randomize", "SELECT p_partkey AS id, p_name AS txt FROM part")
def randomize(spark, sf):
    return K.randomize(K.randomize(codewords(spark, sf).drop("txt"), "cw", 2), "cw", 2).select("id", C.bytes_to_text(F.col("cw")).alias("txt"))


@add("gf_tables", "WITH RECURSIVE t(i, v) AS (SELECT 0, 1 UNION ALL SELECT i + 1, CASE WHEN v * 2 > 255 THEN xor(v * 2, 397) ELSE v * 2 END FROM t WHERE i < 254) SELECT i::BIGINT AS power, v::BIGINT AS value FROM t")
def gf_tables(spark, sf):
    exp, _ = gf.tables(8)
    return spark.range(255).select(F.col("id").alias("power"), big(F.element_at(gf._lit(exp[:255]), F.col("id").cast("int") + 1), "value"))


@add("gf_ops", "SELECT s_suppkey AS id, xor(s_nationkey::BIGINT, s_suppkey % 256) AS total, s_nationkey::BIGINT AS quotient_back, (s_suppkey % 256 > 0)::BIGINT AS unit FROM supplier WHERE s_suppkey % 256 > 0")
def gf_ops(spark, sf):
    s = table(spark, sf, "supplier").where(F.col("s_suppkey") % 256 > 0)
    a, b = F.col("s_nationkey"), (F.col("s_suppkey") % 256).cast("int")
    return s.select(
        F.col("s_suppkey").alias("id"), big(a.bitwiseXOR(b), "total"), big(gf.col_div(gf.col_mul(a, b), b), "quotient_back"), big(gf.col_mul(gf.col_pow(b, 3), gf.col_inverse(gf.col_mul(b, gf.col_mul(b, b)))), "unit")
    )


@add("gf_poly_eval", f"SELECT id, list_reduce(b, lambda a, x: xor(a, x))::BIGINT AS at_one FROM ({PART_BYTES})")
def gf_poly_eval(spark, sf):
    return codewords(spark, sf).select("id", big(gf.col_poly_eval(F.col("cw"), 1), "at_one"))


@add("rs_generator", "SELECT n::BIGINT AS nsym, 1::BIGINT AS lead, (n + 1)::BIGINT AS terms, 0::BIGINT AS at_roots FROM range(1, 31) t(n)")
def rs_generator(spark, sf):
    exp, _ = gf.tables(8)
    rows = spark.createDataFrame([(n, list(gf.generator(n))) for n in range(1, 31)], "nsym bigint, g array<int>")
    worst = F.array_max(gf.col_syndromes(F.col("g"), 1))
    return rows.select("nsym", big(F.element_at("g", 1), "lead"), big(F.size("g"), "terms"), big(worst, "at_roots"))


#: Part names filled up to 24 letters; longer ones stay whole.
PADDED = "p_name || repeat(' ', greatest(0, 24 - length(p_name))::INT)"


def payload(spark, sf):
    padded = F.concat("p_name", F.repeat(F.lit(" "), F.greatest(F.lit(24) - F.length("p_name"), F.lit(0))))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), C.utf8_bytes(padded).alias("cw"))


_EXP, _LOG = (str(t.tolist()) for t in gf.tables(8))


def _sql_parity(nsym: int) -> str:
    """Shift registers, a symbol a step: the parity of each row of payloads."""
    g = str(list(gf.generator(nsym)[1:]))
    step = f"list_transform(range(1, {nsym + 1}), lambda j: xor(coalesce(s[j + 1], 0), CASE WHEN xor(s[1], b[k + 1]) = 0 THEN 0 ELSE ({_EXP})[({_LOG})[xor(s[1], b[k + 1]) + 1] + ({_LOG})[({g})[j] + 1] + 1] END)::INT)"
    start = str([0] * nsym)
    return f"WITH RECURSIVE w AS (SELECT p_partkey AS id, {sql_bytes(f'hex(encode({PADDED}))')} AS b FROM part), r(id, k, b, s) AS (SELECT id, 0, b, {start}::INT[] FROM w UNION ALL SELECT id, k + 1, b, {step} FROM r WHERE k < len(b))"


def _sql_value(power: int) -> str:
    """The value of a code word c at a power of the field's generator."""
    row = str(gf.mul(np.arange(256), int(gf.tables(8)[0][power])).tolist())
    return f"list_reduce(list_prepend(0, c), lambda a, x: xor(({row})[a + 1], x))"


@add("rs_inner_encode", f"{_sql_parity(10)} SELECT id, array_to_string(b || s, ',') AS coded FROM r WHERE k = len(b)")
def rs_inner_encode(spark, sf):
    return K.rs_encode(payload(spark, sf), "cw", 10).select("id", F.array_join(F.col("cw").cast("array<string>"), ",").alias("coded"))


@add("rs_syndrome", f"{_sql_parity(6)}, c AS (SELECT id, list_transform(range(0, len(b) + 6), lambda i: xor((b || s)[i + 1], (i = id % 30)::INT)) AS c FROM r WHERE k = len(b)) SELECT id, concat_ws(',', {', '.join(_sql_value(i) for i in range(6))}) AS syndromes FROM c")
def rs_syndrome(spark, sf):
    coded = K.rs_encode(payload(spark, sf), "cw", 6)
    worn = F.transform("cw", lambda x, i: F.when(i == F.col("id") % 30, x.bitwiseXOR(F.lit(1))).otherwise(x))
    return coded.select("id", F.array_join(gf.col_syndromes(worn, 6).cast("array<string>"), ",").alias("syndromes"))


@add("rs_check", "SELECT p_partkey AS id, p_partkey % 2 = 0 AS ok FROM part")
def rs_check(spark, sf):
    coded = K.rs_encode(payload(spark, sf), "cw", 6)
    worn = F.transform("cw", lambda x, i: F.when((i == 3) & (F.col("id") % 2 == 1), x.bitwiseXOR(F.lit(9))).otherwise(x))
    return coded.select("id", (F.array_max(gf.col_syndromes(worn, 6)) == 0).alias("ok"))


@add("rs_inner_decode", f"SELECT p_partkey AS id, {PADDED} AS txt FROM part")
def rs_inner_decode(spark, sf):
    coded = K.rs_encode(K.spread(payload(spark, sf)), "cw", 10)
    # four erasures and three errors: 4 + 2 * 3 symbols of parity
    place = lambda k: (F.col("id") * 7 + k * 5) % 34
    lost, wrong = [place(k) for k in range(4)], [place(k) for k in range(4, 7)]
    worn = F.transform("cw", lambda x, i: F.when(i.isin(*lost), F.lit(None)).when(i.isin(*wrong), x.bitwiseXOR(F.lit(90))).otherwise(x))
    return K.rs_decode(coded.select("id", worn.alias("cw")), "cw", 10).select("id", C.bytes_to_text(F.col("cw")).alias("txt"))


LAYOUT = O.Layout(packet_bytes=600, strand_bytes=15, data=10, parity=4)
KEY = ["file_id", "packet_id"]


def placed(spark, sf):
    return O.strandize(P.packetize(files(spark, sf), LAYOUT.packet_bytes), LAYOUT, KEY)


@add("strandize", f"WITH f AS ({FILE_SQL}), p AS (SELECT file_id, hex(content) AS h, unnest(range(0, (n_bytes + 599) // 600)) AS packet_id FROM f), q AS (SELECT file_id, packet_id, rpad(substr(h, (1200 * packet_id + 1)::INT, 1200), 1200, '0') AS h, unnest(range(0, 40)) AS strand FROM p) SELECT file_id, packet_id, strand, substr(h, (30 * strand + 1)::INT, 30) AS data FROM q")
def strandize(spark, sf):
    return placed(spark, sf).select("file_id", big(F.col("packet_id"), "packet_id"), big(F.col("strand"), "strand"), F.hex("data").alias("data"))


@add("outer_index", f"WITH f AS ({FILE_SQL}), p AS (SELECT file_id, unnest(range(0, (n_bytes + 599) // 600)) AS packet_id FROM f), q AS (SELECT file_id, packet_id, unnest(range(0, 40)) AS strand FROM p) SELECT file_id, packet_id, strand // 4 AS sub, strand % 4 AS slot, count(*) AS n FROM q GROUP BY ALL")
def outer_index(spark, sf):
    return placed(spark, sf).groupBy("file_id", big(F.col("packet_id"), "packet_id"), big(F.col("sub"), "sub"), big(F.col("slot"), "slot")).agg(F.count(F.lit(1)).alias("n"))


@add("outer_layout", "SELECT d::BIGINT AS data, s::BIGINT AS strand_bytes, ceil(2700 / s)::BIGINT AS strands, ceil(ceil(2700 / s) / d)::BIGINT AS slots, ceil(log2(d + 75))::BIGINT AS sub_bits, ceil(log2(1000))::BIGINT AS packet_bits FROM (VALUES (30), (60), (180)) a(d), (VALUES (10), (15), (47)) b(s)")
def outer_layout(spark, sf):
    rows = []
    for d in (30, 60, 180):
        for s in (10, 15, 47):
            layout = O.Layout(2700, s, d, 75)
            packet, sub, _ = layout.index_bits(1000)
            rows.append((d, s, layout.strands, layout.slots, sub, packet))
    return spark.createDataFrame(rows, "data bigint, strand_bytes bigint, strands bigint, slots bigint, sub_bits bigint, packet_bits bigint")


@add("index_predicates", "SELECT l_orderkey, l_linenumber, l_orderkey % 16 < 14 AND l_linenumber % 8 < 4 AS valid, l_orderkey % 16 >= 10 AS parity FROM lineitem")
def index_predicates(spark, sf):
    sub, slot = F.col("l_orderkey") % 16, F.col("l_linenumber") % 8
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", O.is_valid(sub, slot, LAYOUT).alias("valid"), O.is_parity(sub, LAYOUT).alias("parity"))


@add("rs_outer_encode", f"WITH f AS ({FILE_SQL}) SELECT sum((n_bytes + 599) // 600)::BIGINT * 56 AS strands, 0::BIGINT AS worst FROM f")
def rs_outer_encode(spark, sf):
    coded = O.code_packets(P.packetize(files(spark, sf), LAYOUT.packet_bytes), LAYOUT, KEY)
    return O.packet_syndromes(coded, LAYOUT, KEY).agg((F.count(F.lit(1)) * 14).alias("strands"), big(F.max("worst"), "worst"))


@add("rs_outer_decode", "SELECT doc_id AS file_id, text FROM documents")
def rs_outer_decode(spark, sf):
    f = files(spark, sf)
    coded = O.add_parity(placed(spark, sf), LAYOUT, KEY)
    # any four of fourteen sub-packets may be lost: here those that the ids pick
    arrived = coded.where(F.pmod(F.col("sub") * 5 + F.col("file_id") + F.col("packet_id"), F.lit(14)) >= 4)
    keys = P.packetize(f, LAYOUT.packet_bytes).select(*KEY)
    fixed = O.restore(keys, arrived, LAYOUT, KEY)
    back = P.reassemble(f, O.join_strands(fixed, LAYOUT, KEY), LAYOUT.packet_bytes)
    return back.select("file_id", F.decode("content", "UTF-8").alias("text"))


@add("fill_gaps", f"WITH f AS ({FILE_SQL}), p AS (SELECT file_id, unnest(range(0, (n_bytes + 599) // 600)) AS packet_id FROM f), q AS (SELECT file_id, packet_id, unnest(range(0, 56)) AS place FROM p) SELECT file_id, count(*)::BIGINT AS places, sum((place >= 40 OR (file_id + place) % 5 = 0)::INT)::BIGINT AS lost FROM q GROUP BY file_id")
def fill_gaps(spark, sf):
    keys = P.packetize(files(spark, sf), LAYOUT.packet_bytes).select(*KEY)
    arrived = placed(spark, sf).where((F.col("file_id") + F.col("strand")) % 5 != 0)
    return O.fill_gaps(keys, arrived, LAYOUT, KEY).groupBy("file_id").agg(F.count(F.lit(1)).alias("places"), big(F.count_if(F.col("data").isNull()), "lost"))


@add("outer_decode", f"WITH f AS ({FILE_SQL}), p AS (SELECT file_id, hex(content) AS h, unnest(range(0, (n_bytes + 599) // 600)) AS packet_id FROM f), q AS (SELECT file_id, packet_id, rpad(substr(h, (1200 * packet_id + 1)::INT, 1200), 1200, '0') AS h, unnest(range(0, 40)) AS strand FROM p) SELECT file_id, packet_id, strand, substr(h, (30 * strand + 1)::INT, 30) AS data FROM q")
def outer_decode(spark, sf):
    """Three or four of fourteen sub-packets are lost; the data strands come back from the others."""
    coded = O.add_parity(placed(spark, sf), LAYOUT, KEY)
    keys = P.packetize(files(spark, sf), LAYOUT.packet_bytes).select(*KEY)
    fixed = O.restore(keys, coded.where(F.col("sub") % 4 != 1), LAYOUT, KEY)
    return fixed.select("file_id", big(F.col("packet_id"), "packet_id"), big(F.col("sub") * LAYOUT.slots + F.col("slot"), "strand"), F.hex("data").alias("data"))


CODE = Hedges(0.5, seq_bytes=2, message_bytes=20)


def named(spark, sf):
    """Supplier numbers (two bytes) and names, filled up to twenty letters, as codewords."""
    key = C.int_to_bytes(F.col("s_suppkey"), 2)
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(key, C.utf8_bytes(F.rpad("s_name", 20, " "))).alias("cw"))


#: The hash, a step a column, on numbers below 2^64 kept as larger ones.
_STEPS = (
    "(word * 3935559000370003845::UHUGEINT + 2691343689449507681::UHUGEINT) % 18446744073709551616::UHUGEINT",
    "xor(v0::UBIGINT, (v0 // 2097152)::UBIGINT)::UHUGEINT",
    "xor(v1::UBIGINT, (v1 * 137438953472::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT)::UHUGEINT",
    "xor(v2::UBIGINT, (v2 // 16)::UBIGINT)::UHUGEINT",
    "v3 * 4768777513237032717::UHUGEINT % 18446744073709551616::UHUGEINT",
    "xor(v4::UBIGINT, (v4 * 1048576::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT)::UHUGEINT",
    "xor(v5::UBIGINT, (v5 // 2199023255552)::UBIGINT)::UHUGEINT",
    "xor(v6::UBIGINT, (v6 * 32::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT)::UHUGEINT",
)


def _sql_hedges(codewords: str) -> str:
    """Strands of a code of one bit a base, a base a step, from a table (id, cw)."""
    bits = f"flatten(list_transform(cw, lambda b: list_transform(range(0, 8), lambda j: (b >> j::INT) & 1))) || {[0] * CODE.tail_bits}"
    inner = f"SELECT * REPLACE (CASE WHEN k = {CODE.seq_end} THEN 0 ELSE prev END AS prev, CASE WHEN k = {CODE.seq_end} THEN prev ELSE salt END AS salt), bits[k + 1] AS value, 2 * (length(recent) - length(translate(recent, 'AT', ''))) - length(recent) AS skew FROM r WHERE k < {CODE.length}"
    inner = f"SELECT *, CASE WHEN run > 2 THEN replace('ACGT', right(recent, 1), '') WHEN abs(skew) <= 3 THEN 'ACGT' WHEN skew > 0 THEN 'CG' ELSE 'AT' END AS choices, (k * 256 + prev % 256)::UHUGEINT * 4294967296::UHUGEINT + salt::UHUGEINT AS word FROM ({inner})"
    for i, step in enumerate(_STEPS):
        inner = f"SELECT *, {step} AS v{i} FROM ({inner})"
    inner = f"SELECT *, substr(choices, ((v7 % length(choices)::UHUGEINT)::INT + value) % length(choices) + 1, 1) AS symbol FROM ({inner})"
    step = f"SELECT id, k + 1, (prev * 2 + value) % 4294967296, salt, right(recent || symbol, 12), CASE WHEN right(recent, 1) = symbol THEN run + 1 ELSE 1 END, dna || symbol, bits FROM ({inner})"
    return f"WITH RECURSIVE c AS ({codewords}), r(id, k, prev, salt, recent, run, dna, bits) AS (SELECT id, 0, 0::BIGINT, 2779096485::BIGINT, '', 0, '', {bits} FROM c UNION ALL {step}) SELECT id, dna FROM r WHERE k = {CODE.length}"


NAMED = f"SELECT s_suppkey AS id, [(s_suppkey % 256)::INT, (s_suppkey // 256 % 256)::INT] || {sql_bytes("hex(encode(rpad(s_name, 20, ' ')))")} AS cw FROM supplier"


@add("hedges_encode", _sql_hedges(NAMED))
def hedges_encode(spark, sf):
    return K.hedges_encode(named(spark, sf), "cw", "dna", CODE).select("id", "dna")


@add("hedges_decode", "SELECT s_suppkey AS id, rpad(s_name, 20, ' ') AS txt FROM supplier")
def hedges_decode(spark, sf):
    coded = K.hedges_encode(named(spark, sf), "cw", "dna", CODE)
    at = F.lit(20) + F.col("id") % 40
    worn = F.concat(F.substr("dna", F.lit(1), at), F.translate(F.substr("dna", at + 1, F.lit(1)), "ACGT", "CGTA"), F.substr("dna", at + 2, F.length("dna")))
    return K.hedges_decode(coded.select("id", worn.alias("dna")), "dna", "out", CODE).select("id", C.bytes_to_text(F.slice("out", 3, 20)).alias("txt"))


@add("hedges_orient", "SELECT s_suppkey AS id, TRUE AS same FROM supplier")
def hedges_orient(spark, sf):
    coded = K.hedges_encode(named(spark, sf), "cw", "dna", CODE)
    turned = coded.select("id", "dna", F.when(F.col("id") % 2 == 0, reverse_complement(F.col("dna"))).otherwise(F.col("dna")).alias("seen"))
    return K.hedges_orient(turned, "seen", "right", CODE).select("id", (F.col("right") == F.col("dna")).alias("same"))


@add("hedges_rate_pick", "SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN '3/4' WHEN 1 THEN '1/2' ELSE '1/4' END AS rate FROM supplier")
def hedges_rate_pick(spark, sf):
    codes = {n: Hedges(r, seq_bytes=2, message_bytes=20) for n, r in (("3/4", 0.75), ("1/2", 0.5), ("1/4", 0.25))}
    cw = named(spark, sf)
    for i, (name, code) in enumerate(codes.items()):
        cw = K.hedges_encode(cw, "cw", f"d{i}", code)
    seen = F.when(F.col("id") % 3 == 0, F.col("d0")).when(F.col("id") % 3 == 1, F.col("d1")).otherwise(F.col("d2"))
    return K.hedges_pick_rate(cw.select("id", seen.alias("dna")), "dna", "rate", codes).select("id", "rate")
