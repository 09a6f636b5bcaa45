"""Conversions and strand rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import convert as C
from ..functions import strand as S
from ..functions.rng import sql_u32, u32
from .base import STRANDS, Family, big, sql_bytes, strands, table

family = Family()
add = family.add

SUPPLIERS = "SELECT s_suppkey AS id, s_suppkey % 256 AS b FROM supplier"


@add("base4_encode", f"WITH {STRANDS} SELECT id, dna FROM strands")
def base4_encode(spark, sf):
    return strands(spark, sf).select("id", "dna")


@add("base4_decode", "SELECT p_partkey AS id, p_name AS txt FROM part")
def base4_decode(spark, sf):
    return strands(spark, sf).select("id", C.bytes_to_text(C.base4_decode(F.col("dna"))).alias("txt"))


@add("base3_encode", f"WITH s AS (SELECT p_partkey AS id, hex(encode(p_name)) AS h FROM part) SELECT id, array_to_string(list_transform({sql_bytes('h')}, lambda b: substr('{C.base_lut(3, 6)}', 6 * b + 1, 6)), '') AS dna FROM s")
def base3_encode(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), C.base3_encode(C.utf8_bytes(F.col("p_name"))).alias("dna"))


@add("baseN_encode", "SELECT o_orderkey AS id, array_to_string(list_transform(range(0, 13), lambda k: substr('0123456', ((o_orderkey // (7 ** k)::BIGINT) % 7)::INT + 1, 1)), '') AS digits, o_orderkey AS back FROM orders")
def base_n_encode(spark, sf):
    digits = C.to_digits(F.col("o_orderkey"), 7, 13)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), digits.alias("digits"), C.from_digits(digits, 7, "0123456").alias("back"))


@add("bits_le", f"SELECT id, reverse(lpad(bin(b), 8, '0')) AS bits, bit_count(b)::BIGINT AS ones FROM ({SUPPLIERS})")
def bits_le(spark, sf):
    b = F.col("s_suppkey") % 256
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), C.bits_le(b, 8).alias("bits"), big(F.bit_count(b), "ones"))


@add("int_to_bytes", "SELECT o_orderkey AS id, array_to_string(list_transform(range(0, 4), lambda k: ((o_orderkey >> (8 * k)::INT) & 255)::VARCHAR), ',') AS bytes FROM orders")
def int_to_bytes(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(C.int_to_bytes(F.col("o_orderkey"), 4).cast("array<string>"), ",").alias("bytes"))


@add("bytes_to_int", "SELECT o_orderkey AS id, o_orderkey * 3 AS value FROM orders")
def bytes_to_int(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), C.bytes_to_int(C.int_to_bytes(F.col("o_orderkey") * 3, 6)).alias("value"))


@add("bit_reverse", f"SELECT id, list_sum(list_transform(range(0, 8), lambda k: ((b >> k::INT) & 1) * (2 ** (7 - k))::BIGINT))::BIGINT AS flipped FROM ({SUPPLIERS})")
def bit_reverse(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), big(C.bit_reverse(F.col("s_suppkey") % 256), "flipped"))


@add("index_pack", "SELECT l_orderkey, l_linenumber, ((l_orderkey % 1024) * 8192 + (l_linenumber % 8) * 1024 + (l_partkey % 128) * 8) >> 0 AS packed FROM lineitem")
def index_pack(spark, sf):
    cols = C.pack_bits([F.col("l_orderkey") % 1024, F.col("l_linenumber") % 8, F.col("l_partkey") % 128, F.lit(0)], [10, 3, 7, 0])
    value = F.aggregate(cols, F.lit(0).cast("bigint"), lambda acc, b: acc * 256 + b)
    # 20 bits in three bytes: four zeros fill the last; the check has 23 bits, so shift by one
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.shiftright(value, 1).alias("packed"))


@add("index_unpack", "SELECT l_orderkey, l_linenumber, l_orderkey % 1024 AS a, (l_linenumber % 8)::BIGINT AS b, l_partkey % 128 AS c FROM lineitem")
def index_unpack(spark, sf):
    packed = C.pack_bits([F.col("l_orderkey") % 1024, F.col("l_linenumber") % 8, F.col("l_partkey") % 128], [10, 3, 7])
    a, b, c = C.unpack_bits(F.col("packed"), [10, 3, 7])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", packed.alias("packed")).select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"), c.alias("c"))


PRIMER = "GTCTCGTGGGCTCGG"


def _sql_exclusion(value: str, length: int, alphabet: str = "ACT") -> str:
    parts, weight = [], 1
    for k in range(length):
        allowed = "".join(b for b in alphabet if k >= len(PRIMER) or b != PRIMER[k])
        parts.append(f"substr('{allowed}', ({value} // {weight} % {len(allowed)})::INT + 1, 1)")
        weight *= len(allowed)
    return " || ".join(parts)


@add("excl_encode", f"SELECT s_suppkey AS id, {_sql_exclusion('(s_suppkey % 243)', 10)} AS code FROM supplier")
def excl_encode(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), C.exclusion_encode(F.col("s_suppkey") % 243, 10, PRIMER).alias("code"))


@add("excl_decode", "SELECT s_suppkey AS id, s_suppkey % 243 AS value FROM supplier")
def excl_decode(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), C.exclusion_decode(C.exclusion_encode(F.col("s_suppkey") % 243, 10, PRIMER), 10, PRIMER).alias("value"))


BINARY = f"WITH s AS (SELECT p_partkey AS id, hex(encode(p_name)) AS h FROM part) SELECT id, array_to_string(list_transform({sql_bytes('h')}, lambda b: translate(reverse(lpad(bin(b), 8, '0')), '01', 'AC')), '') AS code FROM s"


@add("binary_encode", BINARY)
def binary_encode(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), C.binary_encode(C.utf8_bytes(F.col("p_name"))).alias("code"))


def _sql_more(b: str, other: str) -> str:
    return f"length(a) - length(replace(a, '{b}', '')) > length(a) - length(replace(a, '{other}', ''))"


_AHEAD = "CASE b " + " ".join(f"WHEN '{b}' THEN {_sql_more(b, o)}" for b, o in zip("ACGT", "TGCA")) + " END"


@add("rotate_encode", f"SELECT id, list_reduce(list_prepend('', str_split(code, '')), lambda a, b: a || CASE WHEN {_AHEAD} OR b = CASE WHEN a = '' THEN 'A' ELSE right(a, 1) END THEN translate(b, 'ACGT', 'TGCA') ELSE b END) AS code FROM ({BINARY})")
def rotate_encode(spark, sf):
    code = C.rotate_encode(C.binary_encode(C.utf8_bytes(F.col("p_name"))))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), code.alias("code"))


@add("rotate_decode", BINARY)
def rotate_decode(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), C.rotate_decode(C.rotate_encode(C.binary_encode(C.utf8_bytes(F.col("p_name"))))).alias("code"))


@add("table_codec", f"SELECT id, b AS value FROM ({SUPPLIERS})")
def table_codec(spark, sf):
    codes = {b: C.base_lut(4, 4)[4 * b : 4 * b + 4] for b in range(256)}
    b = F.array((F.col("s_suppkey") % 256).cast("int"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.element_at(C.table_decode(C.table_encode(b, codes), codes, 4), 1).cast("bigint").alias("value"))


@add("fastq_clean", f"WITH {STRANDS} SELECT id, dna AS seq, contains(dna, 'T') AS is_rna FROM strands")
def fastq_clean(spark, sf):
    raw = F.translate("dna", "T", "U")
    return strands(spark, sf).select("id", S.clean_read(raw).alias("seq"), (F.instr(raw, "U") > 0).alias("is_rna"))


@add("revcomp", f"WITH {STRANDS} SELECT id, reverse(translate(dna, 'ACGT', 'TGCA')) AS rc, reverse(dna) AS rev FROM strands")
def revcomp(spark, sf):
    return strands(spark, sf).select("id", S.reverse_complement(F.col("dna")).alias("rc"), F.reverse("dna").alias("rev"))


@add("anti_seq", f"WITH {STRANDS} SELECT id, translate(dna, 'ACGT', 'CTAG') AS anti FROM strands")
def anti_seq(spark, sf):
    return strands(spark, sf).select("id", S.anti_sequence(F.col("dna")).alias("anti"))


REV = "list_filter(range(0, length(dna)), lambda i: substr(dna, (i + 1)::INT, 1) <> substr(reverse(dna), (i + 1)::INT, 1))"


@add("hamming", f"WITH {STRANDS} SELECT id, len({REV})::BIGINT AS distance, (length(dna) - len({REV}))::BIGINT AS similarity FROM strands")
def hamming(spark, sf):
    d = S.hamming(F.col("dna"), F.reverse("dna"))
    return strands(spark, sf).select("id", big(d, "distance"), big(F.length("dna") - d, "similarity"))


@add("hamming_diff", f"WITH {STRANDS} SELECT id, array_to_string(list_transform({REV}, lambda i: substr(dna, (i + 1)::INT, 1) || '->' || substr(reverse(dna), (i + 1)::INT, 1)), ',') AS subs, array_to_string(list_transform({REV}, lambda i: i::VARCHAR), ',') AS places FROM strands")
def hamming_diff(spark, sf):
    a, b = F.col("dna"), F.reverse("dna")
    return strands(spark, sf).select("id", S.substitutions(a, b).alias("subs"), F.array_join(S.mismatches(a, b).cast("array<string>"), ",").alias("places"))


def _sql_overlap(a: str, b: str) -> str:
    return f"coalesce(list_max(list_transform(list_filter(range(0, length({a})), lambda i: substr({a}, (i + 1)::INT, least(length({b}), length({a}) - i)::INT) = substr({b}, 1, least(length({b}), length({a}) - i)::INT)), lambda i: least(length({b}), length({a}) - i)))::BIGINT, 0)"


OTHER = S.EARLIER_PRIMERS[0]


@add("overlap", f"WITH {STRANDS}, p AS (SELECT id, dna AS a, '{OTHER}' AS b FROM strands) SELECT id, {_sql_overlap('a', 'b')} AS ahead, greatest({_sql_overlap('a', 'b')}, {_sql_overlap('b', 'a')}) AS distance FROM p")
def overlap(spark, sf):
    a, b = F.col("dna"), F.lit(OTHER)
    return strands(spark, sf).select("id", big(S.suffix_overlap(a, b), "ahead"), big(S.overlap_distance(a, b), "distance"))


@add("primer_screen", f"WITH {STRANDS}, p AS (SELECT id, substr(dna, 1, 20) AS a, b FROM strands, (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in S.EARLIER_PRIMERS)}) AS o(b)) SELECT id, max(greatest({_sql_overlap('a', 'b')}, {_sql_overlap('b', 'a')}))::BIGINT AS worst, max(greatest({_sql_overlap('a', 'b')}, {_sql_overlap('b', 'a')})) <= 3 AS ok FROM p GROUP BY id")
def primer_screen(spark, sf):
    a = F.substring("dna", 1, 20)
    worst = F.greatest(*[S.overlap_distance(a, F.lit(p)) for p in S.EARLIER_PRIMERS])
    return strands(spark, sf).select("id", big(worst, "worst"), (worst <= 3).alias("ok"))


PAIRS = "|".join(b * 2 for b in "ACGT")


@add("repetition_score", f"WITH {STRANDS} SELECT id, round(len(list_filter(range(0, length(dna) - 4), lambda i: regexp_matches(substr(dna, (i + 1)::INT, 5), '{PAIRS}'))) / (length(dna) - 4), 9) AS score FROM strands")
def repetition_score(spark, sf):
    return strands(spark, sf).select("id", F.round(S.repetition_score(F.col("dna")), 9).alias("score"))


@add("self_dimer", f"WITH {STRANDS}, r AS (SELECT id, dna, reverse(translate(dna, 'ACGT', 'TGCA')) AS rc FROM strands) SELECT id, len(list_filter(range(0, length(dna) - 7), lambda i: contains(substr(dna, (i + 2)::INT), substr(rc, (i + 1)::INT, 8)))) > 0 AS dimer FROM r")
def self_dimer(spark, sf):
    return strands(spark, sf).select("id", S.self_dimer(F.col("dna"), 8).alias("dimer"))


RUNS = {n: "|".join(b * n for b in "ACGT") for n in (2, 3, 4)}


@add("homopolymer", f"WITH {STRANDS} SELECT id, {', '.join(f'regexp_matches(dna, {chr(39)}{r}{chr(39)}) AS run{n}' for n, r in RUNS.items())} FROM strands")
def homopolymer(spark, sf):
    return strands(spark, sf).select("id", *[S.has_run(F.col("dna"), n).alias(f"run{n}") for n in RUNS])


@add("dimer_run", f"WITH {STRANDS} SELECT id, {', '.join(f'regexp_matches(dna, {chr(39)}' + '|'.join(d * n for d in S.DIMERS) + f'{chr(39)}) AS run{n}' for n in (2, 3, 4))} FROM strands")
def dimer_run(spark, sf):
    return strands(spark, sf).select("id", *[S.has_dimer_run(F.col("dna"), n).alias(f"run{n}") for n in (2, 3, 4)])


@add("gc_content", f"WITH {STRANDS} SELECT id, round(100.0::DOUBLE * length(translate(dna, 'AT', '')) / length(dna), 9) AS gc, 100.0 * length(translate(dna, 'AT', '')) / length(dna) BETWEEN 40 AND 60 AS ok FROM strands")
def gc_content(spark, sf):
    gc = S.gc_percent(F.col("dna"))
    return strands(spark, sf).select("id", F.round(gc, 9).alias("gc"), gc.between(40, 60).alias("ok"))


_PAIR_CASE = {k: v for d, v in S.NEIGHBOURS.items() for k in (d, d[::-1].translate(str.maketrans("ACGT", "TGCA")))}
_SQL_H = "CASE substr(a, (i + 1)::INT, 2) " + " ".join(f"WHEN '{d}' THEN {h}" for d, (h, _) in _PAIR_CASE.items()) + " END::DOUBLE"
_SQL_S = "CASE substr(a, (i + 1)::INT, 2) " + " ".join(f"WHEN '{d}' THEN {e}" for d, (_, e) in _PAIR_CASE.items()) + " END::DOUBLE"


@add(
    "melting_temp",
    f"""WITH {STRANDS}, p AS (SELECT id, substr(dna, 1, 20) AS a FROM strands),
e AS (SELECT id, a, (substr(a, 1, 1) IN ('A','T'))::INT + (substr(a, 20, 1) IN ('A','T'))::INT AS w FROM p),
t AS (SELECT id, list_sum(list_transform(range(0, 19), lambda i: {_SQL_H})) + 2.3 * w + 0.1 * (2 - w) AS dh, list_sum(list_transform(range(0, 19), lambda i: {_SQL_S})) + 4.1 * w - 2.8 * (2 - w) + 0.368 * 19 * ln(0.05) AS ds FROM e)
SELECT id, round((1000.0 * dh / (ds + 1.987 * ln(12.5e-9)) - 273.15)::DOUBLE, 6) AS tm FROM t""",
)
def melting_temp(spark, sf):
    return strands(spark, sf).select("id", F.round(S.melting_temperature(F.substring("dna", 1, 20)), 6).alias("tm"))


P5, P3, SITE = "TAAAGGAAAAAGCCTTCGAT", "CAAAATATAAAACGTTACCG", "AGATATAGGG"


@add("primer_strip5", f"WITH {STRANDS} SELECT id, CASE WHEN contains(dna, '{P5}') THEN substr(dna, instr(dna, '{P5}') + 20) ELSE dna END AS dna FROM strands")
def primer_strip5(spark, sf):
    # one base of the primer is wrong, so the nearest window decides; a strand that holds the primer itself is cut there
    worn = F.concat(F.lit("G" + P5[:7] + "T" + P5[8:]), F.col("dna"))
    return strands(spark, sf).select("id", S.strip_front(worn, P5).alias("dna"))


@add("primer_strip3", f"WITH {STRANDS}, r AS (SELECT id, dna, instr(reverse(dna), '{P3[::-1]}') AS i FROM strands) SELECT id, CASE WHEN i > 0 THEN reverse(substr(reverse(dna), i + 20)) ELSE dna END AS dna FROM r")
def primer_strip3(spark, sf):
    worn = F.concat(F.col("dna"), F.lit(P3[:9] + "C" + P3[10:]))
    return strands(spark, sf).select("id", S.strip_back(worn, P3).alias("dna"))


@add("primer_filter", f"WITH {STRANDS} SELECT count(*)::BIGINT AS total, sum((id % 3 > 0)::INT)::BIGINT AS kept, sum((id % 3 = 0)::INT)::BIGINT AS filtered FROM strands")
def primer_filter(spark, sf):
    read = F.when(F.col("id") % 3 > 0, F.concat(F.lit(P5), F.col("dna"))).otherwise(F.lpad(F.lit("C"), 60, "C"))
    kept = S.strip_front(read, P5).isNotNull()
    return strands(spark, sf).agg(F.count(F.lit(1)).alias("total"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("filtered"))


@add("reverse_payload", f"WITH {STRANDS} SELECT id, reverse(dna) AS dna FROM strands")
def reverse_payload(spark, sf):
    return strands(spark, sf).select("id", F.reverse("dna").alias("dna"))


@add("length_filter", f"WITH {STRANDS} SELECT id, length(dna)::BIGINT AS n FROM strands WHERE length(dna) BETWEEN 60 AND 100")
def length_filter(spark, sf):
    return strands(spark, sf).select("id", big(F.length("dna"), "n")).where(F.col("n").between(60, 100))


@add("cut_site", f"WITH {STRANDS}, m AS (SELECT id, substr(dna, 1, length(dna) // 2) || '{SITE}' || substr(dna, length(dna) // 2 + 1) AS dna FROM strands) SELECT id, substr(dna, 1, instr(dna, '{SITE}') - 1) || substr(dna, instr(dna, '{SITE}') + 10) AS dna FROM m")
def cut_site(spark, sf):
    return strands(spark, sf).select("id", S.remove_middle(S.insert_middle(F.col("dna"), SITE), SITE).alias("dna"))


_PAD = sql_u32(7, "pad", "id", "i")


@add("normalize_len", f"WITH {STRANDS} SELECT id, CASE WHEN length(dna) <= 200 THEN dna || array_to_string(list_transform(range(0, 200 - length(dna)), lambda i: substr('ACGT', ({_PAD} % 4)::INT + 1, 1)), '') END AS dna FROM strands")
def normalize_len(spark, sf):
    fill = F.concat_ws("", F.transform(C.indexes(F.lit(200) - F.length("dna")), lambda i: F.substr(F.lit("ACGT"), (u32(7, "pad", F.col("id"), i) % 4).cast("int") + 1, F.lit(1))))
    return strands(spark, sf).select("id", F.when(F.length("dna") <= 200, F.concat("dna", fill)).alias("dna"))


@add("fuzzy_find", f"WITH {STRANDS}, w AS (SELECT id, list_transform(range(0, length(dna) - 9), lambda i: levenshtein(substr(dna, (i + 1)::INT, 10), '{SITE}')) AS d FROM strands) SELECT id, list_min(d)::BIGINT AS distance, (list_position(d, list_min(d)) - 1)::BIGINT AS place FROM w")
def fuzzy_find(spark, sf):
    near = S.nearest_window(F.col("dna"), F.lit(SITE), 0, F.length("dna") - 10)
    return strands(spark, sf).select("id", near.alias("near")).select("id", big(F.col("near.distance"), "distance"), big(F.col("near.place"), "place"))


T7 = "TAATACGACTCACTATAG"


@add("t7_transcribe", f"WITH {STRANDS}, t AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'ACGTA{T7}' || dna ELSE dna END AS dna FROM strands) SELECT id, CASE WHEN contains(dna, '{T7}') THEN substr(dna, instr(dna, '{T7}') + {len(T7)}) ELSE dna END AS rna FROM t")
def t7_transcribe(spark, sf):
    tagged = F.when(F.col("id") % 2 == 0, F.concat(F.lit("ACGTA" + T7), F.col("dna"))).otherwise(F.col("dna"))
    return strands(spark, sf).select("id", S.transcribe_t7(tagged).alias("rna"))