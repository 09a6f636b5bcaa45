"""Round trips and known answers of the pure functions."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from strandlake.functions import gf, rs
from strandlake.functions.hedges import PATTERNS, Hedges
from strandlake.operators.outer import Layout


@given(st.integers(0, 2**32), st.integers(2, 16), st.integers(1, 40))
@settings(max_examples=25, deadline=None)
def test_reed_solomon_corrects_errors_and_erasures(seed, nsym, k):
    r = np.random.default_rng(seed)
    words = rs.encode(r.integers(0, 256, (3, k)), nsym)
    assert not rs.syndromes(words, nsym).any()
    erasures = int(r.integers(0, nsym + 1))
    errors = (nsym - erasures) // 2
    lost, worn = np.zeros(words.shape, bool), words.copy()
    for row in range(3):
        places = r.permutation(k + nsym)[: erasures + errors]
        lost[row, places[:erasures]] = True
        worn[row, places] ^= r.integers(1, 256, len(places))
    plain, ok = rs.decode(worn, nsym, lost)
    assert ok.all() and (plain == words[:, :k]).all()


def test_reed_solomon_says_when_too_much_is_lost():
    words = rs.encode(np.arange(10)[None], 4)
    lost = np.zeros(words.shape, bool)
    lost[0, :5] = True
    assert not rs.decode(words, 4, lost)[1].any()


def test_common_erasures_take_one_matrix():
    r = np.random.default_rng(1)
    words = rs.encode(r.integers(0, 256, (15, 10)), 4)
    lost = np.zeros(words.shape, bool)
    lost[:, [0, 3, 9, 12]] = True
    plain, ok = rs.decode(np.where(lost, 0, words), 4, lost)
    assert ok.all() and (plain == words[:, :10]).all()


def test_field_tables():
    exp, log = gf.tables(8)
    assert sorted(exp[:255].tolist()) == list(range(1, 256))
    assert all(gf.mul(x, gf.inverse(x)) == 1 for x in range(1, 256))


@pytest.mark.parametrize("rate", list(PATTERNS))
def test_hash_code_round_trip_with_an_edit(rate):
    code = Hedges(rate, seq_bytes=2, message_bytes=8)
    strand = code.encode(b"\x07\x01", b"archival")
    assert len(strand) == code.length and not any(b * 4 in strand for b in "ACGT" if rate < 0.6)
    for worn in (strand, strand[:30] + strand[31:], strand[:30] + "A" + strand[30:]):
        seq, message, _, won = code.decode(worn, 20_000)
        assert won and bytes(seq) == b"\x07\x01" and bytes(message) == b"archival"


def test_known_lengths():
    assert Hedges(0.75, seq_bytes=4, message_bytes=40).length == 242
    layout = Layout(2780, 47, 60)
    assert (layout.strands, layout.slots) == (60, 1)
    assert Layout(2700, 15, 180, 75).index_bits(1)[1] == 8


@given(st.integers(0, 2**32), st.integers(2, 10))
@settings(max_examples=25, deadline=None)
def test_two_ways_of_correcting_agree(seed, nsym):
    r = np.random.default_rng(seed)
    word = rs.encode(r.integers(0, 256, (1, 12)), nsym)[0]
    places = r.permutation(12 + nsym)[: int(r.integers(0, nsym + 2))]
    erased = sorted(places[: int(r.integers(0, len(places) + 1))].tolist())
    worn = word.copy()
    worn[places] ^= r.integers(1, 256, len(places))
    worn[erased] = 0
    lost = np.zeros((1, 12 + nsym), bool)
    lost[0, erased] = True
    plain, ok = rs.decode(worn[None], nsym, lost)
    other = rs.correct_plainly(worn, nsym, erased)
    assert (other is not None) == ok[0] and (not ok[0] or (other[:12] == plain[0]).all())
    assert rs.check(word[None], nsym)[0]


def test_the_larger_field():
    r = np.random.default_rng(4)
    words = rs.encode(r.integers(0, 1 << 16, (2, 300)), 6, 16)
    worn = words.copy()
    worn[:, [5, 200, 304]] ^= 4660
    plain, ok = rs.decode(worn, 6, None, 16)
    assert ok.all() and (plain == words[:, :300]).all()


def test_polynomials_and_plain_products():
    r = np.random.default_rng(5)
    for c_exp in (8, 16):
        for a, b in r.integers(0, 1 << c_exp, (50, 2)).tolist():
            assert gf.mul_plain(a, b, c_exp) == int(gf.mul(a, b, c_exp))
        p, q = r.integers(0, 1 << c_exp, 9).tolist(), [1, *r.integers(0, 1 << c_exp, 4).tolist()]
        quotient, rest = gf.poly_div(p, q, c_exp)
        assert gf.poly_add(gf.poly_mul(quotient, q, c_exp), rest) == p
        assert gf.poly_scale(p, 1, c_exp) == p and gf.poly_div(q, [*p, 1], c_exp)[1] == q


def test_hash_code_vector():
    """Rate 1/4, four bytes of sequence and fifteen of message, four bits of padding, three edits."""
    from strandlake.functions.hedges import _hash

    code = Hedges(0.25, seq_bytes=4, message_bytes=15, pad_bits=4)
    seq, message = bytes([100, 102, 103, 106]), bytes(_hash(i) & 255 for i in range(15))
    strand = list(code.encode(seq, message))
    strand[1], strand[30], strand[35] = "A", "C", "T"
    got = code.decode("".join(strand), 100_000)
    assert bytes(got[0]) == seq and bytes(got[1]) == message and got[3]


def test_settings_expand():
    from strandlake.operators.aggregate import expand_settings

    found = expand_settings({"a": {"value_list": [1, 2]}, "b": {"c": {"range": [0, 3]}, "d": "x"}})
    assert len(found) == 6 and {"a": 2, "b": {"c": 1, "d": "x"}} in found


def test_keyed_strands_and_stores(spark):
    from pyspark.sql import functions as F
    from strandlake.functions import convert as C
    from strandlake.operators import aggregate as A

    rows = spark.createDataFrame([(5, [1, 2, 255]), (1000, [0])], "k long, b array<int>")
    key, values = C.keyed_decode(F.col("s"))
    coded = rows.select("k", "b", C.keyed_encode(F.col("k"), F.col("b")).alias("s"))
    assert all(r["k"] == r["key"] and r["b"] == r["values"] for r in coded.select("k", "b", key.alias("key"), values.alias("values")).collect())
    assert [r[0] for r in spark.range(5).select(C.ternary_filler(F.col("id"))).collect()] == ["", "A", "AC", "ACG", "ACGA"]
    a = spark.createDataFrame([("h", [1, 2]), ("g", [5])], "name string, values array<long>")
    assert {r["name"]: r["values"] for r in A.merge_arrays(a, a, spark.createDataFrame([("h", [0, 0, 7])], "name string, values array<long>")).collect()} == {"h": [2, 4, 7], "g": [10]}
    s = spark.createDataFrame([("x", 1), ("y", 2)], "name string, value long")
    t = spark.createDataFrame([("y", 9), ("z", 3)], "name string, value long")
    assert {r["name"]: r["value"] for r in A.keep_first(s, t).collect()} == {"x": 1, "y": 2, "z": 3}
    assert {r["name"] for r in A.name_runs(s, "e", 4).collect()} == {"e::4::x", "e::4::y"}
    assert {r["name"]: r["values"] for r in A.stat_appends(s.unionByName(t).withColumn("o", -F.col("value")), "name", "value", "o").collect()}["y"] == [9, 2]
    points = {n: spark.createDataFrame(p, "x double, y double, label string") for n, p in (("f", [(1.0, 5.0, "a"), (4.0, 1.0, "b")]), ("g", [(2.0, 4.0, "c"), (3.0, 1.0, "d")]))}
    assert [(r["family"], r["x"]) for r in A.combined_frontier(points, "x", "y", "label").collect()] == [("f", 1.0), ("g", 2.0), ("f", 4.0)]


def test_the_best_end_is_taken_and_not_the_first():
    code = Hedges(0.5, seq_bytes=2, message_bytes=20)
    seq, message = bytes([182, 0]), b"Supplier#000000182  "
    strand = code.encode(seq, message)
    worn = strand[:42] + strand[42].translate(str.maketrans("ACGT", "CGTA")) + strand[43:]
    first, best = code.decode(worn), code.decode(worn, settle=True)
    assert first[3] and best[3] and bytes(first[1]) != message
    assert bytes(best[1]) == message and best[2] < first[2]


def test_bytes_that_are_no_text_are_null(spark):
    from pyspark.sql import functions as F
    from strandlake.functions import convert as C

    rows = spark.createDataFrame([(1, [83, 192, 64]), (2, [83, 195, 164]), (3, [])], "k long, b array<int>")
    assert {r["k"]: r["t"] for r in rows.select("k", C.bytes_to_text(F.col("b")).alias("t")).collect()} == {1: None, 2: "Sä", 3: ""}


def test_codes_after_one_that_reads_a_strand_are_not_tried(spark):
    from strandlake.operators.codes import hedges_pick_rate

    class Never:
        def decode(self, *_):
            raise AssertionError("tried")

    half, third = Hedges(0.5, seq_bytes=2, message_bytes=4), Hedges(1 / 3, seq_bytes=2, message_bytes=4)
    rows = spark.createDataFrame([(half.encode(b"ab", b"word"),), (third.encode(b"ab", b"word"),), (None,)], "dna string")
    got = hedges_pick_rate(rows, "dna", "rate", {"1/3": third, "1/2": half, "never": Never()}).collect()
    assert sorted((r["dna"] is None, r["rate"] or "") for r in got) == [(False, "1/2"), (False, "1/3"), (True, "")]


def test_many_words_with_other_errors_each_are_corrected_at_once():
    import time

    r = np.random.default_rng(6)
    words = rs.encode(r.integers(0, 256, (20_000, 24)), 10)
    lost, worn = np.zeros(words.shape, bool), words.copy()
    places = np.argsort(r.random(words.shape), 1)[:, :8]
    np.put_along_axis(lost, places[:, :4], True, 1)
    # every tenth word has four errors besides four erasures, one more than can be told
    for k in range(4, 8):
        own = np.arange(20_000) if k < 7 else np.arange(0, 20_000, 10)
        worn[own, places[own, k]] ^= 90
    began = time.time()
    plain, ok = rs.decode(worn, 10, lost)
    # a word at a time took 5 ms each
    assert time.time() - began < 20
    right = (plain == words[:, :24]).all(1)
    told = np.arange(20_000) % 10 > 0
    assert ok[told].all() and right[told].all() and not right[~told & ok].any() and ok[~told].mean() < 0.1


@pytest.mark.parametrize("rate", list(PATTERNS))
def test_strands_made_together_are_those_made_one_by_one(rate):
    r = np.random.default_rng(9)
    code = Hedges(rate, seq_bytes=3, message_bytes=7)
    words = [r.integers(0, 256, 10, np.uint8).tobytes() for _ in range(50)] + [b"\0" * 10, b"\xff" * 10, b"", b"ab", b"abcde", b"longer than ten"]
    assert code.encode_all(words) == [code.encode(w[:3], w[3:]) for w in words]
    assert code.encode_all([]) == []


def test_strands_that_no_search_reads_are_told_together():
    import time

    codes = [Hedges(r, seq_bytes=2, message_bytes=20) for r in (0.75, 0.5, 0.25)]
    strands = [codes[1 + i % 2].encode(i.to_bytes(2, "little"), f"Supplier#{i:09d}".ljust(20).encode()) for i in range(200)]
    began = time.time()
    assert codes[0].never_ends(strands, 5_000).all()
    together, began = time.time() - began, time.time()
    assert not any(codes[0].decode(s, 5_000)[3] for s in strands[:40])
    # one by one a strand took eight times as long
    assert together / 200 < (time.time() - began) / 40 / 2
    assert not codes[1].never_ends(strands[::2], 5_000).any()


@given(st.sampled_from(list(PATTERNS)), st.binary(min_size=3, max_size=3), st.lists(st.tuples(st.integers(0, 60), st.sampled_from(["", "A", "CT", "N"])), max_size=4), st.sampled_from([1, 20, 60, 300]))
@settings(max_examples=60, deadline=None)
def test_no_strand_that_a_search_reads_is_called_unreadable(rate, data, edits, guesses):
    strand = Hedges(rate, seq_bytes=1, message_bytes=2).encode(data[:1], data[1:])
    for at, new in edits:
        strand = strand[: at % (len(strand) + 1)] + new + strand[at % (len(strand) + 1) + 1 :]
    for other in PATTERNS:
        code = Hedges(other, seq_bytes=1, message_bytes=2)
        assert not (code.never_ends([strand], guesses)[0] and code.decode(strand, guesses)[3])


@pytest.mark.parametrize("layout", [Layout(600, 15, 10, 4), Layout(100, 9, 5, 3), Layout(20, 20, 4, 2)])
def test_packets_coded_whole_are_those_coded_by_strands(spark, layout):
    from pyspark.sql import functions as F
    from strandlake.operators import outer as O

    r = np.random.default_rng(3)
    packets = spark.createDataFrame([(f, p, r.integers(0, 256, layout.packet_bytes, np.uint8).tobytes()) for f, p in ((None, 0), (1, 0), (1, 1), (7, 2))], "file long, packet int, data binary").repartition(3)
    key = ["file", "packet"]
    coded = O.code_packets(packets, layout, key)
    # a packet is a row: nothing is dealt for it
    assert "hashpartitioning" not in O.packet_syndromes(coded, layout, key)._jdf.queryExecution().toString()
    strands = {(*x[:2], x["sub"], x["slot"]): bytes(x["data"]) for x in O.add_parity(O.strandize(packets, layout, key), layout, key).collect()}
    for row in coded.collect():
        size = layout.strand_bytes
        for place in range(layout.total * layout.slots):
            sub, slot = divmod(place, layout.slots)
            assert row["data"][place * size : place * size + size] == strands[row["file"], row["packet"], sub, slot]
    assert {(x["slot"], x["worst"]) for x in O.packet_syndromes(coded, layout, key).collect()} == {(i, 0) for i in range(layout.slots)}
    worn = coded.withColumn("data", F.when(F.col("packet") == 1, F.concat(F.expr("substring(data, 1, 4)"), F.lit(b"\x00\x01"), F.expr("substring(data, 7, 10000)"))).otherwise(F.col("data")))
    exploded = worn.select(*key, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(layout.total * layout.slots - 1)), lambda i: F.substr(F.col("data"), i * layout.strand_bytes + 1, F.lit(layout.strand_bytes)))).alias("place", "data"))
    placed = exploded.select(*key, (F.col("place") / layout.slots).cast("int").alias("sub"), (F.col("place") % layout.slots).alias("slot"), "data")
    got = {tuple(x) for x in O.packet_syndromes(worn, layout, key).collect()}
    assert got == {tuple(x) for x in O.syndromes(placed, layout, key).collect()} and any(x[3] for x in got)


def _worn_name(code: Hedges, number: int) -> str:
    """The strand of a numbered name with one base changed, as in the query."""
    strand, at = code.encode(number.to_bytes(2, "little"), f"Supplier#{number:09d}".ljust(20).encode()), 20 + number % 40
    return strand[:at] + strand[at].translate(str.maketrans("ACGT", "CGTA")) + strand[at + 1 :]


def test_of_words_as_near_as_each_other_the_likelier_is_taken(spark):
    from strandlake.operators.codes import hedges_decode

    code = Hedges(0.5, seq_bytes=2, message_bytes=20)
    # four strands that are as near to another word, among a few that are not
    numbers = [1571, 1598, 1902, 3187, *range(40, 80)]
    for number in numbers[:4]:
        words, _, won = code.decode_all(_worn_name(code, number), settle=True)
        assert won and len(words) == 2 and (list(number.to_bytes(2, "little")), list(f"Supplier#{number:09d}  ".encode())) in words
    rows = spark.createDataFrame([(n, _worn_name(code, n), 0) for n in numbers] + [(None, None, 1)], "k int, dna string, _alike int")
    found = {r["k"]: r for r in hedges_decode(rows.repartition(3), "dna", "cw", code).collect()}
    assert len(found) == len(numbers) + 1 and found[None]["cw"] is None and found[None]["_alike"] == 1
    assert [n for n in numbers if bytes(found[n]["cw"]) != n.to_bytes(2, "little") + f"Supplier#{n:09d}  ".encode()] == []
    # alone, nothing tells which word is meant: the first is taken
    alone = hedges_decode(rows.where("k = 1598"), "dna", "cw", code).collect()
    assert [bytes(r["cw"]) for r in alone] == [bytes(b for part in code.decode(_worn_name(code, 1598), settle=True)[:2] for b in part)]


def test_an_end_is_found_where_the_search_by_score_runs_out():
    code = Hedges(0.5, seq_bytes=2, message_bytes=20)
    worn = _worn_name(code, 28155)
    assert not code.decode(worn, 20_000)[3]
    seq, message, _, won = code.decode(worn, 20_000, settle=True)
    assert won and bytes(seq) == (28155).to_bytes(2, "little") and bytes(message) == b"Supplier#000028155  "
