"""Integers, bytes, bits and nucleotide digits: all built-in expressions, no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def indexes(n: Column | int) -> Column:
    """[0, n) as an array; empty for n = 0 (a plain ``sequence`` would run backwards)."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def base_lut(base: int, digits: int, alphabet: str = BASES) -> str:
    """Little-endian digits of every byte, one after another."""
    return "".join(alphabet[(b // base**k) % base] for b in range(256) for k in range(digits))


def utf8_bytes(text: Column) -> Column:
    """A string's UTF-8 bytes as an array of integers."""
    h = F.hex(F.encode(text, "UTF-8"))
    return F.transform(indexes(F.length(h) / 2), lambda i: F.conv(F.substr(h, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))


def bytes_to_text(values: Column) -> Column:
    """UTF-8 text of an array of byte values; null where it isn't UTF-8."""
    return F.try_validate_utf8(F.unhex(F.concat_ws("", F.transform(values, lambda b: F.lpad(F.hex(b.cast("bigint")), 2, "0")))).cast("string"))


def to_digits(value: Column, base: int, n: int, alphabet: str = "0123456789") -> Column:
    """``n`` little-endian digits of a non-negative integer; a value that needs more loses the high ones."""
    v = value.cast("bigint")
    powers = F.array(*[F.lit(base**k).cast("bigint") for k in range(n)])
    return F.concat_ws("", F.transform(powers, lambda p: F.substr(F.lit(alphabet), F.pmod(_div(v, p), F.lit(base)).cast("int") + 1, F.lit(1))))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def from_digits(digits: Column, base: int, alphabet: str = BASES) -> Column:
    """Sum of digit values times base^i; null if a character isn't a digit."""
    n = F.length(digits)
    return F.when(
        F.length(F.translate(digits, alphabet[:base], "")) == 0,
        F.aggregate(
            indexes(n),
            F.lit(0).cast("bigint"),
            lambda acc, i: acc * base + (F.instr(F.lit(alphabet), F.substr(digits, n - i, F.lit(1))) - 1).cast("bigint"),
        ),
    )


def base4_encode(values: Column) -> Column:
    """Four nucleotides a byte, least significant digit first."""
    lut = F.lit(base_lut(4, 4))
    return F.concat_ws("", F.transform(values, lambda b: F.substr(lut, 4 * b.cast("int") + 1, F.lit(4))))


def base4_decode(dna: Column) -> Column:
    """Byte values of whole groups of four nucleotides; null for a group with another letter."""
    return F.transform(indexes(F.floor(F.length(dna) / 4)), lambda i: from_digits(F.substr(dna, 4 * i + 1, F.lit(4)), 4).cast("int"))


def base3_encode(values: Column) -> Column:
    """Six ternary nucleotides a byte."""
    lut = F.lit(base_lut(3, 6))
    return F.concat_ws("", F.transform(values, lambda b: F.substr(lut, 6 * b.cast("int") + 1, F.lit(6))))


def bits_le(value: Column, n: int) -> Column:
    """Binary digits, least significant first."""
    return F.reverse(F.lpad(F.bin(value.cast("bigint")), n, "0"))


def int_to_bytes(value: Column, n: int) -> Column:
    """Little-endian bytes."""
    v = value.cast("bigint")
    return F.array(*[F.shiftright(v, 8 * k).bitwiseAND(F.lit(255)).cast("int") for k in range(n)])


def bytes_to_int(values: Column) -> Column:
    return F.aggregate(F.reverse(values), F.lit(0).cast("bigint"), lambda acc, b: acc * 256 + b)


def bit_reverse(byte: Column) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(byte.cast("bigint")), 8, "0")), 2, 10).cast("int")


def pack_bits(values: list[Column], widths: list[int]) -> Column:
    """Most-significant-first bit fields as bytes, the last one filled up with zeros; a field of no width is nothing."""
    fields = [F.lpad(F.bin(v.cast("bigint")), w, "0") for v, w in zip(values, widths) if w]
    total = sum(widths)
    n = -(-total // 8)
    bits = F.rpad(F.concat(*fields), 8 * n, "0") if fields else F.lit("")
    return F.transform(indexes(n), lambda i: F.conv(F.substr(bits, 8 * i + 1, F.lit(8)), 2, 10).cast("int"))


def unpack_bits(values: Column, widths: list[int]) -> list[Column]:
    bits = F.concat_ws("", F.transform(values, lambda b: F.lpad(F.bin(b.cast("bigint")), 8, "0")))
    out, at = [], 0
    for w in widths:
        out.append(F.conv(F.substring(bits, at + 1, w), 2, 10).cast("bigint") if w else F.lit(0).cast("bigint"))
        at += w
    return out


def exclusion_encode(value: Column, length: int, primer: str, alphabet: str = "ACT") -> Column:
    """Mixed-radix digits that differ from the primer's base at each place, least significant first."""
    out, rest = [], value.cast("bigint")
    for k in range(length):
        allowed = [b for b in alphabet if k >= len(primer) or b != primer[k]]
        out.append(F.substr(F.lit("".join(allowed)), (rest % len(allowed)).cast("int") + 1, F.lit(1)))
        rest = _div(rest, F.lit(len(allowed)).cast("bigint"))
    return F.concat(*out)


def exclusion_decode(digits: Column, length: int, primer: str, alphabet: str = "ACT") -> Column:
    value, weight = F.lit(0).cast("bigint"), 1
    for k in range(length):
        allowed = "".join(b for b in alphabet if k >= len(primer) or b != primer[k])
        value = value + (F.instr(F.lit(allowed), F.substring(digits, k + 1, 1)) - 1).cast("bigint") * weight
        weight *= len(allowed)
    return value


def binary_encode(values: Column) -> Column:
    """Eight letters a byte, A for 0 and C for 1, least significant bit first."""
    return F.concat_ws("", F.transform(values, lambda b: F.translate(bits_le(b, 8), "01", "AC")))


def binary_decode(strand: Column) -> Column:
    """Bytes of eight letters each, A for 0 and C for 1, least significant bit first."""
    return F.transform(indexes(F.floor(F.length(strand) / 8)), lambda i: F.conv(F.reverse(F.translate(F.substr(strand, 8 * i + 1, F.lit(8)), "AC", "01")), 2, 10).cast("int"))


def keyed_encode(key: Column, values: Column, width: int = 20) -> Column:
    """A key in ``width`` letters of two kinds, then the bytes."""
    return F.concat(to_digits(key, 2, width, "AC"), binary_encode(values))


def keyed_decode(strand: Column, width: int = 20) -> tuple[Column, Column]:
    """Key and bytes of ``keyed_encode``."""
    return from_digits(F.substring(strand, 1, width), 2, "AC"), binary_decode(F.substr(strand, F.lit(width + 1), F.length(strand)))


def ternary_filler(n: Column) -> Column:
    """``n`` letters that run through the first three."""
    return F.rpad(F.lit("ACG"), n.cast("int"), F.lit("ACG"))


def rotate_encode(strand: Column, first: str = "A") -> Column:
    """Complement a base that equals the one before it, or that has come more often than its complement."""
    names = ("A", "C", "G", "T")
    start = F.struct(F.lit("").alias("out"), F.lit(first).alias("prev"), *[F.lit(0).alias(b) for b in names])

    def step(acc: Column, b: Column) -> Column:
        other = F.translate(b, "ACGT", "TGCA")
        count = {n: acc[n] for n in names}
        ahead = F.lit(False)
        for n, m in zip("ACGT", "TGCA"):
            ahead = ahead | ((b == n) & (count[n] > count[m]))
        c = F.when(ahead | (b == acc["prev"]), other).otherwise(b)
        return F.struct(F.concat(acc["out"], c).alias("out"), c.alias("prev"), *[(count[n] + F.when(c == n, 1).otherwise(0)).alias(n) for n in names])

    letters = F.filter(F.split(strand, ""), lambda b: b != "")
    return F.aggregate(letters, start, step, lambda acc: acc["out"])


def rotate_decode(strand: Column) -> Column:
    return F.translate(strand, "TG", "AC")


def table_encode(values: Column, table: dict[int, str]) -> Column:
    """Code words of a lookup table, joined; null for a value that has none."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    words = F.transform(values, lambda v: F.try_element_at(m, v.cast("int")))
    return F.when(~F.exists(words, lambda w: w.isNull()), F.concat_ws("", words))


def table_decode(code: Column, table: dict[int, str], width: int) -> Column:
    m = F.create_map(*[F.lit(x) for k, v in table.items() for x in (v, k)])
    return F.transform(indexes(F.floor(F.length(code) / width)), lambda i: F.try_element_at(m, F.substr(code, width * i + 1, F.lit(width))))
