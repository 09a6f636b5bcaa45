"""Arithmetic in GF(2^8) and GF(2^16): tables by rule, column expressions over them, and arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Field polynomials by exponent, and the CRC-8 polynomial.
FIELDS = {8: 0x18D, 16: 0x1002D}
CRC8 = 0x131


@lru_cache
def tables(c_exp: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """exp (twice the field's order long, so sums of logs need no modulus) and log."""
    order = (1 << c_exp) - 1
    exp, log = np.zeros(2 * order, np.int64), np.zeros(order + 1, np.int64)
    x = 1
    for i in range(order):
        exp[i] = exp[i + order] = x
        log[x] = i
        x <<= 1
        if x > order:
            x ^= FIELDS[c_exp]
    return exp, log


def mul(a: np.ndarray, b: np.ndarray, c_exp: int = 8) -> np.ndarray:
    exp, log = tables(c_exp)
    a, b = np.asarray(a), np.asarray(b)
    return np.where((a == 0) | (b == 0), 0, exp[log[a] + log[b]])


def inverse(a: int, c_exp: int = 8) -> int:
    exp, log = tables(c_exp)
    return int(exp[(1 << c_exp) - 1 - log[a]])


def poly_eval(poly: np.ndarray, x: int, c_exp: int = 8) -> np.ndarray:
    """Horner over the last axis, highest power first."""
    out = np.zeros(poly.shape[:-1], np.int64)
    for k in range(poly.shape[-1]):
        out = mul(out, x, c_exp) ^ poly[..., k]
    return out


def mul_plain(a: int, b: int, c_exp: int = 8) -> int:
    """A product without tables: shift and add, reduced by the field's polynomial."""
    out = 0
    while b:
        if b & 1:
            out ^= a
        b >>= 1
        a <<= 1
        if a >> c_exp:
            a ^= FIELDS[c_exp]
    return out


def poly_add(p: list[int], q: list[int]) -> list[int]:
    """Sum (and difference) of polynomials, highest power first."""
    n = max(len(p), len(q))
    return [a ^ b for a, b in zip([0] * (n - len(p)) + list(p), [0] * (n - len(q)) + list(q))]


def poly_scale(p: list[int], x: int, c_exp: int = 8) -> list[int]:
    return [int(v) for v in mul(np.array(p), x, c_exp)]


def poly_mul(p: list[int], q: list[int], c_exp: int = 8) -> list[int]:
    """Product of polynomials, in either order of powers."""
    out = np.zeros(len(p) + len(q) - 1, np.int64)
    for i, x in enumerate(p):
        out[i : i + len(q)] ^= mul(np.array(q), x, c_exp)
    return out.tolist()


def poly_div(dividend: list[int], divisor: list[int], c_exp: int = 8) -> tuple[list[int], list[int]]:
    """Quotient and remainder, highest power first; the divisor's first coefficient is not 0."""
    rest, steps = np.array(dividend, np.int64), len(dividend) - len(divisor) + 1
    if steps <= 0:
        return [0], list(dividend)
    scale, tail = inverse(divisor[0], c_exp), np.array(divisor)
    out = []
    for i in range(steps):
        c = int(mul(int(rest[i]), scale, c_exp))
        out.append(c)
        rest[i : i + len(divisor)] ^= mul(tail, c, c_exp)
    return out, rest[steps:].tolist()


@lru_cache
def generator(nsym: int, c_exp: int = 8) -> tuple[int, ...]:
    """Product of (x - a^i) for i below ``nsym``, highest power first."""
    g = np.array([1])
    exp, _ = tables(c_exp)
    for i in range(nsym):
        g = np.append(g, 0) ^ np.append(0, mul(g, exp[i], c_exp))
    return tuple(int(v) for v in g)


def _lit(values: np.ndarray) -> Column:
    return F.expr("array(" + ",".join(map(str, values.tolist())) + ")")


def col_mul(a: Column, b: Column) -> Column:
    exp, log = tables(8)
    pick = lambda t, i: F.element_at(_lit(t), i.cast("int") + 1)
    return F.when((a == 0) | (b == 0), F.lit(0)).otherwise(pick(exp, pick(log, a) + pick(log, b)))


def col_inverse(a: Column) -> Column:
    exp, log = tables(8)
    return F.when(a != 0, F.element_at(_lit(exp), (F.lit(255) - F.element_at(_lit(log), a.cast("int") + 1)).cast("int") + 1))


def col_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, col_mul(a, col_inverse(b)))


def col_pow(a: Column, n: int) -> Column:
    exp, log = tables(8)
    return F.when(a == 0, F.lit(0 if n else 1)).otherwise(F.element_at(_lit(exp[:255]), F.pmod(F.element_at(_lit(log), a.cast("int") + 1) * n, F.lit(255)).cast("int") + 1))


def col_poly_eval(poly: Column, x: int) -> Column:
    """Value of a polynomial given as an array, highest power first: Horner with one product table."""
    row = _lit(mul(np.arange(256), x))
    return F.aggregate(poly, F.lit(0), lambda acc, c: F.element_at(row, acc + 1).bitwiseXOR(c.cast("int")))


def col_syndromes(message: Column, nsym: int) -> Column:
    exp, _ = tables(8)
    return F.array(*[col_poly_eval(message, int(exp[i])) for i in range(nsym)])


@lru_cache
def crc8_table() -> np.ndarray:
    out = np.arange(256)
    for _ in range(8):
        out = np.where(out & 0x80, (out << 1) ^ CRC8, out << 1) & 0xFF
    return out


def crc8(values: Column) -> Column:
    """CRC-8 residue of byte values; null if any is null."""
    return F.aggregate(values, F.lit(0), lambda acc, x: F.element_at(_lit(crc8_table()), acc.bitwiseXOR(x.cast("int")) + 1))
