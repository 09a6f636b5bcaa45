"""Reproducible random draws: pure functions of a seed, a stream and ids.

A draw is 32 bits of MD5 over its coordinates, so it is the same in every
partitioning, on retries and in SQL.  Four draws fit into one digest.  ``grid`` makes
the draws of many places at once, in arrays.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = 1 << 32


def u32(seed: int, stream: str, *ids: Column, lane: int = 0) -> Column:
    """An integer from 0 to 2^32 - 1; lanes 0 to 3 are independent."""
    key = F.concat_ws(":", F.lit(str(seed)), F.lit(stream), *[i.cast("string") for i in ids])
    return F.conv(F.substring(F.md5(key), 8 * lane + 1, 8), 16, 10).cast("bigint")


def sql_u32(seed: int, stream: str, *ids: str, lane: int = 0) -> str:
    """The same draw as SQL text for a checking engine."""
    key = "concat_ws(':', " + ", ".join([f"'{seed}'", f"'{stream}'", *[f"({i})::VARCHAR" for i in ids]]) + ")"
    return f"('0x' || substr(md5({key}), {8 * lane + 1}, 8))::BIGINT"


def threshold(rate: float) -> int:
    """A draw is below this with probability ``rate``; integers compare alike everywhere."""
    return int(rate * RANGE)


# MD5's constants, rotations and start (RFC 1321).
_K = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
_TURN = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Draws that are made at once: what a step works on stays in a core's cache.
_AT_ONCE = 1 << 14


def _md5(words: list[np.ndarray], shape: tuple[int, int]) -> list[np.ndarray]:
    """The four numbers of the digest of one block for each place of ``shape``; a word is an array that spreads over it."""
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            g = 7 * i % 16
        f += a
        f += words[g] + _K[i]
        turn = _TURN[i // 16][i % 4]
        np.left_shift(f, np.uint32(turn), out=t)
        f >>= np.uint32(32 - turn)
        f |= t
        f += b
        # a's numbers are not needed any more
        a, b, c, d, f = d, f, b, c, a
    return [x + np.uint32(s) for x, s in zip((a, b, c, d), _START)]


def grid(seed: int, stream: str, ids: list[int | None], n: int, lanes: tuple[int, ...] = (0,)) -> list[np.ndarray]:
    """For each lane (len(ids), n) draws: ``u32(seed, stream, id, i)`` for each id and each i below n; a null id is left out of the key, as there."""
    out = [np.empty((len(ids), n), np.uint32) for _ in lanes]
    heads = [f"{seed}:{stream}:".encode() if x is None else f"{seed}:{stream}:{x}:".encode() for x in ids]
    by_length: dict[int, list[int]] = {}
    for k, head in enumerate(heads):
        by_length.setdefault(len(head), []).append(k)
    digits = [(lo, min(n, 10 * lo or 10)) for lo in (0, *(10**e for e in range(1, 10))) if lo < n]
    for length, members in by_length.items():
        if length + len(str(max(n - 1, 0))) > 55:
            raise ValueError("a key must fit into one block of MD5")
        blocks = np.zeros((len(members), 64), np.uint8)
        blocks[:, :length] = np.frombuffer(b"".join(heads[k] for k in members), np.uint8).reshape(-1, length)
        front = blocks.view("<u4").astype(np.uint32)
        rows = np.array(members)
        for lo, hi in digits:
            width = len(str(lo))
            tails = np.zeros((hi - lo, 64), np.uint8)
            tails[:, length : length + width] = np.frombuffer(b"".join(str(i).encode() for i in range(lo, hi)), np.uint8).reshape(-1, width)
            tails[:, length + width] = 0x80
            tails[:, 56] = 8 * (length + width) & 255
            tails[:, 57] = 8 * (length + width) >> 8
            back = tails.view("<u4").astype(np.uint32)
            step = max(1, _AT_ONCE // (hi - lo))
            for at in range(0, len(members), step):
                some = front[at : at + step]
                words = []
                for w in range(16):
                    own, all_ = some[:, w], back[:, w]
                    head = own[:, None] if own.any() else np.zeros((1, 1), np.uint32)
                    words.append(head | (all_[None, :1] if (all_ == all_[0]).all() else all_[None]))
                found = _md5(words, (len(some), hi - lo))
                for k, lane in enumerate(lanes):
                    out[k][rows[at : at + step], lo:hi] = found[lane].byteswap()
    return out
