"""Draws with replacement by hashing names: the first eight hex digits of MD5, modulo the number of places, for many names at once.

A shuffle or a call of a library for each draw costs many times what the hash does, so whole arrays of names go through its rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np

#: MD5 (RFC 1321): rotations, constants and order of words of its 64 steps, and the first state.
_SHIFTS = [s for four in ([7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]) for s in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_ORDER = [(x * i + y) % 16 for x, y in ((1, 0), (5, 1), (3, 5), (7, 0)) for i in range(16)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_LOW = 2**32 - 1
#: Names that are hashed at once: enough to make numpy's own time for a call small.
TILE = 65_536

#: A byte of all names, or an array of bytes that spreads over them.
Byte = int | np.ndarray


def digits(numbers: np.ndarray) -> list[Byte]:
    """The decimal digits of numbers that have equally many, as character codes."""
    if numbers.size == 1:
        return list(str(numbers.item()).encode())
    n = len(str(numbers.flat[0]))
    return [(numbers // 10 ** (n - 1 - j) % 10 + 48).astype(np.uint32) for j in range(n)]


def _word(four: Sequence[Byte]) -> Byte:
    fixed = sum(x << 8 * j for j, x in enumerate(four) if isinstance(x, int))
    varied = [x << np.uint32(8 * j) for j, x in enumerate(four) if not isinstance(x, int)]
    return reduce(np.bitwise_or, varied, np.uint32(fixed)) if varied else fixed


def hashes(name: Sequence[Byte], shape: tuple[int, ...]) -> np.ndarray:
    """The first eight hex digits of the names' MD5, as numbers: names are given byte by byte."""
    n = len(name)
    padded = [*name, 0x80, *[0] * (-(n + 9) % 64), *(8 * n).to_bytes(8, "little")]
    words = [_word(padded[i : i + 4]) for i in range(0, len(padded), 4)]
    state = [np.full(shape, x, np.uint32) for x in _START]
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for at in range(0, len(words), 16):
        a, b, c, d = (x.copy() for x in state)
        for i in range(64):
            if i < 16:  # d ^ (b & (c ^ d))
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif i < 32:  # c ^ (d & (b ^ c))
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:  # c ^ (b | ~d)
                np.invert(d, out=f)
                f |= b
                f ^= c
            a += f
            word = words[at + _ORDER[i]]
            if isinstance(word, int):
                a += np.uint32(word + _SINES[i] & _LOW)
            else:
                a += word
                a += np.uint32(_SINES[i])
            np.left_shift(a, np.uint32(_SHIFTS[i]), out=t)
            a >>= np.uint32(32 - _SHIFTS[i])
            a |= t
            a += b
            a, b, c, d = d, a, b, c
        for x, y in zip(state, (a, b, c, d), strict=True):
            x += y
    return state[0].byteswap()


def _runs(first: int, stop: int, size: int) -> Iterator[np.ndarray]:
    """The numbers from ``first`` to ``stop`` - 1 in runs of at most ``size`` with equally many digits."""
    while first < stop:
        end = min(stop, first + size, 10 ** len(str(first)))
        yield np.arange(first, end)
        first = end


def drawn_sums(prefix: str, replicates: range, n: int, values: np.ndarray, first: int = 0) -> np.ndarray:
    """Per replicate b, the sum of the values that its ``n`` draws of ``n`` places meet; draw k hashes the name ``prefix:b:k``.

    ``values`` are those of the places from ``first`` on; draws of other places add nothing.
    """
    out = np.zeros(len(replicates))
    for k in _runs(0, n, TILE):
        last = digits(k[None, :])
        for b in _runs(replicates.start, replicates.stop, max(1, TILE // len(k))):
            drawn = hashes([*f"{prefix}:".encode(), *digits(b[:, None]), *b":", *last], (len(b), len(k)))
            place = drawn % np.uint32(n) if n <= _LOW else drawn
            if len(values) == n:
                met = values[place]
            else:
                place = place.astype(np.int64) - first
                met = np.where((place >= 0) & (place < len(values)), values.take(place, mode="clip"), 0.0)
            out[b - replicates.start] += met.sum(axis=1)
    return out
