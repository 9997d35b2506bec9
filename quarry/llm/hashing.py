"""Vectorised 64-bit hashes of words, grams and sets, over many documents at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20260918))
BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse."""
    if len(_powers.get("b", ())) <= n:
        size = max(n + 1, 1 << 16)
        for key, base in (("b", _BASE), ("i", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["b"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number from 0 for each 64-bit element, the same for equal ones, and how many have each number.

    The leading bits of a mix, with the element's place below them, are sorted: numbers without their places sort several
    times as fast.  If two different elements are alike in those bits, whole elements are sorted.
    """
    n = len(x)
    low = np.uint64(max(1, n - 1).bit_length())
    packed = mix(x)
    packed = ((packed >> low) << low) | np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    packed >>= low
    first = np.ones(n, bool)
    first[1:] = x[order[1:]] != x[order[:-1]]
    if (first[1:] & (packed[1:] == packed[:-1])).any():
        order = np.argsort(x, kind="stable")
        first[1:] = x[order[1:]] != x[order[:-1]]
    number = np.empty(n, np.int64)
    number[order] = np.cumsum(first) - 1
    return number, np.diff(np.flatnonzero(first), append=n)


def spans_of(is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], is_word.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


#: Keeps the first n bytes of a little-endian block of eight.
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
#: Longer words, in bytes, are hashed one by one.
LONG = 256


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word buf[start:end]: its blocks of eight bytes, each mixed into what the ones before gave.

    Words of up to eight bytes never collide with others of their length.  Longer words do so as 64-bit numbers do by chance;
    no pattern of letters makes them (sums of powers collide on such patterns, whatever their base).
    """
    size = ends - starts
    blocks = np.ndarray((len(buf) + 1,), np.uint64, buf.tobytes() + bytes(8), strides=(1,))
    out = mix((size.astype(np.uint64) + np.uint64(1)) * _BASE)
    open_ = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        rest = size[open_] - k
        if k:
            open_, rest = open_[rest > 0], rest[rest > 0]
        if not len(open_):
            break
        out[open_] = mix(out[open_] ^ (blocks[starts[open_] + k] & _KEEP[np.minimum(rest, 8)]))
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def grams(x: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive elements of x; len(x) - n + 1 of them."""
    if len(x) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(x) - n + 1, np.uint64)
    for k in range(n):
        out *= np.uint64(0xE7037ED1A0B428DB)
        out += x[k : k + len(out)]
    return mix(out)


def grams16(x: np.ndarray) -> np.ndarray:
    """A hash of each 16 consecutive elements of x, by doubling."""
    for n, c in ((1, 0xE7037ED1A0B428DB), (2, 0x8EBC6AF09C88C6E3), (4, 0x589965CC75374CC3), (8, 0x1D8E4E27C47D124F)):
        if len(x) <= n:
            return np.zeros(0, np.uint64)
        y = x[:-n] * np.uint64(c)
        y += x[n:]
        x = y
    return mix(x)


def range_hashes(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each x[start:end]."""
    b, inv = powers(len(x))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * b[: len(x)])))
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def least_in(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive elements of x."""
    n = 1
    while 2 * n <= w:
        x = np.minimum(x[:-n], x[n:]) if len(x) > n else x[:0]
        n *= 2
    rest = w - n
    return np.minimum(x[:-rest], x[rest:]) if rest and len(x) > rest else x[:0] if rest else x


def batches(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs [first, after the last) of texts of about `most` bytes together."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
