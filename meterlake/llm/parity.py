"""Parity-sketch arithmetic of the n-gram Jaccard join: shingle sets, size bands, chunk keys.

All of it is numpy on the bytes of many texts at once; the join itself is in ``ngram_join``.
"""

from __future__ import annotations

from functools import lru_cache
from math import exp, sqrt

import numpy as np

#: Jaccard threshold as a fraction of integers, and words a shingle.
NUM, DEN = 75, 100
WORDS = 5
RATIO = 1.5

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A random-looking number for each byte, A-Z like a-z; 0 for white space.
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_BYTES[65:91] = _BYTES[97:123]
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


#: Bytes that are hashed at once.
WINDOW = 1 << 20


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(WINDOW, _BASE), np.full(WINDOW, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _power(base: np.uint64, n: int) -> np.ndarray:
    return np.array([pow(int(base), n, 1 << 64)], dtype=np.uint64)


def _word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Polynomial hashes of data[start:stop], by running totals that are taken a window at a time."""
    begun, ended, shift = (np.zeros(len(start), dtype=np.uint64) for _ in range(3))
    carry = np.zeros(1, dtype=np.uint64)
    up, down = _powers()
    for at in range(0, len(data), WINDOW):
        part = data[at : at + WINDOW]
        total = np.cumsum(_BYTES[part] * up[: len(part)]) * _power(_BASE, at) + carry
        for places, out in ((start, begun), (stop, ended)):
            lo, hi = np.searchsorted(places, [at, at + len(part)], side="right")
            out[lo:hi] = total[places[lo:hi] - at - 1]
        lo, hi = np.searchsorted(start, [at, at + len(part)])
        shift[lo:hi] = down[start[lo:hi] - at] * _power(_INVERSE, at)
        carry = total[-1:]
    return mix((ended - begun) * shift)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of texts whose UTF-8 bytes are data[offsets[i]:offsets[i + 1]].

    A text of fewer words than a shingle has its whole sequence as its one shingle; none, none.
    """
    n = len(offsets) - 1
    if not len(data):
        return [np.zeros(0, dtype=np.uint64)] * n
    solid = ~_WHITE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    start, stop = np.flatnonzero(start), np.flatnonzero(stop) + 1
    word = _word_hashes(data, start, stop)
    bounds = np.searchsorted(start, offsets)
    whole = np.zeros(max(len(word) - words + 1, 0), dtype=np.uint64)
    for k in range(words):
        whole += word[k : k + len(whole)] * _PLACES[k % len(_PLACES)] * _U(2 * (k // len(_PLACES)) + 1)
    whole = mix(whole)
    out = []
    for i in range(n):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if b - a >= words:
            s = np.sort(whole[a : b - words + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            few = mix(np.cumsum(word[a:b] * np.arange(3, 2 * (b - a) + 3, 2, dtype=np.uint64) * _BASE))[-1:]
            out.append(few ^ _U(b - a))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


@lru_cache(maxsize=4096)
def band(i: int) -> tuple[int, int, int, int]:
    """(least size, largest size of smaller sets, largest size, chunks) of size band ``i``.

    The band's smaller sets have sizes within a RATIO; the largest size is what their partners can
    have. Two sets of sizes a and b that reach the threshold differ in at most ``differences(a + b)``
    shingles, so all chunks but as many agree. The chunks are so many that a smaller set has, but for
    4 standard deviations, more chunks that hold anything than it can have differences; how many more
    is what a pair must share.
    """
    low = 1
    for _ in range(i):
        low = int(low * RATIO) + 1
    high = int(low * RATIO)
    most = high * DEN // NUM
    differ = differences(high + most)
    n = differ + 1
    while True:
        part = high / n
        mean, spread = n * (1 - exp(-part)), sqrt(max(n * exp(-part) * (1 - (1 + part) * exp(-part)), 0))
        if mean - 4 * spread > differ * 1.1 or n >= 64 * low:
            return low, high, most, n
        n += 1 + n // 64


def differences(sizes):
    """The most shingles in which two sets that reach the threshold differ; ``sizes``: the sum of theirs."""
    return sizes * (DEN - NUM) // (DEN + NUM)


def bands_of(size: int) -> list[int]:
    """The bands that hold sets of this size."""
    out, i = [], 0
    while band(i)[0] <= size:
        if size <= band(i)[2]:
            out.append(i)
        i += 1
    return out


_bands_of = lru_cache(maxsize=1 << 16)(bands_of)


def left_out(full, size):
    """How many keys a set of a size with so many full chunks leaves out."""
    return np.maximum((full - differences(size + size * DEN // NUM) - 1) // 2, 0)


def chunk_keys(found: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(band, full, keys) for each band of a sorted set: a key is the parity (XOR) of a chunk's hashes.

    ``full`` chunks hold something. Two sets that reach the threshold share, in the band of the
    smaller one, at least as many keys as either has full chunks, less their differences. Half of that
    certainty is spent: a set leaves out its largest keys (see ``left_out``), which costs a pair no
    more keys than the larger of the two numbers, as the order is the same for all. Should a set have
    no more full chunks than differences, the keys of its empty chunks come too, and one must agree.
    """
    out, size = [], len(found)
    for i in _bands_of(size):
        n = band(i)[3]
        place = ((found >> _U(32)) * _U(n)) >> _U(32)  # ascending, as the set is
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        at = place[first]
        keys = mix(np.bitwise_xor.reduceat(mix(found ^ _BASE), first) + mix(at + (_U(i + 1) << _U(40))))
        if len(first) <= differences(size + size * DEN // NUM):
            empty = np.setdiff1d(np.arange(n, dtype=np.uint64), at)
            keys = np.concatenate([keys, mix(mix(empty + (_U(i + 1) << _U(40))))])
        elif drop := int(left_out(len(first), size)):
            keys = np.sort(keys)[:-drop]
        out.append((i, len(first), keys))
    return out


def parity_bits(found: np.ndarray, i: int) -> bytes:
    """The bit sketch of a set for band ``i``: each hash flips one bit, so that the Hamming distance of
    two sketches is at most the symmetric difference of the sets. Its width follows the band's sizes."""
    width = 1 << max(9, (2 * band(i)[0]).bit_length())
    flips = np.bincount((mix(found + _PLACES[0]) >> _U(20)).astype(np.int64) & (width - 1), minlength=width)
    return np.packbits(flips.astype(np.uint8) & 1).tobytes()


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows of a, rows of b) distances of sketches given as rows of 64-bit words."""
    out = np.zeros((len(a), len(b)), dtype=np.int32)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[:, k][:, None] ^ b[:, k][None, :])
    return out
