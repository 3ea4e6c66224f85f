"""Hashes of word shingles for whole batches of texts, in numpy.

A word's hash is a polynomial of its bytes over 64-bit integers, taken from running sums over the batch; a shingle's
is a mix of its words' hashes in order. Sets of shingles are sorted arrays of distinct 64-bit hashes.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

#: Bytes that part words: space, and 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A fixed random 64-bit value for each byte, and an odd base with its inverse.
BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and INVERSE to the powers 0 to n - 1."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts laid end to end, and how many words each text has."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    low = LOWER[data]
    gap = SPACE[low]
    begin = ~gap
    begin[1:] &= gap[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begin[inner] = ~gap[inner]
    end = ~gap  # the last byte of a word
    end[:-1] &= gap[1:]
    end[inner - 1] = ~gap[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[low] * up, out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    hashes ^= (ends - starts).astype(np.uint64) << np.uint64(56)
    per_text = np.diff(np.searchsorted(starts, offsets))
    return mix64(hashes), per_text


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and each set's size.

    A text with fewer words than `size` has its whole sequence as one shingle; one without words has none.
    """
    hashes, count = words(data, offsets)
    texts = len(count)
    first = np.cumsum(count) - count
    number = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(texts), number)
    at = np.repeat(first - (np.cumsum(number) - number), number) + np.arange(int(number.sum()))
    total = len(hashes)
    mixed = np.full(len(at), 0x243F6A8885A308D3, np.uint64)
    room = np.minimum(size, count)[owner]
    for k in range(size):
        use = room > k
        step = mix64((mixed ^ hashes[np.minimum(at + k, max(total - 1, 0))]) + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) if total else mixed
        mixed = step if use.all() else np.where(use, step, mixed)
    order = np.argsort(mixed, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    mixed, owner = mixed[order], owner[order]
    new = np.ones(len(mixed), bool)
    new[1:] = (mixed[1:] != mixed[:-1]) | (owner[1:] != owner[:-1])
    return mixed[new], np.bincount(owner[new], minlength=texts)
