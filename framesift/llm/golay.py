"""The perfect binary Golay code (23, 12, 7) as a fuzzy hash.

Every 23-bit word lies within distance 3 of exactly one codeword. ``keys`` gives a word the indices of all codewords
within distance 4: one if it lies within 2 of its nearest, six if it lies at 3 (the five blocks of the Steiner system
S(4, 7, 23) through three points give the other five). Two words that differ in at most two bits always share one:
if both errors fall outside a weight-3 error pattern, the block through it and one of the two points is within 4 of
both words.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the cyclic form of the code.
GENERATOR = 0xC75
BITS, MESSAGE, REACH = 23, 12, 4


def remainder(words: np.ndarray) -> np.ndarray:
    """The 11-bit syndromes of 23-bit words: remainders on division by the generator."""
    left = words.astype(np.int64)
    for bit in range(BITS - 1, BITS - MESSAGE - 1, -1):
        left ^= np.where(left >> bit & 1, GENERATOR << (bit - (BITS - MESSAGE)), 0)
    return left


@cache
def offsets() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error patterns of weight at most 4, padded with -1, and how many there are."""
    single = 1 << np.arange(BITS, dtype=np.int64)
    patterns = [np.zeros(1, np.int64)]
    top = np.array([-1])
    for _ in range(REACH):
        grown, tops = [], []
        for at in range(BITS):
            lower = patterns[-1][top < at]
            grown.append(lower | single[at])
            tops.append(np.full(len(lower), at))
        patterns.append(np.concatenate(grown))
        top = np.concatenate(tops)
    every = np.concatenate(patterns)
    syndrome = remainder(every)
    order = np.argsort(syndrome, kind="stable")
    every, syndrome = every[order], syndrome[order]
    counts = np.bincount(syndrome, minlength=1 << (BITS - MESSAGE))
    table = np.full((len(counts), counts.max()), -1, np.int64)
    table[syndrome, np.arange(len(every)) - np.repeat(np.cumsum(counts) - counts, counts)] = every
    return table, counts


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 12-bit indices of the codewords within 4 bits of each 23-bit word, -1 where a word has no more."""
    table, counts = offsets()
    syndrome = remainder(words)
    errors = table[syndrome]
    found = (words.astype(np.int64)[:, None] ^ errors) >> (BITS - MESSAGE)
    return np.where(errors < 0, -1, found), counts[syndrome]
