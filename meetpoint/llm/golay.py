"""The binary Golay code [23, 12, 7] as a fuzzy hash of 23-bit words.

The code is perfect: every word lies within 3 bits of exactly one codeword.  If
two words differ in one bit, the codeword of one is among the codewords that
the other and its one-bit neighbours decode to (one to six of them).
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a generator polynomial of the code.
GENERATOR = 0b101011100011
LENGTH = 23


def remainder(word: int) -> int:
    for bit in range(LENGTH - 1, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 12 high bits, and the error pattern of every remainder."""
    high = np.array([remainder(m << 11) for m in range(1 << 12)], dtype=np.int64)
    errors = np.zeros(1 << 11, dtype=np.int64)
    for n in range(4):
        for bits in combinations(range(LENGTH), n):
            pattern = sum(1 << b for b in bits)
            errors[remainder(pattern)] = pattern
    return high, errors


def decode(words: np.ndarray) -> np.ndarray:
    """The index (0 to 4095) of the codeword nearest to each 23-bit word."""
    high, errors = tables()
    words = words.astype(np.int64)
    return (words ^ errors[(words & 0x7FF) ^ high[words >> 11]]) >> 11


def nearby(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct indices that each word and its neighbours (in the low ``bits``) decode to.

    Gives (row, index) pairs; row numbers the words.
    """
    flips = np.array([0] + [1 << b for b in range(bits)], dtype=np.int64)
    near = np.sort(decode(words.astype(np.int64)[:, None] ^ flips), axis=1)
    keep = np.ones(near.shape, dtype=bool)
    keep[:, 1:] = near[:, 1:] != near[:, :-1]
    return np.nonzero(keep)[0], near[keep]
