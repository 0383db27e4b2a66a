"""The binary Golay code of 23 bits, as keys for fuzzy hashing.

The code is perfect: each 23-bit word lies within 3 bits of exactly one of its
4,096 codewords. So a word decodes to the index of that codeword, and words one
bit apart share an index if one of them also tries its own single-bit changes.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
_GENERATOR = 0b110001110101


def _remainder(words: np.ndarray) -> np.ndarray:
    """Words modulo the generator: their syndromes of 11 bits."""
    r = words.astype(np.uint32)
    for bit in range(22, 10, -1):
        r = np.where((r >> np.uint32(bit)) & 1, r ^ np.uint32(_GENERATOR << (bit - 11)), r).astype(np.uint32)
    return r


@lru_cache(maxsize=1)
def _leaders() -> np.ndarray:
    """For each syndrome the one pattern of at most 3 errors that has it."""
    patterns = np.array([sum(1 << i for i in c) for k in range(4) for c in combinations(range(23), k)], np.uint32)
    table = np.zeros(2048, np.uint32)
    table[_remainder(patterns)] = patterns
    return table


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    words = words.astype(np.uint32)
    return ((words ^ _leaders()[_remainder(words)]) >> np.uint32(11)).astype(np.int64)


def nearby(segments: np.ndarray, bits: int) -> np.ndarray:
    """A row for each segment: the indices of itself and of its single-bit changes; repeats are -1."""
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint32)
    found = decode((segments.astype(np.uint32)[:, None] ^ flips[None, :]).ravel()).reshape(len(segments), bits + 1)
    found.sort(axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found
