"""The binary Golay code [23, 12, 7]: systematic encoding, syndrome decoding, nearby codewords.

The code is perfect: every 23-bit word has exactly one codeword within three bits.  A codeword's index is its
upper twelve bits.  Tables come from the generator polynomial; the largest has 4,096 entries.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0b110001110101
LENGTH, CHECK_BITS = 23, 11


def _remainder(message: int) -> int:
    value = message << CHECK_BITS
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if value >> bit & 1:
            value ^= GENERATOR << (bit - CHECK_BITS)
    return value


class Golay:
    """Tables for decoding arrays of 23-bit words."""

    def __init__(self) -> None:
        self.parity = np.array([_remainder(m) for m in range(1 << 12)], np.int64)
        words = (np.arange(1 << 12, dtype=np.int64) << CHECK_BITS) | self.parity
        heavy = words[np.bitwise_count(words) == 7]
        # Syndrome to error pattern, and for patterns of three bits the five weight-7 codewords that cover them.
        self.error = np.zeros(1 << CHECK_BITS, np.int64)
        self.cover = np.zeros((1 << CHECK_BITS, 5), np.int64)
        self.far = np.zeros(1 << CHECK_BITS, bool)
        for weight in (1, 2, 3):
            for bits in combinations(range(LENGTH), weight):
                e = sum(1 << b for b in bits)
                s = (e & 2047) ^ int(self.parity[e >> CHECK_BITS])
                self.error[s] = e
                if weight == 3:
                    self.far[s] = True
                    self.cover[s] = heavy[(heavy & e) == e] >> CHECK_BITS

    def decode(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest codeword, syndrome)."""
        syndrome = (words & 2047) ^ self.parity[words >> CHECK_BITS]
        return (words ^ self.error[syndrome]) >> CHECK_BITS, syndrome

    def nearby(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, index) of every codeword within four bits of each word: one, or six for a word three bits off.

        If two words differ in one bit at most, the nearest codeword of either is among those near the other:
        it is within three bits of its own word and so within four of the other.
        """
        index, syndrome = self.decode(words)
        far = np.flatnonzero(self.far[syndrome])
        more = index[far, None] ^ self.cover[syndrome[far]]
        rows = np.concatenate([np.arange(len(words)), np.repeat(far, 5)])
        return rows, np.concatenate([index, more.ravel()])
