"""Packed bitvectors with a directory of popcounts: rank and select.

A bit stands for a byte of text. Blocks of 512 bits have the number of set bits
ahead of them, so a rank adds the popcounts of less than one block, and a
select searches the directory and then one block. All queries of a batch are
answered at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Words of a block; bytes of text whose flags are made at once.
BLOCK, SEGMENT = 8, 1 << 20


class Bits:
    def __init__(self, flags: Callable[[int, int], np.ndarray], size: int):
        """``flags(a, b)`` gives the flags of the places from a to b."""
        packed = np.zeros((size // (64 * BLOCK) + 1) * 8 * BLOCK, np.uint8)
        for a in range(0, size, SEGMENT):
            part = np.packbits(flags(a, min(a + SEGMENT, size)), bitorder="little")
            packed[a // 8 : a // 8 + len(part)] = part
        self.blocks = packed.view("<u8").reshape(-1, BLOCK)
        self.ahead = np.zeros(len(self.blocks) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.blocks).sum(axis=1, dtype=np.int64), out=self.ahead[1:])

    @property
    def total(self) -> int:
        return int(self.ahead[-1])

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        block, word, bit = place >> 9, (place >> 6) & 7, (place & 63).astype(np.uint64)
        words = self.blocks[block]
        below = (np.uint64(1) << bit) - np.uint64(1)
        whole = np.where(np.arange(BLOCK) < word[:, None], np.bitwise_count(words), 0).sum(axis=1, dtype=np.int64)
        return self.ahead[block] + whole + np.bitwise_count(words[np.arange(len(place)), word] & below)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """Places of the set bits of the given numbers, from 1."""
        block = np.searchsorted(self.ahead, nth, side="left") - 1
        words = self.blocks[block]
        upto = np.bitwise_count(words).cumsum(axis=1, dtype=np.int64)
        left = nth - self.ahead[block]
        word = (upto < left[:, None]).sum(axis=1)
        row = np.arange(len(nth))
        left = left - np.where(word > 0, upto[row, word - 1], 0)
        bits = np.unpackbits(words[row, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return (block << 9) + (word << 6) + (bits.cumsum(axis=1) < left[:, None]).sum(axis=1)
