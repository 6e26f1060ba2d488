"""Compressed bitmaps over 2**15 positions: a sorted array while sparse, packed bits once dense."""

from __future__ import annotations

import numpy as np

BITS = 15
SIZE = 1 << BITS
#: Above so many members the packed form is the smaller one (2 bytes a member against SIZE / 8).
DENSE = SIZE // 16


class Container:
    """One immutable bitmap."""

    __slots__ = ("array", "bits")

    def __init__(self, array: np.ndarray | None, bits: np.ndarray | None) -> None:
        self.array, self.bits = array, bits

    @classmethod
    def of(cls, positions: np.ndarray) -> Container:
        """From positions in any order, repeats allowed."""
        flags = np.zeros(SIZE, bool)
        flags[positions] = True
        return cls._packed(np.packbits(flags))

    @classmethod
    def _packed(cls, bits: np.ndarray) -> Container:
        members = np.flatnonzero(np.unpackbits(bits))
        return cls(members.astype(np.uint16), None) if len(members) <= DENSE else cls(None, bits)

    def packed(self) -> np.ndarray:
        if self.bits is not None:
            return self.bits
        flags = np.zeros(SIZE, bool)
        flags[self.array] = True
        return np.packbits(flags)

    def members(self) -> np.ndarray:
        return self.array if self.bits is None else np.flatnonzero(np.unpackbits(self.bits)).astype(np.uint16)

    def union(self, other: Container) -> Container:
        return Container._packed(self.packed() | other.packed())

    def minus(self, other: Container) -> Container:
        """AND NOT."""
        if self.bits is None:
            hit = (other.packed()[self.array >> 3] >> (7 - (self.array & 7))) & 1
            return Container(self.array[hit == 0], None)
        return Container._packed(self.bits & ~other.packed())

    def nbytes(self) -> int:
        return (self.array if self.bits is None else self.bits).nbytes


EMPTY = Container(np.zeros(0, np.uint16), None)
