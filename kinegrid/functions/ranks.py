"""Values kept in order while they come and go."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

#: Values of a block; a block of twice as many is cut in two.
BLOCK = 512


class Ranked:
    """A multiset of numbers that adds, removes and finds the k-th smallest without sorting anew.

    Values lie in sorted blocks. An operation touches one block, and looks for
    it among the first values of all.
    """

    def __init__(self, values: Iterable[float] = ()):
        ordered = sorted(values)
        self.blocks = [ordered[k : k + BLOCK] for k in range(0, len(ordered), BLOCK)]
        self.firsts = [b[0] for b in self.blocks]
        self.size = len(ordered)

    def __len__(self) -> int:
        return self.size

    def add(self, value: float) -> None:
        self.size += 1
        if not self.blocks:
            self.blocks, self.firsts = [[value]], [value]
            return
        at = max(bisect_left(self.firsts, value) - 1, 0)
        block = self.blocks[at]
        insort(block, value)
        self.firsts[at] = block[0]
        if len(block) > 2 * BLOCK:
            self.blocks[at : at + 1] = [block[:BLOCK], block[BLOCK:]]
            self.firsts[at : at + 1] = [block[0], block[BLOCK]]

    def remove(self, value: float) -> None:
        """Take out one ``value``, which has to be there."""
        at = max(bisect_left(self.firsts, value) - 1, 0)
        place = bisect_left(self.blocks[at], value) if self.blocks else 0
        if self.blocks and place == len(self.blocks[at]):
            at, place = at + 1, 0
        if at == len(self.blocks) or self.blocks[at][place] != value:
            raise ValueError(f"{value} is not among the values")
        block = self.blocks[at]
        del block[place]
        self.size -= 1
        if block:
            self.firsts[at] = block[0]
        else:
            del self.blocks[at], self.firsts[at]

    def __getitem__(self, k: int) -> float:
        """The k-th smallest, from 0."""
        for block in self.blocks:
            if k < len(block):
                return block[k]
            k -= len(block)
        raise IndexError(k)


def spread(values: Ranked, least: int, low: float = 0.05, high: float = 0.95) -> float:
    """Between two percentiles by floored index; 0 of fewer than ``least`` values."""
    if len(values) < least:
        return 0.0
    top = len(values) - 1
    return values[int(high * top)] - values[int(low * top)]
