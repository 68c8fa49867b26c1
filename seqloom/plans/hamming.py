"""How to find k-mers within a Hamming distance by equality joins.

A k-mer of two bits a base is cut into b blocks.  If two k-mers differ in at most m
places, one block differs in at most m // b.  So the queries' blocks are written out
with all ways to change so many bases, as XOR masks, and joined by equality.  Few
wide blocks with changes make far fewer candidates than many narrow ones without; the
plan takes the cheapest by the expected number of rows."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, product


@dataclass(frozen=True)
class BlockPlan:
    k: int
    mismatches: int
    blocks: int

    @property
    def changes(self) -> int:
        return self.mismatches // self.blocks

    def spans(self) -> list[tuple[int, int]]:
        """(shift, bits) of each block."""
        cuts = [self.k * j // self.blocks for j in range(self.blocks + 1)]
        return [(2 * (self.k - hi), 2 * (hi - lo)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]

    def masks(self, bits: int) -> list[int]:
        """What to XOR a block with to change at most ``changes`` of its bases."""
        out = []
        for n in range(self.changes + 1):
            for places in combinations(range(bits // 2), n):
                out += [sum(d << (2 * p) for d, p in zip(digits, places, strict=True)) for digits in product((1, 2, 3), repeat=n)]
        return out

    def candidates(self, queries: float, kmers: float) -> float:
        """Rows written out and rows that the join makes, about."""
        return sum(queries * len(self.masks(bits)) * (1 + kmers / 2**bits) for _, bits in self.spans())


def choose(k: int, mismatches: int, queries: float = 1e6, kmers: float = 1e6) -> BlockPlan:
    if not 0 <= mismatches < k <= 31:
        raise ValueError("needs 0 <= mismatches < k <= 31")
    plans = [BlockPlan(k, mismatches, b) for b in range(1, mismatches + 2) if mismatches // b <= 2]
    return min(plans, key=lambda p: p.candidates(queries, kmers))
