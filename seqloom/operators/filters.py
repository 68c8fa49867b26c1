"""Filters on k-mers: guide quality, triplet lists, copy-number expressions."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PAIRS = np.int64(6148914691236517205)  # every second bit
# The triplets that have a known binding domain.
TRIPLETS = """
GAA GCA GGA GTA GAC GCC GGC GTC GAG GCG GGG GTG GAT GCT GGT GTT
AAA AAC AAG AAT ACA ACC ACG ACT AGA AGC AGG AGT ATA ATG ATT TGA
TGG TAG CAA CAG CAT CCA CCC CCG CCT CGA CGC CGG CGT CTA CTG CAC
CTT
""".split()


def guide_quality(kmer: Column, copies: Column, min_copies: int = 1, max_copies: int = 0, max_t: int = 4, min_gc: float = 0.4, max_gc: float = 0.6, starts_with: str = "", max_tandem_t: int | None = None, allow_lowercase: bool = False) -> Column:
    """Few T in all (and in a row, if asked for), GC within bounds, copies from min to max, both included (0 is no maximum).
    Bases are counted without regard to case; k-mers with lower-case bases go unless allowed."""
    upper = F.upper(kmer)
    gc = F.length(F.regexp_replace(upper, "[^GC]", "")) / F.length(kmer)
    keep = (copies >= min_copies) & (F.length(F.regexp_replace(upper, "[^T]", "")) <= max_t) & gc.between(min_gc, max_gc) & upper.startswith(starts_with.upper())
    if not allow_lowercase:
        keep &= ~kmer.rlike("[acgt]")
    if max_copies:
        keep &= copies <= max_copies
    return keep & ~upper.contains("T" * (max_tandem_t + 1)) if max_tandem_t is not None else keep


def guide_codes(codes: np.ndarray, k: int, max_t: int = 4, min_gc: float = 0.4, max_gc: float = 0.6) -> np.ndarray:
    """The part of :func:`guide_quality` that asks for bases only, of an array of codes of k bases."""
    high = codes >> 1
    t, gc = np.bitwise_count(codes & high & PAIRS), np.bitwise_count((codes ^ high) & PAIRS) / k
    return (t <= max_t) & (gc >= min_gc) & (gc <= max_gc)


def triplets_only(seq: Column) -> Column:
    """Whether a sequence is made of listed triplets; an empty one is."""
    return seq.rlike("^(?:" + "|".join(TRIPLETS) + ")*$")


def copies_match(copies: Column, expression: str) -> Column:
    """``==1``, ``>3&&<=5`` and the like, joined by ``&&``; anything else is an error."""
    keep = F.lit(True)
    for part in expression.split("&&"):
        found = re.fullmatch(r"\s*(==|!=|<=|>=|<|>)\s*(\d+)\s*", part)
        if not found:
            raise ValueError(f"not a comparison: {part!r}")
        op, n = found[1], int(found[2])
        keep &= {"==": copies == n, "!=": copies != n, "<=": copies <= n, ">=": copies >= n, "<": copies < n, ">": copies > n}[op]
    return keep
