"""Sequence functions as Column expressions; all stay inside Spark's code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base orders of the two integer encodings.
KEY_ORDER = "ACTG"
CODE_ORDER = "ACGT"
# Bases that each ambiguity letter of a motif stands for.
AMBIGUITY = {"A": "A", "C": "C", "G": "G", "T": "T", "W": "AT", "S": "CG", "M": "AC", "K": "GT", "R": "AG", "Y": "CT", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT", "X": "ACGT"}
PAIRS = 6148914691236517205  # every second bit


def normalise(seq: Column) -> Column:
    """Upper case, U as T, anything that is no base as N."""
    return F.regexp_replace(F.translate(F.upper(seq), "U", "T"), "[^ACGT]", "N")


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTacgtUu", "TGCAtgcaAa")


def revcomp(seq: Column) -> Column:
    """Reverse complement; keeps case, leaves other letters as they are."""
    return complement(F.reverse(seq))


def kmer_key(kmer: Column) -> Column:
    """Three bits a base, the first base lowest, closed by 7; null for none or more than 20 bases, where it would not fit."""
    value = F.conv(F.concat(F.lit("7"), F.reverse(F.translate(kmer, KEY_ORDER, "0123"))), 8, 10).cast("long")
    return F.when(kmer.rlike("^[ACGT]{1,20}$"), value)


def kmer_of_key(key: Column) -> Column:
    """The k-mer of a key."""
    digits = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.call_function("shiftright", key, 3 * i).bitwiseAND(7))
    length = F.array_position(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.call_function("shiftright", key, 3 * i)), F.lit(7).cast("long")) - 1
    return F.array_join(F.transform(F.slice(digits, F.lit(1), length.cast("int")), lambda d: F.substring(F.lit(KEY_ORDER), d.cast("int") + 1, F.lit(1))), "")


def kmer_code(kmer: Column) -> Column:
    """Two bits a base, the first base highest; null for none or more than 31 bases, or other letters."""
    return F.when(kmer.rlike("^[ACGT]{1,31}$"), F.conv(F.translate(kmer, CODE_ORDER, "0123"), 4, 10).cast("long"))


def kmer_of_code(code: Column, k: int) -> Column:
    digits = F.concat(F.lit("0" * k), F.conv(code.cast("string"), 10, 4))
    return F.translate(F.substring(digits, -k, k), "0123", CODE_ORDER)


def spelled(code: Column, k: int) -> Column:
    """The k-mer of a code, by conversion to base four instead of base by base."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", CODE_ORDER)


def key_of_code(code: Column, k: int) -> Column:
    """The key of the k-mer of a code, by arithmetic; k is at most 20."""
    turned = code.bitwiseXOR(F.shiftrightunsigned(code, 1).bitwiseAND(F.lit(PAIRS)))  # the digits of G and T change places
    key = F.lit(7 << 3 * k).cast("long")
    for i in range(k):
        key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned(turned, 2 * (k - 1 - i)).bitwiseAND(F.lit(3).cast("long")), 3 * i))
    return key


def revcomp_code(code: Column, k: int) -> Column:
    """The code of the reverse complement, by way of base four."""
    digits = F.lpad(F.conv(code.cast("string"), 10, 4), k, "0")
    return F.conv(F.translate(F.reverse(digits), "0123", "3210"), 4, 10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Bases that differ between two codes of the same length."""
    x = a.bitwiseXOR(b)
    return F.bit_count(F.shiftrightunsigned(x, 1).bitwiseOR(x).bitwiseAND(F.lit(PAIRS)))


def mutation_string(query: Column, found: Column) -> Column:
    """``found`` with the bases that differ from ``query`` in lower case."""
    base = lambda s, i: F.substring(s, i, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(found)), lambda i: F.when(base(found, i) == base(query, i), base(found, i)).otherwise(F.lower(base(found, i)))), "")


def percent_gc(seq: Column) -> Column:
    return 100.0 * F.length(F.regexp_replace(seq, "[^GC]", "")) / F.length(seq)


def longest_t(seq: Column) -> Column:
    return F.array_max(F.transform(F.split(seq, "[^T]+"), lambda x: F.length(x)))


def motif_regex(pattern: str) -> str:
    """A motif of ambiguity letters as a regular expression for whole windows; every place must be a base."""
    try:
        return "^" + "".join(f"[{AMBIGUITY[c]}]" for c in pattern.upper()) + "$"
    except KeyError as e:
        raise ValueError(f"no motif letter: {e}") from None


def literals(pattern: str) -> tuple[int, str]:
    """The longest run of single bases in a motif and its place; an empty one if it has none."""
    runs = [(m.start(), m[0]) for m in re.finditer("[ACGT]+", pattern.upper())]
    return max(runs, key=lambda r: len(r[1]), default=(0, ""))


def reverse_motif(pattern: str) -> str:
    """The motif that the other strand shows where this one matches."""
    other = {frozenset(v): k for k, v in AMBIGUITY.items()}
    swap = str.maketrans("ACGT", "TGCA")
    return "".join(other[frozenset(AMBIGUITY[c].translate(swap))] for c in reversed(pattern.upper()))


def lenient_regex(pattern: str) -> str:
    """Only A, C, G, T are literals and other letters match anything; the X run must still be bases."""
    key = range(pattern.upper().index("X"), pattern.upper().rindex("X") + 1)
    return "^" + "".join(c if c in "ACGT" else "[ACGT]" if i in key else "." for i, c in enumerate(pattern.upper())) + "$"


def register(spark) -> None:
    """Makes the string functions callable from SQL as temporary functions that stay expressions."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION revcomp(s STRING) RETURNS STRING RETURN translate(reverse(s), 'ACGTacgtUu', 'TGCAtgcaAa')")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION hamming2bit(a BIGINT, b BIGINT) RETURNS INT RETURN bit_count((shiftrightunsigned(a ^ b, 1) | (a ^ b)) & {PAIRS})")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION kmer_key(s STRING) RETURNS BIGINT RETURN CASE WHEN s RLIKE '^[ACGT]{1,20}$' THEN aggregate(sequence(length(s), 1, -1), 7L, (a, i) -> shiftleft(a, 3) | cast(locate(substring(s, i, 1), 'ACTG') - 1 AS BIGINT)) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION kmer_code(s STRING) RETURNS BIGINT RETURN CASE WHEN s RLIKE '^[ACGT]{1,31}$' THEN aggregate(sequence(1, length(s)), 0L, (a, i) -> shiftleft(a, 2) | cast(locate(substring(s, i, 1), 'ACGT') - 1 AS BIGINT)) END")
