"""Sequences scanned in Arrow batches: motif sites, and counts of windows, by arrays of digits instead of expressions on text.

A letter becomes a digit by one look into a table and a window is found by shifted arrays of digits, so a letter costs the same whatever
the motif; only matches are spelled.  Records of a batch lie behind each other and are read in pieces of ``PIECE`` letters that overlap by
a window less one, whatever their lengths, so a record of any length takes the room of a piece besides its own text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import seq as S

#: Letters of a piece; codes that are counted in an array of all, at most.
PIECE, ALL = 1 << 21, 1 << 20
#: The digit of what is no base.
NONE = 4


def _digits(lower: bool) -> np.ndarray:
    """The digit of each byte: bases in the order of codes, U as T, lower case too if ``lower``."""
    table = np.full(256, NONE, np.uint8)
    for i, base in enumerate(S.CODE_ORDER):
        for letter in base + "U" * (base == "T"):
            table[ord(letter)] = i
            if lower:
                table[ord(letter.lower())] = i
    return table


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of a column of strings as bytes, and where each string begins, the end behind them; a null is empty, and a letter of several bytes is its first."""
    n = len(column)
    if not n or column.null_count == n:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    column = column.cast(pa.large_string()).fill_null("")
    _, ends, data = column.buffers()
    starts = np.frombuffer(ends, np.int64)[column.offset : column.offset + n + 1]
    letters = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data else np.zeros(0, np.uint8)
    starts = starts - starts[0]
    if len(letters) and letters.max() > 127:
        first = (letters & 0xC0) != 0x80
        starts = np.concatenate([[0], np.cumsum(first)])[starts]
        letters = letters[first]
    return letters, starts


def _strings(letters: np.ndarray) -> pa.Array:
    """Rows of bytes as strings."""
    n, width = letters.shape
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(letters))])


def _pieces(letters: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, letters) of pieces with all windows of n letters, each window in one."""
    for at in range(0, len(letters) - n + 1, PIECE):
        yield at, letters[at : at + PIECE + n - 1]


def _fit(digits: np.ndarray, pattern: str) -> np.ndarray:
    """Whether the window at each place fits a motif, as far as its letters ask for some bases only."""
    n = len(pattern)
    fits, size = np.ones(len(digits) - n + 1, bool), len(digits) - n + 1
    found: dict[str, np.ndarray] = {}
    for j, letter in enumerate(pattern):
        allowed = S.AMBIGUITY[letter]
        if len(allowed) < 4:
            if allowed not in found:
                found[allowed] = np.isin(np.arange(NONE + 1), [S.CODE_ORDER.index(b) for b in allowed])[digits]
            fits &= found[allowed][j : j + size]
    return fits


def _rolled(digits: np.ndarray, k: int, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    """The code of the k digits at each place and that of their reverse complement, by doubling; a digit of no base counts as some base."""
    one = (digits & 3).astype(kind)
    code = twin = None
    part, mirrored, width, done = one, 3 - one, 1, 0
    while True:
        if k & width:
            if code is None:
                code, twin = part, mirrored
            else:
                size = len(digits) - (done + width) + 1
                code, twin = (code[:size] << 2 * width) | part[done : done + size], twin[:size] | (mirrored[done : done + size] << 2 * done)
            done += width
        if done == k:
            return code, twin
        size = len(part) - width
        part, mirrored = (part[:size] << 2 * width) | part[width:], mirrored[:size] | (mirrored[width:] << 2 * width)
        width *= 2


def _whole(at: np.ndarray, n: int, flaws: np.ndarray | None, starts: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether, record): which windows of n letters at some places of a piece have bases only and lie in one record."""
    record = np.searchsorted(starts, at + begin, "right") - 1
    whole = at + begin + n <= starts[record + 1]
    return (whole & (flaws[at + n] == flaws[at]) if flaws is not None else whole), record


def _flaws(digits: np.ndarray) -> np.ndarray | None:
    """How many places before each one have no base; None if all have."""
    none = digits == NONE
    return np.concatenate([[0], np.cumsum(none, dtype=np.int32)]) if none.any() else None


def _codes(digits: np.ndarray, at: np.ndarray, k: int, turned: bool) -> np.ndarray:
    """The codes of k bases at some places, ``turned`` those of their reverse complements; four bases are looked up at a time."""
    fours = _rolled(digits, 4, np.uint8)[turned] if k > 3 else None
    code = np.zeros(len(at), np.int64)
    for j in range(0, k - 3, 4):
        code = code << 8 | fours[at + (k - 4 - j if turned else j)]
    for j in range(k - k % 4, k):
        digit = digits[at + (k - 1 - j if turned else j)].astype(np.int64)
        code = code << 2 | (3 - digit if turned else digit)
    return code


def _matches(column: pa.Array, pattern: str, upper: bool, forward_only: bool) -> Iterator[tuple]:
    """(strand, digits, places in them, records, places in these) of the keys of what matches a motif in each piece of a batch, a strand at a time."""
    n, ks, ke = len(pattern), pattern.index("X"), pattern.rindex("X") + 1
    table = _digits(upper)
    letters, starts = texts(column)
    for begin, piece in _pieces(letters, n):
        digits = table[piece]
        flaws = _flaws(digits)
        for strand, motif, left in (("+", pattern, ks), ("-", S.reverse_motif(pattern), n - ke))[: 1 if forward_only else 2]:
            at = np.flatnonzero(_fit(digits, motif))
            whole, record = _whole(at, n, flaws, starts, begin)
            at, record = at[whole] + left, record[whole]
            if len(at):
                yield strand, digits, at, record, at + begin - starts[record]


def _key_length(pattern: str, coded: bool) -> int:
    k = pattern.rindex("X") + 1 - pattern.index("X")
    if coded and k > 31:
        raise ValueError("a code holds 31 bases at most")
    return k


def sites(genome: DataFrame, pattern: str, upper: bool = True, forward_only: bool = False, spelled: bool = True) -> DataFrame:
    """(chrom, start0, strand, kmer) or, if not ``spelled``, a code instead of the k-mer, of every window of (chrom, seq) that matches a strict motif on either strand.

    A column ``base`` is added to places."""
    pattern = pattern.upper()
    k = _key_length(pattern, not spelled)
    spell = np.frombuffer(S.CODE_ORDER.encode(), np.uint8)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases = batch.column(2).to_numpy(zero_copy_only=False)
            for strand, digits, at, record, place in _matches(batch.column(1), pattern, upper, forward_only):
                if spelled:
                    found = np.lib.stride_tricks.sliding_window_view(digits, k)[at]
                    key = _strings(spell[found if strand == "+" else 3 - found[:, ::-1]])
                else:
                    key = pa.array(_codes(digits, at, k, strand == "-"))
                strands = pa.array([strand]).take(pa.array(np.zeros(len(at), np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(record)), pa.array(place + bases[record]), strands, key], ["chrom", "start0", "strand", "kmer" if spelled else "code"])

    base = F.col("base") if "base" in genome.columns else F.lit(0).cast("long")
    rows = genome.select("chrom", "seq", base.alias("base"))
    return rows.mapInArrow(scan, "chrom string, start0 long, strand string, " + ("kmer string" if spelled else "code long"))


def site_counts(genome: DataFrame, pattern: str) -> DataFrame:
    """(code, n): how many sites of a strict motif each key has on both strands; a piece's sites are counted before they leave it."""
    pattern = pattern.upper()
    k = _key_length(pattern, True)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for strand, digits, at, _, _ in _matches(batch.column(0), pattern, True, False):
                yield from _counted(_codes(digits, at, k, strand == "-"))

    return genome.select("seq").mapInArrow(scan, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def strand_counts(genome: DataFrame, k: int) -> DataFrame:
    """(code, n) of the windows of k <= 31 bases of (seq), each as the lesser of its code and that of its reverse complement."""
    table, kind = _digits(True), np.int32 if k < 16 else np.int64

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.zeros(4**k, np.int64) if 4**k <= ALL else None
        for batch in batches:
            letters, starts = texts(batch.column(0))
            for begin, piece in _pieces(letters, k):
                digits = table[piece]
                code, twin = _rolled(digits, k, kind)
                keep = _inside(len(code), k, _flaws(digits), starts, begin)
                least = np.minimum(code, twin)[keep]
                if every is not None:
                    every += np.bincount(least, minlength=len(every))
                else:
                    yield from _counted(least)
        if every is not None:
            held = np.flatnonzero(every)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(every[held])], ["code", "n"])

    return genome.select("seq").mapInArrow(scan, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _inside(size: int, n: int, flaws: np.ndarray | None, starts: np.ndarray, begin: int) -> np.ndarray:
    """Of all windows of n letters of a piece, those that have bases only and lie in one record."""
    keep = flaws[n : n + size] == flaws[:size] if flaws is not None else np.ones(size, bool)
    for end in starts[np.searchsorted(starts, begin, "right") : np.searchsorted(starts, begin + size + n - 1, "left")] - begin:
        keep[max(0, end - n + 1) : end] = False
    return keep


def _counted(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(values):
        held, n = np.unique(values, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int64)), pa.array(n.astype(np.int64))], ["code", "n"])


def masked_counts(genome: DataFrame, k: int, keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(code, low, n) of the forward windows of k <= 20 bases of (seq), by their bases and which of these are in lower case (a bit each, the first
    highest).  Only codes that ``keep`` picks of an array of them are counted."""
    if not 1 <= k <= 20:
        raise ValueError("windows have 1 to 20 bases")
    table = _digits(True)
    table[[ord("U"), ord("u")]] = NONE

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, starts = texts(batch.column(0))
            for begin, piece in _pieces(letters, k):
                digits = table[piece]
                code = _rolled(digits, k)[0]
                inside = _inside(len(code), k, _flaws(digits), starts, begin) & keep(code)
                lower, low = (piece >= 97).astype(np.int32), np.zeros(len(code), np.int32)
                for j in range(k):
                    low = low << 1 | lower[j : j + len(code)]
                yield from _counted((code[inside] << k) | low[inside])

    rows = genome.select("seq").mapInArrow(scan, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return rows.select(F.shiftright("code", k).alias("code"), F.col("code").bitwiseAND(F.lit((1 << k) - 1).cast("long")).alias("low"), "n")


def spelled_masked(counted: DataFrame, k: int) -> DataFrame:
    """(kmer, n) of (code, low, n), in lower case where ``low`` has a bit."""
    spell = np.frombuffer((S.CODE_ORDER + S.CODE_ORDER.lower()).encode(), np.uint8)
    shifts = np.arange(k - 1, -1, -1)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, low = (batch.column(c).to_numpy()[:, None] for c in (0, 1))
            kmer = _strings(spell[(code >> 2 * shifts & 3) + 4 * (low >> shifts & 1)])
            yield pa.RecordBatch.from_arrays([kmer, batch.column(2)], ["kmer", "n"])

    return counted.select("code", "low", "n").mapInArrow(spelled, "kmer string, n long")


def recoded(rows: DataFrame, source: str, target: str, name: str) -> DataFrame:
    """(chrom, seq): a column of text with each character of ``source`` as the one of ``target`` at its place; all others are dropped.  Null stays null."""
    table = np.zeros(256, np.uint8)
    for a, b in zip(source, target, strict=True):
        table[ord(a)] = ord(b)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, starts = texts(batch.column(1))
            made = table[letters]
            held = made > 0
            ends = np.concatenate([[0], np.cumsum(held)])[starts]
            nulls = None if not batch.column(1).null_count else pa.py_buffer(np.packbits(batch.column(1).is_valid().to_numpy(zero_copy_only=False), bitorder="little"))
            seq = pa.Array.from_buffers(pa.string(), len(ends) - 1, [nulls, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(made[held])])
            yield pa.RecordBatch.from_arrays([batch.column(0), seq], ["chrom", "seq"])

    return rows.select("chrom", name).mapInArrow(scan, "chrom string, seq string")
