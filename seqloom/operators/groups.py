"""Neighbours of very many k-mers at once: each code is shuffled once for each of m + 1 blocks and compared where it lands.

Codes that differ in at most m bases are equal in one of m + 1 blocks, so codes are dealt out by each of their blocks and a pair
meets in the group of a block that both have.  What an equality join would have to write out, each code with all changes, is left to the group:
blocks are cut into pieces, a pair within m has all but m of the pieces in common, and for each choice of m pieces that may differ the group's codes are sorted
by their other bases.  Equal ones are neighbours in that order and are compared.  Codes that share a place differ in the m pieces only,
which bounds how many do, whatever repeats.  The more codes a table has, the more of them share a place without being within m, by the square of
their number; finer pieces keep these few for more sorting, which grows with the codes only.  A group takes halves, thirds or finer ones by what a look at three choices tells.

Between tasks codes go packed, as planes of bytes: a row is what one task has for one group.  A pair is kept in the group of the first block that
both have, for one of the choices that find it, so nothing is deduplicated.  Counts, and what is listed, go packed to the group of the first block of their query
and are put together there; a table that is asked for its own profile sends no code twice."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import cache, wraps
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators import scan

#: Codes of a group, about, and codes that a task packs at a time.
GROUP, PACKED = 400_000, 1 << 20
#: Pairs that a task holds before they are counted or returned.
HELD = 1 << 20
#: Pairs that are compared at a time, and neighbours that are told as text at a time, about.
COMPARED, TOLD = 1 << 16, 1 << 17
PAIRS = np.int64(6148914691236517205)
#: Fixed value: an odd multiplier that spreads blocks over groups.
SPREAD = 2654435761


def spans(k: int, m: int, pieces: int = 2) -> list[list[tuple[int, int]]]:
    """(shift, bits) of the pieces of each of m + 1 blocks of a code."""
    cuts = [k * j // (pieces * (m + 1)) for j in range(pieces * (m + 1) + 1)]
    cut = [(2 * (k - hi), 2 * (hi - lo)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    return [cut[j : j + pieces] for j in range(0, len(cut), pieces)]


@cache
def _masks(k: int, m: int, pieces: int) -> list[int]:
    """The bits of each piece."""
    return [((1 << bits) - 1) << shift for block in spans(k, m, pieces) for shift, bits in block]


def group_of(codes: np.ndarray, k: int, m: int, j: int, groups: int) -> np.ndarray:
    """The group, of so many for each block, that block j of each code falls into."""
    (_, hi), (shift, lo) = spans(k, m)[j]
    block = (codes >> shift) & ((1 << (hi + lo)) - 1)
    return ((block.astype(np.uint64) * np.uint64(SPREAD) & np.uint64(0xFFFFFFFF)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """Numbers from 0 on as planes of bytes, as many as the largest needs, behind the number of planes."""
    planes = np.ascontiguousarray(values, dtype="<i8").view(np.uint8).reshape(-1, 8)
    used = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([used]) + planes[:, :used].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    used = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(used, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :used] = planes.T
    return out.view("<i8").ravel()


def tidy(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of a task that gives its worker's free memory back at its end, as the worker outlives the task."""

    @wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def _fours(of) -> np.ndarray:
    """What ``of`` gives for each base of the four in a byte, as one number for each byte."""
    return np.array([[of(byte >> shift & 3) for shift in (6, 4, 2, 0)] for byte in range(256)], np.uint8).view(np.uint32).ravel()


#: The letters of the four bases in a byte, and what makes those of them small that differ from A.
LETTERS, SMALL = _fours(lambda base: ord(S.CODE_ORDER[base])), _fours(lambda base: 32 * (base > 0))


def spelled(codes: np.ndarray, k: int, small: np.ndarray | None = None) -> pa.Array:
    """The k-mers of codes; in lower case where a code in ``small`` has a base that is not the first."""
    four = -(-k // 4)

    def of_bytes(values: np.ndarray) -> np.ndarray:
        return (values.astype(np.uint64) << np.uint64(2 * (4 * four - k))).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - four :]

    letters = LETTERS[of_bytes(codes)]
    if small is not None:
        letters |= SMALL[of_bytes(small)]
    return scan._strings(letters.view(np.uint8).reshape(-1, 4 * four)[:, :k])


def _dealt(to: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(group, its rows of each column)."""
    order = np.argsort(to, kind="stable")
    ends = np.flatnonzero(np.diff(to[order])) + 1
    for rows in np.split(order, ends):
        if len(rows):
            yield int(to[rows[0]]), *[c[rows] for c in columns]


@cache
def choices(m: int, j: int, pieces: int = 2) -> list[tuple[int, ...]]:
    """Which m pieces may differ in the group of block j: none of that block, and of each before it one at least, as no pair that is kept there shares a whole block before it."""
    others = [p for p in range(pieces * (m + 1)) if p // pieces != j]
    return [c for c in combinations(others, m) if all(any(p // pieces == b for p in c) for b in range(j))]


@cache
def _must_differ(choice: tuple[int, ...], m: int, j: int, pieces: int) -> list[int]:
    """The pieces of a choice that a pair must differ in to be kept for it.  A pair that differs in fewer than m pieces is kept for the choice of these and of the
    first others, so those of a choice that all others precede may be equal."""
    for p in (p for p in range(pieces * (m + 1)) if p // pieces != j):
        if p not in choice:
            return [c for c in choice if c > p]
    return []


def _differ(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x | (x >> 1)) & PAIRS)


def _sorted(codes: np.ndarray, mask: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The bases of a mask in order, and the places of the codes in that order."""
    key, n = codes & np.int64(mask), len(codes)
    place = max(1, (n - 1).bit_length())
    if 2 * k + place > 63:
        order = np.argsort(key, kind="stable")
        return key[order], order
    key = np.sort((key << place) | np.arange(n))  # the place is sorted along with the bases
    return key >> place, key & ((1 << place) - 1)


def _followed(key: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Places in order that equal ones follow, those with most first, and how many have 1, 2, 3 and more of them."""
    at = np.flatnonzero(key[1:] == key[:-1])
    last = np.flatnonzero(np.diff(at, append=-1) != 1)
    after = np.repeat(last + 1, np.diff(last, prepend=-1)) - np.arange(len(at))
    most = int(after.max(initial=0))
    if most > 1:
        rank = most - after
        at = at[np.argsort(rank.astype(np.uint16) if most < 1 << 16 else rank, kind="stable")]  # 16 bits are sorted by their digits
    return at, np.cumsum(np.bincount(after, minlength=1)[:0:-1])[::-1].tolist()


def pieces_for(codes: np.ndarray, k: int, m: int, j: int) -> int:
    """Into how many pieces the blocks are cut for a group's codes: what takes least, where sorting a code costs about as much as comparing two pairs.
    How many pairs share a place is told by three of the choices."""
    every, n = (1 << 2 * k) - 1, len(codes)

    def cost(pieces: int) -> int:
        made, masks, met = choices(m, j, pieces), _masks(k, m, pieces), 0
        looked = {made[len(made) * i // 6] for i in (1, 3, 5)}
        for choice in looked:
            key = np.sort(codes & np.int64(every & ~sum(masks[p] for p in choice)))
            ends = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            shared = np.diff(ends)
            met += int((shared * (shared - 1) // 2).sum())
        return len(made) * (2 * n + met // len(looked))

    pieces, now = 2, cost(2)
    while pieces < -(-k // (m + 1)) and now > len(choices(m, j, pieces + 1)) * 2 * n and (finer := cost(pieces + 1)) < now:
        pieces, now = pieces + 1, finer
    return pieces


def near(codes: np.ndarray, asked: np.ndarray, k: int, m: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, d): places of pairs a <> b of a group's codes, each pair once and one of it asked, that differ in d <= m bases and belong to the group of block j."""
    pieces, every = pieces_for(codes, k, m, j), bool(asked.all())
    masks, before = _masks(k, m, pieces), _masks(k, m, 1)[:j]
    held, size = [], 0
    for choice in choices(m, j, pieces):
        key, order = _sorted(codes, ((1 << 2 * k) - 1) & ~sum(masks[p] for p in choice), k)
        own = codes[order]
        differing = [np.int64(mask) for mask in [*(masks[p] for p in _must_differ(choice, m, j, pieces)), *before]]
        at, enough = _followed(key)
        for step, many in enumerate(enough, 1):
            # small parts, so that many equal ones take no more room
            for some in (at[s : min(s + COMPARED, many)] for s in range(0, many, COMPARED)):
                x = own[some] ^ own[some + step]
                d = _differ(x)
                keep = np.flatnonzero(d <= m)
                some, x, d = some[keep], x[keep], d[keep]
                mine = np.ones(len(x), bool)
                for mask in differing:
                    mine &= (x & mask) != 0
                a, b = order[some[mine]], order[some[mine] + step]
                d = d[mine].astype(np.int64)
                if not every:
                    told = asked[a] | asked[b]
                    a, b, d = a[told], b[told], d[told]
                held.append((a, b, d))
                size += len(a)
                if size >= HELD:
                    yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
                    held, size = [], 0
    if size:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _read(batches: Iterator[pa.RecordBatch]) -> tuple:
    """What a group's rows hold: its number, and each of the packed columns behind it as one array."""
    rows = pa.Table.from_batches(batches)
    return rows[0][0].as_py(), *[np.concatenate([unpacked(x) for x in c.to_pylist()]) for c in rows.columns[1:]]


def _packed_rows(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    number, *columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), *[pa.array(c, pa.binary()) for c in columns]], names)


def _grouped(items: DataFrame, k: int, m: int, groups: int) -> DataFrame:
    """Packed rows (part, codes, ns, asked) of items (code, n, asked), one part for each block and group."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(kept: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, ns, asked = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in kept]).astype(np.int64) for c in range(3))
            order = np.argsort(codes, kind="stable")  # neighbours in a plane are then alike
            codes, ns, asked = codes[order], ns[order], asked[order]
            for j in range(m + 1):
                dealt = _dealt(group_of(codes, k, m, j, groups), codes, ns, asked)
                yield _packed_rows(["part", "codes", "ns", "asked"], [(j * groups + g, *map(packed, columns)) for g, *columns in dealt])

        kept, size = [], 0
        for batch in batches:
            kept.append(batch)
            size += batch.num_rows
            if size >= PACKED:
                yield from flush(kept)
                kept, size = [], 0
        if size:
            yield from flush(kept)

    return items.select("code", "n", "asked").mapInArrow(tidy(pack), "part int, codes binary, ns binary, asked binary")


def _items(queries: DataFrame | None, table: DataFrame) -> DataFrame:
    """(code, n, asked) of a table that is asked for itself, or of queries (q) and a table."""
    held = table.select("code", F.col("n").cast("long").alias("n"), F.lit(queries is None).cast("int").alias("asked"))
    if queries is None:
        return held
    return held.unionByName(queries.select(F.col("q").alias("code"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("asked")))


def _dealt_out(rows: DataFrame, by: str, parts: int):
    # told how many, as what is packed is small by bytes and long to compare
    return rows.repartition(max(parts, rows.sparkSession.sparkContext.defaultParallelism), by).groupBy(by)


def groups_for(rows: int) -> int:
    return max(1, -(-rows // GROUP))


def pairs(queries: DataFrame | None, table: DataFrame, k: int, m: int, rows: int) -> DataFrame:
    """(q, code, n, d) as :func:`neighbors.pairs` gives them, of about ``rows`` codes; of a table with itself if ``queries`` is None."""
    groups = groups_for(rows)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, codes, ns, asked = _read(batches)
        j = part // groups

        def told(a, b, d) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes[a]), pa.array(codes[b]), pa.array(ns[b]), pa.array(d.astype(np.int32))], ["q", "code", "n", "d"])

        if j == 0:
            own = np.flatnonzero((asked > 0) & (ns > 0))
            yield told(own, own, np.zeros(len(own)))
        for a, b, d in near(codes, asked > 0, k, m, j):
            for x, y in ((a, b), (b, a)):
                keep = (asked[x] > 0) & (ns[y] > 0)
                yield told(x[keep], y[keep], d[keep])

    return _dealt_out(_grouped(_items(queries, table), k, m, groups), "part", (m + 1) * groups).applyInArrow(tidy(meet), "q long, code long, n long, d int")


def counts(queries: DataFrame | None, table: DataFrame, k: int, m: int, rows: int, spell: bool = False) -> DataFrame:
    """(q, n0..nm): the sums of n at each distance of all queries, of about ``rows`` codes; of a table with itself if ``queries`` is None.  With ``spell`` also kmer."""
    groups, wide = groups_for(rows), m + 1

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, codes, ns, asked = _read(batches)
        j = part // groups
        sums = np.zeros(len(codes) * wide, np.int64)
        for a, b, d in near(codes, asked > 0, k, m, j):
            for x, y in ((a, b), (b, a)):
                np.add.at(sums, x * wide + d, ns[y])
        sums = sums.reshape(-1, wide)
        if j == 0:
            sums[:, 0] += ns
        told = np.flatnonzero((asked > 0) & ((j == 0) | sums.any(axis=1)))
        if len(told):
            dealt = _dealt(group_of(codes[told], k, m, 0, groups), codes[told], sums[told])
            yield _packed_rows(["owner", "codes", "sums"], [(owner, packed(c), packed(s.ravel())) for owner, c, s in dealt])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, codes, sums = _read(batches)
        order = np.argsort(codes, kind="stable")
        first = np.flatnonzero(np.diff(codes[order], prepend=-1))
        total, own = np.add.reduceat(sums.reshape(-1, wide)[order], first, axis=0), codes[order[first]]
        kmer = [spelled(own, k)] * spell
        yield pa.RecordBatch.from_arrays([pa.array(own), *kmer, *[pa.array(total[:, i]) for i in range(wide)]], ["q", *["kmer"] * spell, *[f"n{i}" for i in range(wide)]])

    met = _dealt_out(_grouped(_items(queries, table), k, m, groups), "part", wide * groups).applyInArrow(tidy(meet), "owner int, codes binary, sums binary")
    return _dealt_out(met, "owner", groups).applyInArrow(tidy(add), "q long, " + "kmer string, " * spell + ", ".join(f"n{i} long" for i in range(wide)))


def listed(table: DataFrame, k: int, m: int, rows: int) -> DataFrame:
    """(q, kmer, n0..nm, found) of a table of about ``rows`` codes with itself: sums as :func:`counts` gives them, and as text each neighbour with its n, by distance and code,
    bases that differ in lower case, the query itself first."""
    groups, wide = groups_for(rows), m + 1
    names = ["q", "kmer", *[f"n{i}" for i in range(wide)], "found"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, codes, ns, asked = _read(batches)
        j = part // groups

        def sent(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            dealt = _dealt(group_of(codes[a], k, m, 0, groups), codes[a], codes[b], ns[b])
            return _packed_rows(["owner", "codes", "found", "ns"], [(owner, *map(packed, columns)) for owner, *columns in dealt])

        if j == 0:
            yield sent(np.arange(len(codes)), np.arange(len(codes)))
        for a, b, _ in near(codes, asked > 0, k, m, j):
            yield sent(np.concatenate([a, b]), np.concatenate([b, a]))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, q, found, ns = _read(batches)
        d = _differ(q ^ found)
        order = np.lexsort((found, d, q))
        first = np.append(np.flatnonzero(np.diff(q[order], prepend=-1)), len(q))
        # the queries of about TOLD neighbours at a time
        cuts = np.unique(np.append(np.searchsorted(first[:-1], np.arange(0, len(q), TOLD)), len(first) - 1))
        for some in (first[lo : hi + 1] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)):
            rows, ends = order[some[0] : some[-1]], some - some[0]
            own = q[rows[ends[:-1]]]
            sums = [np.add.reduceat(np.where(d[rows] == i, ns[rows], 0), ends[:-1]) for i in range(wide)]
            each = pc.binary_join_element_wise(spelled(found[rows], k, q[rows] ^ found[rows]), pa.array(ns[rows]).cast(pa.string()), ":")
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each), "/")
            yield pa.RecordBatch.from_arrays([pa.array(own), spelled(own, k), *map(pa.array, sums), text], names)

    met = _dealt_out(_grouped(_items(None, table), k, m, groups), "part", wide * groups).applyInArrow(tidy(meet), "owner int, codes binary, found binary, ns binary")
    return _dealt_out(met, "owner", groups).applyInArrow(tidy(tell), "q long, kmer string, " + ", ".join(f"n{i} long" for i in range(wide)) + ", found string")
