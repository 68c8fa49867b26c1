"""K-mers that do not occur: as gaps between those that do, listed up to a limit, or drawn at random, at any k.

The k-mers that match a motif (and start with a prefix) are numbered by code: their places are the digits of a number of mixed radix,
so rank and k-mer give each other by arithmetic, and the space is a range of numbers that nobody has to write
down.  What occurs is a set of ranks; what lies between two neighbours of that set is a gap.

Neighbours are found in blocks of the space, at most ``BLOCKS`` of them, by a window in each; a block's first rank
takes its predecessor from the blocks before it, one row each.  No task sees the whole set and none the whole space."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions import seq as S
from seqloom.sources.shared import finished, remove_table, written

#: Blocks that a space is cut into, at most; their totals are the only thing that one task adds up.
BLOCKS = 1 << 16
#: Ranks that a gap is cut into at a time when it is written out.
STEP = 4096
#: Multipliers of the mixing of a half, below 2^31.
MIX_A, MIX_B, MIX_BITS = 1103515245, 1540483477, 31
ROUNDS = 4


@dataclass(frozen=True)
class Space:
    """The k-mers that match: the bases, as digits of a code, that each place allows."""

    choices: tuple[tuple[int, ...], ...]

    @classmethod
    def of(cls, k: int, prefix: str = "", motif: str = "") -> Space:
        if not 1 <= k <= 31:
            raise ValueError("needs 1 <= k <= 31")
        letters = motif.upper() or "X" * k
        if len(letters) != k or len(prefix) > k:
            raise ValueError(f"motif and prefix are for {k} bases")
        sets = [set(S.AMBIGUITY[c]) for c in letters]
        for i, c in enumerate(prefix.upper()):
            sets[i] &= {c}
        return cls(tuple(tuple(sorted(map(S.CODE_ORDER.index, s))) for s in sets))

    @property
    def k(self) -> int:
        return len(self.choices)

    @property
    def size(self) -> int:
        return prod(map(len, self.choices))

    @property
    def block(self) -> int:
        """Ranks in a block."""
        return max(STEP, -(-self.size // BLOCKS))

    def runs(self) -> list[tuple[int, int, tuple[int, ...]]]:
        """(shift, places, digits) of places, joined where all bases are allowed."""
        out: list[tuple[int, int, tuple[int, ...]]] = []
        for i, digits in enumerate(self.choices):
            if len(digits) == 4 and out and len(out[-1][2]) == 4:
                out[-1] = (2 * (self.k - 1 - i), out[-1][1] + 1, digits)
            else:
                out.append((2 * (self.k - 1 - i), 1, digits))
        return out

    def rank(self, code: Column) -> Column:
        """The number of a code; null where it does not match."""
        rank, fits = F.lit(0).cast("long"), F.lit(True)
        for shift, places, digits in self.runs():
            part = F.shiftrightunsigned(code, shift).bitwiseAND(F.lit(4**places - 1).cast("long"))
            if len(digits) < 4:
                fits &= part.isin(list(digits))
                part = F.lit(0).cast("long") if len(digits) == 1 else F.array_position(F.array(*[F.lit(d).cast("long") for d in digits]), part) - 1
            rank = rank * (4**places if len(digits) == 4 else len(digits)) + part
        return F.when(fits, rank)

    def code(self, rank: str) -> Column:
        """The code of a number in a column."""
        code, weight = F.lit(0).cast("long"), 1
        for shift, places, digits in reversed(self.runs()):
            radix = 4**places if len(digits) == 4 else len(digits)
            part = F.expr(f"({rank} div {weight}L) % {radix}L")
            if len(digits) < 4:
                part = F.element_at(F.array(*[F.lit(d).cast("long") for d in digits]), (part + 1).cast("int"))
            code = code.bitwiseOR(F.shiftleft(part.cast("long"), shift))
            weight *= radix
        return code


def ranks(present: DataFrame, space: Space) -> DataFrame:
    """(rank) of the k-mers of a table (kmer, or code) that lie in the space, each once; those of another length do not."""
    if "kmer" in present.columns:
        present = present.where(F.length("kmer") == space.k)
    if "code" not in present.columns:
        present = present.select("kmer").distinct().select(S.kmer_code(F.col("kmer")).alias("code"))
    return present.select(space.rank(F.col("code")).alias("rank")).where("rank IS NOT NULL").distinct()


def gaps(present: DataFrame, k: int, prefix: str = "", motif: str = "") -> DataFrame:
    """(first, last, n, block): the runs of numbers of a space that ``present`` lacks, ends included; a gap stands in the block of what follows it."""
    space = Space.of(k, prefix, motif)
    if not space.size:
        return present.sparkSession.createDataFrame([], "first long, last long, n long, block long")
    held = written(ranks(present, space).withColumn("block", F.expr(f"rank div {space.block}L")), "absent-ranks")
    # One row a block, BLOCKS at most; the end of the space stands behind the last one.
    edges = held.groupBy("block").agg(F.max("rank").alias("most"))
    ends = edges.unionByName(held.sparkSession.createDataFrame([(space.size // space.block + 1, None)], "block long, most long"))
    before = F.coalesce(F.max("most").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1).cast("long"))
    before = ends.select("block", before.alias("before"))
    rows = held.unionByName(held.sparkSession.createDataFrame([(space.size, space.size // space.block + 1)], "rank long, block long"))
    lag = F.lag("rank").over(Window.partitionBy("block").orderBy("rank"))
    rows = rows.join(F.broadcast(before), "block").withColumn("first", F.coalesce(lag, F.col("before")) + 1).where("first < rank")
    return finished(rows.select("first", (F.col("rank") - 1).alias("last"), (F.col("rank") - F.col("first")).alias("n"), "block"), "absent-gaps", held)


def limited(found: DataFrame, limit: int) -> DataFrame:
    """The gaps, the last one cut, that hold the first ``limit`` numbers: by the totals of the blocks and running sums in the blocks that matter."""
    totals = found.groupBy("block").agg(F.sum("n").alias("total"))
    ahead = F.sum("total").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("block", F.coalesce(ahead, F.lit(0).cast("long")).alias("ahead")).where(F.col("ahead") < limit)
    here = F.sum("n").over(Window.partitionBy("block").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    rows = found.join(F.broadcast(totals), "block").withColumn("ahead", F.col("ahead") + F.coalesce(here, F.lit(0).cast("long"))).where(F.col("ahead") < limit)
    last = F.least("last", F.col("first") + (limit - 1) - F.col("ahead"))
    return rows.select("first", last.alias("last"), (last - F.col("first") + 1).alias("n"), "block")


def listed(found: DataFrame, space: Space) -> DataFrame:
    """(code, kmer) of gaps.  A gap is cut again and again into at most ``STEP`` parts, which are dealt out before the last cut, so a long one is no task's list."""
    step = STEP
    while step * STEP < space.size:
        step *= STEP
    rows = found.select("first", "last")
    while step:
        cut = F.explode(F.sequence("first", "last", F.lit(step).cast("long")))
        rows = rows.withColumn("at", cut).select(F.col("at").alias("first"), F.least("last", F.col("at") + (step - 1)).alias("last"))
        rows = rows.repartition("first") if step == STEP else rows
        step = step // STEP
    return rows.select(F.col("first").alias("rank")).select(space.code("rank").alias("code")).withColumn("kmer", S.kmer_of_code(F.col("code"), space.k))


def absent(present: DataFrame, k: int, prefix: str = "", motif: str = "", limit: int = 0) -> DataFrame:
    """(code, kmer) of all k-mers, or the ``limit`` smallest, that match and that ``present`` lacks."""
    found = gaps(present, k, prefix, motif)
    return listed(limited(found, limit) if limit else found, Space.of(k, prefix, motif))


def absent_count(present: DataFrame, k: int, prefix: str = "", motif: str = "") -> DataFrame:
    """(n_absent) of a space; nothing is listed."""
    space = Space.of(k, prefix, motif)
    return ranks(present, space).agg((F.lit(space.size).cast("long") - F.count(F.lit(1))).alias("n_absent"))


def keys(seed: int) -> list[int]:
    """What a seed adds in each round."""
    return [int.from_bytes(hashlib.sha256(f"{seed}:{r}".encode()).digest()[:4], "big") >> 1 for r in range(ROUNDS)]


def half_bits(size: int) -> int:
    """Bits of each half of the numbers that a bijection of at least ``size`` numbers permutes."""
    return max(1, -(-max(1, size - 1).bit_length() // 2))


def shuffled(draws: DataFrame, size: int, seed: int) -> DataFrame:
    """Adds ``rank``: a bijection of the numbers ``draw`` below 4^half, by rounds that swap two halves and mix one into the other."""
    bits = half_bits(size)
    low = F.lit((1 << bits) - 1).cast("long")

    def turned(both: Column, key: Column) -> Column:
        right = both.bitwiseAND(low)
        t = (right * MIX_A + key) % (1 << MIX_BITS)
        t = (t.bitwiseXOR(F.shiftrightunsigned(t, 13)) * MIX_B) % (1 << MIX_BITS)
        mixed = t.bitwiseXOR(F.shiftrightunsigned(t, 15)).bitwiseAND(low)
        return F.shiftleft(right, bits).bitwiseOR(F.shiftrightunsigned(both, bits).bitwiseXOR(mixed))

    # A fold, as rounds written into each other would double with each.
    return draws.withColumn("rank", F.aggregate(F.array(*[F.lit(x).cast("long") for x in keys(seed)]), F.col("draw"), turned))


def draw_absent(spark: SparkSession, present: DataFrame, k: int, n: int, seed: int = 0, prefix: str = "", motif: str = "") -> DataFrame:
    """(draw, code, kmer) of n k-mers that match and that ``present`` lacks, in the order in which a seeded bijection of the space draws them; all if there are fewer.

    Nothing is listed but what is drawn: as many draws as should do by the part of the space that is absent, and four times as many
    again until n are found or the space ends."""
    space = Space.of(k, prefix, motif)
    empty = spark.createDataFrame([], "draw long, code long, kmer string")
    if not space.size or n < 1:
        return empty
    held = written(ranks(present, space), "absent-ranks")
    lacking, end = space.size - held.count(), 4 ** half_bits(space.size)
    at, more, kept = 0, int(1.2 * n * end / max(1, lacking)) + 100, []
    found = 0
    while found < min(n, lacking) and at < end:
        to = min(end, at + more)
        draws = shuffled(spark.range(at, to).withColumnRenamed("id", "draw"), space.size, seed).where(F.col("rank") < space.size)
        kept.append(written(draws.join(held, "rank", "left_anti").orderBy("draw").limit(n - found), "absent-draws"))
        found += kept[-1].count()
        at, more = to, 4 * more
    if not kept:
        remove_table(held)
        return empty
    rows = kept[0]
    for table in kept[1:]:
        rows = rows.unionByName(table)
    rows = rows.select("draw", space.code("rank").alias("code")).withColumn("kmer", S.kmer_of_code(F.col("code"), k))
    return finished(rows, "absent-drawn", held, *kept)
