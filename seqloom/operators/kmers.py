"""K-mer sets and counts, set operations, and k-mers that do not occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators import absence, scan
from seqloom.operators.sites import HALF, coded_windows, sites
from seqloom.sources.shared import remove_table, written


def kmers(genome: DataFrame, k: int, pam: str = "", prefix: str = "", lenient: bool = False) -> DataFrame:
    """The k-mer of every window on both strands, followed by ``pam`` if given."""
    return sites(genome, "X" * k + pam, prefix=prefix, lenient=lenient).select("kmer")


def kmer_set(found: DataFrame) -> DataFrame:
    return found.select("kmer").distinct().withColumn("code", S.kmer_code(F.col("kmer")))


def kmer_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).withColumn("code", S.kmer_code(F.col("kmer")))


def coded_counts(found: DataFrame) -> DataFrame:
    """(code, n) of sites that are codes already."""
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def strand_counts(genome: DataFrame, k: int) -> DataFrame:
    """(kmer, n, code) of the windows of both strands of (chrom, seq): what :func:`kmer_counts` of :func:`kmers` gives.

    A window is counted once, as the lesser of itself and its reverse complement; both have the same count in the end, so half as many
    rows are made and shuffled as there are windows on two strands.  Up to 31 bases they are longs until they have been counted.
    """
    if k > HALF:
        return _spelled_counts(genome, k)
    counts = scan.strand_counts(genome, k)
    both = _two_strands(F.col("code"), S.revcomp_code(F.col("code"), k))
    return counts.select(F.inline(both)).select(S.spelled(F.col("window"), k).alias("kmer"), "n", F.col("window").alias("code"))


def _two_strands(one: Column, twin: Column) -> Column:
    """A counted window as rows of both strands; one that is its own reverse complement stands on both."""
    row = lambda value, n: F.struct(value.alias("window"), n.alias("n"))
    return F.when(one == twin, F.array(row(one, 2 * F.col("n")))).otherwise(F.array(row(one, F.col("n")), row(twin, F.col("n"))))


def _spelled_counts(genome: DataFrame, k: int) -> DataFrame:
    """The same for k-mers that no code holds: runs of bases are cut into chunks in one pass, each with the first k - 1 bases of the next,
    and the lesser strand is read off the chunk or its reverse complement."""
    size = max(64, 2 * k)
    chunk = f"(?=([ACGT]{{{k},{size + k - 1}}}))[ACGT]{{1,{size}}}"
    chunks = genome.select(F.explode(F.regexp_extract_all(S.normalise(F.col("seq")), F.lit(chunk), F.lit(1))).alias("chunk"))
    places = chunks.select("chunk", S.revcomp(F.col("chunk")).alias("other"), F.explode(F.sequence(F.lit(1), F.length("chunk") - (k - 1))).alias("o"))
    back = F.length("chunk") - (k - 2) - F.col("o")
    lesser = F.least(F.substring(F.col("chunk"), F.col("o"), F.lit(k)), F.substring(F.col("other"), back, F.lit(k)))
    counts = places.select(lesser.alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    both = _two_strands(F.col("kmer"), S.revcomp(F.col("kmer")))
    return counts.select(F.inline(both)).select(F.col("window").alias("kmer"), "n", F.lit(None).cast("long").alias("code"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("kmer").union(b.select("kmer")).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("kmer").intersect(b.select("kmer"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("kmer").subtract(b.select("kmer"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(kmer, in_left, in_right) of what only one side has."""
    sides = a.select("kmer", F.lit(1).alias("l"), F.lit(0).alias("r")).union(b.select("kmer", F.lit(0).alias("l"), F.lit(1).alias("r")))
    both = sides.groupBy("kmer").agg(F.max("l").alias("in_left"), F.max("r").alias("in_right"))
    return both.where("in_left <> in_right")


def equal(a: DataFrame, b: DataFrame) -> bool:
    return symmetric_difference(a, b).isEmpty()


def absent(spark: SparkSession, present: DataFrame, k: int, prefix: str = "", motif: str = "", limit: int = 0) -> DataFrame:
    """(code, kmer) of all k-mers that ``present`` lacks, or of the ``limit`` smallest; see :mod:`seqloom.operators.absence`."""
    return absence.absent(present, k, prefix, motif, limit)


def first_absent(genome: DataFrame, k: int, limit: int) -> DataFrame:
    """(code, kmer) of the ``limit`` smallest k <= 31 bases that no window of either strand has.

    All windows are read, but only those below a bound are shuffled: a bound whose lower part lacks ``limit`` codes settles them; else
    it is raised until it does or the space ends."""
    found = coded_windows(genome.select(S.normalise(F.col("seq")).alias("seq")), k, []).where("bad = 0")
    both = found.select(F.explode(F.array("code", "twin")).alias("code"))
    below = 16 * max(limit, 1 << 16)
    while True:
        below = min(4**k, below)
        held = written(both.where(F.col("code") < below).distinct(), "first-codes")
        if below == 4**k or below - held.count() >= limit:
            return absence.absent(held, k, limit=limit)
        remove_table(held)
        below *= 64


def with_range(spark: SparkSession, codes: DataFrame, lo: int, hi: int) -> DataFrame:
    """(code) of a set with all codes from lo to below hi added."""
    return codes.select("code").union(spark.range(lo, hi).select(F.col("id").alias("code"))).distinct()


def within_range(codes: DataFrame, lo: int, hi: int) -> DataFrame:
    """The rows of a set whose codes lie from lo to below hi."""
    return codes.where((F.col("code") >= lo) & (F.col("code") < hi))


def absent_count(present: DataFrame, k: int) -> DataFrame:
    return absence.absent_count(present, k)


def sample(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows in an order that a hash of the k-mer and the seed decides; all if there are fewer."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "kmer")), "kmer").limit(n)


def first(rows: DataFrame, n: int) -> DataFrame:
    """The n smallest codes; all if n is 0."""
    return rows.orderBy("code").limit(n) if n else rows
