"""Neighbour profiles over a count table in shards, one folder for each prefix, without reading all of it.

A k-mer with a neighbour within m mismatches shares its first bases with it but for m of them, so a query can only find something in the shards
whose prefix is that near its own.  Shards that no query can reach are never opened; the others are read a few at a time.
After each round the counts so far are written, and queries that are beyond a threshold already, since counts only grow, are
not asked again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators import groups, neighbors
from seqloom.plans.hamming import BlockPlan
from seqloom.sources import files
from seqloom.sources.shared import finished, remove_table, written

#: Bases of a prefix, at most: the list of a table's shards is the driver's.
LONGEST = 6
#: Queries beyond which they are compared in groups and not joined with all changes.
MANY = 10_000


def reachable(q: Column, k: int, p: int, m: int) -> Column:
    """The codes of the prefixes of p bases that differ in at most m from the start of a code of k bases."""
    own = F.shiftrightunsigned(q, 2 * (k - p))
    return F.transform(F.array(*[F.lit(x).cast("long") for x in BlockPlan(p, min(m, p), 1).masks(2 * p)]), lambda x: own.bitwiseXOR(x))


def shard_list(table: DataFrame) -> list[str]:
    """The prefixes of a table in shards, 4^LONGEST at most."""
    found = sorted(r[0] for r in table.select("prefix").distinct().limit(4**LONGEST + 1).collect())
    if len({len(x) for x in found}) > 1 or len(found) > 4**LONGEST:
        raise ValueError(f"a table in shards has prefixes of one length, {LONGEST} at most")
    return found


def code_of(prefix: str) -> int:
    code = 0
    for c in prefix:
        code = 4 * code + S.CODE_ORDER.index(c)
    return code


def rounds(shards: list[str], asked: DataFrame, k: int, m: int, per_round: int) -> list[list[str]]:
    """The shards that any query can reach, some at a time."""
    p = len(shards[0]) if shards else 0
    if not p:
        return [shards] if shards else []
    wanted = {r[0] for r in asked.select(F.explode(reachable(F.col("q"), k, p, m)).alias("shard")).distinct().collect()}  # 4^p at most
    mine = [s for s in shards if code_of(s) in wanted]
    return [mine[at : at + per_round] for at in range(0, len(mine), per_round)]


def shard_table(spark: SparkSession, path: str, shards: list[str]) -> DataFrame:
    """(code, n) of some shards; other folders are not opened."""
    table = files.read_kmers(spark, path, shards)
    return table.select(F.col("code") if "code" in table.columns else S.kmer_code(F.col("kmer")).alias("code"), "n")


def profile(queries: DataFrame, path: str, m: int, k: int, bounds: str = "", per_round: int = 16, bag: bool = True) -> DataFrame:
    """``queries`` (with a column kmer) with n0..nm over the table in shards at ``path``, or ``path.[AA,AC]`` for some of its shards.

    With ``bounds`` (``m0/m1/../mm/total``, -1 is none) only queries within them come back.  Queries that are no k-mers of k bases have null
    counts, or with bounds do not come back."""
    spark = queries.sparkSession
    each, total = neighbors.thresholds(bounds) if bounds else ([None] * (m + 1), None)
    names = [f"n{i}" for i in range(m + 1)]
    coded = queries.withColumn("q", F.when(F.length("kmer") == k, S.kmer_code(F.upper("kmer"))))
    asked = written(coded.select("q").where("q IS NOT NULL").distinct(), "shard-queries")
    shards = shard_list(files.read_kmers(spark, path))
    path = path.split("[")[0].removesuffix(".")
    p = len(shards[0]) if shards else 0
    state = asked.select("q", *[F.lit(0).cast("long").alias(n) for n in names])
    within = F.lit(True)
    for name, most in zip(names, each, strict=True):
        within &= F.col(name) <= most if most is not None else F.lit(True)
    if total is not None:
        within &= sum((F.col(n) for n in names[1:]), F.col("n0")) <= total
    held, many = None, asked.count() > MANY
    for some in rounds(shards, asked, k, m, per_round if bounds else 4**LONGEST):
        here = F.exists(reachable(F.col("q"), k, p, m), lambda x: x.isin([code_of(s) for s in some])) if p else F.lit(True)
        table = shard_table(spark, path, some)
        table, wanted = table if bag else table.withColumn("n", F.lit(1).cast("long")), state.where(here).select("q")
        if many:
            part = groups.counts(wanted, table, k, m, table.count())
        else:
            found = neighbors.pairs(wanted, table, k, m)
            part = found.select("q", *[F.when(F.col("d") == i, F.col("n")).otherwise(0).alias(n) for i, n in enumerate(names)])
        sums = state.unionByName(part).groupBy("q").agg(*[F.sum(n).alias(n) for n in names])
        state = written(sums.where(within), "shard-profiles")
        remove_table(held)
        held = state
    rows = coded.join(state.where(within), "q", "inner" if bounds else "left")
    return finished(rows.drop("q"), "shard-result", asked, held)
