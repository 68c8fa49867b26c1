"""How many k-mers of a table lie at each Hamming distance from each query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators import groups, kmers
from seqloom.plans.hamming import BlockPlan, choose

#: Table codes that may share a block before it is cut further, and how many such blocks are listed.
CROWD, MOST_CROWDED = 20_000, 100_000


def _block(code, shift: int, bits: int):
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _changed(block, masks: list[int]):
    """A block with each of the changes."""
    return F.transform(F.array(*[F.lit(x).cast("long") for x in masks]), lambda x: block.bitwiseXOR(x))


def _rest(code, shift: int, bits: int):
    """A code without the bases of a block."""
    return F.shiftleft(F.shiftrightunsigned(code, shift + bits), shift).bitwiseOR(code.bitwiseAND(F.lit((1 << shift) - 1).cast("long")))


def _keys(code, plan: BlockPlan, changed: bool):
    """(i, part) of each block of a code; ``changed`` gives each block with all changes."""

    def keys(i: int, shift: int, bits: int):
        parts = _changed(_block(code, shift, bits), plan.masks(bits) if changed else [0])
        return F.transform(parts, lambda x: F.struct(F.lit(i).alias("i"), x.alias("part")))

    return F.flatten(F.array(*[keys(i, *span) for i, span in enumerate(plan.spans())]))


def _first(a, b, plan: BlockPlan):
    """The first block in which two codes are as near as the plan asks."""
    near = [S.hamming(_block(a, shift, bits), _block(b, shift, bits)) <= plan.changes for shift, bits in plan.spans()]
    first = F.lit(plan.blocks - 1)
    for i in reversed(range(plan.blocks - 1)):
        first = F.when(near[i], i).otherwise(first)
    return first


def _by_block(spans: list, told):
    """What ``told`` gives for the block that column j names."""
    out = told(len(spans) - 1)
    for j in reversed(range(len(spans) - 1)):
        out = F.when(F.col("j") == j, told(j)).otherwise(out)
    return out


def pairs(queries: DataFrame, table: DataFrame, k: int, m: int, plan: BlockPlan | None = None, crowd: int = CROWD) -> DataFrame:
    """(q, code, n, d) of all query codes q and table codes at distance d <= m, each pair once.

    ``queries`` has distinct codes q; ``table`` has distinct codes with n.  A pair that several
    blocks find is kept for the first of them, which an expression tells, so nothing is deduplicated.
    A block that over ``crowd`` codes share is cut further: its rows are joined by blocks of their other bases
    too, so that few codes meet under one key whatever the table repeats.  Of these blocks the list of the
    ``MOST_CROWDED`` largest is broadcast; any other stays one key."""
    plan = plan or choose(k, m)
    spans = plan.spans()
    inner = [choose(k - bits // 2, m, crowd, crowd) if k - bits // 2 > m else None for _, bits in spans]
    asked = F.array(*[F.struct(F.lit(j).alias("j"), _changed(_block(F.col("q"), shift, bits), plan.masks(bits)).alias("blocks")) for j, (shift, bits) in enumerate(spans)])
    left = queries.select("q", F.explode(asked).alias("a")).select("q", "a.j", F.explode("a.blocks").alias("block"))
    held = F.array(*[F.struct(F.lit(j).alias("j"), _block(F.col("code"), shift, bits).alias("block")) for j, (shift, bits) in enumerate(spans)])
    right = table.select("code", "n", F.explode(held).alias("h")).select("code", "n", "h.j", "h.block")
    met = left.join(right, ["j", "block"])
    if any(inner):
        shared = right.groupBy("j", "block").count().where(F.col("count") > crowd).orderBy(F.desc("count"), "j", "block").limit(MOST_CROWDED)
        crowded = F.broadcast(shared.select("j", "block"))
        whole = F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).cast("long").alias("part")))

        def cut(rows: DataFrame, code: str, changed: bool) -> DataFrame:
            keys = _by_block(spans, lambda j: _keys(_rest(F.col(code), *spans[j]), inner[j], changed) if inner[j] else whole)
            return rows.join(crowded, ["j", "block"], "left_semi").withColumn("key", F.explode(keys)).select(*rows.columns, "key.i", "key.part")

        # where no block is crowded, adaptive execution drops both the cut side and the tests of this one
        met = left.join(crowded, ["j", "block"], "left_anti").join(right.join(crowded, ["j", "block"], "left_anti"), ["j", "block"])
        first = _by_block(spans, lambda j: _first(_rest(F.col("q"), *spans[j]), _rest(F.col("code"), *spans[j]), inner[j]) if inner[j] else F.lit(-1))
        again = cut(left, "q", True).join(cut(right, "code", False), ["j", "block", "i", "part"]).where(F.col("i") == first)
        met = met.unionByName(again.select(*met.columns))
    both = met.withColumn("d", S.hamming(F.col("q"), F.col("code"))).where(F.col("d") <= m)
    return both.where(F.col("j") == _first(F.col("q"), F.col("code"), plan)).select("q", "code", "n", "d")


def profile(queries: DataFrame, counts: DataFrame, m: int, bag: bool = True, listing: bool = False, k: int | None = None, plan: BlockPlan | None = None, rows: int = 0) -> DataFrame:
    """Adds n0..nm and off_site_counts to ``queries`` (with a column kmer): sites at each distance, or
    distinct k-mers if not ``bag``.  With ``listing``, also ``found``: each k-mer found with its count, by
    distance and code, bases that differ in lower case; the query itself comes first even with none.
    Queries that are no k-mers get nulls; a column ``code`` of theirs is taken as it is.  k saves a look at the table; a plan for the real numbers of rows may be given.
    With ``rows``, about as many as the table has, neighbours are found in groups (:mod:`seqloom.operators.groups`) and not by joins: for many queries."""
    k = k or counts.select(F.max(F.length("kmer"))).first()[0] or 1
    coded = queries.withColumn("q", F.col("code") if "code" in queries.columns else S.kmer_code(F.upper("kmer")))
    code = F.col("code") if "code" in counts.columns else S.kmer_code(F.col("kmer"))
    table = counts.select(code.alias("code"), F.col("n") if bag else F.lit(1).cast("long").alias("n"))
    asked = coded.where(F.col("q").isNotNull() & (F.length("kmer") == k)).select("q").distinct()
    if rows and not listing:
        per_query = groups.counts(asked, table, k, m, rows)
    else:
        per_query = _summed(groups.pairs(asked, table, k, m, rows) if rows else pairs(asked, table, k, m, plan), m, listing)
    return _told(coded.join(per_query, "q", "left"), m, k, listing).drop("q")


def own_profile(counts: DataFrame, m: int, k: int, bag: bool = True, listing: bool = False) -> DataFrame:
    """(kmer, n0..nm, off_site_counts), with ``listing`` also found, of all k-mers of a table (code, n) among themselves: what :func:`profile` tells of them, in groups and without a join back."""
    table = counts.select("code", F.col("n") if bag else F.lit(1).cast("long").alias("n"))
    rows = counts.count()
    return _told(groups.listed(table, k, m, rows) if listing else groups.counts(None, table, k, m, rows, spell=True), m, k, False)


def _summed(found: DataFrame, m: int, listing: bool) -> DataFrame:
    """n0..nm of each query and, with ``listing``, what was found by distance and code."""
    at = [F.coalesce(F.sum(F.when(F.col("d") == i, F.col("n"))), F.lit(0)).cast("long").alias(f"n{i}") for i in range(m + 1)]
    extra = [F.array_sort(F.collect_list(F.struct("d", "code", "n"))).alias("found")] if listing else []
    return found.groupBy("q").agg(*at, *extra)


def _told(rows: DataFrame, m: int, k: int, listing: bool) -> DataFrame:
    """Counts as a slash list and, with ``listing``, what was found as text."""
    known = F.col("q").isNotNull()
    rows = rows.withColumns({f"n{i}": F.when(known, F.coalesce(f"n{i}", F.lit(0).cast("long"))) for i in range(m + 1)})
    rows = rows.withColumn("off_site_counts", F.when(known, F.concat_ws("/", *[F.col(f"n{i}").cast("string") for i in range(m + 1)])))
    if listing:
        told = F.transform(F.filter("found", lambda x: x["d"] > 0), lambda x: F.concat(S.mutation_string(F.upper("kmer"), S.kmer_of_code(x["code"], k)), F.lit(":"), x["n"].cast("string")))
        rows = rows.withColumn("found", F.when(known, F.concat_ws("/", F.concat(F.upper("kmer"), F.lit(":"), F.col("n0").cast("string")), F.array_join(told, "/"))))
        rows = rows.withColumn("found", F.regexp_replace("found", "/$", ""))
    return rows


def thresholds(text: str) -> tuple[list[int | None], int | None]:
    """``m0/m1/../mk/total`` as bounds for each distance and their sum; -1 is none."""
    parts = [None if int(x) < 0 else int(x) for x in text.split("/")]
    return parts[:-1], parts[-1]


def within(profiled: DataFrame, text: str) -> DataFrame:
    """Rows whose counts stay within thresholds."""
    each, total = thresholds(text)
    keep = F.lit(True)
    for i, most in enumerate(each):
        if most is not None:
            keep &= F.col(f"n{i}") <= most
    if total is not None:
        keep &= sum((F.col(f"n{i}") for i in range(1, len(each))), F.col("n0")) <= total
    return profiled.where(keep)


def absent_within(spark: SparkSession, counts: DataFrame, k: int, bounds: list[int | None], motif: str = "", prefix: str = "", limit: int = 0) -> DataFrame:
    """(code, kmer, n1..nm) of k-mers that the table lacks, match a motif or start with a prefix, and have at most ``bounds[d - 1]``
    sites at each distance d (None is no bound); the first ``limit`` by code, if it is over 0."""
    m = len(bounds)
    lacking = kmers.absent(spark, counts, k, prefix, motif)
    kept = within(profile(lacking, counts, m, k=k), "/".join(str(-1 if x is None else x) for x in [None, *bounds, None]))
    return kmers.first(kept.select("code", "kmer", *[f"n{d}" for d in range(1, m + 1)]), limit)


def merge_profiles(a, b):
    """Two slash lists added place by place."""
    total = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: (x.cast("long") + y.cast("long")).cast("string"))
    return F.array_join(total, "/")


def hit_histogram(queries: DataFrame, hits: DataFrame, m: int) -> DataFrame:
    """Profiles from a list of hits (pattern, mismatches) of another program; queries without a hit get zeros."""
    counts = hits.groupBy(F.upper("pattern").alias("pattern")).agg(*[F.count_if(F.col("mismatches") == i).alias(f"n{i}") for i in range(m + 1)])
    rows = queries.join(counts, F.upper("kmer") == F.col("pattern"), "left").drop("pattern")
    return rows.withColumns({f"n{i}": F.coalesce(f"n{i}", F.lit(0).cast("long")) for i in range(m + 1)})


def hit_search_input(queries: DataFrame, m: int, pam: str = "NNN"):
    """The lines that an external search takes: k-mer, wildcard PAM, mismatches."""
    return queries.select(F.concat_ws(" ", F.concat("kmer", F.lit(pam)), F.lit(m).cast("string")).alias("line"))
