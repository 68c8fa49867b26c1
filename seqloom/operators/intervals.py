"""Interval joins, chains and block checks on (chrom, s, e) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.sources.shared import written


def _bins(lo: Column, hi: Column, size: Column | int) -> Column:
    return F.explode(F.sequence(F.floor(lo / size), F.floor(F.greatest(lo, hi) / size)))


def _holding(a: DataFrame, points: DataFrame, at: str, size: int = 128) -> DataFrame:
    """Pairs of an interval (chrom, s, e) of ``a`` and a row of ``points`` (chrom_b) whose ``at`` lies in the closed interval.

    Intervals are sorted into classes by length, each with bins as wide as its intervals may be, so that one is
    written out twice at most, however long it is; a point is written out for each class that occurs.  A pair
    meets in one bin only."""
    width = F.greatest(F.col("e") - F.col("s") + 1, F.lit(1))
    classed = a.where("s <= e").withColumn("class", F.ceil(F.greatest(F.log(width / size) / F.log(F.lit(4.0)), F.lit(0.0)) - 1e-9).cast("int"))
    classes = classed.agg(F.collect_set("class")).scalar()  # 30 numbers at most, found when the join runs
    wide = lambda c: F.pow(F.lit(4.0), c) * size
    left = classed.select("*", _bins(F.col("s"), F.col("e"), wide(F.col("class"))).alias("bin"))
    right = points.select("*", F.explode(classes).alias("class_b")).withColumn("bin_b", F.floor(F.col(at) / wide(F.col("class_b"))))
    on = (F.col("chrom") == F.col("chrom_b")) & (F.col("class") == F.col("class_b")) & (F.col("bin") == F.col("bin_b")) & F.col(at).between(F.col("s"), F.col("e"))
    return left.join(right, on).drop("class", "class_b", "bin", "bin_b")


def overlap_join(a: DataFrame, b: DataFrame, mode: str = "endpoint", size: int = 128) -> DataFrame:
    """Pairs of intervals on one chromosome, columns of a as they are and of b with ``_b`` added.

    ``endpoint``: the start or the end of b lies in the closed interval a (so b holding all of a is no
    pair); ``overlap``: half-open intervals share a base.  Either is a matter of points in intervals, joined by equality
    of bins; what the second join finds the first can't have found, so nothing is deduplicated."""
    right = b.select(*[F.col(c).alias(f"{c}_b") for c in b.columns])
    names = [*a.columns, *right.columns]
    if mode == "overlap":
        left, right = a.where("s < e"), right.where("s_b < e_b")
        starts = _holding(left.withColumn("e", F.col("e") - 1), right, "s_b", size).withColumn("e", F.col("e") + 1)
        swapped = right.select(F.col("chrom_b").alias("chrom"), F.col("s_b").alias("s"), (F.col("e_b") - 1).alias("e"), F.struct(*right.columns).alias("of_b"))
        points = left.select(F.col("chrom").alias("chrom_b"), F.col("s").alias("at_a"), F.struct(*a.columns).alias("of_a"))
        inner = _holding(swapped, points, "at_a", size).where("at_a > s").select("of_a.*", "of_b.*")
        return starts.select(*names).unionByName(inner.select(*names))
    ends = F.array(F.struct(F.lit(0).alias("which"), F.col("s_b").alias("at")), F.struct(F.lit(1).alias("which"), F.col("e_b").alias("at")))
    points = right.select("*", F.explode(ends).alias("p")).select("*", F.col("p.at").alias("at_b"))
    found = _holding(a, points, "at_b", size)
    # The end counts only where the start doesn't.
    return found.where((F.col("p.which") == 0) | ~F.col("s_b").between(F.col("s"), F.col("e"))).select(*names)


def chains(items: DataFrame, lo: int, hi: int, least: int, most: int, overlap: bool = False, size: int | None = None, blocks: bool = False) -> DataFrame:
    """Maximal chains of ``least`` to ``most`` distinct intervals (chrom, s, e, name) whose gaps lie in [lo, hi].

    The next one starts beyond the end of the last one or, if ``overlap``, only comes later in order; names then carry ``/strand``, if
    there is one.  A chain ends where its last interval does.  Which interval can follow which is found by one equality join on
    bins of the reach and written down; chains grow along these links by equality and are maximal if they have ``most`` members or their last one has no link.  With ``blocks`` the members come too."""
    size = size or max(1, hi - lo + 1)
    name = F.concat("name", F.lit("/"), "strand") if overlap and "strand" in items.columns else F.col("name")
    rows = items.select("chrom", "s", "e", name.alias("name")).distinct().select("chrom", F.struct("s", "e", "name").alias("x"))
    reach = rows.select("*", _bins(F.col("x.e") + lo, F.col("x.e") + hi, size).alias("bin"))
    nexts = rows.select(F.col("chrom").alias("c"), F.col("x").alias("y"), F.floor(F.col("x.s") / size).alias("b"))
    after = F.col("y") > F.col("x") if overlap else F.col("y.s") > F.col("x.e")
    links = reach.join(nexts, (F.col("chrom") == F.col("c")) & (F.col("bin") == F.col("b")) & (F.col("y.s") - F.col("x.e")).between(lo, hi) & after).select("chrom", "x", "y")
    links = written(links, "chain-links")
    last = links.select("chrom", F.col("x").alias("y")).distinct()
    paths, done = rows.select("chrom", F.array("x").alias("blocks"), F.col("x").alias("y")), []
    for n in range(1, most + 1):
        if n >= least:
            done.append(paths if n == most else paths.join(last, ["chrom", "y"], "left_anti"))
        if n < most:
            follow = links.select("chrom", "x", F.col("y").alias("z"))
            paths = paths.withColumnRenamed("y", "x").join(follow, ["chrom", "x"]).select("chrom", F.concat("blocks", F.array("z")).alias("blocks"), F.col("z").alias("y"))
    rows = reduce(DataFrame.unionByName, [d.select("chrom", "blocks") for d in done])
    return rows.select("chrom", F.col("blocks")[0]["s"].alias("s"), F.element_at("blocks", -1)["e"].alias("e"), F.size("blocks").cast("long").alias("n"), F.array_join(F.transform("blocks", lambda x: x["name"]), ":").alias("name"), *["blocks"] * blocks)


def chain_bed12(chained: DataFrame) -> DataFrame:
    """BED12 rows of chains with their blocks: sizes and starts within the chain; they have no score and no strand."""
    listed = lambda f: F.array_join(F.transform("blocks", f), ",")
    return chained.select(
        "chrom", F.col("s").alias("start0"), F.col("e").alias("end1"), "name", F.lit(0).cast("long").alias("copies"), F.lit(".").alias("strand"), F.col("s").alias("thick_start"), F.col("e").alias("thick_end"), F.lit("0,0,0").alias("rgb"),
        F.col("n").alias("block_count"), listed(lambda b: (b["e"] - b["s"]).cast("string")).alias("block_sizes"), listed(lambda b: (b["s"] - F.col("s")).cast("string")).alias("block_starts"),
    )


def _runs(p: DataFrame, by: list[str], s: str, e: str) -> DataFrame:
    """Joins adjacent runs (s to e, inclusive; within a group they may be equal but share no place otherwise): by, start0 and end0.

    Of sorted runs only those that begin or end a joined one are kept, the first with the place where the next kept one ends: nothing is grouped."""
    turn = Window.partitionBy(*by).orderBy(s)
    first, last = F.coalesce(F.lag(e).over(turn) < F.col(s) - 1, F.lit(True)), F.coalesce(F.lead(s).over(turn) > F.col(e) + 1, F.lit(True))  # equal places are one
    marked = p.withColumns({"first": first, "last": last}).where("first OR last")
    ends = F.when(F.col("last"), F.col(e)).otherwise(F.lead(e).over(turn))
    return marked.withColumn("end0", ends).where("first").select(*by, F.col(s).alias("start0"), "end0")


def islands(points: DataFrame, size: int = 1 << 16, rows: int = 1 << 20) -> DataFrame:
    """Runs of adjacent distinct places s of a chromosome: chrom, start0, end0 (inclusive), n.

    Runs are made within ranges of ``size`` places, so no task sees a whole chromosome; then those that touch the edge of a range,
    two a range at most, are joined.  Ranges are dealt out to as many tasks as give each about so many ``rows``, so a task sorts no more of a larger table."""
    spark = points.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-points.count() // rows))
    p = points.select("chrom", "s").withColumns({"range": F.floor(F.col("s") / size), "e": F.col("s")}).repartition(tasks, "chrom", "range")
    parts = written(_runs(p, ["chrom", "range"], "s", "e").select("chrom", "start0", "end0"), "island-parts")
    edge = (F.pmod("start0", F.lit(size)) == 0) | (F.pmod(F.col("end0") + 1, F.lit(size)) == 0)
    joined = _runs(parts.where(edge), ["chrom"], "start0", "end0")
    return parts.where(~edge).unionByName(joined).withColumn("n", F.col("end0") - F.col("start0") + 1)


def legal_blocks(sizes: str = "block_sizes", starts: str = "block_starts") -> Column:
    """Whether no block starts before the one before it ends; true for fewer than two."""
    n = F.size(starts)
    pair = lambda i: F.element_at(starts, i - 1) + F.element_at(sizes, i - 1) <= F.element_at(starts, i)
    return F.when(n > 1, F.forall(F.sequence(F.lit(2), n), pair)).otherwise(True)


def split_legal(rows: DataFrame, sizes: str = "block_sizes", starts: str = "block_starts") -> tuple[DataFrame, DataFrame]:
    return rows.where(legal_blocks(sizes, starts)), rows.where(~legal_blocks(sizes, starts))


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
