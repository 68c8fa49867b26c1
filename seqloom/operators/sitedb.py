"""Queries on a site table: regions, column ranges, best rows of each region.

A query is written as lines (or with ``/`` for tabs, as single arguments):
``chrom start end`` asks for a region, ``$column min max`` (or ``.column``) bounds a
column, ``!BEST n`` keeps the n best rows of each region by the ``!MIN column`` and
``!MAX column`` lines in their order, ``:file`` names the table to ask, ``#`` starts a comment.
A column is a name or a number from 1.  All bounds hold together and include their ends."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions import seq as S
from seqloom.operators import intervals
from seqloom.sources import stores

NO_BOUND = -10000


@dataclass
class SiteQuery:
    regions: list[tuple[str, int, int]] = field(default_factory=list)
    ranges: list[tuple[str, int | None, int | None]] = field(default_factory=list)
    best: int | None = None
    order: list[tuple[str, bool]] = field(default_factory=list)
    comments: list[str] = field(default_factory=list)
    table: str | None = None


def parse(lines: Iterable[str], query: SiteQuery | None = None) -> SiteQuery:
    query = query or SiteQuery()
    for raw in lines:
        line = raw.rstrip("\r\n")
        if not line.strip():
            continue
        if line[0] == "#":
            query.comments.append(line)
            continue
        parts = [p.strip() for p in (line.split("\t") if "\t" in line else line.split("/") if line[0] != ":" and "/" in line else line.split(None, 2))]
        if line[0] == ":":
            query.table = line[1:].strip()
        elif line[0] in "$.":
            lo, hi = (None if int(x) == NO_BOUND else int(x) for x in parts[1:3])
            query.ranges.append((parts[0][1:], lo, hi))
        elif parts[0] == "!BEST":
            query.best = int(parts[1])
        elif parts[0] in ("!MIN", "!MAX"):
            query.order.append((parts[1], parts[0] == "!MIN"))
        elif line[0] == "!":
            raise ValueError(f"unknown command: {line}")
        else:
            start, end = (int(parts[k].replace(",", "")) if len(parts) > k and parts[k] else 0 for k in (1, 2))
            query.regions.append((parts[0], max(0, start), end))
    return query


def column_name(db: DataFrame, name: str, ignore_missing: bool = False) -> str | None:
    """A column by name or number from 1; an unknown one is an error unless ignored."""
    if name.isdigit() and 1 <= int(name) <= len(db.columns):
        return db.columns[int(name) - 1]
    if name in db.columns:
        return name
    if ignore_missing:
        return None
    raise ValueError(f"no column {name!r}")


def regions_frame(spark: SparkSession, regions: list[tuple[str, int, int]]) -> DataFrame:
    return spark.createDataFrame([(k, c, s, e) for k, (c, s, e) in enumerate(regions)], "rid int, r_chrom string, r_start long, r_end long")


def chromosome_sizes(db: DataFrame) -> DataFrame:
    """(chrom, size) as far as the rows of a table tell."""
    return db.groupBy("chrom").agg(F.max("chromEnd").alias("size"))


def may_overlap(regions: list[tuple[str, int, int]], start: Column, end: Column) -> Column:
    """Whether a row of a chromosome may overlap one of some regions, which are written into the test; an end of 0 or less is no bound."""
    keep = F.lit(False)
    for chrom, first, last in regions:
        one = (F.col("chrom") == chrom) & (end > first)
        keep |= one & (start < last) if last > 0 else one
    return keep


def code_bounds(query: SiteQuery, code: Column, k: int) -> Column:
    """What a query's bounds on percentGC say of k-mers as codes: sites that fail by their bases alone need not be joined with anything."""
    keep, gc = F.lit(True), 100.0 * F.bit_count(code.bitwiseXOR(F.shiftrightunsigned(code, 1)).bitwiseAND(F.lit(S.PAIRS))) / k
    for name, lo, hi in query.ranges:
        if name == "percentGC":
            keep &= (gc >= lo if lo is not None else F.lit(True)) & (gc <= hi if hi is not None else F.lit(True))
    return keep


def in_regions(db: DataFrame, regions: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Rows with each region that they overlap (half-open); an end of 0 or less is the end of the chromosome, and r_end comes back as such.

    ``sizes`` has (chrom, size); without it, the last end in ``db`` counts.  Rows and regions are joined by bins, so a
    row meets only regions near it."""
    sizes = (sizes or chromosome_sizes(db)).select(F.col("chrom").alias("r_chrom"), F.col("size").cast("long"))
    closed = regions.join(sizes, "r_chrom").withColumn("r_end", F.when(F.col("r_end") <= 0, F.col("size")).otherwise(F.col("r_end")))
    asked = closed.select(F.col("r_chrom").alias("chrom"), F.col("r_start").alias("s"), F.col("r_end").alias("e"), "rid")
    rows = db.select("chrom", F.col("chromStart").alias("s"), F.col("chromEnd").alias("e"), F.struct(*db.columns).alias("row"))
    found = intervals.overlap_join(rows, asked, mode="overlap", size=1 << 10)
    return found.select("row.*", F.col("rid_b").alias("rid"), F.col("chrom_b").alias("r_chrom"), F.col("s_b").alias("r_start"), F.col("e_b").alias("r_end"))


def run(db: DataFrame, query: SiteQuery, range_in_name: bool = False, max_items: int | None = None, ignore_missing: bool = False, regions: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Rows of ``db`` that a query asks for, with ``rid`` and the region; without regions, each chromosome is one."""
    sizes = sizes or chromosome_sizes(db)
    for name, lo, hi in query.ranges:
        found = column_name(db, name, ignore_missing)
        if found is not None:
            value = F.coalesce(F.col(found).try_cast("double"), F.lit(0.0))
            db = db.where((value >= lo if lo is not None else F.lit(True)) & (value <= hi if hi is not None else F.lit(True)))
    if regions is None and query.regions:
        regions = regions_frame(db.sparkSession, query.regions)
    if regions is not None:
        rows, group = in_regions(db, regions, sizes), ["rid"]
    else:
        rows, group = db.withColumns({"rid": F.lit(None).cast("int"), "r_chrom": F.col("chrom"), "r_start": F.lit(0).cast("long")}), ["r_chrom"]
        if range_in_name:
            rows = rows.join(sizes.select("chrom", F.col("size").alias("r_end")), "chrom")
    order = [F.col(c).asc() if up else F.col(c).desc() for n, up in query.order if (c := column_name(db, n, ignore_missing))]
    most = query.best if query.best is not None else max_items
    if most is not None:
        ties = [c for c in ("chromStart", "chromEnd", "name") if c in db.columns]
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order, *ties))
        rows = rows.withColumn("rank", rank).where(F.col("rank") <= most)
    if range_in_name:
        rows = rows.withColumn("name", F.concat("r_chrom", F.lit(":"), F.col("r_start").cast("string"), F.lit("-"), F.col("r_end").cast("string"), F.lit("/"), "name"))
    return rows


def header(db: DataFrame, query: SiteQuery, with_header: bool = False, print_comments: bool = False) -> list[str]:
    """The lines that go before a query's result: comments and regions as asked for, and the header."""
    lines = [*query.comments, *[f"#range={c}:{s}-{e}" for c, s, e in query.regions]] if print_comments else []
    return lines + ["#" + "\t".join(db.columns)] * with_header


def ask(spark: SparkSession, lines: Iterable[str], db: DataFrame | None = None, **options) -> DataFrame:
    """What a query written as lines asks for, of ``db`` or of the stored site table that its ``:`` line names.

    Of a stored table only the folders and row groups that the regions can touch are read, and chromosomes have their stored sizes."""
    query = parse(lines)
    if query.table is None:
        if db is None:
            raise ValueError("no table to ask")
        return run(db, query, **options)
    store = stores.open_sites(spark, query.table)
    return run(store.near(query.regions), query, sizes=store.sizes, **options)
