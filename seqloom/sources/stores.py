"""Stored tables laid out for the questions that are asked of them: sites in buckets by k-mer, site tables in order of place."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.sites import in_range
from seqloom.sources import files

#: Folders of a site table, and regions that are written into a filter, at most.
PARTS, LISTED = 64, 1000
#: Bytes of a row group of a site table, so that a region is a small part of a file.
ROW_GROUP = 8 << 20
#: Letters of the sequences whose sites are in one bucket.
LETTERS = 16 << 20


def buckets_for(letters: int, least: int = 16) -> int:
    """How many buckets the sites of sequences of so many letters need for a bucket, which one task writes and one task reads, to grow no further with them."""
    return max(least, -(-letters // LETTERS))


def write_bucketed(found: DataFrame, table: str, path: str, buckets: int = 64) -> None:
    """Sites (with a column kmer) as a table in buckets by k-mer, in order of k-mer within each.

    What groups or joins by k-mer afterwards needs no exchange.  All sites of a k-mer are in one bucket, so this is a layout for
    k-mers of few sites each; tables with k-mers of very many are better grouped as they come."""
    dealt = found.repartition(buckets, "kmer").sortWithinPartitions("kmer", *[c for c in ("chrom", "start0", "strand") if c in found.columns])
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, "kmer").sortBy("kmer").option("path", path).saveAsTable(table)


def bucketed_copies(spark: SparkSession, table: str, lo: int = 1, hi: int = 0) -> DataFrame:
    """The sites of a table in buckets with the copy number of their k-mer, lo to hi of them."""
    found = spark.table(table)
    counts = found.groupBy("kmer").agg(F.count(F.lit(1)).alias("copies")).where(in_range(F.col("copies"), lo, hi))
    return found.join(counts.hint("merge"), "kmer")


def _part(chrom: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(chrom), F.lit(parts)).cast("int")


@dataclass
class SiteStore:
    """A stored site table: its rows (with a column part), the sizes of its chromosomes, and its number of folders."""

    rows: DataFrame
    sizes: DataFrame
    parts: int

    def table(self) -> DataFrame:
        return self.rows.drop("part")

    def near(self, regions: list[tuple[str, int, int]]) -> DataFrame:
        """Rows that may overlap one of some regions.  Few regions are written into the filter, which picks folders by chromosome and row groups by
        chromosome and place; of many, only the folders are."""
        if not regions:
            return self.table()
        if len(regions) > LISTED:
            spark = self.rows.sparkSession
            chroms = spark.createDataFrame([(c,) for c in {r[0] for r in regions}], "chrom string")
            kept = [r[0] for r in chroms.select(_part(F.col("chrom"), self.parts)).distinct().collect()]  # PARTS at most
            return self.rows.where(F.col("part").isin(kept)).drop("part")
        keep = F.lit(False)
        for chrom, start, end in regions:
            one = (F.col("part") == _part(F.lit(chrom), self.parts)) & (F.col("chrom") == chrom) & (F.col("chromEnd") > start)
            keep |= one & (F.col("chromStart") < end) if end > 0 else one
        return self.rows.where(keep).drop("part")


def schema_of(rows: DataFrame) -> str:
    """Which of the two site tables has these columns."""
    for schema in (files.ONE_COPY, files.TWO_PLUS):
        if [f.split()[0] for f in schema.split(", ")] == rows.columns:
            return schema
    raise ValueError("the columns are those of neither site table")


def write_sites(rows: DataFrame, path: str, parts: int = PARTS, made: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """A site table of 18 or 22 columns, in folders by chromosome and in order of place within files; beside it the chromosomes' sizes, and a row about the table.

    With ``made`` the rows, of which only chrom and chromStart must be known, are put in place first and the table is what it makes of each: few columns are shuffled and sorted."""
    dealt = rows.withColumn("part", _part(F.col("chrom"), parts)).repartitionByRange("part", "chrom", "chromStart").sortWithinPartitions("part", "chrom", "chromStart")
    table = made(dealt) if made else dealt.select(*rows.columns)
    schema = schema_of(table)
    typed = table.select(*[F.col(c).cast(kind).alias(c) for c, kind in (f.split() for f in schema.split(", "))], _part(F.col("chrom"), parts).alias("part"))
    typed.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).option("compression", "zstd").partitionBy("part").parquet(f"{path}/rows")
    stored = rows.sparkSession.read.schema(schema).parquet(f"{path}/rows")
    stored.groupBy("chrom").agg(F.max("chromEnd").alias("size")).write.mode("overwrite").parquet(f"{path}/sizes")
    rows.sparkSession.createDataFrame([(parts, schema)], "parts int, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def open_sites(spark: SparkSession, path: str) -> SiteStore:
    about = spark.read.parquet(f"{path}/about").first()
    return SiteStore(spark.read.schema(about["schema"] + ", part int").parquet(f"{path}/rows"), spark.read.parquet(f"{path}/sizes"), about["parts"])
