"""The commands of the command line as functions: files in, files out.

Paths are Spark's, so they may lie anywhere Spark reads and writes; outputs are folders.  A command returns nothing."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import absence, kmers, neighbors, pages, shards, sitedb, sites
from seqloom.sources import files, stores


def _genome(spark: SparkSession, fastas: str | Iterable[str]) -> DataFrame:
    """The records of one or several FASTA files."""
    paths = [fastas] if isinstance(fastas, str) else list(fastas)
    return reduce(DataFrame.unionByName, [files.read_fasta(spark, p) for p in paths])


def _bounded(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.where(F.col("kmer").startswith(prefix)) if prefix else rows


def bin_sites(spark: SparkSession, fasta: str, out: str, prefix_length: int, pattern: str, prefix: str = "", ignore_lower: bool = False) -> None:
    """Sites of a motif in bins, one folder for each prefix of their k-mers."""
    found = sites.sites(_genome(spark, fasta), pattern, upper=not ignore_lower, prefix=prefix)
    files.write_kmers(found, out, prefix_length)


def bed_of_bins(spark: SparkSession, bins: str, out: str, lo: int = 1, hi: int = 0) -> None:
    """BED6 rows of the sites in bins (``bins`` or ``bins.[AA,AC]``) that have lo to hi copies."""
    found = files.read_kmers(spark, bins).drop("prefix")
    files.write_bed(sites.to_bed6(sites.with_copies(found, lo, hi)), out)


def bed_of_each_bin(spark: SparkSession, bins: str, out: str, lo: int = 1, hi: int = 0) -> None:
    """The same as a folder for each bin, by one job: a k-mer's sites are all in one bin."""
    found = files.read_kmers(spark, bins)
    counted = sites.with_copies(found, lo, hi)
    rows = sites.to_bed6(counted).withColumn("prefix", F.substring(F.split("name", "/")[1], 1, F.length(F.lit(found.select("prefix").first()[0]))))
    rows.repartitionByRange("prefix", "chrom", "start0").sortWithinPartitions("prefix", "chrom", "start0").write.mode("overwrite").partitionBy("prefix").option("sep", "\t").csv(out)


def find_sites(spark: SparkSession, fasta: str, out: str, pattern: str, prefix: str = "", ignore_lower: bool = False, clusters: bool = False, max_copies: int = 0) -> None:
    """BED6 rows of all sites with at most so many copies, or BED12 rows of the k-mers whose sites make clusters."""
    found = sites.sites(_genome(spark, fasta), pattern, upper=not ignore_lower, prefix=prefix)
    if clusters:
        rows = sites.clusters(sites.site_table(found))
        files.write_bed(rows.where(F.col("copies") <= max_copies) if max_copies else rows, out)
    else:
        files.write_bed(sites.to_bed6(sites.with_copies(sites.site_table(found), 1, max_copies)), out)


def _windows(spark: SparkSession, fastas, k: int, prefix: str, pam: str) -> DataFrame:
    """(kmer, n) of both strands, before a PAM (``-`` is none)."""
    genome = _genome(spark, fastas)
    if pam.strip("-"):
        return kmers.kmer_counts(kmers.kmers(genome, k, pam, prefix))
    return _bounded(kmers.strand_counts(genome, k), prefix)


def encode_set(spark: SparkSession, out: str, k: int, fastas: str | Iterable[str], prefix: str = "", pam: str = "-") -> None:
    """The set of k-mers as pages of bits."""
    pages.write_pages(pages.pages(_windows(spark, fastas, k, prefix, pam)), out)


def encode_counts(spark: SparkSession, out: str, k: int, fastas: str | Iterable[str], prefix: str = "", pam: str = "-", prefix_length: int = 2) -> None:
    """The counts of k-mers in shards; counts are longs and do not overflow."""
    files.write_kmers(_windows(spark, fastas, k, prefix, pam), out, prefix_length)


def count_neighbors(spark: SparkSession, set_: str, k: int, m: int, queries: str, out: str, column: str = "", prefix: str = "", add_to: str | None = None) -> None:
    """Lines of a list with the k-mers of a set at each distance; with ``add_to``, an earlier output of the same list, the sums of both."""
    table = pages.members(pages.read_pages(spark, set_, prefix, k), k)
    table = _bounded(table, prefix).withColumn("n", F.lit(1).cast("long"))
    told = neighbors.profile(files.read_queries(spark, queries, column), table, m, k=k).select("line", "off_site_counts")
    if add_to:
        earlier = F.regexp_extract("value", r"^(.*)\t([^\t]*)$", 1), F.regexp_extract("value", r"^(.*)\t([^\t]*)$", 2)
        before = spark.read.text(add_to).select(earlier[0].alias("line"), earlier[1].alias("before")).where("line <> ''").dropDuplicates(["line"])
        told = told.join(before, "line", "left").select("line", F.when(F.col("before").isNull(), F.col("off_site_counts")).otherwise(neighbors.merge_profiles(F.col("off_site_counts"), F.col("before"))).alias("off_site_counts"))
    files.write_profiles(told, out)


def count_off_sites(spark: SparkSession, counts: str, k: int, m: int, queries: str, out: str, column: str = "", bounds: str = "", listing: bool = False) -> None:
    """Lines of a list with the sites at each distance, from a table in shards (``counts`` or ``counts.[AA,AC]``).

    With ``bounds`` only lines within them, and queries are dropped between shards; with ``listing`` each k-mer found is written behind its counts."""
    asked = files.read_queries(spark, queries, column)
    if listing:
        rows = neighbors.profile(asked, files.read_kmers(spark, counts), m, listing=True, k=k)
        rows = neighbors.within(rows, bounds) if bounds else rows
        rows = rows.withColumn("off_site_counts", F.concat_ws("\t", "off_site_counts", "found"))
    else:
        rows = shards.profile(asked, counts, m, k, bounds)
        known = F.col("n0").isNotNull()
        rows = rows.withColumn("off_site_counts", F.when(known, F.concat_ws("/", *[F.col(f"n{i}").cast("string") for i in range(m + 1)])))
    files.write_profiles(rows, out)


def list_absent(spark: SparkSession, set_: str, k: int, out: str, motif: str = "", prefix: str = "", limit: int = 0, sample: int = 0, seed: int = 0) -> None:
    """K-mers that a set lacks, one a line: all, the first, or so many drawn at random."""
    present = pages.members(pages.read_pages(spark, set_), k)
    rows = absence.draw_absent(spark, present, k, sample, seed, prefix, motif) if sample else absence.absent(present, k, prefix, motif, limit)
    rows.select("kmer").write.mode("overwrite").text(out)


def compare_sets(spark: SparkSession, left: str, right: str, k: int, out: str) -> None:
    """K-mers that only one of two sets has: ``kmer<tab>1<tab>0`` or ``kmer<tab>0<tab>1``."""
    a, b = (pages.members(pages.read_pages(spark, p), k) for p in (left, right))
    kmers.symmetric_difference(a, b).write.mode("overwrite").option("sep", "\t").csv(out)


def query_sites(spark: SparkSession, out: str, *lines: str, db: str | None = None, regions: str | None = None, filters: str | None = None, max_items: int | None = None, range_in_name: bool = False, header: bool = False, print_comments: bool = False, ignore_missing: bool = False) -> list[str]:
    """Rows of a stored site table as tab-separated text; returns the lines that go before them.

    A query is made of inline lines and of the lines of a file of regions and one of filters; ``:path`` among them or ``db`` names the table."""
    told = list(lines)
    for path in (regions, filters):
        told += [r[0] for r in spark.read.text(path).collect()] if path else []  # a query, not data
    query = sitedb.parse(told)
    place = query.table or db
    if not place:
        raise ValueError("no table to ask")
    rows = sitedb.ask(spark, [*told, f":{place}"], range_in_name=range_in_name, max_items=max_items, ignore_missing=ignore_missing)
    names = stores.open_sites(spark, place).table().columns
    rows.select(*names).orderBy("chrom", "chromStart", "name").write.mode("overwrite").option("sep", "\t").csv(out)
    return sitedb.header(rows.select(*names), query, header, print_comments)
