"""Sets of k-mers as pages of bits: a page holds 32,768 codes in a row, one bit each.

A page is a row (page, bits), so a set of k-mers of 4^k bits is a table of at most 4^k / 32768 rows of 4 KB, with no row where nothing occurs.  Sets are made,
united, cut and counted by Spark's own bitmap aggregates, page by page; codes are sorted into pages before they are shuffled, so a very
frequent k-mer is one bit of its task's page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import seq as S

#: Fixed value: codes of a page, as the bitmap functions number them.
PAGE = 32_768


def pages(codes: DataFrame) -> DataFrame:
    """(page, bits) of a table with codes (or else k-mers)."""
    code = F.col("code") if "code" in codes.columns else S.kmer_code(F.col("kmer"))
    rows = codes.select((code + 1).alias("nth")).where("nth IS NOT NULL")  # pages are numbered from 1, and so are their codes
    return rows.groupBy(F.bitmap_bucket_number("nth").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("nth")).alias("bits"))


def write_pages(set_: DataFrame, path: str) -> None:
    """A stored set, its pages in order within files that each hold a range of them."""
    set_.repartitionByRange("page").sortWithinPartitions("page").write.mode("overwrite").parquet(path)


def read_pages(spark: SparkSession, path: str, prefix: str = "", k: int | None = None) -> DataFrame:
    """A stored set; with a prefix, only the pages where k-mers of k bases that start with it can lie."""
    table = spark.read.parquet(path)
    if prefix:
        lo = 0
        for c in prefix.upper():
            lo = 4 * lo + S.CODE_ORDER.index(c)
        width = 4 ** (k - len(prefix))
        table = table.where(F.col("page").between(lo * width // PAGE + 1, ((lo + 1) * width - 1) // PAGE + 1))
    return table


def union(*sets: DataFrame) -> DataFrame:
    rows = sets[0]
    for other in sets[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("page").agg(F.bitmap_or_agg("bits").alias("bits"))


def intersection(*sets: DataFrame) -> DataFrame:
    """Pages that every set has, with the bits that all have."""
    rows = sets[0]
    for other in sets[1:]:
        rows = rows.unionByName(other)
    both = rows.groupBy("page").agg(F.count(F.lit(1)).alias("sets"), F.bitmap_and_agg("bits").alias("bits"))
    return both.where((F.col("sets") == len(sets)) & (F.bitmap_count("bits") > 0)).select("page", "bits")


def count(set_: DataFrame) -> Column:
    """Members of the pages of a grouping."""
    return F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0).cast("long"))


def absent_count(set_: DataFrame, k: int) -> DataFrame:
    """(n_present, n_absent) of the space of k-mers."""
    return set_.agg(count(set_).alias("n_present")).withColumn("n_absent", F.lit(4**k).cast("long") - F.col("n_present"))


def members(set_: DataFrame, k: int) -> DataFrame:
    """(code, kmer) of a set: of each page the bytes that are not 0, and of those the bits."""
    byte = F.conv(F.hex(F.substring("bits", F.col("b") + 1, F.lit(1))), 16, 10).cast("int")
    bytes_ = set_.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(PAGE // 8 - 1)))).select("page", "b", byte.alias("byte")).where("byte <> 0")
    bits = bytes_.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7)))).where(F.call_function("getbit", "byte", "i") == 1)
    code = (F.col("page") - 1) * PAGE + F.col("b") * 8 + F.col("i")
    return bits.select(code.alias("code")).withColumn("kmer", S.kmer_of_code(F.col("code"), k))
