"""Genome-like inputs made from the driver's tables, in the same way in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import scan

LETTERS = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
#: Characters of a text and the bases they become: letters in turn, digits N, all else dropped.
SOURCE = LETTERS + LETTERS.upper() + DIGITS
TARGET = "".join("ACGT"[i % 4] for i in range(26)) * 2 + "N" * 10
MASKED = "".join("acgt"[i % 4] for i in range(26)) + "".join("ACGT"[i % 4] for i in range(26)) + "N" * 10


def genome(spark: SparkSession, sf_dir: str, masked: bool = False) -> DataFrame:
    """(chrom, seq) of the documents, whole; ``masked`` keeps lower case.  Dealt anew only where the files make fewer partitions than there are cores."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    if docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        docs = docs.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "doc_id")
    return scan.recoded(docs.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("chrom"), "text"), SOURCE, MASKED if masked else TARGET, "text")


def letters(spark: SparkSession, sf_dir: str) -> int:
    """Bytes of the documents' texts, which their sequences don't exceed."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def benchmark_genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return items.select(F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("chrom"), F.regexp_replace(F.translate("text", SOURCE, TARGET), "[^ACGTN]", "").alias("seq"))


def bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    s = F.col("l_partkey") * 10 + F.col("l_orderkey") % 10
    return lines.select(F.concat(F.lit("chr"), F.col("l_suppkey").cast("string")).alias("chrom"), s.cast("long").alias("s"), (s + F.col("l_quantity")).cast("long").alias("e"), F.col("l_returnflag").alias("name"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"))


GENOME_SQL = f"genome AS (SELECT 'doc' || doc_id AS chrom, regexp_replace(translate(text, '{SOURCE}', '{TARGET}'), '[^ACGTN]', '', 'g') AS seq FROM documents)"
MASKED_SQL = f"genome AS (SELECT 'doc' || doc_id AS chrom, regexp_replace(translate(text, '{SOURCE}', '{MASKED}'), '[^ACGTNacgt]', '', 'g') AS seq FROM documents)"
ITEMS_SQL = f"items AS (SELECT 'item' || item_id AS chrom, regexp_replace(translate(text, '{SOURCE}', '{TARGET}'), '[^ACGTN]', '', 'g') AS seq FROM benchmark)"
BED_SQL = """bed AS (SELECT 'chr' || l_suppkey AS chrom, (l_partkey * 10 + l_orderkey % 10)::bigint AS s,
  (l_partkey * 10 + l_orderkey % 10 + l_quantity)::bigint AS e, l_returnflag AS name, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand FROM lineitem)"""


def sites_sql(pattern: str, regex: str, source: str = "genome", name: str = "sites") -> str:
    """The sites of a motif as SQL: both strands are written out and matched by the same expression."""
    n, ks, ke = len(pattern), pattern.index("X"), pattern.rindex("X") + 1
    return f"""{name}_s AS (
  SELECT chrom, '+' AS strand, length(seq) AS len, seq FROM {source} WHERE length(seq) >= {n}
  UNION ALL SELECT chrom, '-', length(seq), translate(reverse(seq), 'ACGTacgt', 'TGCAtgca') FROM {source} WHERE length(seq) >= {n}),
{name}_w AS (SELECT chrom, strand, len, i, substr(seq, i::int + 1, {n}) AS win FROM {name}_s, LATERAL (SELECT unnest(range(0, len - {n} + 1)) AS i)),
{name} AS (
  SELECT chrom, (CASE WHEN strand = '+' THEN i + {ks} ELSE len - i - {ke} END)::bigint AS start0, substr(win, {ks + 1}, {ke - ks}) AS kmer, strand
  FROM {name}_w WHERE regexp_full_match(win, '{regex}'))"""
