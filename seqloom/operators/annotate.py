"""Site tables with profiles, as the 18-column and 22-column tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import seq as S


def one_copy_table(profiled: DataFrame) -> DataFrame:
    """18 columns from BED6 rows with off_site_counts ``n0/n1/n2/n3``; the sequence is taken from the name."""
    n = F.split("off_site_counts", "/")
    seq = F.split("name", "/")[1]
    return profiled.select(
        "chrom", F.col("start0").alias("chromStart"), F.col("end1").alias("chromEnd"), "name", F.col("copies").alias("score"), "strand",
        F.col("start0").alias("thickStart"), F.col("end1").alias("thickEnd"), F.lit("0,0,0").alias("reserved"),
        *[n[i].cast("long").alias(f"n{i}mismatches") for i in range(4)], (n[1].cast("long") + n[2].cast("long") + n[3].cast("long")).alias("totalOffSites"),
        F.col("off_site_counts").alias("offSiteCounts"), seq.alias("spacerSeq"), S.percent_gc(seq).alias("percentGC"), S.longest_t(seq).cast("long").alias("longestTandemT"),
    )


def cluster_table(profiled: DataFrame) -> DataFrame:
    """22 columns from BED12 cluster rows with off_site_counts."""
    n = F.split("off_site_counts", "/")
    seq = F.split("name", "/")[1]
    return profiled.select(
        "chrom", F.col("start0").alias("chromStart"), F.col("end1").alias("chromEnd"), "name", F.col("copies").alias("score"), "strand",
        F.col("thick_start").alias("thickStart"), F.col("thick_end").alias("thickEnd"), F.col("rgb").alias("reserved"), F.col("block_count").alias("blockCount"),
        F.array_join(F.col("block_sizes").cast("array<string>"), ",").alias("blockSizes"), F.array_join(F.col("block_starts").cast("array<string>"), ",").alias("chromStarts"),
        F.col("copies").alias("clusterSize"), *[n[i].cast("long").alias(f"n{i}mismatches") for i in range(4)], (n[1].cast("long") + n[2].cast("long") + n[3].cast("long")).alias("totalOffSites"),
        F.col("off_site_counts").alias("offSiteCounts"), seq.alias("spacerSeq"), S.percent_gc(seq).alias("percentGC"), S.longest_t(seq).cast("long").alias("longestTandemT"),
    )
