"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from seqloom.plans import queries as Q

HEADLINE = [
    "overlap_join", "chain_radius", "islands", "site_copies", "site_clusters", "kmer_counts", "absent_count", "guide_filter", "triplet_filter", "offsites_bag",
    "kmer_symdiff", "neighbors_set", "db_annotate18", "db_best_n_by_chrom",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        began = time.time()
        Q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 2)
        print(name, times[name], file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    queries = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 2), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "documents": queries}))


if __name__ == "__main__":
    main()
