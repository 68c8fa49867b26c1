"""K-mer counts over sequences that arrive while the query runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators.kmers import kmers, strand_counts
from seqloom.sources.shared import remove


def streaming_counts(genome: DataFrame, k: int, pam: str = "") -> DataFrame:
    """A streaming (kmer, n) from a streaming (chrom, seq); write it in complete or update mode."""
    return kmers(genome, k, pam).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


class CountTable:
    """A stored table of counts, in shards by prefix, that grows by batches of sequences.

    A batch rewrites only the shards that it touches, each into a folder of its own number; then one small file, the batch's list of
    which folder holds which shard, makes them the table.  Until that file is there the table is the one before, and a batch that is already
    in the table is not added again, so a batch may fail anywhere and be tried again.  Readers of the table before keep
    its folders: :meth:`vacuum` deletes what no longer counts.  One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, k: int, prefix_length: int = 2):
        if not 1 <= prefix_length <= min(k, 6):
            raise ValueError("needs a prefix of 1 to 6 bases")  # a list has 4^6 rows at most
        self.spark, self.path, self.k, self.prefix_length = spark, path.rstrip("/"), k, prefix_length

    def _lists(self) -> DataFrame | None:
        """(prefix, folder, batch): all lists of the past."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/lists")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return None
        return self.spark.read.schema("prefix string, folder long, batch long").parquet(f"{self.path}/lists")

    def last_batch(self) -> int | None:
        lists = self._lists()
        return None if lists is None else lists.agg(F.max("batch")).first()[0]

    def shards(self) -> dict[str, int]:
        """The folder of each shard, 4^6 at most."""
        last = self.last_batch()
        return {} if last is None else {r["prefix"]: r["folder"] for r in self._lists().where(F.col("batch") == last).collect() if r["prefix"]}

    def _read(self, shards: dict[str, int]) -> DataFrame:
        folders: dict[int, list[str]] = {}
        for prefix, folder in shards.items():
            folders.setdefault(folder, []).append(prefix)
        if not folders:
            return self.spark.createDataFrame([], "kmer string, n long, prefix string")
        keep = F.lit(False)
        for folder, prefixes in folders.items():
            keep |= (F.col("folder") == folder) & F.col("prefix").isin(prefixes)
        table = self.spark.read.schema("kmer string, n long, folder long, prefix string").parquet(f"{self.path}/shards")
        return table.where(keep).select("kmer", "n", "prefix")

    def counts(self, prefixes: list[str] | None = None) -> DataFrame:
        """(kmer, n), of the shards of some prefixes if given; others are not read."""
        shards = self.shards()
        return self._read({p: f for p, f in shards.items() if prefixes is None or p in prefixes}).drop("prefix")

    def merge(self, genome: DataFrame, batch: int) -> None:
        """Adds the windows of (chrom, seq), for ``foreachBatch``; nothing if this batch or a later one is in the table."""
        last = self.last_batch()
        if last is not None and batch <= last:
            return
        shards = self.shards()
        new = strand_counts(genome, self.k).select("kmer", "n", F.substring("kmer", 1, self.prefix_length).alias("prefix")).persist()
        try:
            touched = [r[0] for r in new.select("prefix").distinct().collect()]
            both = new.unionByName(self._read({p: f for p, f in shards.items() if p in set(touched)}))
            sums = both.groupBy("prefix", "kmer").agg(F.sum("n").alias("n"))
            sums.repartition("prefix", F.pmod(F.xxhash64("kmer"), F.lit(16))).write.mode("overwrite").partitionBy("prefix").parquet(f"{self.path}/shards/folder={batch}")
        finally:
            new.unpersist()
        rows = [*({**shards, **dict.fromkeys(touched, batch)}).items()] or [("", batch)]  # a list of an empty table has one row too
        self.spark.createDataFrame(rows, "prefix string, folder long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists/batch={batch}")

    def follow(self, genome: DataFrame, **trigger) -> StreamingQuery:
        """Merges a streaming (chrom, seq), batch by batch."""
        return genome.writeStream.foreachBatch(self.merge).option("checkpointLocation", f"{self.path}/progress").trigger(**(trigger or {"availableNow": True})).start()

    def vacuum(self) -> None:
        """Deletes folders that hold no shard of the table and lists before the last."""
        last, used = self.last_batch(), set(self.shards().values())
        for r in self._lists().select("batch").distinct().collect() if last is not None else []:
            if r["batch"] not in used:
                remove(self.spark, f"{self.path}/shards/folder={r['batch']}")
            if r["batch"] != last:
                remove(self.spark, f"{self.path}/lists/batch={r['batch']}")
