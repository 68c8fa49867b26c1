"""Exact dedup as stateful streaming deduplication.

Documents pass through a Structured Streaming query whose keyed state lies on
disk (RocksDB) and never expires: no watermark, so a copy is recognised however
late it comes.  Per digest the state retains the digest itself, the stable
identifier of the row that stays, that row's content locator (file and row
within the file) and a count.  Equal digests are only *hits*: the full bytes of
each hit are compared with those of the row that stays, found by its locator;
rows that differ (colliding digests) are grouped by their bytes instead.  Of an
earlier call's row that stays, the text is read again by its locator.

Everything runs as DataFrame operations in the JVM.  Texts are shuffled only for
hits, salted by the size of their group, so that a group of copies with a third
of all rows is spread over as many tasks as its size asks for.  The corpus is read twice, once for
digests and once for the texts of hits.

Defined results: a null text counts as empty; null identifiers are larger than
all others; of rows with equal text and identifier the one with the smaller
locator stays; a very long text is one value like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.llm.common import SPACE, finished, fresh_path, join_groups, located, remove, with_locator, written

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Each partition has a store of its own; without this, each one also reserves megabytes of disk for its logs.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Files that a micro-batch takes in at most, which bounds what a retry repeats.
FILES_PER_BATCH = 10_000
#: Copies that one task compares with the row that stays.
COPIES_PER_SALT = 100
#: Most bytes of digests that are broadcast to pick the hits; more are joined by shuffle.
BROADCAST_BYTES = 16 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


class DedupState:
    """Disk-backed deduplication state in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def ingest(self, rows: DataFrame, label: str | None = None) -> None:
        """Take in ``rows`` (digest, id, file, row) that the state hasn't seen.

        A call that failed may be repeated with the same ``label``: rows already laid down under it are
        not laid down again, and the stream takes in no file twice."""
        spark, inbox = self.spark, f"{self.root}/inbox"
        rows = rows.select("digest", "id", "file", "row")
        schema, place = rows.schema, f"{inbox}/load={label or uuid.uuid4().hex}"
        try:
            spark.read.schema(schema).parquet(place)
        except AnalysisException:  # not there yet: one write, whole or not at all
            rows.write.parquet(place)
        updates = f"{self.root}/updates"

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

        before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
        for k, v in STATE_SETTINGS.items():
            spark.conf.set(k, v)
        try:
            state = (
                spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(inbox).groupBy("digest")
                .agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "row")).alias("first"), F.count(F.lit(1)).alias("copies"))
            )
            query = (
                state.writeStream.outputMode("update").foreachBatch(keep)
                .option("checkpointLocation", f"{self.root}/state").trigger(availableNow=True).start()
            )
            query.awaitTermination()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def snapshot(self) -> DataFrame:
        """(digest, first, copies) of all that was taken in: the last update of each digest."""
        schema = "digest string, first struct<no_id:boolean,id:bigint,file:string,row:bigint>, copies bigint"
        updates = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.root}/updates")
        return updates.groupBy("digest").agg(F.min("first").alias("first"), F.max("copies").alias("copies"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, state: DedupState | None = None) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, and ``file``, ``row``, the locator.

    ``digest`` may be any function of the normalised text; a weak one costs byte
    comparisons but not correctness.  With ``state``, earlier documents count too:
    their ids and copies enter keep_id and group_size.
    """
    spark = docs.sparkSession
    located = with_locator(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "exact-source")
    source = located.select("id", "file", "row", normalised(F.col("text")).alias("text"))
    seen = written(source.select("id", "file", "row", digest(F.col("text")).alias("digest"), sha256(F.col("text")).alias("sha")), "exact-digests")
    own_state, state = state is None, state or DedupState(spark, fresh_path(spark, "exact-state"))
    state.ingest(seen)
    known = written(state.snapshot(), "exact-known")
    if own_state:
        remove(spark, state.root)

    # Hits: every row of a digest with more than one row, and the row that stays, once for each salt.
    groups = known.where("copies > 1").withColumn("salts", F.ceil(F.col("copies") / COPIES_PER_SALT).cast("int"))
    n_groups = groups.count()

    def hit(rows: DataFrame) -> DataFrame:
        """Rows of a group, with their group.  Where groups are too many to broadcast, large ones are dealt out before they are joined."""
        rows = rows.withColumn("digest", digest(F.col("text")))
        return rows.join(F.broadcast(groups.drop("copies")), "digest") if n_groups * 300 <= BROADCAST_BYTES else join_groups(rows, groups, "digest", "copies", COPIES_PER_SALT)

    texts = hit(source).withColumn("stays", (F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row")))
    if not own_state and n_groups:
        earlier = _earlier(groups, seen, text_col)
        texts = texts if earlier is None else texts.unionByName(hit(earlier).withColumn("stays", F.lit(True)))
    salts = F.when(F.col("stays"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("file", "row"), F.col("salts")).cast("int")))
    # The salt is not the one that a join may have dealt rows by, so hits are dealt again, by digest and salt.
    hits = texts.select("digest", "id", "file", "row", "text", "stays", F.explode(salts).alias("salt"))
    first_text = F.first("text").over(Window.partitionBy("digest", "salt").orderBy(F.desc("stays")).rowsBetween(Window.unboundedPreceding, 0))
    differ = hits.withColumn("first_text", first_text).where(~F.col("stays") & (F.col("text") != F.col("first_text")))
    own = written(differ.select("digest", "id", "file", "row", "text"), "exact-differ") if n_groups else None

    rows = seen.join(known, "digest")
    if own is None or own.isEmpty():
        keep, size = F.col("first"), F.col("copies")
    else:
        by_bytes = own.groupBy("digest", "text").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "row")).alias("own_first"), F.count(F.lit(1)).alias("own_copies"))
        placed = own.join(by_bytes, ["digest", "text"]).select("file", "row", "own_first", "own_copies")
        gone = own.groupBy("digest").agg(F.count(F.lit(1)).alias("gone"))
        rows = rows.join(placed, ["file", "row"], "left").join(gone, "digest", "left")
        keep = F.coalesce("own_first", "first")
        size = F.coalesce("own_copies", F.col("copies") - F.coalesce("gone", F.lit(0)))
    told = rows.select(
        F.col("id").alias(id_col), keep["id"].alias("keep_id"), size.cast("long").alias("group_size"),
        ((F.col("file") == keep["file"]) & (F.col("row") == keep["row"])).alias("kept"), F.col("sha").alias("text_sha256"), "file", "row",
    )
    return finished(told, "exact-result", seen, known, own)


def _earlier(groups: DataFrame, seen: DataFrame, text_col: str) -> DataFrame | None:
    """The rows that stay from calls before this one, with their texts, read again from the files that their locators name."""
    spark = seen.sparkSession
    firsts = groups.select(F.col("first.file").alias("file"), F.col("first.row").alias("row")).join(seen.select("file", "row"), ["file", "row"], "left_anti")
    files = [r["file"] for r in firsts.select("file").distinct().collect()]
    if not files:
        return None
    texts = spark.read.parquet(*files)
    text = F.col(text_col if text_col in texts.columns else "text").cast("string")
    texts = texts.select(F.lit(None).cast("long").alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), normalised(text).alias("text"))
    return texts.join(firsts, ["file", "row"], "left_semi")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that exact dedup keeps.

    Rows are matched by their locator, so identical rows lose all but one.
    """
    docs = located(docs, "exact-input")
    rows = with_locator(docs, "exact-input", "__file", "__row")
    told = exact_dedup(docs, id_col, text_col)
    kept = told.where("kept").select(F.col("file").alias("__file"), F.col("row").alias("__row"))
    return rows.join(kept, ["__file", "__row"], "left_semi").select(*docs.columns)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("file", "row")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
