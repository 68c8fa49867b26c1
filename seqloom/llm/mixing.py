"""Mixing sources to target weights by weighted fair queueing.

Each source shuffles its documents by a hash of their ids and offers them in that
order, again and again for as many epochs as repeats are allowed.  An offered
document's virtual finish time is the source's words up to and with it, divided
by the source's target.  Targets add up to the budget, so the budget is used up where
virtual time reaches 1: there the mix is truncated, inside a document if need be.  A word of a source has
a virtual time too, its number divided by the target, so what a document gives is told by
where virtual time 1 falls in it.  A global range sort by virtual finish time interleaves the sources
fairly; running sums over its ranges give each document its place in the mix.

Targets come from filling by weight: sources share the budget by weight, none
gets more than ``epochs`` times its size, and what is over is shared again.

A source may hold any part of all rows.  Its running sum of words is therefore
made in two levels: the hash cuts each source into about sqrt(rows) buckets, whose
totals (one row each) are summed up per source, and a window runs within a bucket.
Windows over everything see one row per source (the targets) or per range of the sort only.

Defined results: a null text has no words; a null source is a source of its own,
after all others; documents without words take nothing; equal ids are ordered by
size; a very long text counts whole; an empty table gives no rows; all other columns pass through :func:`mix`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.llm.common import WORD, finished, words, written

SHARE, EPOCHS, WEIGHTS, SEED = 1.5, 2, (5, 2, 1), 17
_KEYS = ["__source", "__bucket"]


def _offered(docs: DataFrame, id_: Column, text: Column, source: Column, *kept: Column) -> DataFrame:
    """The columns kept, size, the source's key and what tells its place in the shuffled order."""
    return docs.select(
        *kept, words(text).alias("__size"), F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t")).alias("__source"),
        F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(id_.cast("string"), F.lit("null")))).alias("__hash"),
    )


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(__source, source_size, target) from (__source, source_size), one row per source."""
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy("__source")
    nth = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("cap", epochs * F.col("source_size"))
    filling = everything.orderBy(F.col("cap") / F.col("w"), "__source")
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(filling.rowsBetween(0, Window.unboundedFollowing))
    budget = F.lit(share) * F.sum("source_size").over(everything)
    # The level at which a unit of weight is filled: it rises while smaller sources are full and falls after.
    rows = rows.withColumn("level", (budget - before) / rest)
    level = F.max("level").over(everything)
    return rows.select("__source", "source_size", F.least(F.col("cap").cast("double"), level * F.col("w")).alias("target"))


def queue(offered: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, order: tuple[Column, ...] = ()) -> DataFrame:
    """Adds source_size, target and, for each time that a document is offered, epoch, virtual_finish and taken (0 beyond the budget)."""
    n = offered.count()
    buckets = 1 << max(4, math.ceil(math.log2(max(1, n)) / 2))
    offered = offered.withColumn("__bucket", F.floor(F.conv(F.substring("__hash", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("long"))
    totals = offered.groupBy(*_KEYS).agg(F.sum("__size").alias("bucket_size"))
    sources = targets(totals.groupBy("__source").agg(F.sum("bucket_size").alias("source_size")), weights, share, epochs)
    ahead = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0))).join(sources, "__source").drop("bucket_size")
    within = Window.partitionBy(*_KEYS).orderBy("__hash", "__size", *order)
    rows = offered.join(starts, _KEYS).withColumn("__nth", F.row_number().over(within))
    rows = rows.withColumn("start", F.col("ahead") + F.sum("__size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size"))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    start = F.col("start") + (F.col("epoch") - 1) * F.col("source_size")
    goal = F.floor("target").cast("long")
    return rows.withColumns({
        "virtual_finish": F.when(F.col("target") > 0, (start + F.col("__size")) / F.col("target")),
        "taken": F.greatest(F.lit(0), F.least(F.col("__size"), goal - start)).cast("long"),
    })


def first_words(text: Column, n: Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each time that a document is taken,
    range-sorted by virtual finish time.  A document that the truncation cuts keeps its first words."""
    # All columns travel in one, so that none can clash.
    doc = F.struct(*[F.col(c) for c in docs.columns]).alias("__doc")
    offered = _offered(docs, F.col(id_col), F.col(text_col), F.col(source_col), doc)
    text = F.col("__doc")[text_col]
    queued = queue(offered, weights, share, epochs, order=(text,)).where("taken > 0")
    cut = F.when(F.col("taken") < F.col("__size"), first_words(text, F.col("taken"))).otherwise(text)
    queued = queued.withColumn("__cut", cut).orderBy("virtual_finish", "__source", "__hash")
    return queued.select(*[F.col("__cut").alias(c) if c == text_col else F.col("__doc")[c].alias(c) for c in docs.columns])


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, and place, the words of the mix before its first ones (null if none is taken)."""
    offered = written(_offered(docs, F.col(id_col), F.col(text_col), F.col(source_col), F.col(id_col).alias("id")), "mix-offered")
    order = [F.col("virtual_finish").asc_nulls_last(), "__source", "__hash", "epoch", "__nth"]
    rows = queue(offered, weights, share, epochs).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.withColumn("range", F.spark_partition_id()), "mix-sorted")
    in_turn = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("range").agg(F.sum("taken").alias("in_range")).select("range", F.coalesce(F.sum("in_range").over(in_turn), F.lit(0)).alias("before"))
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(ranges, "range").withColumn("place", F.when(F.col("taken") > 0, F.col("before") + F.sum("taken").over(within) - F.col("taken")))
    told = (
        placed.groupBy(*_KEYS, "__nth", "id").agg(F.first("__size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken"), F.min("place").alias("place"))
        .select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "place")
    )
    return finished(told, "mix-result", offered, rows)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('17:' || coalesce(doc_id::varchar, 'null')) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size
  FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::double, 2.0::double, 1.0::double][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::int] AS w, 2 * source_size AS cap FROM s),
l AS (
  SELECT *, (1.5::double * (sum(source_size) OVER ())::double
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::double)
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (SELECT source, source_size, least(cap::double, max(level) OVER () * w) AS target FROM l),
o AS (
  SELECT d.doc_id, d.source, d.h, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT doc_id, source, h, size, source_size, target, epoch, start, (start + (epoch - 1) * source_size + size) / target AS finish,
         greatest(0, least(size, floor(target)::bigint - start - (epoch - 1) * source_size))::bigint AS taken
  FROM o, (SELECT unnest([1, 2])::bigint AS epoch)),
p AS (SELECT *, sum(taken) OVER (ORDER BY CASE WHEN target > 0 THEN finish END NULLS LAST, source NULLS LAST, h, epoch, start ROWS UNBOUNDED PRECEDING) - taken AS place FROM e)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target, sum(taken)::bigint AS taken, min(place) FILTER (taken > 0)::bigint AS place
FROM p GROUP BY doc_id, source, h, start
"""
