"""Chat formatting with cumulative-snapshot collapse.

Chat logs often hold a conversation many times, once after each turn.  Each turn
gets a rolling hash of all turns up to it: the running sum of four 32-bit lanes
of SHA-256 over position, role and text, which a window computes in one pass.
A conversation is a snapshot if its last hash is found among the hashes at
which a longer conversation has not ended yet; an anti-join drops it.  Of
equal conversations the smallest identifier stays.  What remains is rendered.

Both sides of the anti-join are reduced to distinct hashes first (with partial
aggregation), so a first turn or a whole conversation that a third of all logs
share is one row on each side.  A rendered conversation is one value, so the
turns of one conversation meet in one task; nothing else is collected.

Defined results: turns are ordered by turn (null first), role, text; a null role
or text counts as empty; rows with a null conversation id are one conversation
of their own; repeated rows are turns of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LANES = [f"h{k}" for k in range(4)]


def turn_hashes(turns: DataFrame) -> DataFrame:
    """Adds position, number of turns and the rolling hash of the turns up to each one."""
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    digest = F.sha2(F.concat_ws(":", F.col("pos").cast("string"), F.length("role").cast("string"), "role", "text"), 256)
    rows = turns.withColumn("pos", F.row_number().over(order)).withColumn("digest", digest)
    lane = lambda k: F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("long")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.sum(lane(k)).over(so_far).alias(LANES[k]) for k in range(4)])
    return rows.withColumn("n_turns", F.count(F.lit(1)).over(Window.partitionBy("conv"))).drop("digest")


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def format_chats(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation that no other one continues: id, n_turns, rendered."""
    turns = conversations.select(
        F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    hashed = turn_hashes(turns)
    ended = (
        hashed.where("pos = n_turns").groupBy("pos", *LANES)
        .agg(F.min(F.struct(F.col("conv").isNull().alias("no_id"), "conv")).alias("first"))
    )
    continued = hashed.where("pos < n_turns").select("pos", *LANES).distinct()
    maximal = ended.join(continued, ["pos", *LANES], "left_anti").select(F.col("first.conv").alias("conv"), F.col("pos").cast("long").alias("n_turns"))
    kept = turns.alias("t").join(maximal.alias("m"), F.col("t.conv").eqNullSafe(F.col("m.conv"))).select("t.*", "n_turns")
    return (
        kept.groupBy("conv", "n_turns")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text"))).alias("all"))
        .select(F.col("conv").alias(id_col), "n_turns", F.array_join(F.transform("all", lambda t: rendered_turn(t["role"], t["text"])), "").alias("rendered"))
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
         list(role || chr(31) || text ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, rendered FROM c
WHERE NOT EXISTS (
  SELECT 1 FROM c AS d WHERE d.turns[1] = c.turns[1] AND d.turns[1:c.n_turns] = c.turns AND (d.n_turns > c.n_turns OR d.n_turns = c.n_turns AND d.conv_id < c.conv_id))
"""
