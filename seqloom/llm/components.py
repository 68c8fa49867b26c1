"""Connected components of links between identifiers, without collecting them.

Each round hooks every component to its smallest neighbour and then follows the
hooks by pointer jumping; components at least halve in number per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import remove_table, written


def merge_components(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (did, comp) after merging along ``links`` (a, b) between dids; comp is the smallest comp merged.
    If it is a written table, it is deleted once it is replaced."""
    while True:
        of_a = comps.select(F.col("did").alias("a"), F.col("comp").alias("ca"))
        of_b = comps.select(F.col("did").alias("b"), F.col("comp").alias("cb"))
        edges = links.join(of_a, "a").join(of_b, "b").where("ca <> cb").select(F.greatest("ca", "cb").alias("child"), F.least("ca", "cb").alias("parent"))
        hooks = written(edges.groupBy("child").agg(F.min("parent").alias("parent")), "comp-hooks")
        if hooks.isEmpty():
            remove_table(hooks)
            return comps
        while True:
            up = hooks.select(F.col("child").alias("parent"), F.col("parent").alias("further"))
            jumped = written(hooks.join(up, "parent", "left").select("child", F.coalesce("further", "parent").alias("parent"), F.col("further").isNotNull().alias("moved")), "comp-hooks")
            moved = not jumped.where("moved").isEmpty()
            remove_table(hooks)
            hooks = jumped
            if not moved:
                break
        merged = written(comps.join(hooks.select(F.col("child").alias("comp"), F.col("parent").alias("root")), "comp", "left").select("did", F.coalesce("root", "comp").alias("comp")), "comps")
        remove_table(comps, hooks)
        comps = merged
