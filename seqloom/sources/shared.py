"""Tables that are written once and read several times, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made and not yet deleted, with the session that made them.
_left: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.  Only where that is unset and the session runs on one machine a
    fresh temporary folder is made and remembered; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="seqloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _left[path] = spark
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: lineage ends here,
    and a lost executor costs no recomputation of what came before."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage through Spark's own file system layer, where the session has one."""
    _left.pop(path, None)
    if hasattr(spark, "_jvm"):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def remove_table(*tables: DataFrame | None) -> None:
    """Delete the folders behind tables made by :func:`written` when their last reader is done."""
    for table in tables:
        if table is not None and getattr(table, "written_to", None) in _left:
            remove(table.sparkSession, table.written_to)


def finished(result: DataFrame, name: str, *tables: DataFrame | None) -> DataFrame:
    """The result, written, and the tables that it was made of deleted."""
    out = written(result, name)
    remove_table(*tables)
    return out


def remove_all(spark: SparkSession | None = None) -> None:
    """Delete every folder still there.  Results that are not read yet lose their tables: a long session calls this
    between queries, any other is cleaned at its end."""
    for path in list(_left):
        try:
            remove(spark or _left[path], path)
        except Exception:  # noqa: BLE001  the session may be gone
            _left.pop(path, None)


atexit.register(remove_all)
