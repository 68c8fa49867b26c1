"""Helpers shared by the corpus operators: shared storage and row identity."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.sources.shared import finished, fresh_path, remove, remove_all, remove_table, shared_dir, written

__all__ = ["finished", "fresh_path", "remove", "remove_all", "remove_table", "shared_dir", "written"]

#: White space of the contracts: blank and the five ASCII controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


@contextmanager
def few_records(spark: SparkSession, n: int = 4) -> Iterator[None]:
    """For jobs started within: at most n rows at once between JVM and Python, where a row is large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


_caches: list[Callable[[], None]] = []


def cache_cleared_by(clear: Callable[[], None]) -> None:
    """Has ``clear`` called in a Python worker whenever a task's iterator has ended."""
    _caches.append(clear)


def give_back() -> None:
    """Empties a worker's caches and returns its free memory, as the worker outlives the task."""
    for clear in _caches:
        clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function for ``mapInPandas`` that leaves its worker as small as it found it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """Batches cut small, so that what is made of one stays small too."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows].reset_index(drop=True)


def pack(*arrays: bytes) -> bytes:
    """Several byte strings as one."""
    head = np.array([len(arrays), *map(len, arrays)], np.int64).tobytes()
    return head + b"".join(arrays)


def unpack(payload: bytes) -> list[bytes]:
    n = int(np.frombuffer(payload, np.int64, 1)[0])
    sizes = np.frombuffer(payload, np.int64, n, 8)
    ends = 8 * (n + 1) + np.cumsum(sizes)
    return [payload[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def located(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` if its rows were read from files, and so have a file and a place in it; else ``docs`` written."""
    try:
        docs.select("_metadata.file_path").schema  # noqa: B018  analysed here
    except AnalysisException:
        return written(docs, name)
    return docs


def with_locator(docs: DataFrame, name: str, file: str = "file", row: str = "row") -> DataFrame:
    """``docs`` with each row's file and place in it."""
    return located(docs, name).select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, members: str, hot: int = 500, most_hot: int = 100_000) -> DataFrame:
    """Joins each row with its group's one row in ``groups``, a written table whose column ``members`` counts the group's rows.

    Groups of more than ``hot`` rows (more, where there would be over ``most_hot`` of them, so their keys can be
    broadcast) are salted: their rows are dealt out and the group's row is repeated."""
    most = max(hot, (groups.agg(F.sum(members)).first()[0] or 0) // most_hot)
    large = F.broadcast(groups.where(F.col(members) > most).select(key, F.ceil(F.col(members) / most).cast("int").alias("__salts")))
    salts = F.coalesce("__salts", F.lit(1))
    dealt = rows.join(large, key, "left").withColumn("__salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), salts).cast("int")).drop("__salts")
    repeated = groups.join(large, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts", members)
    return dealt.join(repeated, [key, "__salt"]).drop("__salt")


def words(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
