"""Line dedup that can be taken back: cuckoo filters over exact reference counts.

A line's key is its bytes, stripped and in ASCII lower case, as a 128-bit digest.
The exact table counts in how many documents each key occurs; inserting documents
adds to it, deleting them subtracts, and keys no longer used disappear.  Keys are
dealt to shards, each with a cuckoo filter of the keys that have reached the
threshold: a key that crosses it upwards is inserted, one that falls below it is
deleted.

Documents are probed where the filters are: blocks of documents send each shard the
distinct keys that they have there, the shard's filter turns most of them away, the
shard's own part of the exact table confirms the others, and a block gets back those that are common.
A shard that very many documents refer to answers from several copies, each with its share of the blocks;
only the list of such shards, of bounded length, is broadcast.  Counts and keys are added up per task or block before any shuffle, so a line
found in a third of all documents is one key for each of those.

Defined results: a null text counts as empty and an empty text is one empty line;
a line's length counts code points and keys shorter than ``min_chars`` are never
dropped; repeated rows count as documents of their own; an empty table gives no
rows; null ids pass through; a very long text is split
and kept whole in one task; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import finished, remove_table, slices, tidy, written

MIN_DOCS, MIN_CHARS = 10, 1
KEYS_PER_SHARD = 16_000
#: Bytes of text in a block of documents, about.
BLOCK_BYTES = 2 << 20
#: Keys that a task counts at once.
HELD = 100_000
#: References to a shard's keys that one copy of it answers, and how many shards may have copies.
ASKS, MOST_COPIED = 64_000, 100_000
BLANK = b" \t\n\x0b\x0c\r"
SLOTS = 4


class CuckooFilter:
    """16-bit fingerprints of 16-byte digests in buckets of four slots; 0 is a free slot."""

    def __init__(self, keys: int = 0, blob: bytes | None = None):
        if blob is None:
            size = 1
            while size * SLOTS * 0.85 < keys:
                size *= 2
            self.table, self.n = np.zeros((size, SLOTS), np.uint16), 0
        else:
            self.n = struct.unpack_from("<q", blob)[0]
            self.table = np.frombuffer(blob, np.uint16, offset=8).reshape(-1, SLOTS).copy()

    def to_bytes(self) -> bytes:
        return struct.pack("<q", self.n) + self.table.tobytes()

    def _places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of digests given as an (n, 2) array of uint64."""
        print_ = (digests[:, 0] & np.uint64(0xFFFF)).astype(np.uint16)
        print_[print_ == 0] = 1
        mask = np.uint64(len(self.table) - 1)
        first = digests[:, 1] & mask
        return print_, first, first ^ (self._spread(print_) & mask)

    @staticmethod
    def _spread(print_: np.ndarray) -> np.ndarray:
        mixed = print_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mixed >> np.uint64(32)

    def contains(self, digests: np.ndarray) -> np.ndarray:
        print_, a, b = self._places(digests)
        return (self.table[a] == print_[:, None]).any(1) | (self.table[b] == print_[:, None]).any(1)

    def insert(self, digests: np.ndarray) -> bool:
        """False if there was no room for one; the filter must then be built anew, larger."""
        table, mask = self.table, np.uint64(len(self.table) - 1)
        for p, a, b in zip(*self._places(digests), strict=True):
            at = a
            for bucket in (a, b):
                free = np.flatnonzero(table[bucket] == 0)
                if len(free):
                    table[bucket, free[0]] = p
                    break
            else:
                for turn in range(500):
                    slot = (int(at) + turn) % SLOTS
                    p, table[at, slot] = table[at, slot], p
                    at = at ^ (self._spread(np.array([p]))[0] & mask)
                    free = np.flatnonzero(table[at] == 0)
                    if len(free):
                        table[at, free[0]] = p
                        break
                else:
                    return False
            self.n += 1
        return True

    def delete(self, digests: np.ndarray) -> None:
        for p, a, b in zip(*self._places(digests), strict=True):
            for bucket in (a, b):
                held = np.flatnonzero(self.table[bucket] == p)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    self.n -= 1
                    break


def as_pairs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def line_keys(text: str | None, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text and their keys; None for a key that is too short."""
    lines = (text or "").encode().split(b"\n")
    keys: list[bytes | None] = []
    for line in lines:
        key = line.strip(BLANK).lower()
        long_enough = len(key) >= 4 * min_chars or len(key.decode()) >= min_chars
        keys.append(hashlib.md5(key, usedforsecurity=False).digest() if key and long_enough else None)
    return lines, keys


def _counted(min_chars: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, int] = {}
        for batch in slices(batches):
            for text in batch["text"]:
                for key in set(line_keys(text, min_chars)[1]) - {None}:
                    held[key] = held.get(key, 0) + 1
                if len(held) >= HELD:
                    yield pd.DataFrame({"digest": list(held), "n": list(held.values())})
                    held = {}
        yield pd.DataFrame({"digest": list(held), "n": list(held.values())})

    return count


class LineIndex:
    """Reference counts and filters of the lines of all documents inserted and not deleted."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keys_per_shard: int = KEYS_PER_SHARD):
        self.spark, self.min_docs, self.min_chars, self.keys_per_shard = spark, min_docs, min_chars, keys_per_shard
        self.counts: DataFrame | None = None
        self.filters: DataFrame | None = None
        self.shards = 0

    def insert(self, docs: DataFrame, text_col: str = "text") -> None:
        self._change(docs, text_col, 1)

    def delete(self, docs: DataFrame, text_col: str = "text") -> None:
        self._change(docs, text_col, -1)

    def close(self) -> None:
        """Deletes the tables."""
        remove_table(self.counts, self.filters)
        self.counts = self.filters = None

    def _change(self, docs: DataFrame, text_col: str, sign: int) -> None:
        texts = docs.select(F.col(text_col).cast("string").alias("text"))
        rows = texts.mapInPandas(tidy(_counted(self.min_chars)), "digest binary, n long").select("digest", F.lit(0).cast("long").alias("before"), (F.col("n") * sign).alias("n"))
        if self.counts is not None:
            rows = self.counts.where("n > 0").select("digest", F.col("n").alias("before"), "n").unionByName(rows)
        earlier = self.counts, self.filters
        self.counts = written(rows.groupBy("digest").agg(F.sum("before").alias("before"), F.sum("n").alias("n")).where("before > 0 OR n > 0"), "line-counts")
        n, old = self.counts.count(), self.filters
        if not self.shards or n > 2 * self.shards * self.keys_per_shard:  # from now on more shards, so their filters are built anew
            self.shards, old = max(16, -(-n // self.keys_per_shard)), None
        shard = (F.conv(F.hex(F.substring("digest", 13, 4)), 16, 10).cast("long") % self.shards).cast("int").alias("shard")
        none = F.lit(None).cast("binary")
        rows = self.counts.select(shard, "digest", "before", "n", none.alias("filter"))
        if old is not None:
            rows = rows.unionByName(old.select("shard", none.alias("digest"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("n"), "filter"))
        self.filters = written(rows.groupBy("shard").applyInPandas(_filtered(self.min_docs), "shard int, filter binary, common binary, asks long"), "line-filters")
        remove_table(*earlier)

    def dropped(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, asks: int = ASKS) -> DataFrame:
        """Per document: id, n_lines, n_dropped, kept_sha256 and, if asked for, kept (the text that is left).

        A block asks a shard once, so a shard is asked no more often than there are blocks or references to its keys."""
        kind = docs.schema[id_col].dataType.simpleString()
        named = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
        blocks = written(named.mapInPandas(tidy(_block), "block long, shard int, payload binary"), "line-blocks")
        asked = blocks.mapInPandas(tidy(_ask(self.min_chars, self.shards)), "block long, shard int, payload binary, common binary")
        held = self.filters.select(F.lit(-1).cast("long").alias("block"), "shard", F.col("filter").alias("payload"), "common")
        often = self.filters.select("shard", F.least("asks", F.lit(blocks.count())).alias("asks"))
        most = max(asks, (often.agg(F.sum("asks")).first()[0] or 0) // MOST_COPIED)
        copied = F.broadcast(often.where(F.col("asks") > most).select("shard", F.ceil(F.col("asks") / most).cast("int").alias("copies")))
        copies = F.coalesce("copies", F.lit(1))
        dealt = asked.join(copied, "shard", "left").withColumn("copy", F.pmod(F.xxhash64("block"), copies).cast("int"))
        repeated = held.join(copied, "shard", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
        answers = dealt.unionByName(repeated).drop("copies").groupBy("shard", "copy").applyInPandas(_answer, "block long, shard int, payload binary")
        out = "id string, n_lines long, n_dropped long, kept_sha256 string" + ", kept string" * with_text
        rows = blocks.unionByName(answers).groupBy("block").applyInPandas(_drop(self.min_chars, with_text), out)
        return finished(rows.withColumn("id", F.col("id").cast(kind)), "line-result", blocks).withColumnRenamed("id", id_col)


def _filtered(min_docs: int):
    """Brings a shard's filter up to date and lists the keys that are common by the exact counts."""

    def change(rows: pd.DataFrame) -> pd.DataFrame:
        shard, blobs, rows = int(rows["shard"].iloc[0]), rows["filter"].dropna(), rows[rows["digest"].notna()]
        digests = as_pairs(rows["digest"].tolist())
        before, now = rows["before"].to_numpy() >= min_docs, rows["n"].to_numpy() >= min_docs
        keys = CuckooFilter(blob=blobs.iloc[0]) if len(blobs) else CuckooFilter(int(now.sum()))
        if len(blobs):
            keys.delete(digests[before & ~now])
        more = digests[now & ~before] if len(blobs) else digests[now]
        while not keys.insert(more):
            keys, more = CuckooFilter(len(keys.table) * SLOTS), digests[now]
        return pd.DataFrame({"shard": [shard], "filter": [keys.to_bytes()], "common": [digests[now].tobytes()], "asks": [int(rows["n"].sum())]})

    return change


def _block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents as blocks: ids and texts; a block's number depends on its task's input alone."""
    base, number, size = TaskContext.get().partitionId() << 24, 0, 0
    ids: list[str | None] = []
    texts: list[str | None] = []

    def block() -> pd.DataFrame:
        return pd.DataFrame({"block": [base + number], "shard": [-1], "payload": [pickle.dumps((ids, texts))]})

    for batch in slices(batches):
        for id_, text in zip(batch["id"], batch["text"], strict=True):
            ids.append(id_)
            texts.append(text)
            size += len(text or "")
            if size >= BLOCK_BYTES:
                yield block()
                ids, texts, size, number = [], [], 0, number + 1
    if ids:
        yield block()


def _ask(min_chars: int, shards: int):
    """Of each block, a row per shard with the distinct keys that it has there."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, payload in zip(batch["block"], batch["payload"], strict=True):
                keys = list({k for t in pickle.loads(payload)[1] for k in line_keys(t, min_chars)[1]} - {None})
                if not keys:
                    continue
                digests = as_pairs(keys)
                shard = _shard_of(digests, shards)
                order = np.argsort(shard, kind="stable")
                parts = np.split(order, np.flatnonzero(np.diff(shard[order])) + 1)
                yield pd.DataFrame({"block": block, "shard": [int(shard[p[0]]) for p in parts], "payload": [digests[p].tobytes() for p in parts], "common": None})

    return ask


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a shard: the keys asked about that its filter claims and its exact counts confirm."""
    held, asked = rows[rows["block"] < 0], rows[rows["block"] >= 0]
    if not len(held) or not len(asked):
        return pd.DataFrame({"block": [], "shard": [], "payload": []})
    keys, common = CuckooFilter(blob=held["payload"].iloc[0]), held["common"].iloc[0]
    exact = {common[i : i + 16] for i in range(0, len(common), 16)}
    found = []
    for payload in asked["payload"]:
        digests = np.frombuffer(payload, np.uint64).reshape(-1, 2)
        claimed = digests[keys.contains(digests)].tobytes() if keys.n else b""
        found.append(b"".join(k for k in (claimed[i : i + 16] for i in range(0, len(claimed), 16)) if k in exact))
    out = pd.DataFrame({"block": asked["block"].to_numpy(), "shard": asked["shard"].to_numpy(), "payload": found})
    return out[out["payload"].str.len() > 0]


def _drop(min_chars: int, with_text: bool):
    """Drops a block's common lines."""

    def drop(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows["shard"] < 0
        ids, texts = pickle.loads(rows["payload"][own].iloc[0])
        found = b"".join(rows["payload"][~own])
        common = {found[i : i + 16] for i in range(0, len(found), 16)}
        out = []
        for id_, text in zip(ids, texts, strict=True):
            lines, keys = line_keys(text, min_chars)
            left = b"\n".join([line for line, k in zip(lines, keys, strict=True) if k not in common])
            out.append((id_, len(lines), sum(k in common for k in keys), hashlib.sha256(left).hexdigest(), *([left.decode()] if with_text else [])))
        return pd.DataFrame(out, columns=["id", "n_lines", "n_dropped", "kept_sha256", *(["kept"] if with_text else [])])

    return drop


def _shard_of(digests: np.ndarray, shards: int) -> np.ndarray:
    """By the last four bytes, which the filters' buckets don't use."""
    return ((digests[:, 1] >> np.uint64(32)).astype(np.uint32).byteswap() % np.uint32(shards)).astype(np.int64)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, with_text: bool = True) -> DataFrame:
    index = LineIndex(docs.sparkSession, min_docs, min_chars)
    index.insert(docs, text_col)
    rows = index.dropped(docs, id_col, text_col, with_text=with_text)
    index.close()
    return rows


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


SQL = r"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line,
         translate(regexp_replace(regexp_replace(lines[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)),
k AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (FROM k)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (key NOT IN (FROM k)), '')) AS kept_sha256
FROM l GROUP BY doc_id
"""
