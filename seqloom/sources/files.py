"""Readers and writers: sequences, names, intervals, query lists, k-mer tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.sources.shared import remove_table, written

BED6 = "chrom string, start0 long, end1 long, name string, copies long, strand string"
BED12 = BED6 + ", thick_start long, thick_end long, rgb string, block_count long, block_sizes string, block_starts string"
ONE_COPY = (
    "chrom string, chromStart long, chromEnd long, name string, score long, strand string, thickStart long, thickEnd long, reserved string, "
    "n0mismatches long, n1mismatches long, n2mismatches long, n3mismatches long, totalOffSites long, offSiteCounts string, spacerSeq string, percentGC double, longestTandemT long"
)
TWO_PLUS = (
    "chrom string, chromStart long, chromEnd long, name string, score long, strand string, thickStart long, thickEnd long, reserved string, "
    "blockCount long, blockSizes string, chromStarts string, clusterSize long, n0mismatches long, n1mismatches long, n2mismatches long, n3mismatches long, "
    "totalOffSites long, offSiteCounts string, spacerSeq string, percentGC double, longestTandemT long"
)
#: White space, and the first word of a FASTA header.
BLANK, NAME = re.compile("[ \\t\\n\\v\\f\\r]"), re.compile("^>[ \\t\\n\\v\\f\\r]*([^ \\t\\n\\v\\f\\r]+)")
#: Bases that wait, besides those of a chunk, to be given out together.
HELD = 1 << 16
SPLITS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("heads", pa.int64()), ("tail", pa.int64()), ("name", pa.string())])
PIECES = pa.schema([("file", pa.string()), ("record", pa.int64()), ("chrom", pa.string()), ("chunk", pa.int64()), ("at", pa.int64()), ("piece", pa.string()), ("whole", pa.bool_())])
HITS = "pattern string, chrom string, location long, seq string, strand string, mismatches long"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, seq): the first word of each header, and its sequence without white space; records without either are skipped."""
    record = spark.read.option("lineSep", ">").text(path).select(F.split("value", "\r?\n", 2).alias("r"))
    chrom, seq = F.regexp_extract(F.col("r")[0], r"^\s*(\S+)", 1), F.regexp_replace(F.get("r", F.lit(1)), r"\s", "")
    return record.where(F.size("r") == 2).select(chrom.alias("chrom"), seq.alias("seq")).where("chrom <> '' AND seq <> ''")


def _split_runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, list[str]]]:
    """((file, block), first row, lines) of the lines of a batch (value, file, block, ...), in order."""
    if not batch.num_rows:
        return
    file, block = batch.column(1), batch.column(2).to_numpy()
    other = (block[1:] != block[:-1]) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
    starts = [0, *(np.flatnonzero(other) + 1).tolist()]
    for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield (file[start].as_py(), int(block[start])), start, batch.column(0).slice(start, end - start).to_pylist()


def _bases(line: str) -> str:
    return line if line.isalpha() else BLANK.sub("", line)


def _name(line: str) -> str:
    """The first word of a header."""
    return found[1] if (found := NAME.match(line)) else ""


def _split_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split: how many headers it has, the name in its last one, and the bases behind that (all, if it has none)."""
    key, heads, tail, last = None, 0, 0, None

    def row():
        return pa.RecordBatch.from_pylist([{"file": key[0], "block": key[1], "heads": heads, "tail": tail, "name": last and _name(last)}], SPLITS)

    for batch in batches:
        for k, _, lines in _split_runs(batch):
            if k != key:
                if key:
                    yield row()
                key, heads, tail, last = k, 0, 0, None
            for line in lines:
                if line.startswith(">"):
                    heads, tail, last = heads + 1, 0, line
                else:
                    tail += len(_bases(line))
    if key:
        yield row()


class _Record:
    """What one split has of a record, from its base ``at`` on, given out in chunks as its lines come."""

    def __init__(self, size: int, n: int, key: tuple, at: int):
        self.size, self.reach, self.key = size, size + n - 1, key
        self.start = self.left = self.end = at
        self.chunk, self.lines = max(0, (at - n + 1) // size), []

    def add(self, line: str) -> bool:
        """Takes a line; whether there may be a chunk to give out."""
        self.lines.append(line)
        self.end += len(line)
        return self.end - self.left >= self.reach + HELD

    def pieces(self, last: bool = False, over: bool = False) -> Iterator[tuple]:
        """(*key, chunk, at, piece, whole) of the chunks that are full, and of the others too if these lines are the split's last ones of the record; ``over``: the record ends here."""
        text, at = "".join(self.lines), self.chunk * self.size
        while self.end > self.start and (at + self.reach <= self.end or last and at < self.end):
            lo = max(at, self.left)
            yield (*self.key, self.chunk, lo, text[lo - self.left : at + self.reach - self.left], at >= self.start and (over or at + self.reach <= self.end))
            self.chunk, at = self.chunk + 1, at + self.size
        lo = min(max(at, self.left), self.end)
        self.lines, self.left = [text[lo - self.left :]], lo


def read_fasta_chunks(spark: SparkSession, path: str, n: int = 1, size: int = 1 << 16) -> DataFrame:
    """(chrom, offset, seq): records in chunks of ``size`` bases, each with the first n - 1 of the next, so that every window of n bases lies in one.

    For records of any length: no line waits for the rest of its record, and no lines are shuffled or sorted.  A split of a file is read in order, twice: first for
    its headers and the bases behind the last one, from which follows, by a row for each split, which record the next one goes on with and at which base; then it is cut.  Chunks
    that lie in one split are written as they are; only the pieces of the others, a few for each split, are put together by a grouping."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    splits = lines.mapInArrow(_split_ends, "file string, block long, heads long, tail long, name string")
    turn = Window.partitionBy("file").orderBy("block")
    splits = splits.withColumn("group", F.sum(F.when(F.col("heads") > 0, 1).otherwise(0)).over(turn.rowsBetween(Window.unboundedPreceding, 0)))
    so_far = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    splits = splits.withColumns({"to": F.sum("tail").over(so_far), "named": F.first("name").over(so_far)})
    earlier = F.coalesce(F.sum("heads").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "block", earlier.alias("record"), F.coalesce(F.lag("to").over(turn), F.lit(0)).alias("at"), F.lag("named").over(turn).alias("chrom"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, record = None, None
        for batch in batches:
            out = []
            for k, row, lines in _split_runs(batch):
                if k != key:
                    out += record.pieces(True) if record else []
                    key, (number, at, chrom) = k, (batch.column(c)[row].as_py() for c in (3, 4, 5))
                    if number is None:
                        raise ValueError(f"{k[0]} is not split as before")
                    record = _Record(size, n, (k[0], number, chrom), at) if chrom else None
                for line in lines:
                    if line.startswith(">"):
                        out += record.pieces(True, True) if record else []
                        number, chrom = number + 1, _name(line)
                        record = _Record(size, n, (k[0], number, chrom), 0) if chrom else None
                    elif record and record.add(_bases(line)):
                        out += record.pieces()
            yield _pieces_batch(out)
        yield _pieces_batch(list(record.pieces(True)) if record else [])

    found = lines.join(F.broadcast(splits), ["file", "block"], "left").select("value", "file", "block", "record", "at", "chrom")
    found = written(found.mapInArrow(cut, "file string, record long, chrom string, chunk long, at long, piece string, whole boolean"), "fasta-pieces")
    whole = found.where("whole").select("chrom", (F.col("chunk") * size).alias("offset"), F.col("piece").alias("seq"))
    chunks = found.where("NOT whole").groupBy("file", "record", "chrom", "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"))
    return whole.unionByName(chunks.select("chrom", (F.col("chunk") * size).alias("offset"), F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("seq")))


def _pieces_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(PIECES), PIECES, strict=True)], schema=PIECES)


def write_fasta(genome: DataFrame, path: str, width: int = 60) -> None:
    """(chrom, seq) as records with lines of so many bases."""
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    genome.select(F.concat(F.lit(">"), "chrom", F.lit("\n"), wrapped).alias("value")).write.mode("overwrite").text(path)


def write_names(genome: DataFrame, path: str) -> None:
    """``id<tab>name`` of the records, numbered from 0 by name: within ranges of names, and from where the ranges before end."""
    place = F.monotonically_increasing_id()
    names = genome.select("chrom").distinct().repartitionByRange("chrom").sortWithinPartitions("chrom")
    names = written(names.select("chrom", F.spark_partition_id().alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")), "names")
    ahead = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row for each range
    starts = names.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(ahead, F.lit(0)).alias("start"))
    rows = names.join(F.broadcast(starts), "part").select((F.col("start") + F.col("nth")).alias("chrom_id"), "chrom")
    rows.write.mode("overwrite").option("sep", "\t").csv(path)
    remove_table(names)


def with_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows with a column chrom_id and their chromosome's name."""
    return rows.join(names.select("chrom_id", "chrom"), "chrom_id")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(chrom_id, chrom) of a two-column file separated by white space."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].cast("int").alias("chrom_id"), parts[1].alias("chrom"))


def name_and_offset(chrom) -> tuple:
    """``name|x:offset`` as (name, offset or -1)."""
    return F.split(chrom, r"\|")[0], F.coalesce(F.regexp_extract(chrom, r"\|[^:]*:(\d+)", 1).try_cast("long"), F.lit(-1).cast("long"))


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated table; lines that start with # are comments."""
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").csv(path)


def element(line, selector: str):
    """A selector ``col`` or ``col,separators,element`` (1-based) of a tab-separated line; without one, the line itself."""
    if not selector:
        return line
    col, *rest = selector.split(",", 1)
    value = F.get(F.split(line, "\t"), F.lit(int(col) - 1))
    if rest:
        separators, _, nth = rest[0].rpartition(",")
        value = F.get(F.split(value, "[" + re.escape(separators) + "]"), F.lit(int(nth) - 1))
    return value


def read_queries(spark: SparkSession, path: str, selector: str = "") -> DataFrame:
    """(line, kmer) of a list of queries; blank lines are skipped, other letters than bases give a null k-mer."""
    kmer = F.upper(element(F.col("value"), selector))
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("line"), F.when(kmer.rlike("^[ACGT]+$"), kmer).alias("kmer"))


def shards(path: str) -> tuple[str, list[str]]:
    """``name.[AA,AC].suffix`` as the pattern's ends and its list of prefixes; a table partitioned by prefix is read with it."""
    found = re.fullmatch(r"(.*)\[([^\]]*)\](.*)", path)
    return (found[1] + "*" + found[3], found[2].split(",")) if found else (path, [])


def read_kmers(spark: SparkSession, path: str, prefixes: list[str] | None = None) -> DataFrame:
    """A k-mer or site table written by :func:`write_kmers`; only the folders of ``prefixes`` are read.

    A path ``table.[AA,AC]`` names the prefixes itself."""
    path, named = shards(path)
    path, prefixes = (path.removesuffix("*").removesuffix("."), prefixes or named) if named else (path, prefixes)
    table = spark.read.parquet(path)
    return table.where(F.col("prefix").isin(prefixes)) if prefixes else table


def write_kmers(kmers: DataFrame, path: str, prefix_length: int = 2) -> None:
    kmers.withColumn("prefix", F.substring("kmer", 1, prefix_length)).repartition("prefix", F.pmod(F.xxhash64("kmer"), F.lit(16))).write.partitionBy("prefix").mode("overwrite").parquet(path)


def write_bed(rows: DataFrame, path: str, header: bool = False) -> None:
    """Tab-separated text sorted by place; arrays are joined by commas."""
    flat = rows.select(*[F.array_join(c, ",").alias(c) if kind.startswith("array") else F.col(c) for c, kind in rows.dtypes])
    flat.orderBy(*flat.columns[:2]).write.mode("overwrite").option("sep", "\t").option("header", header).csv(path)


def write_profiles(profiled: DataFrame, path: str) -> None:
    """Each query's line and, behind a tab, its counts by distance."""
    profiled.select(F.concat_ws("\t", "line", "off_site_counts").alias("value")).write.mode("overwrite").text(path)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """What an external search found."""
    return read_table(spark, path, HITS)


def header_line(rows: DataFrame) -> str:
    return "#" + "\t".join(rows.columns)


def columns_of(rows: DataFrame) -> DataFrame:
    """(n, column) of a table, numbered from 1."""
    return rows.sparkSession.createDataFrame(list(enumerate(rows.columns, 1)), "n int, column string")
