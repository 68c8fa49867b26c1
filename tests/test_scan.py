"""Sequences scanned as arrays against plain loops over their letters."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators import filters, kmers, scan, sitedb, sites
from seqloom.plans import queries
from seqloom.sources import shared

NGG = "X" * 20 + "NGG"


def letters(n: int, seed: int, more: str = "NnacgtU-é") -> str:
    draw = random.Random(seed)
    return "".join(draw.choice("ACGT" if draw.random() < 0.95 else more) for _ in range(n))


def test_pieces_meet_without_gap_or_overlap(monkeypatch):
    records = ["", letters(300, 1), "GG", letters(90, 2), None, letters(22, 3), letters(23, 4), "G" * 80]
    column = pa.array(records)

    def found(size: int) -> list:
        monkeypatch.setattr(scan, "PIECE", size)
        return sorted((strand, int(r), int(i), int(c)) for strand, digits, at, record, place in scan._matches(column, "XXXXXNRG", True, False) for r, i, c in zip(record, place, scan._codes(digits, at, 5, strand == "-"), strict=True))

    whole = found(1 << 20)
    assert len(whole) == len(set(whole)) > 20 and all(found(size) == whole for size in (1, 7, 64, 301))


def test_sites_are_counted_where_they_are_scanned(spark):
    table = spark.createDataFrame([(f"c{i}", letters(n, i)) for i, n in enumerate((0, 22, 23, 400, 3000))], "chrom string, seq string")
    counted = sites.site_counts(table, NGG)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, kmers.coded_counts(sites.coded_sites(table, NGG)).collect())) and counted.count() > 50
    for rows in (counted, sites.sites(table, NGG), kmers.strand_counts(table, 20).select("code", "n")):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode" not in plan and "regexp_extract_all" not in plan  # no row and no text for each window
    with pytest.raises(ValueError):
        sites.site_counts(table, "XXJ")


def test_masked_windows_are_counted_as_longs(spark):
    rows = [letters(n, n, "acgtNnU-") for n in (0, 4, 5, 6, 700)] * 2
    want = Counter(t[i : i + 5] for t in rows for i in range(len(t) - 4) if not set(t[i : i + 5]) - set("ACGTacgt"))
    fits = lambda w: w.upper().count("T") <= 1 and 0.4 <= (w.upper().count("G") + w.upper().count("C")) / 5 <= 0.6
    table = spark.createDataFrame([(t,) for t in [*rows, None]], "seq string")
    found = scan.masked_counts(table, 5, lambda codes: filters.guide_codes(codes, 5, max_t=1))
    assert dict(found.dtypes) == {"code": "bigint", "low": "bigint", "n": "bigint"}
    assert {r[0]: r[1] for r in scan.spelled_masked(found, 5).collect()} == {w: n for w, n in want.items() if fits(w)}


def test_recoded_text(spark):
    table = spark.createDataFrame([("a", "xé-Yx"), ("b", None), ("c", ""), ("d", "zz")], "chrom string, text string")
    assert sorted(map(tuple, scan.recoded(table, "xY", "AC", "text").collect()), key=str) == [("a", "ACA"), ("b", None), ("c", ""), ("d", "")]


def test_batches_are_more_than_a_file(spark, monkeypatch):
    """Three batches, of as many files as the input has parts: no batch is one task's work."""
    rows = spark.createDataFrame([(f"c{i}", letters(60, i)) for i in range(40)], "chrom string, seq string").repartition(8)
    monkeypatch.setattr(queries.V, "genome", lambda *_: rows)
    merged = []
    merge = queries.CountTable.merge
    monkeypatch.setattr(queries.CountTable, "merge", lambda self, genome, batch: (merged.append(batch), merge(self, genome, batch))[1])
    found = queries.kmer_counts_in_batches(spark, "")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, kmers.strand_counts(rows, 8).select("kmer", "n").collect()))
    path = next(p for p, s in shared._left.items() if "/arrivals-" in p and s is spark)
    assert merged == [0, 1, 2, 2] and len(spark.read.parquet(f"{path}/in").inputFiles()) > 3
    shared.remove_all(spark)


def test_bounds_on_bases_are_known_of_codes(spark):
    words = ["A" * 20, "G" * 20, "ACGT" * 5, "GC" * 4 + "AT" * 6, "GC" * 6 + "AT" * 4, "G" * 13 + "T" * 7]
    rows = spark.createDataFrame([(w,) for w in words], "kmer string").withColumn("code", S.kmer_code(F.col("kmer")))
    query = sitedb.parse(["$percentGC\t40\t60", "$n1mismatches\t-10000\t2"])
    kept = [r[0] for r in rows.where(sitedb.code_bounds(query, F.col("code"), 20)).collect()]
    assert kept == [r[0] for r in rows.where(S.percent_gc(F.col("kmer")).between(40, 60)).collect()] == words[2:5]
