import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators import groups as G
from seqloom.operators import kmers, neighbors, sitedb, sites

NGG = "X" * 20 + "NGG"


@pytest.fixture(scope="module")
def genome(spark):
    rng = random.Random(3)
    seqs = ["".join(rng.choices("ACGTNacgt", [20, 20, 30, 20, 1, 1, 1, 1, 1], k=n)) for n in (0, 5, 22, 23, 200, 1500)]
    return spark.createDataFrame([(f"c{i}", s) for i, s in enumerate([*seqs, seqs[-1][::-1], "G" * 60])], "chrom string, seq string")


@pytest.mark.parametrize("k, m", [(10, 0), (10, 1), (11, 2), (10, 3), (31, 2)])
def test_groups_find_what_joins_find_and_send_no_changed_blocks(spark, monkeypatch, k, m):
    monkeypatch.setattr(G, "GROUP", 60)
    rng = random.Random(k + m)
    base = ["A" * (k // 2) + "".join(rng.choices("ACGT", k=k - k // 2)) for _ in range(60)] + ["".join(rng.choices("ACGT", k=k)) for _ in range(60)]
    near = [b[:i] + rng.choice("ACGT") + b[i + 1 :] for b in base for i in rng.sample(range(k), 2)]
    kmers_ = sorted({*base, *near, *[x[:2] + rng.choice("ACGT") + x[3:] for x in near]})
    codes = [int(x.translate(str.maketrans("ACGT", "0123")), 4) for x in kmers_]
    differ = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    n = [rng.randint(1, 300) for _ in codes]
    held = {c: i for i, c in enumerate(codes)}
    table = spark.createDataFrame(list(zip(codes, n, strict=True)), "code long, n long")
    want = sorted((codes[i], codes[j], n[j], d) for i in range(len(codes)) for j in range(len(codes)) if (d := differ(kmers_[i], kmers_[j])) <= m)
    found = G.pairs(None, table, k, m, len(codes))
    assert sorted(tuple(r) for r in found.collect()) == want
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    sums = {c: [0] * (m + 1) for c in codes}
    for q, _, n_, d in want:
        sums[q][d] += n_
    assert {r[0]: list(r[1:]) for r in G.counts(None, table, k, m, len(codes)).collect()} == sums
    # some of them, and one that the table lacks
    asked = codes[::3] + [next(c for c in range(4**k) if c not in held)]
    q = spark.createDataFrame([(c,) for c in asked], "q long")
    by_join = sorted(tuple(r) for r in neighbors.pairs(q, table, k, m).collect())
    assert sorted(tuple(r) for r in G.pairs(q, table, k, m, len(codes)).collect()) == by_join
    told = {r[0]: list(r[1:]) for r in G.counts(q, table, k, m, len(codes)).collect()}
    assert set(told) == set(asked) and all(told[c] == sums[c] for c in codes[::3])


@pytest.mark.parametrize("k, m, j", [(10, 1, 0), (12, 2, 1), (20, 3, 0), (20, 3, 2), (20, 3, 3)])
def test_finer_pieces_find_the_same_and_compare_less(monkeypatch, k, m, j):
    """Where many codes share a place, pairs that are compared grow with the square of the codes; a group then takes finer pieces."""
    rng = np.random.default_rng(k + m + j)
    codes = np.unique(rng.integers(0, 4, (3000, k)) @ (4 ** np.arange(k)))
    codes &= ~np.int64(G._masks(k, m, 1)[j])  # all in one block
    some = [p for p in range(k) if (int(G._masks(k, m, 1)[j]) >> 2 * p) & 1 == 0]
    codes = np.unique(np.concatenate([codes, *[codes ^ (rng.integers(1, 4, len(codes)) << 2 * np.array(rng.choice(some, len(codes)))) for _ in range(3)]]))
    compared = [0]

    def differ(x, of=G._differ):
        compared[0] += len(x)
        return of(x)

    monkeypatch.setattr(G, "_differ", differ)
    found, work = [], []
    for pieces in (1, 2, 3, 5):
        monkeypatch.setattr(G, "pieces_for", lambda *_, n=pieces: n)
        compared[0] = 0
        at = [(int(a), int(b), int(d)) for part in G.near(codes, np.ones(len(codes), bool), k, m, j) for a, b, d in zip(*part, strict=True)]
        assert len({frozenset(x[:2]) for x in at}) == len(at)
        found.append({(frozenset(x[:2]), x[2]) for x in at})
        work.append(compared[0])
    assert found[0] == found[1] == found[2] == found[3]
    assert j or len(found[0]) > 3000
    assert work[0] > work[1]


def test_crowded_groups_take_finer_pieces():
    rng = np.random.default_rng(0)
    sparse = np.unique(rng.integers(0, 1 << 40, 20_000))
    crowded = np.unique(rng.integers(0, 1 << 30, 1_200_000))  # all in one first block
    assert G.pieces_for(sparse, 20, 3, 0) == 2 and G.pieces_for(crowded, 20, 3, 0) > 2


def test_listing_is_told_in_groups(spark, monkeypatch):
    """No pair is a row between tasks, and texts are not put together letter by letter; queries are told few at a time."""
    monkeypatch.setattr(G, "GROUP", 50)
    rng = random.Random(5)
    codes = [rng.randrange(1 << 40) for _ in range(60)]
    codes = sorted({*codes, *[c ^ (rng.randint(1, 3) << 2 * rng.randrange(20)) ^ (rng.randint(0, 3) << 2 * rng.randrange(20)) for c in codes for _ in range(4)]})
    counts = spark.createDataFrame([(c, rng.randint(1, 300)) for c in codes], "code long, n long").cache()
    want = neighbors.profile(counts.select(S.spelled(F.col("code"), 20).alias("kmer")), counts, 3, k=20, listing=True).select("kmer", "n0", "n3", "found")
    got = neighbors.own_profile(counts, 3, 20, listing=True).select("kmer", "n0", "n3", "found")
    assert sorted(got.collect()) == sorted(want.collect()) and any("/" in r.found for r in want.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "transform" not in plan


def test_codes_are_spelled():
    codes = np.array([0, 5, (1 << 62) - 1])
    for k in (3, 4, 20, 31):
        mine = codes & ((1 << 2 * k) - 1)
        told = ["".join(S.CODE_ORDER[int(c) >> 2 * (k - 1 - i) & 3] for i in range(k)) for c in mine]
        assert G.spelled(mine, k).to_pylist() == told
        assert G.spelled(mine, k, np.array([0, 0, 1])).to_pylist() == [told[0], told[1], told[2][:-1] + told[2][-1].lower()]


def test_packed_numbers_come_back():
    for values in ([0], [255, 0, 256], [1 << 61, 7]):
        assert G.unpacked(G.packed(np.array(values))).tolist() == values


def test_coded_sites_are_sites(genome):
    spelled = sites.sites(genome, NGG).select("chrom", "start0", "strand", S.kmer_code(F.col("kmer")).alias("code"), S.kmer_key(F.col("kmer")).alias("key"))
    coded = sites.coded_sites(genome, NGG)
    rows = coded.select("chrom", "start0", "strand", "code", S.key_of_code(F.col("code"), 20).alias("key"))
    assert sorted(rows.collect()) == sorted(spelled.collect()) and rows.count() > 20
    counts = {r.kmer: r.n for r in kmers.kmer_counts(sites.sites(genome, NGG)).collect()}
    assert {r.kmer: r.n for r in kmers.coded_counts(coded).select(S.spelled(F.col("code"), 20).alias("kmer"), "n").collect()} == counts


def test_own_profile_is_profile(spark, genome):
    counts = kmers.coded_counts(sites.coded_sites(genome, NGG)).cache()
    queries = counts.select(S.spelled(F.col("code"), 20).alias("kmer"))
    for options in ({}, {"bag": False}, {"listing": True}):
        want = neighbors.profile(queries, counts, 3, k=20, **options)
        names = want.columns
        assert sorted(neighbors.own_profile(counts, 3, 20, **options).select(names).collect()) == sorted(want.collect())
    assert sorted(neighbors.profile(queries, counts, 3, k=20, rows=9).collect()) == sorted(neighbors.profile(queries, counts, 3, k=20).collect())


@pytest.mark.parametrize("limit", [1, 1000])
def test_first_absent_is_absent(spark, genome, limit):
    for k in (3, 6, 12):
        want = kmers.absent(spark, kmers.strand_counts(genome, k), k, limit=limit).collect()
        assert sorted(kmers.first_absent(genome, k, limit).collect()) == sorted(want)


def test_many_chromosomes_are_few_folders(spark, tmp_path):
    found = spark.range(500).select(F.concat(F.lit("c"), "id").alias("chrom"), (F.col("id") % 7).alias("start0"), F.lit("+").alias("strand"))
    sites.partitioned_by_chrom(found, str(tmp_path / "by"), parts=8)
    assert len(list((tmp_path / "by").glob("part=*"))) == 8
    back = spark.read.parquet(str(tmp_path / "by"))
    assert sorted(back.select(found.columns).collect()) == sorted(found.collect())
    assert back.groupBy("chrom").agg(F.count_distinct("part").alias("n")).where("n > 1").isEmpty()


def test_rows_that_may_overlap(spark):
    rows = spark.createDataFrame([("a", 0, 20), ("a", 20, 40), ("a", 90, 110), ("b", 5, 25)], "chrom string, s long, e long")
    kept = rows.where(sitedb.may_overlap([("a", 10, 20), ("a", 95, 0)], F.col("s"), F.col("e"))).collect()
    assert sorted(tuple(r) for r in kept) == [("a", 0, 20), ("a", 90, 110)]
