import random
from collections import Counter, defaultdict

import pytest

from seqloom.plans import queries as Q

BASES = "ACGT"


@pytest.fixture(scope="module")
def near_sites(spark, tmp_path_factory):
    """Documents whose letters a to d are bases, with sites zero to four mismatches apart, and (chrom, start0, kmer, strand) of all sites."""
    rng = random.Random(8)
    base = "".join(rng.choices(BASES, k=20))
    texts = {3: [], 10: [], 25: []}
    for k in range(60):
        kmer = list(base)
        for i in rng.sample(range(20), k % 5):
            kmer[i] = rng.choice([c for c in BASES if c != kmer[i]])
        texts[rng.choice([3, 10, 25])].append("".join(kmer) + "TGG")
    twice = "".join(rng.choices(BASES, k=20)) + "AGG"
    texts[25] += [twice, "A" * 7, twice]
    seqs = {k: "".join(v) for k, v in texts.items()}
    d = str(tmp_path_factory.mktemp("near"))
    spark.createDataFrame([(k, s.translate(str.maketrans(BASES, "abcd"))) for k, s in seqs.items()], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    found = []
    for k, seq in seqs.items():
        for strand, s in (("+", seq), ("-", seq[::-1].translate(str.maketrans(BASES, "TGCA")))):
            found += [(f"doc{k}", i if strand == "+" else len(s) - i - 20, s[i : i + 20], strand) for i in range(len(s) - 22) if s[i + 21 : i + 23] == "GG"]
    return d, found


def profiles(found):
    count = Counter(kmer for _, _, kmer, _ in found)
    out = {a: [0] * 4 for a in count}
    for a in count:
        for b, n in count.items():
            apart = sum(x != y for x, y in zip(a, b, strict=True))
            if apart <= 3:
                out[a][apart] += n
    return out


def test_tables_count_three_mismatches(spark, near_sites):
    d, found = near_sites
    want = profiles(found)
    got = Q.QUERIES["db_annotate18"](spark, d).collect()
    assert len(got[0]) == 18 and sorted((r.chrom, r.chromStart, r.spacerSeq, r.strand) for r in got) == sorted(found)
    assert all([r.n0mismatches, r.n1mismatches, r.n2mismatches, r.n3mismatches] == want[r.spacerSeq] and r.totalOffSites == sum(want[r.spacerSeq][1:]) for r in got)
    assert any(r.n3mismatches for r in got)
    clusters = Q.QUERIES["db_annotate22"](spark, d).collect()
    assert clusters and len(clusters[0]) == 22 and all(r.offSiteCounts == "/".join(map(str, want[r.spacerSeq])) and r.clusterSize == r.n0mismatches for r in clusters)


def test_best_by_three_mismatches(spark, near_sites):
    d, found = near_sites
    want = profiles(found)
    by_chrom = defaultdict(list)
    for chrom, start, kmer, _ in found:
        by_chrom[chrom].append((sum(want[kmer][1:]), start, kmer))
    best = {(c, s, k) for c, rows in by_chrom.items() for _, s, k in sorted(rows)[:2]}
    got = Q.QUERIES["db_best_n_by_chrom"](spark, d).collect()
    assert {(r.chrom, r.chromStart, r.name.split("/")[1]) for r in got} == best
    gc = lambda kmer: sum(c in "GC" for c in kmer)
    for rid, (chrom, lo, hi) in enumerate(Q.REGIONS):
        rows = [r for r in by_chrom[chrom] if r[1] + 20 > lo and (hi <= 0 or r[1] < hi)]
        first = sorted(rows, key=lambda r: (r[0], -gc(r[2]), r[1]))[:4]
        told = sorted((r["rank"], r.chromStart, r.name.split("/")[1]) for r in Q.QUERIES["db_best_n"](spark, d).where(f"rid = {rid}").collect())
        assert [x[1:] for x in told] == [r[1:] for r in first]


def test_lenient_sites_and_absent_sample_of_all_prefixes(spark, near_sites):
    d, _ = near_sites
    assert {r.kmer[0] for r in Q.QUERIES["site_lenient_motif"](spark, d).collect()} == set(BASES)
    spark.createDataFrame([(1, "abcd" * 3)], "item_id long, text string").write.mode("overwrite").parquet(f"{d}/benchmark.parquet")
    drawn = [r.kmer for r in Q.QUERIES["absent_sample"](spark, d).collect()]
    assert len(drawn) == 50 and len({k[:2] for k in drawn}) > 4


def test_overlaps_of_all_flags(spark, tmp_path):
    lines = [(1, 1, 7, 5.0, "R", "O"), (1, 1, 7, 4.0, "A", "O"), (2, 1, 7, 9.0, "N", "F"), (2, 50, 7, 9.0, "N", "F")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted((r.s_b, r.e_b) for r in Q.QUERIES["overlap_join"](spark, str(tmp_path)).collect()) == [(11, 15), (12, 21)]
    assert sorted((r.s_b, r.e_b, r.n) for r in Q.QUERIES["overlap_join_halfopen"](spark, str(tmp_path)).collect()) == [(11, 15, 4), (12, 21, 4)]
