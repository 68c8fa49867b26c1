import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators import absence as A
from seqloom.operators import kmers as K
from seqloom.operators import neighbors as N
from seqloom.operators import pages as P
from seqloom.operators import shards as H
from seqloom.sources import files

SETS = {"X": "ACGT", "R": "AG", "Y": "CT", "B": "CGT", "A": "A"}


def all_kmers(k):
    return ["".join(x) for x in itertools.product("ACGT", repeat=k)]


@pytest.fixture(scope="module")
def present(spark):
    """Half of all 5-mers, some twice, with a long run that lacks them all and both ends missing."""
    rng = random.Random(2)
    kept = [x for i, x in enumerate(all_kmers(5)) if rng.random() < 0.5 and not 300 < i < 500 and 0 < i < 1023]
    return kept, spark.createDataFrame([(x,) for x in kept + kept[:20]], "kmer string")


@pytest.mark.parametrize(("prefix", "motif"), [("", ""), ("G", ""), ("", "XRYXB"), ("C", "XRYXB"), ("GATC", ""), ("", "AAAAA"), ("C", "AAAAA")])
@pytest.mark.parametrize("limit", [0, 1, 37])
def test_absent(spark, monkeypatch, present, prefix, motif, limit):
    monkeypatch.setattr(A, "BLOCKS", 16)
    monkeypatch.setattr(A, "STEP", 8)
    kept, table = present
    fits = [x for x in all_kmers(5) if x.startswith(prefix) and all(c in SETS[m] for c, m in zip(x, motif or "XXXXX", strict=True))]
    want = [x for x in fits if x not in set(kept)]
    got = A.absent(table, 5, prefix, motif, limit).orderBy("code").collect()
    assert [r.kmer for r in got] == (want[:limit] if limit else want)
    assert all(sum("ACGT".index(c) * 4 ** (4 - i) for i, c in enumerate(r.kmer)) == r.code for r in got)
    assert A.absent_count(table, 5, prefix, motif).first()[0] == len(want)


def test_gaps_cover_what_is_absent(spark, monkeypatch, present):
    monkeypatch.setattr(A, "STEP", 8)
    kept, table = present
    rows = A.gaps(table, 5).collect()
    held = {sum("ACGT".index(c) * 4 ** (4 - i) for i, c in enumerate(x)) for x in kept}
    assert sorted(c for r in rows for c in range(r["first"], r["last"] + 1)) == sorted(set(range(1024)) - held)
    assert all(r["first"] - 1 in held | {-1} and r["last"] + 1 in held | {1024} and r.n == r["last"] - r["first"] + 1 for r in rows)
    nothing = A.gaps(table.limit(0), 5).collect()
    assert [(r["first"], r["last"]) for r in nothing] == [(0, 1023)] and A.gaps(spark.createDataFrame([(x,) for x in all_kmers(2)], "kmer string"), 2).isEmpty()


def test_large_spaces_are_not_listed(spark, present):
    began = time.time()
    some = spark.createDataFrame([("A" * 14 + x,) for x in all_kmers(2)[:9]], "kmer string")
    first = A.absent(some, 16, limit=1000).orderBy("code").collect()
    assert [r.code for r in first] == list(range(9, 1009)) and first[0].kmer == "A" * 14 + "GC"
    drawn = [r.kmer for r in A.draw_absent(spark, spark.createDataFrame([("ACGT" * 5,)], "kmer string"), 20, 30, seed=3, motif="X" * 18 + "RY").orderBy("draw").collect()]
    again = [r.kmer for r in A.draw_absent(spark, spark.createDataFrame([("ACGT" * 5,)], "kmer string"), 20, 30, seed=3, motif="X" * 18 + "RY").orderBy("draw").collect()]
    assert drawn == again and len(set(drawn)) == 30 and all(x[18] in "AG" and x[19] in "CT" for x in drawn) and len({x[:2] for x in drawn}) > 6
    assert A.absent_count(some, 31).first()[0] == 4**31  # 16-mers are no 31-mers
    assert time.time() - began < 60


def test_draws_are_a_bijection(spark, present):
    for size in (1, 2, 100, 4**5, 6**4):
        n = 4 ** A.half_bits(size)
        got = [r["rank"] for r in A.shuffled(spark.range(n).withColumnRenamed("id", "draw"), size, 5).orderBy("draw").collect()]
        assert sorted(got) == list(range(n)) and n >= size and (n < 50 or got != list(range(n)))
    kept, table = present
    lacking = set(all_kmers(5)) - set(kept)
    assert {r.kmer for r in A.draw_absent(spark, table, 5, 10**6, seed=1).collect()} == lacking
    assert [r.kmer for r in A.draw_absent(spark, table, 5, 7, seed=1).orderBy("draw").collect()] == [r.kmer for r in A.draw_absent(spark, table, 5, 200, seed=1).orderBy("draw").limit(7).collect()]
    assert A.draw_absent(spark, table, 5, 5, prefix="C", motif="AXXXX").isEmpty() and A.draw_absent(spark, table, 5, 0).isEmpty()


def test_pages(spark, tmp_path):
    rng = random.Random(4)
    left, right = ({rng.choice([rng.randrange(4**9), rng.randrange(300)]) for _ in range(2000)} | {0, 32767, 32768} for _ in range(2))
    a, b = (P.pages(spark.createDataFrame([(c,) for c in [*s, *s, None]], "code long")) for s in (left, right))
    for made, want in ((P.union(a, b), left | right), (P.intersection(a, b), left & right), (a, left)):
        assert sorted(r.code for r in P.members(made, 9).collect()) == sorted(want)
        assert tuple(P.absent_count(made, 9).first()) == (len(want), 4**9 - len(want))
    assert P.members(a, 9).where("code = 32768").first().kmer == "AGAAAAAAA"
    P.write_pages(a, str(tmp_path / "set"))
    pruned = P.read_pages(spark, str(tmp_path / "set"), "GT", 9)
    assert {r.page for r in pruned.collect()} <= {6, 7} and P.members(pruned, 9).where("kmer LIKE 'GT%'").count() == sum(4**9 * 11 // 16 <= c < 4**9 * 12 // 16 for c in left)
    assert tuple(P.absent_count(a.limit(0), 9).first()) == (0, 4**9)


def test_strand_counts(spark):
    rng = random.Random(6)
    seqs = ["".join(rng.choices("ACGTNacgtu-", [20, 20, 20, 20, 1, 1, 1, 1, 1, 1, 1], k=n)) for n in (0, 3, 4, 5, 63, 64, 65, 66, 67, 68, 500, 2000)] + ["ACGT" * 40, None, "A" * 1000]
    table = spark.createDataFrame([(f"c{i}", s) for i, s in enumerate(seqs)], "chrom string, seq string")
    for k in (1, 4, 5, 31):
        fast, slow = (sorted(tuple(r) for r in t.select("kmer", "n", "code").collect()) for t in (K.strand_counts(table, k), K.kmer_counts(K.kmers(table, k))))
        assert fast == slow and fast


@pytest.fixture(scope="module")
def sharded(spark, tmp_path_factory):
    rng = random.Random(9)
    base = ["".join(rng.choices("ACGT", k=10)) for _ in range(60)]
    near = [b[:i] + rng.choice("ACGT") + b[i + 1 :] for b in base for i in rng.sample(range(10), 5)]
    counts = spark.createDataFrame([(x, rng.randint(1, 5)) for x in sorted({*base, *near})], "kmer string, n long")
    path = str(tmp_path_factory.mktemp("shards") / "table")
    files.write_kmers(counts, path, 3)
    return base, counts, path


@pytest.mark.parametrize("m", [0, 1, 3])
def test_shard_profiles_are_profiles(spark, sharded, m):
    base, counts, path = sharded
    queries = spark.createDataFrame([(x,) for x in [*base[:25], base[0], base[1].lower(), "ACGTACGTAN", "ACG", None]], "kmer string")
    want = N.profile(queries, counts, m, k=10).drop("off_site_counts")
    names = [f"n{i}" for i in range(m + 1)]
    key = lambda r: tuple(map(str, r))
    told = sorted(((r.kmer, *(r[n] for n in names)) for r in want.collect() if r.kmer != "ACG"), key=key)
    assert sorted(((r.kmer, *(r[n] for n in names)) for r in H.profile(queries, path, m, 10).collect() if r.kmer != "ACG"), key=key) == told
    bounds = "/".join(["3"] * (m + 1)) + "/6"
    some = sorted(tuple(r) for r in N.within(want, bounds).where("length(kmer) = 10").collect())
    assert sorted(tuple(r) for r in H.profile(queries, path, m, 10, bounds, per_round=20).collect()) == some


def test_only_reachable_shards_are_read(spark, sharded):
    base, _, path = sharded
    asked = spark.createDataFrame([(base[0],)], "kmer string").select(S.kmer_code(F.col("kmer")).alias("q"))
    shards = H.shard_list(spark.read.parquet(path))
    near = [s for s in shards if sum(a != b for a, b in zip(s, base[0], strict=False)) <= 1]
    assert H.rounds(shards, asked, 10, 1, 4) == [near[k : k + 4] for k in range(0, len(near), 4)] and len(near) < len(shards)
    table = H.shard_table(spark, path, near)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and near[0] in plan and set(r[0] for r in files.read_kmers(spark, path, near).select("prefix").distinct().collect()) <= set(near)
