import itertools
import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators import neighbors as N
from seqloom.plans.hamming import BlockPlan, choose


def distance(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True))


@pytest.fixture(scope="module")
def table():
    rng = random.Random(5)
    base = ["".join(rng.choices("ACGT", k=10)) for _ in range(20)]
    near = [b[:i] + rng.choice("ACGT") + b[i + 1 :] for b in base for i in rng.sample(range(10), 4)]
    twice = [n[:j] + rng.choice("ACGT") + n[j + 1 :] for n in near for j in (2, 7)]
    return {k: rng.randint(1, 9) for k in [*base, *near, *twice]}


@pytest.mark.parametrize("m", [0, 1, 2, 3])
def test_every_plan_finds_every_pair(spark, table, m):
    t = spark.createDataFrame(list(table.items()), "kmer string, n long").withColumn("code", S.kmer_code(F.col("kmer"))).cache()
    codes = {r.kmer: r.code for r in t.collect()}
    want = sorted((codes[a], codes[b], n, distance(a, b)) for a, (b, n) in itertools.product(table, table.items()) if distance(a, b) <= m)
    for blocks in range(1, m + 2):
        if m // blocks <= 2:
            got = sorted(tuple(r) for r in N.pairs(t.select(F.col("code").alias("q")), t.select("code", "n"), 10, m, BlockPlan(10, m, blocks)).collect())
            assert got == want


@pytest.mark.parametrize("m, crowd", [(1, 1), (2, 1), (3, 1), (2, 40), (3, 40)])
def test_crowded_blocks_are_cut_and_lose_no_pair(spark, m, crowd):
    rng = random.Random(m)
    # most codes share their first half, some their second, a few neither
    kmers = {"AAAAA" + "".join(rng.choices("ACGT", k=5)) for _ in range(120)} | {"".join(rng.choices("ACGT", k=5)) + "CCCCC" for _ in range(40)} | {"".join(rng.choices("ACGT", k=10)) for _ in range(40)}
    held = {a: rng.randint(1, 9) for a in sorted(kmers)}
    t = spark.createDataFrame(list(held.items()), "kmer string, n long").withColumn("code", S.kmer_code(F.col("kmer"))).cache()
    codes = {r.kmer: r.code for r in t.collect()}
    want = sorted((codes[a], codes[b], n, distance(a, b)) for a, (b, n) in itertools.product(held, held.items()) if distance(a, b) <= m)
    for plan in [BlockPlan(10, m, b) for b in range(1, m + 2) if m // b <= 2]:
        got = sorted(tuple(r) for r in N.pairs(t.select(F.col("code").alias("q")), t.select("code", "n"), 10, m, plan, crowd).collect())
        assert got == want


def test_one_dominant_block_does_not_meet_all_its_queries(spark):
    codes = spark.range(3000).select((F.col("id") * 349 % 4**6).alias("code"), F.lit(1).cast("long").alias("n"))  # the first six of twelve bases are all A
    found = N.pairs(codes.select(F.col("code").alias("q")), codes, 12, 1, BlockPlan(12, 1, 2), crowd=100)
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert len(joins) == 2 and any(all(f" {c}#" in join or f"({c}#" in join for c in ("block", "i", "part")) for join in joins)
    held = {i * 349 % 4**6 for i in range(3000)}
    assert found.count() == sum(a ^ (x << p) in held for a in held for p in range(0, 12, 2) for x in (1, 2, 3)) + len(held)


def test_plan_prefers_wide_blocks():
    assert choose(20, 3).blocks == 2 and choose(20, 0).blocks == 1
    assert sum(bits for _, bits in choose(21, 2).spans()) == 42
    with pytest.raises(ValueError):
        choose(32, 1)


def test_profile_set_bag_and_listing(spark):
    counts = spark.createDataFrame([("ACGT", 2), ("ACGA", 5), ("TCGA", 1)], "kmer string, n long")
    queries = spark.createDataFrame([("ACGT",), ("acgt",), ("GCGT",), ("ACNT",), (None,), ("ACGT",)], "kmer string")
    bag = {r.kmer: r.off_site_counts for r in N.profile(queries, counts, 2).collect()}
    assert bag == {"ACGT": "2/5/1", "acgt": "2/5/1", "GCGT": "0/2/6", "ACNT": None, None: None}
    assert N.profile(queries, counts, 2).count() == 6
    assert {r.off_site_counts for r in N.profile(queries.limit(1), counts, 2, bag=False).collect()} == {"1/1/1"}
    listed = {r.kmer: r.found for r in N.profile(queries, counts, 2, listing=True).collect()}
    assert listed["ACGT"] == "ACGT:2/ACGa:5/tCGa:1" and listed["GCGT"] == "GCGT:0/aCGT:2/aCGa:5/tCGa:1"


def test_thresholds_and_merge(spark):
    rows = spark.createDataFrame([("a", 1, 0, 0), ("b", 1, 3, 0), ("c", 1, 1, 9)], "kmer string, n0 long, n1 long, n2 long")
    assert [r.kmer for r in N.within(rows, "1/2/-1/-1").orderBy("kmer").collect()] == ["a", "c"]
    assert [r.kmer for r in N.within(rows, "1/2/-1/5").collect()] == ["a"]
    assert spark.sql("SELECT '1/2' AS a, '3/40' AS b").select(N.merge_profiles(F.col("a"), F.col("b"))).first()[0] == "4/42"


def test_hits(spark):
    queries = spark.createDataFrame([("ACGT",), ("TTTT",)], "kmer string")
    hits = spark.createDataFrame([("ACGT", 0), ("ACGT", 2), ("acgt", 2)], "pattern string, mismatches long")
    assert {tuple(r) for r in N.hit_histogram(queries, hits, 2).collect()} == {("ACGT", 1, 0, 2), ("TTTT", 0, 0, 0)}
    assert N.hit_search_input(queries, 3).first().line == "ACGTNNN 3"
