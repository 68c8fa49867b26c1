import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.functions import seq as S

# Published rows: sequence, key, percent GC, longest run of T.
GOLDEN = [("CCCGGTAGAGTATTTGAAGA", 8124609316492752457, 45.0, 3), ("GCAGACACATGCTAGCGCGT", 8415868856704206347, 60.0, 1), ("ACGCAACTCCGCCGTTGCAA", 8073627651782476488, 60.0, 2)]


def test_golden_rows(spark):
    rows = spark.createDataFrame(GOLDEN, "kmer string, key long, gc double, t int")
    k = F.col("kmer")
    wrong = rows.where((S.kmer_key(k) != F.col("key")) | (S.percent_gc(k) != F.col("gc")) | (S.longest_t(k) != F.col("t")) | (S.kmer_of_key(F.col("key")) != k))
    assert wrong.isEmpty()


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text("ACGT", min_size=1, max_size=20), min_size=1, max_size=30))
def test_round_trips(spark, kmers):
    rows = spark.createDataFrame([(k,) for k in kmers], "kmer string")
    k = F.col("kmer")
    got = rows.select(k, S.revcomp(S.revcomp(k)).alias("rr"), S.kmer_of_key(S.kmer_key(k)).alias("kk"), S.kmer_code(k).alias("code")).collect()
    assert all(r.kmer == r.rr == r.kk for r in got)
    assert [r.code for r in got] == [int("".join(str("ACGT".index(c)) for c in x), 4) for x in kmers]


def test_letters(spark):
    row = spark.sql("SELECT 'acgURnX' AS s, 'ACGTNRu' AS t").select(S.normalise(F.col("s")).alias("n"), S.revcomp(F.col("t")).alias("r")).first()
    assert row.n == "ACGTNNN" and row.r == "aRNACGT"


def test_hamming_and_mutations(spark):
    rows = spark.createDataFrame([("ACGT", "ACGT"), ("ACGT", "TCGA"), ("AAAA", "CCCC")], "a string, b string")
    got = rows.select(S.hamming(S.kmer_code(F.col("a")), S.kmer_code(F.col("b"))).alias("d"), S.mutation_string(F.col("a"), F.col("b")).alias("m")).collect()
    assert [(r.d, r.m) for r in got] == [(0, "ACGT"), (2, "tCGa"), (4, "cccc")]


def test_not_a_kmer_is_null(spark):
    row = spark.sql("SELECT 'ACNT' AS a, '' AS b, repeat('A', 21) AS c, cast(null AS string) AS d").select(*[S.kmer_key(F.col(c)).alias(c) for c in "abcd"]).first()
    assert list(row) == [None] * 4


def test_motifs():
    assert S.motif_regex("XNGG") == "^[ACGT][ACGT][G][G]$"
    assert S.reverse_motif("XXNGG") == "CCXXX" and S.reverse_motif("XR") == "YX"
    with pytest.raises(ValueError):
        S.motif_regex("X*")


def test_sql_functions(spark):
    S.register(spark)
    row = spark.sql("SELECT revcomp('ACGTn') AS r, hamming2bit(kmer_code('ACGT'), kmer_code('AGGT')) AS d, kmer_key('CCCGGTAGAGTATTTGAAGA') AS k").first()
    assert (row.r, row.d, row.k) == ("nACGT", 1, 8124609316492752457)


def test_sql_functions_on_odd_input(spark):
    S.register(spark)
    one = lambda call: spark.sql(f"SELECT {call} AS x").first().x
    for call in ("kmer_key('ACNT')", "kmer_key('')", "kmer_key(repeat('A', 25))", "kmer_code('ACNT')", "kmer_code('')", "kmer_code(repeat('A', 40))", "kmer_key(CAST(NULL AS STRING))"):
        assert one(call) is None, call
    assert one("kmer_key('AC')") == 456 and one("kmer_code('ACGT')") == 27
