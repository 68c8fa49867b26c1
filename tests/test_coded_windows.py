"""Windows as codes against windows cut out letter by letter."""

import random
import re

import pytest
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators import kmers, sites

SWAP = str.maketrans("ACGT", "TGCA")


def texts(seed: int) -> list[str]:
    draw = random.Random(seed)
    # lengths round the borders of chunks and halves; runs of N, lower case, other letters
    sizes = [0, 1, 2, 7, 8, 30, 31, 32, 53, 54, 55, 56, 61, 62, 63, 92, 93, 94, 123, 124, 125, 400]
    rows = ["".join(draw.choice("ACGT" if draw.random() < 0.97 else "NnacgtU-é😀") for _ in range(n)) for n in sizes]
    return [*rows, "N" * 70, "A" * 130, "acgt" * 20, "ACGT" * 40, "A" * 31 + "N" + "C" * 31, "N" + "G" * 62 + "N"]


def code(word: str) -> int:
    value = 0
    for c in word:
        value = 4 * value + max(0, "ACGT".find(c))
    return value


@pytest.mark.parametrize("n", [1, 2, 8, 20, 23, 30, 31])
def test_codes(spark, n):
    rows = [(i, re.sub("[^ACGT]", "N", t.upper().replace("U", "T"))) for i, t in enumerate(texts(n))]
    got = sites.coded_windows(spark.createDataFrame(rows, "id int, seq string"), n).select("id", "i", "code", "twin", "bad").collect()
    want = []
    for id_, t in rows:
        for i in range(len(t) - n + 1):
            word = t[i : i + n]
            bad = int("".join("1" if c == "N" else "0" for c in word), 2)
            twin = code(word[::-1].translate(SWAP)) if not bad else None
            want.append((id_, i, code(word), twin, bad))
    assert sorted((r["id"], r["i"], r["code"], r["twin"] if not r["bad"] else None, r["bad"]) for r in got) == sorted(want)


def test_windows_too_long_for_a_code(spark):
    with pytest.raises(ValueError):
        sites.coded_windows(spark.createDataFrame([("A",)], "seq string"), 32)


def plain_sites(rows, pattern, regex, prefix=""):
    n, (ks, ke) = len(pattern), sites.key_range(pattern)
    found = []
    for chrom, t in rows:
        for strand, s in (("+", t), ("-", t[::-1].translate(SWAP))):
            for i in range(len(s) - n + 1):
                word = s[i : i + n]
                if re.fullmatch(regex.strip("^$"), word) and word[ks:ke].startswith(prefix):
                    start = i + ks if strand == "+" else len(s) - i - ke
                    found.append((chrom, start, start + ke - ks, word[ks:ke], strand))
    return sorted(found)


@pytest.mark.parametrize("pattern", ["X" * 20 + "NGG", "XXXXNRG", "CXXRXN", "BXDHVYKX", "TTTVXXXX", "X", "NXN", "X" * 28 + "NGG", "X" * 30 + "NGG"])
@pytest.mark.parametrize("lenient", [False, True])
def test_motifs(spark, pattern, lenient):
    raw = [(f"c{i}", t) for i, t in enumerate(texts(len(pattern)))]
    rows = [(c, re.sub("[^ACGT]", "N", t.upper().replace("U", "T"))) for c, t in raw]
    regex = S.lenient_regex(pattern) if lenient else S.motif_regex(pattern)
    table = spark.createDataFrame(raw, "chrom string, seq string")
    got = sorted(tuple(r) for r in sites.sites(table, pattern, lenient=lenient).collect())
    assert got == plain_sites(rows, pattern, regex)


def test_masked_windows_match_nothing(spark):
    raw = [("c", "ACGTACGTaCGTTGGACCAAGGTnACGGTCCUAGG")]
    want = plain_sites([("c", re.sub("[^ACGT]", "N", raw[0][1].replace("U", "T")))], "XXXNGG", S.motif_regex("XXXNGG"))
    got = sorted(tuple(r) for r in sites.sites(spark.createDataFrame(raw, "chrom string, seq string"), "XXXNGG", upper=False).collect())
    assert got == want and got


def test_unknown_motif_letter(spark):
    with pytest.raises(ValueError):
        sites.sites(spark.createDataFrame([("c", "ACGT")], "chrom string, seq string"), "XXJ")


@pytest.mark.parametrize("k", [1, 5, 31, 33])
def test_counts_of_both_strands(spark, k):
    rows = [(f"c{i}", t) for i, t in enumerate(texts(k))] + [("null", None)]
    table = spark.createDataFrame(rows, "chrom string, seq string")
    fast, plain = (sorted((r["kmer"], r["n"], r["code"]) if k < 32 else (r["kmer"], r["n"]) for r in t.collect()) for t in (kmers.strand_counts(table, k), kmers.kmer_counts(kmers.kmers(table, k))))
    assert fast == plain and fast


def test_codes_spelled_and_turned(spark):
    words = ["A", "T", "ACGT", "A" * 31, "T" * 31, "GATTACA" * 4, "C" + "A" * 30]
    table = spark.createDataFrame([(w,) for w in words], "kmer string").withColumn("code", S.kmer_code(F.col("kmer")))
    for w in words:
        one = table.where(F.col("kmer") == w).select(S.spelled(F.col("code"), len(w)), S.revcomp_code(F.col("code"), len(w))).first()
        assert one[0] == w and one[1] == code(w[::-1].translate(SWAP))


def test_plan_tests_no_text_per_window(spark):
    table = spark.createDataFrame([("c", "ACGT" * 50)], "chrom string, seq string")
    plan = kmers.strand_counts(table, 20)._jdf.queryExecution().executedPlan().toString()
    assert "substring(chunk" not in plan.split("Generate explode(sequence")[0]  # nothing is cut out behind the windows
