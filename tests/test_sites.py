import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import kmers, sites
from seqloom.sources import files


def genome(spark, **seqs):
    return spark.createDataFrame(list(seqs.items()), "chrom string, seq string")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def brute(seqs, pattern_ok, n, ks, ke):
    comp = str.maketrans("ACGT", "TGCA")
    out = []
    for chrom, seq in seqs.items():
        for strand, s in (("+", seq), ("-", seq[::-1].translate(comp))):
            for i in range(len(s) - n + 1):
                if pattern_ok(s[i : i + n]):
                    out.append((chrom, i + ks if strand == "+" else len(s) - i - ke, s[i + ks : i + ke], strand))
    return sorted(out)


def test_strands_n_and_short_records(spark):
    g = genome(spark, a="TTACGTACGTAGGTT", b="AACCTACGTACGTAA", c="ACGNACGTAGG", d="AGG", e="")
    found = rows(sites.sites(g, "XXXXXXXXNGG"), "chrom", "start0", "kmer", "strand")
    ok = lambda w: set(w) <= set("ACGT") and w[9:] == "GG"
    assert found == brute({"a": "TTACGTACGTAGGTT", "b": "AACCTACGTACGTAA", "c": "ACGNACGTAGG", "d": "AGG", "e": ""}, ok, 11, 0, 8)
    assert ("a", 1, "TACGTACG", "+") not in found and any(r[3] == "-" for r in found)


def test_long_records_cross_chunks(spark):
    import random

    seq = "".join(random.Random(3).choices("ACGTN", [5, 5, 5, 5, 1], k=2000))
    found = rows(sites.sites(genome(spark, x=seq), "GXXXXXXRX"), "chrom", "start0", "kmer", "strand")
    assert found == brute({"x": seq}, lambda w: set(w) <= set("ACGT") and w[0] == "G" and w[7] in "AG", 9, 1, 9)
    wide = rows(sites.sites(genome(spark, x=seq.replace("N", "A")), "X" * 600), "start0", "strand")
    assert len(wide) == 2 * (2000 - 600 + 1)


def test_mask_palindrome_and_copies(spark):
    g = genome(spark, a="ACGTacgtACGT")
    assert rows(sites.sites(g, "XXXX", upper=False), "start0", "strand") == [(0, "+"), (0, "-"), (8, "+"), (8, "-")]
    counted = sites.with_copies(sites.sites(genome(spark, p="ACGT"), "XXXX"))
    assert rows(counted, "start0", "strand", "copies") == [(0, "+", 2), (0, "-", 2)]
    assert sites.clusters(sites.sites(genome(spark, p="ACGT"), "XXXX")).isEmpty()


def test_copy_bounds(spark):
    found = spark.createDataFrame([("AC", k) for k in range(3)] + [("GT", 9)], "kmer string, start0 int")
    assert sites.with_copies(found, 2, 0).count() == 3 and sites.with_copies(found, 1, 1).count() == 1 and sites.with_copies(found, 3, 3).count() == 3


def test_clusters(spark):
    data = [("AAAC", "1", 0, "+"), ("AAAC", "1", 10, "-"), ("CCCC", "1", 0, "+"), ("CCCC", "2", 50, "+"), ("GGGG", "1", 0, "+"), ("GGGG", "1", 3, "+"), ("TTTT", "1", 7, "-")]
    found = spark.createDataFrame(data, "kmer string, chrom string, start0 long, strand string")
    got = {r.name.split("/")[1]: r for r in sites.clusters(found).collect()}
    assert set(got) == {"AAAC", "TTTT"}
    assert (got["AAAC"].strand, got["AAAC"].end1, got["AAAC"].block_starts, got["AAAC"].name.split("/")[2:]) == (".", 14, [0, 10], ["k=2", "s=14"])
    assert got["TTTT"].strand == "-" and got["TTTT"].block_count == 1


def test_sets_and_absent(spark):
    a, b = (kmers.kmer_set(spark.createDataFrame([(k,) for k in ks], "kmer string")) for ks in (["AC", "GT", "AC"], ["GT", "TT"]))
    assert rows(kmers.union(a, b), "kmer") == [("AC",), ("GT",), ("TT",)] and rows(kmers.intersection(a, b), "kmer") == [("GT",)] and rows(kmers.difference(a, b), "kmer") == [("AC",)]
    assert rows(kmers.symmetric_difference(a, b), "kmer", "in_left") == [("AC", 1), ("TT", 0)]
    assert kmers.equal(a, a) and not kmers.equal(a, b)
    assert kmers.absent(spark, a, 2).count() == 14 == kmers.absent_count(a, 2).first().n_absent
    assert rows(kmers.absent(spark, a, 2, prefix="G"), "code", "kmer") == [(8, "GA"), (9, "GC"), (10, "GG")]
    assert rows(kmers.first(kmers.absent(spark, a, 2, motif="YR"), 2), "kmer") == [("CA",), ("CG",)]
    assert kmers.sample(a, 99).count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">c1 first one\nACGT\nAC\n>c2\n\n>c3\nGG\n")
    assert rows(files.read_fasta(spark, str(tmp_path / "g.fa")), "chrom", "seq") == [("c1", "ACGTAC"), ("c3", "GG")]
    (tmp_path / "q.tsv").write_text("x\ta.1/ACGT/9\n\ny\tb.2/acnt/1\n")
    assert [r.kmer for r in files.read_queries(spark, str(tmp_path / "q.tsv"), "2,./,3").orderBy("line").collect()] == ["ACGT", None]
    assert files.shards("db.[AA,AC].gz") == ("db.*.gz", ["AA", "AC"])
    (tmp_path / "names").write_text("0 chr1|x:17\n1\tchr2\n")
    n, o = files.name_and_offset(F.col("chrom"))
    assert rows(files.read_names(spark, str(tmp_path / "names")).select(n.alias("n"), o.alias("o")), "n", "o") == [("chr1", 17), ("chr2", -1)]
    table = spark.createDataFrame([("AACC", 1), ("ACGG", 2), ("TTTT", 3)], "kmer string, n long")
    files.write_kmers(table, str(tmp_path / "db"))
    assert rows(files.read_kmers(spark, str(tmp_path / "db"), ["AA", "AC"]), "kmer", "n") == [("AACC", 1), ("ACGG", 2)]
    bed = sites.to_bed6(sites.with_copies(sites.sites(genome(spark, z="ACGTT"), "XXXX")))
    files.write_bed(bed, str(tmp_path / "bed"))
    assert rows(files.read_table(spark, str(tmp_path / "bed"), files.BED6), *bed.columns) == rows(bed, *bed.columns)
    assert files.header_line(bed).startswith("#chrom\tstart0") and files.columns_of(bed).count() == 6


def test_motif_needs_a_key():
    with pytest.raises(ValueError):
        sites.key_range("NGG")


def test_streaming_counts(spark, tmp_path):
    from seqloom.streaming.counts import streaming_counts

    genome(spark, a="ACGTT").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("chrom string, seq string").parquet(str(tmp_path / "in"))
    query = streaming_counts(stream, 2).writeStream.outputMode("complete").format("memory").queryName("kmer_stream").trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.table("kmer_stream"), "kmer", "n") == [("AA", 1), ("AC", 2), ("CG", 2), ("GT", 2), ("TT", 1)]


def test_fasta_in_chunks(spark, tmp_path):
    """Records over several lines, files and splits: every window once, at its place in its record."""
    rng = random.Random(1)
    seqs = {f"c{k}": "".join(rng.choices("ACGT", k=n)) for k, n in enumerate((1, 90, 700, 5000, 3))}
    (tmp_path / "g").mkdir()
    for f, names in (("a.fa", ["c0", "c1", "c2"]), ("b.fa", ["c3", "c4"])):
        (tmp_path / "g" / f).write_text("".join(f">{c} text\n" + "".join(seqs[c][i : i + 7] + "\n" for i in range(0, len(seqs[c]), 7)) + "\n" for c in names))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600b")
    try:
        chunks = files.read_fasta_chunks(spark, str(tmp_path / "g"), 9, 50)
        got = rows(sites.sites(chunks, "XXXXXXXGG"), "chrom", "start0", "kmer", "strand")
        whole = spark.createDataFrame(list(seqs.items()), "chrom string, seq string")
        assert got == rows(sites.sites(whole, "XXXXXXXGG"), "chrom", "start0", "kmer", "strand") and len(got) > 100
        assert rows(files.read_fasta_chunks(spark, str(tmp_path / "g"), 1, 1 << 20), "chrom", "offset", "seq") == sorted((c, 0, s) for c, s in seqs.items())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_dumps_and_orders(spark):
    found = spark.createDataFrame([("AC", "1", 5, "+"), ("AC", "1", 2, "-"), ("GT", "2", 0, "+")], "kmer string, chrom string, start0 long, strand string")
    assert [r.line for r in sites.text_dump(found).collect()] == ["111001000\tF:1:5", "111001000\tR:1:2", "111010011\tF:2:0"]
    assert [(r.kmer, r.start0) for r in sites.by_key(found).collect()] == [("GT", 0), ("AC", 2), ("AC", 5)]
    assert [r.start0 for r in sites.by_place(found).collect()] == [2, 5, 0]
    assert tuple(sites.totals(found, 2).first()) == (3, 2, 1, 2) and tuple(sites.totals(found.limit(0)).first()) == (0, 0, 0, 0)
    old = sites.to_bed6(sites.with_copies(found).withColumn("end1", F.col("start0") + 2), with_seq=False)
    assert {r.name for r in old.collect()} == {"456.2", "467.1"}
    codes = spark.createDataFrame([(2,), (9,)], "code long")
    assert rows(kmers.with_range(spark, codes, 4, 6), "code") == [(2,), (4,), (5,), (9,)] and rows(kmers.within_range(codes, 2, 9), "code") == [(2,)]


def test_fasta_chunks_are_cut_within_splits(spark, tmp_path, monkeypatch):
    """Lines are not shuffled: most chunks leave their split whole, whatever stands in the file, and a few pieces of each split are put together."""
    rng = random.Random(4)
    seqs = {"a": 900, "b": 40, "c": 6000, "d": 0, "e": 100}
    seqs = {c: "".join(rng.choices("ACGTN", k=n)) for c, n in seqs.items()}
    cut = lambda s: "".join(s[i : i + 9] + rng.choice(["\n", " \n", "\r\n", "\n\n"]) for i in range(0, len(s), 9))
    (tmp_path / "g.fa").write_text("ACGT\n" + "".join(f"> {c} of many\n" + cut(s) + ">\n" + cut("ACGTACGTACGT") for c, s in seqs.items()), newline="")
    seqs.pop("d")
    seen = []
    kept = files.written
    monkeypatch.setattr(files, "written", lambda df, name: seen.append(kept(df, name)) or seen[-1])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")
    try:
        for n, size in ((1, 7), (9, 7), (9, 50), (30, 100), (5, 1 << 14)):
            want = sorted((c, at, s[at : at + size + n - 1]) for c, s in seqs.items() for at in range(0, len(s), size))
            assert rows(files.read_fasta_chunks(spark, str(tmp_path / "g.fa"), n, size), "chrom", "offset", "seq") == want
        few = seen[2].where("NOT whole").count()
        assert 0 < few < 40 < seen[2].where("whole").count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_clusters_of_codes(spark, capsys):
    """Sites with codes make the same rows as sites with k-mers; nothing is aggregated by sorting text, and a chromosome's hash decides nothing alone."""
    rng = random.Random(9)
    repeat = "".join(rng.choices("ACGT", k=60))
    seqs = {c: "".join(rng.choices("ACGT", k=300)) + repeat * m + "".join(rng.choices("ACGT", k=90)) for c, m in (("a", 3), ("b", 1), ("c", 0))}
    seqs["c"] += "T" * 30 + 2 * "ACGTTGCAAC" + "".join(rng.choices("ACGT", k=50)) * 3
    g = spark.createDataFrame(list(seqs.items()), "chrom string, seq string")
    coded = sites.clusters(sites.coded_sites(g, "X" * 12 + "NGG"), coded=12)
    spelled = sites.clusters(sites.sites(g, "X" * 12 + "NGG"))
    assert rows(coded, *coded.columns) == rows(spelled, *coded.columns) and {r.copies for r in coded.collect()} >= {1, 3}
    coded.explain()
    assert "SortAggregate" not in capsys.readouterr().out
