import random
from collections import Counter
from pathlib import Path

import pytest

from seqloom import commands as C
from seqloom.operators import intervals as I
from seqloom.operators import kmers, neighbors, sitedb, sites
from seqloom.plans import queries as Q
from seqloom.sources import files, stores
from seqloom.streaming.counts import CountTable


@pytest.fixture(scope="module")
def fastas(tmp_path_factory):
    """Two FASTA files, the second with a masked and an unknown stretch."""
    rng = random.Random(11)
    folder, paths, seqs = tmp_path_factory.mktemp("fasta"), [], []
    for f in range(2):
        text = ""
        for r in range(4):
            seq = "".join(rng.choices("ACGT", k=400)) + ("acgtnn" * 5 if f else "") + "TTTTTTTTTTTTTTTT" + "ACGGATTAGGCCTTGG"
            seqs.append((f"c{f}{r}", seq))
            text += f">c{f}{r} told\n" + "\n".join(seq[k : k + 50] for k in range(0, len(seq), 50)) + "\n"
        (folder / f"{f}.fa").write_text(text)
        paths.append(str(folder / f"{f}.fa"))
    return paths, seqs


def both_strands(seqs, k, pam=""):
    swap, out = str.maketrans("ACGT", "TGCA"), Counter()
    for _, s in seqs:
        s = s.upper()
        for t in (s, s.translate(swap)[::-1]):
            for i in range(len(t) - k - len(pam) + 1):
                w, tail = t[i : i + k], t[i + k : i + k + len(pam)]
                if set(w) <= set("ACGT") and all(p == "N" and c in "ACGT" or p == c for p, c in zip(pam, tail, strict=True)):
                    out[w] += 1
    return out


def lines(path):
    return sorted(x for p in Path(path).rglob("part-*") for x in p.read_text().splitlines())


def test_buckets_need_no_exchange(spark, fastas, tmp_path):
    found = sites.sites(files.read_fasta(spark, fastas[0][0]), "XXXXXXNGG")
    stores.write_bucketed(found, "sites_in_buckets", str(tmp_path / "b"), 4)
    rows = stores.bucketed_copies(spark, "sites_in_buckets", 2)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    key = lambda t: sorted(tuple(map(str, (r.kmer, r.chrom, r.start0, r.strand, r.copies))) for r in t.collect())
    assert key(rows) == key(sites.with_copies(found, 2)) and rows.count()
    spark.sql("DROP TABLE sites_in_buckets")


def table18(spark, n=2000):
    rng = random.Random(3)
    rows = [(f"chr{rng.randrange(7)}", s := rng.randrange(10_000), s + 20, f"k{k}", 1, "+", s, s + 20, "0,0,0", 1, rng.randrange(4), 0, 0, 3, "1/0/0/0", "ACGT", 50.0, 1) for k in range(n)]
    return spark.createDataFrame(rows, files.ONE_COPY)


def test_stored_sites_are_pruned(spark, tmp_path):
    table, path = table18(spark), str(tmp_path / "db")
    stores.write_sites(table, path, 16)
    asked = ["chr3\t100\t900", "chr5\t9000\t0", "$n1mismatches\t1\t3"]
    key = lambda t: sorted((r.rid, r.chrom, r.chromStart, r.name, r.r_end) for r in t.collect())
    got = sitedb.ask(spark, [f":{path}", *asked])
    assert key(got) == key(sitedb.ask(spark, asked, table)) and got.count()
    store = stores.open_sites(spark, path)
    near = store.near([("chr3", 100, 900)])
    read = {r[0] for r in store.rows.where("chrom = 'chr3'").select("_metadata.file_path").distinct().collect()}
    plan = spark._jvm.PythonSQLUtils.explainString(near._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(part" in plan and "LessThan(chromStart,900)" in plan and "GreaterThan(chromEnd,100)" in plan
    assert len(read) < len(store.rows.inputFiles()) and store.table().count() == 2000 and store.near([]).count() == 2000
    many = [("chr1", k, k + 1) for k in range(1500)]
    assert {r[0] for r in store.near(many).select("chrom").distinct().collect()} >= {"chr1"} and key(sitedb.run(store.near(many), sitedb.SiteQuery(regions=many), sizes=store.sizes)) == key(sitedb.run(table, sitedb.SiteQuery(regions=many)))
    with pytest.raises(ValueError):
        stores.write_sites(table.drop("score"), path)
    with pytest.raises(ValueError):
        sitedb.ask(spark, ["chr1\t0\t1"])
    stores.write_sites(table.limit(0), str(tmp_path / "none"))
    assert sitedb.ask(spark, [f":{tmp_path}/none", "chr1\t0\t10"]).isEmpty()


def test_chains_as_bed12(spark):
    items = spark.createDataFrame([("c", 0, 10, "a"), ("c", 12, 15, "b"), ("c", 20, 30, "d")], "chrom string, s long, e long, name string")
    rows = I.chain_bed12(I.chains(items, 1, 5, 2, 3, blocks=True)).collect()
    # A chain begins at every item.
    assert sorted(tuple(r) for r in rows) == [("c", 0, 30, "a:b:d", 0, ".", 0, 30, "0,0,0", 3, "10,3,10", "0,12,20"), ("c", 12, 30, "b:d", 0, ".", 12, 30, "0,0,0", 2, "3,10", "0,8")]
    assert ", ".join(f"{f.name} {t}" for f, t in zip(I.chain_bed12(I.chains(items, 1, 5, 2, 3, blocks=True)).schema, [x.split()[1] for x in files.BED12.split(", ")], strict=True)) == files.BED12


def test_clusters_with_a_dominant_kmer(spark):
    rows = [("c", k, "A" * 4, "+") for k in range(500)] + [("c", k, "ACGT", "+") for k in (0, 4, 9)] + [("c", k, "CCCC", "+") for k in (0, 3, 90)] + [("c", 5, "GGGG", "-"), ("d", 5, "TTTT", "-"), ("c", 1, "TTTT", "-")]
    found = spark.createDataFrame(rows, "chrom string, start0 long, kmer string, strand string")
    assert sorted((r.start0, r.copies, list(r.block_starts)) for r in sites.clusters(found).collect()) == [(0, 3, [0, 4, 9]), (5, 1, [0])]


def test_names_are_numbered_in_order(spark, tmp_path):
    names = [f"chr{k}" for k in range(3000)]
    files.write_names(spark.createDataFrame([(n,) for n in names + names[:5]], "chrom string"), str(tmp_path / "names"))
    assert sorted(tuple(r) for r in files.read_names(spark, str(tmp_path / "names")).collect()) == list(enumerate(sorted(names)))


def test_hits_of_a_file(spark, tmp_path):
    (tmp_path / "hits.tsv").write_text("# what was found\nACGT\tc1\t7\tACGa\t+\t1\nACGT\tc1\t9\tACGT\t-\t0\nTTTT\tc2\t1\tTTaa\t+\t2\n")
    hits = files.read_hits(spark, str(tmp_path / "hits.tsv"))
    assert hits.schema.simpleString() == "struct<pattern:string,chrom:string,location:bigint,seq:string,strand:string,mismatches:bigint>"
    queries = spark.createDataFrame([("ACGT",), ("GGGG",)], "kmer string")
    assert {tuple(r) for r in neighbors.hit_histogram(queries, hits, 1).collect()} == {("ACGT", 1, 1), ("GGGG", 0, 0)}


def test_growing_counts(spark, tmp_path):
    table = CountTable(spark, str(tmp_path / "t"), 4, 1)
    first, second = (spark.createDataFrame([(str(k), s) for k, s in enumerate(x)], "chrom string, seq string") for x in (["ACGTACGTTT", "NNN"], ["AAAAAAA", "GATTACA"]))
    told = lambda t: {r.kmer: r.n for r in t.collect()}
    assert table.last_batch() is None and table.counts().isEmpty()
    table.merge(first, 0)
    table.merge(first, 0)
    before = told(table.counts())
    assert before == told(kmers.strand_counts(first, 4))
    # A batch that fails after its shards are written has changed nothing and may come again.
    (tmp_path / "t/shards/folder=1/prefix=A").mkdir(parents=True)
    spark.createDataFrame([("AAAA", 99)], "kmer string, n long").write.mode("overwrite").parquet(str(tmp_path / "t/shards/folder=1/prefix=A"))
    assert told(table.counts()) == before
    table.merge(second, 1)
    want = told(kmers.strand_counts(first.unionByName(second), 4))
    assert told(table.counts()) == want and table.last_batch() == 1
    old = set(table.shards().values())
    table.vacuum()
    assert told(table.counts()) == want and told(table.counts(["A"])) == {k: n for k, n in want.items() if k[0] == "A"} and old
    table.merge(second.limit(0), 2)
    assert told(table.counts()) == want and table.last_batch() == 2
    with pytest.raises(ValueError):
        CountTable(spark, "x", 4, 5)


def test_site_commands(spark, fastas, tmp_path):
    (path, _), seqs = fastas
    C.bin_sites(spark, path, f"{tmp_path}/bins", 1, "XXXXXNGG")
    C.bed_of_bins(spark, f"{tmp_path}/bins", f"{tmp_path}/all.bed", 2, 3)
    C.bed_of_bins(spark, f"{tmp_path}/bins.[A,C]", f"{tmp_path}/some.bed", 2, 3)
    C.bed_of_each_bin(spark, f"{tmp_path}/bins", f"{tmp_path}/each", 2, 3)
    C.find_sites(spark, path, f"{tmp_path}/found.bed", "XXXXXNGG", max_copies=3)
    want = {k: n for k, n in both_strands(seqs[:4], 5, "NGG").items() if n <= 3}
    got = Counter(x.split("\t")[3].split("/")[1] for x in lines(tmp_path / "found.bed"))
    assert got == want
    twice = sorted(x for x in lines(tmp_path / "found.bed") if int(x.split("\t")[4]) >= 2)
    assert lines(tmp_path / "all.bed") == twice == lines(tmp_path / "each") and {p.name for p in (tmp_path / "each").glob("prefix=*")} == {f"prefix={x.split('/')[1][0]}" for x in twice}
    assert lines(tmp_path / "some.bed") == [x for x in twice if x.split("/")[1][0] in "AC"]
    C.find_sites(spark, path, f"{tmp_path}/clusters.bed", "XXXXXNGG", clusters=True, max_copies=2)
    assert all(len(x.split("\t")) == 12 and int(x.split("\t")[4]) <= 2 for x in lines(tmp_path / "clusters.bed")) and lines(tmp_path / "clusters.bed")


def test_kmer_commands(spark, fastas, tmp_path):
    paths, seqs = fastas
    counts = both_strands(seqs, 6)
    queries = [*sorted(counts)[:6], "acgtac", "NNNNNN"]
    (tmp_path / "list.txt").write_text("".join(f"q{k}\t{x}\n" for k, x in enumerate(queries)))
    distance = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    prof = lambda q, table, m: "/".join(str(sum(n for x, n in table.items() if distance(q.upper(), x) == d)) for d in range(m + 1))
    C.encode_set(spark, f"{tmp_path}/set", 6, paths)
    C.encode_set(spark, f"{tmp_path}/one", 6, paths[0])
    C.encode_counts(spark, f"{tmp_path}/counts", 6, paths, prefix_length=2)
    C.encode_counts(spark, f"{tmp_path}/pam", 6, paths, prefix="A", pam="NGG")
    assert {r.kmer: r.n for r in files.read_kmers(spark, f"{tmp_path}/counts").collect()} == counts
    assert {r.kmer: r.n for r in files.read_kmers(spark, f"{tmp_path}/pam").collect()} == {k: n for k, n in both_strands(seqs, 6, "NGG").items() if k[0] == "A"}
    told = lambda table, m: sorted(f"q{k}\t{x}\t{prof(x, table, m)}" if x != "NNNNNN" else f"q{k}\t{x}" for k, x in enumerate(queries))
    C.count_neighbors(spark, f"{tmp_path}/set", 6, 2, f"{tmp_path}/list.txt", f"{tmp_path}/n.txt", "2")
    assert lines(tmp_path / "n.txt") == told(dict.fromkeys(counts, 1), 2)
    C.count_neighbors(spark, f"{tmp_path}/set", 6, 2, f"{tmp_path}/list.txt", f"{tmp_path}/p1.txt", "2", prefix="A")
    C.count_neighbors(spark, f"{tmp_path}/set", 6, 2, f"{tmp_path}/list.txt", f"{tmp_path}/p2.txt", "2", prefix="C", add_to=f"{tmp_path}/p1.txt")
    assert lines(tmp_path / "p2.txt") == told({k: 1 for k in counts if k[0] in "AC"}, 2)
    C.count_off_sites(spark, f"{tmp_path}/counts", 6, 1, f"{tmp_path}/list.txt", f"{tmp_path}/o.txt", "2")
    assert lines(tmp_path / "o.txt") == told(counts, 1)
    C.count_off_sites(spark, f"{tmp_path}/counts.[AA,AC,CA]", 6, 1, f"{tmp_path}/list.txt", f"{tmp_path}/s.txt", "2")
    assert lines(tmp_path / "s.txt") == told({k: n for k, n in counts.items() if k[:2] in ("AA", "AC", "CA")}, 1)
    C.count_off_sites(spark, f"{tmp_path}/counts", 6, 1, f"{tmp_path}/list.txt", f"{tmp_path}/b.txt", "2", bounds="3/-1/20")
    within = [x for x in told(counts, 1) if x.count("\t") == 2 and int(x.split("\t")[2].split("/")[0]) <= 3 and sum(map(int, x.split("\t")[2].split("/"))) <= 20]
    assert lines(tmp_path / "b.txt") == within
    C.count_off_sites(spark, f"{tmp_path}/counts", 6, 1, f"{tmp_path}/list.txt", f"{tmp_path}/l.txt", "2", listing=True)
    assert any(x.startswith(f"q0\t{queries[0]}\t") and f"\t{queries[0]}:{counts[queries[0]]}" in x for x in lines(tmp_path / "l.txt"))
    C.list_absent(spark, f"{tmp_path}/set", 6, f"{tmp_path}/absent", limit=5)
    C.list_absent(spark, f"{tmp_path}/set", 6, f"{tmp_path}/drawn", sample=5, seed=2, motif="XXXXRY")
    assert len(lines(tmp_path / "absent")) == 5 == len(lines(tmp_path / "drawn")) and not {*lines(tmp_path / "absent"), *lines(tmp_path / "drawn")} & set(counts)
    C.compare_sets(spark, f"{tmp_path}/set", f"{tmp_path}/one", 6, f"{tmp_path}/cmp")
    assert lines(tmp_path / "cmp") == sorted(f"{x}\t1\t0" for x in set(counts) - set(both_strands(seqs[:4], 6)))


def test_query_command(spark, tmp_path):
    table, path = table18(spark, 300), f"{tmp_path}/db"
    stores.write_sites(table, path)
    (tmp_path / "regions").write_text("# mine\nchr1\t0\t5000\n")
    (tmp_path / "filters").write_text("$n1mismatches\t0\t1\n")
    head = C.query_sites(spark, f"{tmp_path}/out", "chr2/0/3000", db=path, regions=f"{tmp_path}/regions", filters=f"{tmp_path}/filters", header=True, print_comments=True)
    want = table.where("n1mismatches <= 1 AND (chrom = 'chr1' AND chromStart < 5000 OR chrom = 'chr2' AND chromStart < 3000)")
    assert len(lines(tmp_path / "out")) == want.count() > 0 and head[0] == "# mine" and head[-1].startswith("#chrom\tchromStart")
    assert {x.split("\t")[3] for x in lines(tmp_path / "out")} == {r.name for r in want.collect()}
    C.query_sites(spark, f"{tmp_path}/best", f":{path}", "!BEST\t2", "!MIN\tn1mismatches", range_in_name=True)
    assert len(lines(tmp_path / "best")) == 14 and all("/k" in x.split("\t")[3] for x in lines(tmp_path / "best"))
    with pytest.raises(ValueError):
        C.query_sites(spark, f"{tmp_path}/x", "chr1/0/1")


def test_classes_are_found_when_the_join_runs(spark):
    a = spark.createDataFrame([("c", 0, 5), ("c", 100, 90_000), ("d", 3, 3)], "chrom string, s long, e long")
    b = spark.createDataFrame([("c", 4, 8), ("c", 50_000, 50_001), ("d", 3, 9), ("d", 4, 9)], "chrom string, s long, e long")
    got = I.overlap_join(a, b).select("s", "s_b").collect()
    assert sorted(map(tuple, got)) == [(0, 4), (3, 3), (100, 50_000)] and I.overlap_join(a.limit(0), b).isEmpty()


def test_buckets_grow_with_the_sequences(spark, tmp_path, monkeypatch):
    """More letters make more buckets, not larger ones; short sequences keep the 16 of the query."""
    made = []
    write = stores.write_bucketed
    monkeypatch.setattr(stores, "write_bucketed", lambda found, table, path, buckets=64: made.append(buckets) or write(found, table, path, buckets))
    text = "".join(random.Random(3).choices("abcd", k=3000))
    spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    few = sorted(map(tuple, Q.QUERIES["bucketed_copies"](spark, str(tmp_path)).collect()))
    monkeypatch.setattr(stores, "LETTERS", 200)
    assert sorted(map(tuple, Q.QUERIES["bucketed_copies"](spark, str(tmp_path)).collect())) == few and len(few) > 100
    assert made == [16, 30]
