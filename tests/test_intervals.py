import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import annotate, filters, intervals, sitedb, sites


@pytest.fixture(scope="module")
def beds():
    rng = random.Random(2)
    make = lambda n: [(f"c{rng.randint(1, 2)}", s := rng.randint(0, 900), s + rng.randint(0, 300), f"i{k}") for k in range(n)]
    return make(60), make(60)


def test_overlap(spark, beds):
    schema = "chrom string, s long, e long, name string"
    a, b = (spark.createDataFrame(x, schema) for x in beds)
    end = sorted((x[3], y[3]) for x in beds[0] for y in beds[1] if x[0] == y[0] and (x[1] <= y[1] <= x[2] or x[1] <= y[2] <= x[2]))
    half = sorted((x[3], y[3]) for x in beds[0] for y in beds[1] if x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2])
    for size in (7, 128):
        assert sorted((r.name, r.name_b) for r in intervals.overlap_join(a, b, size=size).collect()) == end
        assert sorted((r.name, r.name_b) for r in intervals.overlap_join(a, b, "overlap", size).collect()) == half


def test_containment(spark):
    a, b = (spark.createDataFrame([x], "chrom string, s long, e long") for x in (("c", 10, 20), ("c", 0, 100)))
    assert intervals.overlap_join(a, b).isEmpty() and intervals.overlap_join(a, b, "overlap").count() == 1


def test_chains_are_maximal_and_inclusive(spark):
    rows = spark.createDataFrame([("c", s, s + 5, n) for s, n in ((0, "a"), (10, "b"), (25, "c"), (41, "d"))], "chrom string, s long, e long, name string")
    got = {r.name for r in intervals.chains(rows, 5, 10, 2, 3).collect()}
    assert got == {"a:b:c", "b:c"}
    assert {r.name for r in intervals.chains(rows, 5, 11, 2, 3).collect()} == {"a:b:c", "b:c:d", "c:d"}
    assert intervals.chains(rows.limit(0), 5, 10, 2, 3).isEmpty()


def test_islands_and_blocks(spark):
    p = spark.createDataFrame([("c", s) for s in (1, 2, 2, 3, 7, 9, 10)] + [("d", 4)], "chrom string, s long")
    assert sorted(tuple(r) for r in intervals.islands(p).collect()) == [("c", 1, 3, 3), ("c", 7, 7, 1), ("c", 9, 10, 2), ("d", 4, 4, 1)]
    b = spark.createDataFrame([([5], [0]), ([5, 5], [0, 5]), ([5, 5], [0, 4]), ([], [])], "block_sizes array<int>, block_starts array<int>")
    legal, illegal = intervals.split_legal(b)
    assert legal.count() == 3 and illegal.count() == 1


def test_same_item_chain(spark):
    rows = [("x", "1", 0, 20, 4), ("x", "1", 10, 30, 4), ("x", "1", 50, 70, 4), ("x", "2", 5, 25, 4), ("y", "1", 0, 20, 1), ("z", "3", 0, 20, 3), ("z", "3", 900, 920, 3), ("z", "3", 890, 910, 3)]
    items = spark.createDataFrame(rows, "name string, chrom string, start0 long, end1 long, copies long")
    got = {(r.name.split("/")[0], r.chrom): (r.name, r.block_count, r.block_starts) for r in sites.same_item_chains(items, 100, 0.5).collect()}
    assert got == {("x", "1"): ("x/k=2/s=70/f=0.5", 2, "0,50"), ("y", "1"): ("y/k=1/s=20/f=1.0", 1, "0")}
    every = {(r.name, r.chrom): r for r in sites.same_item_chains(items, 0).collect()}
    assert set(every) == {("x/k=2/s=70/f=0.5", "1"), ("x/k=1/s=20/f=0.25", "2"), ("y/k=1/s=20/f=1.0", "1"), ("z/k=2/s=920/f=0.6666666666666666", "3")}
    z = every[("z/k=2/s=920/f=0.6666666666666666", "3")]
    assert len(z) == 12 and (z.block_starts, z.block_sizes, z.thick_end, z.strand) == ("0,890", "20,20", 920, "+")
    assert [r.name for r in sites.same_item_chains(items, 0, 1.0).collect()] == ["y/k=1/s=20/f=1.0"]


def test_chains_with_strands(spark):
    rows = spark.createDataFrame([("c", 0, 50, "a", "+"), ("c", 45, 48, "b", "-"), ("d", 0, 9, "a", "+")], "chrom string, s long, e long, name string, strand string")
    got = [(r.s, r.e, r.n, r.name) for r in intervals.chains(rows, -10, 5, 2, 3, overlap=True).collect()]
    assert got == [(0, 48, 2, "a/+:b/-")]


def test_intervals_of_all_lengths(spark):
    """Classes of length: one interval of millions of places among short ones, on either side."""
    rng = random.Random(2)
    side = lambda n: [("c", s, s + rng.choice((0, 1, 5, 127, 128, 129, 5000, 3_000_000)), str(k)) for k, s in enumerate(rng.randint(0, 4_000_000) for _ in range(n))]
    a, b = side(60), side(60)
    fa, fb = (spark.createDataFrame(x, "chrom string, s long, e long, name string") for x in (a, b))
    point = sorted((x[3], y[3]) for x in a for y in b if x[1] <= y[1] <= x[2] or x[1] <= y[2] <= x[2])
    assert sorted((r.name, r.name_b) for r in intervals.overlap_join(fa, fb).collect()) == point
    half = sorted((x[3], y[3]) for x in a for y in b if x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2])
    assert sorted((r.name, r.name_b) for r in intervals.overlap_join(fa, fb, mode="overlap").collect()) == half


@pytest.mark.parametrize("size", [1, 3, 1 << 16])
def test_islands_across_ranges(spark, size):
    places = [0, 1, 2, 3, 4, 5, 6, 7, 9, 12, 14, 15, 17, 18, 19, 20, 26, 29, 30]
    got = sorted((r.start0, r.end0, r.n) for r in intervals.islands(spark.createDataFrame([("c", s) for s in places], "chrom string, s long"), size).collect())
    assert got == [(0, 7, 8), (9, 9, 1), (12, 12, 1), (14, 15, 2), (17, 20, 4), (26, 26, 1), (29, 30, 2)]


@pytest.fixture(scope="module")
def db(spark):
    rows = [("c1", 10 * k, f"{k}.1/ACGTACGTACGTACGTACGT", 1, f"1/{k % 3}/2/3") for k in range(10)] + [("c2", 5, "9.1/TTTTACGTACGTACGTACGT", 2, "2/0/0/0")]
    bed = spark.createDataFrame(rows, "chrom string, start0 long, name string, copies long, off_site_counts string").withColumns({"end1": F.col("start0") + 20, "strand": F.lit("+")})
    return annotate.one_copy_table(bed)


def test_annotated(db):
    row = db.where("chrom = 'c2'").first()
    assert len(db.columns) == 18 and (row.percentGC, row.longestTandemT, row.totalOffSites, row.thickEnd) == (40.0, 4, 0, 25)


def test_site_queries(spark, db):
    q = sitedb.parse(["# note", "c1\t15\t45", "c2\t0\t0", "$n1mismatches\t0\t1", "!BEST\t2", "!MAX\t11", "!MIN\tchromStart"])
    got = [(r.rid, r.chromStart, r["rank"]) for r in sitedb.run(db, q).orderBy("rid", "rank").collect()]
    assert q.comments == ["# note"] and got == [(0, 10, 1), (0, 40, 2), (1, 5, 1)]
    assert sitedb.run(db, sitedb.parse(["c1/0/5"]), range_in_name=True).first().name.startswith("c1:0-5/0.1/")
    assert sitedb.run(db, sitedb.parse([]), max_items=3).count() == 4
    assert sitedb.run(db, sitedb.parse(["c2/0/0"]), range_in_name=True).first().name.startswith("c2:0-25/9.1/")
    sizes = spark.createDataFrame([("c1", 5000), ("c2", 700)], "chrom string, size long")
    assert sitedb.run(db, sitedb.parse(["c2/0/0"]), range_in_name=True, sizes=sizes).first().name.startswith("c2:0-700/9.1/")
    assert sitedb.parse([":other.bb", "!BEST/7"]).table == "other.bb"
    assert sitedb.header(db, q, True, True)[:2] == ["# note", "#range=c1:15-45"] and sitedb.header(db, q, True)[0].startswith("#chrom\tchromStart")
    regions = sitedb.regions_frame(spark, [("c1", 15, 45), ("c1", 0, 0)])
    assert sitedb.in_regions(db, regions).count() == 15
    with pytest.raises(ValueError):
        sitedb.run(db, sitedb.parse(["$nothing\t0\t1"]))
    assert sitedb.run(db, sitedb.parse(["$nothing\t0\t1"]), ignore_missing=True).count() == 11
    with pytest.raises(ValueError):
        sitedb.parse(["!WORST\t1"])


def test_filters(spark):
    rows = spark.createDataFrame([("GAAGCAGGAG", 1), ("GAAGCAGGA", 4), ("GAAGCATTT", 6), ("", 2)], "kmer string, n long")
    assert sorted(r.kmer for r in rows.where(filters.triplets_only(F.col("kmer"))).collect()) == ["", "GAAGCAGGA"]
    assert sorted(r.n for r in rows.where(filters.copies_match(F.col("n"), ">1&&<=4")).collect()) == [2, 4]
    with pytest.raises(ValueError):
        filters.copies_match(F.col("n"), "__import__('os')")
    g = spark.createDataFrame([("ACGTACGTAC", 1), ("ACgTACGTAC", 1), ("TTTTTCGCGC", 1), ("ACGTACGTAC", 9), ("AAAAAAAAAC", 1)], "kmer string, n long")
    assert g.where(filters.guide_quality(F.col("kmer"), F.col("n"), max_copies=5)).count() == 1
    assert g.where(filters.guide_quality(F.col("kmer"), F.col("n"), max_copies=9)).count() == 2
    assert g.where(filters.guide_quality(F.col("kmer"), F.col("n"), max_copies=9, allow_lowercase=True)).count() == 3
    assert g.where(filters.guide_quality(F.col("kmer"), F.col("n"), max_t=9, max_tandem_t=4)).count() == 2


def test_islands_are_made_in_tasks_of_bounded_size(spark, monkeypatch):
    """More rows are dealt out to more tasks, whatever the session's number of partitions."""
    parts = []
    kept = intervals.written
    monkeypatch.setattr(intervals, "written", lambda df, name: parts.append(df) or kept(df, name))
    places = spark.range(4000).select(F.concat(F.lit("c"), F.col("id") % 40).alias("chrom"), (F.col("id") * 3 % 997).alias("s"))
    got = sorted((r.chrom, r.start0, r.end0, r.n) for r in intervals.islands(places, 64, 100).collect())
    sizes = [r["count"] for r in parts[0].groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 30 and max(sizes) < 500
    want = []
    for chrom, s in sorted({(r.chrom, r.s) for r in places.collect()}):
        if want and want[-1][0] == chrom and want[-1][2] == s - 1:
            want[-1] = (chrom, want[-1][1], s, want[-1][3] + 1)
        else:
            want.append((chrom, s, s, 1))
    assert got == want


def test_same_item_chains_deal_rows_out_once(spark, capsys):
    """Bounds and runs come from one order of the rows; equal rows count once and codes are spelled at the end."""
    rows = [(0b0001, "1", 0, 3, 4), (0b0001, "1", 0, 3, 4), (0b0001, "1", 2, 5, 4), (0b0001, "1", 9, 12, 4), (0b0001, "2", 0, 3, 4), (0b1110, "1", 4, 7, 2), (0b1110, "1", 900, 903, 2)]
    items = spark.createDataFrame(rows, "name long, chrom string, start0 long, end1 long, copies long")
    got = sites.same_item_chains(items, 100, 0.5, coded=2)
    got.explain()
    assert capsys.readouterr().out.count("Exchange") == 1
    assert [(r.name, r.chrom, r.block_starts) for r in got.collect()] == [("AC/k=2/s=12/f=0.5", "1", "0,9")]
