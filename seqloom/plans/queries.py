"""One query for each operator on the driver's tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators import absence, annotate, filters, groups, intervals, kmers, neighbors, pages, scan, shards, sitedb, sites
from seqloom.plans import views as V
from seqloom.sources import files, shared, stores
from seqloom.streaming.counts import CountTable

NGG, NGG_RE = "X" * 20 + "NGG", "[ACGT]{21}GG"
K = 8
KEY_SQL = "list_sum(list_transform(range(0, length({0})), lambda i: (instr('ACTG', substr({0}, i::int + 1, 1)) - 1)::bigint << (3 * i)::int))::bigint + (7::bigint << (3 * length({0}))::int)"
CODE_SQL = "list_sum(list_transform(range(0, length({0})), lambda i: (instr('ACGT', substr({0}, i::int + 1, 1)) - 1)::bigint << (2 * (length({0}) - 1 - i))::int))::bigint"
COPIES = "counted AS (SELECT *, count(*) OVER (PARTITION BY kmer) AS copies FROM sites)"
_key, _code = KEY_SQL.format, CODE_SQL.format

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


NGG_SQL = f"WITH {V.GENOME_SQL}, {V.sites_sql(NGG, NGG_RE)}"
COUNTED_SQL = f"{NGG_SQL}, {COPIES}"
ALL_SQL = f"WITH {V.GENOME_SQL}, {V.ITEMS_SQL}, {V.sites_sql('X' * K, '[ACGT]{8}')}, {V.sites_sql('X' * K, '[ACGT]{8}', 'items', 'others')}"


def _ngg(spark: SparkSession, d: str) -> DataFrame:
    return sites.sites(V.genome(spark, d), NGG)


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """The same, written once for queries that use them several times."""
    return sites.site_table(_ngg(spark, d))


def _kmers(spark: SparkSession, d: str, pam: str = "", prefix: str = "") -> DataFrame:
    return kmers.kmers(V.genome(spark, d), K, pam, prefix)


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return kmers.strand_counts(V.genome(spark, d), K)


def _others(spark: SparkSession, d: str) -> DataFrame:
    return kmers.strand_counts(V.benchmark_genome(spark, d), K)


def _coded(spark: SparkSession, d: str) -> DataFrame:
    """(chrom, start0, strand, code) of the same sites."""
    return sites.coded_sites(V.genome(spark, d), NGG)


def _coded_counts(spark: SparkSession, d: str) -> DataFrame:
    """(code, n) of their k-mers."""
    return sites.site_counts(V.genome(spark, d), NGG)


# --- sites ------------------------------------------------------------------------------------

@_query(f"{COUNTED_SQL} SELECT chrom, start0, start0 + 20 AS end1, kmer, copies, strand FROM counted")
def site_copies(spark, d):
    return sites.with_copies(_stored(spark, d)).select("chrom", "start0", "end1", "kmer", "copies", "strand")


@_query(f"{COUNTED_SQL} SELECT chrom, start0, kmer, copies, strand FROM counted WHERE copies BETWEEN 1 AND 3")
def bucketed_copies(spark, d):
    """Sites stored in buckets by k-mer, read again and counted without an exchange."""
    path = shared.fresh_path(spark, "bucketed")
    name = "sites_" + path.rpartition("-")[2]
    stores.write_bucketed(_ngg(spark, d), name, path, stores.buckets_for(V.letters(spark, d)))
    return stores.bucketed_copies(spark, name, 1, 3).select("chrom", "start0", "kmer", "copies", "strand")


@_query(f"{COUNTED_SQL} SELECT chrom, start0, kmer, copies, strand FROM counted WHERE copies BETWEEN 2 AND 5")
def site_copy_range(spark, d):
    return sites.with_copies(_stored(spark, d), 2, 5).select("chrom", "start0", "kmer", "copies", "strand")


@_query(f"{NGG_SQL} SELECT chrom, start0, kmer, strand FROM sites WHERE kmer LIKE 'AC%'")
def site_prefix(spark, d):
    return sites.sites(V.genome(spark, d), NGG, prefix="AC").select("chrom", "start0", "kmer", "strand")


@_query(f"WITH {V.MASKED_SQL}, {V.sites_sql('XXX', '[ACGT]{3}')} SELECT chrom, start0, kmer, strand FROM sites")
def site_softmask(spark, d):
    return sites.sites(V.genome(spark, d, masked=True), "XXX", upper=False).select("chrom", "start0", "kmer", "strand")


@_query(f"WITH {V.GENOME_SQL}, {V.sites_sql('XXXXXXXXNRYWB', '[ACGT]{9}[AG][CT][AT][CGT]')} SELECT kmer, strand, count(*) AS n FROM sites GROUP BY kmer, strand")
def site_iupac_motif(spark, d):
    return sites.sites(V.genome(spark, d), "XXXXXXXXNRYWB").groupBy("kmer", "strand").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {V.GENOME_SQL}, {V.sites_sql('X' * 12 + 'NRG', '[ACGT]{12}..G')} SELECT chrom, start0, kmer, strand FROM sites")
def site_lenient_motif(spark, d):
    return sites.sites(V.genome(spark, d), "X" * 12 + "NRG", lenient=True).select("chrom", "start0", "kmer", "strand")


@_query(f"{COUNTED_SQL} SELECT chrom, start0, start0 + 20 AS end1, ({_key('kmer')}) || '.' || copies || '/' || kmer AS name, copies, strand FROM counted")
def bed6_names(spark, d):
    return sites.to_bed6(sites.with_copies(_stored(spark, d)))


@_query(f"""{NGG_SQL},
g AS (SELECT *, start0 - lag(start0) OVER (PARTITION BY kmer, chrom ORDER BY start0) AS gap FROM sites),
c AS (SELECT kmer, min(chrom) AS chrom, min(start0) AS lo, max(start0) AS hi, count(*) AS copies, min(strand) AS s1, max(strand) AS s2, string_agg(start0, ',' ORDER BY start0) AS starts
  FROM g GROUP BY kmer HAVING count(DISTINCT chrom) = 1 AND coalesce(min(gap), 20) >= 20)
SELECT chrom, lo AS start0, hi + 20 AS end1, ({_key('kmer')}) || '.' || copies || '/' || kmer || '/k=' || copies || '/s=' || (hi + 20 - lo) AS name, copies,
       CASE WHEN s1 = s2 THEN s1 ELSE '.' END AS strand, starts FROM c""")
def site_clusters(spark, d):
    rows = sites.clusters(sites.site_table(_coded(spark, d)), coded=20)
    starts = F.array_join(F.transform("block_starts", lambda x: (x + F.col("start0")).cast("string")), ",")
    return rows.select("chrom", "start0", "end1", "name", "copies", "strand", starts.alias("starts"))


@_query(f"{COUNTED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY kmer ORDER BY chrom, start0, strand) AS rn FROM counted) SELECT kmer, copies, chrom, start0, strand FROM r WHERE rn = 1 AND copies <= 3")
def dedup_max_freq(spark, d):
    return sites.first_of_each(_ngg(spark, d), 3)


@_query(f"{NGG_SQL} SELECT chrom, count(*) AS n, min(start0) AS lo, max(start0) AS hi FROM sites WHERE strand = '+' GROUP BY chrom")
def partition_chrom_forward(spark, d):
    rows = sites.sites(V.genome(spark, d), NGG, forward_only=True)
    return rows.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.min("start0").alias("lo"), F.max("start0").alias("hi"))


@_query(f"""{COUNTED_SQL},
i AS (SELECT DISTINCT kmer AS name, chrom, start0 AS s, copies FROM counted WHERE copies > 1),
h AS (SELECT name, chrom, any_value(copies) AS score, list(s ORDER BY s) AS ss FROM i GROUP BY name, chrom),
f AS (SELECT name, chrom, score, ss, list_reduce(list_transform(ss, lambda x: [x]), lambda a, x: CASE WHEN x[1] < a[len(a)] + 20 THEN a ELSE list_concat(a, x) END) AS b FROM h),
c AS (SELECT *, ss[1] AS lo, ss[len(ss)] + 20 AS hi, len(b) / score AS fraction FROM f)
SELECT chrom, lo AS start0, hi AS end1, name || '/k=' || len(b) || '/s=' || (hi - lo) || '/f=' || fraction AS name, score AS copies, '+' AS strand, lo AS thick_start, hi AS thick_end, '0,0,0' AS rgb, len(b)::bigint AS block_count,
       list_aggregate(list_transform(b, lambda x: 20), 'string_agg', ',') AS block_sizes, list_aggregate(list_transform(b, lambda x: x - lo), 'string_agg', ',') AS block_starts
FROM c WHERE hi - lo <= 5000 AND fraction >= 0.5""")
def same_chrom_chain(spark, d):
    rows = sites.with_copies(sites.site_table(_coded(spark, d)), 2, key="code").select("chrom", "start0", (F.col("start0") + 20).alias("end1"), F.col("code").alias("name"), "copies")
    return sites.same_item_chains(rows, 5000, 0.5, coded=20)


@_query(f"{COUNTED_SQL}, c AS (SELECT DISTINCT kmer, copies FROM counted) SELECT sum(copies)::bigint AS n_sites, count(*) AS n_kmers, count(*) FILTER (copies BETWEEN 2 AND 5) AS n_kept, (sum(copies) FILTER (copies BETWEEN 2 AND 5))::bigint AS n_kept_sites FROM c")
def run_totals(spark, d):
    return sites.totals(_ngg(spark, d), 2, 5)


@_query(f"{NGG_SQL}, k AS (SELECT *, {_key('kmer')} AS key FROM sites), o AS (SELECT *, row_number() OVER (ORDER BY key DESC, chrom, start0, strand) AS n FROM k) SELECT chrom, start0, strand, key FROM o WHERE n <= 500")
def sites_by_key(spark, d):
    return sites.by_key(_ngg(spark, d)).select("chrom", "start0", "strand", "key").limit(500)


# --- files --------------------------------------------------------------------------------------

@_query(f"WITH {V.GENOME_SQL} SELECT chrom, length(seq) AS n, md5(seq) AS seq_md5 FROM genome WHERE seq <> ''")
def fasta_scan(spark, d):
    """Sequences written as a FASTA file and read again."""
    path = shared.fresh_path(spark, "fasta")
    files.write_fasta(V.genome(spark, d), path)
    return files.read_fasta(spark, path).select("chrom", F.length("seq").cast("long").alias("n"), F.md5("seq").alias("seq_md5"))


@_query(f"{NGG_SQL} SELECT chrom, start0, kmer, strand FROM sites")
def fasta_chunk_sites(spark, d):
    """Sites of a FASTA file read line by line, in chunks far shorter than its records."""
    path = shared.fresh_path(spark, "fasta")
    files.write_fasta(V.genome(spark, d), path)
    return sites.sites(files.read_fasta_chunks(spark, path, len(NGG), 1000), NGG).select("chrom", "start0", "kmer", "strand")


QUERY_LIST_SQL = "q AS (SELECT item_id || chr(9) || 'id.' || item_id || '/' || substr(regexp_replace(translate(text, '{}', '{}'), '[^ACGTN]', '', 'g'), 1, 20) || '/x' AS line FROM benchmark)".format(V.SOURCE, V.TARGET)


def _query_list(spark, d) -> DataFrame:
    """A list of queries as a file, the k-mer being the second part of the second column's name."""
    path = shared.fresh_path(spark, "queries")
    items = V.benchmark_genome(spark, d)
    number = F.substring("chrom", 5, 20)
    items.select(F.concat(number, F.lit("\tid."), number, F.lit("/"), F.substring("seq", 1, 20), F.lit("/x")).alias("value")).write.text(path)
    return files.read_queries(spark, path, "2,/,2")


@_query(f"WITH {QUERY_LIST_SQL}, k AS (SELECT line, string_split(line, '/')[2] AS kmer FROM q) SELECT line, CASE WHEN regexp_full_match(kmer, '[ACGT]+') THEN kmer END AS kmer FROM k")
def query_list(spark, d):
    return _query_list(spark, d)


@_query(f"""{NGG_SQL}, {QUERY_LIST_SQL}, k AS (SELECT line, string_split(line, '/')[2] AS kmer FROM q), c AS (SELECT kmer, count(*) AS n FROM sites GROUP BY kmer),
h AS (SELECT k.line, k.kmer, {', '.join(f'coalesce(sum(c.n) FILTER (hamming(k.kmer, c.kmer) = {i}), 0)::bigint AS n{i}' for i in range(3))} FROM k LEFT JOIN c ON length(k.kmer) = 20 AND regexp_full_match(k.kmer, '[ACGT]+') AND hamming(k.kmer, c.kmer) <= 2 GROUP BY k.line, k.kmer)
SELECT line || CASE WHEN length(kmer) = 20 AND regexp_full_match(kmer, '[ACGT]+') THEN chr(9) || n0 || '/' || n1 || '/' || n2 ELSE '' END AS value FROM h""")
def profile_append(spark, d):
    """The lines of a list of queries with their profiles behind them, written and read again."""
    path = shared.fresh_path(spark, "profiles")
    counts = shared.written(kmers.kmer_counts(_ngg(spark, d)), "counts")
    profiled = neighbors.profile(_query_list(spark, d), counts, 2, k=20)
    known = F.length("kmer") == 20
    files.write_profiles(profiled.withColumn("off_site_counts", F.when(known, F.col("off_site_counts"))), path)
    shared.remove_table(counts)
    return spark.read.text(path)


@_query(f"{NGG_SQL} SELECT chrom, start0, kmer, strand FROM sites WHERE strand = '+'")
def partition_by_chrom(spark, d):
    """Forward sites written to folders by chromosome and read again."""
    path = shared.fresh_path(spark, "by-chrom")
    sites.partitioned_by_chrom(sites.sites(V.genome(spark, d), NGG, forward_only=True), path)
    return spark.read.parquet(path).select("chrom", "start0", "kmer", "strand")


@_query(f"WITH {V.GENOME_SQL} SELECT (row_number() OVER (ORDER BY chrom) - 1)::int AS chrom_id, chrom, length(seq) AS n FROM genome")
def name_table(spark, d):
    """Names written as a table and joined back to their numbers."""
    genome, path = V.genome(spark, d), shared.fresh_path(spark, "names")
    files.write_names(genome, path)
    names = files.read_names(spark, path)
    numbered = genome.join(names.withColumnRenamed("chrom", "name"), F.col("chrom") == F.col("name")).select("chrom_id", F.length("seq").cast("long").alias("n"))
    return files.with_names(numbered, names).select("chrom_id", "chrom", "n")


@_query(f"WITH {V.GENOME_SQL}, {V.sites_sql('X' * K + 'NGG', '[ACGT]{9}GG')} SELECT kmer, count(*) AS n FROM sites WHERE substr(kmer, 1, 2) IN ('AC', 'GT', 'TT') GROUP BY kmer")
def shard_counts(spark, d):
    """A count table written in shards, of which three are read."""
    path = shared.fresh_path(spark, "shards")
    files.write_kmers(kmers.kmer_counts(_kmers(spark, d, "NGG")).select("kmer", "n"), path)
    return files.read_kmers(spark, path + ".[AC,GT,TT]").select("kmer", "n")


@_query(f"WITH {V.GENOME_SQL} SELECT chrom, length(seq) AS n, md5(translate(reverse(seq), 'ACGT', 'TGCA')) AS revcomp_md5, md5(regexp_replace(seq, '[^ACGT]', 'N', 'g')) AS norm_md5 FROM genome")
def revcomp_norm(spark, d):
    return V.genome(spark, d).select("chrom", F.length("seq").cast("long").alias("n"), F.md5(S.revcomp(F.col("seq"))).alias("revcomp_md5"), F.md5(S.normalise(F.col("seq"))).alias("norm_md5"))


@_query(f"{NGG_SQL}, k AS (SELECT DISTINCT kmer FROM sites) SELECT kmer, {_key('kmer')} AS key, {_code('kmer')} AS code, kmer AS of_key, kmer AS of_code FROM k")
def kmer_encodings(spark, d):
    rows = _coded_counts(spark, d).select(S.spelled(F.col("code"), 20).alias("kmer")).withColumns({"key": S.kmer_key(F.col("kmer")), "code": S.kmer_code(F.col("kmer"))})
    return rows.select("kmer", "key", "code", S.kmer_of_key(F.col("key")).alias("of_key"), S.kmer_of_code(F.col("code"), 20).alias("of_code"))


# --- k-mers -----------------------------------------------------------------------------------

@_query(f"{ALL_SQL} SELECT DISTINCT kmer, {_code('kmer')} AS code FROM sites")
def kmer_set(spark, d):
    return kmers.kmer_set(_counts(spark, d))


@_query(f"{ALL_SQL} SELECT kmer, count(*) AS n, {_code('kmer')} AS code FROM sites GROUP BY kmer")
def kmer_counts(spark, d):
    return _counts(spark, d)


@_query(f"WITH {V.GENOME_SQL}, {V.sites_sql('X' * K + 'NGG', '[ACGT]{9}GG')} SELECT kmer, count(*) AS n FROM sites WHERE kmer LIKE 'CA%' GROUP BY kmer")
def kmer_counts_prefix(spark, d):
    return kmers.kmer_counts(_kmers(spark, d, "NGG", "CA")).select("kmer", "n")


@_query(f"{ALL_SQL} SELECT kmer FROM sites UNION SELECT kmer FROM others")
def kmer_union(spark, d):
    return kmers.union(_counts(spark, d), _others(spark, d))


@_query(f"{ALL_SQL} SELECT kmer FROM sites INTERSECT SELECT kmer FROM others")
def kmer_intersect(spark, d):
    return kmers.intersection(_counts(spark, d), _others(spark, d))


@_query(f"{ALL_SQL} SELECT kmer FROM sites EXCEPT SELECT kmer FROM others")
def kmer_except(spark, d):
    return kmers.difference(_counts(spark, d), _others(spark, d))


@_query(f"{ALL_SQL} SELECT kmer, max(l) AS in_left, max(r) AS in_right FROM (SELECT kmer, 1 AS l, 0 AS r FROM sites UNION ALL SELECT kmer, 0, 1 FROM others) GROUP BY kmer HAVING max(l) <> max(r)")
def kmer_symdiff(spark, d):
    return kmers.symmetric_difference(_counts(spark, d), _others(spark, d))


@_query(f"{ALL_SQL} SELECT kmer, count(*) AS n FROM sites GROUP BY kmer")
def kmer_counts_in_batches(spark, d):
    """A stored table of counts that grows by a stream of files, in three batches; the last batch comes twice and counts once."""
    path = shared.fresh_path(spark, "arrivals")
    genome = V.genome(spark, d)
    genome.write.parquet(f"{path}/in")  # a file for each part of the input, however large it is
    files_ = spark.read.parquet(f"{path}/in").select("_metadata.file_path").distinct().count()
    table = CountTable(spark, f"{path}/table", K)
    arriving = spark.readStream.schema("chrom string, seq string").option("maxFilesPerTrigger", max(1, -(-files_ // 3))).parquet(f"{path}/in")
    table.follow(arriving).awaitTermination()
    table.merge(spark.read.parquet(f"{path}/in"), table.last_batch())
    table.vacuum()
    return table.counts()


SPACE_SQL = f"""space AS (SELECT c AS code, list_aggregate(list_transform(range(0, {K}), lambda i: substr('ACGT', ((c >> (2 * ({K - 1} - i))::int) & 3)::int + 1, 1)), 'string_agg', '') AS kmer
  FROM (SELECT unnest(range(0, {4**K})) AS c)), absent AS (SELECT * FROM space WHERE kmer NOT IN (SELECT kmer FROM sites))"""


@_query(f"{ALL_SQL}, {SPACE_SQL} SELECT code, kmer FROM absent")
def absent_kmers(spark, d):
    return kmers.absent(spark, _counts(spark, d), K)


@_query(f"{ALL_SQL} SELECT ({4**K} - count(DISTINCT kmer))::bigint AS n_absent FROM sites")
def absent_count(spark, d):
    return kmers.absent_count(_counts(spark, d), K)


@_query(f"{ALL_SQL}, {SPACE_SQL} SELECT code, kmer FROM absent WHERE regexp_full_match(kmer, '[ACGT]{{6}}[AG][CT]') ORDER BY code LIMIT 100")
def absent_motif_limited(spark, d):
    return kmers.absent(spark, _counts(spark, d), K, motif="XXXXXXRY", limit=100)


@_query(f"{ALL_SQL}, {SPACE_SQL} SELECT code, kmer FROM absent ORDER BY md5('7:' || kmer), kmer LIMIT 50")
def absent_sample(spark, d):
    return kmers.sample(kmers.absent(spark, _counts(spark, d), K), 50, seed=7)


@_query(f"""{ALL_SQL}, {SPACE_SQL}, c AS (SELECT kmer, count(*) AS n FROM sites GROUP BY kmer),
v AS (SELECT a.kmer, substr(a.kmer, 1, i::int) || b || substr(a.kmer, i::int + 2) AS v FROM absent AS a, (SELECT unnest(range(0, {K})) AS i), (SELECT unnest(['A', 'C', 'G', 'T']) AS b) WHERE substr(a.kmer, i::int + 1, 1) <> b)
SELECT a.kmer, 0::bigint AS n0, coalesce(sum(c.n), 0)::bigint AS n1 FROM absent AS a JOIN v ON a.kmer = v.kmer LEFT JOIN c ON c.kmer = v.v GROUP BY a.kmer""")
def absent_profile(spark, d):
    counts = shared.written(_counts(spark, d), "counts")
    rows = neighbors.profile(kmers.absent(spark, counts, K), counts, 1, k=K).select("kmer", "n0", "n1")
    return shared.finished(rows, "absent-profile", counts)


def _absent_bounded_sql(bounds: list[int], where: str, limit: int) -> str:
    n = ", ".join(f"coalesce(sum(c.n) FILTER (hamming(a.kmer, c.kmer) = {i + 1}), 0)::bigint AS n{i + 1}" for i in range(len(bounds)))
    keep = " AND ".join(f"n{i + 1} <= {b}" for i, b in enumerate(bounds) if b is not None)
    return f"""{ALL_SQL}, {SPACE_SQL}, c AS (SELECT kmer, count(*) AS n FROM sites GROUP BY kmer),
p AS (SELECT a.code, a.kmer, {n} FROM absent AS a LEFT JOIN c ON hamming(a.kmer, c.kmer) <= {len(bounds)} WHERE {where} GROUP BY a.code, a.kmer)
SELECT * FROM p WHERE {keep} ORDER BY code LIMIT {limit}"""


@_query(_absent_bounded_sql([120, 4000], "regexp_full_match(a.kmer, '[ACGT]{6}[AG][CT]')", 200))
def absent_bounded_motif(spark, d):
    counts = shared.written(_counts(spark, d), "counts")
    return shared.finished(neighbors.absent_within(spark, counts, K, [120, 4000], motif="XXXXXXRY", limit=200), "absent-bounded", counts)


@_query(_absent_bounded_sql([None, 3000], "a.kmer LIKE 'GC%'", 200))
def absent_bounded_prefix(spark, d):
    counts = shared.written(_counts(spark, d), "counts")
    return shared.finished(neighbors.absent_within(spark, counts, K, [None, 3000], prefix="GC", limit=200), "absent-bounded", counts)

# --- absent k-mers as gaps and draws; sets as pages -------------------------------------------------

def _gaps_sql(k: int, codes: str = "SELECT DISTINCT code FROM coded") -> str:
    return f"""coded AS (SELECT {_code('kmer')} AS code FROM (SELECT DISTINCT kmer FROM sites)), held AS ({codes} UNION ALL SELECT {4**k}),
gaps AS (SELECT first, code - 1 AS last, code - first AS n FROM (SELECT code, coalesce(lag(code) OVER (ORDER BY code), -1) + 1 AS first FROM held) WHERE first < code)"""


@_query(f"{ALL_SQL}, {_gaps_sql(K)} SELECT first, last, n FROM gaps")
def absent_gaps(spark, d):
    """Runs of codes that do not occur."""
    return absence.gaps(_counts(spark, d), K).select("first", "last", "n")


@_query(f"""WITH {V.GENOME_SQL}, {V.sites_sql('X' * 16, '[ACGT]{16}')}, {_gaps_sql(16)},
r AS (SELECT *, sum(n) OVER (ORDER BY first) - n AS ahead FROM gaps), f AS (SELECT first, least(last, first + 999 - ahead)::bigint AS last FROM r WHERE ahead < 1000)
SELECT unnest(range(first, last + 1)) AS code FROM f""")
def absent_first_16(spark, d):
    """The first 1,000 of the 16-mers that do not occur, of 4^16."""
    return kmers.first_absent(V.genome(spark, d), 16, 1000).select("code")


def _draw_sql(size: int, seed: int) -> str:
    """The bijection of :func:`absence.shuffled` over all draws."""
    bits = absence.half_bits(size)
    steps = [f"r0 AS (SELECT draw, draw >> {bits} AS l, draw & {(1 << bits) - 1} AS r FROM (SELECT unnest(range(0, {4**bits})) AS draw))"]
    for k, key in enumerate(absence.keys(seed)):
        steps.append(f"m{k} AS (SELECT draw, l, r, (r * {absence.MIX_A} + {key}) % {1 << absence.MIX_BITS} AS t FROM r{k})")
        steps.append(f"x{k} AS (SELECT draw, l, r, (xor(t, t >> 13) * {absence.MIX_B}) % {1 << absence.MIX_BITS} AS t FROM m{k})")
        steps.append(f"r{k + 1} AS (SELECT draw, r AS l, xor(l, xor(t, t >> 15) & {(1 << bits) - 1}) AS r FROM x{k})")
    return ", ".join(steps) + f", drawn AS (SELECT draw, (l << {bits}) | r AS rank FROM r{absence.ROUNDS})"


@_query(f"{ALL_SQL}, {SPACE_SQL}, {_draw_sql(4**K, 7)} SELECT d.draw, a.code, a.kmer FROM drawn AS d JOIN absent AS a ON a.code = d.rank ORDER BY d.draw LIMIT 50")
def absent_draw(spark, d):
    """Fifty 8-mers that do not occur, drawn at random without listing the others."""
    return absence.draw_absent(spark, _counts(spark, d), K, 50, seed=7)


def _page_sets(spark, d) -> tuple[DataFrame, DataFrame]:
    """The sets of documents and of benchmark items, stored as pages and read again."""
    out = []
    for table in (_counts(spark, d), _others(spark, d)):
        path = shared.fresh_path(spark, "pages")
        pages.write_pages(pages.pages(table), path)
        out.append(pages.read_pages(spark, path))
    return out[0], out[1]


@_query(f"{ALL_SQL}, u AS (SELECT kmer FROM sites UNION SELECT kmer FROM others) SELECT kmer, {_code('kmer')} AS code FROM u")
def page_union(spark, d):
    return pages.members(pages.union(*_page_sets(spark, d)), K).select("kmer", "code")


@_query(f"""{ALL_SQL}, a AS (SELECT DISTINCT kmer FROM sites), b AS (SELECT DISTINCT kmer FROM others)
SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, (SELECT count(*) FROM a WHERE kmer IN (FROM b)) AS n_both, (SELECT count(*) FROM (FROM a UNION FROM b)) AS n_either,
{4**K} - (SELECT count(*) FROM (FROM a UNION FROM b)) AS n_absent""")
def page_counts(spark, d):
    """Sizes of two stored sets, of what both and what either has, and of what neither has, by counting bits."""
    a, b = _page_sets(spark, d)
    named = [("left", a), ("right", b), ("both", pages.intersection(a, b)), ("either", pages.union(a, b))]
    sides = [rows.select(F.lit(name).alias("side"), F.bitmap_count("bits").alias("n")) for name, rows in named]
    both = sides[0].unionByName(sides[1]).unionByName(sides[2]).unionByName(sides[3])
    of = lambda name: F.coalesce(F.sum(F.when(F.col("side") == name, F.col("n"))), F.lit(0).cast("long"))
    return both.agg(*[of(name).alias(f"n_{name}") for name, _ in named]).withColumn("n_absent", F.lit(4**K).cast("long") - F.col("n_either"))


# --- neighbours -------------------------------------------------------------------------------

def _profile_sql(m: int, bag: bool) -> str:
    cuts = [20 * j // (m + 1) for j in range(m + 2)]
    seeds = " UNION ALL ".join(f"SELECT kmer, n, {j} AS j, substr(kmer, {lo + 1}, {hi - lo}) AS b FROM c" for j, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))
    sums = ", ".join(f"coalesce(sum(CASE WHEN d = {i} THEN {'n' if bag else 1} END), 0)::bigint AS n{i}" for i in range(m + 1))
    return f"""{NGG_SQL}, c AS (SELECT kmer, count(*) AS n FROM sites GROUP BY kmer), s AS ({seeds}),
p AS (SELECT DISTINCT a.kmer, b.kmer AS other, b.n, hamming(a.kmer, b.kmer) AS d FROM s AS a JOIN s AS b ON a.j = b.j AND a.b = b.b WHERE hamming(a.kmer, b.kmer) <= {m}),
profile AS (SELECT kmer, {sums} FROM p GROUP BY kmer)"""


def _profiled(spark, d, m: int, bag: bool = True, listing: bool = False) -> DataFrame:
    counts = shared.written(_coded_counts(spark, d), "counts")
    return neighbors.own_profile(counts, m, 20, bag, listing)


@_query(f"{_profile_sql(2, False)} SELECT kmer, n0, n1, n2 FROM profile")
def neighbors_set(spark, d):
    return _profiled(spark, d, 2, bag=False).select("kmer", "n0", "n1", "n2")


@_query(f"{_profile_sql(3, True)} SELECT kmer, n0, n1, n2, n3, n0 || '/' || n1 || '/' || n2 || '/' || n3 AS off_site_counts FROM profile")
def offsites_bag(spark, d):
    return _profiled(spark, d, 3).select("kmer", "n0", "n1", "n2", "n3", "off_site_counts")


@_query(f"{_profile_sql(2, True)} SELECT kmer, n0, n1, n2 FROM profile WHERE n0 <= 1 AND n1 <= 2 AND n0 + n1 + n2 <= 4")
def offsites_thresholded(spark, d):
    return neighbors.within(_profiled(spark, d, 2), "1/2/-1/4").select("kmer", "n0", "n1", "n2")


@_query(f"""{_profile_sql(2, True)}, l AS (SELECT kmer, other, n, d,
  list_aggregate(list_transform(range(1, 21), lambda i: CASE WHEN substr(kmer, i::int, 1) = substr(other, i::int, 1) THEN substr(other, i::int, 1) ELSE lower(substr(other, i::int, 1)) END), 'string_agg', '') AS m FROM p)
SELECT kmer, string_agg(m || ':' || n, '/' ORDER BY d, other) AS found FROM l GROUP BY kmer""")
def offsites_mutlist(spark, d):
    return _profiled(spark, d, 2, listing=True).select("kmer", "found")


@_query(f"{_profile_sql(2, True)} SELECT kmer, (2 * n0) || '/' || (2 * n1) || '/' || (2 * n2) AS merged FROM profile")
def profile_merge(spark, d):
    rows = _profiled(spark, d, 2)
    return rows.select("kmer", neighbors.merge_profiles(F.col("off_site_counts"), F.col("off_site_counts")).alias("merged"))


@_query(f"""{_profile_sql(2, False)}, h AS (SELECT kmer AS pattern, d FROM p WHERE d > 0)
SELECT c.kmer, count(h.d) FILTER (h.d = 0) AS n0, count(h.d) FILTER (h.d = 1) AS n1, count(h.d) FILTER (h.d = 2) AS n2 FROM c LEFT JOIN h ON h.pattern = c.kmer GROUP BY c.kmer""")
def hit_histogram(spark, d):
    counts = shared.written(_coded_counts(spark, d), "counts")
    near = groups.pairs(None, counts, 20, 2, counts.count()).where("d > 0")
    hits = near.select(S.spelled(F.col("q"), 20).alias("pattern"), F.col("d").alias("mismatches"))
    return neighbors.hit_histogram(counts.select(S.spelled(F.col("code"), 20).alias("kmer")), hits, 2).select("kmer", "n0", "n1", "n2")


@_query(f"""{_profile_sql(2, True)}, h AS (SELECT kmer AS pattern, d, unnest(range(0, n)) AS copy FROM p)
SELECT c.kmer, count(h.d) FILTER (h.d = 0) AS n0, count(h.d) FILTER (h.d = 1) AS n1, count(h.d) FILTER (h.d = 2) AS n2 FROM c LEFT JOIN h ON h.pattern = c.kmer GROUP BY c.kmer""")
def hit_file_histogram(spark, d):
    """Hits of a search, one line for each site found, written as such a program writes them and read back."""
    found = _coded(spark, d)  # scanned again for the lines, as a table of all sites takes more room than the scan takes time
    counts_ = shared.written(_coded_counts(spark, d), "counts")
    near = groups.pairs(None, counts_, 20, 2, counts_.count()).select("q", "code", "d")
    path = shared.fresh_path(spark, "hits")
    spelled = lambda name: S.spelled(F.col(name), 20)
    lines = near.join(found, "code").select(spelled("q").alias("pattern"), "chrom", F.col("start0").alias("location"), spelled("code").alias("seq"), "strand", "d")
    lines.write.option("sep", "\t").option("compression", "gzip").csv(path)
    return neighbors.hit_histogram(counts_.select(spelled("code").alias("kmer")), files.read_hits(spark, path), 2).select("kmer", "n0", "n1", "n2")


@_query(f"{NGG_SQL} SELECT DISTINCT kmer || 'NNN 3' AS line FROM sites")
def hit_search_input(spark, d):
    return neighbors.hit_search_input(_ngg(spark, d).select("kmer").distinct(), 3)


# --- tables in shards ---------------------------------------------------------------------------

def _sharded(spark, d, p: int) -> str:
    """The counts of all 20-mers before NGG, a folder for each prefix of p bases."""
    path = shared.fresh_path(spark, "kmer-shards")
    counts = _coded_counts(spark, d)
    files.write_kmers(counts.select(S.spelled(F.col("code"), 20).alias("kmer"), "n", "code"), path, p)
    return path


ITEM_SQL = "q AS (SELECT item_id, substr(regexp_replace(translate(text, '{}', '{}'), '[^ACGTN]', '', 'g'), 1, 20) AS kmer FROM benchmark)".format(V.SOURCE, V.TARGET)


@_query(f"""{NGG_SQL}, {ITEM_SQL}, c AS (SELECT kmer, count(*) AS n FROM sites GROUP BY kmer), f AS (SELECT * FROM q WHERE regexp_full_match(kmer, '[ACGT]{{20}}'))
SELECT f.item_id::bigint AS item_id, f.kmer, {', '.join(f'coalesce(sum(c.n) FILTER (hamming(f.kmer, c.kmer) = {i}), 0)::bigint AS n{i}' for i in range(4))} FROM f LEFT JOIN c ON hamming(f.kmer, c.kmer) <= 3 GROUP BY f.item_id, f.kmer""")
def shard_profile(spark, d):
    """The first 20-mer of each benchmark item against a table in shards, of which only those are read that a query can reach."""
    items = V.benchmark_genome(spark, d).select(F.substring("chrom", 5, 20).cast("long").alias("item_id"), F.substring("seq", 1, 20).alias("kmer")).where("kmer RLIKE '^[ACGT]{20}$'")
    return shards.profile(items, _sharded(spark, d, 4), 3, 20)


@_query(f"{_profile_sql(2, True)} SELECT kmer, n0, n1, n2 FROM profile WHERE kmer LIKE 'AC%' AND n0 <= 2 AND n1 <= 1 AND n0 + n1 + n2 <= 4")
def shard_profile_bounded(spark, d):
    """All 20-mers that start with AC, asked shard by shard; what is beyond a bound is not asked again."""
    path = _sharded(spark, d, 3)
    asked = files.read_kmers(spark, path).where("kmer LIKE 'AC%'").select("kmer")
    return shards.profile(asked, path, 2, 20, "2/1/-1/4").select("kmer", "n0", "n1", "n2")


# --- intervals --------------------------------------------------------------------------------

@_query(f"""WITH {V.BED_SQL} SELECT a.chrom, a.s, a.e, b.s AS s_b, b.e AS e_b FROM bed AS a JOIN bed AS b
ON a.chrom = b.chrom AND a.name = 'R' AND b.name <> 'R' AND (b.s BETWEEN a.s AND a.e OR b.e BETWEEN a.s AND a.e)""")
def overlap_join(spark, d):
    bed = V.bed(spark, d)
    return intervals.overlap_join(bed.where("name = 'R'"), bed.where("name <> 'R'")).select("chrom", "s", "e", "s_b", "e_b")


@_query(f"""WITH {V.BED_SQL} SELECT a.chrom, a.s, a.e, b.s AS s_b, b.e AS e_b, (least(a.e, b.e) - greatest(a.s, b.s))::bigint AS n FROM bed AS a JOIN bed AS b
ON a.chrom = b.chrom AND a.name = 'R' AND b.name <> 'R' AND a.s < b.e AND b.s < a.e""")
def overlap_join_halfopen(spark, d):
    bed = V.bed(spark, d)
    rows = intervals.overlap_join(bed.where("name = 'R'"), bed.where("name <> 'R'"), mode="overlap")
    return rows.select("chrom", "s", "e", "s_b", "e_b", intervals.overlap_length(F.col("s"), F.col("e"), F.col("s_b"), F.col("e_b")).alias("n"))


def _chain_sql(after: str, lo: int, hi: int, name: str = "name", blocks: bool = False) -> str:
    told = """gs AS start0, le AS end1, path AS name, 0::bigint AS copies, '.' AS strand, gs AS thick_start, le AS thick_end, '0,0,0' AS rgb, n AS block_count, sizes AS block_sizes, starts AS block_starts"""
    return f"""WITH RECURSIVE {V.BED_SQL}, b AS (SELECT DISTINCT chrom, s, e, {name} AS name FROM bed),
p AS (
  SELECT chrom, s AS gs, s AS ls, e AS le, name AS ln, 1::bigint AS n, name AS path, (e - s)::varchar AS sizes, '0' AS starts FROM b
  UNION ALL SELECT p.chrom, gs, b.s, b.e, b.name, n + 1, path || ':' || b.name, sizes || ',' || (b.e - b.s), starts || ',' || (b.s - gs)
  FROM p JOIN b ON b.chrom = p.chrom AND b.s - p.le BETWEEN {lo} AND {hi} AND {after} WHERE n < 3)
SELECT chrom, {told if blocks else 'gs AS s, le AS e, n, path AS name'} FROM p
WHERE n >= 2 AND (n = 3 OR NOT EXISTS (SELECT 1 FROM b WHERE b.chrom = p.chrom AND b.s - p.le BETWEEN {lo} AND {hi} AND {after}))"""


@_query(_chain_sql("b.s > p.le", 20, 40))
def chain_radius(spark, d):
    return intervals.chains(V.bed(spark, d), 20, 40, 2, 3)


@_query(_chain_sql("(b.s, b.e, b.name) > (p.ls, p.le, p.ln)", -10, 5, "name || '/' || strand"))
def chain_radius_overlap(spark, d):
    return intervals.chains(V.bed(spark, d), -10, 5, 2, 3, overlap=True)


@_query(_chain_sql("b.s > p.le", 20, 40, blocks=True))
def chain_bed12(spark, d):
    """The same chains as BED12 rows."""
    return intervals.chain_bed12(intervals.chains(V.bed(spark, d), 20, 40, 2, 3, blocks=True))


@_query(f"""WITH {V.BED_SQL}, x AS (SELECT DISTINCT chrom, s FROM bed), g AS (SELECT *, s - row_number() OVER (PARTITION BY chrom ORDER BY s) AS k FROM x)
SELECT chrom, min(s) AS start0, max(s) AS end0, count(*) AS n FROM g GROUP BY chrom, k""")
def islands(spark, d):
    return intervals.islands(V.bed(spark, d))


BLOCKS_SQL = f"""WITH {V.BED_SQL}, b AS (
  SELECT chrom, name, s // 100 AS k, string_agg(s, ',' ORDER BY s, e) AS starts, list(s ORDER BY s, e) AS ss, list(e - s ORDER BY s, e) AS zs FROM bed GROUP BY chrom, name, s // 100)
SELECT chrom, name, k::bigint AS k, starts FROM b WHERE {{}} (len(list_filter(range(2, len(ss) + 1), lambda i: ss[i - 1] + zs[i - 1] > ss[i])) = 0)"""


def _blocks(spark, d):
    rows = V.bed(spark, d).withColumn("k", F.floor(F.col("s") / 100)).groupBy("chrom", "name", "k").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("all"))
    return rows.select("chrom", "name", "k", F.array_join(F.transform("all", lambda x: x["s"].cast("string")), ",").alias("starts"),
                       F.transform("all", lambda x: x["s"]).alias("block_starts"), F.transform("all", lambda x: x["e"] - x["s"]).alias("block_sizes"))


@_query(BLOCKS_SQL.format(""))
def legal_blocks(spark, d):
    return intervals.split_legal(_blocks(spark, d))[0].select("chrom", "name", "k", "starts")


@_query(BLOCKS_SQL.format("NOT"))
def illegal_blocks(spark, d):
    return intervals.split_legal(_blocks(spark, d))[1].select("chrom", "name", "k", "starts")


# --- site tables ------------------------------------------------------------------------------

PROFILE3_SQL = _profile_sql(3, True)
TABLE3_SQL = f"""{PROFILE3_SQL}, t AS (
  SELECT s.chrom, s.start0 AS "chromStart", s.start0 + 20 AS "chromEnd", ({_key('s.kmer')}) || '.' || f.n0 || '/' || s.kmer AS name, f.n0 AS score, s.strand, n0, n1, n2, n3, s.kmer AS seq
  FROM sites AS s JOIN profile AS f ON s.kmer = f.kmer)"""
GC_SQL = "100.0 * length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq)"


def _table(spark, d, query: sitedb.SiteQuery | None = None) -> DataFrame:
    """The 18 columns, off-sites to three mismatches; of the k-mers that a query's bounds on their bases leave, if one is given."""
    return _annotated(_profiled_sites(spark, d, query=query))


def _profiled_sites(spark, d, regions: list[tuple[str, int, int]] | None = None, query: sitedb.SiteQuery | None = None) -> DataFrame:
    """(chrom, start0, strand, code, n0..n3) of all sites, or of those that may overlap some regions: only they are then asked for, of the counts of all.

    Sequences are scanned for counts and again for places, as a table of all sites takes more room than a scan takes time."""
    counts = shared.written(_coded_counts(spark, d), "counts")
    n = counts.count()
    if regions is None:
        profiled = groups.counts(None, counts, 20, 3, n).withColumnRenamed("q", "code")
        keep = sitedb.code_bounds(query, F.col("code"), 20) if query else F.lit(True)
        return _coded(spark, d).where(keep).join(profiled.where(keep), "code")
    near = V.genome(spark, d).where(F.col("chrom").isin(sorted({r[0] for r in regions})))
    rows = shared.written(sites.coded_sites(near, NGG).where(sitedb.may_overlap(regions, F.col("start0"), F.col("start0") + 20)), "sites")
    profiled = groups.counts(rows.select(F.col("code").alias("q")).distinct(), counts, 20, 3, n)
    return shared.finished(rows.join(profiled.withColumnRenamed("q", "code"), "code"), "sites-near", rows, counts)


def _annotated(rows: DataFrame) -> DataFrame:
    """The 18 columns of sites with their counts; a k-mer has n0 sites."""
    kmer, counts = S.spelled(F.col("code"), 20), F.concat_ws("/", *[F.col(f"n{i}").cast("string") for i in range(4)])
    name = F.concat(S.key_of_code(F.col("code"), 20).cast("string"), F.lit("."), F.col("n0").cast("string"), F.lit("/"), kmer)
    return annotate.one_copy_table(rows.select("*", (F.col("start0") + 20).alias("end1"), name.alias("name"), F.col("n0").alias("copies"), counts.alias("off_site_counts")))


REGIONS = [("doc3", 0, 400), ("doc3", 300, 900), ("doc10", 100, 0), ("doc25", 0, 0), ("doc111", 50, 2000)]
# An end of 0 is the chromosome's last place.
REGIONS_SQL = """r AS (SELECT rid, rc, rs, CASE WHEN re <= 0 THEN (SELECT max("chromEnd") FROM t WHERE chrom = rc) ELSE re END AS re FROM (VALUES """ + ", ".join(f"({k}, '{c}', {s}, {e})" for k, (c, s, e) in enumerate(REGIONS)) + ") AS v(rid, rc, rs, re))"
HIT_SQL = 'JOIN r ON t.chrom = r.rc AND t."chromEnd" > r.rs AND t."chromStart" < r.re'


def _near_table(spark, d) -> DataFrame:
    """The rows of the 18-column table that the regions can touch."""
    return _annotated(_profiled_sites(spark, d, REGIONS))


_LINES = [f"{c}\t{s}\t{e}" for c, s, e in REGIONS]


@_query(f"""{TABLE3_SQL} SELECT chrom, "chromStart", name FROM t WHERE ({GC_SQL}) BETWEEN 40 AND 60 AND n1 <= 2""")
def db_filter_ranges(spark, d):
    query = sitedb.parse(["$percentGC\t40\t60", ".11\t-10000\t2"])
    return sitedb.run(_table(spark, d, query), query).select("chrom", "chromStart", "name")


@_query(f"""{TABLE3_SQL}, {REGIONS_SQL} SELECT rid, chrom, "chromStart", name FROM t {HIT_SQL}""")
def db_regions(spark, d):
    return sitedb.run(_near_table(spark, d), sitedb.parse(_LINES)).select("rid", "chrom", "chromStart", "name")


@_query(f"""{TABLE3_SQL}, {REGIONS_SQL} SELECT rid, chrom, "chromStart", name, n1 + n2 + n3 AS "totalOffSites" FROM t {HIT_SQL}""")
def db_stored_regions(spark, d):
    """The same regions of a stored table, which the query names itself; only what the regions can touch is read."""
    path = shared.fresh_path(spark, "site-store")
    stores.write_sites(_profiled_sites(spark, d).withColumn("chromStart", F.col("start0")), path, made=_annotated)
    return sitedb.ask(spark, [f":{path}", *_LINES]).select("rid", "chrom", "chromStart", "name", "totalOffSites")


@_query(f"""{TABLE3_SQL}, {REGIONS_SQL} SELECT rid, chrom, "chromStart", rc || ':' || rs || '-' || re || '/' || name AS name FROM t {HIT_SQL}""")
def db_range_in_name(spark, d):
    return sitedb.run(_near_table(spark, d), sitedb.parse(_LINES), range_in_name=True).select("rid", "chrom", "chromStart", "name")


LAST_SQL = f"""n0 AS n0mismatches, n1 AS n1mismatches, n2 AS n2mismatches, n3 AS n3mismatches, n1 + n2 + n3 AS "totalOffSites", n0 || '/' || n1 || '/' || n2 || '/' || n3 AS "offSiteCounts",
seq AS "spacerSeq", {GC_SQL} AS "percentGC", list_max(list_transform(string_split_regex(seq, '[^T]+'), lambda x: length(x))) AS "longestTandemT\""""


@_query(f"""{TABLE3_SQL} SELECT chrom, "chromStart", "chromEnd", name, score, strand, "chromStart" AS "thickStart", "chromEnd" AS "thickEnd", '0,0,0' AS reserved, {LAST_SQL} FROM t""")
def db_annotate18(spark, d):
    return _table(spark, d)


@_query(f"""{PROFILE3_SQL}, g AS (SELECT *, start0 - lag(start0) OVER (PARTITION BY kmer, chrom ORDER BY start0) AS gap FROM sites),
l AS (SELECT kmer, min(chrom) AS chrom, min(start0) AS lo, max(start0) AS hi, count(*) AS n, min(strand) AS s1, max(strand) AS s2, string_agg('20', ',') AS sizes, list(start0 ORDER BY start0) AS ss
  FROM g GROUP BY kmer HAVING count(DISTINCT chrom) = 1 AND coalesce(min(gap), 20) >= 20 AND count(*) > 1),
t AS (SELECT l.*, l.kmer AS seq, n0, n1, n2, n3 FROM l JOIN profile AS f ON l.kmer = f.kmer)
SELECT chrom, lo AS "chromStart", hi + 20 AS "chromEnd", ({_key('kmer')}) || '.' || n || '/' || kmer || '/k=' || n || '/s=' || (hi + 20 - lo) AS name, n AS score, CASE WHEN s1 = s2 THEN s1 ELSE '.' END AS strand,
lo AS "thickStart", hi + 20 AS "thickEnd", '0,0,0' AS reserved, n AS "blockCount", sizes AS "blockSizes", list_aggregate(list_transform(ss, lambda x: x - lo), 'string_agg', ',') AS "chromStarts", n AS "clusterSize", {LAST_SQL} FROM t""")
def db_annotate22(spark, d):
    found = sites.site_table(_coded(spark, d))
    counts = shared.written(kmers.coded_counts(found), "counts")
    # a k-mer of one site is no cluster of several, so its place is not looked at
    several = found.join(counts.where("n > 1").select("code"), "code").select("chrom", "start0", "strand", S.spelled(F.col("code"), 20).alias("kmer"))
    rows = shared.written(sites.clusters(several).withColumn("kmer", F.split("name", "/")[1]), "clusters")
    profiled = neighbors.profile(rows.select("kmer"), counts, 3, k=20, rows=counts.count()).select("kmer", "off_site_counts")
    return annotate.cluster_table(rows.join(profiled, "kmer"))


@_query(f"""{TABLE3_SQL}, {REGIONS_SQL}, b AS (SELECT rid, t.*, row_number() OVER (PARTITION BY rid ORDER BY n1 + n2 + n3, {GC_SQL} DESC, "chromStart", "chromEnd", name) AS rank FROM t {HIT_SQL})
SELECT rid, chrom, "chromStart", name, rank::int AS rank FROM b WHERE rank <= 4""")
def db_best_n(spark, d):
    return sitedb.run(_near_table(spark, d), sitedb.parse([*_LINES, "!BEST\t4", "!MIN\ttotalOffSites", "!MAX\tpercentGC"])).select("rid", "chrom", "chromStart", "name", "rank")


@_query(f"""{TABLE3_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY n1 + n2 + n3, "chromStart", "chromEnd", name) AS rank FROM t) SELECT chrom, "chromStart", name, rank::int AS rank FROM b WHERE rank <= 2""")
def db_best_n_by_chrom(spark, d):
    return sitedb.run(_table(spark, d), sitedb.parse(["!BEST/2", "!MIN/14"])).select("chrom", "chromStart", "name", "rank")


@_query(f"""{COUNTED_SQL} SELECT DISTINCT kmer, copies FROM counted WHERE length(regexp_replace(kmer, '[^T]', '', 'g')) <= 4 AND length(regexp_replace(kmer, '[^GC]', '', 'g')) / 20 BETWEEN 0.4 AND 0.6""")
def guide_filter(spark, d):
    rows = kmers.kmer_counts(_ngg(spark, d)).withColumnRenamed("n", "copies")
    return rows.where(filters.guide_quality(F.col("kmer"), F.col("copies"))).select("kmer", "copies")


@_query(f"""WITH {V.MASKED_SQL}, g AS (SELECT unnest(range(1, length(seq) - 18)) AS i, seq FROM genome), k AS (SELECT substr(seq, i::int, 20) AS kmer FROM g), c AS (SELECT kmer, count(*) AS copies FROM k WHERE regexp_full_match(kmer, '[ACGTacgt]{{20}}') GROUP BY kmer)
SELECT kmer, copies FROM c WHERE copies BETWEEN 2 AND 3 AND length(regexp_replace(upper(kmer), '[^T]', '', 'g')) <= 4 AND length(regexp_replace(upper(kmer), '[^GC]', '', 'g')) / 20 BETWEEN 0.4 AND 0.6""")
def guide_filter_max(spark, d):
    """At most three copies, masked bases allowed and counted like others."""
    rows = scan.masked_counts(V.genome(spark, d, masked=True), 20, lambda codes: filters.guide_codes(codes, 20)).where("n BETWEEN 2 AND 3")
    return scan.spelled_masked(rows, 20).withColumnRenamed("n", "copies")


TRIPLET_SQL = "regexp_full_match(kmer, '(" + "|".join(filters.TRIPLETS) + ")*')"


@_query(f"WITH {V.GENOME_SQL}, {V.sites_sql('X' * 9, '[ACGT]{9}')} SELECT kmer, count(*) AS copies FROM sites WHERE {TRIPLET_SQL} GROUP BY kmer")
def triplet_filter(spark, d):
    return kmers.strand_counts(V.genome(spark, d), 9).where(filters.triplets_only(F.col("kmer"))).select("kmer", F.col("n").alias("copies"))


@_query(f"WITH {V.GENOME_SQL}, {V.sites_sql('X' * 9, '[ACGT]{9}')} SELECT kmer, count(*) AS copies FROM sites WHERE {TRIPLET_SQL} GROUP BY kmer HAVING count(*) > 3 AND count(*) <= 50")
def triplet_copy_filter(spark, d):
    counts = kmers.strand_counts(V.genome(spark, d), 9).where(filters.triplets_only(F.col("kmer"))).select("kmer", F.col("n").alias("copies"))
    return counts.where(filters.copies_match(F.col("copies"), ">3&&<=50"))
