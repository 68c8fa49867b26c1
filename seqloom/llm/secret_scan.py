"""Secret scans with corpus-wide ownership frequency.

Three patterns find candidates.  Spark's functions return matches, not places, so
places come from splitting the text by the same pattern: running sums of the
lengths between matches and of the matches.  Each candidate value is hashed, and
the corpus is asked how many distinct repositories (documents) and owners
(sources) hold it.  A value that at least ``EXAMPLE_OWNERS`` owners or
``EXAMPLE_REPOSITORIES`` repositories hold is a widely copied ``example``.  Of the others, those that
look random are ``live`` if one owner holds them and ``shared`` if several do.  A class
adds a span over the value to the spans of the patterns.

A value looks random if its characters spread enough: with n characters of which c
are equal, n * n is at least ``RANDOM[kind]`` times the sum of c * c (2 to the power of the collision
entropy, in whole numbers).  A hexadecimal run must also hold a letter: digits alone are numbers.

All of it is DataFrame operations.  Counts are aggregated in steps (by hash, owner
and repository; by hash and owner; by hash), each with partial aggregation, so a
key pasted into a third of all documents never meets in one task.

Defined results: a null text counts as empty, a null owner is an owner of its own,
a null repository one of its own; repeated rows give repeated results; an empty
table gives no rows; texts and values of any length are searched whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.llm.common import finished, join_groups, written

# The patterns and least lengths of the contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ["assign", "access", "hex", "live", "shared", "example"]

#: Owners, or repositories, from which on a value counts as a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 20
#: As how many equally frequent characters a random-looking value's characters spread at least.
RANDOM = {"assign": 8, "access": 8, "hex": 6}


def _found(text: Column, kind: str, pattern: str, value_group: int, maybe: Column) -> Column:
    """array<struct<kind, i, gap, whole, value>> of all matches, also of those too short."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else matches
    rows = F.transform(F.arrays_zip(matches.alias("m"), gaps.alias("g"), values.alias("v")), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), x["g"].cast("long").alias("gap"), F.length(x["m"]).cast("long").alias("whole"), x["v"].alias("value")))
    # split() gives one part more than there are matches
    return F.when(maybe, F.filter(rows, lambda x: x["whole"].isNotNull())).otherwise(F.array().cast("array<struct<kind:string,i:int,gap:bigint,whole:bigint,value:string>>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents, candidates): a row number for each document, and the candidates' kind, span, value and its span."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("s"), F.col(owner_col).cast("string")), F.lit("")).alias("owner"), text.alias("text"))
    t = F.col("text")
    # A run shorter than the least length can't be part of a longer match of ACCESS or HEX, so their bounds may stand in the pattern.
    hex_runs, access_runs = HEX.replace("+", "{%d,}" % LEAST["hex"]), ACCESS.replace("+", "{%d,}" % (LEAST["access"] - 4))
    rows = base.select("id", "owner", F.concat(
        _found(t, "assign", ASSIGN, 2, t.rlike("[:=]") & t.rlike(ASSIGN)), _found(t, "access", access_runs, 0, t.contains("AKIA")), _found(t, "hex", hex_runs, 0, t.rlike(hex_runs))).alias("found"))
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "secret-found")
    documents = rows.select("uid", "id")
    documents.written_to = rows.written_to
    one = Window.partitionBy("uid", "kind").orderBy("i")
    spans = (
        rows.select("uid", "id", "owner", F.explode("found").alias("f")).select("uid", "id", "owner", "f.*")
        .withColumn("end", F.sum(F.col("gap") + F.col("whole")).over(one.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("start", F.col("end") - F.col("whole")).withColumn("length", F.length("value"))
        .where(" OR ".join(f"kind = '{k}' AND length >= {n}" for k, n in LEAST.items()))
        .select("uid", "id", "owner", "kind", "start", "end", "value", (F.col("end") - F.col("length")).alias("value_start"))
    )
    return documents, written(spans, "secret-spans")


def looks_random(kind: Column, value: Column) -> Column:
    chars = F.split(value, "")
    squares = F.aggregate(F.array_distinct(chars), F.lit(0).cast("long"), lambda a, c: a + F.pow(F.size(F.filter(chars, lambda x: x == c)), 2).cast("long"))
    least = F.element_at(F.create_map(*[F.lit(x) for pair in RANDOM.items() for x in pair]), kind)
    n = F.length(value).cast("long")
    return (n * n >= least * squares) & ((kind != "hex") | value.rlike("[a-f]"))


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, repositories, owners, class, spans) of each candidate value; class is example, live, shared or null, spans how often it occurs."""
    value = F.sha2("value", 256)
    by_repo = spans.groupBy(value.alias("hash"), "owner", "id").agg(F.max(looks_random(F.col("kind"), F.col("value"))).alias("looks"), F.count(F.lit(1)).alias("spans"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.max("looks").alias("looks"), F.sum("spans").alias("spans"))
    by_value = by_owner.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"), F.max("looks").alias("looks"), F.sum("spans").alias("spans"))
    kind = F.when((F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES), "example").when(F.col("looks"), F.when(F.col("owners") == 1, "live").otherwise("shared"))
    return by_value.select("hash", "repositories", "owners", kind.alias("class"), "spans")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared, n_example."""
    documents, spans = scan(docs, id_col, text_col, owner_col)
    judged = written(ownership(spans).where("class IS NOT NULL").select("hash", "class", "spans"), "secret-judged")
    # A value pasted into very many documents is dealt out before it is joined.
    added = join_groups(spans.withColumn("hash", F.sha2("value", 256)), judged, "hash", "spans").select("uid", F.col("class").alias("kind"), F.col("value_start").alias("start"), "end")
    both = spans.select("uid", "kind", "start", "end").unionByName(added.distinct())
    place = lambda k: F.array_position(F.array(*[F.lit(x) for x in KINDS]), k)
    per_doc = both.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", place(F.col("kind")).alias("place"), "kind", "end"))).alias("all"))
    all_rows = documents.join(per_doc, "uid", "left").withColumn("all", F.coalesce("all", F.array().cast(per_doc.schema["all"].dataType)))
    told = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    told_all = all_rows.select(F.col("id").alias(id_col), count("assign"), count("access"), count("hex"), F.sha2(told(F.filter("all", lambda s: s["place"] <= 3)), 256).alias("base_sha256"), told(F.col("all")).alias("spans"), count("live"), count("shared"), count("example"))
    return finished(told_all, "secret-result", documents, spans, judged)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_PART = """
m_{kind} AS (
  SELECT doc_id, owner, unnest(range(1, len(m) + 1)) AS i, m, g, v FROM (
    SELECT doc_id, owner, regexp_extract_all(t, {pattern}, 0) AS m, string_split_regex(t, {pattern}) AS g, regexp_extract_all(t, {pattern}, {group}) AS v FROM d)),
s_{kind} AS (
  SELECT doc_id, owner, '{kind}' AS kind, sum(length(g[i]) + length(m[i])) OVER (PARTITION BY doc_id ORDER BY i) AS e, length(m[i]) AS n, v[i] AS val FROM m_{kind})"""
_quoted = lambda p: "'" + p.replace("'", "''") + "'"
SQL = (
    "WITH d AS (SELECT doc_id, coalesce('s' || source, '') AS owner, coalesce(text, '') AS t FROM documents),"
    + ",".join(_PART.format(kind=k, pattern=_quoted(p), group=g) for k, p, g in (("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0)))
    + f""",
b AS (
  SELECT doc_id, owner, kind, (e - n)::bigint AS s, e::bigint AS e, val FROM (FROM s_assign UNION ALL FROM s_access UNION ALL FROM s_hex)
  WHERE length(val) >= CASE kind WHEN 'assign' THEN {LEAST['assign']} WHEN 'access' THEN {LEAST['access']} ELSE {LEAST['hex']} END),
o AS (
  SELECT val, CASE WHEN count(DISTINCT owner) >= {EXAMPLE_OWNERS} OR count(DISTINCT (owner, doc_id)) >= {EXAMPLE_REPOSITORIES} THEN 'example'
                   WHEN bool_or(looks) THEN CASE WHEN count(DISTINCT owner) = 1 THEN 'live' ELSE 'shared' END END AS kind
  FROM (SELECT *, length(val) * length(val) >= CASE kind WHEN 'assign' THEN {RANDOM['assign']} WHEN 'access' THEN {RANDOM['access']} ELSE {RANDOM['hex']} END
               * list_sum(list_transform(list_distinct(string_split(val, '')), lambda c: pow(length(val) - length(replace(val, c, '')), 2)))
               AND (kind <> 'hex' OR regexp_matches(val, '[a-f]')) AS looks FROM b)
  GROUP BY val),
a AS (
  SELECT doc_id, kind, s, e FROM b
  UNION ALL SELECT DISTINCT b.doc_id, o.kind, b.e - length(b.val), b.e FROM b JOIN o USING (val) WHERE o.kind IS NOT NULL),
p AS (SELECT *, list_position(['assign', 'access', 'hex', 'live', 'shared', 'example'], kind) AS k, kind || ':' || s || ':' || e AS told FROM a)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(told, ',' ORDER BY s, k, e) FILTER (k <= 3), '')) AS base_sha256,
       coalesce(string_agg(told, ',' ORDER BY s, k, e), '') AS spans,
       count(*) FILTER (kind = 'live') AS n_live, count(*) FILTER (kind = 'shared') AS n_shared, count(*) FILTER (kind = 'example') AS n_example
FROM d LEFT JOIN p ON d.doc_id = p.doc_id GROUP BY d.doc_id
"""
)
