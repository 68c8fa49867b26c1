"""Exact top-k search by inner product with a pivot-distance index.

Vectors are lifted by one coordinate, sqrt(M^2 - |v|^2) with M the largest norm, so
that the largest inner product is the smallest distance.  Pivots come from a bounded
sample; every vector is indexed by its nearest pivot and its distance to it.  A cell
of the index is a ring: a pivot's vectors are cut by distance so that about ``CELL`` fall into each, and only a
ring whose vectors are all as far away (copies of one vector) is cut by a hash.  Within a
cell vectors are sorted by distance and cut into annuli.  A query first searches its
own cell, which gives it a k-th score.  It then visits the cells whose rings can
still hold a better one: by the triangle inequality a vector is no nearer to the query
than the difference of their distances to the pivot.  Within a cell the annuli are
expanded from the query's own distance and left once that bound is beyond the k-th.

Queries are sent to cells.  A task holds one cell and streams its queries past it, block by
block; only a cell that over ``CROWD`` queries visit is copied, once for each so many.  The driver holds the
pivots and two numbers per cell.

Defined results: vectors that are null, empty, or hold null or non-finite components
take no part; shorter vectors count as padded with zeros; a null id is no query and
no candidate; equal ids are candidates of their own; fewer than k candidates are all
returned; an empty table gives no rows; vectors of any length are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.llm.common import few_records, finished, remove_table, tidy, written

K = 5
#: Vectors in a cell, about, queries searched at once, and queries from which on a cell is copied.
CELL, BLOCK, CROWD = 8192, 2048, 65_536
ANNULUS = 512
#: Rows that pivots are chosen from, and most pivots: their distances are a matrix on the driver.
SAMPLE, PIVOTS = 16_384, 2048
#: Places at which a pivot's distances may be cut.
CUTS = 1024
#: Bytes of vectors between JVM and Python at once.
BATCH_BYTES = 8 << 20


def as_matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def lifted(m: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([m, np.sqrt(np.maximum(top - (m * m).sum(1), 0))[:, None]], 1)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Centres after a few rounds of k-means from evenly taken rows."""
    centres = sample[np.linspace(0, len(sample) - 1, n).astype(int)].copy()
    for _ in range(4):
        near = np.concatenate([distances(part, centres).argmin(1) for part in np.array_split(sample, -(-len(sample) // 2048))])
        for k in range(n):
            if (near == k).any():
                centres[k] = sample[near == k].mean(0)
    return centres


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: doubles where every sum fits them, integers else."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2.0**53:
        return np.array([[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a])
    return (a @ b.T).astype(np.int64)


class Best:
    """The k best (score, id) so far of each query, ties to the smaller id."""

    def __init__(self, query_ids: np.ndarray, query_rows: np.ndarray, k: int):
        self.ids, self.rows, self.k = query_ids, query_rows, k
        self.found: list[list[tuple[int, int, int]]] = [[] for _ in query_ids]

    def add(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        for q, line in zip(which, scores, strict=True):
            least = self.least(q)
            good = np.flatnonzero(line >= least) if least is not None else np.arange(len(line))
            if len(good) > 4 * self.k:
                cut = np.partition(line[good], -self.k - 1)[-self.k - 1]
                good = good[line[good] >= cut]
                if len(good) > 4 * self.k:  # many equal scores: the smallest ids of each are enough
                    good = good[np.lexsort((ids[good], -line[good]))[: self.k + 1]]
            more = [(-int(line[g]), int(ids[g]), int(rows[g])) for g in good if rows[g] != self.rows[q]]
            self.found[q] = sorted(self.found[q] + more)[: self.k]

    def least(self, q: int) -> int | None:
        return -self.found[q][-1][0] if len(self.found[q]) == self.k else None

    def frame(self) -> pd.DataFrame:
        rows = [(int(i), int(r), v, row, -s) for i, r, f in zip(self.ids, self.rows, self.found, strict=True) for s, v, row in f]
        return pd.DataFrame(rows, columns=["query_id", "query_row", "vec_id", "row", "score"])


FOUND = "query_id long, query_row long, vec_id long, row long, score long"


class Cell:
    """A cell's vectors by their distance to the pivot, in annuli."""

    def __init__(self, vectors: pd.DataFrame, width: int):
        vectors = vectors.sort_values(["at", "vec_id"])
        self.m, self.ids, self.rows, dist = as_matrix(vectors["v"], width), vectors["vec_id"].to_numpy(), vectors["row"].to_numpy(), vectors["at"].to_numpy()
        self.starts = np.arange(0, len(self.m), ANNULUS)
        self.lo, self.hi = dist[self.starts], dist[np.minimum(self.starts + ANNULUS, len(self.m)) - 1]

    def search(self, queries: pd.DataFrame, width: int, top: float, k: int) -> pd.DataFrame:
        """The best of the cell for a block of queries."""
        q, to_pivot, floor = as_matrix(queries["v"], width), queries["at"].to_numpy(), queries["floor"].to_numpy(dtype=float)
        best = Best(queries["vec_id"].to_numpy(), queries["row"].to_numpy(), k)
        squares = (q * q).sum(1) + top
        gap = np.maximum(np.maximum(self.lo - to_pivot[:, None], to_pivot[:, None] - self.hi), 0)
        for a in np.argsort(gap.mean(0), kind="stable"):
            known = np.array([np.nan if (x := best.least(i)) is None else x for i in range(len(q))], float)
            which = np.flatnonzero(gap[:, a] <= reach(squares, np.fmax(known, floor), top))
            if len(which):
                part = slice(self.starts[a], self.starts[a] + ANNULUS)
                best.add(which, products(q[which], self.m[part]), self.ids[part], self.rows[part])
        return best.frame()


def reach(squares: np.ndarray, least: np.ndarray, top: float) -> np.ndarray:
    """How far from a query, in the lifted space, a vector of at least the score ``least`` can be."""
    return np.where(np.isnan(least), np.inf, np.sqrt(np.maximum(squares - 2 * np.nan_to_num(least), 0))) + 1e-6 * (1 + np.sqrt(top))


def _searcher(width: int, top: float, k: int, block: int):
    """Reads rows sorted by cell, its vectors before its queries."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, cell = None, [], None
        for batch in batches:
            for now, group in batch.groupby(["cell", "copy"], sort=False):
                if now != key:
                    key, held, cell = now, [], None
                vectors, queries = group[group["kind"] == 0], group[group["kind"] == 1]
                if len(vectors):
                    held.append(vectors)
                if len(queries) and held:
                    cell = cell or Cell(pd.concat(held), width)
                    for at in range(0, len(queries), block):
                        yield cell.search(queries.iloc[at : at + block], width, top, k)

    return search


class Cells:
    """The directory of the index: of each cell its pivot and its nearest and farthest distance."""

    def __init__(self, pivots: np.ndarray, stats: list, cell: int):
        self.pivots, self.cuts, self.first = pivots, [np.zeros(0)] * len(pivots), np.zeros(len(pivots), np.int64)
        at = 0
        for r in sorted(stats, key=lambda r: r["pivot"]):
            rings = min(CUTS, -(-r["n"] // cell))
            edges = np.array(r["cuts"])[np.linspace(0, len(r["cuts"]) - 1, rings + 1).round().astype(int)[1:-1]]
            self.cuts[r["pivot"]], self.first[r["pivot"]] = np.unique(edges), at
            at += len(self.cuts[r["pivot"]]) + 1
        self.rings = at

    def ring(self, pivot: np.ndarray, dist: np.ndarray) -> np.ndarray:
        out = np.empty(len(pivot), np.int64)
        for p in np.unique(pivot):
            mine = pivot == p
            out[mine] = self.first[p] + np.searchsorted(self.cuts[p], dist[mine], side="right")
        return out

    def fill(self, stats: list, cell: int) -> None:
        """Takes in what each ring holds; rings with far too many vectors are several cells."""
        by_ring = {r["ring"]: r for r in stats}
        self.salts = np.array([max(1, -(-by_ring[k]["n"] // (2 * cell))) if k in by_ring else 1 for k in range(self.rings)])
        self.base = np.cumsum(self.salts) - self.salts
        told = [by_ring.get(k, {"pivot": 0, "lo": np.inf, "hi": -np.inf}) for k in range(self.rings)]
        self.pivot, self.lo, self.hi = (np.repeat([t[c] for t in told], self.salts) for c in ("pivot", "lo", "hi"))

    def place(self, ring: np.ndarray, row: np.ndarray) -> np.ndarray:
        mixed = (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.base[ring] + (mixed % self.salts[ring].astype(np.uint64)).astype(np.int64)


def top_k(vectors: DataFrame, k: int = K, query_every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, cell: int = CELL, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of every query: the rows whose id is divisible by ``query_every``."""
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    raw = raw.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0)).where(finite)
    # floor of a double may exceed a long; the exact value stays a double
    whole = F.transform("e", lambda x: F.when(F.abs(x) < 2.0**44, F.floor(x * scale).cast("double")).otherwise(x * scale))
    rows = written(raw.select("vec_id", whole.alias("v")).withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, width, top = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(square)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sampled = rows.orderBy(F.xxhash64("vec_id", "row")).limit(min(SAMPLE, max(1, (64 << 20) // (8 * width)))).select("v").collect()
    sample = as_matrix(pd.Series([r["v"] for r in sampled]), width)
    pivots = choose_pivots(lifted(sample, top), max(1, min(PIVOTS, len(sample), round((n / 8) ** 0.5))))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = distances(lifted(as_matrix(batch["v"], width), top), pivots)
                yield batch.assign(pivot=d.argmin(1).astype(np.int32), dist=d.min(1))

    with few_records(spark, max(16, BATCH_BYTES // (8 * width))):
        indexed = written(rows.mapInPandas(tidy(assign), "vec_id long, v array<double>, row long, pivot int, dist double"), "topk-index")
        remove_table(rows)
        cuts = F.percentile_approx("dist", [i / CUTS for i in range(CUTS + 1)], 4 * CUTS)
        cells = Cells(pivots, indexed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), cuts.alias("cuts")).collect(), cell)

        def ring(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(ring=cells.ring(batch["pivot"].to_numpy(), batch["dist"].to_numpy()))

        ringed = written(indexed.mapInPandas(ring, "vec_id long, v array<double>, row long, pivot int, dist double, ring long"), "topk-rings")
        remove_table(indexed)
        cells.fill(ringed.groupBy("ring").agg(F.first("pivot").alias("pivot"), F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect(), cell)
        shape = "cell long, kind int, vec_id long, v array<double>, row long, at double, floor double"

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(cell=cells.place(batch["ring"].to_numpy(), batch["row"].to_numpy()), kind=0, at=batch["dist"], floor=np.nan)[["cell", "kind", "vec_id", "v", "row", "at", "floor"]]

        def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Each query in its own cell.  Its lifted coordinate is 0, so its distance to the pivot is not the indexed one."""
            for batch in batches:
                if len(batch):
                    d = distances(np.pad(as_matrix(batch["v"], width), ((0, 0), (0, 1))), pivots)
                    at = cells.place(batch["ring"].to_numpy(), batch["row"].to_numpy())
                    yield batch.assign(cell=at, kind=1, at=d[np.arange(len(batch)), batch["pivot"]], floor=np.nan)[["cell", "kind", "vec_id", "v", "row", "at", "floor"]]

        def further(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Each query in all other cells whose ring of distances can hold something at least as good as the k-th so far."""
            for batch in batches:
                for some in np.array_split(np.arange(len(batch)), max(1, len(batch) * len(cells.pivot) >> 21)):
                    if not len(some):
                        continue
                    part = batch.iloc[some]
                    q = as_matrix(part["v"], width)
                    d = distances(np.pad(q, ((0, 0), (0, 1))), pivots)[:, cells.pivot]
                    near = np.maximum(np.maximum(cells.lo - d, d - cells.hi), 0) <= reach((q * q).sum(1) + top, part["floor"].to_numpy(dtype=float), top)[:, None]
                    near[np.arange(len(part)), part["cell"]] = False
                    which, cell_ = np.nonzero(near)
                    yield part.iloc[which].assign(cell=cell_, at=d[which, cell_])

        index = ringed.mapInPandas(place, shape)

        def searched(asked: DataFrame) -> DataFrame:
            # at most a row for each cell, so no more than the directory that every task holds
            visits = asked.groupBy("cell").count().where(F.col("count") > crowd)
            crowded = F.broadcast(visits.select("cell", F.ceil(F.col("count") / crowd).cast("int").alias("copies")))
            copies = F.coalesce("copies", F.lit(1))
            held = index.join(crowded, "cell", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
            dealt = asked.join(crowded, "cell", "left").withColumn("copy", F.pmod(F.xxhash64("row"), copies).cast("int"))
            both = held.unionByName(dealt).drop("copies").repartition("cell", "copy").sortWithinPartitions("cell", "copy", "kind")
            return both.mapInPandas(tidy(_searcher(width, top, k, block)), FOUND)

        queries = ringed.where(F.pmod(F.col("vec_id"), F.lit(query_every)) == 0)
        first = written(queries.mapInPandas(own, shape), "topk-first")
        seeds = written(searched(first), "topk-seeds")
        kth = seeds.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("kth"))
        known = first.drop("floor").join(kth, "row", "left").select("cell", "kind", "vec_id", "v", "row", "at", F.col("kth").alias("floor"))
        asked = written(known.mapInPandas(tidy(further), shape), "topk-asked")
        both = seeds.unionByName(searched(asked))
        rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
        told = both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        return finished(told, "topk-result", ringed, first, seeds, asked)


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::int AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 5
"""
