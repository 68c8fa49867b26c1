"""Approximate nearest neighbours by Euclidean distance: a hierarchical k-means tree, searched best bin first.

The tree is fitted on the driver to a bounded sample of rows (``SAMPLE``, fewer where vectors are long): the node that
holds most of the sample is split into ``BRANCHES`` by k-means, again and again, until there are half as many leaves as the square root of
the table's rows (at most ``LEAVES``): what a query meets, nodes and leaves, grows slower than the table.  Every row of the table is then sent down the tree and indexed in the leaf
it ends in; a leaf with many rows is cut into chunks by a hash, so that no task holds a whole one however it grew.

A query walks the tree with a priority queue: the nearest node that is still waiting is opened, its children wait in turn, and
leaves are visited in the order in which they come out.  How many leaves a query visits is calibrated on the table
itself: ``CALIBRATION`` of the queries, drawn by a hash, are compared with all rows, by one pass in blocks; the leaves of
their true neighbours have places in the order of their walks, and visits are widened leaf by leaf until the part of true neighbours reached is
``recall``.  Where the data have no structure that takes most leaves; the result is then nearly exact, not less right.

Queries are sent to the chunks of their leaves, where a block of them meets a chunk by one matrix product; what may be among the
nearest is measured again by differences, so scores are those of the definition.  Only a leaf that over ``CROWD`` queries visit is copied, once for each so many.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; shorter vectors
count as padded with zeros; a null id is no query and no candidate; equal ids are candidates of their own; fewer
than k candidates are all returned; ties go to smaller ids; an empty table gives no rows; squares of components must not
exceed a double.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.llm.common import few_records, finished, remove_table, tidy, written
from seqloom.llm.topk import as_matrix, distances

K, EVERY = 10, 100
#: Rows that the tree is fitted to, at most, and bytes that they may have on the driver.
SAMPLE, SAMPLE_BYTES = 16_384, 64 << 20
#: Children of a node, leaves at most, and rows of a chunk of a leaf.
BRANCHES, LEAVES, CHUNK = 8, 2048, 8192
#: Queries that visits are calibrated on, at most, and the part of their true neighbours that must be reached.
CALIBRATION, RECALL = 256, 0.95
#: Queries that meet a chunk at once, and queries from which on a leaf is copied.
BLOCK, CROWD = 512, 65_536
#: Bytes of vectors between JVM and Python at once.
BATCH_BYTES = 8 << 20
FOUND = "query_id long, query_row long, vec_id long, row long, leaf int, score double"


@dataclass
class Tree:
    """Centres of all nodes, the children of each (none for a leaf) and the number of each leaf."""

    centres: np.ndarray
    children: list[list[int]] = field(default_factory=list)
    leaf: dict[int, int] = field(default_factory=dict)

    def assign(self, m: np.ndarray) -> np.ndarray:
        """The leaf that each row ends in: always the nearest child, the first of equals."""
        at = np.zeros(len(m), int)
        open_ = np.arange(len(m))
        while len(open_):
            for node in np.unique(at[open_]):
                if self.children[node]:
                    mine = open_[at[open_] == node]
                    at[mine] = np.array(self.children[node])[distances(m[mine], self.centres[self.children[node]]).argmin(1)]
            open_ = open_[[bool(self.children[n]) for n in at[open_]]]
        return np.array([self.leaf[n] for n in at.tolist()], np.int32)

    def walk(self, m: np.ndarray, visits: int) -> np.ndarray:
        """The first leaves that each query visits, best bin first."""
        out = np.full((len(m), min(visits, len(self.leaf))), -1, np.int32)
        for q, far in enumerate(distances(m, self.centres).tolist()):
            waiting, n = [(0.0, 0)], 0
            while waiting and n < out.shape[1]:
                _, node = heapq.heappop(waiting)
                if self.children[node]:
                    for c in self.children[node]:
                        heapq.heappush(waiting, (far[c], c))
                else:
                    out[q, n] = self.leaf[node]
                    n += 1
        return out


def k_means(m: np.ndarray, k: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(centres, label of each row); fewer centres where rows are alike."""
    centres = np.unique(m[np.linspace(0, len(m) - 1, k).astype(int)], axis=0)
    for _ in range(rounds):
        near = distances(m, centres).argmin(1)
        centres = np.array([m[near == c].mean(0) for c in np.unique(near)])
    near = distances(m, centres).argmin(1)
    used, near = np.unique(near, return_inverse=True)
    return centres[used], near


def fit(sample: np.ndarray, leaves: int, branches: int = BRANCHES) -> Tree:
    """Splits the node with most of the sample until there are enough leaves or none can be split."""
    centres, children, rows = [sample.mean(0)], [[]], {0: np.arange(len(sample))}
    waiting = [(-len(sample), 0)]
    while waiting and len(rows) < leaves:
        _, node = heapq.heappop(waiting)
        mine = sample[rows[node]]
        made, label = k_means(mine, min(branches, leaves - len(rows) + 1, len(mine)))
        if len(made) < 2:
            continue
        held = rows.pop(node)
        for c, centre in enumerate(made):
            children[node].append(len(centres))
            rows[len(centres)] = held[label == c]
            heapq.heappush(waiting, (-len(rows[len(centres)]), len(centres)))
            centres.append(centre)
            children.append([])
    return Tree(np.array(centres), children, {n: k for k, n in enumerate(sorted(rows))})


def nearest(q: np.ndarray, own: np.ndarray, m: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places in m, distances) of the k nearest of each query but its own row; ties to smaller ids."""
    squares, mine = (m * m).sum(1), (q * q).sum(1)
    about = mine[:, None] + squares - 2 * q @ m.T
    slack = 1e-9 * (mine + squares.max(initial=0))
    for a in range(len(q)):
        line = np.where(rows == own[a], np.inf, about[a])
        if len(line) > k:
            good = np.flatnonzero(line <= np.partition(line, k - 1)[k - 1] + slack[a])
        else:
            good = np.arange(len(line))
        good = good[rows[good] != own[a]]
        exact = np.sqrt(((m[good] - q[a]) ** 2).sum(1))
        best = np.lexsort((rows[good], ids[good], exact))[:k]
        yield a, good[best], exact[best]


def _told(asked: pd.DataFrame, width: int, m: np.ndarray, held: pd.DataFrame, k: int) -> pd.DataFrame:
    """The nearest of the rows held for each query asked, as rows of ``FOUND``."""
    ids, rows = held["vec_id"].to_numpy(), held["row"].to_numpy()
    out = [(asked["vec_id"].iat[a], asked["row"].iat[a], ids[b], rows[b], held["leaf"].iat[b], s) for a, best, far in nearest(as_matrix(asked["v"], width), asked["row"].to_numpy(), m, ids, rows, k) for b, s in zip(best, far, strict=True)]
    return pd.DataFrame(out, columns=[f.split()[0] for f in FOUND.split(", ")])


def _searcher(width: int, k: int):
    """Reads rows sorted by chunk, its vectors before its queries."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, m = None, [], None
        for batch in batches:
            for now, group in batch.groupby(["leaf", "chunk", "copy"], sort=False):
                if now != key:
                    key, held, m = now, [], None
                vectors, asked = group[group["kind"] == 0], group[group["kind"] == 1]
                if len(vectors):
                    held.append(vectors)
                if len(asked) and held:
                    if m is None:
                        held = [pd.concat(held)]
                        m = as_matrix(held[0]["v"], width)
                    for at in range(0, len(asked), BLOCK):
                        yield _told(asked.iloc[at : at + BLOCK], width, m, held[0], k)

    return search


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine & F.exists("v", lambda x: x != 0))


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def exact(queries: list, rows: DataFrame, width: int, k: int) -> DataFrame:
    """The true nearest of a bounded list of queries (vec_id, v, row) among all ``rows``, compared in blocks."""
    asked = pd.DataFrame([(r["vec_id"], r["v"], r["row"]) for r in queries], columns=["vec_id", "v", "row"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield _told(asked, width, as_matrix(batch["v"], width), batch, k)

    return ranked(rows.mapInPandas(tidy(compare), FOUND), k)


def near(vectors: DataFrame, k: int = K, query_every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, leaves: int | None = None, chunk: int = CHUNK, calibration: int = CALIBRATION, crowd: int = CROWD) -> DataFrame:
    """query_id, rank, vec_id, score, leaves (visited), calibrated_recall of the nearest found of every query: the rows whose id is divisible by ``query_every``."""
    spark = vectors.sparkSession
    shape = "query_id long, rank int, vec_id long, score double, leaves int, calibrated_recall double"
    rows = written(usable(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "ann-vectors")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], shape)
    sampled = rows.orderBy(F.xxhash64("vec_id", "row"), "row").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))).select("v").collect()
    tree = fit(as_matrix(pd.Series([r["v"] for r in sampled]), width), max(1, min(LEAVES, len(sampled) // 8, leaves or round(n**0.5 / 2))))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(leaf=tree.assign(as_matrix(batch["v"], width)))

    with few_records(spark, max(16, min(4096, BATCH_BYTES // (8 * width)))):
        index = written(rows.mapInPandas(tidy(place), "vec_id long, v array<double>, row long, leaf int"), "ann-index")
        remove_table(rows)
        queries = index.where(F.pmod("vec_id", F.lit(query_every)) == 0)
        known = queries.orderBy(F.xxhash64("vec_id", "row", F.lit(1)), "row").limit(calibration).collect()
        visits, reached = calibrated(tree, known, exact(known, index, width, k).select("query_row", "leaf").collect(), width, recall) if known else (1, 1.0)

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), BLOCK):
                    part = batch.iloc[at : at + BLOCK]
                    order = tree.walk(as_matrix(part["v"], width), visits)
                    yield part.iloc[np.repeat(np.arange(len(part)), order.shape[1])].assign(leaf=order.ravel())

        asked = written(queries.mapInPandas(tidy(walk), "vec_id long, v array<double>, row long, leaf int"), "ann-asked")
        # One row a leaf, of at most LEAVES.
        sizes = index.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
        crowds = asked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / crowd).cast("int").alias("copies"))
        directory = F.broadcast(sizes.join(crowds, "leaf"))
        hashed = lambda parts: F.pmod(F.xxhash64("row"), F.col(parts)).cast("int")
        dealt = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
        held = index.join(directory, "leaf").select("leaf", hashed("chunks").alias("chunk"), "copies", "vec_id", "v", "row", F.lit(0).alias("kind")).withColumn("copy", dealt("copies")).drop("copies")
        sent = asked.join(directory, "leaf").select("leaf", "chunks", hashed("copies").alias("copy"), "vec_id", "v", "row", F.lit(1).alias("kind")).withColumn("chunk", dealt("chunks")).drop("chunks")
        both = held.unionByName(sent).repartition("leaf", "chunk", "copy").sortWithinPartitions("leaf", "chunk", "copy", "kind")
        found = ranked(both.mapInPandas(tidy(_searcher(width, k)), FOUND), k)
        told = found.select("query_id", "rank", "vec_id", "score", F.lit(visits).alias("leaves"), F.lit(reached).alias("calibrated_recall"))
        return finished(told, "ann-result", index, asked)


def calibrated(tree: Tree, known: list, truth: list, width: int, recall: float) -> tuple[int, float]:
    """(leaves to visit, the part of true neighbours that they hold): visits are widened until that part is ``recall``."""
    order = tree.walk(as_matrix(pd.Series([r["v"] for r in known]), width), len(tree.leaf))
    place = {r["row"]: {int(x): k for k, x in enumerate(line)} for r, line in zip(known, order, strict=True)}
    places = np.sort([place[r["query_row"]][r["leaf"]] for r in truth])
    visits, reached = 1, 1.0
    while len(places) and (reached := float((places < visits).mean())) < recall:
        visits += 1
    return visits, reached


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
