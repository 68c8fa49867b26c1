"""Whitening of embeddings by matrix-free block subspace iteration.

Entries become whole numbers x, so that counts, sums and deviations are exact.  No covariance
matrix V is ever made for the iteration: each Spark pass takes a block Q of orthonormal columns and gives
X'(XQ) / n over the centred rows, summed on the executors, column by column; the driver sees a block of
(dimensions x columns) numbers and nothing of a row.  Rayleigh and Ritz turn the pair Q, VQ
into eigenvalues and vectors, whose residuals |Vq - eq| need no further pass.  QR of VQ is the next block.
It ends when the residuals of all wanted components are below ``TOLERANCE`` of the largest eigenvalue, and
fails if that takes more than ``passes``.  A block has twice as many columns as components are wanted, or as
many as there are dimensions; then the first pass is already exact.  A last pass measures how far
the covariance of the whitened rows is from the identity.

Rows are centred without loss: x less the whole number nearest its mean, less the rest of the mean.

Defined results: null vectors and those with null or non-finite entries take no part; shorter vectors count as
padded with zeros, so empty ones take part where another is longer; entries of 2^46 or more in size count as
2^46; null and equal ids are rows like others; a component without variance (an eigenvalue of 1e-12 of
the trace or less) cannot be whitened and is left out, so a table of one row, or of equal
rows, gives no rows; a deviation too large for a long is null; equal eigenvalues have any basis of their space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import few_records, finished, written

K, SCALE, SHIFT = 32, 64, 1_000_000
#: Residual of a component, as a part of the largest eigenvalue, and passes after which the iteration has failed.
TOLERANCE, PASSES = 1e-12, 1000
#: A component with at most this part of the trace has no variance.
FLAT = 1e-12
#: Entries are at most so large.
LARGEST = 2.0**46
#: Bytes of vectors between JVM and Python at once.
BATCH_BYTES = 8 << 20
SHAPE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_rows(vectors: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(-LARGEST)), F.lit(LARGEST))) + shift
    return rows.where(F.col("v").isNotNull() & finite).select("vec_id", F.transform("v", whole).alias("x"))


def matrix(column: pa.ListArray, width: int, fill: int) -> np.ndarray:
    """Lists of numbers as rows; shorter ones are filled up."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) * width == len(flat):
        return flat.reshape(len(lengths), width)
    out = np.full((len(lengths), width), fill, np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


class Centred:
    """What a task needs to centre rows: the sums of all rows, in whole numbers."""

    def __init__(self, n: int, sums: list[int], fill: int):
        self.n, self.fill, self.width = n, fill, len(sums)
        origin = [(2 * s + n) // (2 * n) for s in sums]
        self.origin, self.left = np.array(origin, np.int64), np.array([s - n * o for s, o in zip(sums, origin, strict=True)], np.int64)

    def moved(self, column: pa.ListArray) -> np.ndarray:
        return matrix(column, self.width, self.fill) - self.origin

    def rows(self, column: pa.ListArray) -> np.ndarray:
        return self.moved(column) - self.left / self.n

    def deviations(self, column: pa.ListArray) -> list[int | None]:
        """Sums of (n x - S)^2, exact; whole numbers of any size where longs might not do."""
        moved = self.moved(column)
        most = (self.n * float(np.abs(moved).max(initial=0)) + float(np.abs(self.left).max(initial=0))) ** 2 * self.width
        if most < 2.0**62:
            return ((moved * self.n - self.left) ** 2).sum(1).tolist()
        exact = (sum((self.n * int(x) - int(r)) ** 2 for x, r in zip(row, self.left, strict=True)) for row in moved)
        return [d if d < 2**63 else None for d in exact]


def _summed(rows: DataFrame, function, cells: int) -> np.ndarray:
    """A function gives an array of ``cells`` numbers for a batch of rows; their sum over all batches, made on the executors."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = function(batch.column(0)).ravel()
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(total)], names=["cell", "value"])

    out = np.zeros(cells)
    for r in rows.select("x").mapInArrow(part, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r["cell"]] = r["value"]
    return out


def components(rows: DataFrame, centre: Centred, k: int = K, block: int | None = None, tolerance: float = TOLERANCE, passes: int = PASSES, seed: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues, unit eigenvectors as columns, passes) of the covariance of ``rows`` (with a column x), the k largest."""
    d = centre.width
    k, p = min(k, d), min(d, block or 2 * k)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, p)))[0]
    for done in range(1, passes + 1):

        def times(column: pa.ListArray, q: np.ndarray = q) -> np.ndarray:
            x = centre.rows(column)
            return x.T @ (x @ q)

        y = _summed(rows, times, d * p).reshape(d, p) / centre.n
        small = q.T @ y
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, image = q @ turn, y @ turn
        residuals = np.linalg.norm(image - ritz * values, axis=0)[:k]
        if (residuals <= tolerance * max(values[0], np.finfo(float).tiny)).all():
            return values[:k], ritz[:, :k] / np.linalg.norm(ritz[:, :k], axis=0), done
        q = np.linalg.qr(image)[0]
    raise RuntimeError(f"{passes} passes leave a residual of {residuals.max() / values[0]:.3g} of the largest eigenvalue")


def whiten(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT, **iteration) -> DataFrame:
    """A row for each vector and component: n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    rows = written(whole_rows(vectors, id_col, vector_col, scale, shift), "whiten-rows")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n or not width:
        return spark.createDataFrame([], SHAPE)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums a dimension and batch, each below 2^63 as a batch is small."""
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(matrix(batch.column(0), width, shift).sum(0))], names=["cell", "value"])

    with few_records(spark, max(16, min(10_000, BATCH_BYTES // (8 * width)))):
        told = rows.select("x").mapInArrow(parts, "cell long, value long").groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).orderBy("cell").collect()
        centre = Centred(n, [int(r["value"]) for r in told], shift)
        values, vectors_, _ = components(rows, centre, k, **iteration)
        trace = float(_summed(rows, lambda column: (centre.rows(column) ** 2).sum(0), width).sum()) / n
        keep = values > FLAT * trace
        values, vectors_ = values[keep], vectors_[:, keep]
        c = len(values)
        if not c:
            return spark.createDataFrame([], SHAPE)
        map_ = vectors_ / np.sqrt(values)

        def products(column: pa.ListArray) -> np.ndarray:
            w = centre.rows(column) @ map_
            return w.T @ w

        off = float(np.abs(_summed(rows, products, c * c).reshape(c, c) / n - np.eye(c)).max())
        explained = values / trace

        def told_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = batch.num_rows
                if m:
                    x = batch.column(1)
                    columns = [
                        batch.column(0).take(pa.array(np.repeat(np.arange(m), c))), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), m)), pa.array(np.full(m * c, n)),
                        pa.array(centre.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), c))), pa.array((centre.rows(x) @ map_).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * c, off)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SHAPE.split(", ")])

        return finished(rows.select("vec_id", "x").mapInArrow(told_rows, SHAPE), "whiten-result", rows)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
