"""Whitening of embeddings: moments by Welford's updates, merged in parallel, then a symmetric QR eigen-solve.

Every task streams its vectors through rank-one updates of count, mean and centred products; tasks' moments meet by the
parallel update formula, first in a fixed number of merging tasks, then on the driver, which sees that many matrices of
the dimension squared. The eigenvectors come from a Householder tridiagonalisation and implicit QR steps.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._util import map_arrow
from lodestone.llm.clustering import finite

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: So many tasks merge the moments of all others.
MERGERS = 16
#: An eigenvalue below this share of the largest is no variance but rounding.
NO_VARIANCE = 1e-12
#: Scaled entries beyond this are no whole numbers that a double tells apart.
LARGEST = 1 << 52


@dataclass
class Moments:
    """Count, mean and sum of centred products of vectors."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def none(cls, dim: int) -> Moments:
        return cls(0, np.zeros(dim), np.zeros((dim, dim)))

    def add(self, rows: np.ndarray) -> None:
        """Welford: one rank-one update a vector."""
        mean, products, n = self.mean, self.products, self.n
        for x in rows:
            n += 1
            before = x - mean
            mean += before / n
            products += np.outer(before, x - mean)
        self.n = n

    def merge(self, other: Moments) -> None:
        """The moments of both lists of vectors together."""
        n = self.n + other.n
        if not other.n:
            return
        apart = other.mean - self.mean
        self.mean = self.mean + apart * (other.n / n)
        self.products = self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n)
        self.n = n

    def covariance(self) -> np.ndarray:
        return (self.products + self.products.T) / (2 * self.n)


STATE = "task int, n long, mean array<double>, products array<double>"


def moments(vectors: DataFrame, column: str, dim: int, read: Callable[[np.ndarray], np.ndarray]) -> Moments:
    """The moments of what ``read`` makes of the batches of an array column; dim is how long its rows are."""

    def state(task: int, m: Moments) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([m.n]), pa.array([m.mean]), pa.array([m.products.ravel()])], names=["task", "n", "mean", "products"])

    def taken(batch: pa.RecordBatch) -> Iterator[tuple[int, Moments]]:
        for r in batch.to_pylist():
            yield r["task"], Moments(r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(dim, dim))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Moments.none(dim)
        for batch in batches:
            if batch.num_rows:
                m.add(read(matrix(batch.column(column))))
        if m.n:
            yield state(TaskContext.get().partitionId(), m)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sorted((x for batch in batches for x in taken(batch)), key=lambda x: x[0])
        if own:
            whole = Moments.none(dim)
            for _, m in own:
                whole.merge(m)
            yield state(own[0][0], whole)

    parts = map_arrow(map_arrow(vectors.select(column), gather, STATE).repartition(MERGERS, "task"), meet, STATE)
    whole = Moments.none(dim)
    for _, m in sorted((x for batch in parts.toArrow().to_batches() for x in taken(batch)), key=lambda x: x[0]):
        whole.merge(m)
    return whole


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix: Householder reflections to three diagonals,
    then implicit QR steps with Wilkinson's shift."""
    a, n = a.astype(np.float64).copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        size = np.linalg.norm(v)
        if not size:
            continue
        v /= size
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    d, e = np.diag(a).copy(), np.diag(a, -1).copy()
    small = lambda i: abs(e[i]) <= np.finfo(float).eps * (abs(d[i]) + abs(d[i + 1]))
    last = n - 1
    while last > 0:
        if small(last - 1):
            last -= 1
            continue
        first = last - 1
        while first > 0 and not small(first - 1):
            first -= 1
        half = (d[last - 1] - d[last]) / 2
        shift = d[last] - e[last - 1] ** 2 / (half + math.copysign(math.hypot(half, e[last - 1]), half))
        x, z = d[first] - shift, e[first]
        for k in range(first, last):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > first:
                e[k - 1] = r
            upper, lower, side = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * upper + 2 * c * s * side + s * s * lower, s * s * upper - 2 * c * s * side + c * c * lower
            e[k] = (c * c - s * s) * side + c * s * (lower - upper)
            if k < last - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[:, k], q[:, k + 1] = c * q[:, k] + s * q[:, k + 1], c * q[:, k + 1] - s * q[:, k]
    order = np.argsort(-d, kind="stable")
    return d[order], q[:, order]


def scaled(vector: Column) -> Column:
    """floor(SCALE * x) of each entry: what it becomes, less OFFSET, which changes neither deviations nor covariances."""
    z = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return F.when(F.exists(vector, lambda x: F.abs(x.cast("double") * SCALE) > LARGEST), F.raise_error(F.lit(f"an entry is beyond {LARGEST} / {SCALE}"))).otherwise(z)


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each vector without null or non-finite entries and
    each component, the strongest first; rows with other vectors, null ones too, have none.

    The fit list is all remaining vectors. Where they differ in length, those of the most frequent one remain (the
    longest in a tie). A component without variance is 0 for every vector, and is left out of identity_error; a signed
    direction is free and the same for all rows. Repeated rows count each on its own. No rows: no rows. An entry beyond
    LARGEST / SCALE, and a deviation that fits no long, is an error. Other columns are not read.
    """
    spark = vectors.sparkSession
    whole = vectors.filter(finite(F.col(vector_col)) & (F.size(vector_col) > 0))
    lengths = whole.groupBy(F.size(vector_col).alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not lengths:
        return spark.createDataFrame([], schema)
    dim = lengths[0].dim
    own = whole.filter(F.size(vector_col) == dim).select(F.col(id_col).alias("vec_id"), scaled(F.col(vector_col)).alias("z"))
    total = own.agg(F.count("*").alias("n"), *[F.sum(F.col("z")[i]).alias(f"s{i}") for i in range(dim)]).first()
    n, s = total.n, np.array(total[1:], np.int64)
    values, directions = symmetric_qr(moments(own, "z", dim, lambda z: z.astype(np.float64)).covariance())
    top = min(components, dim)
    live = np.arange(top)[values[:top] > NO_VARIANCE * max(values[0], 0)]
    weights = np.zeros((dim, top))
    weights[:, live] = directions[:, live] / np.sqrt(values[live])
    explained = values[:top] / values.sum() if values.sum() > 0 else np.zeros(top)

    def project(z: np.ndarray) -> np.ndarray:
        return (n * z - s) / n @ weights

    seen = moments(own, "z", top, project).covariance()[np.ix_(live, live)]
    error = float(np.abs(seen - np.eye(len(live))).max(initial=0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z = matrix(batch.column("z"))
            far = n * z - s
            if dim * float(np.abs(far).max()) ** 2 >= 2.0**63 or n * float(np.abs(z).max()) >= 2.0**62:
                raise OverflowError("a deviation fits no long")
            rows, here = np.repeat(np.arange(len(z)), top), len(z) * top
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, top + 1, dtype=np.int32), len(z))), pa.array(np.full(here, n)),
                 pa.array((far * far).sum(axis=1)[rows]), pa.array(project(z).ravel()), pa.array(np.tile(explained, len(z))), pa.array(np.full(here, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_arrow(own, run, schema)
