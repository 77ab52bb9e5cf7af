"""Centroid clustering by weighted deduplication.

Vectors are quantised to integers, identical ones become one row with a multiplicity, and Lloyd's rounds run over the
distinct vectors with sums of whole numbers weighted by it, so every result is exact and depends on no order. Assignments
are joined back to the vectors' ids at the end. A round sends the centroids out and gets one row of sums for each
centroid back, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lodestone.llm._util import discard, map_arrow, materialize

SCALE = 256
DIM = 64
CLUSTERS = 40
ROUNDS = 5
SEED = "2"
#: Quantised components beyond this could have squared distances that fit no long.
LARGEST = 1 << 27
#: A vector that makes up one in so many rows is hot; there are at most so many of them.
HOT = 1_000


def finite(vector: Column) -> Column:
    """Whether a vector holds neither nulls nor non-finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; one that is out of range is an error."""
    q = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return F.when(F.exists(q, lambda x: F.abs(x) > LARGEST), F.raise_error(F.lit(f"a component is beyond {LARGEST} / {scale}"))).otherwise(F.transform(q, lambda x: x.cast("int")))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (the first in a tie) and the squared distance, exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:  # whole numbers that doubles hold exactly
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        d = np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ c.T) + np.einsum("ij,ij->i", c, c)
    else:
        d = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at].astype(np.int64)


def rows_of(batch: pa.RecordBatch) -> np.ndarray:
    q = batch.column("q")
    return q.flatten().to_numpy().astype(np.int64).reshape(len(q), -1)


def sums(distinct: DataFrame, centroids: np.ndarray) -> dict[int, Row]:
    """For each centroid that is the nearest of a vector: how many vectors it is of (n) and their componentwise sum (s0, s1, ...)."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, n = rows_of(batch), batch.column("n").to_numpy()
            at, _ = nearest(x, centroids)
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            total[at[order][first]] += np.add.reduceat((x * n[:, None])[order], first, axis=0)
            count[at[order][first]] += np.add.reduceat(n[order], first)
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(count[own]), *map(pa.array, total[own].T)], names=["cluster", "n", *[f"s{i}" for i in range(dim)]])

    parts = map_arrow(distinct.select("q", "n"), run, "cluster int, n long, " + ", ".join(f"s{i} long" for i in range(dim)))
    return {r.cluster: r for r in parts.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in parts.columns[1:]]).collect()}


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(key, n, cluster, distance) of each distinct vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, d = nearest(rows_of(batch), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(at, pa.int32()), pa.array(d)], names=["key", "n", "cluster", "distance"])

    return map_arrow(distinct.select("key", "n", "q"), run, "key binary, n long, cluster int, distance long")


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of every vector of dim components, none of them null or
    non-finite; all other rows, null vectors too, have none.

    Centroids start as the kept vectors of smallest sha256 of ``seed:id`` (id null: empty; rows of one id: the lesser
    vector first); with fewer than ``clusters`` vectors there are fewer of them. Distances are squared; a tie goes to the
    smaller number; an empty centroid stays where it is. Repeated rows count each on its own. No rows, or none kept: no rows.
    A component beyond LARGEST / scale is an error. Other columns are not read.
    """
    spark = vectors.sparkSession
    own = vectors.filter(finite(F.col(vector_col)) & (F.size(vector_col) == dim)).select(F.col(id_col).alias("vec_id"), quantised(F.col(vector_col), scale).alias("q"))
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = own.select(place.alias("place"), "q").orderBy("place", "q").limit(clusters).collect()
    kind = own.schema["vec_id"].dataType.simpleString()
    if not start:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<bigint>")
    centroids = np.array([r.q for r in start], np.int64)
    key = F.unhex(F.sha2(F.array_join("q", ","), 256))
    distinct = materialize(own.groupBy("q").agg(F.count("*").alias("n")).withColumn("key", key), "cluster-distinct")
    for _ in range(rounds):
        for k, r in sums(distinct, centroids).items():
            centroids[k] = [s // r.n for s in r[2:]]  # rounds down, below 0 too
    done = materialize(assigned(distinct, centroids), "cluster-assigned")
    discard(distinct)
    whole = done.groupBy("cluster").agg(F.sum(F.col("n") * F.col("distance")).alias("cluster_inertia"), F.sum("n").alias("n")).collect()
    inertia, count = sum(r.cluster_inertia for r in whole), sum(r.n for r in whole)
    per = [(r.cluster, r.cluster_inertia, inertia, centroids[r.cluster].tolist()) for r in whole]
    per = spark.createDataFrame(per, "cluster int, cluster_inertia long, inertia long, centroid array<bigint>")  # a row for each centroid
    # hot vectors, at most HOT, are looked up where their rows are; in the join those rows get keys that match nothing
    hot = done.filter(F.col("n") * HOT >= count).select(F.col("key").alias("hot"), F.col("cluster").alias("hot_cluster"), F.col("distance").alias("hot_distance"))
    rows = own.select("vec_id", key.alias("key")).join(F.broadcast(hot), F.col("key") == F.col("hot"), "left")
    rows = rows.withColumn("key", F.when(F.col("hot").isNull(), F.col("key")).otherwise(F.coalesce(F.col("vec_id").cast("string"), F.lit("")).cast("binary")))
    rows = rows.join(done.select("key", "cluster", "distance"), "key", "left")
    rows = rows.select("vec_id", F.coalesce("hot_cluster", "cluster").alias("cluster"), F.coalesce("hot_distance", "distance").alias("distance"))
    return rows.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(vectors: DataFrame) -> DataFrame:
    """Contract columns: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    c = cluster(vectors)
    return c.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


def oracle() -> str:
    """The same by plain rounds over all vectors."""
    far = "list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    out = [rf"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), q) - 1)::INTEGER AS k, q FROM v
       QUALIFY row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), q) <= {CLUSTERS})"""]
    for r in range(ROUNDS + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT row_no, any_value(vec_id) AS vec_id, any_value(q) AS q, min(struct_pack(d, k)) AS best\n"
                   f"  FROM (SELECT v.row_no, v.vec_id, v.q, {far} AS d, c.k FROM (SELECT *, row_number() OVER () AS row_no FROM v) v, c{r} c) GROUP BY row_no)")  # fmt: skip
        if r < ROUNDS:
            out.append(f"m{r} AS (SELECT best.k AS k, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {DIM + 1}) t(i) GROUP BY 1, 2)")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN\n"
                       f"  (SELECT k, list((s - ((s % n + n) % n)) // n ORDER BY i) AS q FROM m{r} GROUP BY k) m USING (k))")  # fmt: skip
    last = f"a{ROUNDS}"
    return ",\n".join(out) + f"""
SELECT vec_id, best.k AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM {last} a JOIN c{ROUNDS} c ON c.k = best.k"""
