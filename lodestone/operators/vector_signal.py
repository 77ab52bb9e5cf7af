"""The vector signal: cosine between chunks, the best per earlier change, the best of those."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from lodestone import constants as C
from lodestone.functions import vectors as V
from lodestone.plans.cluster import ship

#: So many query chunks go out at once; more are taken in blocks of at most about this size, whole queries each.
QUERY_BLOCK = 8_000
#: A task holds a matrix of at most so many similarities.
CELLS = 2_000_000
#: Of rows that may still be among the best, a task keeps at most so many before it cuts them to k of each query.
KEPT_ROWS = 1_000_000


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of one matrix, each of length one; a vector of another dimension is an error."""
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes != dim).any():
        raise ValueError(f"embedding dimension {int(sizes[sizes != dim][0])}, expected {dim}")
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(invalid="ignore"):
        return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def check(query: DataFrame, chunks: DataFrame) -> None:
    """Raises for a query without chunks, an empty corpus, and times without a zone."""
    for name, df in (("query", query), ("chunks", chunks)):
        if isinstance(df.schema["created_at"].dataType, TimestampNTZType):
            raise ValueError(f"created_at of {name} has no time zone")
    if query.isEmpty():
        raise ValueError("the query has no chunks")
    if chunks.filter("in_corpus and embedding is not null").isEmpty():
        raise ValueError("the corpus has no chunks")


def chunk_scores(query: DataFrame, chunks: DataFrame, *, dim: int = C.EMBEDDING_DIM, places: int = 6, k: int | None = None) -> DataFrame:
    """(query_pr, query_chunk, pr_id, score): for each query chunk, the best chunk of each strictly earlier change of its repo.
    If chunks have a column chunk, best_chunk names the best (the least of those as good). k: only the k best changes of
    a query chunk need to come out right; a task then sends on no more of each.

    query: query_pr, query_chunk, repo_id, created_at, embedding. chunks: pr_id, repo_id, created_at, in_corpus, embedding.
    Chunks without a vector never match; a vector of another dimension is an error. Queries are a stated set: their unit
    vectors go out in blocks of about QUERY_BLOCK, and each batch of chunks is one matrix product with a block; chunks are
    not shuffled.
    """
    named = "chunk" in chunks.columns
    left, right = _sides(query, chunks)
    if k is not None:
        return _nearest(left, right, dim, places, k, "query_chunk", named)
    out = _union(_against(own, right, dim, places) for own in _blocks(left))
    best = out.groupBy("query_pr", "query_chunk", "pr_id").agg(F.max(F.struct("score", (-F.col("best_chunk")).alias("minus"))).alias("b"))
    return best.select("query_pr", "query_chunk", "pr_id", "b.score", *([(-F.col("b.minus")).alias("best_chunk")] if named else []))


def best_changes(query: DataFrame, chunks: DataFrame, k: int, *, dim: int = C.EMBEDDING_DIM, places: int = 6) -> DataFrame:
    """(query_pr, pr_id, score, rank): the k best earlier changes of each query by the best pair of their chunks. Arguments as for
    chunk_scores; what is shuffled is k rows of each query from a task, not a row for each pair of changes."""
    left, right = _sides(query, chunks)
    return top_per(_nearest(left, right, dim, places, k, "query_pr", False).select("query_pr", "pr_id", "score"), ["query_pr"], k)


def pair_scores(pairs: DataFrame, query: DataFrame, chunks: DataFrame, *, dim: int = C.EMBEDDING_DIM, places: int = 6) -> DataFrame:
    """(query_pr, pr_id, score, best_chunk) of the given pairs (query_pr, pr_id) of a query and an earlier change: as chunk_scores
    aggregated by query, for these pairs only. Pairs meet their change's chunks in a join; the queries' vectors go out in blocks."""
    left, right = _sides(query, chunks)
    held = right.groupBy(F.col("pr_id")).agg(F.collect_list(F.struct("repo", "at", "chunk", "embedding")).alias("held"))
    asks = pairs.select(F.col("query_pr").cast("long"), F.col("pr_id").cast("long")).distinct()
    asks = asks.groupBy("pr_id").agg(F.collect_list("query_pr").alias("queries"))
    met = asks.join(held, "pr_id").select("pr_id", "queries", *[F.col(f"held.{c}").alias(c) for c in ("repo", "at", "chunk", "embedding")])
    return _union(_paired(own, met, dim, places) for own in _blocks(left))


def top_pairs(query: DataFrame, chunks: DataFrame, *, dim: int = C.EMBEDDING_DIM, places: int = 6, k: int = C.MEAN_TOP_K) -> DataFrame:
    """(query_pr, pr_id, best, mean, query_chunk, best_chunk) of every pair of a query and a strictly earlier change: of all pairs of
    their chunks the best, the mean of the k best, and which is the best (the least query chunk of those as good, then the least
    chunk). Arguments as for chunk_scores; a vector of length 0 gives NaN, which counts as the best.

    Chunks are shuffled once, by their change and in its order, so a task makes the rows of its changes and no pair is shuffled.
    It holds the k best of one slice and of the change that goes on in the next one, never a change's chunks or pairs."""
    left, right = (df.filter("at is not null and size(array_compact(embedding)) = size(embedding)") for df in _sides(query, chunks))
    right = right.repartition(2 * right.sparkSession.sparkContext.defaultParallelism, "pr_id").sortWithinPartitions("pr_id", "chunk")
    return _union(_tops(own, right, dim, places, k) for own in _blocks(left))


def _sides(query: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    named = "chunk" in chunks.columns
    right = chunks.filter("in_corpus and embedding is not null").select(
        F.col("pr_id").cast("long").alias("pr_id"), F.col("repo_id").cast("long").alias("repo"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"),
        (F.col("chunk") if named else F.lit(0)).cast("long").alias("chunk"), "embedding")
    left = query.filter("embedding is not null").select(
        F.col("query_pr").cast("long").alias("query_pr"), F.col("query_chunk").cast("long").alias("query_chunk"), F.col("repo_id").cast("long").alias("repo"),
        F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), "embedding")
    return left, right


def _blocks(left: DataFrame) -> Iterator[DataFrame]:
    many = -(-left.count() // QUERY_BLOCK)
    for b in range(max(1, many)):
        yield left if many <= 1 else left.filter(F.pmod(F.xxhash64("query_pr"), F.lit(many)) == b)


def _union(parts: Iterator[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _shared(block: DataFrame, dim: int):
    """A block of queries in order of time, on all executors: unit vectors and keys."""
    t = block.toArrow().combine_chunks().sort_by([("at", "ascending"), ("query_pr", "ascending"), ("query_chunk", "ascending")]).combine_chunks()
    vectors = matrix(t.column("embedding").combine_chunks(), dim) if t.num_rows else np.zeros((0, dim))
    keys = {c: t.column(c).to_numpy() for c in ("query_pr", "query_chunk", "repo", "at")}
    return block.sparkSession.sparkContext.broadcast((vectors, keys))


def _slices(batch: pa.RecordBatch, wide: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose similarities with so many queries are CELLS at most."""
    step = max(1, CELLS // max(1, wide))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def _against(block: DataFrame, chunks: DataFrame, dim: int, places: int) -> DataFrame:
    """All pairs of a query chunk and an earlier change, by the best of a slice's chunks."""
    shared = _shared(block, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, of = shared.value
        for batch in (s for whole in batches if len(q) for s in _slices(whole, len(q))):
            own = {c: batch.column(c).to_numpy() for c in ("pr_id", "repo", "at", "chunk")}
            order = np.lexsort((own["chunk"], own["pr_id"]))
            own = {c: v[order] for c, v in own.items()}
            near = np.round(matrix(batch.column("embedding"), dim)[order] @ q.T, places)
            fit = (own["repo"][:, None] == of["repo"]) & (own["at"][:, None] < of["at"]) & (own["pr_id"][:, None] != of["query_pr"])
            near = np.where(fit & ~np.isnan(near), near, -np.inf)
            first = np.flatnonzero(np.diff(own["pr_id"], prepend=own["pr_id"][0] - 1))
            best = np.maximum.reduceat(near, first, axis=0)  # change by query chunk
            # the first row that is as good as its change's best
            rows = np.arange(len(near))[:, None]
            at = np.minimum.reduceat(np.where(near == np.repeat(best, np.diff(first, append=len(near)), axis=0), rows, len(near)), first, axis=0)
            pr = own["pr_id"][first]
            i, j = np.nonzero(best > -np.inf)
            yield pa.RecordBatch.from_arrays(
                [pa.array(of["query_pr"][j]), pa.array(of["query_chunk"][j]), pa.array(pr[i]), pa.array(best[i, j]), pa.array(own["chunk"][at[i, j]])],
                names=["query_pr", "query_chunk", "pr_id", "score", "best_chunk"])

    ship(chunks.sparkSession)
    return chunks.mapInArrow(run, "query_pr long, query_chunk long, pr_id long, score double, best_chunk long")


class Best:
    """The k best changes of each of n queries among the rows that a task has seen: a change counts by its best row, the least
    chunk in a tie; of changes that are as good the least id comes first. floor: what a row must reach to be of use."""

    def __init__(self, k: int, n: int):
        self.k, self.floor, self.rows, self.held, self.limit = k, np.full(n, -np.inf), [], 0, max(KEPT_ROWS, 2 * k * n)

    def add(self, query: np.ndarray, pr: np.ndarray, score: np.ndarray, chunk: np.ndarray) -> None:
        self.rows.append((query, pr, score, chunk))
        self.held += len(query)
        if self.held > self.limit:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.rows:
            self.rows = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        query, pr, score, chunk = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((chunk, -score, pr, query))
        query, pr, score, chunk = query[order], pr[order], score[order], chunk[order]
        once = np.append(True, (query[1:] != query[:-1]) | (pr[1:] != pr[:-1]))[: len(query)]
        query, pr, score, chunk = query[once], pr[once], score[once], chunk[once]
        order = np.lexsort((pr, -score, query))
        query, pr, score, chunk = query[order], pr[order], score[order], chunk[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        last = nth == self.k - 1
        self.floor[query[last]] = score[last]
        kept = nth < self.k
        self.rows, self.held = [(query[kept], pr[kept], score[kept], chunk[kept])], int(kept.sum())
        return self.rows[0]


def _nearest(left: DataFrame, right: DataFrame, dim: int, places: int, k: int, by: str, named: bool) -> DataFrame:
    """(query_pr, query_chunk if by is that, pr_id, score, best_chunk if named) of what may be among the k best changes by the best
    chunk: a task sends on k of each query at most. Chunks come in no more tasks than twice the cores, so the rows grow with
    the queries alone."""
    tasks = 2 * right.sparkSession.sparkContext.defaultParallelism
    out = _union(_best_of(own, right.coalesce(tasks), dim, places, k, by) for own in _blocks(left))
    keys = ["query_pr", "query_chunk"] if by == "query_chunk" else ["query_pr"]
    best = out.groupBy(*keys, "pr_id").agg(F.max(F.struct("score", (-F.col("best_chunk")).alias("minus"))).alias("b"))
    return best.select(*keys, "pr_id", "b.score", *([(-F.col("b.minus")).alias("best_chunk")] if named else []))


def _best_of(block: DataFrame, chunks: DataFrame, dim: int, places: int, k: int, by: str) -> DataFrame:
    shared = _shared(block, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, of = shared.value
        if not len(q):
            return
        names, which = np.unique(np.rec.fromarrays([of["query_pr"], of["query_chunk"] if by == "query_chunk" else np.zeros_like(of["query_pr"])]), return_inverse=True)
        best = Best(k, len(names))
        for batch in (s for whole in batches for s in _slices(whole, len(q))):
            own = {c: batch.column(c).to_numpy() for c in ("pr_id", "repo", "at", "chunk")}
            begin = int(np.searchsorted(of["at"], own["at"].min(), side="right"))  # queries before that have no earlier chunk here
            if begin == len(q):
                continue
            near = matrix(batch.column("embedding"), dim) @ q[begin:].T
            i, j = np.nonzero(near >= best.floor[which[begin:]] - 10.0**-places)
            score, j = np.round(near[i, j], places), j + begin
            fit = (own["repo"][i] == of["repo"][j]) & (own["at"][i] < of["at"][j]) & (own["pr_id"][i] != of["query_pr"][j]) & (score >= best.floor[which[j]])
            i, j, score = i[fit], j[fit], score[fit]
            best.add(which[j], own["pr_id"][i], score, own["chunk"][i])
        query, pr, score, chunk = best.cut()
        for a in range(0, len(query), 50_000):
            n = names[query[a : a + 50_000]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(n["f0"]), pa.array(n["f1"]), pa.array(pr[a : a + 50_000]), pa.array(score[a : a + 50_000]), pa.array(chunk[a : a + 50_000])],
                names=["query_pr", "query_chunk", "pr_id", "score", "best_chunk"])

    ship(chunks.sparkSession)
    return chunks.mapInArrow(run, "query_pr long, query_chunk long, pr_id long, score double, best_chunk long")


def _paired(block: DataFrame, met: DataFrame, dim: int, places: int) -> DataFrame:
    shared = _shared(block, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, of = shared.value
        order = np.argsort(of["query_pr"], kind="stable")
        pr_of = of["query_pr"][order]
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                asks = batch.column("queries")[row].values.to_numpy()
                lo, hi = np.searchsorted(pr_of, asks), np.searchsorted(pr_of, asks, side="right")
                j = order[np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
                if not len(j):
                    continue
                pr, repo, at, chunk = batch.column("pr_id")[row].as_py(), *(batch.column(c)[row].values.to_numpy() for c in ("repo", "at", "chunk"))
                near = np.round(matrix(batch.column("embedding")[row].values, dim) @ q[j].T, places)
                fit = (repo[:, None] == of["repo"][j]) & (at[:, None] < of["at"][j]) & (of["query_pr"][j] != pr) & ~np.isnan(near)
                i, c = np.nonzero(fit)
                out.append((of["query_pr"][j][c], np.full(len(i), pr), near[i, c], chunk[i]))
            if out:
                query, pr, score, chunk = (np.concatenate(x) for x in zip(*out, strict=True))
                order_ = np.lexsort((chunk, -score, pr, query))
                query, pr, score, chunk = query[order_], pr[order_], score[order_], chunk[order_]
                once = np.append(True, (query[1:] != query[:-1]) | (pr[1:] != pr[:-1]))[: len(query)]
                yield pa.RecordBatch.from_arrays([pa.array(x[once]) for x in (query, pr, score, chunk)], names=["query_pr", "pr_id", "score", "best_chunk"])

    ship(met.sparkSession)
    return met.mapInArrow(run, "query_pr long, pr_id long, score double, best_chunk long")


def _folded(layers: list[np.ndarray], tags: list[np.ndarray], first: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of segments of rows that begin at first: by column the k largest values of all layers, in falling order, and the tags of the
    largest, the first of those as large. layers[0] is nowhere less than the others."""
    sizes = np.diff(first, append=len(layers[0]))
    tops, out = [np.full((len(first), layers[0].shape[1]), -np.inf) for _ in range(k)], [t[first] for t in tags]
    for p in range(sizes.max()):
        on = np.flatnonzero(sizes > p)
        rows, held = first[on] + p, [t[on] for t in tops]
        best = layers[0][rows]
        more = best > held[0]
        for to, tag in zip(out, tags, strict=True):
            to[on] = np.where(more, tag[rows], to[on])
        for x in (best, *(y[rows] for y in layers[1:])):
            _insert(held, x)
        for to, t in zip(tops, held, strict=True):
            to[on] = t
    return tops, out


def _insert(tops: list[np.ndarray], x: np.ndarray) -> None:
    for t in range(len(tops) - 1, 0, -1):
        np.maximum(tops[t], np.minimum(tops[t - 1], x), out=tops[t])
    np.maximum(tops[0], x, out=tops[0])


def _tops(block: DataFrame, chunks: DataFrame, dim: int, places: int, k: int) -> DataFrame:
    """Of each query of a block and each change: see top_pairs. Chunks come with each change's in one run of rows, in order."""
    shared = _shared(block, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, of = shared.value
        if not len(q):
            return
        # whole queries in order of their last chunk: those that end before a slice begins are left out
        names, which = np.unique(of["query_pr"], return_inverse=True)
        latest = np.full(len(names), of["at"].min())
        np.maximum.at(latest, which, of["at"])
        order = np.lexsort((of["query_chunk"], which, latest[which]))
        q, of = q[order], {c: v[order] for c, v in of.items()}
        starts = np.flatnonzero(np.diff(of["query_pr"], prepend=of["query_pr"][0] - 1))
        names, latest = of["query_pr"][starts], latest[which[order][starts]]

        def rows(pr, begin, tops, a, b) -> pa.RecordBatch:
            n, total = sum(t > -np.inf for t in tops), sum(np.where(t > -np.inf, t, 0.0) for t in tops)
            i, j = np.nonzero(n)
            best, mean = tops[0][i, j] + 0.0, np.round(total[i, j] / n[i, j] + 1e-9, places) + 0.0
            best[best == np.inf] = mean[mean == np.inf] = np.nan
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (names[begin:][i], pr[j], best, mean, a[i, j], b[i, j])], names=["query_pr", "pr_id", "best", "mean", "query_chunk", "best_chunk"])

        last = None  # the change that the slice before ended with: it may go on
        for batch in (s for whole in batches for s in _slices(whole, len(q))):
            own = {c: batch.column(c).to_numpy() for c in ("pr_id", "repo", "at", "chunk")}
            begin = int(np.searchsorted(latest, own["at"].min(), side="right"))
            if last is not None and last[0][0] == own["pr_id"][0]:
                begin = min(begin, last[1])
            if begin == len(names):
                continue
            past = starts[begin]
            near = np.round(matrix(batch.column("embedding"), dim) @ q[past:].T, places)
            near[np.isnan(near)] = np.inf
            near[(own["repo"][:, None] != of["repo"][past:]) | (own["at"][:, None] >= of["at"][past:]) | (own["pr_id"][:, None] == of["query_pr"][past:])] = -np.inf
            first = np.flatnonzero(np.diff(own["pr_id"], prepend=own["pr_id"][0] - 1))
            pr = own["pr_id"][first]
            tops, (b,) = _folded([near], [np.broadcast_to(own["chunk"][:, None], near.shape)], first, k)  # change by query chunk
            turned = [np.ascontiguousarray(x.T) for x in (*tops, b)]
            chunk = np.broadcast_to(of["query_chunk"][past:, None], turned[0].shape)
            tops, (a, b) = _folded(turned[:k], [chunk, turned[k]], starts[begin:] - past, k)  # query by change
            if last is not None and last[0][0] == pr[0]:
                skip, held, a0, b0 = last[1] - begin, last[2], last[3][:, 0], last[4][:, 0]
                a1, b1, now = a[skip:, 0], b[skip:, 0], [t[skip:, 0] for t in tops]
                sooner = (held[0][:, 0] > now[0]) | (held[0][:, 0] == now[0]) & ((a0 < a1) | (a0 == a1) & (b0 < b1))
                a1[sooner], b1[sooner] = a0[sooner], b0[sooner]
                for t in held:
                    _insert(now, t[:, 0])
            elif last is not None:
                yield rows(*last)
            if len(pr) > 1:
                yield rows(pr[:-1], begin, [t[:, :-1] for t in tops], a[:, :-1], b[:, :-1])
            last = (pr[-1:], begin, [t[:, -1:].copy() for t in tops], a[:, -1:].copy(), b[:, -1:].copy())
        if last is not None:
            yield rows(*last)

    ship(chunks.sparkSession)
    return chunks.mapInArrow(run, "query_pr long, pr_id long, best double, mean double, query_chunk long, best_chunk long")


def top_per(scores: DataFrame, by: list[str], k: int, score: str = "score", tie: str = "pr_id") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def aggregate(best: DataFrame, strategy: str = "max", by: str = "query_pr") -> DataFrame:
    """(query_pr, pr_id, score, chunk_hits) over a change's chunk lists. max, or mean_top_k: the mean of up to MEAN_TOP_K. With
    max, and best_chunk in best, also the best chunk of all."""
    if strategy not in ("max", "mean_top_k"):
        raise ValueError(f"unknown strategy {strategy!r}")
    score = F.max("score") if strategy == "max" else V.top_mean(F.collect_list("score"), C.MEAN_TOP_K)
    chunk = [(-F.max(F.struct("score", (-F.col("best_chunk")).alias("m")))["m"]).alias("best_chunk")] if "best_chunk" in best.columns else []
    return best.groupBy(by, "pr_id").agg(score.alias("score"), F.count("*").alias("chunk_hits"), *chunk)


def signal(query: DataFrame, chunks: DataFrame, *, dim: int = C.EMBEDDING_DIM, strategy: str = "max", k: int = C.VECTOR_TOP_K) -> DataFrame:
    """The k best of each query chunk, then one score per earlier change. Filters come before the cut. What check rejects is an
    error."""
    check(query, chunks)
    best = top_per(chunk_scores(query, chunks, dim=dim, k=k), ["query_pr", "query_chunk"], k)
    return aggregate(best.drop("best_chunk"), strategy)
