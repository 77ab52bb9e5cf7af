"""Retrieval quality: recall, reciprocal rank, bootstrap intervals, agreement of judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions import vectors as V

MOST_QUERIES = 100_000


def pool(*runs: DataFrame, per_run: int = 6) -> DataFrame:
    """Distinct (query_pr, pr_id) of the best of each run (query_pr, pr_id, rank)."""
    out = runs[0].filter(F.col("rank") <= per_run).select("query_pr", "pr_id")
    for r in runs[1:]:
        out = out.unionByName(r.filter(F.col("rank") <= per_run).select("query_pr", "pr_id"))
    return out.distinct()


def pool_runs(normalised: DataFrame, runs: tuple[tuple[float, float, float], ...] = C.POOL_RUNS, per_run: int = 6) -> DataFrame:
    """(query_pr, pr_id) that are among the best of any run, each run being a weighting of the same normalised candidates. One
    pass: all runs rank inside the partitioning by query that the candidates already have. No rows in: no rows out."""
    ranks = []
    for weights in runs:
        score = F.round(V.weighted(F.col("vector_norm"), F.col("file_norm"), F.col("bm25_norm"), weights), 6)
        ranks.append(F.row_number().over(Window.partitionBy("query_pr").orderBy(score.desc(), "pr_id")))
    ranked = normalised.select("query_pr", "pr_id", *[r.alias(f"_rank{i}") for i, r in enumerate(ranks)])
    return ranked.filter(F.least(*[f"_rank{i}" for i in range(len(runs))]) <= per_run).select("query_pr", "pr_id")


def weight_grid(steps: int = 10) -> list[tuple[int, int, int]]:
    """All weightings of three signals in whole steps, the vector's share falling."""
    return [(i, j, steps - i - j) for i in range(steps, -1, -1) for j in range(steps - i, -1, -1)]


def weight_search(normalised: DataFrame, judgments: DataFrame, tune: Column, *, steps: int = 10, k: int = C.RESULTS_RETURNED, least_grade: int = 2) -> DataFrame:
    """(w_vector, w_file, w_bm25, tune_queries, holdout_queries, tune_recall, holdout_recall, chosen), one row a weighting.

    The mean recall of the best k over the queries for which tune holds (a condition on query_pr) and over the rest; chosen
    is the best by the tune half alone, ties going to the greater vector's, then file's share; none is chosen without a
    tune query. Only queries with a relevant change count; relevant changes that are no candidate are never found.

    A query's candidates are few (the signals' cuts), so they are one array, and all weightings are scored from it: the
    candidates are shuffled by query once, whatever the grid. Null judgments count as not relevant, repeated ones once. An
    empty table gives each weighting nulls for its recalls.
    """
    spark = normalised.sparkSession
    rel = judgments.filter(F.col("grade") >= least_grade).select("query_pr", "pr_id").distinct()
    rel = rel.groupBy("query_pr").agg(F.count("*").alias("relevant"), F.collect_set("pr_id").alias("wanted"))
    named = F.struct("pr_id", "vector_norm", "file_norm", "bm25_norm")
    own = normalised.groupBy("query_pr").agg(F.collect_list(named).alias("cands"))
    q = rel.join(own, "query_pr", "left").withColumn("tuned", F.coalesce(tune, F.lit(False)))
    weights = [F.struct(*[F.lit(x).alias(c) for c, x in zip("ijk", w, strict=True)]) for w in weight_grid(steps)]
    q = q.withColumn("w", F.explode(F.array(*weights)))
    share = tuple(F.col(f"w.{c}").cast("double") / steps for c in "ijk")
    scored = F.transform("cands", lambda c: F.struct((-F.round(V.weighted(c["vector_norm"], c["file_norm"], c["bm25_norm"], share), 6)).alias("minus"), c["pr_id"].alias("pr_id")))
    best = F.transform(F.slice(F.array_sort(scored), 1, k), lambda c: c["pr_id"])
    found = F.coalesce(F.size(F.array_intersect(best, "wanted")), F.lit(0))
    q = q.select("w.*", "tuned", (F.when(F.col("cands").isNull(), 0).otherwise(found) / F.col("relevant")).alias("recall"))
    on = lambda half: F.when(F.col("tuned") if half else ~F.col("tuned"), F.col("recall"))
    q = q.groupBy("i", "j", "k").agg(F.count(on(True)).alias("tune_queries"), F.count(on(False)).alias("holdout_queries"), F.round(F.avg(on(True)), 6).alias("tune_recall"), F.round(F.avg(on(False)), 6).alias("holdout_recall"))
    # one row a weighting
    every = spark.createDataFrame(weight_grid(steps), "i int, j int, k int").join(q, ["i", "j", "k"], "left").fillna(0, ["tune_queries", "holdout_queries"])
    first = F.row_number().over(Window.orderBy(F.desc_nulls_last("tune_recall"), F.desc("i"), F.desc("j")))
    every = every.withColumn("chosen", (first == 1) & F.col("tune_recall").isNotNull())
    return every.select(*[(F.col(c).cast("double") / steps).alias(n) for c, n in zip("ijk", ("w_vector", "w_file", "w_bm25"), strict=True)], "tune_queries", "holdout_queries", "tune_recall", "holdout_recall", "chosen")


def recall_at(results: DataFrame, judgments: DataFrame, k: int = 3, least_grade: int = 2) -> DataFrame:
    """(query_pr, relevant, found, recall) for queries with a relevant change. judgments: query_pr, pr_id, grade."""
    rel = judgments.filter(F.col("grade") >= least_grade).select("query_pr", "pr_id").distinct()
    top = results.filter(F.col("rank") <= k).select("query_pr", "pr_id", F.lit(1).alias("hit"))
    j = rel.join(top, ["query_pr", "pr_id"], "left")
    return j.groupBy("query_pr").agg(F.count("*").alias("relevant"), F.count("hit").alias("found")).withColumn("recall", F.round(F.col("found") / F.col("relevant"), 6))


def reciprocal_rank(results: DataFrame, judgments: DataFrame, least_grade: int = 2) -> DataFrame:
    """(query_pr, rr): 1 over the first relevant rank, 0 without one; for queries with a relevant change."""
    rel = judgments.filter(F.col("grade") >= least_grade).select("query_pr", "pr_id").distinct()
    first = rel.join(results.select("query_pr", "pr_id", "rank"), ["query_pr", "pr_id"], "left")
    return first.groupBy("query_pr").agg(F.round(F.coalesce(1.0 / F.min("rank"), F.lit(0.0)), 6).alias("rr"))


def bootstrap(values: DataFrame, column: str, rounds: int = 1000, seed: int = 7) -> DataFrame:
    """(low, mid, high): percentile interval of the mean over queries drawn with replacement. Draw j of round i takes the query
    at index (a(i, j)) mod n, from a linear congruence of the two, so any engine gives the same draws. values has a row
    for each evaluated query, MOST_QUERIES at most: they go to every round as one array."""
    spark = values.sparkSession
    rest = [c for c in values.columns if c != column]
    if values.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} evaluated queries")
    v = values.agg(F.transform(F.array_sort(F.collect_list(F.struct(*rest, column))), lambda r: r[column]).alias("v"))
    draws = spark.range(rounds).select(F.col("id").alias("i")).crossJoin(F.broadcast(v)).filter(F.size("v") > 0)

    def drawn(j):
        state = (F.col("i") * 1_103_515 + j * 12_345 + seed) * 48_271 % 2_147_483_647
        return F.get("v", (state * 48_271 % 2_147_483_647 % F.size("v")).cast("int"))

    total = F.aggregate(F.transform(F.sequence(F.lit(0).cast("long"), F.size("v").cast("long") - 1), drawn), F.lit(0.0), lambda s, x: s + x)
    means = draws.select((total / F.size("v")).alias("m"))
    p = F.percentile("m", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return means.agg(p.alias("p")).select(*[F.round(F.col("p")[k], 6).alias(c) for k, c in enumerate(("low", "mid", "high"))])


def weighted_kappa(judgments: DataFrame, grades: int = 3, least_pairs: int = 10) -> DataFrame:
    """(pairs, kappa): quadratic-weighted agreement of rounds 1 and 2; null kappa for fewer than least_pairs pairs."""
    one = judgments.filter("round = 1").select("query_pr", "pr_id", F.col("grade").alias("x"))
    two = judgments.filter("round = 2").select("query_pr", "pr_id", F.col("grade").alias("y"))
    j = one.join(two, ["query_pr", "pr_id"])
    span = (grades - 1) ** 2
    cells = j.groupBy("x", "y").agg(F.count("*").alias("n"))
    a, b = j.groupBy("x").agg(F.count("*").alias("nx")), j.groupBy("y").agg(F.count("*").alias("ny"))
    total = cells.agg(F.sum("n").alias("t"), F.sum(F.col("n") * (F.col("x") - F.col("y")) * (F.col("x") - F.col("y")) / span).alias("o"))
    expected = a.crossJoin(F.broadcast(b)).agg(F.sum(F.col("nx") * F.col("ny") * (F.col("x") - F.col("y")) * (F.col("x") - F.col("y")) / span).alias("e"))
    k = total.crossJoin(expected)
    return k.select(F.coalesce("t", F.lit(0)).alias("pairs"), F.when((F.col("t") >= least_pairs) & (F.col("e") > 0), F.round(1 - F.col("o") * F.col("t") / F.col("e"), 6)).alias("kappa"))
