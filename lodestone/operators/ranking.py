"""Candidates of three signals, normalised over one set, weighted, cut, and given a reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions import vectors as V


def candidate_union(*signals: DataFrame) -> DataFrame:
    """Distinct (query_pr, pr_id) of all signals."""
    return reduce(DataFrame.unionByName, [s.select("query_pr", "pr_id") for s in signals]).distinct()


def raw_signals(candidates: DataFrame, vector: DataFrame, files: DataFrame, bm25: DataFrame) -> DataFrame:
    """vector, file and bm25 of every candidate; what a signal does not name scores 0. vector must cover the candidates for
    its scores to be true ones."""
    out = candidates
    for name, s in (("vector", vector), ("file", files), ("bm25", bm25)):
        out = out.join(s.select("query_pr", "pr_id", F.col("score").alias(name)), ["query_pr", "pr_id"], "left")
    return out.fillna(0.0, ["vector", "file", "bm25"])


def normalise(raw: DataFrame) -> DataFrame:
    """Adds vector_norm, file_norm, bm25_norm: min-max over one query's candidates, 0 where all are equal."""
    w = Window.partitionBy("query_pr")
    for c in ("vector", "file", "bm25"):
        raw = raw.withColumn(f"{c}_norm", V.minmax(F.col(c), F.min(c).over(w), F.max(c).over(w)))
    return raw


def rank(normalised: DataFrame, k: int = C.RESULTS_RETURNED, weights: tuple[float, float, float] = (C.WEIGHT_VECTOR, C.WEIGHT_FILE, C.WEIGHT_BM25)) -> DataFrame:
    if abs(sum(weights) - 1) > 1e-9:
        raise ValueError("weights must sum to 1")
    score = F.round(V.weighted(F.col("vector_norm"), F.col("file_norm"), F.col("bm25_norm"), weights), 6)
    w = Window.partitionBy("query_pr").orderBy(F.desc("final_score"), "pr_id")
    return normalised.withColumn("final_score", score).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def reasons(results: DataFrame) -> DataFrame:
    """Adds reason, the first that fits. Needs shared_file, top_file, top_terms (array) and outcome; of several shared files
    the least path is named, of the terms the two that contribute most."""
    shared, high = F.col("shared_file").isNotNull(), F.col("vector_norm") > C.REASON_HIGH_VECTOR
    said = (
        F.when(shared & high, F.concat(F.lit(C.SAID_BOTH), F.col("shared_file"), F.lit(C.SAID_BOTH_END)))
        .when(shared, F.concat(F.lit(C.SAID_FILE), F.col("shared_file")))
        .when(high, F.concat(F.lit(C.SAID_PATTERN), F.col("top_file")))
        .when(F.col("bm25_norm") > C.REASON_HIGH_BM25, F.concat(F.lit(C.SAID_TERMS), F.array_join(F.slice("top_terms", 1, 2), ", ")))
        .otherwise(F.concat(F.lit(C.SAID_RELATED), F.substring_index(F.col("top_file"), "/", 1)))
    )
    suffix = F.when(F.col("outcome") == "closed_unmerged", C.CLOSED_SUFFIX).otherwise("")
    return results.withColumn("reason", F.concat(said, suffix))
