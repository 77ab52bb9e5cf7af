"""The file signal: Jaccard overlap of exact paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone import constants as C


def overlap_join(query: DataFrame, changes: DataFrame, cap: int | None = C.OVERLAP_CAP) -> DataFrame:
    """(query_pr, pr_id, shared, score, rank): earlier changes of the repo that share a path with the query, best first.

    query: query_pr, repo_id, created_at, files. changes: pr_id, repo_id, created_at, in_corpus, files. An equi-join on
    (repo, path) finds exactly the pairs whose Jaccard is not 0, so nothing that scores is left out before the cut.
    """
    q = query.select("query_pr", "repo_id", "created_at", F.explode(F.array_distinct("files")).alias("path"), F.size(F.array_distinct("files")).alias("q_n"))
    c = changes.filter("in_corpus").select("pr_id", F.col("repo_id").alias("c_repo"), F.col("created_at").alias("c_at"), F.explode(F.array_distinct("files")).alias("c_path"), F.size(F.array_distinct("files")).alias("c_n"))
    j = q.join(c, (q.repo_id == c.c_repo) & (q.path == c.c_path) & (c.c_at < q.created_at) & (c.pr_id != q.query_pr))
    out = j.groupBy("query_pr", "pr_id", "q_n", "c_n").agg(F.count("*").alias("shared"))
    out = out.select("query_pr", "pr_id", "shared", F.round(F.col("shared") / (F.col("q_n") + F.col("c_n") - F.col("shared")), 6).alias("score"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_pr").orderBy(F.desc("score"), "pr_id")))
    return out.filter(F.col("rank") <= cap) if cap else out
