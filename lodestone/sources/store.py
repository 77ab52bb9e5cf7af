"""Writes keyed by what is there: upsert, insert-ignore, status, staged loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import constants as C

CHANGE_KEY = ["repo_id", "number"]
CHANGE_FROZEN = ["github_id", "author", "author_type", "created_at"]
CHUNK_KEY = ["pr_id", "file_path", "hunk_index"]


def upsert(target: DataFrame, source: DataFrame, key: list[str], frozen: list[str] = ()) -> DataFrame:
    """The merged table. A matched row takes the source's values even where they are null, but keeps its frozen columns;
    the others pass through. The source must have one row per key."""
    t, s = target.withColumn("_t", F.lit(True)).alias("t"), source.withColumn("_s", F.lit(True)).alias("s")
    j = t.join(s, on=[F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key], how="full")
    matched, both = F.col("s._s").isNotNull(), F.col("t._t").isNotNull()
    out = []
    for c in target.columns:
        take = matched & ~both if c in frozen else matched
        out.append(F.when(take, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
    return j.select(*out)


def insert_ignore(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """What to append: rows of new whose key is not there yet, one for each key."""
    return new.dropDuplicates(key).join(existing.select(*key), key, "left_anti").select(*new.columns)


def load(df: DataFrame, path: str, staging: str) -> None:
    """All or nothing: written beside, then renamed into place. The table that stood there is set aside first and goes only
    once the new one stands; recover() brings it back if a run ended in between."""
    df.write.mode("overwrite").parquet(staging)
    _place(df.sparkSession, staging, path)


def _place(spark: SparkSession, staging: str, path: str) -> None:
    p, fs = _files(spark, path)
    recover(spark, path)
    old = p(path + OLD)
    fs.mkdirs(p(path).getParent())
    if fs.exists(p(path)) and not fs.rename(p(path), old):
        raise OSError(f"could not set {path} aside")
    if not fs.rename(p(staging), p(path)):
        fs.rename(old, p(path))
        raise OSError(f"could not move {staging} to {path}")
    fs.delete(old, True)


#: What a table's path bears while it is set aside.
OLD = ".before"


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path
    return p, p(path).getFileSystem(spark._jsc.hadoopConfiguration())


def recover(spark: SparkSession, path: str) -> None:
    """After a run that ended between the two renames the old table stands again; after one that ended later it goes."""
    p, fs = _files(spark, path)
    if fs.exists(p(path + OLD)):
        if fs.exists(p(path)):
            fs.delete(p(path + OLD), True)
        else:
            fs.rename(p(path + OLD), p(path))


def load_aside(df: DataFrame, path: str, errors: str, staging: str) -> dict[str, int]:
    """Loads the rows of df whose error is null into path and the others into errors, with their error, in one pass: a bad
    record costs itself only. Both tables are put in place as load does, and both always stand. How many rows went where."""
    seen = Observation("loaded")
    counted = df.observe(seen, F.count_if(F.col("error").isNull()).alias("rows"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    counted.withColumn("_failed", F.col("error").isNotNull()).write.mode("overwrite").partitionBy("_failed").parquet(staging)
    for failed, at in ((False, path), (True, errors)):
        own = f"{staging}/_failed={str(failed).lower()}"
        p, fs = _files(df.sparkSession, own)
        if not fs.exists(p(own)):
            df.filter("false").write.mode("overwrite").parquet(own)
        _place(df.sparkSession, own, at)
    return dict(seen.get)


def load_each(tables: dict[str, tuple[DataFrame, str]], staging: str) -> dict[str, str | None]:
    """Loads each named table (frame, path) for itself and goes on after a failure: name to error, or None."""
    out: dict[str, str | None] = {}
    for name, (df, path) in tables.items():
        try:
            load(df, path, f"{staging}/{name}")
            out[name] = None
        except Exception as e:  # noqa: BLE001 - reported by name, not hidden
            out[name] = f"{type(e).__name__}: {e}"[:500]
    return out


def set_status(repos: DataFrame, full_name: str, status: str, indexed: int) -> DataFrame:
    """The repo table with the status of one repo, how many changes it has indexed, and when."""
    own = F.col("full_name") == full_name
    return repos.withColumns({
        "status": F.when(own, F.lit(status)).otherwise(F.col("status")),
        "indexed_prs": F.when(own, F.lit(indexed)).otherwise(F.col("indexed_prs")).cast("int"),
        "indexed_at": F.when(own, F.current_timestamp()).otherwise(F.col("indexed_at"))})


def repo_by_name(repos: DataFrame, full_name: str) -> DataFrame:
    """The row of one repo, or none."""
    return repos.filter(F.col("full_name") == full_name)


def upsert_repo(repos: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged repo table, new repos with ids above those there are; and (full_name, id) of the source's repos."""
    top = repos.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    known = source.drop("id").join(repos.select("github_id", "id"), "github_id", "left")
    fresh = known.filter("id is null").select("github_id", F.row_number().over(Window.orderBy("github_id")).alias("nth"))  # a few repos
    known = known.join(fresh, "github_id", "left").crossJoin(F.broadcast(top)).withColumn("id", F.coalesce("id", F.col("top") + F.col("nth")))
    named = known.select(*repos.columns)
    return upsert(repos, named, ["id"], ["github_id", "created_at"]), named.select("full_name", "id")


def by_ids(changes: DataFrame, ids: DataFrame, key: str = "pr_id") -> DataFrame:
    """The changes whose key is among ids, by one join instead of a lookup each; a small list is broadcast, which is checked."""
    own = ids.select(key).distinct()
    return changes.join(F.broadcast(own) if own.limit(C.SMALL_ROWS + 1).count() <= C.SMALL_ROWS else own, key, "left_semi")


def seeds(results: DataFrame, path: str, *, model: str) -> None:
    """Results of a few demo queries (query_pr, results, weights) as JSON, one object a line, with model and time."""
    results.withColumns({"model": F.lit(model), "generated_at": F.current_timestamp()}).coalesce(1).write.mode("overwrite").json(path)


def pending(changes: DataFrame, chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """Changes of the corpus without chunks, by number; the limit is applied after the skip."""
    left = changes.filter("in_corpus").join(chunks.select("pr_id").distinct(), "pr_id", "left_anti").orderBy("number")
    return left.limit(limit) if limit else left


def write_status(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def results_row(ranked: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(query_pr, results, weights): a query's results, best first, with the weights they were made with."""
    item = F.struct("rank", "pr_id", "final_score", "vector_norm", "file_norm", "bm25_norm")
    used = F.map_from_arrays(F.array(*map(F.lit, weights)), F.array(*map(F.lit, weights.values())))
    return ranked.groupBy("query_pr").agg(F.array_sort(F.collect_list(item)).alias("results")).withColumn("weights", used)


def destination(paths: dict[str, str], target: str) -> str:
    """The path of a named target; there is no default."""
    if target not in paths:
        raise KeyError(f"unknown target {target!r}; known: {sorted(paths)}")
    return paths[target]


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
