"""Soundness checks as queries: a row of booleans, or the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import constants as C

KNOWN_REASONS = (C.REASON_BOT, C.REASON_HOUSEKEEPING, C.REASON_DUPLICATE, C.REASON_NO_SOURCE, C.REASON_NO_DIFF)


def list_sound(items: DataFrame, first: int, low: int, high: int) -> DataFrame:
    """items: number. One row: not_empty, unique, first_ok, in_band. Order is checked by corpus.ascending_breaks."""
    n, u = F.count("*"), F.countDistinct("number")
    return items.agg((n > 0).alias("not_empty"), (n == u).alias("unique"), F.coalesce(F.min("number") == first, F.lit(False)).alias("first_ok"), n.between(low, high).alias("in_band"))


def tail_short(items: DataFrame, per_page: int = C.PER_PAGE) -> DataFrame:
    """items: page. One row, ok: every page but the last is full, and the last is not above a page."""
    n = items.groupBy("page").agg(F.count("*").alias("n"))
    last = n.agg(F.max("page").alias("last"))
    return n.crossJoin(F.broadcast(last)).agg(F.coalesce(F.bool_and(F.when(F.col("page") == F.col("last"), F.col("n") <= per_page).otherwise(F.col("n") == per_page)), F.lit(False)).alias("ok"))


def scores_in_range(results: DataFrame, *columns: str) -> DataFrame:
    """(outside): how many rows have a score below 0 or above 1."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | ~F.col(c).between(0, 1)
    return results.agg(F.count_if(bad).alias("outside"))


def verdicts_sound(verdicts: DataFrame, expected: int) -> DataFrame:
    """One row: complete, unique, consistent (the reason is null exactly where in_corpus), known (reasons of this step only)."""
    step = (C.REASON_BOT, C.REASON_HOUSEKEEPING, C.REASON_DUPLICATE)
    n = F.count("*")
    return verdicts.agg(
        (n == expected).alias("complete"), (F.countDistinct("number") == n).alias("unique"),
        (F.count_if(F.col("exclusion_reason").isNull() != F.col("in_corpus")) == 0).alias("consistent"),
        (F.count_if(F.col("exclusion_reason").isNotNull() & ~F.col("exclusion_reason").isin(*step)) == 0).alias("known"))


def rows_sound(rows: DataFrame, expected: int) -> DataFrame:
    n = F.count("*")
    return rows.agg(
        (n == expected).alias("complete"), (F.countDistinct("number") == n).alias("unique"),
        (F.count_if(F.col("exclusion_reason").isNotNull() & ~F.col("exclusion_reason").isin(*KNOWN_REASONS)) == 0).alias("known"),
        (F.count_if(~F.col("in_corpus") & (F.size("files_changed") > 0)) == 0).alias("no_files_if_excluded"))


def temporal_leaks(results: DataFrame) -> DataFrame:
    """results: query_at, candidate_at. How many candidates are not strictly earlier."""
    return results.agg(F.count_if(F.col("candidate_at") >= F.col("query_at")).alias("leaks"), F.count("*").alias("checked"))


def violations(df: DataFrame, *, unique: list[list[str]] = (), not_null: list[str] = (), allowed: dict[str, list[str]] | None = None, parents: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(rule, broken): how many rows break each table rule, which Spark does not enforce itself."""
    out = []
    spark = df.sparkSession
    for cols in unique:
        out.append(df.groupBy(*cols).count().filter("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("broken")).select(F.lit(f"unique {','.join(cols)}").alias("rule"), "broken"))
    for c in not_null:
        out.append(df.agg(F.count_if(F.col(c).isNull()).alias("broken")).select(F.lit(f"not null {c}").alias("rule"), "broken"))
    for c, values in (allowed or {}).items():
        out.append(df.agg(F.count_if(~F.col(c).isin(*values)).alias("broken")).select(F.lit(f"check {c}").alias("rule"), "broken"))
    for c, (parent, key) in (parents or {}).items():
        lost = df.filter(F.col(c).isNotNull()).join(parent.select(F.col(key).alias(c)), c, "left_anti")
        out.append(lost.agg(F.count("*").alias("broken")).select(F.lit(f"references {c}").alias("rule"), "broken"))
    if not out:
        return spark.createDataFrame([], "rule string, broken long")
    first = out[0]
    for x in out[1:]:
        first = first.unionByName(x)
    return first


def chunk_totals_break(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes whose additions differ from the sum over their chunks."""
    s = chunks.groupBy("pr_id").agg(F.sum("additions").alias("chunk_additions"))
    return changes.join(s, "pr_id", "left").filter(F.coalesce("chunk_additions", F.lit(0)) != F.col("additions"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, total, folded) that is the same for the same rows in any order and number of partitions: how many, the sum
    of their 64-bit hashes and their exclusive or. Repeated rows count; columns are taken by name; a null is told from the
    empty text and from a null in another column. Maps have no hash and are an error."""
    cols = [x for c in sorted(df.columns) for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    h = df.select(F.xxhash64(*cols).alias("h"))
    return h.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("total"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("folded"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of a, and same, whether both hold the same rows the same number of times (but for a chance in 2^64)."""
    y = fingerprint(b).withColumnsRenamed({"rows": "b_rows", "total": "b_total", "folded": "b_folded"})
    same = (F.col("rows") == F.col("b_rows")) & (F.col("total") == F.col("b_total")) & (F.col("folded") == F.col("b_folded"))
    return fingerprint(a).crossJoin(F.broadcast(y)).select("rows", same.alias("same"))
