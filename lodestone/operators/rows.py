"""Raw list items to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.operators import diffs as D

#: What is read of a raw item.
ITEM = (
    "number long, id long, title string, body string, user struct<login:string,type:string>, state string, created_at string, merged_at string, "
    "closed_at string, labels array<struct<name:string>>, base variant, head struct<sha:string>, links variant, _links variant"
)


def author(user: Column) -> Column:
    return F.coalesce(F.nullif(user["login"], F.lit("")), F.lit(C.GHOST_AUTHOR))


def author_type(user: Column) -> Column:
    return F.coalesce(F.nullif(user["type"], F.lit("")), F.lit(C.DEFAULT_AUTHOR_TYPE))


def outcome(merged_at: Column, state: Column) -> Column:
    return F.when(F.coalesce(merged_at, F.lit("")) != "", "merged").when(state == "closed", "closed_unmerged").otherwise("open")


def meta(items: DataFrame) -> DataFrame:
    """(number, title, author, author_type, created_at, merged_at) of parsed items."""
    return items.select("number", "title", author(F.col("user")).alias("author"), author_type(F.col("user")).alias("author_type"), F.to_timestamp("created_at").alias("created_at"), F.to_timestamp("merged_at").alias("merged_at"))


def parse_items(raw: DataFrame, column: str = "raw") -> DataFrame:
    """JSON strings of single items to columns, with the JSON itself beside them."""
    return raw.select(F.from_json(F.col(column), ITEM.replace("variant", "string")).alias("item"), F.col(column).alias("raw")).select("item.*", "raw")


def lean_raw(raw: Column) -> Column:
    """An item's JSON without what repeats the repository and without links, and with the head's revision; every other key stays
    as it is."""
    whole = F.parse_json(raw)
    kept = F.map_filter(whole.cast("map<string,variant>"), lambda k, v: ~k.isin(*C.DROPPED_KEYS))
    sha = F.try_variant_get(whole, "$.head.sha", "string")
    return F.to_json(F.map_concat(kept, F.create_map(F.lit("head_sha"), F.to_variant_object(F.array(sha)).cast("array<variant>")[0])))


def judged(items: DataFrame, verdicts: DataFrame, diffs: DataFrame, unavailable: DataFrame) -> DataFrame:
    """One row per item, marked, and error: what keeps it from being one, or null. Nothing is raised.

    verdicts: number, exclusion_reason, for every item. diffs: number, diff. unavailable: number. The reason is the verdict's,
    else that the diff is unavailable, else that it has no source. Errors, the first that fits: what is no item (no number),
    an item without a verdict, one that should have a diff and has none, a diff with text and no file in it, a time that is
    none.
    """
    hunks = D.parse_hunks(diffs)
    per = hunks.groupBy("number").agg(F.array_sort(F.collect_set("file_path")).alias("files_changed"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.count("*").alias("n_hunks"))
    text = diffs.groupBy("number").agg(F.lit(True).alias("has_diff"), F.bool_or((F.btrim("diff") != "") & ~F.col("diff").rlike(r"(?m)^diff --git ")).alias("no_file"))
    j = items.join(verdicts.select("number", F.col("exclusion_reason").alias("step_reason"), F.lit(True).alias("judged")), "number", "left")
    j = j.join(text, "number", "left").join(unavailable.select("number", F.lit(True).alias("refused")).distinct(), "number", "left").join(per, "number", "left")
    reason = F.coalesce("step_reason", F.when(F.col("refused"), C.REASON_NO_DIFF), F.when(F.col("has_diff") & (F.coalesce("n_hunks", F.lit(0)) == 0), C.REASON_NO_SOURCE))
    used = F.col("step_reason").isNull() & F.col("refused").isNull()
    said = lambda what: F.concat(F.lit(f"{what} "), F.col("number").cast("string"))
    error = F.when(F.col("number").isNull(), F.concat(F.lit("no item: "), F.substring(F.coalesce("raw", F.lit("")), 1, 100)))
    error = error.when(F.col("judged").isNull(), said("no verdict for change")).when(used & F.col("has_diff").isNull(), said("no diff for change")).when(used & F.col("no_file"), said("no file in the diff of change"))
    for c in ("created_at", "merged_at", "closed_at"):
        error = error.when((F.coalesce(F.col(c), F.lit("")) != "") & F.try_to_timestamp(c).isNull(), said(f"no time in {c} of change"))
    at = [F.try_to_timestamp(c).alias(c) for c in ("created_at", "merged_at", "closed_at")]
    return j.select(
        "number", F.col("id").alias("github_id"), "title", "body", author(F.col("user")).alias("author"), author_type(F.col("user")).alias("author_type"), outcome(F.col("merged_at"), F.col("state")).alias("outcome"),
        F.coalesce(F.col("labels")["name"], F.array().cast("array<string>")).alias("labels"),
        F.when(used, F.col("files_changed")).otherwise(F.lit(None)).alias("files"), F.when(used, F.coalesce("additions", F.lit(0))).otherwise(0).alias("additions"), F.when(used, F.coalesce("deletions", F.lit(0))).otherwise(0).alias("deletions"),
        *at, reason.alias("exclusion_reason"), F.when(error.isNull(), lean_raw(F.col("raw"))).otherwise(F.col("raw")).alias("raw"), error.alias("error"),
    ).withColumn("files_changed", F.coalesce("files", F.array().cast("array<string>"))).drop("files").withColumn("in_corpus", F.col("exclusion_reason").isNull())


def build(items: DataFrame, verdicts: DataFrame, diffs: DataFrame, unavailable: DataFrame) -> DataFrame:
    """One row per item, as judged gives them; the first error is raised."""
    out = judged(items, verdicts, diffs, unavailable)
    raised = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")))
    return out.withColumn("exclusion_reason", F.coalesce(raised.cast("string"), F.col("exclusion_reason"))).drop("error").withColumn("in_corpus", F.col("exclusion_reason").isNull())


def chunk_rows(hunks: DataFrame, limit: int = C.MAX_MODEL_TOKENS) -> DataFrame:
    """hunks with token_count: adds was_truncated, strictly above the model's limit."""
    return hunks.withColumn("was_truncated", F.col("token_count") > limit)


CHANGE_OF_CHUNK = ("pr_id", "repo_id", "created_at")


def build_chunks(hunks: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Rows of the chunk table: hunks (number, file_path, hunk_index, content, additions, deletions) embedded and counted, with
    the id, repo and time of their change: of changes (number, pr_id, repo_id, created_at), or columns of hunks if none are
    given. A hunk of no change is an error. Changes are joined before there are vectors, which are never shuffled."""
    from lodestone.operators import embedding

    if changes is not None:
        hunks = hunks.join(changes.select("number", *CHANGE_OF_CHUNK, F.lit(True).alias("known")), "number", "left")
        hunks = hunks.withColumn("pr_id", F.when(F.col("known"), F.col("pr_id")).otherwise(F.raise_error(F.concat(F.lit("hunk of unknown change "), F.col("number").cast("string")))))
    e = chunk_rows(embedding.embed(hunks, "content"))
    return e.select("pr_id", "repo_id", "file_path", "hunk_index", "content", "token_count", "was_truncated", "additions", "deletions", "embedding", "created_at")
