"""Unified diffs: files, hunks, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions import text as T


def _counted(body: Column, sign: str) -> Column:
    """Lines that begin with sign: the last character of any line end stands before it, or nothing. Only signs are looked at, so
    lines are not taken apart."""
    return F.regexp_count(body, F.lit(rf"\{sign}(?<![^\n\r\x0B\x0C\x1C-\x1E\u0085\u2028\u2029]\{sign})")).cast("int")


def parse_hunks(diffs: DataFrame, id_col: str = "number", diff_col: str = "diff", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, file_path, hunk_index, content, additions, deletions): a row per hunk of a source file. keep: columns of the diff's
    row that go with each of its hunks.

    Text before the first file is dropped. Files without a new path (deleted, binary, renamed only) and excluded files have
    no hunks. hunk_index starts at 0 in each file block. Null and empty diffs have none.
    """
    # pieces and path are made before the rows are: conditions on them are then not split and matched anew for each use
    blocks = F.transform(F.slice(F.split(diff_col, r"(?dm)^diff --git "), 2, 1_000_000_000), lambda x: F.split(x, C.HUNK_HEADER))
    told = F.transform(blocks, lambda x: F.struct(x.alias("pieces"), T.strip(F.regexp_extract(x[0], C.NEW_PATH, 1)).alias("path")))
    b = diffs.select(id_col, *keep, F.posexplode(told).alias("block_no", "block"))
    b = b.select(id_col, *keep, "block_no", F.col("block.pieces").alias("pieces"), F.col("block.path").alias("file_path"))
    b = b.filter((F.size("pieces") > 1) & (F.col("file_path") != "") & (F.col("file_path") != "/dev/null"))
    b = b.filter(~T.is_excluded(F.col("file_path")))
    h = b.select(id_col, *keep, "block_no", "file_path", F.posexplode(F.slice("pieces", 2, F.size("pieces"))).alias("hunk_index", "piece"))
    # each is a column of its own, made once: what is used twice is not put in place of its name
    h = h.withColumn("context", F.substring_index("piece", "\n", 1))
    h = h.withColumn("body", F.substr("piece", F.length("context") + 1)).withColumn("shown", T.strip(F.col("context")))
    trimmed = F.btrim("body", F.lit("\n"))
    content = F.concat(F.when(F.col("shown") == "", "").otherwise(F.concat("shown", F.lit("\n"))), trimmed)
    return h.select(id_col, "block_no", "file_path", "hunk_index", content.alias("content"), _counted(F.col("body"), "+").alias("additions"), _counted(F.col("body"), "-").alias("deletions"), *keep)


def files_changed(hunks: DataFrame, id_col: str = "number") -> DataFrame:
    return hunks.groupBy(id_col).agg(F.array_sort(F.collect_set("file_path")).alias("files_changed"))


def diff_totals(hunks: DataFrame, id_col: str = "number") -> DataFrame:
    return hunks.groupBy(id_col).agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))


def classify(diff: Column) -> Column:
    """The kind of a diff, the special ones first."""
    lines = F.split(diff, T.LINE_END)
    marker = F.exists(lines, lambda x: ~x.rlike(C.DIFF_STRUCTURE) & x.rlike("^[ +-]") & F.contains(x, F.lit("@@")))
    files = (F.length(diff) - F.length(F.replace(diff, F.lit("diff --git"), F.lit("")))) / len("diff --git")
    sizes = F.transform(F.slice(F.split(diff, r"(?dm)^@@"), 2, 1_000_000_000), lambda h: F.length(F.regexp_replace(h, T.LINE_END, "")) + 2)
    return (
        F.when(F.contains(diff, F.lit("Binary files")) | F.contains(diff, F.lit("GIT binary patch")), "binary_file")
        .when(F.contains(diff, F.lit("+++ /dev/null")) | F.contains(diff, F.lit("deleted file mode")), "deleted_file")
        .when(F.contains(diff, F.lit("rename from")) & F.contains(diff, F.lit("rename to ")) & ~F.contains(diff, F.lit("@@")), "rename_only")
        .when(marker, "at_marker_in_content")
        .when(F.coalesce(F.array_max(sizes), F.lit(0)) > 1500, "huge_hunk")
        .when((files == 1) & F.contains(diff, F.lit("@@")), "simple_single_file")
        .when(files > 1, "multi_file")
    )
