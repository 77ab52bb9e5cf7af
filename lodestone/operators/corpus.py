"""Which changes belong to the corpus. Rows are marked, never deleted: in_corpus is true exactly where the reason is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions import text as T
from lodestone.plans.cluster import written


def classify(changes: DataFrame) -> DataFrame:
    """Adds reason from the row alone: bot first, then housekeeping, else null."""
    bot, house = T.is_bot(F.col("author"), F.col("author_type")), T.is_housekeeping(F.col("title"))
    return changes.withColumn("reason", F.when(bot, C.REASON_BOT).when(house, C.REASON_HOUSEKEEPING))


def near_misses(changes: DataFrame) -> DataFrame:
    """Titles that would be housekeeping but for their case."""
    return changes.filter(T.is_housekeeping(F.col("title"), ignore_case=True) & ~T.is_housekeeping(F.col("title")))


def group_duplicates(changes: DataFrame, days: int = C.DUPLICATE_WINDOW_DAYS, fold_rows: int = C.FOLD_ROWS) -> DataFrame:
    """Adds anchor (number of the group's first member) and group_size.

    Within an author and normalised title, in order of time and number, a change joins the open group if it is at most
    ``days`` days after the group's first member, else opens one. Titles match by equality. Null titles are equal to each
    other and to empty ones, null authors to each other; a change without a time is a group of its own. Authors and titles
    of at most ``fold_rows`` changes are folded each in one row, which carries the anchor only; larger ones go by
    anchors_by_doubling, where no task gets all of them.
    """
    key = ["author", "title_key"]
    c = changes.withColumn("title_key", T.normalize_title(F.coalesce(F.col("title"), F.lit(""))))
    rows = c.select(F.to_json(F.struct(*key)).alias("key"), F.col("created_at").cast("timestamp").alias("t"), F.col("number").cast("long").alias("number"))
    solo = rows.filter("t is null").select("number", F.col("number").alias("anchor"))
    rows = rows.filter("t is not null")
    size = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > fold_rows)
    large = rows.join(size, "key", "left_semi")
    both = solo.unionByName(_folded(rows.join(size, "key", "left_anti"), days))
    if not size.isEmpty():
        both = both.unionByName(anchors_by_doubling(large, days))
    size = both.groupBy("anchor").agg(F.count("*").alias("group_size"))
    return c.drop("title_key").join(both.join(size, "anchor"), "number")


def _folded(rows: DataFrame, days: int) -> DataFrame:
    """(number, anchor) of rows (key, t, number), a key's rows as one array of (t, n)."""
    a = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("t", F.col("number").alias("n")))).alias("members"))
    zero = F.struct(F.lit(None).cast("timestamp").alias("t"), F.lit(None).cast("long").alias("n"), F.array().cast("array<struct<number:bigint,anchor:bigint>>").alias("out"))

    def step(acc, x):
        fresh = acc["t"].isNull() | (x["t"] > acc["t"] + F.expr(f"INTERVAL {days} DAYS"))
        t, n = F.when(fresh, x["t"]).otherwise(acc["t"]), F.when(fresh, x["n"]).otherwise(acc["n"])
        return F.struct(t.alias("t"), n.alias("n"), F.array_append(acc["out"], F.struct(x["n"].alias("number"), n.alias("anchor"))).alias("out"))

    one = a.filter(F.size("members") == 1).select(F.col("members")[0]["n"].alias("number"), F.col("members")[0]["n"].alias("anchor"))
    return one.unionByName(a.filter(F.size("members") > 1).select(F.explode(F.aggregate("members", zero, step, lambda s: s["out"])).alias("m")).select("m.*"))


#: A window is cut into so many pieces of time, and a key's rows meet by piece. Divides the microseconds of a day.
PIECES = 150


def piece_of(u: Column, days: int) -> Column:
    """Exact for times before 1970 too: a day's microseconds are a multiple of PIECES."""
    width = days * 86_400_000_000 // PIECES
    return ((u - F.pmod(u, F.lit(width))) / width).cast("long")


def next_anchors(points: DataFrame, days: int) -> DataFrame:
    """(n, next): for each point (key, u in microseconds, n; one a moment) the first of its key that is more than ``days`` later.

    Time is cut into pieces, PIECES to the window, so a point's limit lies PIECES further on: the next point is in the same
    piece as the limit, or else the first of a later piece. A task gets a key's points of one piece, or a row for each piece.
    """
    span = days * 86_400_000_000
    p = points.withColumn("piece", piece_of(F.col("u"), days))
    point = F.struct("u", "n")
    ask = p.select("key", (F.col("piece") + PIECES).alias("piece"), (F.col("u") + span).alias("at"), F.lit(1).alias("asks"), "n", F.lit(None).cast("struct<u:bigint,n:bigint>").alias("point"))
    row = p.select("key", "piece", F.col("u").alias("at"), F.lit(0).alias("asks"), "n", point.alias("point"))
    later = Window.partitionBy("key", "piece").orderBy(F.desc("at"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, 0)
    near = row.unionByName(ask).withColumn("next", F.min("point").over(later)).filter("asks = 1").select("key", "piece", "n", "next")
    first = p.groupBy("key", "piece").agg(F.min(point).alias("point")).withColumn("asks", F.lit(0))
    asked = p.select("key", (F.col("piece") + PIECES).alias("piece")).distinct().withColumns({"point": F.lit(None).cast("struct<u:bigint,n:bigint>"), "asks": F.lit(1)})
    beyond = Window.partitionBy("key").orderBy(F.desc("piece"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, 0)
    far = first.unionByName(asked.select(*first.columns)).withColumn("far", F.min("point").over(beyond)).filter("asks = 1").select("key", "piece", "far")
    return near.join(far, ["key", "piece"]).select("n", F.coalesce("next", "far")["n"].alias("next"))


def anchors_by_doubling(rows: DataFrame, days: int) -> DataFrame:
    """(number, anchor) of rows (key, t, number), by pointers that double: the anchors of a key are its first row, that row's
    next, and so on; a round finds as many again as are known and makes every pointer twice as long, so rounds are the
    logarithm of the longest chain. Only the first row of a moment can be an anchor. A row's anchor is the last one that is
    not after it: the next would have begun by then if it were more than ``days`` before."""
    rows = written(rows.select("key", F.unix_micros("t").alias("u"), "number"), "anchors-rows")
    points = written(rows.groupBy("key", "u").agg(F.min("number").alias("n")), "anchors-points")
    jump = written(next_anchors(points, days).filter("next is not null"), "anchors-jump")
    known = points.groupBy("key").agg(F.min(F.struct("u", "n"))["n"].alias("n")).select("n")
    anchors = fresh = written(known, "anchors-known")
    while True:
        fresh = written(anchors.join(jump, "n").select(F.col("next").alias("n")), "anchors-known")
        if fresh.isEmpty():
            break
        anchors = anchors.unionByName(fresh)
        jump = written(jump.join(jump.select(F.col("n").alias("next"), F.col("next").alias("after")), "next").select("n", F.col("after").alias("next")), "anchors-jump")
    own = points.join(anchors, "n").select("key", "u", F.col("n").alias("anchor"))
    return latest_anchors(rows, own, days)


def latest_anchors(rows: DataFrame, anchors: DataFrame, days: int) -> DataFrame:
    """(number, anchor): for each row (key, u, number) the last of its key's anchors (key, u, anchor) that is not after it.

    As in next_anchors, the anchor is in the row's own piece of time, or else the last one of an earlier piece. Rows and
    anchors go to one place each, so what is shuffled is as large as they are, however many pieces a window has.
    """
    mark = F.struct("u", "anchor")
    a = anchors.withColumn("piece", piece_of(F.col("u"), days))
    r = rows.withColumn("piece", piece_of(F.col("u"), days))
    row = r.select("key", "piece", "u", F.lit(1).alias("asks"), "number", F.lit(None).cast("struct<u:bigint,anchor:bigint>").alias("mark"))
    begun = a.select("key", "piece", "u", F.lit(0).alias("asks"), F.lit(None).cast("long").alias("number"), mark.alias("mark"))
    earlier = Window.partitionBy("key", "piece").orderBy("u", "asks").rowsBetween(Window.unboundedPreceding, 0)
    near = row.unionByName(begun).withColumn("mark", F.max("mark").over(earlier)).filter("asks = 1").select("key", "piece", "number", F.col("mark")["anchor"].alias("near"))
    pieces = r.select("key", "piece").distinct().withColumn("mark", F.lit(None).cast("struct<u:bigint,anchor:bigint>"))
    pieces = pieces.unionByName(a.select("key", "piece", mark.alias("mark"))).groupBy("key", "piece").agg(F.max("mark").alias("mark"))
    before = Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    far = pieces.withColumn("far", F.max("mark").over(before)).select("key", "piece", F.col("far")["anchor"].alias("far"))
    return near.join(far, ["key", "piece"]).select("number", F.coalesce("near", "far").alias("anchor"))


def resolve(grouped: DataFrame) -> DataFrame:
    """Adds n_merged and keeper of each group: the merged member if there is one, else the highest number. Groups with two
    merged members or more are no resubmissions, and neither are groups of one."""
    per = grouped.groupBy("anchor").agg(
        F.count_if(F.col("merged_at").isNotNull()).alias("n_merged"),
        F.max(F.struct(F.col("merged_at").isNotNull().alias("m"), F.col("number").alias("n")))["n"].alias("keeper"))
    real = (F.col("group_size") > 1) & (F.col("n_merged") < 2)
    return grouped.join(per, "anchor").withColumn("duplicate", real & (F.col("number") != F.col("keeper")))


def verdicts(changes: DataFrame) -> DataFrame:
    """(number, in_corpus, exclusion_reason); duplicates are looked for among what the row rules leave."""
    c = classify(changes)
    left = resolve(group_duplicates(c.filter("reason is null").drop("reason")))
    dup = left.select("number", F.when(F.col("duplicate"), C.REASON_DUPLICATE).alias("reason"))
    out = c.filter("reason is not null").select(F.col("number").cast("long"), "reason").unionByName(dup.select(F.col("number").cast("long"), "reason"))
    return out.select("number", F.col("reason").isNull().alias("in_corpus"), F.col("reason").alias("exclusion_reason"))


def most_common(df: DataFrame, column: str, n: int) -> DataFrame:
    """(column, count): the n most frequent values, the first in order in a tie (a top-n report)."""
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column).limit(n)


def branch_tally(groups: DataFrame) -> DataFrame:
    """groups: title_a, title_b of pairs that two rules matched. One row: exact (equal after normalising) and loose ones."""
    same = T.normalize_title(F.col("title_a")) == T.normalize_title(F.col("title_b"))
    return groups.agg(F.count_if(same).alias("exact"), F.count_if(~same).alias("loose"))


def facets(changes: DataFrame) -> DataFrame:
    """changes: facet, additions, deletions. Churn and number of changes of each facet, and how many touch nothing."""
    churn = F.col("additions") + F.col("deletions")
    return changes.groupBy("facet").agg(F.count("*").alias("changes"), F.sum(churn).alias("churn"), F.count_if(churn == 0).alias("empty"))


def ascending_breaks(changes: DataFrame, at: str = "created_at", unit: str = "day") -> DataFrame:
    """(number, before): rows whose number is not above that of the row before, in order of time and number.

    Rows are looked at inside each time unit; the first of a unit is held against the last of the unit before, which comes
    from a table of one row per unit. No task sees more than a unit's rows."""
    c = changes.withColumn("unit", F.date_trunc(unit, F.col(at)))
    ends = c.groupBy("unit").agg(F.max(F.struct(F.col(at).alias("t"), F.col("number").alias("n")))["n"].alias("end"))
    ends = ends.select("unit", F.lag("end").over(Window.orderBy("unit")).alias("end"))
    inside = F.lag("number").over(Window.partitionBy("unit").orderBy(at, "number"))
    j = c.withColumn("inside", inside).join(ends, "unit")
    return j.withColumn("before", F.coalesce("inside", "end")).filter("before >= number").select("number", "before")
