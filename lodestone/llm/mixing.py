"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

Every source's documents are laid end to end in a shuffled order (md5 of seed and id) and cut into blocks of
``block_words`` words. A schedule of slots, one block each, is drawn from the van der Corput sequence: slot i takes the
point bitreverse(i) and maps it through the sources' cumulative slot allotments, so any stretch of the schedule holds
each source in proportion to its target, and the whole schedule holds each source's allotment exactly. Slots are
ranked per source; the r-th slot of a source is block r of its line, around again when the line ends.

All of it is DataFrame code. A hot source is not one group anywhere: its line is summed in hash ranges whose totals
are then added up, and its slots are ranked in chunks of the schedule.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._util import materialize, partitions

BLOCK_WORDS = 1024
MAX_REPEAT = 3
RANGE_ROWS = 2_000
SLOT_CHUNK = 4096
#: Words: maximal runs of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT, cycle: int = 3) -> DataFrame:
    """sizes: (source, source_size), one row a source. Adds weight and target.

    Sources by code point, null last, weigh 1..cycle, repeating, and share the sum of all sizes; a target stops at
    max_repeat times its source's size, and what is over goes to the others by weight until none is above. In closed
    form: with the sources in order of cap/weight, the first k are capped, where k is the least number for which the
    level (total - their caps) / (weights of the rest) is not above the next one's cap/weight.
    One row a source: a dimension, not data; the windows run over these rows only.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    every = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    t = sizes.withColumn("rank", F.row_number().over(order)).withColumn("weight", (F.col("rank") - 1) % cycle + 1)
    t = t.withColumn("cap", F.col("source_size") * max_repeat)
    t = t.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    t = t.withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)))
    t = t.withColumn("rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
    t = t.withColumn("level", (F.sum("source_size").over(every) - F.col("capped")).cast("double") / F.col("rest"))
    # the first source in this order whose ratio is not below the level fixes the level for it and all after it
    t = t.withColumn("fixed", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level"))).over(every))
    open_ = F.struct("ratio", "rank", "level") >= F.col("fixed")
    t = t.withColumn("target", F.when(open_, F.col("weight") * F.col("fixed.level")).otherwise(F.col("cap").cast("double")))
    return t.select("source", "source_size", "rank", "weight", "target")


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_words: int = BLOCK_WORDS, max_repeat: int = MAX_REPEAT, seed: str = "mix") -> DataFrame:
    """Returns doc_id, size, source, source_size, target, taken, first_slot, one row for each row of docs.

    taken is what the schedule's blocks take of the document, repeats counted; over a source it is
    floor(target + 1/2) words exactly, and at most max_repeat times the size for any document. first_slot is the first
    slot of the schedule that takes any of it (null: none does).

    Null or empty text: size 0, taken 0. Null source: a source of its own, last in order. Rows that agree in id are
    laid down one after the other, ordered by size, each on its own. A very long text spans many blocks. No rows in: no
    rows out. Other columns are not read.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    sized = materialize(sized.withColumn("place", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))), "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    share = materialize(allot(targets(sizes, max_repeat), block_words), "mix-targets")
    lines = layout(sized, share)
    pieces = cut(lines, block_words)
    part = F.greatest(F.lit(0), F.least(F.col("upto"), F.col("slot_upto")) - F.col("from"))
    taken = slots(share, block_words).join(pieces, ["rank", "block"]).groupBy("row_source", "start").agg(
        F.sum(part).alias("taken"), F.min(F.when(part > 0, F.col("slot"))).alias("first_slot"))
    out = lines.join(taken, (lines.rank == taken.row_source) & (lines.start == taken.start) & (lines.size > 0), "left")
    return out.select("doc_id", lines["size"], "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def allot(share: DataFrame, block_words: int) -> DataFrame:
    """Adds to each source its blocks, the whole rounds and the rest its target comes to, its number of slots, and where
    its slots lie on the line of all."""
    blocks = F.ceil(F.col("source_size") / block_words)
    t = share.withColumn("want", F.floor(F.col("target") + 0.5).cast("long")).withColumn("blocks", blocks)
    whole = F.when(F.col("source_size") > 0, F.expr("want div source_size")).otherwise(0)
    t = t.withColumn("rounds", whole).withColumn("rest", F.col("want") - F.col("rounds") * F.col("source_size"))
    t = t.withColumn("slots", (F.col("rounds") * F.col("blocks") + F.ceil(F.col("rest") / block_words)).cast("long"))
    upto = F.sum("slots").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("slot_end", upto).withColumn("slot_begin", F.col("slot_end") - F.col("slots"))


def layout(sized: DataFrame, share: DataFrame) -> DataFrame:
    """Gives each document its start on the line of its source, without putting a source into one task: the line is
    summed in ranges of the shuffled order, and each range starts at the total of those before it."""
    n = sized.count()
    digits = max(1, min(8, math.ceil(math.log(max(n, 1) / RANGE_ROWS + 1, 16))))
    dims = share.select("source", "rank", "source_size", "target", "blocks")
    rows = sized.join(dims, sized.source.eqNullSafe(dims.source)).drop(dims.source)
    rows = rows.withColumn("range", F.substring("place", 1, digits))
    totals = rows.groupBy("rank", "range").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("rank", "range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("rank", "range").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum("size").over(inside))
    return rows.join(offsets, ["rank", "range"]).withColumn("start", F.col("offset") + F.col("run") - F.col("size"))


def cut(lines: DataFrame, block_words: int) -> DataFrame:
    """Pieces of documents by block: (rank, block, start of the document, from and upto inside the block)."""
    first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")
    p = lines.filter("size > 0").select("rank", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    base = F.col("block") * block_words
    return p.select(
        "rank", "block", "start",
        F.greatest(F.col("start") - base, F.lit(0)).alias("from"),
        F.least(F.col("start") + F.col("size") - base, F.lit(block_words)).alias("upto"),
        F.col("rank").alias("row_source"))


def slots(share: DataFrame, block_words: int) -> DataFrame:
    """The schedule: (slot, rank of its source, block, slot_upto: where in the block it stops)."""
    total = share.agg(F.coalesce(F.max("slot_end"), F.lit(0)).alias("n")).first().n
    bits = max(1, math.ceil(math.log2(total))) if total > 1 else 1
    # each source's stretch of the line of allotments, point by point, in two steps so that no array is long
    own = share.filter("slots > 0").select("rank", "blocks", "rounds", "rest", "slot_begin", "slot_end")
    upto = F.ceil(F.col("slot_end") / SLOT_CHUNK).cast("long") - 1
    own = own.withColumn("piece", F.explode(F.sequence(F.expr(f"slot_begin div {SLOT_CHUNK}"), upto))).repartition(partitions(share.sparkSession), "piece")
    first, last = F.greatest(F.col("slot_begin"), F.col("piece") * SLOT_CHUNK), F.least(F.col("slot_end"), (F.col("piece") + 1) * SLOT_CHUNK) - 1
    s = own.withColumn("point", F.explode(F.sequence(first, last)))
    # van der Corput in base 2: a slot's point is its bits in reverse order, and so is the slot of a point
    s = s.withColumn("slot", F.conv(F.reverse(F.lpad(F.bin("point"), bits, "0")), 2, 10).cast("long")).withColumn("chunk", F.expr(f"slot div {SLOT_CHUNK}"))
    counts = s.groupBy("rank", "chunk").count()
    before = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("rank", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    s = s.withColumn("seen", F.row_number().over(Window.partitionBy("rank", "chunk").orderBy("slot")))
    s = s.join(counts, ["rank", "chunk"]).withColumn("nth", F.col("offset") + F.col("seen") - 1)
    block, last = F.expr("nth % blocks"), F.expr("nth div blocks") == F.col("rounds")
    stop = F.when(last, F.least(F.col("rest") - F.col("block") * block_words, F.lit(block_words))).otherwise(F.lit(block_words))
    return s.withColumn("block", block).withColumn("slot_upto", stop).select("slot", "rank", "block", "slot_upto")
