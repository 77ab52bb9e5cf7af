"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import math
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII upper case to lower case, as the contracts define lower-casing.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a local session gets one in /tmp; a cluster must name one,
    since its executors would each write to a disk of their own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "/tmp/checkpoints/lodestone"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and a lost executor costs no
    recomputation of what came before. What is not discarded earlier goes when the driver ends.

    Spark deletes shuffle files only once the driver's garbage collector has seen that their plan is gone, which a driver
    with little to do puts off for long; so it is asked to look here, where a plan has just been cut off."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{tag}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    release()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application: Python workers import it by name."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def release() -> None:
    """Gives freed memory back to the system. Python workers outlive their tasks, and what they keep adds up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _tidy(run: Callable) -> Callable:
    def call(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return call


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(_tidy(run), schema)


def map_pandas(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInPandas(_tidy(run), schema)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: A range of ordered_runs weighs about so much; there are at least as many ranges as shuffle partitions.
RANGE_WEIGHT = 64_000_000
#: Rows of a range's neighbours that are broadcast; of more, Spark picks the join by their size.
EDGES_BROADCAST = 1_000_000


def first_keys(df: DataFrame, key: str, weight: Column, parts: int, n: int, per_part: int) -> DataFrame:
    """One row, cuts: the first keys of at most parts ranges of about the same weight, in order.

    The keys come from a sample by hash of about per_part a range, and the least of all. The sample is sorted and added up
    in ranges of its own, so it is in no one task; the one row has a key for each range.
    """
    keys = df.select(F.col(key).alias("k"), (weight + 1).cast("double").alias("w"))
    want = parts * per_part
    some = keys
    if n > want:
        some = keys.filter(F.shiftrightunsigned(F.xxhash64("k", F.lit("cut")), 2) < int(want / n * 2**62) + 1)
    some = some.unionByName(keys.agg(F.min("k").alias("k"), F.lit(0.0).alias("w"))).groupBy("k").agg(F.sum("w").alias("w"))
    some = materialize(some.repartitionByRange(partitions(df.sparkSession), "k").withColumn("part", F.spark_partition_id()), "runs-sample")
    # one row for each shuffle partition
    sums = some.groupBy("part").agg(F.sum("w").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("total").over(before), F.lit(0.0)).alias("offset"), F.sum("total").over(Window.partitionBy()).alias("all"))
    inside = Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    some = some.withColumn("run", F.coalesce(F.sum("w").over(inside), F.lit(0.0))).join(sums, "part")
    share = F.coalesce(F.try_divide(F.col("offset") + F.col("run"), F.col("all")), F.lit(0.0))
    cuts = some.groupBy(F.least(F.floor(share * parts), F.lit(parts - 1)).alias("b")).agg(F.min("k").alias("k"))
    return cuts.agg(F.array_sort(F.collect_list("k")).alias("cuts"))


def in_ranges(df: DataFrame, key: str, cuts: Column, parts: int, name: str) -> DataFrame:
    """Adds name: how many of the ranges' first keys, but the first, are not above the key, by binary search. Each halving is a
    projection, so the plan grows with the logarithm of the ranges, and the steps compile into one loop-free stretch of code."""
    df = df.withColumn(name, F.lit(0))
    for step in (1 << j for j in reversed(range((parts - 1).bit_length()))):
        above = F.coalesce(F.get(cuts, F.col(name) + step) <= F.col(key), F.lit(False))
        df = df.withColumn(name, F.col(name) + F.when(above, step).otherwise(0))
    return df


def ordered_runs(df: DataFrame, key: str, weight: Column, per_part: int = 40, marks: DataFrame | None = None) -> DataFrame:
    """Deals df out by ranges of the non-null column ``key`` so that each partition also holds its neighbours.

    Adds ``_role`` and sorts each partition by (_role, key): -1 rows of the key just before the partition's range,
    0 its own rows, 1 rows of the key just after it (around the end: the first of all). There are as many ranges as
    shuffle partitions, or one for each RANGE_WEIGHT if that is more; rows of one key share a range. With marks (k, host,
    state of each row), -1 and 1 also have the nearest rows of the edge's host whose state is not the edge's.

    The plan does not grow with the ranges. Their first keys are one row of a subquery (a key a range, as Spark's own range
    partitioning has); which keys go to a second range is a table that is joined. Through the driver go that row and, while the
    table is broadcast (EDGES_BROADCAST), its two rows a range, four with marks; the sampled keys do not.
    """
    spark = df.sparkSession
    whole = df.agg(F.count("*").alias("n"), F.sum(weight).alias("w")).first()
    n = whole.n
    if n == 0:
        return df.withColumn("_role", F.lit(0))
    parts = max(partitions(spark), int((whole.w or 0) // RANGE_WEIGHT))
    cuts = materialize(first_keys(df, key, weight, parts, n, per_part), "runs-cuts").scalar()
    # a range's first key is one of df's, so no range is empty and the next one's number is one more
    ends = in_ranges(df.select(F.col(key).alias("k")), "k", cuts, parts, "b").groupBy("b").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    last = F.size(cuts) - 1
    to = lambda k, b, role: F.struct(k.alias("_k"), F.struct(b.cast("int").alias("b"), F.lit(role).alias("r")).alias("p"))
    before, after = to(F.col("lo"), F.when(F.col("b") == 0, F.col("last")).otherwise(F.col("b") - 1), 1), to(F.col("hi"), F.col("b") + 1, -1)
    extra = ends.withColumn("last", last).select(F.explode(F.when(F.col("b") < F.col("last"), F.array(before, after)).otherwise(F.array(before))).alias("e")).select("e.*")
    if marks is not None:
        far = _far(in_ranges(marks, "k", cuts, parts, "b"))
        extra = extra.unionByName(far.select(F.col("k").alias("_k"), F.struct(F.col("b").cast("int").alias("b"), F.col("r").alias("r")).alias("p")))
    extra = materialize(extra.groupBy("_k").agg(F.collect_set("p").alias("_extra")), "runs-edges")
    if 2 * parts <= EDGES_BROADCAST:
        extra = F.broadcast(extra)
    own = F.array(F.struct(F.col("_own").cast("int").alias("b"), F.lit(0).alias("r")))
    dealt = in_ranges(df, key, cuts, parts, "_own").join(extra, F.col(key) == F.col("_k"), "left")
    dealt = dealt.withColumn("_at", F.explode(F.when(F.col("_extra").isNull(), own).otherwise(F.concat(own, "_extra")))).drop("_k", "_extra", "_own")
    dealt = dealt.withColumn("_bucket", F.col("_at.b")).withColumn("_role", F.col("_at.r")).drop("_at")
    return dealt.repartitionById(parts, F.col("_bucket")).drop("_bucket")


def _far(marks: DataFrame) -> DataFrame:
    """(k, b, r): in range b and role r, k is the nearest row of the edge's host with another state. marks: k, host, state, b.

    What a range finds beyond its edge is in the next one if that holds any, and else what that range found itself. So it is
    carried along the ranges whose edge is of one host: a window over one row a range."""
    row = F.struct("k", "host", "state")
    ends = marks.groupBy("b").agg(F.min(row).alias("lo"), F.max(row).alias("hi"))
    other = lambda end: (F.col("host") == F.col(f"{end}.host")) & (F.col("state") != F.col(f"{end}.state"))
    ends = materialize(marks.join(ends, "b").groupBy("b", "lo", "hi").agg(
        F.min(F.when(other("lo"), F.col("k"))).alias("first"), F.max(F.when(other("hi"), F.col("k"))).alias("last")), "runs-states")
    out = None
    for side, near, beyond, inside, role in ((-1, "lo", "hi", "last", -1), (1, "hi", "lo", "first", 1)):
        before = ends.select((F.col("b") - side).alias("b"), F.col(beyond).alias("end"), F.col(inside).alias("inside"), F.col(f"{near}.host").alias("begins"))
        edge = F.col(near)
        found = (
            F.when(F.col("end").isNull() | (F.col("end.host") != edge["host"]), F.struct(F.lit(None).cast("string").alias("k")))
            .when(F.col("end.state") != edge["state"], F.struct(F.col("end.k").alias("k")))
            .when(F.col("inside").isNotNull(), F.struct(F.col("inside").alias("k")))
            .when(F.col("begins") != edge["host"], F.struct(F.lit(None).cast("string").alias("k"))))
        along = Window.partitionBy("host").orderBy(F.col("b") * -side).rowsBetween(Window.unboundedPreceding, 0)
        one = ends.join(before, "b", "left").select("b", edge["host"].alias("host"), found.alias("found"))
        one = one.select("b", F.last("found", ignorenulls=True).over(along)["k"].alias("k"), F.lit(role).alias("r")).filter("k is not null")
        out = one if out is None else out.unionByName(one)
    return out


def batches_of(rows: Iterable[tuple], names: list[str], types: list[pa.DataType], size: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most size rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, names, types)
            held = []
    if held:
        yield _batch(held, names, types)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
