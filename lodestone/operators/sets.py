"""Groups held against groups by their members: equal, inside, containing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical(groups: DataFrame, name: str, members: str) -> DataFrame:
    """(name, members, size): each group's distinct members in order, null ones left out; groups without members have no row.
    groups may have a row for each member (members no array), or one with all of them."""
    if not groups.schema[members].dataType.simpleString().startswith("array"):
        groups = groups.groupBy(name).agg(F.collect_set(members).alias(members))
    m = F.array_sort(F.array_distinct(F.filter(members, lambda x: x.isNotNull())))
    return groups.select(F.col(name).alias("name"), m.alias("members")).withColumn("size", F.size("members")).filter("size > 0")


def inside(small: DataFrame, large: DataFrame) -> DataFrame:
    """(members, of): distinct lists of small that lie strictly inside a distinct list of large.

    A list can only lie inside one that holds its rarest member, so that is the key they meet by; which member is rare is
    counted among the larger lists. What meets is then compared whole.
    """
    s, l = small.select("members", "size").distinct(), large.select(F.col("members").alias("of"), F.col("size").alias("of_size")).distinct()
    held = l.select("of", "of_size", F.explode("of").alias("member"))
    rare = held.groupBy("member").agg(F.count("*").alias("n"))
    own = s.select("members", "size", F.explode("members").alias("member")).join(rare, "member", "left")
    # a member that no larger list holds: none can contain this one
    best = own.groupBy("members", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "member")).alias("r")).filter("r.n > 0")
    met = best.select("members", "size", F.col("r.member").alias("member")).join(held, "member").filter(F.col("size") < F.col("of_size"))
    return met.filter(F.size(F.array_except("members", "of")) == 0).select("members", "of")


def relations(a: DataFrame, b: DataFrame, *, name: str = "name", members: str = "members") -> DataFrame:
    """(name, relation, n, least): for each group of a how many groups of b have the very same members (equal), more (inside), or
    only some of them (contains), and the least name of those. A group that has none of the three has no row.

    Groups are compared by their lists of members, equal lists once, whatever the groups are called; names and members of
    either side may repeat, and null members do not count. Groups that only share some members are not related.
    """
    a, b = canonical(a, name, members), canonical(b, name, members)
    of = b.groupBy("members").agg(F.count("*").alias("n"), F.min("name").alias("least"))
    pairs = inside(a, b).select("members", F.lit("inside").alias("relation"), "of").unionByName(inside(b, a).select(F.col("of").alias("members"), F.lit("contains").alias("relation"), F.col("members").alias("of")))
    pairs = pairs.unionByName(a.select("members", F.lit("equal").alias("relation"), F.col("members").alias("of")).distinct())
    found = pairs.join(of.withColumnRenamed("members", "of"), "of").groupBy("members", "relation").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    return a.select("name", "members").join(found, "members").select("name", "relation", "n", "least")
