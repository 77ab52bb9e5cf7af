"""Ordered ranges with their neighbours."""

import random

import pytest
from conftest import sentence
from test_fingerprints import brute, run

from lodestone.llm import _util as U
from lodestone.llm import fingerprints as P
from lodestone.llm import html_extract as H
from pyspark.sql import functions as F


@pytest.mark.parametrize("weight", [400, 6000])
def test_many_ranges(spark, monkeypatch, weight):
    """Ranges of a few rows each: every text still has its next one beside it."""
    monkeypatch.setattr(U, "RANGE_WEIGHT", weight)
    rng = random.Random(3)
    rows = [(k * 3 % 700, sentence(rng, rng.randrange(30))) for k in range(700)] + [(5, "again"), (None, "none"), (9, None)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)) == brute(rows)


def test_every_range_has_rows_and_both_neighbours(spark, monkeypatch):
    monkeypatch.setattr(U, "RANGE_WEIGHT", 50)
    df = spark.range(2000).select((F.col("id") * 3).alias("key"), F.lit("x").alias("text")).repartition(5)
    dealt = U.ordered_runs(df, "key", F.lit(1))
    rows = dealt.select("key", "_role", F.spark_partition_id().alias("p")).collect()
    own = {}
    for r in rows:
        own.setdefault(r.p, {}).setdefault(r["_role"], []).append(r.key)
    assert sorted(k for parts in own.values() for k in parts.get(0, [])) == [k * 3 for k in range(2000)] and len(own) > 20
    for parts in own.values():
        lo, hi = min(parts[0]), max(parts[0])
        assert parts[0] and sorted(parts[0]) == list(range(lo, hi + 1, 3))
        assert parts[1] == [hi + 3 if hi + 3 < 6000 else 0] and parts.get(-1, []) == ([lo - 3] if lo else [])


def test_the_plan_grows_with_the_logarithm_of_the_ranges(spark, monkeypatch):
    df = spark.range(20_000).select(F.col("id").alias("key"), F.lit("x").alias("text"))
    sizes = []
    for weight in (2_000, 5):
        monkeypatch.setattr(U, "RANGE_WEIGHT", weight)
        sizes.append(len(U.ordered_runs(df, "key", F.lit(1))._jdf.queryExecution().optimizedPlan().toString()))
    # ten ranges and 4,000 of them: nine halvings more
    assert sizes[1] - sizes[0] < 9 * 2 * 1500


def test_pages_with_many_ranges(spark, monkeypatch):
    """Hosts over many ranges, with long stretches of pages whose lines are the very same."""
    rng = random.Random(4)
    rows = []
    for k in range(240):
        host, body = f"h{k // 80}", "same" if k % 80 in range(10, 60) else f"own {rng.randrange(9)}"
        rows.append((k, f"http://{host}/p/{k:04d}", f"<html><body><div>Top {host}</div><p>{body}</p><div>End</div></body></html>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    few = sorted(map(tuple, H.extract(df.coalesce(1)).collect()))
    monkeypatch.setattr(U, "RANGE_WEIGHT", 300)
    assert sorted(map(tuple, H.extract(df).collect())) == few
    assert P.fingerprints(df.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))).count() == 240
