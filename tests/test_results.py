"""The store of results: whole batches, failed ones, reruns."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import ranking
from lodestone.sources import results, store

SCHEMA = "query_pr long, score double"


def made(spark, low, high):
    return spark.range(low, high, 1, 3).select(F.col("id").alias("query_pr"), (F.col("id") / 2).alias("score"))


def test_batches_failures_and_reruns(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    assert results.stored(spark, path, SCHEMA).count() == 0 and results.remaining(made(spark, 0, 4), path).count() == 4
    results.append(made(spark, 0, 50), path)
    assert sorted(map(tuple, results.stored(spark, path, SCHEMA).collect())) == [(k, k / 2) for k in range(50)]
    # the last of three tasks fails after the others have written
    bad = made(spark, 50, 110).withColumn("score", F.when(F.col("query_pr") == 109, F.raise_error(F.lit("no score")).cast("double")).otherwise(F.col("score")))
    with pytest.raises(Exception, match="no score"):
        results.append(bad, path)
    assert results.stored(spark, path, SCHEMA).count() == 50
    named = {n for m in results.manifests(path) for n in m["files"]}
    assert set(os.listdir(tmp_path / "store/parts")) == named
    left = results.remaining(made(spark, 0, 110), path)
    assert sorted(r.query_pr for r in left.collect()) == list(range(50, 110))
    results.append(left, path)
    assert sorted(r.query_pr for r in results.stored(spark, path, SCHEMA).collect()) == list(range(110))
    assert [m["rows"] for m in results.manifests(path)].count(60) == 1 and results.remaining(made(spark, 0, 110), path).count() == 0


def test_a_task_that_outlives_its_failed_batch_adds_nothing(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    path = f"file://{tmp_path}/store"
    task = type("Task", (), {"partitionId": lambda self: 0, "taskAttemptId": lambda self: 1})()
    monkeypatch.setattr(results.TaskContext, "get", lambda: task)
    writer, rows = results.ResultWriter(path), pa.record_batch({"query_pr": [1], "score": [0.5]})

    def late():
        writer.abort([None])
        yield rows

    writer.write(late())
    assert not (tmp_path / "store/parts").exists() and results.stored(spark, path, SCHEMA).count() == 0
    writer = results.ResultWriter(path)
    lost = writer.write(iter([rows]))
    task.taskAttemptId = lambda: 2
    counted = writer.write(iter([rows]))
    writer.commit([counted])
    assert lost.name != counted.name and os.listdir(tmp_path / "store/parts") == [counted.name] and not (tmp_path / "store/open" / writer.batch).exists()
    writer.abort([counted])  # too late: the batch is in
    assert results.stored(spark, path, SCHEMA).count() == 1
    # a commit that breaks off before its manifest
    writer = results.ResultWriter(path)
    with pytest.raises(OSError):
        writer.commit([writer.write(iter([rows])), results.Part(f"{writer.batch}-none.parquet", 1)])
    writer.abort([None])
    assert os.listdir(tmp_path / "store/parts") == [counted.name] and results.stored(spark, path, SCHEMA).count() == 1


def test_empty_batches_and_modes(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    results.append(made(spark, 0, 0), path)
    assert results.stored(spark, path, SCHEMA).count() == 0 and [m["rows"] for m in results.manifests(path)] == [0]
    with pytest.raises(Exception, match="append"):
        made(spark, 0, 1).write.format("lodestone_results").option("path", path).mode("overwrite").save()


def test_rows_of_results_keep_their_weights(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    n = spark.createDataFrame([(1, 10, 1.0, 0.0, 0.5), (1, 11, 0.0, 1.0, 1.0)], "query_pr long, pr_id long, vector_norm double, file_norm double, bm25_norm double")
    rows = store.results_row(ranking.rank(n), {"vector": 0.5, "file": 0.3, "bm25": 0.2})
    results.append(rows, path)
    r = results.stored(spark, path, rows.schema).first()
    assert [x.pr_id for x in r.results] == [10, 11] and r.weights == {"vector": 0.5, "file": 0.3, "bm25": 0.2}
