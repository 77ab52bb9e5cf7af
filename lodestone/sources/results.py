"""A store of results that a batch enters whole or not at all.

Tasks write files under ``open/<batch>``, each attempt one of its own; the commit moves those of the attempts that counted to
``parts`` and names them in a manifest, one a batch, which appears by a rename. Readers see the files that manifests name. A
failed batch leaves no rows, its files are deleted, and a rerun takes only the queries that have no results yet. Spark does not
wait for the other tasks of a failed batch: what one writes after the others' files are gone stays in ``open``.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lodestone.plans.cluster import ship


def opened(path: str) -> tuple[fs.FileSystem, str]:
    system, at = fs.FileSystem.from_uri(path)
    return system, at.rstrip("/")


@dataclass
class Part(WriterCommitMessage):
    name: str | None
    rows: int


class ResultSink(DataSource):
    """Appends a batch to the store at ``path``, a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_results"

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("results are added, not replaced: use mode append")
        return ResultWriter(self.options["path"])


class ResultWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.batch = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, at = opened(self.path)
        context = TaskContext.get()
        name, out, rows = f"{self.batch}-{context.partitionId()}-{context.taskAttemptId()}.parquet", None, 0
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    system.create_dir(f"{at}/open/{self.batch}", recursive=True)
                    out = pq.ParquetWriter(f"{at}/open/{self.batch}/{name}", batch.schema, filesystem=system)
                out.write_batch(batch)
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Part(name if out is not None else None, rows)

    def commit(self, messages: list[Part | None]) -> None:
        system, at = opened(self.path)
        system.create_dir(f"{at}/manifests", recursive=True)
        told = {"files": sorted(m.name for m in messages if m and m.name), "rows": sum(m.rows for m in messages if m)}
        system.create_dir(f"{at}/parts", recursive=True)
        for name in told["files"]:
            system.move(f"{at}/open/{self.batch}/{name}", f"{at}/parts/{name}")
        with system.open_output_stream(f"{at}/manifests/.{self.batch}") as f:
            f.write(json.dumps(told).encode())
        system.move(f"{at}/manifests/.{self.batch}", f"{at}/manifests/{self.batch}.json")
        self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        system, at = opened(self.path)
        self._clear()
        if system.get_file_info(f"{at}/manifests/{self.batch}.json").type == fs.FileType.File:
            return  # it is in
        for f in system.get_file_info(fs.FileSelector(f"{at}/parts", allow_not_found=True)):
            if f.base_name.startswith(self.batch):  # of a commit that broke off
                system.delete_file(f.path)

    def _clear(self) -> None:
        system, at = opened(self.path)
        with contextlib.suppress(OSError):  # there is none, or a task still writes there
            system.delete_dir(f"{at}/open/{self.batch}")


def append(df: DataFrame, path: str) -> None:
    """Adds df as one batch. Where a task fails for good, nothing is added."""
    spark = df.sparkSession
    ship(spark)
    spark.dataSource.register(ResultSink)
    df.write.format("lodestone_results").option("path", path).mode("append").save()


def manifests(path: str) -> list[dict]:
    system, at = opened(path)
    found = system.get_file_info(fs.FileSelector(f"{at}/manifests", allow_not_found=True))
    return [json.loads(system.open_input_stream(f.path).read()) for f in sorted(found, key=lambda f: f.path) if f.base_name.endswith(".json")]


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows of the batches that were committed; none of a store that does not exist yet."""
    names = [f"{path.rstrip('/')}/parts/{n}" for m in manifests(path) for n in m["files"]]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def remaining(queries: DataFrame, path: str, key: str = "query_pr") -> DataFrame:
    """The queries without stored results: what a rerun has left to do. A null key is never stored."""
    own = stored(queries.sparkSession, path, queries.select(key).schema)
    return queries.join(own.select(key).distinct(), key, "left_anti")
