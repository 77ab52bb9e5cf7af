"""A keyed table on disk that is rewritten part by part.

Rows lie in a fixed number of parts by the hash of their key. A write reads and rewrites only the parts its rows fall into,
beside the old files, and then adds a manifest that says which folder each part is in; so parts that are not touched keep
their files, and a reader sees one version whole, whatever is written meanwhile. Two writers cannot both add the same
version: the later one fails and leaves nothing that is read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import store

PARTS = 32


class Conflict(RuntimeError):
    """Another writer added the version first."""


class KeyedTable:
    """path: where it is or is to be. key: columns that name a row; frozen: columns that an upsert leaves as they are."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], frozen: list[str] = (), parts: int = PARTS):
        self.spark, self.path, self.key, self.frozen, self.parts = spark, path.rstrip("/"), list(key), list(frozen), parts
        self._p = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int")

    def manifest(self) -> dict | None:
        """The last version: number, schema, and the folder of each part that has rows."""
        at = self._p(f"{self.path}/versions")
        if not self._fs.exists(at):
            return None
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(at) if f.getPath().getName().endswith(".json"))
        return json.loads(self.spark.read.text(f"{self.path}/versions/{names[-1]}", wholetext=True).first().value) if names else None

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The table as the last manifest has it, or some of its parts."""
        m = self.manifest()
        if m is None:
            raise FileNotFoundError(f"no version of {self.path}")
        folders = [f"{self.path}/{f}" for k, f in m["folders"].items() if only is None or int(k) in only]
        if not folders:
            return self.spark.createDataFrame([], m["schema"])
        return self.spark.read.schema(m["schema"]).parquet(*folders)

    def _commit(self, before: dict | None, changed: DataFrame, touched: list[int] | None) -> int:
        """Writes the rows of the touched parts (None: all), then the manifest."""
        version = (before["version"] if before else 0) + 1
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changed.schema.fields)
        attempt = f"data/{version:08d}-{uuid.uuid4().hex}"
        changed.withColumn("_part", self._part()).repartition(F.col("_part")).write.partitionBy("_part").parquet(f"{self.path}/{attempt}")
        now = {int(f.getPath().getName().split("=")[1]): f"{attempt}/{f.getPath().getName()}" for f in self._fs.listStatus(self._p(f"{self.path}/{attempt}")) if f.isDirectory()}
        kept = {} if touched is None or before is None else {int(k): f for k, f in before["folders"].items() if int(k) not in touched}
        text = json.dumps({"version": version, "schema": schema, "folders": {str(k): f for k, f in sorted((kept | now).items())}})
        at = self._p(f"{self.path}/versions/{version:08d}.json")
        try:
            out = self._fs.create(at, False)
        except Exception as e:
            if self._fs.exists(at):
                raise Conflict(f"version {version} of {self.path} is there already") from e
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return version

    def overwrite(self, rows: DataFrame) -> int:
        """A version of these rows only. Rows must be one for each key."""
        return self._commit(self.manifest(), rows, None)

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r.p for r in rows.select(self._part().alias("p")).distinct().collect()]  # at most as many as there are parts

    def upsert(self, rows: DataFrame) -> int:
        """store.upsert of the rows, one for each key, into the parts they fall into. The first write makes the table."""
        m = self.manifest()
        if m is None:
            return self.overwrite(rows)
        touched = self._touched(rows)
        return self._commit(m, store.upsert(self.read(touched), rows, self.key, self.frozen), touched) if touched else m["version"]

    def insert_ignore(self, rows: DataFrame) -> int:
        """Adds rows whose key is not there, one for each key; the parts they fall into are rewritten."""
        m = self.manifest()
        if m is None:
            return self.overwrite(rows.dropDuplicates(self.key))
        there = self.read()
        new = store.insert_ignore(there, rows, self.key)
        touched = self._touched(new)
        return self._commit(m, self.read(touched).unionByName(new), touched) if touched else m["version"]

    def vacuum(self) -> int:
        """Deletes what the last version does not name; for when no reader of an earlier one is left. How many folders went."""
        m, gone = self.manifest(), 0
        live = {f for f in m["folders"].values()}
        for attempt in self._fs.listStatus(self._p(f"{self.path}/data")):
            name = attempt.getPath().getName()
            for part in self._fs.listStatus(attempt.getPath()):
                if part.isDirectory() and f"data/{name}/{part.getPath().getName()}" not in live:
                    gone += bool(self._fs.delete(part.getPath(), True))
        return gone
