"""Cached list pages, frozen snapshots, diffs and status files."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone import constants as C
from lodestone.functions import text as T
from lodestone.operators import rows as R


class SnapshotError(ValueError):
    """A frozen snapshot does not hold what its manifest says."""


def list_path(root: str, slug: str) -> str:
    return f"{root.rstrip('/')}/{slug}_page_*.json"


def read_pages(spark: SparkSession, root: str, slug: str) -> DataFrame:
    """(page, pos, raw): the items of every cached page, each as its JSON. Page files hold one array."""
    files = spark.read.text(list_path(root, slug), wholetext=True).select(T.page_number(F.col("_metadata.file_name")).alias("page"), "value")
    return files.select("page", F.posexplode(F.from_json("value", "array<variant>")).alias("pos", "v")).select("page", "pos", F.to_json("v").alias("raw"))


def read_items(spark: SparkSession, root: str, slug: str) -> DataFrame:
    return R.parse_items(read_pages(spark, root, slug))


def trusted_pages(pages: DataFrame) -> DataFrame:
    """Only full pages are taken from the cache: the last one may have grown since."""
    full = pages.groupBy("page").agg(F.count("*").alias("n")).filter(F.col("n") == C.PER_PAGE)
    return pages.join(full.select("page"), "page", "left_semi")


def until_short(pages: DataFrame) -> DataFrame:
    """The pages up to the first that is short or has no successor, as a reader that goes page by page would stop there; the
    partitions of a paged source do not know of each other. Without page 1: none."""
    n = pages.groupBy("page").agg(F.count("*").alias("n"))
    after = n.select((F.col("page") - 1).alias("page"), F.lit(True).alias("more"))
    ends = n.join(after, "page", "left").agg(F.min(F.when((F.col("n") < C.PER_PAGE) | F.col("more").isNull(), F.col("page"))).alias("end"), F.min("page").alias("begin"))
    return pages.join(F.broadcast(ends), (F.col("page") <= F.col("end")) & (F.col("begin") == 1), "left_semi")


def cache_first(cached: DataFrame, fetched: DataFrame) -> DataFrame:
    """Full cached pages as they are, all others from the fetched ones."""
    own = trusted_pages(cached)
    return own.unionByName(fetched.join(own.select("page").distinct(), "page", "left_anti").select(*own.columns))


def read_frozen(spark: SparkSession, root: str, slug: str, manifest: dict) -> DataFrame:
    """The pages of a frozen snapshot. Everything is checked before anything is returned: that no page is missing or
    stray, and that the total is the manifest's."""
    pages = read_pages(spark, root, slug)
    seen = pages.agg(F.count("*").alias("n"), F.countDistinct("page").alias("k"), F.max("page").alias("last")).first()
    if seen.k != manifest["pages"] or seen.last != manifest["pages"]:
        raise SnapshotError(f"{seen.k} pages up to {seen.last}; the manifest has {manifest['pages']}")
    if seen.n != manifest["total"]:
        raise SnapshotError(f"{seen.n} items; the manifest has {manifest['total']}")
    return pages


def manifest_of(pages: DataFrame, slug: str, reason: str) -> dict:
    """What freezing writes down: pages, total, first and last number. Refuses duplicates and falling numbers."""
    items = pages.select("page", "pos", F.get_json_object("raw", "$.number").cast("long").alias("number"))
    # numbers rise if each page's do and each page begins above the end of the one before
    per = items.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", "number"))).alias("x"), F.min("number").alias("lo"), F.max("number").alias("hi"))
    falls = F.exists(F.sequence(F.lit(1), F.size("x") - 1), lambda i: F.element_at("x", i)["number"] >= F.element_at("x", i + 1)["number"])
    rows = per.select("page", "lo", "hi", F.size("x").alias("n"), F.when(F.size("x") > 1, falls).otherwise(False).alias("falls")).orderBy("page").collect()
    if not rows:
        raise SnapshotError("no items")
    if any(r.falls for r in rows) or any(a.hi >= b.lo for a, b in zip(rows, rows[1:])):
        raise SnapshotError("numbers do not rise")
    return {"slug": slug, "reason": reason, "pages": len(rows), "total": sum(r.n for r in rows), "first": rows[0].lo, "last": rows[-1].hi}


def freeze(spark: SparkSession, pages: DataFrame, slug: str, reason: str, path: str) -> dict:
    """Writes the manifest as one JSON row; fails if there is one."""
    manifest = manifest_of(pages, slug, reason)
    spark.createDataFrame([tuple(manifest.values())], list(manifest)).withColumn("frozen_at", F.current_timestamp()).coalesce(1).write.mode("errorifexists").json(path)
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return None
    return spark.read.json(path).first().asDict()


def thaw(spark: SparkSession, path: str) -> bool:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs_path, True))


def read_diffs(spark: SparkSession, glob: str) -> DataFrame:
    """(number, diff): one file per change."""
    d = spark.read.text(glob, wholetext=True)
    return d.select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.diff$", 1).cast("long").alias("number"), F.col("value").alias("diff"))


def read_unavailable(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema("diff_unavailable array<bigint>").json(path).select(F.explode("diff_unavailable").alias("number"))


def duplicate_numbers(items: DataFrame) -> DataFrame:
    return items.groupBy("number").count().filter("count > 1")


class QuotaError(RuntimeError):
    """The fetcher says that fewer requests are left than are to be kept."""


class Items(list):
    """What a fetcher may give instead of a list: the items, and how many requests are left."""

    def __init__(self, items, remaining: int | None = None):
        super().__init__(items)
        self.remaining = remaining


class PagedSource(DataSource):
    """A paginated list as a Spark source: ``spark.read.format("paged_list").option("fetcher", "module:function")``.

    The function takes a page number and gives the JSON strings of its items. Options: ``cache`` ("module:function"), which
    gives a page's items from an earlier run or None, and is believed where the page is full; ``pages``, how many there are,
    if that is known; ``per_page``; ``stride``, pages of a partition; ``attempts`` and ``base`` of retries; ``delay`` seconds
    before each request; ``quota``, requests to be left over. If ``pages`` is not given the end is looked for before the
    partitions are made, from the last cached page on, by doubling and bisection: about twice the logarithm of how many
    pages are new. Transport errors and refusals are retried with doubling waits.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_list"

    def schema(self) -> str:
        return "page int, pos int, raw string"

    def reader(self, schema):
        return PagedReader(self.options)


def _named(path: str):
    module, name = path.split(":")
    return getattr(__import__(module, fromlist=[name]), name)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.stride = int(self.options.get("stride", "1"))
        self.per_page = int(self.options.get("per_page", str(C.PER_PAGE)))

    def cached(self, page: int) -> list[str] | None:
        """A full page of an earlier run; a short one may have grown since."""
        items = _named(self.options["cache"])(page) if "cache" in self.options else None
        return items if items is not None and len(items) == self.per_page else None

    def fetched(self, page: int) -> list[str]:
        time.sleep(float(self.options.get("delay", "0")))
        items = with_retry(lambda: _named(self.options["fetcher"])(page), attempts=int(self.options.get("attempts", "5")), base=float(self.options.get("base", "2")))
        left = getattr(items, "remaining", None)
        if left is not None and left < int(self.options.get("quota", "0")):
            raise QuotaError(f"{left} requests are left, {self.options['quota']} are to be kept")
        return items

    def last_page(self) -> int:
        """The last page that has items: full ones are before it, short or empty ones are not passed."""
        low, step = 0, 1
        while self.cached(low + 1) is not None:
            low += 1
        high = None  # low is full, or 0; high is short or empty
        while high is None:
            n = len(self.fetched(low + step))
            if 0 < n < self.per_page:
                return low + step
            low, step, high = (low + step, step * 2, None) if n else (low, step, low + step)
        while high - low > 1:
            mid = (low + high) // 2
            n = len(self.fetched(mid))
            if 0 < n < self.per_page:
                return mid
            low, high = (mid, high) if n else (low, mid)
        return low

    def partitions(self):
        pages = int(self.options["pages"]) if "pages" in self.options else self.last_page()
        return [InputPartition((k + 1, min(k + self.stride, pages))) for k in range(0, pages, self.stride)]

    def read(self, partition):
        first, last = partition.value
        for page in range(first, last + 1):
            items = self.cached(page)
            items = self.fetched(page) if items is None else items
            for pos, raw in enumerate(items):
                yield page, pos, raw
            if len(items) < self.per_page:
                return


def with_retry(call, *, attempts: int = 5, base: float = 2.0, sleep=None):
    """Calls; after an OSError waits base**attempt, or as long as the error's retry_after says, and calls again. An error with
    an HTTP code is tried again only if the code is a refusal for now: 403 or 429."""
    for attempt in range(attempts):
        try:
            return call()
        except OSError as e:
            if attempt == attempts - 1 or getattr(e, "code", None) not in (None, 403, 429):
                raise
            (sleep or time.sleep)(getattr(e, "retry_after", None) or base**attempt)
