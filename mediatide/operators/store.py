"""Keyed record sets as frames: merge, delete, migrate, refresh."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import numbered


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last written row of each key (the first in ``order``)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``target`` with the rows of ``updates`` in place of those of equal key; of equal keys in a batch the last wins."""
    last = latest(updates, keys, order).select(*target.columns)
    return target.join(last.select(*keys), keys, "left_anti").unionByName(last)


def delete_keys(target: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` without the given keys; no keys, no change."""
    return target.join(gone.select(*keys).distinct(), keys, "left_anti")


def keep_present(target: DataFrame, catalog: DataFrame, key: str = "file_path") -> tuple[DataFrame, DataFrame]:
    """The rows whose key is in the catalogue, and those that are removed."""
    present = catalog.select(key).distinct()
    return target.join(present, key, "left_semi"), target.join(present, key, "left_anti")


def reset_failed(prints: DataFrame) -> DataFrame:
    """Failed rows as if never tried."""
    failed = F.col("is_failed") == 1
    return prints.withColumns({"attempted_at": F.when(failed, 0).otherwise(F.col("attempted_at")), "error_msg": F.when(failed, "").otherwise(F.col("error_msg")), "is_failed": F.when(failed, 0).otherwise(F.col("is_failed"))})


def migrate(df: DataFrame, additions: dict[str, str]) -> DataFrame:
    """``df`` with the columns it lacks, each with its default text."""
    return df.withColumns({c: F.lit(v) for c, v in additions.items() if c not in df.columns})


def append_with_ids(target: DataFrame, rows: DataFrame, order: list[Column], key: str = "id") -> DataFrame:
    """``rows`` appended with the next free ids, in ``order``."""
    top = target.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    new = numbered(rows, order, "_no").withColumn(key, F.col("_no") + F.lit(top)).drop("_no")
    return target.unionByName(new.select(*target.columns))


def to_compute(catalog: DataFrame, cache: DataFrame, mode: str = "missing", detect_changes: bool = False) -> DataFrame:
    """The paths of the catalogue that a refresh computes.

    ``recompute_all``: all. Else those not cached or cached with an empty fingerprint; ``retry_failed`` adds the
    failed ones. A changed file is only seen with ``detect_changes`` (its mtime or size differs).
    """
    if mode == "recompute_all":
        return catalog.select("file_path").distinct()
    have = cache.select("file_path", F.lit(True).alias("_have"), F.coalesce("fingerprint", F.lit("")).alias("_fp"), F.coalesce("is_failed", F.lit(0)).alias("_failed"), F.col("mtime").alias("_mtime"), F.col("file_size").alias("_size"))
    j = catalog.join(have, "file_path", "left")
    need = F.col("_have").isNull() | (F.col("_fp") == "")
    if mode == "retry_failed":
        need = need | (F.col("_failed") == 1)
    if detect_changes:
        need = need | (F.col("mtime") != F.col("_mtime")) | (F.col("file_size") != F.col("_size"))
    return j.where(need).select("file_path").distinct()


def cache_hits(files: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """Files whose cached row may be used: same mtime and size, not failed, fingerprinted."""
    if force:
        return files.limit(0)
    ok = cache.where((F.coalesce("is_failed", F.lit(0)) == 0) & (F.coalesce("fingerprint", F.lit("")) != ""))
    return files.join(ok.select("file_path", "mtime", "file_size").distinct(), ["file_path", "mtime", "file_size"], "left_semi")


class ParquetStore:
    """A record set by key in a folder that any file system of the cluster may hold.

    Rows lie in buckets by the hash of their key. A write makes new files for the buckets it touches and then a new
    list of what is current, under the next number; readers take the highest number there is. A write that dies leaves
    the list before it in force, and of two writes at once the later one fails instead of losing the earlier one's rows.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str] | None = None, buckets: int = 32):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), keys, buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _current(self) -> tuple[int, dict | None]:
        """The highest number of a list, and that list."""
        numbers = [int(n) for n in self._names(self.folder + "/_current") if n.isdigit()]
        if not numbers:
            return 0, None
        stream = self._fs.open(self._path(f"{self.folder}/_current/{max(numbers):012d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return max(numbers), json.loads(text)

    def _announce(self, number: int, current: dict) -> None:
        temporary = self._path(f"{self.folder}/_current/.{uuid.uuid4().hex}")
        out = self._fs.create(temporary, True)
        out.write(json.dumps(current).encode())
        out.close()
        head = self._path(f"{self.folder}/_current/{number:012d}")
        if self._fs.exists(head) or not self._fs.rename(temporary, head):
            self._fs.delete(temporary, False)
            raise RuntimeError(f"{self.folder} was written to by another writer")

    def _frame(self, current: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(current["schema"])
        parts = [f"{self.folder}/{v}/_bucket={b}" for b, v in current["parts"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def _write_buckets(self, df: DataFrame, keys: list[str], buckets: int) -> tuple[str, list[int]]:
        """A new folder with the rows of ``df``, and the buckets that have any."""
        version = uuid.uuid4().hex
        df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{version}")
        return version, [int(n.split("=")[1]) for n in self._names(f"{self.folder}/{version}") if n.startswith("_bucket=")]

    def read(self) -> DataFrame | None:
        _, current = self._current()
        return self._frame(current) if current else None

    def write(self, df: DataFrame, keys: list[str] | None = None) -> None:
        """Make ``df`` the whole content; what was there stays on disk until ``vacuum``."""
        keys = keys or self.keys or df.columns[:1]
        number, _ = self._current()
        version, there = self._write_buckets(df, keys, self.buckets)
        self._announce(number + 1, {"schema": df.schema.jsonValue(), "keys": keys, "buckets": self.buckets, "parts": {str(b): version for b in there}})

    def upsert(self, updates: DataFrame, keys: list[str], order: list[Column]) -> None:
        """Merge a batch by key; only the buckets that hold its keys are read and written."""
        number, current = self._current()
        if current is None or current["keys"] != keys:
            self.write(latest(updates, keys, order) if current is None else upsert(self._frame(current), updates, keys, order), keys)
            return
        bucket = F.pmod(F.xxhash64(*keys), F.lit(current["buckets"]))
        touched = [r[0] for r in updates.select(bucket.alias("b")).distinct().collect()]  # at most as many as there are buckets
        version, there = self._write_buckets(upsert(self._frame(current, touched), updates, keys, order), keys, current["buckets"])
        parts = {b: v for b, v in current["parts"].items() if int(b) not in touched} | {str(b): version for b in there}
        self._announce(number + 1, current | {"parts": parts})

    def truncate(self) -> None:
        number, current = self._current()
        if current is not None:
            self._announce(number + 1, current | {"parts": {}})

    def vacuum(self) -> None:
        """Remove what the current list doesn't name, and the lists before it; no write may be under way."""
        number, current = self._current()
        keep = set(current["parts"].values()) if current else set()
        for name in self._names(self.folder):
            if name != "_current" and name not in keep:
                self._fs.delete(self._path(f"{self.folder}/{name}"), True)
        for name in self._names(self.folder + "/_current"):
            if name != f"{number:012d}":
                self._fs.delete(self._path(f"{self.folder}/_current/{name}"), False)
