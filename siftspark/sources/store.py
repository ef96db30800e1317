"""Small tables that a running engine keeps: events, searches, pages shown, the frontier, results for a while.

A log grows by appended Parquet files, a day a folder, and is read as one table. A state is written whole under a number of its own and made current by the
last file written, so a reader sees the old state or the new one and a writer that dies leaves the old.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE_SECONDS, CACHE_ENTRIES = 30, 500


def append(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """Adds rows with Unix seconds in `ts` to a log."""
    rows.withColumn("day", F.date_format(F.timestamp_seconds(F.col(ts)), "yyyy-MM-dd")).write.mode("append").partitionBy("day").parquet(path)


def read_log(spark: SparkSession, path: str, schema: str, since_day: str | None = None) -> DataFrame:
    """The rows of a log, of days from since_day on; none where nothing was added yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, day string").parquet(path)
    return (rows.filter(F.col("day") >= since_day) if since_day else rows).drop("day")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def _current(spark: SparkSession, path: str) -> dict | None:
    return json.loads(spark.read.text(f"{path}/current").first()[0]) if _exists(spark, f"{path}/current") else None


def save_state(tables: dict[str, DataFrame], path: str, **facts) -> None:
    """Every table under a number of its own, then the file that names it; the state before the last is deleted."""
    spark = next(iter(tables.values())).sparkSession
    before = _current(spark, path)
    number = before["number"] + 1 if before else 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{number}/{name}")
    spark.createDataFrame([(json.dumps({"number": number, "tables": sorted(tables), **facts}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/current")
    if number > 2:
        p, fs = _fs(spark, f"{path}/{number - 2}")
        fs.delete(p, True)


def load_state(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The tables of the current state; None where there is none."""
    now = _current(spark, path)
    return now and {name: spark.read.parquet(f"{path}/{now['number']}/{name}") for name in now["tables"]}


def cache_key(query: str, mode: str, offset: int = 0, limit: int = 10, principal: str | None = None, groups: list[str] | None = None, filters: dict | None = None) -> str:
    """What a page of results depends on; who asks is part of it, so nobody gets a page made for another."""
    return hashlib.sha256(json.dumps([query.strip(), mode, offset, limit, principal, sorted(groups or []), sorted((filters or {}).items())]).encode()).hexdigest()


class ResultCache:
    """Pages of results (a few rows each) kept for some seconds."""

    def __init__(self, spark: SparkSession, path: str, seconds: int = CACHE_SECONDS, entries: int = CACHE_ENTRIES) -> None:
        self.spark, self.path, self.seconds, self.entries = spark, path.rstrip("/"), seconds, entries

    def _kept(self) -> list[tuple[int, str]]:
        """(saved_ts, key) of the entries, oldest first, from their folders' names."""
        p, fs = _fs(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted((int(n.split("-")[0]), n.split("-")[1]) for n in names if n.count("-") == 1 and _exists(self.spark, f"{self.path}/{n}/_SUCCESS"))

    def get(self, key: str, now: int) -> DataFrame | None:
        fresh = [ts for ts, k in self._kept() if k == key and 0 <= now - ts < self.seconds]
        return self.spark.read.parquet(f"{self.path}/{fresh[-1]}-{key}") if fresh else None

    def put(self, key: str, page: DataFrame, now: int) -> None:
        page.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{now}-{key}")
        kept = self._kept()
        for i, (ts, k) in enumerate(kept):
            if now - ts >= self.seconds or i < len(kept) - self.entries:
                self._delete(f"{ts}-{k}")

    def clear(self) -> None:
        """After the index changed."""
        for ts, k in self._kept():
            self._delete(f"{ts}-{k}")

    def _delete(self, name: str) -> None:
        p, fs = _fs(self.spark, f"{self.path}/{name}")
        fs.delete(p, True)
