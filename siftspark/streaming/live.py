"""Live index and live measures with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.index import Index

BURST, REFILL, TICK_SECONDS = 50, 100, 60


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last change (kind upsert or delete, seq, and the columns of a document) of each path."""
    last = Window.partitionBy("path").orderBy(F.desc("seq"))
    return changes.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")


def apply_changes(index: Index, changes: DataFrame) -> Index:
    """The index after the changes: tables lose the rows of changed documents and gain those of upserted ones, whose texts alone are read."""
    last = latest_changes(changes)
    new = last.filter("kind = 'upsert'")
    old = index.docs.select("doc_id", "path")
    gone = old.join(last.select("path"), "path", "left_semi").select("doc_id")
    return index.changed(gone, new)


def watch(changes: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Applies a stream of changes to the index at path: each batch is written as a new version, then made current; a batch done twice gives the same tables."""

    def batch(df: DataFrame, number: int) -> None:
        if df.head(1):
            index = Index.load(df.sparkSession, path, check=False)
            # A version of its own, so the tables that are read are never overwritten.
            apply_changes(index, df).save(path, max(number + 2, Index.version(df.sparkSession, path) + 1))

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def file_events(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """New and changed files of a folder as a stream."""
    return spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)


def session_metrics(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a stream (session_id, event_time, kind): impressions and clicks by session window. Goes beyond the batch measures: sessions close by watermark."""
    kinds = [F.count(F.when(F.col("kind") == k, 1)).alias(f"{k}s") for k in ("impression", "click")]
    return events.withWatermark("event_time", late).groupBy("session_id", F.session_window("event_time", gap)).agg(*kinds)


def take(state: tuple[float, float] | None, now: float, n: int) -> tuple[tuple[float, float], bool]:
    """((tokens, last refill), granted): a bucket starts full at BURST and gains REFILL, up to BURST, for each whole tick."""
    tokens, last = state or (float(BURST), now)
    ticks = int((now - last) // TICK_SECONDS)
    if ticks > 0:
        tokens, last = min(float(BURST), tokens + ticks * REFILL), last + ticks * TICK_SECONDS
    return ((tokens - n, last), True) if tokens >= n else ((tokens, last), False)


class TokenBucket(StatefulProcessor):
    """Rows (key, ts, n) in time order to (key, ts, granted)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "tokens double, last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values("ts", kind="stable")
        now = self.state.get() if self.state.exists() else None
        granted = []
        for ts, n in zip(got["ts"], got["n"]):
            now, ok = take(now, float(ts), int(n))
            granted.append(ok)
        self.state.update(now)
        yield pd.DataFrame({"key": got["key"], "ts": got["ts"], "granted": granted})

    def close(self) -> None:
        pass


LIMITED = "key string, ts double, granted boolean"


def rate_limited(requests: DataFrame) -> DataFrame:
    """A stream of requests through a bucket for each key. Needs the RocksDB state store."""
    return requests.groupBy("key").transformWithStateInPandas(TokenBucket(), LIMITED, "Append", "None")


def rate_limited_batch(requests: DataFrame) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, state, out = rows.sort_values("ts", kind="stable"), None, []
        for ts, n in zip(rows["ts"], rows["n"]):
            state, ok = take(state, float(ts), int(n))
            out.append(ok)
        return pd.DataFrame({"key": rows["key"], "ts": rows["ts"].astype("float64"), "granted": out})

    return requests.groupBy("key").applyInPandas(run, LIMITED)


def validated(query: str, offset: int = 0, limit: int = 10) -> tuple[str, int, int]:
    """The request, if it is within bounds."""
    if not query.strip() or len(query.encode()) > 256:
        raise ValueError("a query has 1 to 256 bytes")
    if not 0 <= offset <= 100 or not 0 < limit <= 100:
        raise ValueError("offset is 0 to 100 and limit 1 to 100")
    return query, offset, limit


def schema_of_changes() -> StructType:
    return StructType.fromDDL("kind string, seq bigint, doc_id bigint, path string, file_name string, extension string, size_bytes bigint, modified_unix bigint, content string")
