"""Files as documents, seed lists, and tables of other programs."""

from __future__ import annotations

import os
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import Files
from .formats import extension_of, format_of_extension, is_supported, text_columns, text_udf

CHROMIUM_EPOCH = 11_644_473_600
_FIREFOX = "SELECT p.url, p.title, p.visit_count, MAX(v.visit_date) FROM moz_places p LEFT JOIN moz_historyvisits v ON v.place_id = p.id GROUP BY p.id ORDER BY p.id"


def scan(spark: SparkSession, folder: str, files: Files = Files()) -> DataFrame:
    """Supported files below a folder: path, modificationTime, length, content. Names and sizes are judged before contents are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    keep = is_supported(F.col("path")) & (F.col("length") <= files.max_file_bytes)
    below = F.concat(F.lit("/"), F.expr(f"substring(regexp_replace(path, '^[a-z]+:/*', '/'), {len(os.path.abspath(folder)) + 2})"))
    if files.ignore_hidden:
        keep = keep & ~below.rlike(r"/\.[^/]")
    for f in files.ignored_folders:
        keep = keep & ~below.contains(f"/{f}/")
    if files.ignored_extensions:
        keep = keep & ~extension_of(F.col("path")).isin(*files.ignored_extensions)
    return rows.filter(keep)


def documents(files: DataFrame) -> DataFrame:
    """Rows for an index from scanned files; doc_id is a hash of the path. Files are the owner's unless `public` is given."""
    path = F.regexp_replace("path", "^file:/*", "/")
    extension = extension_of(path)
    return files.select(
        F.xxhash64(path).alias("doc_id"), path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("file_name"), extension.alias("extension"),
        F.col("length").alias("size_bytes"), F.unix_seconds("modificationTime").alias("modified_unix"), text_udf(format_of_extension(extension), F.col("content")).alias("content"),
    )


def local_acl(path: str) -> dict:
    """World-readable files are public, others their owner's."""
    info = os.stat(path)
    public = bool(info.st_mode & 0o004)
    return {"owner": None if public else f"uid:{info.st_uid}", "allowed_principals": [], "allowed_groups": [], "public": public}


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """Addresses of a list with one a line; empty lines, comments and what is no web address go."""
    return spark.read.text(path).select(F.trim("value").alias("url")).filter(F.col("url").rlike(r"^(?i)https?://[^/\s]+"))


class SQLiteSource(DataSource):
    """spark.read.format("sqlite_text").load(file): table, row, text, with a partition for each table that has text columns."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_text"

    def schema(self) -> str:
        return "table string, row long, text string"

    def reader(self, schema) -> DataSourceReader:
        return _SQLiteReader(self.options["path"])


class _SQLiteReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((t, c)) for t, c in text_columns(self.path)]

    def read(self, partition: InputPartition):
        table, columns = partition.value
        names = ", ".join('"{}"'.format(c.replace('"', '""')) for c in columns)
        quoted = table.replace('"', '""')
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            for i, row in enumerate(db.execute(f'SELECT {names} FROM "{quoted}"')):
                yield table, i, " ".join(str(v) for v in row if v not in (None, ""))


class HistorySource(DataSource):
    """spark.read.format("browser_history").load(file): url, title, visit_count, visited_unix of a Chromium or Firefox database."""

    @classmethod
    def name(cls) -> str:
        return "browser_history"

    def schema(self) -> str:
        return "url string, title string, visit_count long, visited_unix long"

    def reader(self, schema) -> DataSourceReader:
        return _HistoryReader(self.options["path"])


class _HistoryReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def read(self, partition):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            tables = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
            if "urls" in tables:
                for url, title, n, t in db.execute("SELECT url, title, visit_count, last_visit_time FROM urls ORDER BY id"):
                    yield url, title, n, t // 1_000_000 - CHROMIUM_EPOCH if t else None
            else:
                for url, title, n, t in db.execute(_FIREFOX):
                    yield url, title, n, t // 1_000_000 if t is not None else None


def register(spark: SparkSession) -> None:
    """Makes the sources and SQL functions of the package known to a session."""
    from ..functions.text import nfkc
    from .html import extract_udf

    for source in (SQLiteSource, HistorySource):
        spark.dataSource.register(source)
    spark.udf.register("nfkc", nfkc)
    spark.udf.register("extract_html", extract_udf)


def export(found: DataFrame, path: str, kind: str = "json") -> None:
    """Results as JSON or CSV; nested columns go to CSV as JSON."""
    if kind == "csv":
        found = found.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in found.dtypes])
    getattr(found.write.mode("overwrite"), kind)(path)
