"""Completion, spelling, history and clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_word

HISTORY = 50
SHOWN_SECONDS = 6 * 3600


def complete(vocab: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Terms that begin so, most frequent first; frequencies count 1 at least."""
    return vocab.filter(F.col("term").startswith(normalize_word(prefix))).select("term", F.greatest("df", F.lit(1)).alias("df")).orderBy(F.desc("df"), "term").limit(limit)


def _near(word, term):
    return (F.abs(F.octet_length(word) - F.octet_length(term)) <= 2) & (F.levenshtein(word, term, 2) >= 1)


def spelling(vocab: DataFrame, term: str, limit: int = 5) -> DataFrame:
    """Known terms within two edits, nearest first; none for a known term."""
    word = F.lit(normalize_word(term))
    known = F.broadcast(vocab.filter(F.col("term") == word).select(F.lit(1).alias("_k")).limit(1))  # one row
    near = vocab.filter(_near(word, F.col("term"))).select("term", F.levenshtein(word, F.col("term")).alias("distance"))
    return near.join(known, F.lit(True), "left_anti").orderBy("distance", "term").limit(limit)


def did_you_mean(vocab: DataFrame, query: str, each: int = 3) -> DataFrame:
    """(word, term, distance): suggestions for each unknown word of a query."""
    words = list(dict.fromkeys(normalize_word(w) for w in query.split()))
    spark = vocab.sparkSession
    asked = F.broadcast(spark.createDataFrame([(w,) for w in words], "word string"))  # the words of one query
    known = vocab.join(asked, F.col("term") == F.col("word")).select("word")
    near = vocab.join(asked, _near(F.col("word"), F.col("term"))).select("word", "term", F.levenshtein("word", "term").alias("distance")).join(known, "word", "left_anti")
    best = Window.partitionBy("word").orderBy("distance", "term")
    return near.withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= each).drop("_k")


def history(searches: DataFrame, limit: int = HISTORY) -> DataFrame:
    """Distinct queries of searches (query, ts), most recent first."""
    return searches.groupBy("query").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("times")).orderBy(F.desc("last_ts"), "query").limit(limit)


def popular(searches: DataFrame, limit: int = 10) -> DataFrame:
    return searches.groupBy("query").agg(F.count(F.lit(1)).alias("times")).orderBy(F.desc("times"), "query").limit(limit)


def clicks(events: DataFrame) -> DataFrame:
    return events.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def last_shown(shown: DataFrame, query: str, mode: str, rank: int, now: int) -> DataFrame:
    """The document of that rank in the last page of the same query and mode, if that is no older than six hours. shown: query, mode, rank, doc_id, saved_ts."""
    rows = shown.filter((F.col("query") == query) & (F.col("mode") == mode) & F.col("saved_ts").between(now - SHOWN_SECONDS, now))
    newest = rows.agg(F.max("saved_ts").alias("_t"))
    return rows.filter(F.col("rank") == rank).join(F.broadcast(newest), F.col("saved_ts") == F.col("_t")).select("doc_id", "saved_ts")


def frequent_kind(clicks: DataFrame, docs: DataFrame) -> DataFrame:
    """The kind of source with most clicks; ties go to the first in order."""
    return clicks.join(docs.select("doc_id", "source_kind"), "doc_id").groupBy("source_kind").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "source_kind").limit(1)
