"""Merging of sources: normalised scores, duplicates across sources, results of peers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Ranking
from ..functions import scoring as S

WEIGHTS = {"federated": 0.85, "archive": 0.95, "email": 1.0, "pdf": 1.0, "web_page": 1.0, "note": 1.1, "local_file": 1.1}


def z_scores(rows: DataFrame, score: str, source: str, weights: dict[str, float]) -> DataFrame:
    """rows with normalized_score: the score's distance from its source's mean in population deviations, times the source's weight.

    Sources are few, so their statistics are a small table joined back rather than a window, which would gather each source in one task."""
    stats = rows.groupBy(F.col(source).alias("_s")).agg(F.avg(score).alias("_m"), F.stddev_pop(score).alias("_d"))
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col(source)], F.lit(1.0))
    z = F.when(F.col("_d") > 1e-6, (F.col(score) - F.col("_m")) / F.col("_d")).otherwise(0.0)
    return rows.join(stats, F.col(source).eqNullSafe(F.col("_s"))).withColumn("normalized_score", z * weight).drop("_s", "_m", "_d")


def merge(candidates: DataFrame, weights: dict[str, float] | None = None, principal: str | None = None, groups: list[str] | None = None) -> DataFrame:
    """Candidates (id, source, raw_score, acl, ...) of several sources in one order. Statistics include what the caller may not see."""
    scored = z_scores(candidates, "raw_score", "source", weights or WEIGHTS)
    return scored.filter(S.visible(F.col("acl"), principal, groups or [])).orderBy(F.desc("normalized_score"), "id")


def normalized(found: DataFrame, ranking: Ranking) -> DataFrame:
    return z_scores(found, "score", "source_kind", {**WEIGHTS, "local_file": ranking.local_boost})


def drop_cross_source(index, found: DataFrame, ranking: Ranking) -> DataFrame:
    """found without web pages that are near copies of a local result, at any number of results: fingerprints of both sides are compared by dedup.within."""
    from ..plans.tables import written
    from . import dedup

    bits = math.floor(64 * (1 - ranking.hybrid_dedup_min_similarity) + 1e-9)
    found = written(found, "found")  # looked at three times
    sides = found.select("doc_id", "is_web").join(index.fingerprints.select("doc_id", "hi", "lo"), "doc_id")
    gone = dedup.within(sides.filter("is_web"), sides.filter(~F.col("is_web")), bits).select(F.col("a").alias("doc_id")).distinct()
    return found.join(gone, "doc_id", "left_anti")


def with_peers(found: DataFrame, peers: DataFrame, limit: int = 10) -> DataFrame:
    """Own (id, title, source, score) rows and peers' (peer, id, title, score) rows, normalised together."""
    theirs = peers.select(F.concat_ws(":", "peer", F.col("id").cast("string")).alias("id"), F.concat(F.lit("["), F.col("peer"), F.lit("] "), F.col("title")).alias("title"), F.lit("federated").alias("source"), F.col("score").alias("raw_score"))
    own = found.select(F.col("id").cast("string").alias("id"), "title", "source", F.col("score").alias("raw_score"))
    return z_scores(own.unionByName(theirs), "raw_score", "source", WEIGHTS).orderBy(F.desc("normalized_score"), "id").limit(limit)


def peer_registry(spark, peers: list[tuple[str, str, bool]]) -> DataFrame:
    return spark.createDataFrame(peers, "peer string, url string, enabled boolean")


def first_of_copies(docs: DataFrame, key: str = "exact_hash") -> DataFrame:
    """Each row with the lowest doc_id of its hash."""
    return docs.withColumn("first_doc", F.min("doc_id").over(Window.partitionBy(key)))
