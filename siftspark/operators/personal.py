"""Personal ranking: a small logistic model learned from clicks."""

from __future__ import annotations

import json
import math
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE, L2 = 0.02, 0.001
NAMES = ("bias", "edu_or_gov", "favourite_kind", "recency", "base_score")


def features(page: DataFrame, favourite: str | None = None) -> DataFrame:
    """A page of results with f_edu, f_kind, f_recency and f_score: min-max over the page, a half where all are equal. A page is small: its extremes are one row."""
    ends = page.agg(F.min("modified_unix").alias("_m0"), F.max("modified_unix").alias("_m1"), F.min("score").alias("_s0"), F.max("score").alias("_s1"))

    def scaled(x: str, low: str, high: str) -> Column:
        return F.when(F.col(high) > F.col(low), (F.col(x) - F.col(low)) / (F.col(high) - F.col(low))).otherwise(0.5)

    edu = F.coalesce(F.col("domain").rlike(r"\.(edu|gov)$"), F.lit(False)).cast("double")
    kind = F.lit(0.0) if favourite is None else (F.col("source_kind") == favourite).cast("double")
    return page.crossJoin(F.broadcast(ends)).withColumns({"f_edu": edu, "f_kind": kind, "f_recency": scaled("modified_unix", "_m0", "_m1"), "f_score": scaled("score", "_s0", "_s1")}).drop("_m0", "_m1", "_s0", "_s1")


def predicted(weights: list[float]) -> Column:
    z = F.lit(float(weights[0]))
    for w, c in zip(weights[1:], ("f_edu", "f_kind", "f_recency", "f_score")):
        z = z + float(w) * F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))
    return 1 / (1 + F.exp(-z))


def boosted(page: DataFrame, weights: list[float], favourite: str | None = None) -> DataFrame:
    """The page in its personal order: score times 0.85 + 0.3 p, which leaves it alone before anything was learned."""
    out = features(page, favourite)
    return out.withColumn("score", F.col("score") * (0.85 + 0.3 * predicted(weights))).orderBy(F.desc("score"), "doc_id")


def train(weights: list[float], shown: list[tuple[float, float, float, float]], clicked: int | None) -> list[float]:
    """Weights after one page: results above the clicked one count as 0, the clicked one as 1, in their order. Without a click nothing changes."""
    if clicked is None:
        return list(weights)
    w = list(weights)
    for i, f in enumerate(shown[: clicked + 1]):
        x = [1.0, *(min(max(v, 0.0), 1.0) for v in f)]
        error = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x)))) - (i == clicked)
        w = [a - RATE * (error * b + L2 * a) for a, b in zip(w, x)]
    return w


def train_users(pages: DataFrame) -> DataFrame:
    """(user_id, weights) from rows (user_id, page, rank, clicked, f_edu, f_kind, f_recency, f_score): each user's pages in order, folded in the JVM."""
    one = F.struct("page", "rank", "clicked", "f_edu", "f_kind", "f_recency", "f_score")
    # Rows up to the first click of a page that has one.
    from pyspark.sql import Window

    first = F.min(F.when(F.col("clicked"), F.col("rank"))).over(Window.partitionBy("user_id", "page"))
    rows = pages.withColumn("_first", first).filter(F.col("rank") <= F.col("_first")).withColumn("clicked", F.col("rank") == F.col("_first"))
    zero = F.array(*[F.lit(0.0)] * 5)

    def step(w: Column, r: Column) -> Column:
        x = F.array(F.lit(1.0), *[F.least(F.greatest(r[c].cast("double"), F.lit(0.0)), F.lit(1.0)) for c in ("f_edu", "f_kind", "f_recency", "f_score")])
        z = sum((w[i] * x[i] for i in range(5)), F.lit(0.0))
        error = 1 / (1 + F.exp(-z)) - F.when(r["clicked"], 1.0).otherwise(0.0)
        return F.zip_with(w, x, lambda a, b: a - RATE * (error * b + L2 * a))

    return rows.groupBy("user_id").agg(F.aggregate(F.sort_array(F.collect_list(one)), zero, step).alias("weights"))


def feature_weights(weights: list[float]) -> list[tuple[str, float]]:
    return list(zip(NAMES, weights))


def load(path: str) -> list[float]:
    if not os.path.exists(path):
        return [0.0] * 5
    with open(path) as f:
        return [float(x) for x in json.load(f)["weights"]]


def save(weights: list[float], path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as f:
        json.dump({"weights": list(weights)}, f)
