"""Measures of a search service's events and of its relevance against judgements."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LONG_CLICK, REFORMULATION = 30.0, 120
_SAMPLE = {
    "bread": {"sourdough": 3, "rye": 2, "toaster": 0, "flour": 1},
    "solar panels": {"photovoltaics": 3, "inverter": 2, "lunar": 0},
    "train times": {"timetable": 3, "station": 1, "gym": 0},
}


def click_through(impressions: DataFrame, clicks: DataFrame) -> DataFrame:
    """One row: ctr and abandonment. An impression is clicked if its session has any click on its query, whenever; without impressions ctr is 0."""
    marked = impressions.join(clicks.select("session_id", "query").distinct().withColumn("_c", F.lit(1)), ["session_id", "query"], "left")
    ctr = F.coalesce(F.try_divide(F.count("_c"), F.count(F.lit(1))), F.lit(0.0))
    return marked.agg(ctr.alias("ctr"), (1 - ctr).alias("abandonment"))


def reformulation(impressions: DataFrame) -> DataFrame:
    """Share of a session's neighbouring searches that change the query within two minutes. Equal times are ordered by query."""
    w = Window.partitionBy("session_id").orderBy("ts", "query")
    pairs = impressions.select(F.col("query"), F.col("ts"), F.lead("query").over(w).alias("_q"), F.lead("ts").over(w).alias("_t")).filter("_t IS NOT NULL")
    changed = (F.col("_t") - F.col("ts") <= REFORMULATION) & (F.col("query") != F.col("_q"))
    return pairs.agg(F.coalesce(F.try_divide(F.count(F.when(changed, 1)), F.count(F.lit(1))), F.lit(0.0)).alias("reformulation"))


def long_clicks(clicks: DataFrame) -> DataFrame:
    long_ = F.count(F.when(F.col("dwell_seconds") >= LONG_CLICK, 1))
    return clicks.agg(F.coalesce(F.try_divide(long_, F.count("dwell_seconds")), F.lit(0.0)).alias("long_click_rate"))


def freshness(pages: DataFrame, crawled: str = "fetched_unix", modified: str = "modified_unix") -> DataFrame:
    return pages.agg(F.coalesce(F.avg(F.greatest(F.col(crawled) - F.col(modified), F.lit(0))), F.lit(0.0)).alias("freshness_lag"))


def snapshot(impressions: DataFrame, clicks: DataFrame, pages: DataFrame) -> DataFrame:
    """All measures in one row; each side has one row."""
    return click_through(impressions, clicks).crossJoin(reformulation(impressions)).crossJoin(long_clicks(clicks)).crossJoin(freshness(pages))


def histogram(latencies: DataFrame, bounds: tuple[float, ...] = (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000)) -> DataFrame:
    """(le, n): cumulative counts of `ms`, in one pass."""
    sums = latencies.agg(*[F.count(F.when(F.col("ms") <= b, 1)).alias(f"_{i}") for i, b in enumerate(bounds)], F.count(F.lit(1)).alias("_all"))
    rows = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("_all").alias("n")))
    return sums.select(F.inline(rows))


def relevance(ranked: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """(query, ndcg, rr, precision) for ranked (query, doc_id, rank from 1) and judged (query, doc_id, grade).

    Unjudged results have grade 0. ndcg is 1 where nothing relevant is judged; rr looks at all results; precision is over the results among the first k."""
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    best = Window.partitionBy("query").orderBy(F.desc("grade"), "doc_id")
    ideal = judged.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k).groupBy("query").agg(F.sum(gain / F.log2(F.col("_r") + 1.0)).alias("_ideal"))
    rows = ranked.join(judged, ["query", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    top = F.col("rank") <= k
    found = rows.groupBy("query").agg(
        F.sum(F.when(top, gain / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("_dcg"),
        F.coalesce(1.0 / F.min(F.when(F.col("grade") > 0, F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.coalesce(F.try_divide(F.count(F.when(top & (F.col("grade") > 0), 1)), F.count(F.when(top, 1))), F.lit(0.0)).alias("precision"),
    )
    out = judged.select("query").distinct().join(found, "query", "left").join(ideal, "query", "left")
    ndcg = F.when(F.coalesce("_ideal", F.lit(0.0)) <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("_dcg", F.lit(0.0)) / F.col("_ideal")))
    return out.select("query", ndcg.alias("ndcg"), F.coalesce("rr", F.lit(0.0)).alias("rr"), F.coalesce("precision", F.lit(0.0)).alias("precision"))


def suite(per_query: DataFrame) -> DataFrame:
    return per_query.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in ("ndcg", "rr", "precision")])


#: Queries whose search plans are united into one.
TOGETHER = 32


def run_suite(judged: DataFrame, search: Callable[[str], DataFrame], k: int = 10) -> DataFrame:
    """suite() of a search function that returns (doc_id, rank) for a query. Every TOGETHER queries are one plan, whose ranks are written, so plans stay small at any number of queries."""
    from ..plans.tables import written

    queries = [r.query for r in judged.select("query").distinct().orderBy("query").toLocalIterator()]
    tables = []
    for at in range(0, len(queries), TOGETHER):
        parts = [search(q).select(F.lit(q).alias("query"), "doc_id", "rank") for q in queries[at : at + TOGETHER]]
        tables.append(written(reduce(DataFrame.unionByName, parts), "ranked"))
    ranked = reduce(DataFrame.unionByName, tables) if tables else judged.select("query", "doc_id", F.lit(1).alias("rank"))
    return suite(relevance(ranked, judged, k))


def regression(baseline: DataFrame, current: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """One row: the change of each mean and whether none fell by more than the tolerance."""
    names = ("mean_ndcg", "mean_rr", "mean_precision")
    both = baseline.select(*[F.col(c).alias(f"_{c}") for c in names]).crossJoin(current)
    deltas = [(F.col(c) - F.col(f"_{c}")).alias(c.replace("mean", "delta")) for c in names]
    ok = F.lit(True)
    for c in names:
        ok = ok & (F.col(c) - F.col(f"_{c}") >= -tolerance)
    return both.select(*deltas, ok.alias("passed"))


def sample_judgements(spark) -> DataFrame:
    return spark.createDataFrame([(q, d, g) for q, docs in _SAMPLE.items() for d, g in docs.items()], "query string, doc_id string, grade int")
