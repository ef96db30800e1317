"""Link graph, PageRank and the reliability of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Ranking
from ..functions.urls import resolve_udf
from ..plans.tables import dropped, written

DAMPING, ROUNDS, ENOUGH = 0.85, 100, 1e-6
CUT_EVERY = 2


def resolve_edges(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(src, dst, anchor) from links (doc_id, url, href, anchor, nofollow) to pages (doc_id, url): followed links between pages, none to itself."""
    targets = pages.select(F.col("doc_id").alias("dst"), F.col("url").alias("_target"))
    found = links.filter(~F.coalesce("nofollow", F.lit(False))).select(F.col("doc_id").alias("src"), resolve_udf("url", "href").alias("_target"), "anchor")
    return found.join(targets, "_target").filter("src <> dst").select("src", "dst", "anchor")


def incoming(edges: DataFrame) -> DataFrame:
    """(dst, in_links, in_pages): links and distinct pages that lead to a page."""
    return edges.groupBy("dst").agg(F.count(F.lit(1)).alias("in_links"), F.count_distinct("src").alias("in_pages"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, enough: float | None = ENOUGH) -> DataFrame:
    """(doc_id, rank) for nodes (doc_id) and edges (src, dst): power iteration, the rank of pages without links spread over all.

    Edges are written once, hashed by source; ranks are written every CUT_EVERY rounds, when the largest change is also compared with `enough`
    (None: all rounds are done)."""
    ids = written(nodes.select("doc_id").distinct(), "nodes")
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    inside = edges.select("src", "dst").filter("src <> dst").distinct().join(ids.withColumnRenamed("doc_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("doc_id", "dst"), "dst", "left_semi")
    inside = written(inside.join(inside.groupBy("src").agg(F.count(F.lit(1)).alias("out")), "src").repartition("src"), "edges")
    linking = written(ids.join(inside.select(F.col("src").alias("doc_id")).distinct().withColumn("links", F.lit(True)), "doc_id", "left").withColumn("links", F.coalesce("links", F.lit(False))), "linking")
    kept = start = linking.withColumn("rank", F.lit(1.0 / n))
    old: list[DataFrame] = []
    for r in range(1, rounds + 1):
        shares = kept.join(inside, kept["doc_id"] == inside["src"]).groupBy(F.col("dst").alias("doc_id")).agg(F.sum(F.col("rank") / F.col("out")).alias("_in"))
        lost = kept.agg(F.coalesce(F.sum(F.when(~F.col("links"), F.col("rank"))), F.lit(0.0)).alias("_lost"))  # one row
        kept = kept.select("doc_id", "links").join(shares, "doc_id", "left").crossJoin(F.broadcast(lost)).select("doc_id", "links", ((1 - damping) / n + damping * (F.coalesce("_in", F.lit(0.0)) + F.col("_lost") / n)).alias("rank"))
        if r % CUT_EVERY == 0 or r == rounds:
            kept = written(kept, "ranks")
            change = None
            if enough is not None:
                change = kept.join(start.select("doc_id", F.col("rank").alias("_old")), "doc_id").agg(F.max(F.abs(F.col("rank") - F.col("_old")))).first()[0]
            for t in old:
                dropped(t)
            old, start = [kept], kept
            if change is not None and change < enough:
                break
    return kept.select("doc_id", "rank")


def top_pages(ranks: DataFrame, limit: int = 10) -> DataFrame:
    return ranks.orderBy(F.desc("rank"), "doc_id").limit(limit)


def reliability(pages: DataFrame, in_degree: Column, n_pages: Column, ranking: Ranking = Ranking()) -> DataFrame:
    """pages (url, domain, redirect_chain, author) with reliability 0..100, its label and factors."""
    domain = F.col("domain")
    trusted = domain.isin(*ranking.trusted_domains) if ranking.trusted_domains else F.lit(False)
    spam = domain.isin(*ranking.spam_domains) if ranking.spam_domains else F.lit(False)
    linked = F.least(F.greatest(F.round(in_degree / n_pages * 200), F.lit(0)), F.lit(20)).cast("int")

    def factor(when: Column, label: str, points: Column | int) -> Column:
        return F.when(when, F.struct(F.lit(label).alias("label"), (F.lit(points) if isinstance(points, int) else points).cast("int").alias("points")))

    https = F.lower("url").startswith("https://")
    factors = F.filter(
        F.array(
            factor(https, "encrypted", 10), factor(~https, "not encrypted", -15), factor(trusted, "trusted domain", 20), factor(~trusted & spam, "doubtful domain", -40),
            factor(domain.rlike(r"\.(gov|edu)$"), "institution", 15), factor((n_pages > 1) & (linked > 0), "linked by others", linked),
            factor(F.size(F.coalesce("redirect_chain", F.array().cast("array<string>"))) > 2, "many redirects", -10), factor(F.col("author").isNotNull(), "named author", 5),
        ),
        lambda x: x.isNotNull(),
    )
    out = pages.withColumn("factors", factors)
    score = F.least(F.greatest(F.aggregate("factors", F.lit(50), lambda a, x: a + x["points"]), F.lit(0)), F.lit(100))
    out = out.withColumn("reliability", score)
    return out.withColumn("reliability_label", F.when(F.col("reliability") >= 70, "high").when(F.col("reliability") >= 40, "moderate").otherwise("low"))
