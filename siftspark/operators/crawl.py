"""Crawling over tables: frontier, politeness, robots rules, sitemaps, feeds and the page pipeline."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Crawl
from ..functions import text as T
from ..functions.urls import canonical_udf, domain_allowed, domain_of
from ..plans.tables import written
from ..sources import store
from ..sources.html import extracted
from . import classify, dedup

PRIORITIES = {"seed": 100, "sitemap": 75, "feed": 50, "link": 10}
AGENT = "siftspark"


def push(frontier: DataFrame, found: DataFrame, seen: DataFrame) -> DataFrame:
    """frontier and found (url, domain, depth, priority, seq) without what was seen: the first entry of a URL stays, whatever the later one's priority."""
    rows = frontier.unionByName(found)
    first = rows.groupBy("url").agg(F.min_by(F.struct("domain", "depth", "priority", "seq"), F.struct("seq", "depth", "domain")).alias("_r")).select("url", "_r.*")
    return first.join(seen.select("url"), "url", "left_anti")


def schedule(frontier: DataFrame, delays: DataFrame | None = None, delay_millis: int = 1000) -> DataFrame:
    """frontier with turn, its place within its domain, and ready_millis, when the domain's delay lets it be fetched. delays: domain, delay_millis."""
    order = Window.partitionBy("domain").orderBy(F.desc("priority"), "depth", "url")
    out = frontier.withColumn("turn", F.row_number().over(order) - 1)
    if delays is None:
        return out.withColumn("ready_millis", F.col("turn").cast("long") * delay_millis)
    own = delays.groupBy("domain").agg(F.max("delay_millis").alias("_d"))
    return out.join(own, "domain", "left").withColumn("ready_millis", F.col("turn").cast("long") * F.coalesce("_d", F.lit(delay_millis))).drop("_d")


def pop(frontier: DataFrame, limit: int, per_domain: int = 1) -> DataFrame:
    """The next fetches: best priority, then least depth, at most so many of a domain."""
    return schedule(frontier).filter(F.col("turn") < per_domain).orderBy(F.desc("priority"), "depth", "url").limit(limit)


def parse_robots(body: str) -> list[dict]:
    """Rules of a robots.txt: group, agents, prefix, allow, delay; a group without rules has one of no prefix that allows."""
    groups: list[dict] = []
    started = True
    for line in body.splitlines():
        key, colon, value = line.split("#", 1)[0].strip().partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            if started:
                groups.append({"agents": [], "rules": [], "delay": None})
                started = False
            groups[-1]["agents"].append(value.lower())
        elif key in ("allow", "disallow", "crawl-delay"):
            started = True
            if not groups:
                continue
            if key == "crawl-delay":
                groups[-1]["delay"] = float(value) if re.fullmatch(r"\d*\.?\d+", value) else None
            else:
                groups[-1]["rules"].append((value, key == "allow" or not value))
    return [{"grp": i, "agents": g["agents"], "prefix": p, "allow": a, "delay": g["delay"]} for i, g in enumerate(groups) for p, a in (g["rules"] or [("", True)])]


_RULES = "array<struct<grp:int,agents:array<string>,prefix:string,allow:boolean,delay:double>>"


def robots_rules(robots: DataFrame, agent: str = AGENT) -> DataFrame:
    """(domain, prefix, allow, delay) that bind an agent: of the first group that names it, else of the first for all. robots: domain, body."""

    def parse(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: parse_robots(b) if b else [])

    parse.__annotations__ = {"bodies": pd.Series, "return": pd.Series}
    rules = robots.select("domain", F.explode(F.pandas_udf(parse, _RULES)("body")).alias("_r")).select("domain", "_r.*")
    named = F.exists("agents", lambda a: (a != "*") & F.contains(F.lit(agent.lower()), a))
    rank = F.when(named, F.col("grp")).when(F.array_contains("agents", "*"), F.col("grp") + 1_000_000)
    ranked = rules.withColumn("_k", rank).filter(F.col("_k").isNotNull())
    first = ranked.groupBy("domain").agg(F.min("_k").alias("_first"))
    return ranked.join(first, "domain").filter("_k = _first").select("domain", "prefix", "allow", "delay")


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (domain, path, ...) with allowed: the longest matching prefix decides, an allowing one among equals, and nothing forbids."""
    own = rules.groupBy("domain").agg(F.collect_list(F.struct("prefix", "allow")).alias("_rules"))
    hits = F.filter("_rules", lambda r: F.startswith(F.col("path"), r["prefix"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.length(r["prefix"]).alias("n"), r["allow"].alias("allow"))))
    return urls.join(own, "domain", "left").withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("_rules")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def parse_sitemap(text: str) -> tuple[list[str], list[str]]:
    """(pages, further sitemaps) of a sitemap, an index of them or a plain list."""
    try:
        root = ElementTree.fromstring(text.strip())
    except ElementTree.ParseError:
        return [x.strip() for x in text.splitlines() if re.match(r"https?://", x.strip())], []
    found = [(_local(e.tag), (c.text or "").strip()) for e in root for c in e if _local(c.tag) == "loc" and (c.text or "").strip()]
    return [u for t, u in found if t == "url"], [u for t, u in found if t == "sitemap"]


def parse_feed(text: str) -> list[tuple[str, str]]:
    """(link, title) of the items of an RSS or Atom feed; of several links, the one without rel or of rel=alternate."""
    try:
        root = ElementTree.fromstring(text.strip())
    except ElementTree.ParseError:
        return []
    out = []
    for item in root.iter():
        if _local(item.tag) not in ("item", "entry"):
            continue
        title, link = "", ""
        for c in item:
            if _local(c.tag) == "title":
                title = "".join(c.itertext()).strip()
            elif _local(c.tag) == "link" and not link and c.get("rel", "alternate") == "alternate":
                link = (c.get("href") or c.text or "").strip()
        if link:
            out.append((link, title))
    return out


def discovered(spark, candidates: dict[str, DataFrame]) -> DataFrame:
    """(url, domain, priority): candidate urls by kind (seed, sitemap, feed, link), canonical, each with its best priority."""
    rows = None
    for kind, df in candidates.items():
        one = df.select(canonical_udf("url").alias("url"), F.lit(PRIORITIES[kind]).alias("priority"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.filter("url IS NOT NULL").groupBy("url").agg(F.max("priority").alias("priority")).withColumn("domain", domain_of(F.col("url")))


def found_in(bodies: DataFrame) -> DataFrame:
    """(url, kind, domain): what fetched sitemaps and feeds (kind, body) name; kind sitemap_index is a further sitemap to fetch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple[str, str]] = []
            for kind, body in zip(batch["kind"], batch["body"]):
                if kind == "feed":
                    rows += [(link, "feed") for link, _ in parse_feed(body or "")]
                else:
                    pages, more = parse_sitemap(body or "")
                    rows += [(u, "sitemap") for u in pages] + [(u, "sitemap_index") for u in more]
            yield pd.DataFrame(rows, columns=["url", "kind"])

    rows = bodies.select("kind", "body").mapInPandas(run, "url string, kind string").distinct()
    return rows.select(canonical_udf("url").alias("url"), "kind").filter("url IS NOT NULL").withColumn("domain", domain_of(F.col("url")))


def due(fetched: DataFrame, now: int, seconds: int = 86_400) -> DataFrame:
    """Pages (url, domain, fetched_unix) to fetch again: those last fetched so many seconds ago or more, as frontier rows of the least urgent kind."""
    last = fetched.groupBy("url", "domain").agg(F.max("fetched_unix").alias("_t")).filter(F.col("_t") <= now - seconds)
    return last.select("url", "domain", F.lit(0).alias("depth"), F.lit(PRIORITIES["link"]).alias("priority"), F.col("_t").alias("seq"))


def save_frontier(frontier: DataFrame, seen: DataFrame, path: str) -> None:
    store.save_state({"frontier": frontier, "seen": seen}, path)


def load_frontier(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(frontier, seen) as they were last saved; None before."""
    tables = store.load_state(spark, path)
    return tables and (tables["frontier"], tables["seen"])


def changed(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Fetched pages whose url and etag aren't known: a page without etag always counts as changed."""
    return pages.join(known.select("url", "etag").distinct(), ["url", "etag"], "left_anti")


def judged(pages: DataFrame, crawl: Crawl | None = None, copies: bool = True) -> DataFrame:
    """Extracted and classified pages (page_id, url, html) with `fate`: domain (not allowed), budget (beyond a domain's pages), filtered (unsafe), suppressed (spam), duplicate (of an earlier page
    that isn't one of these; unless copies stay) or indexed. Without crawl, every domain is allowed and no page is beyond a budget."""
    own = pages.withColumn("domain", domain_of(F.col("url")))
    fate = F.lit(None).cast("string")
    if crawl is not None:
        fate = F.when(~domain_allowed(F.col("domain"), list(crawl.allowed_domains)), "domain")
        if crawl.max_pages_per_domain:
            # A domain's pages are ranked by a window; its budget lets Spark keep no more than so many a task.
            turn = F.row_number().over(Window.partitionBy("domain").orderBy("page_id"))
            own = own.withColumn("_turn", turn)
            fate = fate.when(F.col("_turn") > crawl.max_pages_per_domain, "budget")
    out = classify.policy(classify.spam(extracted(own.withColumn("_fate", fate).drop("_turn")))).withColumn("content", classify.text())
    out = out.withColumn("_fate", F.coalesce("_fate", F.when(F.col("filtered"), "filtered").when(F.col("suppress"), "suppressed")))
    if not copies:
        out = written(out, "judged")  # pages are read and judged once, and looked at three times
        kept = out.filter("_fate IS NULL").select(F.col("page_id").alias("doc_id"), "content")
        near = written(dedup.sketched(kept), "sketches")
        first = kept.groupBy(T.exact_hash(F.col("content")).alias("h")).agg(F.min("doc_id").alias("_f"))
        exact = kept.select("doc_id", T.exact_hash(F.col("content")).alias("h")).join(first, "h").filter(F.col("_f") < F.col("doc_id")).select("doc_id")
        gone = exact.union(dedup.near_copies(near).select("doc_id")).distinct().select(F.col("doc_id").alias("page_id"), F.lit("duplicate").alias("_copy"))
        out = out.join(gone, "page_id", "left").withColumn("_fate", F.coalesce("_fate", "_copy")).drop("_copy")
    return out.withColumn("fate", F.coalesce("_fate", F.lit("indexed"))).drop("_fate")


def documents(pages: DataFrame, fetched_unix: int, crawl: Crawl | None = None, first_id: int = 1_000_000_000, copies: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Index rows of the pages that judged() lets in, with the columns `keep` of pages."""
    content = F.col("content")
    doc = judged(pages, crawl, copies).filter("fate = 'indexed'").select(
        (F.col("page_id") + first_id).alias("doc_id"), F.col("url").alias("path"), F.when(F.col("title") == "", F.col("url")).otherwise(F.col("title")).alias("file_name"), F.lit("html").alias("extension"),
        F.octet_length(content).cast("bigint").alias("size_bytes"), F.lit(fetched_unix).cast("bigint").alias("modified_unix"), content.alias("content"), "url", "domain", "title", "lang", "author",
        F.lit("text/html").alias("content_type"), F.lit(fetched_unix).cast("bigint").alias("fetched_unix"), F.array().cast("array<string>").alias("redirect_chain"), F.lit(0).alias("depth"), "spam_score", "policy_flag", "links", *keep,
    )
    return doc.withColumn("pagerank", F.lit(None).cast("double"))


def report(pages: DataFrame, crawl: Crawl | None = None, copies: bool = True, robots: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Counts of a crawl in one row. Pages that robots rules (domain, prefix, allow) forbid, or whose etag is known (url, etag), are counted and go no further."""
    count = lambda c: F.count(F.when(c, 1))
    forbidden = unchanged = F.lit(0).cast("long")
    offered = pages.agg(F.count(F.lit(1)).alias("fetched"))
    if robots is not None:
        ruled = robots_allowed(pages.withColumns({"domain": domain_of(F.col("url")), "path": F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("/"))}), robots)
        offered = offered.crossJoin(ruled.agg(count(~F.col("allowed")).alias("robots")))  # one row each
        pages, forbidden = ruled.filter("allowed").drop("allowed", "domain", "path"), F.col("robots")
    if known is not None:
        left = changed(pages, known)
        offered = offered.crossJoin(pages.agg(F.count(F.lit(1)).alias("_before")).crossJoin(left.agg(F.count(F.lit(1)).alias("_after"))))
        pages, unchanged = left, F.col("_before") - F.col("_after")
    own = judged(pages, crawl, copies).agg(
        *[count(F.col("fate") == k).alias(k) for k in ("domain", "budget", "filtered", "suppressed", "duplicate", "indexed")],
        F.coalesce(F.sum(F.when(F.col("fate") == "indexed", F.size("links"))), F.lit(0)).alias("links"), F.coalesce(F.sum(F.size("feeds")), F.lit(0)).alias("feeds"), F.count_distinct("domain").alias("domains"),
    )
    return own.crossJoin(offered).withColumns({"robots": forbidden, "unchanged": unchanged}).select("fetched", "domain", "budget", "filtered", "suppressed", "duplicate", "indexed", "robots", "unchanged", "links", "feeds", "domains")
