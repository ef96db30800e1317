"""Spam signals and safety flags of extracted pages.

Pages have url, title, description, headings, paragraphs, alts and links array<struct<href,anchor,nofollow>>; text() joins what is indexed.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batch as B
from ..functions import text as T
from ..functions.urls import host_of

SUPPRESS_AT, FILTER_AT = 0.72, 0.6
BRANDS = tuple(sorted("paypal apple microsoft google amazon netflix bankofamerica wellsfargo chase irs usps fedex dhl".split()))
SHORTENERS = tuple("buff.ly is.gd ow.ly goo.gl t.co tinyurl.com bit.ly".split())
VENDORS = tuple(f".{v}.com" for v in ("google", "github", "apple", "microsoft"))
URGENCY = ("final notice", "limited time", "verify immediately", "account will be suspended", "act now")
PAYMENT = ("claim your prize", "processing fee", "send bitcoin", "wire transfer", "gift card")
PRESSURE = ("update required immediately", "click to fix", "driver is outdated", "your computer is infected")
EXPLICIT = ("adult content warning", "nsfw content warning", "porn", "xxx")


def text() -> Column:
    """What is indexed of a page."""
    parts = F.concat(F.array(F.col("title"), F.col("description")), F.col("headings"), F.col("paragraphs"), F.col("alts"))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " \n ")


def n_words(t: Column) -> Column:
    return F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))


def _clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def thin_content(t: Column) -> Column:
    n = n_words(t)
    return F.when(n < 50, 0.85).when(n < 150, 0.5).when(n < 300, 0.2).otherwise(0.0)


def keyword_stuffing(n: Column, most: Column) -> Column:
    """From the share of the most frequent of n words."""
    return F.when(n < 20, 0.0).otherwise(_clamp((most / n - 0.03) / 0.10))


def doorway_page(t: Column, links: Column) -> Column:
    n, each = F.size(links), F.greatest(n_words(t), F.lit(1)) / F.greatest(F.size(links), F.lit(1))
    return F.when((n >= 5) & (each < 15), 0.8).when((n >= 10) & (each < 30), 0.5).otherwise(0.0)


def affiliate_links(links: Column, host: Column) -> Column:
    n = F.size(links)
    outside = F.size(F.filter(links, lambda x: (F.coalesce(host, F.lit("")) != "") & F.coalesce(host_of(x["href"]) != host, F.lit(False))))
    share = F.try_divide(outside, n)
    return F.when(n == 0, 0.0).when((share > 0.8) & (n >= 8), 0.7).when(share > 0.6, 0.35).otherwise(0.0)


def repetition(n: Column, runs: Column) -> Column:
    """From the share of distinct three-word runs among those of n words."""
    return F.when(n < 30, 0.0).otherwise(_clamp((0.75 - runs / F.greatest(n - 2, F.lit(1))) / 0.4))


def boilerplate(headings: Column, paragraphs: Column) -> Column:
    p, h = (F.aggregate(c, F.lit(0), lambda a, x: a + n_words(x)) for c in (paragraphs, headings))
    return F.when(p + h == 0, 0.6).when(p * 4 < p + h, 0.4).otherwise(0.0)


SIGNALS = ("thin_content", "keyword_stuffing", "doorway_page", "affiliate_links", "repetition", "boilerplate")


def spam(pages: DataFrame) -> DataFrame:
    """pages with a column for each signal, spam_score, their mean, and suppress. Words are counted for whole batches, all else within the row."""
    rows = B.over_words(pages.withColumn("_text", text()), F.col("_text"), [*pages.columns, "_text"], "_n int, _most int, _runs int", B.count_arrays)
    t, n = F.col("_text"), F.col("_n")
    values = (thin_content(t), keyword_stuffing(n, F.col("_most")), doorway_page(t, F.col("links")), affiliate_links(F.col("links"), host_of(F.col("url"))), repetition(n, F.col("_runs")), boilerplate(F.col("headings"), F.col("paragraphs")))
    out = rows.withColumns({k: v.cast("double") for k, v in zip(SIGNALS, values)}).drop("_text", "_n", "_most", "_runs")
    return out.withColumn("spam_score", sum((F.col(k) for k in SIGNALS), F.lit(0.0)) / len(SIGNALS)).withColumn("suppress", F.col("spam_score") >= SUPPRESS_AT)


def _any(t: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(or_, [F.instr(t, p) > 0 for p in phrases])


def brand_impersonation(host: Column) -> Column:
    out = F.lit(None).cast("string")
    for b in BRANDS:
        own = host.isin(f"{b}.com", f"{b}.co", f"{b}.gov") | host.endswith(f".{b}.com")
        out = F.coalesce(out, F.when(F.contains(host, F.lit(b)) & ~own, b))
    return out


def flags(url: Column, t: Column, links: Column) -> Column:
    """array<struct<category,confidence>> of the flags that hold; t is the lower-case text."""
    host = F.coalesce(host_of(url), F.lit(""))
    login = F.contains(t, F.lit("password")) & _any(t, ("verify your account", "log in", "sign in"))
    risky = F.when(~url.startswith("https://"), 0.55).when(host.isin(*SHORTENERS), 0.6)
    lure = F.exists(links, lambda x: F.lower(x["href"]).rlike(r"\.(exe|msi|apk|scr)$")) & _any(t, PRESSURE) & ~reduce(or_, [host.endswith(v) for v in VENDORS])
    hits = sum((F.contains(t, F.lit(p)).cast("int") for p in EXPLICIT), F.lit(0))

    def flag(category: str, confidence: Column) -> Column:
        return F.when(confidence.isNotNull(), F.struct(F.lit(category).alias("category"), confidence.cast("double").alias("confidence")))

    return F.filter(
        F.array(
            flag("phishing", F.when(brand_impersonation(host).isNotNull(), 0.7)), flag("phishing", F.when(login, risky)), flag("scam", F.when(_any(t, URGENCY) & _any(t, PAYMENT), 0.75)),
            flag("malicious", F.when(lure, 0.65)), flag("explicit", F.when(hits > 0, F.least(F.lit(0.9), 0.4 + 0.2 * hits))),
        ),
        lambda x: x.isNotNull(),
    )


def policy(pages: DataFrame, blocklist: DataFrame | None = None) -> DataFrame:
    """pages with flags, policy_flag (the first of highest confidence), blocklisted and filtered. blocklist: domain."""
    out = pages.withColumn("flags", T.bound(F.lower(text()), lambda t: flags(F.col("url"), t, F.col("links"))))
    if blocklist is None:
        out = out.withColumn("blocklisted", F.lit(False))
    else:
        listed = blocklist.filter("domain <> ''").select(F.col("domain").alias("_d")).distinct()
        # A host is listed itself or ends in a listed name: every ending of a host is looked up, an equi-join whatever the list's size.
        host = F.coalesce(host_of(F.col("url")), F.lit(""))
        ends = out.select(host.alias("_host")).distinct().select("_host", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("_host"), F.lit(1))), lambda i: F.substring(F.col("_host"), i, 4096))).alias("_d"))
        bad = ends.join(listed, "_d").select("_host").distinct().withColumn("blocklisted", F.lit(True))
        out = out.withColumn("_host", host).join(bad, "_host", "left").drop("_host").withColumn("blocklisted", F.coalesce("blocklisted", F.lit(False)))
    best = F.array_max(F.transform("flags", lambda x: x["confidence"]))
    out = out.withColumn("policy_flag", F.try_element_at(F.filter("flags", lambda x: x["confidence"] == best), F.lit(1)))
    return out.withColumn("filtered", F.col("blocklisted") | F.exists("flags", lambda x: x["confidence"] >= FILTER_AT))
