"""Lines that a site repeats, by their share of the site's pages.

A page is a row of documents and its site is `source`. A line (outer spaces aside) is boilerplate on a site when at least
`min_pages` of its pages have it and these are more than `ratio` of all its pages; every occurrence is then dropped there.

Lines are counted with a partial sum in each task, so a line or a site of a third of all pages is no more than a row a task. A site has fewer than
1 / ratio times its mean lines a page of boilerplate, which is what travels to its pages: by broadcast up to `BROADCAST_LINES`, else by shuffle, where the
pages of a site of more than `SITE_PAGES` are spread over as many parts as it has times that.

Defined results: blank lines are kept and never counted; a page counts once for a line that it repeats; a row without a site
is left alone; a null text stays null with no lines, an empty one is one blank line; a very long line counts by its digest like any other; a line at
exactly the ratio stays; repeated rows are pages of their own; pages whose lines all go have an
empty text; an empty table gives no rows; columns other than source and text, and doc_id for spreading if there is one, aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import unused, written

RATIO = 0.02
MIN_PAGES = 3
#: Boilerplate lines (16-byte digests) that may be sent to every executor; beyond, sites are joined by shuffle.
BROADCAST_LINES = 500_000
#: Pages of a site from which they are spread; there are fewer such sites than pages / SITE_PAGES.
SITE_PAGES = 100_000


def _key(line):
    return F.unhex(F.md5(F.trim(line)))


def boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(source, pages, lines): digests of each site's boilerplate lines."""
    pages = docs.filter("source IS NOT NULL").select("source", "text")
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), _key))
    counted = pages.select("source", F.explode(lines).alias("line")).groupBy("source", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    totals = pages.groupBy("source").agg(F.count(F.lit(1)).alias("pages"))
    return counted.join(totals, "source").filter(F.col("n") / F.col("pages") > ratio).groupBy("source", "pages").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The given rows with `text` rid of boilerplate, and n_lines, n_dropped added (in place of columns of these names)."""
    bad = written(boilerplate(docs, ratio, min_pages), "lines")
    few = (bad.agg(F.sum(F.size("lines"))).first()[0] or 0) <= BROADCAST_LINES
    site, marked, left, part, parts = (unused(c, docs.columns) for c in ("_site", "_boilerplate", "_kept", "_salt", "_salts"))
    names = docs.columns
    bad = bad.select(F.col("source").alias(site), F.col("lines").alias(marked), F.ceil(F.col("pages") / SITE_PAGES).cast("int").alias(parts))
    on = docs["source"] == F.col(site)
    if few:
        joined = docs.join(F.broadcast(bad.drop(parts)), on, "left")
    else:
        spread = F.broadcast(bad.filter(F.col(parts) > 1).select(site, parts))  # fewer than pages / SITE_PAGES
        row = F.xxhash64(*[F.col(c) for c in ("doc_id", "text") if c in names])
        salted = docs.join(spread, on, "left").drop(site).withColumn(part, F.when(F.col(parts).isNull(), 0).otherwise(F.pmod(row, F.col(parts))).cast("int")).drop(parts)
        copies = bad.withColumn(parts, F.explode(F.sequence(F.lit(0), F.col(parts) - 1)))
        joined = salted.join(copies, (salted["source"] == copies[site]) & (salted[part] == copies[parts]), "left")
    docs = joined
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x: F.col(marked).isNull() | (F.trim(x) == "") | ~F.array_contains(marked, _key(x)))
    rest = [c for c in names if c not in ("text", "n_lines", "n_dropped")]
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    staged = docs.select(*[F.col(f"`{c}`") for c in rest], kept.alias(left), n.alias("n_lines"))
    gone = F.when(F.col(left).isNull(), 0).otherwise(F.col("n_lines") - F.size(left))
    return staged.select(*[F.col(f"`{c}`") for c in rest], F.array_join(left, "\n").alias("text"), "n_lines", gone.alias("n_dropped"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))


QUERIES = {"op9_line_dedup": op9_line_dedup}
SQL = {
    "op9_line_dedup": f"""
WITH numbered AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents
), line AS (
  SELECT r, source, u.i AS i, u.x AS x
  FROM numbered, LATERAL (SELECT unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i) u
), pages AS (SELECT source, count(*) AS pages FROM documents WHERE source IS NOT NULL GROUP BY 1
), bad AS (
  SELECT source, trim(x) AS x FROM (SELECT DISTINCT r, source, trim(x) AS x FROM line WHERE trim(x) <> '') JOIN pages USING (source)
  GROUP BY source, trim(x), pages HAVING count(*) >= {MIN_PAGES} AND count(*) / pages > {RATIO}
), kept AS (
  SELECT line.r, count(*) AS n_lines, count(*) FILTER (bad.x IS NOT NULL) AS n_dropped,
         coalesce(string_agg(line.x, chr(10) ORDER BY i) FILTER (bad.x IS NULL), '') AS text
  FROM line LEFT JOIN bad ON line.source = bad.source AND trim(line.x) = bad.x GROUP BY 1
)
SELECT doc_id, source, kept.text, coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_dropped, 0)::INT AS n_dropped
FROM numbered LEFT JOIN kept USING (r)"""
}
