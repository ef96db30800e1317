"""The test tables as the engine's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.index import Index, analysed, documents
from .tables import written

NOW = 1_700_000_000
WEB_ID = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    acl = F.struct(
        F.concat(F.lit("user"), (F.col("doc_id") % 7).cast("string")).alias("owner"), F.array().cast("array<string>").alias("allowed_principals"),
        F.array(F.concat(F.lit("team"), (F.col("doc_id") % 3).cast("string"))).alias("allowed_groups"), (F.col("doc_id") % 2 == 0).alias("public"),
    )
    return d.select(
        "doc_id", F.concat_ws("", "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"),
        F.lit("txt").alias("extension"), F.col("n_chars").alias("size_bytes"), (F.lit(NOW) - F.col("doc_id") * 3600).alias("modified_unix"), acl.alias("acl"), F.col("text").alias("content"),
    )


#: Every so many-th document is published on a mirror as well, so that copies stand on both sides.
MIRRORED = 10


def web_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by plain patterns (the text between tags, without scripts and styles; operators.crawl has the full extraction) with ranks and spam scores that differ, and mirrored documents."""
    p = table(spark, sf_dir, "pages")
    bare = F.regexp_replace(F.regexp_replace("html", r"(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>", " "), r"(?s)<[^>]*>", " ")
    pages = p.select(
        (F.col("page_id") + WEB_ID).alias("doc_id"), F.col("url").alias("path"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("file_name"), F.lit("html").alias("extension"),
        F.octet_length("html").cast("bigint").alias("size_bytes"), (F.lit(NOW) - F.col("page_id") * 60).alias("modified_unix"), bare.alias("content"), "url",
        F.regexp_replace(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1), r"^www\.", "").alias("domain"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
        (F.col("page_id") % 5 * 0.125).alias("spam_score"), (F.col("page_id") % 7 * 0.0001).alias("pagerank"),
    )
    d = table(spark, sf_dir, "documents").filter(F.col("doc_id") % MIRRORED == 3)
    url = F.concat(F.lit("https://mirror.example/"), F.col("doc_id").cast("string"))
    mirrored = d.select(
        (F.col("doc_id") + 2 * WEB_ID).alias("doc_id"), url.alias("path"), F.concat(F.lit("mirror "), F.col("doc_id").cast("string")).alias("file_name"), F.lit("html").alias("extension"), F.col("n_chars").alias("size_bytes"),
        F.lit(NOW).cast("bigint").alias("modified_unix"), F.col("text").alias("content"), url.alias("url"), F.lit("mirror.example").alias("domain"), "lang", F.lit(0.0).alias("spam_score"), F.lit(0.0).alias("pagerank"),
    )
    return pages.unionByName(mirrored)


def _index(docs: DataFrame, parts: tuple[str, ...]) -> Index:
    """An index whose texts are read once, as those of a saved one, for what a query needs of them."""
    return Index(written(analysed(docs, parts), "docs"))


def local_index(spark: SparkSession, sf_dir: str, parts: tuple[str, ...] = ()) -> Index:
    return _index(documents(local_docs(spark, sf_dir)), parts)


def full_index(spark: SparkSession, sf_dir: str, parts: tuple[str, ...] = ()) -> Index:
    return _index(documents(local_docs(spark, sf_dir)).unionByName(documents(web_docs(spark, sf_dir))), parts)


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, "view").select("session_id", "query", "ts")


def click_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, "click").select("session_id", "query", "ts", F.col("value").alias("dwell_seconds"), "doc_id")


def _events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == kind)
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("user_id").cast("string").alias("session_id"), F.concat(F.lit("q"), (k % 20).cast("string")).alias("query"), F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("ts"), "value", (F.col("event_id") % 500).alias("doc_id"))


_MARK = chr(0xE000)


def tokens_sql(text: str) -> str:
    """The words of a text in SQL without look-around: joiners between letters or digits get marks, then words are runs of letters and marked joiners."""
    x = f"lower({text})"
    for pattern in (r"(\p{L}\p{M}*)([.''’:·])(\p{L})", r"(\p{L}\p{M}*)([.''’:·])(\p{L})", r"(\p{N})([.,;''’])(\p{N})", r"(\p{N})([.,;''’])(\p{N})"):
        x = rf"regexp_replace({x}, '{pattern}', '\1{_MARK}\2{_MARK}\3', 'g')"
    words = rf"regexp_extract_all({x}, '(?:[\p{{L}}\p{{N}}\p{{M}}_]|{_MARK}[.,;:·''’]{_MARK})+')"
    return rf"list_filter(list_transform({words}, lambda x: replace(x, '{_MARK}', '')), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]'))"


STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
LOCAL_SQL = f"""SELECT doc_id, source || '/' || doc_id || '.txt' AS path, doc_id || '.txt' AS file_name, 'txt' AS extension, n_chars AS size_bytes, {NOW} - doc_id * 3600 AS modified_unix,
  doc_id % 7 AS owner, doc_id % 3 AS team, doc_id % 2 = 0 AS public, text AS content, NULL AS url, NULL AS domain, NULL AS lang, NULL::DOUBLE AS spam_score, NULL::DOUBLE AS pagerank FROM documents"""
WEB_SQL = f"""SELECT page_id + {WEB_ID} AS doc_id, url AS path, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS file_name, 'html' AS extension, strlen(html) AS size_bytes, {NOW} - page_id * 60 AS modified_unix,
  0 AS owner, 0 AS team, true AS public, regexp_replace(regexp_replace(html, '(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS content, url,
  regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^www\\.', '') AS domain, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, page_id % 5 * 0.125::DOUBLE AS spam_score, page_id % 7 * 0.0001::DOUBLE AS pagerank FROM pages
UNION ALL BY NAME SELECT doc_id + {2 * WEB_ID} AS doc_id, 'https://mirror.example/' || doc_id AS path, 'mirror ' || doc_id AS file_name, 'html' AS extension, n_chars AS size_bytes, {NOW} AS modified_unix,
  0 AS owner, 0 AS team, true AS public, text AS content, 'https://mirror.example/' || doc_id AS url, 'mirror.example' AS domain, lang, 0.0::DOUBLE AS spam_score, 0.0::DOUBLE AS pagerank FROM documents WHERE doc_id % {MIRRORED} = 3"""


def index_sql(web: bool = False) -> str:
    """WITH clauses docs, toks, words (doc_id, term, position), postings, lens, vocab, stats."""
    both = f"{LOCAL_SQL} UNION ALL BY NAME {WEB_SQL}" if web else LOCAL_SQL
    return f"""WITH docs AS ({both}
), toks AS MATERIALIZED (SELECT doc_id, {tokens_sql('content')} AS w FROM docs
), words AS (SELECT * FROM (SELECT doc_id, unnest(w) AS term, unnest(range(len(w)))::INT AS position FROM toks) WHERE term NOT IN ({STOP_SQL})
), postings AS MATERIALIZED (SELECT term, doc_id, count(*)::INT AS tf, list(position ORDER BY position) AS positions FROM words GROUP BY ALL
), lens AS (SELECT docs.doc_id, coalesce(n, 0)::INT AS token_count FROM docs LEFT JOIN (SELECT doc_id, count(*) AS n FROM words GROUP BY 1) USING (doc_id)
), vocab AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM postings GROUP BY 1
), stats AS (SELECT count(*) AS n_docs, sum(token_count)::BIGINT AS total_tokens, sum(token_count) / count(*) AS avg_length FROM lens
)"""


def search_sql(tfs: str, web: bool = False, exact: str = "false", where: str = "true", boost: str = "1.0", limit: int | None = 10, extra: str = "") -> str:
    """The best documents of `tfs`, a query of (doc_id, term, tf) rows over postings; null terms are documents matched by filters alone."""
    end = f"ORDER BY score DESC, doc_id LIMIT {limit}" if limit else ""
    return f"""{index_sql(web)}{extra}, tfs AS ({tfs}
), bm AS (
  SELECT tfs.doc_id, coalesce(sum(CASE WHEN tf > 0 THEN ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(token_count, 1) / greatest(avg_length, 1))) END), 0) AS bm25,
         count(term) AS match_count
  FROM tfs LEFT JOIN vocab USING (term) JOIN lens USING (doc_id), stats GROUP BY 1
)
SELECT doc_id, match_count, round(bm25 * (CASE WHEN {exact} THEN 1.5 ELSE 1 END) * (1 + 0.1 * pow(0.5, greatest({NOW} - modified_unix, 0) / 2592000.0)) * {boost}, 6) AS score
FROM bm JOIN docs USING (doc_id) WHERE {where} {end}"""
