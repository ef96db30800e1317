"""Search: a parsed query becomes one plan.

Leaves that look up terms share one scan of the postings. Each document's hits are gathered once; the boolean structure, term frequencies and phrases are
then expressions over that row, so the shape of a query adds no join. A term frequency counts once for each leaf that found the term and took part
in the match. Documents without hits are only looked at where the query can accept them (filters and NOT).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Ranking
from ..functions import scoring as S
from ..functions import text as T
from ..plans import query as Q
from .index import Index, term_part, term_part_of


@dataclass
class Compiled:
    """Leaves of a query over postings and the expressions that combine them."""

    leaves: list[Q.Node] = field(default_factory=list)
    phrase_terms: list[str] = field(default_factory=list)
    entities: list[str] = field(default_factory=list)

    def leaf(self, node: Q.Node) -> int:
        self.leaves.append(node)
        if isinstance(node, Q.Phrase):
            self.phrase_terms += [t for t in node.terms if t not in self.phrase_terms]
        return len(self.leaves) - 1

    def _positions(self, node: Q.Phrase) -> Column:
        """Places where the phrase begins."""
        at = [F.coalesce(F.col(f"_p{self.phrase_terms.index(t)}"), F.array().cast("array<int>")) for t in node.terms]
        return reduce(F.array_intersect, [_shifted(p, i) for i, p in enumerate(at)])

    def compile(self, node: Q.Node, now: int) -> tuple[Column, list[tuple[int, Column]], bool]:
        """(whether a document matches, [(leaf, whether it takes part)], whether a document without hits can match)."""
        if isinstance(node, Q.And):
            parts = [self.compile(p, now) for p in node.parts]
            match = reduce(and_, [m for m, _, _ in parts])
            return match, [(i, a & match) for p, (_, active, _) in zip(node.parts, parts) if not isinstance(p, Q.Not) for i, a in active], all(e for _, _, e in parts)
        if isinstance(node, Q.Or):
            parts = [self.compile(p, now) for p in node.parts]
            return reduce(or_, [m for m, _, _ in parts]), [x for _, active, _ in parts for x in active], any(e for _, _, e in parts)
        if isinstance(node, Q.Not):
            match, _, _ = self.compile(node.part, now)
            return ~match, [], True
        if isinstance(node, Q.Filter):
            return F.coalesce(self.filter(node, now), F.lit(False)), [], True
        if isinstance(node, Q.Phrase) and not node.terms:
            return F.lit(False), [], False
        i = self.leaf(node)
        hit = F.coalesce(F.col(f"_l{i}"), F.lit(False))
        if isinstance(node, Q.Phrase) and len(node.terms) > 1:
            hit = F.size(self._positions(node)) > 0
        return hit, [(i, hit)], False

    def filter(self, node: Q.Filter, now: int) -> Column:
        v = node.value
        compare = (lambda x, y: x > y) if node.op == ">" else (lambda x, y: x < y)
        if node.kind == "ext":
            return F.col("extension") == v
        if node.kind == "path":
            return F.lower("path").contains(v)
        if node.kind == "name":
            return F.lower("file_name").contains(v)
        if node.kind == "site":
            return F.col("url").isNotNull() & ((F.col("domain") == v) | F.col("domain").endswith(f".{v}"))
        if node.kind == "lang":
            return F.col("url").isNotNull() & (F.col("lang") == v)
        if node.kind == "author":
            return F.col("url").isNotNull() & F.lower("author").contains(v)
        if node.kind == "date":
            return compare(F.col("modified_unix"), F.lit(v))
        if node.kind == "size":
            return compare(F.col("size_bytes"), F.lit(v))
        if node.kind == "modified":
            return compare(F.lit(now) - F.col("modified_unix"), F.lit(v))
        if not str(v).strip():
            return F.lit(False)
        self.entities.append(str(v))
        return F.col(f"_e{len(self.entities) - 1}")

    def leaf_terms(self, node: Q.Node) -> Column:
        """Whether a leaf looks up the row's term."""
        term = F.col("term")
        if isinstance(node, Q.Term):
            return term == node.term
        if isinstance(node, Q.Phrase):
            return term.isin(*node.terms)
        if isinstance(node, Q.Prefix):
            return term.startswith(node.stem)
        if isinstance(node, Q.Wildcard):
            return term.rlike(T.wildcard_pattern(node.pattern))
        return F.levenshtein(term, F.lit(node.term), node.distance) >= 0

    def exact_terms(self) -> list[str] | None:
        """The terms looked up, where no leaf is a pattern."""
        out: list[str] = []
        for leaf in self.leaves:
            if isinstance(leaf, Q.Term):
                out.append(leaf.term)
            elif isinstance(leaf, Q.Phrase):
                out += leaf.terms
            else:
                return None
        return list(dict.fromkeys(out))


def evaluate(index: Index, node: Q.Node, now: int) -> DataFrame:
    """The columns of index.narrow, terms array<struct<term,tf,df>> and exact_phrase of every document that matches."""
    c = Compiled()
    match, active, empty = c.compile(node, now)
    docs = index.narrow
    if c.leaves:
        # Patterns are tried on the vocabulary, a row a term; the terms that they find are then looked up.
        leaf = F.array(*[c.leaf_terms(x) for x in c.leaves])
        terms = index.vocab.filter(reduce(or_, [c.leaf_terms(x) for x in c.leaves])).select("term", "df", leaf.alias("leaves"))
        rows, keys = index.postings, ["term"]
        exact = c.exact_terms()
        if index.parts and exact is not None:
            rows = rows.filter(F.col("part").isin(*{term_part_of(t, index.parts) for t in exact}) & F.col("term").isin(*exact))
        elif index.parts:
            keys, terms = ["part", "term"], terms.withColumn("part", term_part(F.col("term"), index.parts))
        elif exact is not None:
            rows = rows.filter(F.col("term").isin(*exact))
        rows = rows.join(terms, keys)
        found = F.struct("term", "tf", "df", "leaves")
        hits = rows.groupBy("doc_id").agg(
            F.collect_list(found).alias("_hits"),
            *[F.max(F.col("leaves")[i]).alias(f"_l{i}") for i in range(len(c.leaves))],
            *[F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"_p{k}") for k, t in enumerate(c.phrase_terms)],
        )
        docs = docs.join(hits, "doc_id", "left" if empty else "inner")
    for k, name in enumerate(c.entities):
        named = index.mentions.filter(F.instr(F.lower("name"), name) > 0).select("doc_id").distinct().withColumn(f"_e{k}", F.lit(True))
        docs = docs.join(named, "doc_id", "left")
    docs = docs.filter(match)
    if not c.leaves:
        return docs.withColumn("terms", F.array().cast("array<struct<term:string,tf:int,df:bigint>>")).withColumn("exact_phrase", F.lit(False))
    takes = {i: reduce(or_, [F.coalesce(a, F.lit(False)) for j, a in active if j == i]) for i in {j for j, _ in active}}
    flags = F.array(*[takes.get(i, F.lit(False)) for i in range(len(c.leaves))])
    docs = docs.withColumn("_active", flags)
    counted = F.transform("_hits", lambda h: F.struct(h["term"].alias("term"), (h["tf"] * F.size(F.filter(F.zip_with(h["leaves"], F.col("_active"), lambda a, b: a & b), lambda x: x))).cast("int").alias("tf"), h["df"].alias("df")))
    phrases = [F.col("_active")[i] for i, x in enumerate(c.leaves) if isinstance(x, Q.Phrase) and len(x.terms) > 1]
    docs = docs.withColumn("terms", F.coalesce(F.filter(counted, lambda t: t["tf"] > 0), F.array().cast("array<struct<term:string,tf:int,df:bigint>>")))
    docs = docs.withColumn("exact_phrase", reduce(or_, phrases) if phrases else F.lit(False))
    return docs.drop("_active", "_hits", *[f"_l{i}" for i in range(len(c.leaves))], *[f"_p{k}" for k in range(len(c.phrase_terms))], *[f"_e{k}" for k in range(len(c.entities))])


def _shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda x: x - by)


BOOSTS = ("filename", "exact", "recency", "pagerank", "url", "domain", "spam", "click")


def in_mode(mode: str) -> Column:
    web, onion = F.col("url").isNotNull(), F.lower(F.coalesce("url", F.lit(""))).contains(".onion")
    return {"local": ~web, "web": web & ~onion, "tor": web & onion, "both": ~onion}[mode]


def scored(index: Index, found: DataFrame, ranking: Ranking, now: int, clicks: DataFrame | None = None) -> DataFrame:
    """found with bm25, a column b_<name> for each boost, and score. Pages flagged as unsafe beyond the threshold go."""
    r = ranking
    web = F.col("url").isNotNull()
    found = found.crossJoin(F.broadcast(index.stats.select("n_docs", "avg_length")))  # one row
    if clicks is not None:
        counts = clicks.groupBy("doc_id").agg(F.sum("n").alias("_clicks")) if "n" in clicks.columns else clicks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_clicks"))
        found = found.join(counts, "doc_id", "left")
    found = found.filter(F.coalesce(F.col("policy_flag.confidence"), F.lit(-1.0)) < r.safety_block_threshold)
    n = F.greatest("n_docs", F.lit(1)).cast("double")
    parts = F.transform(F.array_sort("terms"), lambda t: S.bm25(t["tf"], t["df"], n, F.col("token_count"), F.col("avg_length"), r.bm25_k1, r.bm25_b))
    some = F.size("terms") > 0
    name, path = F.lower("file_name"), F.lower("path")
    domain = F.when(F.col("domain").isin(*r.spam_domains), r.spam_domain_penalty) if r.spam_domains else F.when(F.lit(False), 1.0)
    if r.trusted_domains:
        domain = domain.when(F.col("domain").isin(*r.trusted_domains), r.trusted_domain_boost)
    boosts = {
        "filename": F.when(some & F.forall("terms", lambda t: F.instr(name, t["term"]) > 0), r.filename_boost).otherwise(1.0),
        "exact": F.when(F.col("exact_phrase"), r.exact_match_boost).otherwise(1.0),
        "recency": S.recency(F.col("modified_unix"), F.lit(now), r.recency_boost),
        "pagerank": F.when(web, 1 + r.pagerank_weight * F.greatest(F.coalesce("pagerank", F.lit(0.0)) * n, F.lit(0.0))).otherwise(1.0),
        "url": F.when(some & F.exists("terms", lambda t: F.instr(path, t["term"]) > 0), r.url_match_boost).otherwise(1.0),
        "domain": F.when(web, F.coalesce(domain, F.lit(1.0))).otherwise(1.0),
        "spam": F.when(web, F.greatest(1 - r.spam_score_weight * F.coalesce("spam_score", F.lit(0.0)), F.lit(0.05))).otherwise(1.0),
        "click": F.lit(1.0) if clicks is None else 1 + r.click_weight * F.log(1 + F.coalesce("_clicks", F.lit(0))),
    }
    out = found.withColumn("bm25", F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)).withColumns({f"b_{k}": v.cast("double") for k, v in boosts.items()})
    return out.withColumn("score", reduce(lambda a, b: a * b, [F.col(f"b_{k}") for k in BOOSTS], F.col("bm25"))).drop("n_docs", "avg_length", "_clicks")


def query_vector(index: Index, terms: list[str]) -> DataFrame | None:
    """(bucket, w): the unit vector of a query's terms by their rarity."""
    if not terms:
        return None
    spark = index.docs.sparkSession
    rows = spark.createDataFrame([(t,) for t in terms], "term string").join(index.vocab, "term", "left").crossJoin(F.broadcast(index.stats.select("n_docs")))
    weighted = rows.select(F.lit(0).alias("q"), "term", S.query_weight(F.coalesce("df", F.lit(0)), F.greatest("n_docs", F.lit(1))).alias("weight"))
    return T.embed(weighted, "q", weight=F.col("weight")).drop("q")


def vector_similarity(vectors: DataFrame, query: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cosine): the query has at most 256 rows."""
    return vectors.join(F.broadcast(query.withColumnRenamed("w", "_q")), "bucket").groupBy(*keys).agg(F.sum(F.col("w") * F.col("_q")).alias("cosine"))


def with_vector_boost(index: Index, found: DataFrame, terms: list[str], weight: float) -> DataFrame:
    """score times 1 + weight * the best of the whole document's and its chunks' similarity; best_chunk where a chunk is at least as near."""
    query = query_vector(index, terms)
    if weight <= 0 or query is None:
        return found.withColumns({"b_vector": F.lit(1.0), "best_chunk": F.lit(None).cast("int")})
    ids = found.select("doc_id")
    whole = vector_similarity(index.vectors.join(ids, "doc_id", "left_semi"), query, ["doc_id"]).withColumnRenamed("cosine", "_whole")
    chunk = vector_similarity(index.chunk_vectors.join(ids, "doc_id", "left_semi"), query, ["doc_id", "chunk_index"])
    chunk = chunk.groupBy("doc_id").agg(F.max(F.struct("cosine", "chunk_index")).alias("_c")).select("doc_id", F.col("_c.cosine").alias("_part"), F.col("_c.chunk_index").alias("_at"))
    joined = found.join(whole, "doc_id", "left").join(chunk, "doc_id", "left")
    near, part = F.greatest(F.coalesce("_whole", F.lit(0.0)), F.lit(0.0)), F.greatest("_part", F.lit(0.0))
    joined = joined.withColumn("b_vector", 1 + weight * F.greatest(near, F.coalesce(part, F.lit(0.0)))).withColumn("best_chunk", F.when(part >= near, F.col("_at")))
    return joined.withColumn("score", F.col("score") * F.col("b_vector")).drop("_whole", "_part", "_at")


def results(index: Index, node: Q.Node | str, ranking: Ranking = Ranking(), now: int = 0, mode: str = "web", principal: str | None = None, groups: list[str] | None = None, clicks: DataFrame | None = None) -> DataFrame:
    """Every result, unsorted and without its text (with_content). With a principal or groups, rows that the caller may not see go."""
    node = Q.parse(node) if isinstance(node, str) else node
    found = evaluate(index, node, now).filter(in_mode(mode))
    if principal is not None or groups is not None:
        found = found.filter(S.visible(F.col("acl"), principal, groups or []))
    out = scored(index, found, ranking, now, clicks)
    if mode == "both":
        out = out.withColumn("score", F.when(F.col("url").isNull(), F.col("score") * ranking.local_boost).otherwise(F.col("score")))
    out = with_vector_boost(index, out, Q.terms_of(node), ranking.vector_weight)
    out = out.withColumn("is_web", F.col("url").isNotNull()).withColumn("source_kind", S.source_kind(F.col("is_web"), F.col("extension"))).withColumn("match_count", F.size("terms"))
    if mode == "both":
        from .merge import drop_cross_source, normalized

        out = normalized(drop_cross_source(index, out, ranking), ranking)
    else:
        out = out.withColumn("normalized_score", F.col("score"))
    return out


def page(found: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """The best results, ties by doc_id."""
    ordered = found.orderBy(F.desc("score"), "doc_id")
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def counts(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(~F.col("is_web"), 1)).alias("local_count"), F.count(F.when(F.col("is_web"), 1)).alias("web_count"))


def with_content(index: Index, best: DataFrame) -> DataFrame:
    """A page of results, in its order, with the texts: read for the page alone."""
    texts = index.docs.select("doc_id", "content").join(F.broadcast(best.select("doc_id")), "doc_id", "left_semi")
    return best.join(texts, "doc_id", "left").orderBy(F.desc("score"), "doc_id")


def search(index: Index, query: Q.Node | str, ranking: Ranking = Ranking(), now: int = 0, mode: str = "web", limit: int = 10, offset: int = 0, **who) -> DataFrame:
    return with_content(index, page(results(index, query, ranking, now, mode, **who), limit, offset))


_LABELS = {
    "filename": "name match", "exact": "exact phrase", "recency": "recent", "pagerank": "linked by others", "url": "address match",
    "domain": "domain", "click": "clicked before", "spam": "spam signals", "vector": "similar content",
}


def reasons(found: DataFrame) -> DataFrame:
    """found with `reasons`, the boosts that aren't neutral and their effect in per cent, and `summary`."""
    up, down = ("recency", "pagerank", "click", "vector"), ("spam",)
    items = []
    for k, label in _LABELS.items():
        b = F.col(f"b_{k}")
        shown = F.abs(b - 1) > 0.001
        shown = shown & (b > 1) if k in up else shown & (b < 1) if k in down else shown
        name = F.when(b > 1, "trusted domain").otherwise("doubtful domain") if k == "domain" else F.lit(label)
        items.append(F.when(shown, F.struct(name.alias("label"), ((b - 1) * 100).alias("percent"))))
    listed = F.filter(F.array(*items), lambda x: x.isNotNull())
    text = F.array_join(F.transform("reasons", lambda x: F.concat(x["label"], F.lit(" ("), F.format_string("%+.0f%%", x["percent"]), F.lit(")"))), ", ")
    return found.withColumn("reasons", listed).withColumn("summary", F.when(F.size("reasons") == 0, "Matched the terms").otherwise(text))
