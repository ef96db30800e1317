"""Quality rules: an ordered list of threshold conjunctions learned from labelled statistics.

The statistics of a text are Spark expressions. Sequential covering runs on the driver over the labelled rows' statistics: a rule grows by the
condition of highest FOIL gain on two thirds of the rows until it covers no good row, is pruned from its end on the other third by (p - n) / (p + n),
and joins the list when its precision there is at least `min_precision` and it covers enough bad rows there: a tenth of them, but no fewer than 2 and no more than `min_cover`; rows that it covers are then taken away. Both
parts have the classes in like shares.
The list is emitted as one CASE WHEN over the statistics: the first rule that holds rejects a document, none keeps it.

At most `max_labelled` labelled rows are learned from, those of the lowest hash of doc_id in each class; a class rarer than a tenth fills a tenth of them
as far as it goes, and precision is then weighted back to all labels. Scoring covers all rows.

Defined results: a null or empty text has all statistics 0 and is judged by them; labels that are null or of unknown documents are passed over; labels of
one class, or none, and fewer than 6 bad ones, give an empty list, which keeps everything (with a warning if there are bad ones); repeated rows are judged each by itself; the input's columns other than text don't matter.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LABELLED = 20_000
MIN_PRECISION = 0.95
MIN_COVER = 10
MAX_RULES = 24
MAX_CONDITIONS = 4
QUANTILES = 48


def statistics(text: str = "text") -> dict[str, Column]:
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    n, chars = F.greatest(F.size(words), F.lit(1)).cast("double"), F.greatest(F.length(t), F.lit(1)).cast("double")

    def share(of: Column, total: Column) -> Column:
        return of.cast("double") / total

    return {
        "n_words": F.size(words).cast("double"),
        "mean_word": share(F.length(t), n),
        # Distinct words by Herdan's measure, which long texts don't lower by their length.
        "variety": F.when(F.size(words) < 2, 1.0).otherwise(F.log(F.size(F.array_distinct(words)).cast("double")) / F.log(n)),
        "short_words": share(F.size(F.filter(words, lambda w: F.length(w) <= 3)), n),
        "bare_marks": share(F.size(F.filter(words, lambda w: ~w.rlike(r"[\p{L}\p{N}]"))), n),
        "marks": share(F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s]+", "")), chars),
        "capitals": share(F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")), chars),
        "digits": share(F.length(F.regexp_replace(t, r"[^0-9]+", "")), chars),
        "mean_line": share(F.length(t), F.size(F.split(t, "\n"))),
    }


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and the statistics as columns q_*."""
    return docs.select(*keep, *[c.alias(f"q_{k}") for k, c in statistics().items()])


@dataclass(frozen=True)
class Condition:
    name: str
    at_least: bool
    bound: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] >= self.bound if self.at_least else x[self.name] < self.bound

    def column(self) -> Column:
        c = F.col(f"q_{self.name}")
        return c >= F.lit(self.bound) if self.at_least else c < F.lit(self.bound)

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.at_least else '<'} {self.bound:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def grow(x: dict[str, np.ndarray], bad: np.ndarray, max_conditions: int = MAX_CONDITIONS) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < max_conditions:
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        if not n or not p:
            break
        best, gain = None, 1e-9
        base = np.log2(p / (p + n))
        for name in sorted(x):
            v = x[name][inside]
            b = bad[inside]
            for bound in np.unique(np.quantile(v, np.linspace(0, 1, QUANTILES + 1))):
                high = v >= bound
                for at_least, hit in ((True, high), (False, ~high)):
                    pp = int(b[hit].sum())
                    if pp:
                        g = pp * (np.log2(pp / int(hit.sum())) - base)
                        if g > gain:
                            best, gain = Condition(name, at_least, float(bound)), g
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray, weight: float = 1.0) -> Rule:
    def worth(r: Rule) -> float:
        c = covers(r, x)
        p, n = int(bad[c].sum()), weight * int((~bad[c]).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())


def learn(x: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = MIN_PRECISION, min_cover: int = MIN_COVER, weight: float = 1.0) -> list[Rule]:
    """Rules for the rows that are bad. Every third row of each class prunes; a good row stands for `weight` ones."""
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    third = np.zeros(len(bad), dtype=bool)
    for c in (bad, ~bad):
        third[np.flatnonzero(c)[2::3]] = True
    least = min(min_cover, max(2, -(-int((bad & third).sum()) // 10)))
    while len(rules) < MAX_RULES and bad[left].any() and not bad[left].all():
        g, q = left & ~third, left & third
        rule = grow({k: v[g] for k, v in x.items()}, bad[g])
        rule = prune(rule, {k: v[q] for k, v in x.items()}, bad[q], weight) if rule else ()
        if not rule:
            break
        c = covers(rule, x)
        p, n = int(bad[c & q].sum()), int((~bad[c & q]).sum())
        if p < least or p / (p + weight * n) < min_precision:
            break
        rules.append(rule)
        left &= ~c
    return rules


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, min_precision: float = MIN_PRECISION, min_cover: int = MIN_COVER) -> list[Rule]:
    """Rules from labels (doc_id, quality); quality 0 is bad."""
    some = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("_quality"))
    of = {r[0]: r[1] for r in some.groupBy(F.col("_quality") == 0).count().collect()}
    n_bad, n_good = of.get(True, 0), of.get(False, 0)
    share = round(max_labelled * n_bad / max(1, n_bad + n_good))
    bad = min(n_bad, max(max_labelled // 10, min(share, max_labelled - min(n_good, max_labelled // 10))))
    good = min(n_good, max_labelled - bad)
    first = lambda c, n: some.filter(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    some = F.broadcast(first("_quality = 0", bad).unionByName(first("_quality <> 0", good)))  # bounded by max_labelled
    weight = (n_good / good) / (n_bad / bad) if good and bad else 1.0
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(some, "doc_id")
    rows = with_statistics(docs, ["doc_id", "_quality"]).orderBy(F.xxhash64("doc_id"), "doc_id", "q_n_words", "q_mean_word").toPandas()
    x = {k: rows[f"q_{k}"].to_numpy(np.float64) for k in statistics()}
    rules = learn(x, rows["_quality"].to_numpy() == 0, min_precision, min_cover, weight)
    if bad and not rules:
        warnings.warn(f"no rule holds on {bad} bad and {good} good labelled rows: every document is kept", stacklevel=2)
    return rules


def rule_number(rules: list[Rule]) -> Column:
    """The 1-based number of the first rule that holds, else null: one ordered conditional expression over q_* columns."""
    out = None
    for i, rule in enumerate(rules, 1):
        hit = rule[0].column()
        for c in rule[1:]:
            hit &= c.column()
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return F.lit(None).cast("int") if out is None else out.cast("int")


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, rule, keep) of every row."""
    return with_statistics(docs, ["doc_id"]).select("doc_id", rule_number(rules).alias("rule")).withColumn("keep", F.col("rule").isNull())


def drop_rejected(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows that no rule rejects, unchanged."""
    if not rules:
        return docs
    used = {c.name for r in rules for c in r}
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(f"q_{k}") for k, c in statistics().items() if k in used]).filter(rule_number(rules).isNull()).select("_row.*")


def op2_decision_list_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op2_decision_list_quality": op2_decision_list_quality}
SQL: dict[str, str] = {}
