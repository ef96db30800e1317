"""Entities of texts, their mentions and co-occurrence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMAIL, NAME, CODE = "email", "proper_noun", "code"


def _trim(word: str, keep: str = "") -> str:
    a, b = 0, len(word)
    while a < b and not (word[a].isalnum() or word[a] in keep):
        a += 1
    while b > a and not (word[b - 1].isalnum() or word[b - 1] in keep):
        b -= 1
    return word[a:b]


def _is_code(word: str) -> bool:
    if "::" in word:
        return True
    if "_" in word and all(c == "_" or c.isalnum() for c in word):
        return True
    return word.isalnum() and any(map(str.islower, word)) and any(map(str.isupper, word[1:]))


def extract(text: str) -> list[tuple[str, str]]:
    """(name, kind) in order of kind and place: e-mail addresses, runs of capitalised words, code identifiers."""
    words = text.split()
    out = []
    if "@" in text:
        for w in words:
            if "@" in w:
                w = _trim(w, "@.")
                if w.count("@") == 1 and "." in w and w[0] != "@":
                    out.append((w.lower(), EMAIL))
    if not text.islower():
        i, opens, n = 0, True, len(words)
        while i < n:
            after = i + 1
            w = words[i]
            if not w.islower():
                w = _trim(w)
                if w[:1].isupper() and any(map(str.islower, w[1:])):
                    run = [w]
                    while after < n and (more := _trim(words[after]))[:1].isupper():
                        run.append(more)
                        after += 1
                    name = " ".join(run)
                    if (len(run) > 1 or not opens) and len(name.encode()) >= 3:
                        out.append((name, NAME))
            i = after
            opens = words[i - 1][-1] in ".!?"
    for w in words:
        if "_" in w or "::" in w or not w.islower():
            w = _trim(w, "_:.").rstrip(".")
            if 4 <= len(w.encode()) <= 60 and _is_code(w):
                out.append((w, CODE))
    return out


def mentions(docs: DataFrame, text: str = "content", ts: str = "modified_unix") -> DataFrame:
    """(doc_id, name, kind, ts): once for each name and kind of a row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [dict.fromkeys(extract(t)) if t else () for t in batch.column("text").to_pylist()]
            row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]).astype(np.int64))
            flat = [x for f in found for x in f]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), pa.array([n for n, _ in flat], pa.string()), pa.array([k for _, k in flat], pa.string()), batch.column("ts").take(row)], ["doc_id", "name", "kind", "ts"])

    chosen = docs.select("doc_id", F.col(text).alias("text"), F.col(ts).alias("ts"))
    kinds = dict(chosen.dtypes)
    return chosen.mapInArrow(run, f"doc_id {kinds['doc_id']}, name string, kind string, ts {kinds['ts']}")


def cooccurrence(mentions: DataFrame) -> DataFrame:
    """(a, b, n): mentions that share a document, a <= b. A name found as two kinds pairs with itself."""
    side = mentions.select("doc_id", "name", "kind")
    a, b = side.alias("a"), side.alias("b")
    before = (F.col("a.name") < F.col("b.name")) | ((F.col("a.name") == F.col("b.name")) & (F.col("a.kind") < F.col("b.kind")))
    pairs = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & before)
    return pairs.groupBy(F.col("a.name").alias("a"), F.col("b.name").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def related_to(pairs: DataFrame, name: str, limit: int = 10) -> DataFrame:
    rows = pairs.filter((F.col("a") == name) | (F.col("b") == name))
    return rows.select(F.when(F.col("a") == name, F.col("b")).otherwise(F.col("a")).alias("name"), "n").orderBy(F.desc("n"), "name").limit(limit)


def sources_mentioning(mentions: DataFrame, name: str, start: int, end: int) -> DataFrame:
    """Most recent first; both ends count."""
    return mentions.filter((F.col("name") == name) & F.col("ts").between(start, end)).select("doc_id", "ts").distinct().orderBy(F.desc("ts"), "doc_id")


def top_entities(mentions: DataFrame, limit: int = 20, least: int = 2) -> DataFrame:
    return mentions.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_seen")).filter(F.col("n") >= least).orderBy(F.desc("n"), "name").limit(limit)


def entity(mentions: DataFrame, name: str) -> DataFrame:
    return mentions.filter(F.col("name") == name).groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def without_source(mentions: DataFrame, doc_ids: DataFrame) -> DataFrame:
    return mentions.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")
