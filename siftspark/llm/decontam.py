"""Benchmark passages in training documents: n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, ASCII case aside. Every trigram of a test item is a seed, and of items of fewer than `SHORT` words every
bigram, as edits may leave those no whole trigram. Equally rare seeds weigh alike: all are used. Documents that share a seed with an item are aligned with it (match +2, mismatch and gap -1) on every stretch that an alignment through a seed can reach, and the score is
divided by that of the whole item. A copy without a whole n-gram isn't found. The test items are taken in chunks of `CHUNK_WORDS` words, so what is sent to the executors is bounded;
a larger benchmark takes more passes over the documents.

A stretch longer than 16 items is aligned in windows that overlap by 3 items, more than any local alignment spans, so its score is that of the whole.

Defined results: an item of fewer than `min_words` words is too short for edits to be told from chance, so it matches only where all its words stand in a row,
and one of one or two words only a document of just these words; null, empty or wordless texts and items match nothing; a very long text is searched whole;
repeated rows and item_ids give one row a pair with the best score; an empty table of either kind gives no rows; a row without doc_id or item_id is skipped in pairs() and kept by drop_contaminated(); only
doc_id and text, item_id and text are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import NON_ALNUM, buffers, ngram_hashes, release, segments, slices, word_hashes
from .shared import unused, written
from .tokens import gather

N = 3
SHORT, SHORT_N = 16, 2
MIN_WORDS = 8
THRESHOLD = 0.5
CHUNK_WORDS = 4_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Cells of a batch of alignment rows.
ROW_CELLS = 1 << 16
#: Words of a batch's passages, with their padding.
TEXT_CELLS = 1 << 20
#: Passages aligned at a time.
PASSAGES = 1 << 13
_FILTER_BITS = 22
#: Contaminated documents that are broadcast; beyond, Spark joins them by shuffle.
BROADCAST_ROWS = 500_000


class Items:
    """A chunk of the benchmark as word hashes, and the places of its seeds in order of their grams."""

    def __init__(self, rows: list[tuple[int, str]], min_words: int = MIN_WORDS, threshold: float = THRESHOLD) -> None:
        data, offsets = buffers(pa.array([r[1] for r in rows], pa.string()))
        self.words, doc, _, _ = word_hashes(data, offsets, NON_ALNUM, fold=True)
        self.offsets = segments(doc, len(rows))
        self.ids = np.array([r[0] for r in rows], dtype=np.int64)
        length = np.diff(self.offsets)
        short = length < SHORT
        self.least = np.where(length < min_words, 1.0, threshold)
        self.sizes: list[int] = []
        grams, item, at = [], [], []
        for n, some in ((N, ~short), (SHORT_N, short & (length >= SHORT_N)), (1, length == 1)):
            g, place = ngram_hashes(self.words, doc, n)
            keep = some[doc[place]]
            if keep.any():
                self.sizes.append(n)
                grams.append(g[keep])
                item.append(doc[place][keep])
                at.append((place - self.offsets[doc[place]])[keep])
        every = np.concatenate([np.zeros(0, dtype=np.uint64), *grams])
        self.grams, gram = np.unique(every, return_inverse=True)
        order = np.argsort(gram, kind="stable")
        self.item = np.concatenate([np.zeros(0, dtype=np.int64), *item])[order].astype(np.int32)
        self.at = np.concatenate([np.zeros(0, dtype=np.int64), *at])[order].astype(np.int32)
        self.owners = segments(gram[order], len(self.grams))


def gram_filter(grams: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
    bits[(grams & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
    return bits


def lookup(h: np.ndarray, grams: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in h, index of the gram there) of the known grams."""
    at = np.flatnonzero(bits[(h & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
    if not len(grams):
        return at[:0], at[:0]
    k = np.searchsorted(grams, h[at]).clip(max=len(grams) - 1)
    hit = grams[k] == h[at]
    return at[hit], k[hit]


def align(texts: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman scores of texts[i] against items[i]."""
    parts, mine, owner = [], [], []
    for k, (t, i) in enumerate(zip(texts, items)):
        # An alignment of positive score has fewer than two words of other kinds a match, so it spans less than three items.
        step = 13 * len(i)
        for a in range(0, max(1, len(t) - 3 * len(i)), step) if len(t) > 16 * len(i) > 0 else (0,):
            parts.append(t[a : a + step + 3 * len(i)] if len(t) > 16 * len(i) > 0 else t)
            mine.append(i)
            owner.append(k)
    out = np.zeros(len(texts), dtype=np.int64)
    if parts:
        np.maximum.at(out, np.array(owner), _align(parts, mine))
    return out


def _align(texts: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(texts), dtype=np.int64)
    order = np.lexsort(([-len(t) for t in texts], [len(i) for i in items]))
    a = 0
    while a < len(order):
        width, longest = len(items[order[a]]), len(texts[order[a]])
        b = a + 1
        while b < len(order) and (b - a + 1) * len(items[order[b]]) <= ROW_CELLS and len(items[order[b]]) <= width * 5 // 4 + 8 and (b - a + 1) * max(longest, len(texts[order[b]])) <= TEXT_CELLS:
            longest = max(longest, len(texts[order[b]]))
            b += 1
        some = order[a:b][np.argsort([-len(texts[k]) for k in order[a:b]], kind="stable")]
        width = max(len(items[k]) for k in some)
        item = np.zeros((len(some), width), dtype=np.uint64)
        there = np.zeros((len(some), width), dtype=bool)
        for r, k in enumerate(some):
            item[r, : len(items[k])] = items[k]
            there[r, : len(items[k])] = True
        steps = np.array([len(texts[k]) for k in some])
        text = np.zeros((len(some), steps[0] if len(steps) else 0), dtype=np.uint64)
        for r, k in enumerate(some):
            text[r, : len(texts[k])] = texts[k]
        h = np.zeros((len(some), width + 1), dtype=np.int32)
        best = np.zeros(len(some), dtype=np.int32)
        slope = -GAP * np.arange(width + 1, dtype=np.int32)
        for t in range(text.shape[1]):
            n = int(np.searchsorted(-steps, -t, side="left"))
            old = h[:n]
            new = np.maximum(old + GAP, 0)
            hit = (item[:n] == text[:n, t : t + 1]) & there[:n]
            np.maximum(new[:, 1:], old[:, :-1] + np.where(hit, MATCH, MISMATCH), out=new[:, 1:])
            new = np.maximum.accumulate(new + slope, axis=1) - slope
            h[:n] = new
            np.maximum(best[:n], new.max(axis=1), out=best[:n])
        out[some] = best
        a = b
    return out


def _matches(docs: DataFrame, items: Items) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = shared.value
        bits, length = gram_filter(it.grams), np.diff(it.offsets)
        reach = np.ceil((1 - it.least) * MATCH * length / -GAP).astype(np.int64)

        def scored(ids: np.ndarray, found: list[tuple[int, int]], texts: list[np.ndarray]) -> pa.RecordBatch:
            passages = [it.words[it.offsets[y] : it.offsets[y + 1]] for _, y in found]
            scores = align(texts, passages)
            item = np.array([y for _, y in found], dtype=np.int64)
            ratio = scores / (MATCH * length[item])
            good = np.flatnonzero(ratio >= it.least[item])
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[found[k][0]] for k in good], pa.int64()), pa.array(it.ids[item[good]]), pa.array(scores[good].astype(np.int32)), pa.array(ratio[good], pa.float64())],
                ["doc_id", "item_id", "score", "ratio"],
            )

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            data, offsets = buffers(batch.column("text"))
            found: list[tuple[int, int]] = []
            texts: list[np.ndarray] = []
            for a, b in slices(offsets):
                h, doc, _, _ = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], NON_ALNUM, fold=True)
                places, known = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
                for n in it.sizes:
                    g, at = ngram_hashes(h, doc, n)
                    where, k = lookup(g, it.grams, bits)
                    places.append(at[where])
                    known.append(k)
                k = np.concatenate(known)
                if not len(k):
                    continue
                each = np.diff(it.owners)[k]
                hits = gather(it.owners[:-1][k], each)
                word, item = np.repeat(np.concatenate(places), each), it.item[hits]
                d, bounds = doc[word], segments(doc, b - a)
                whole = np.diff(bounds)[d]
                some = (length[item] >= N) | (length[item] == whole)  # an item of one or two words is a whole document or nothing
                word, item, d, hits = word[some], item[some], d[some], hits[some]
                if not len(d):
                    continue
                left = np.maximum(word - it.at[hits] - reach[item], bounds[d])
                right = np.minimum(word - it.at[hits] + length[item] + reach[item], bounds[d + 1])
                order = np.lexsort((left, item, d))
                d, item, left, right = d[order], item[order], left[order], right[order]
                last = None
                for x, y, p, q in zip(d.tolist(), item.tolist(), left.tolist(), right.tolist()):
                    if last and last[:2] == [x, y] and p <= last[3]:
                        last[3] = max(last[3], q)
                    else:
                        if last:
                            texts.append(h[last[2] : last[3]])
                        last = [x, y, p, q]
                        found.append((a + x, y))
                texts.append(h[last[2] : last[3]])
                if len(found) >= PASSAGES:
                    yield scored(ids, found, texts)
                    found, texts = [], []
            if found:
                yield scored(ids, found, texts)

    return docs.mapInArrow(release(run), "doc_id long, item_id long, score int, ratio double")


def _chunks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    rows, words = [], 0
    for r in benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text").toLocalIterator():
        rows.append((r[0], r[1]))
        words += r[1].count(" ") + 1
        if words >= most:
            yield rows
            rows, words = [], 0
    if rows:
        yield rows


def pairs(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, chunk_words: int = CHUNK_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, score, ratio) of every document that holds a copy or edited copy of an item. 0 < threshold <= 1."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score int, ratio double")
    for rows in _chunks(benchmark, chunk_words):
        out = out.unionByName(_matches(docs, Items(rows, min_words, threshold)))
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.round(F.max("ratio"), 6).alias("ratio"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that hold no copy of an item."""
    name = unused("gone", docs.columns)
    gone = written(pairs(docs, benchmark, threshold).select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op4_benchmark_decontamination": op4_benchmark_decontamination}
SQL: dict[str, str] = {}
