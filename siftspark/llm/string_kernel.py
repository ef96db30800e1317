"""Language of a text by a string kernel.

The kernel of two texts is the blended-spectrum presence kernel: the number of distinct byte n-grams (n from 1 to 3, letters in lower case,
digits and ASCII marks as one class each, runs of blanks as one, none at the start) that both have, divided by the root of the product of both numbers. Landmarks
are labelled texts; the Nystrom map phi(x) = k(x, landmarks) K^-1/2 feeds a kernel ridge regression for each language against the rest (targets
1 and -1 with a bias), and the highest score wins.

Scores of a batch are k(x, landmarks) W with W = K^-1/2 beta. As k is a product of presence matrices, k(x, landmarks) W = X (L' D W) / norm: the bracket
is computed once and a batch is one product of its presence rows with it. n-grams of no landmark add nothing to k and only count in the norm.

At most `per_language` labelled texts of each language are learned from, those of the lowest hash of doc_id, `landmarks` of them as landmarks, taken in turn
from the languages; scoring covers every row and whole texts.

Defined results: a null or blank text, or a model without labelled rows, gives a null language and score; one labelled language is always the answer; ties go to
the first language in order; repeated rows are scored each by itself; only doc_id, text and, for labels, lang are looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernels import buffers

N = 3
PER_LANGUAGE = 400
LANDMARKS = 192
RIDGE = 1e-2
#: Texts whose presence rows are multiplied with the weights at once.
BATCH = 128
OUT = "doc_id long, language string, score double, margin double"
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] += 32
_CLASS[list(b" \t\n\x0b\f\r")] = 32
_CLASS[48:58] = 48
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 33
SPECTRUM = (1 << 8) + (1 << 16) + (1 << 24)


class Spectrum:
    """Distinct n-grams of a text as numbers. `seen` has a place for each possible n-gram; one per worker."""

    def __init__(self) -> None:
        self.seen = np.zeros(SPECTRUM, dtype=np.int32)

    def of(self, raw: np.ndarray) -> np.ndarray:
        b = _CLASS[raw]
        blank = b == 32
        if len(b):
            b = b[~(blank & np.append(True, blank[:-1]))]
        b = b.astype(np.int32)
        codes = [b]
        if len(b) > 1:
            codes.append((b[:-1] << 8 | b[1:]) + 256)
        if len(b) > 2:
            codes.append((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) + (256 + 65536))
        out = []
        for c in codes[:N]:
            place = np.arange(len(c), dtype=np.int32)
            self.seen[c] = place
            out.append(c[self.seen[c] == place])
        return np.concatenate(out)


@dataclass
class Model:
    """Weights (n-grams x languages) of the landmarks' n-grams, found through `row`; `bias` and the languages in order."""

    languages: list[str]
    grams: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def rows(self) -> np.ndarray:
        """Row of each possible n-gram in weights; the last row, of zeros, for n-grams of no landmark."""
        out = np.full(SPECTRUM, len(self.grams), dtype=np.int32)
        out[self.grams] = np.arange(len(self.grams), dtype=np.int32)
        return out


def presence(sets: list[np.ndarray], grams: np.ndarray) -> np.ndarray:
    """0/1 rows of the sets over these sorted n-grams, divided by the root of each set's size."""
    out = np.zeros((len(sets), len(grams)), dtype=np.float32)
    for i, s in enumerate(sets):
        k = np.searchsorted(grams, s).clip(max=max(0, len(grams) - 1))
        out[i, k[grams[k] == s]] = 1 / np.sqrt(max(1, len(s)))
    return out


def kernel(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    grams = np.unique(np.concatenate(y)) if y else np.zeros(0, np.int32)
    right = presence(y, grams).T
    return np.concatenate([presence(x[a : a + 256], grams) @ right for a in range(0, len(x), 256)]).astype(np.float64)


def fit(sets: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    rows = [i for i, s in enumerate(sets) if len(s)]
    sets, labels = [sets[i] for i in rows], [labels[i] for i in rows]
    languages = sorted(set(labels))
    if not sets:
        return None
    turn = {g: [i for i, x in enumerate(labels) if x == g] for g in languages}
    chosen = sorted(range(len(sets)), key=lambda i: (turn[labels[i]].index(i), labels[i]))[:landmarks]
    marks = [sets[i] for i in chosen]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = kernel(sets, marks) @ root
    target = np.where(np.array(labels)[:, None] == np.array(languages), 1.0, -1.0)
    # Languages weigh alike, however many rows each has.
    weight = 1 / np.array([len(turn[x]) for x in labels], dtype=np.float64)
    weight /= weight.sum()
    mean, centre = weight @ phi, weight @ target
    a = (phi - mean) * weight[:, None]
    beta = np.linalg.solve(a.T @ (phi - mean) + ridge / len(sets) * np.eye(phi.shape[1]), a.T @ (target - centre))
    grams = np.unique(np.concatenate(marks))
    weights = presence(marks, grams).T.astype(np.float64) @ (root @ beta)
    return Model(languages, grams, np.concatenate([weights, np.zeros((1, len(languages)))]).astype(np.float32), centre - mean @ beta)


def _spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spectrum = Spectrum()
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        sets = [spectrum.of(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "lang", "grams"])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """The classifier of the languages in `lang`, where it isn't null."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.select("doc_id", "lang").withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= per_language).select("doc_id", "lang").distinct()
    found = rows.join(F.broadcast(ids), ["doc_id", "lang"]).mapInArrow(_spectra, "doc_id long, lang string, grams binary").toArrow()  # bounded by per_language
    order = sorted(zip(found.column("doc_id").to_pylist(), found.column("lang").to_pylist(), found.column("grams").to_pylist()))
    return fit([np.frombuffer(g, np.int32) for _, _, g in order], [x for _, x, _ in order], landmarks, ridge)


def scores(texts: pa.Array, model: Model, rows: np.ndarray, spectrum: Spectrum) -> tuple[np.ndarray, np.ndarray]:
    """(scores of each language, number of n-grams) of a batch of texts."""
    data, offsets = buffers(texts)
    width = len(model.weights)
    out, norm = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    x = np.zeros((min(BATCH, len(texts)), width), dtype=np.float32)
    for a in range(0, len(texts), BATCH):
        sets = [rows[spectrum.of(data[i:j])] for i, j in zip(offsets[a : a + BATCH].tolist(), offsets[a + 1 : a + BATCH + 1].tolist())]
        size = np.array([len(s) for s in sets])
        where = np.repeat(np.arange(len(sets)) * width, size) + np.concatenate(sets)
        flat = x.ravel()
        flat[where] = 1  # presence rows; n-grams of no landmark share the last column, whose weights are 0
        out[a : a + len(sets)] = x[: len(sets)] @ model.weights
        flat[where] = 0
        norm[a : a + len(sets)] = size
    return out / np.sqrt(np.maximum(norm, 1))[:, None] + model.bias, norm


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, language, score, margin) of every row; the margin is over the second language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, spectrum = shared.value, Spectrum()
        rows = m.rows() if m else None
        names = pa.array(m.languages, pa.string()) if m else None
        for batch in batches:
            ids, n = batch.column("doc_id"), batch.num_rows
            if m is None:
                columns = [pa.nulls(n, pa.string()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64())]
            else:
                value, norm = scores(batch.column("text"), m, rows, spectrum)
                none = norm == 0
                order = np.sort(value, axis=1)
                best = value.argmax(axis=1)
                margin = order[:, -1] - (order[:, -2] if value.shape[1] > 1 else 0)
                columns = [names.take(pa.array(best, mask=none)), pa.array(np.round(order[:, -1], 6), mask=none), pa.array(np.round(margin, 6), mask=none)]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "language", "score", "margin"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)


def op7_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))


QUERIES = {"op7_string_kernel_language": op7_string_kernel_language}
SQL: dict[str, str] = {}
