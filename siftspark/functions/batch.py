"""What is computed of the words of whole Arrow batches: postings, fingerprints, lexical vectors, word statistics.

Spark finds the words (text.runs_in, in the JVM); they arrive as lists of strings, whose distinct values are numbered once a portion. Everything
else works on the numbers of all texts at once, so nothing is exploded or shuffled and no expression is interpreted once a word. Texts that NFKC
may change arrive as they are and are read here, so that a task has one Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .text import BUCKETS, STOP_WORDS, is_composed, is_word, normalize_word, runs_in, words_of

_JOIN = 1
#: Words of a batch that are worked on at a time, which bounds a worker's memory; a longer text is taken by itself.
PORTION_WORDS = 1 << 16
#: Digests that are made at a time.
_DIGESTS = 1 << 13


class Words:
    """The words of a batch's texts: numbers of distinct words, the words themselves, and each text's place. A null list has no words; runs without letter or digit are none."""

    def __init__(self, lists: pa.ListArray) -> None:
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        self.dictionary: pa.StringArray = coded.dictionary
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        # What has no letter or digit begins with a low line or a mark; the first marks are U+0300.
        data, start, _ = strings_of(self.dictionary)
        doubtful = [i for i in np.flatnonzero((data[start] == ord("_")) | (data[start] >= 0xCC)).tolist() if not is_word(self.dictionary[i].as_py())] if len(start) else []
        if doubtful:
            keep = ~np.isin(self.code, doubtful)
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[keep], minlength=len(sizes))
            self.code, flat = self.code[keep], flat.filter(pa.array(keep))
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.size = sizes
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.flat = flat

    def __len__(self) -> int:
        return len(self.size)

    def stop(self) -> np.ndarray:
        """Of each distinct word, whether it is a stop word."""
        return pc.is_in(self.dictionary, pa.array(STOP_WORDS, self.dictionary.type)).to_numpy(zero_copy_only=False)

    def bytes_of_texts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all words with a sign between, first byte and end byte of each word)"""
        data, start, end = strings_of(self.flat)
        lengths = end - start
        joined = np.full(int(lengths.sum()) + len(lengths), _JOIN, dtype=np.uint8)
        if len(lengths):
            joined[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)] = data[start[0] : end[-1]]
        after = np.cumsum(lengths + 1) - 1
        return joined, after - lengths, after


def strings_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first byte and end byte of each word) of an array of strings without nulls."""
    kind = np.int64 if pa.types.is_large_string(words.type) else np.int32
    if not len(words):
        return np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, dtype=kind)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8), at[:-1], at[1:]


def portions(lists: pa.ListArray) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about PORTION_WORDS words together."""
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(ends):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + PORTION_WORDS, side="right")))
        yield a, b
        a = b


def shingle_digests(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(the first 8 bytes of the MD5 of each shingle, shingles of each text): windows of `size` words; a shorter text is one."""
    n = np.where(words.size > 0, np.maximum(words.size - size + 1, 1), 0)
    if not len(words.code):
        return np.zeros((0, 8), dtype=np.uint8), n
    raw, start, end = words.bytes_of_texts()
    ends = np.cumsum(n)
    first = np.arange(int(ends[-1])) - np.repeat(ends - n, n) + np.repeat(words.at[:-1], n)
    last = np.minimum(first + size, np.repeat(words.at[1:], n)) - 1
    return digests_of(raw, start[first], end[last]), n


_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]])
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], dtype=np.uint32)


def digests_of(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first 8 bytes of the MD5 of each range of raw, as rows: those of one or two blocks for many ranges at once."""
    out = np.empty((len(start), 8), dtype=np.uint8)
    data = np.concatenate([raw, np.zeros(128, dtype=np.uint8)])
    blocks = (end - start + 8) // 64 + 1
    for k in (1, 2):
        at = np.flatnonzero(blocks == k)
        for i in range(0, len(at), _DIGESTS):
            some = at[i : i + _DIGESTS]
            out[some] = _digests(data, start[some], end[some] - start[some], k)
    for i in np.flatnonzero(blocks > 2).tolist():
        out[i] = np.frombuffer(md5(raw[start[i] : end[i]]).digest()[:8], dtype=np.uint8)
    return out


def _digests(data: np.ndarray, start: np.ndarray, length: np.ndarray, blocks: int) -> np.ndarray:
    """digests_of() for ranges that all fill so many blocks of 64 bytes with their padding."""
    n, place = len(start), np.arange(64 * blocks, dtype=np.uint8)
    text = np.lib.stride_tricks.sliding_window_view(data, 64 * blocks)[start]
    text *= place < length.astype(np.uint8)[:, None]
    text[np.arange(n), length] = 0x80
    text[:, -8:] = (length * 8).astype("<u8").view(np.uint8).reshape(n, 8)
    word = np.ascontiguousarray(text.view("<u4").T)
    state = [np.full(n, x, dtype=np.uint32) for x in _START]
    f, g = np.empty(n, dtype=np.uint32), np.empty(n, dtype=np.uint32)
    for block in range(blocks):
        a, b, c, d = (x.copy() for x in state)
        for i in range(64):
            kind = i // 16
            if kind == 0:
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
                m = i
            elif kind == 1:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
                m = (5 * i + 1) % 16
            elif kind == 2:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
                m = (3 * i + 5) % 16
            else:
                np.invert(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
                m = 7 * i % 16
            np.add(f, a, out=f)
            np.add(f, word[16 * block + m], out=f)
            np.add(f, _SINES[i], out=f)
            turn = int(_TURNS[kind, i % 4])
            np.right_shift(f, np.uint32(32 - turn), out=g)
            np.left_shift(f, np.uint32(turn), out=f)
            np.bitwise_or(f, g, out=f)
            np.add(f, b, out=a)
            a, b, c, d = d, a, b, c
        state = [x + y for x, y in zip(state, (a, b, c, d))]
    return np.stack(state[:2], axis=1).astype("<u4").view(np.uint8).reshape(n, 8)


def _votes(digests: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hi, lo = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
    some = np.flatnonzero(n)
    if len(some):
        ones = np.add.reduceat(np.unpackbits(digests, axis=1), (np.cumsum(n) - n)[some], axis=0, dtype=np.int32)
        both = np.packbits(ones * 2 > n[some][:, None], axis=1).view(">u4").astype(np.int64)
        hi[some], lo[some] = both[:, 0], both[:, 1]
    return hi, lo


def fingerprints(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo): 32 bits each, set where more of a text's shingles have the bit in their MD5 than not; 0 for no words."""
    return _votes(*shingle_digests(words, size))


def fingerprints_and_sketches(words: Words, k: int, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hi, lo, sketches one after another, length of each): a sketch has the k lowest distinct 60-bit hashes of the shingles."""
    digests, n = shingle_digests(words, size)
    value = (np.ascontiguousarray(digests).view(">u8").ravel() >> np.uint64(4)).astype(np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    by = np.lexsort((value, doc))
    doc, value = doc[by], value[by]
    new = np.append(True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])) if len(doc) else np.zeros(0, dtype=bool)
    doc, value = doc[new], value[new]
    each = np.bincount(doc, minlength=len(n))
    place = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    return *_votes(digests, n), value[place < k], np.minimum(each, k)


def buckets_of(dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, sign) of each word, by its MD5 as text.bucket and text.sign have them."""
    digests = digests_of(*strings_of(dictionary))
    return digests[:, 3].astype(np.int64) % BUCKETS, np.where((digests[:, 4] >> 4) % 2 == 0, 1.0, -1.0)


def vectors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, weight) of the unit vectors of all words, without zeros; a vector of norm up to 1e-8 has none."""
    if not len(words.code):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    bucket, sign = buckets_of(words.dictionary)
    v = np.bincount(words.doc * BUCKETS + bucket[words.code], weights=sign[words.code], minlength=len(words) * BUCKETS).reshape(-1, BUCKETS)
    norm = np.sqrt((v * v).sum(axis=1))
    doc, at = np.nonzero((v != 0) & (norm > 1e-8)[:, None])
    return doc, at, v[doc, at] / norm[doc]


def postings(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, number of the word, tf, first of its positions, positions) of the kept words, in order of text and word number."""
    place = np.arange(len(words.code)) - np.repeat(words.at[:-1], words.size)
    keep = ~words.stop()[words.code] if len(words.code) else np.zeros(0, dtype=bool)
    doc, code, place = words.doc[keep], words.code[keep], place[keep]
    order = np.argsort(doc * max(1, len(words.dictionary)) + code, kind="stable")
    doc, code, place = doc[order], code[order], place[order]
    head = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1]))) if len(doc) else np.zeros(0, dtype=np.int64)
    return doc[head], code[head], np.diff(np.append(head, len(doc))), head, place


def stuffing_and_runs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(occurrences of each text's most frequent word, distinct runs of three words)"""
    most, runs = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
    if not len(words.code):
        return most, runs
    k = len(words.dictionary)
    pair, count = np.unique(words.doc * k + words.code, return_counts=True)
    np.maximum.at(most, pair // k, count)
    if len(words.code) > 2:
        two = np.unique(words.code[:-1] * k + words.code[1:], return_inverse=True)[1]
        three = np.unique(two[:-1] * k + words.code[2:], return_inverse=True)[1]
        doc = words.doc[:-2]
        inside = doc == words.doc[2:]
        both = np.unique(doc[inside] * (int(three.max()) + 1) + three[inside])
        runs += np.bincount(both // (int(three.max()) + 1), minlength=len(words))
    return most, runs


def over_words(docs: DataFrame, text, keep: list[str], extra: str, compute: Callable[[Words], list[pa.Array]]) -> DataFrame:
    """The columns `keep` of docs and those of `extra` (as DDL) that compute gives for the words of `text`, a column."""
    name = "_words"
    while name in docs.columns:
        name += "_"
    plain = is_composed(text)
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.when(plain, runs_in(F.lower(text))).alias(name), F.when(~plain, text).alias(f"{name}t"))
    schema = StructType.fromJson(chosen.drop(name, f"{name}t").schema.jsonValue())  # a copy that can be sent to workers
    for field in StructType.fromDDL(extra).fields:
        schema = schema.add(field)

    names = list(schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = _with_read(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1))
            for a, b in portions(lists):
                part = batch.slice(a, b - a)
                columns = [part.column(i) for i in range(batch.num_columns - 2)]
                yield pa.RecordBatch.from_arrays(columns + compute(Words(lists.slice(a, b - a))), names)
            batch = lists = part = columns = None  # before the next one is read
            pa.default_memory_pool().release_unused()

    return chosen.mapInArrow(run, schema)


def _with_read(lists: pa.ListArray, texts: pa.Array) -> pa.ListArray:
    """lists, and where texts aren't null their words."""
    if texts.null_count == len(texts):
        return lists
    at = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
    read = pa.array([[w for w, _, _ in words_of(normalize_word(texts[int(i)].as_py()))] for i in at], lists.type)
    take = np.arange(len(lists))
    take[at] = len(lists) + np.arange(len(at))
    return pa.concat_arrays([lists, read]).take(pa.array(take))


def nested(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    """Lists of the given sizes, one after another."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


# What goes to workers refers to functions of this module alone, as a whole module can't be sent.


def fingerprint_arrays(size: int) -> Callable[[Words], list[pa.Array]]:
    """hi bigint, lo bigint"""
    return lambda words: [pa.array(x) for x in fingerprints(words, size)]


def vector_arrays(words: Words) -> list[pa.Array]:
    """buckets array<int>, weights array<double>"""
    doc, bucket, weight = vectors(words)
    each = np.bincount(doc, minlength=len(words))
    return [nested(pa.array(bucket.astype(np.int32)), each), nested(pa.array(weight), each)]


def sketch_arrays(k: int) -> Callable[[Words], list[pa.Array]]:
    """hi bigint, lo bigint, sketch array<bigint>"""

    def compute(words: Words) -> list[pa.Array]:
        hi, lo, sketch, each = fingerprints_and_sketches(words, k)
        return [pa.array(hi), pa.array(lo), nested(pa.array(sketch), each)]

    return compute


def count_arrays(words: Words) -> list[pa.Array]:
    """words int, most int, runs int"""
    return [pa.array(x.astype(np.int32)) for x in (words.size, *stuffing_and_runs(words))]


#: What a pass over texts gives, by parts; words are always among them.
ANALYSIS = {"prints": "hi bigint, lo bigint", "words": "token_count int, terms array<string>, tfs array<int>, positions array<array<int>>", "vectors": "buckets array<int>, weights array<double>"}


def _word_arrays(words: Words) -> list[pa.Array]:
    doc, code, tf, head, place = postings(words)
    kept, each = np.bincount(doc, weights=tf, minlength=len(words)).astype(np.int32), np.bincount(doc, minlength=len(words))
    terms = words.dictionary.take(pa.array(code)).cast(pa.string())
    spots = pa.ListArray.from_arrays(pa.array(np.append(head, len(place)).astype(np.int32)), pa.array(place.astype(np.int32)))
    return [pa.array(kept), nested(terms, each), nested(pa.array(tf.astype(np.int32)), each), nested(spots, each)]


def _analysis(parts: list[str]) -> Callable[[Words], list[pa.Array]]:
    """The columns of ANALYSIS for these parts."""
    prints = fingerprint_arrays(5)

    def compute(words: Words) -> list[pa.Array]:
        return [x for part in parts for x in (prints(words) if part == "prints" else _word_arrays(words) if part == "words" else vector_arrays(words))]

    return compute


def analysed(docs: DataFrame, text: str = "content", keep: list[str] | None = None, parts: tuple[str, ...] = ("prints", "vectors")) -> DataFrame:
    """Every document with its count of kept words and postings, and its fingerprint and vector where they are among the parts: one pass over the texts."""
    chosen = [p for p in ANALYSIS if p == "words" or p in parts]
    return over_words(docs, F.col(text), docs.columns if keep is None else keep, ", ".join(ANALYSIS[p] for p in chosen), _analysis(chosen))
