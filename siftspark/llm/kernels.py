"""Vectorised word hashing over Arrow text buffers, shared by the operators of this subpackage.

Everything works on slices of whole documents: a text is never cut, and one that is longer than a slice gets a slice of
its own. Null and empty texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Text of a batch that is worked on at a time by operators whose results are larger than it.
PORTION_BYTES = 1 << 22
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def byte_classes(separators: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(separators)] = True
    return out


SPACE = byte_classes(b" \t\n\x0b\f\r")
#: Every ASCII byte that is neither a letter nor a digit.
NON_ALNUM = byte_classes(bytes(b for b in range(128) if not chr(b).isalnum()))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes that stay of an 8-byte chunk of which the first k belong to a span.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_PLACE, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and 64-bit offsets of a string array; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0:
        offsets = np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def portions(batch: pa.RecordBatch, column: str = "text", most: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of whole rows whose texts have about `most` bytes together."""
    for a, b in slices(buffers(batch.column(column))[1], most):
        yield batch.slice(a, b - a)


def release(run):
    """run, after which the worker's free memory goes back to the system: Spark keeps its Python workers for later tasks."""

    def then_release(batches):
        yield from run(batches)
        import ctypes

        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return then_release


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes together."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, fold: bool = False):
    """(64-bit hash, document index, first byte, end byte) of every maximal run of non-separator bytes, in order; with fold, ASCII case aside."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z.astype(np.uint64), z, z, z
    word = ~separators[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    lengths = np.diff(offsets)
    heads, tails = offsets[:-1][lengths > 0], offsets[1:][lengths > 0] - 1
    first[heads] = word[heads]
    last[tails] = word[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.repeat(np.arange(len(lengths)), np.add.reduceat(np.append(first, False).astype(np.int32), np.append(offsets[:-1], n).clip(max=n))[: len(lengths)] * (lengths > 0))
    return span_hashes(_FOLD[data] if fold else data, start, end), doc, start, end


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each data[start:end], none empty. Each chunk of 8 bytes is mixed with its place by itself, so no algebra of the bytes collides."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    chunk = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the 8 bytes from each byte on
    length, salt = end - start, mix(np.array([seed + 1], dtype=np.uint64))
    out = mix((chunk[start] & _MASKS[np.minimum(length, 8)]) + salt)
    long = np.flatnonzero(length > 8)
    if len(long):
        more = (length[long] - 1) >> 3
        ends = np.cumsum(more)
        k = np.arange(int(ends[-1])) - np.repeat(ends - more, more) + 1
        at = np.repeat(start[long], more) + 8 * k
        part = mix((chunk[at] & _MASKS[np.minimum(np.repeat(end[long], more) - at, 8)]) + salt + k.astype(np.uint64) * _PLACE)
        out[long] += np.add.reduceat(mix(part + k.astype(np.uint64)), ends - more)
    return mix(out + length.astype(np.uint64) * _LENGTH)


def ngram_hashes(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words inside a document, and the index of each run's first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    out = h[at]
    for k in range(1, n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + h[at + k])
    return out, at


def segments(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Offsets of each document's items when `doc` is sorted."""
    return np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n_docs))]).astype(np.int64)
