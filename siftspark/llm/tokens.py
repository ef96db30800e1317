"""Byte-level BPE token ids for whole Arrow batches.

The vocabulary file stays outside the repository; its path is a parameter. A batch is cut before every single space that
precedes a non-space character. The pre-tokenisation pattern never joins across such a place, so each distinct piece of the
batch is encoded once and the ids are gathered, which gives the ids of encoding every text by itself. Pieces are told apart by two
64-bit hashes; pieces that agree in the first alone are encoded each by itself.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa

from .kernels import SPACE, buffers, slices, span_hashes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VOCABULARY_SIZE = 50257
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: First bytes of the UTF-8 forms of white space beyond ASCII.
_WIDE_SPACE = np.zeros(256, dtype=bool)
_WIDE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Pieces kept between batches of a task, with their ids.
CACHE_PIECES = 1 << 19
SLICE_BYTES = 1 << 20


class Tokenizer:
    """One per task: build it inside the worker."""

    def __init__(self, path: str = VOCABULARY) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.token_bytes[list(ranks.values())] = [len(k) for k in ranks]
        self._forget()

    def _forget(self) -> None:
        self.known = self.known_check = np.zeros(0, np.uint64)
        self.known_at = self.known_size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _encode_new(self, raw: bytes, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these pieces one after another, and how many each has."""
        core = self.encoding._core_bpe
        second = data[(start + 1).clip(max=len(data) - 1)]
        joined = (data[start] == 32) & (end - start > 1) & ~SPACE[second] & ~_WIDE_SPACE[second]
        joins = np.flatnonzero(joined)
        sizes = np.zeros(len(start), np.int64)
        text = b"".join([raw[a:b] for a, b in zip(start[joins].tolist(), end[joins].tolist())]).decode("utf-8", "replace")
        ids = np.array(core.encode_ordinary(text), dtype=np.int32)
        bounds = np.cumsum(end[joins] - start[joins])
        at = np.searchsorted(np.cumsum(self.token_bytes[ids]), bounds, side="left") + 1 if len(ids) else bounds
        sizes[joins] = np.diff(at, prepend=0)
        heads = np.flatnonzero(~joined)
        rest = [core.encode_ordinary(raw[a:b].decode("utf-8", "replace")) for a, b in zip(start[heads].tolist(), end[heads].tolist())]
        sizes[heads] = [len(v) for v in rest]
        out = np.empty(int(sizes.sum()), np.int32)
        first = np.cumsum(sizes) - sizes
        out[gather(first[joins], sizes[joins])] = ids
        if len(heads):
            out[gather(first[heads], sizes[heads])] = np.concatenate([np.array(v, np.int32) for v in rest])
        return out, sizes

    def _pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, check = span_hashes(data, start, end), span_hashes(data, start, end, 1)
        distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > CACHE_PIECES:
            self._forget()
        place = np.searchsorted(self.known, distinct)
        if len(self.known):
            new = self.known[place.clip(max=len(self.known) - 1)] != distinct
        else:
            new = np.ones(len(distinct), dtype=bool)
        if new.any():
            ids, sizes = self._encode_new(data.tobytes(), data, start[at[new]], end[at[new]])
            first = len(self.ids) + np.cumsum(sizes) - sizes
            self.ids = np.concatenate([self.ids, ids])
            self.known = np.insert(self.known, place[new], distinct[new])
            self.known_check = np.insert(self.known_check, place[new], check[at[new]])
            self.known_at = np.insert(self.known_at, place[new], first)
            self.known_size = np.insert(self.known_size, place[new], sizes)
            place = np.searchsorted(self.known, distinct)
        place = place[inverse]
        first, size = self.known_at[place], self.known_size[place]
        other = np.flatnonzero(self.known_check[place] != check)
        if len(other):
            ids, size[other] = self._encode_new(data.tobytes(), data, start[other], end[other])
            first[other] = len(self.ids) + np.cumsum(size[other]) - size[other]
            self.ids = np.concatenate([self.ids, ids])
        return first, size

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids); null and empty texts have none."""
        data, offsets = buffers(column)
        parts, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a, b in slices(offsets, SLICE_BYTES):
            d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            n = len(d)
            if n == 0:
                counts.append(np.zeros(b - a, np.int64))
                continue
            heads = o[:-1][np.diff(o) > 0]
            cut = np.zeros(n, dtype=bool)
            cut[:-1] = (d[:-1] == 32) & ~SPACE[d[1:]] & ~_WIDE_SPACE[d[1:]]
            cut[heads[heads > 0] - 1] = False  # the last character of a document precedes none of its own
            cut[heads] = True
            start = np.flatnonzero(cut)
            first, size = self._pieces(d, start, np.append(start[1:], n))
            parts.append(self.ids[gather(first, size)])
            doc = np.searchsorted(o, start, side="right") - 1
            counts.append(np.bincount(doc, weights=size, minlength=b - a).astype(np.int64))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def gather(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices first[0], first[0]+1, ... of runs of the given sizes, one run after another."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)


def tokenizer(path: str = VOCABULARY) -> Tokenizer:
    """The process's tokenizer. Functions of this package are sent to workers by value, their globals too, so what outlives a task is kept in a module of its own."""
    import sys
    import types

    kept = sys.modules.setdefault("_siftspark_kept", types.ModuleType("_siftspark_kept")).__dict__.setdefault("tokenizers", {})
    if path not in kept:
        kept[path] = Tokenizer(path)
    return kept[path]
