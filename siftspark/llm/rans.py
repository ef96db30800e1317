"""Token ids as static range asymmetric numeral system (rANS) blocks.

One frequency table for the whole corpus is counted over every token and shared by all blocks. A document's ids are cut into
blocks of `BLOCK_TOKENS`; each block is coded by itself with `LANES` interleaved 64-bit states (token i belongs to lane
i mod LANES), so blocks can be decoded in any order and lanes side by side. Every `CHECKPOINT_STEPS` steps the lane states and
the place in the word stream are kept, which lets a decoder start inside a block; a CRC-32 of the ids guards each block.

Defined results: a null or empty text gives one block of no tokens; a very long text gives as many blocks as it takes; repeated rows give repeated
blocks; a null doc_id stays null; equally frequent tokens have equal shares, the lowest id any rest; columns other than doc_id and text aren't looked at; an empty table gives only the row of the frequency table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import portions, release, slices
from .shared import written
from .tokens import VOCABULARY, VOCABULARY_SIZE, gather, tokenizer

SCALE_BITS = 20
LANES = 8
BLOCK_TOKENS = 4096
CHECKPOINT_STEPS = 128
LOW = np.uint64(1 << 31)
_W = np.uint64(32)
#: Tokens coded together; bounds the memory of a step.
GROUP_TOKENS = 1 << 20

BLOCKS = (
    "kind string, doc_id long, block int, n_tokens int, states binary, payload binary, checkpoints binary, crc32 long"
)
_BLOCKS = pa.schema(
    [("kind", pa.string()), ("doc_id", pa.int64()), ("block", pa.int32()), ("n_tokens", pa.int32()), ("states", pa.binary()), ("payload", pa.binary()), ("checkpoints", pa.binary()), ("crc32", pa.int64())]
)


def normalised(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that add up to 2**bits; a symbol that occurs keeps at least 1, one that doesn't has 0. Needs fewer symbols than 2**bits."""
    counts = counts.astype(np.float64)
    if not counts.sum():
        return np.zeros(len(counts), dtype=np.uint64)
    total = 1 << bits
    f = np.floor(counts / counts.sum() * total).astype(np.int64)
    f[(counts > 0) & (f == 0)] = 1
    while over := int(f.sum()) - total:
        order = np.argsort(-f, kind="stable")
        if over < 0:
            f[order[0]] -= over
        else:
            take = np.minimum(f[order] - 1, np.maximum(f[order] * over // total, 1)).clip(min=0)
            take = np.where(np.cumsum(take) <= over, take, np.maximum(over - (np.cumsum(take) - take), 0))
            f[order] -= take
    return f.astype(np.uint64)


def encode_blocks(ids: np.ndarray, first: np.ndarray, size: np.ndarray, freq: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """(final states, 32-bit words, checkpoints) of each block ids[first : first + size]."""
    n = len(first)
    start = (np.cumsum(freq) - freq).astype(np.uint64)
    limit = freq << np.uint64(31 - SCALE_BITS + 32)
    order = np.argsort(-size, kind="stable")
    f, s = first[order], size[order]
    steps = -(-s // LANES)
    x = np.full((n, LANES), LOW, dtype=np.uint64)
    emitted = np.zeros(n, dtype=np.int64)
    lane = np.arange(LANES)
    words, owners = [], []
    marks: list[tuple[int, np.ndarray, np.ndarray]] = []
    active_at = np.searchsorted(-steps, -np.arange(int(steps[0]) if n else 0), side="left")  # blocks with more than t steps
    for t in range(len(active_at) - 1, -1, -1):
        k = active_at[t]
        at = f[:k, None] + (t * LANES + lane)
        live = (t * LANES + lane) < s[:k, None]
        sym = ids[np.where(live, at, 0)]
        fr, state = freq[sym], x[:k]
        spill = live & (state >= limit[sym])
        b, _ = np.nonzero(spill)
        if len(b):
            words.append(state[spill].astype(np.uint32))
            owners.append(b)
            emitted[:k] += spill.sum(axis=1)
            state = np.where(spill, state >> _W, state)
        fr = np.where(live, fr, np.uint64(1))
        q = state // fr
        x[:k] = np.where(live, (q << np.uint64(SCALE_BITS)) + (state - q * fr) + start[sym], state)
        if t and t % CHECKPOINT_STEPS == 0:
            marks.append((t, x[:k].copy(), emitted[:k].copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    owner = np.concatenate(owners[::-1]) if owners else np.zeros(0, np.int64)
    stream = stream[np.argsort(owner, kind="stable")]
    ends = np.cumsum(emitted)
    checkpoints: list[list[bytes]] = [[] for _ in range(n)]
    for t, states, done in reversed(marks):
        for b in range(len(states)):
            checkpoints[b].append(np.array([t * LANES, emitted[b] - done[b]], "<i4").tobytes() + states[b].astype("<u8").tobytes())
    out: list = [None] * n
    for b in range(n):
        out[order[b]] = (x[b].astype("<u8").tobytes(), stream[ends[b] - emitted[b] : ends[b]].astype("<u4").tobytes(), b"".join(checkpoints[b]))
    return out


def symbols(freq: np.ndarray) -> np.ndarray:
    """The symbol of each of the 2**SCALE_BITS slots."""
    return np.repeat(np.arange(len(freq)), freq.astype(np.int64))


def decode_blocks(states: list[bytes], payloads: list[bytes], n_tokens: np.ndarray, freq: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all blocks, offsets of each block's, whether its words sufficed), all blocks and lanes side by side."""
    n, size = len(states), np.asarray(n_tokens, dtype=np.int64)
    start, mask = (np.cumsum(freq) - freq).astype(np.uint64), np.uint64((1 << SCALE_BITS) - 1)
    offsets = np.concatenate([[0], np.cumsum(size)])
    out, fits = np.zeros(int(offsets[-1]), dtype=np.int64), np.array([len(s) == 8 * LANES and not len(p) % 4 for s, p in zip(states, payloads)], dtype=bool)
    x = np.frombuffer(b"".join(s if ok else bytes(8 * LANES) for s, ok in zip(states, fits)), "<u8").astype(np.uint64).reshape(n, LANES)
    words = np.frombuffer(b"".join(p[: len(p) // 4 * 4] for p in payloads) + bytes(4), "<u4").astype(np.uint64)
    end = np.cumsum([len(p) // 4 for p in payloads])
    order = np.argsort(-size, kind="stable")
    x, first, left = x[order], offsets[:-1][order], size[order]
    at, end = np.concatenate([[0], end[:-1]])[order] if n else end, end[order] if n else end
    good, lane = fits[order], np.arange(LANES)
    for t in range(int(-(-left[0] // LANES)) if n else 0):
        k = int(np.searchsorted(-left, -t * LANES, side="left"))  # blocks with tokens left
        token = t * LANES + lane
        live = token < left[:k, None]
        slot = x[:k] & mask
        sym = symbol[slot.astype(np.int64)] if len(symbol) else np.zeros(slot.shape, dtype=np.int64)
        out[(first[:k, None] + token)[live]] = sym[live]
        state = freq[sym] * (x[:k] >> np.uint64(SCALE_BITS)) + slot - start[sym]
        low = live & (state < LOW)
        place = at[:k, None] + np.cumsum(low, axis=1) - 1
        good[:k] &= at[:k] + low.sum(axis=1) <= end[:k]
        state = np.where(low, (state << _W) | words[np.minimum(place, len(words) - 1).clip(min=0)], state)
        at[:k] += low.sum(axis=1)
        x[:k] = np.where(live, state, x[:k])
    fits[order] = good
    return out, offsets, fits


def decode_block(states: bytes, payload: bytes, n_tokens: int, freq: np.ndarray, first: int = 0) -> np.ndarray:
    """The ids from token `first` on, which is 0 or where a checkpoint lies, given the states and words from there on."""
    ids, _, fits = decode_blocks([states], [payload], np.array([n_tokens - first]), freq, symbols(freq))
    if not fits.all():
        raise ValueError("the words end before the tokens")
    return ids


def checkpoints_of(record: bytes) -> list[tuple[int, int, bytes]]:
    """(token, word, states) of each checkpoint of a block."""
    each = 8 + 8 * LANES
    return [(*np.frombuffer(record[i : i + 8], "<i4").tolist(), record[i + 8 : i + each]) for i in range(0, len(record), each)]


def _texts_to_ids(path: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in (part for b in batches for part in portions(b)):
            ids, offsets = t.encode(batch.column("text"))
            raw = np.ascontiguousarray(ids.astype(kind))
            column = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer((offsets * raw.itemsize).astype(np.int64)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column.cast(pa.binary())], ["doc_id", "ids"])

    return release(run)


def _ids(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def token_table(docs: DataFrame, vocabulary: str = VOCABULARY, vocabulary_size: int = VOCABULARY_SIZE) -> tuple[DataFrame, str]:
    """(doc_id, ids) written once for the passes that follow, and the numpy type of the ids."""
    kind = "<u2" if vocabulary_size <= 1 << 16 else "<i4"
    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_texts_to_ids(vocabulary, kind), "doc_id long, ids binary"), "ids"), kind


def token_counts(tokens: DataFrame, kind: str, vocabulary_size: int) -> np.ndarray:
    """How often each id occurs in the corpus: one array a task, added up by id; the driver gets one row for each id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary_size, dtype=np.int64)
        for batch in batches:
            ids, _ = _ids(batch.column(0), kind)
            total += np.bincount(ids, minlength=vocabulary_size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(release(count), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(vocabulary_size, dtype=np.int64)
    out[[r.id for r in rows]] = [r.n for r in rows]
    return out


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, vocabulary_size: int = VOCABULARY_SIZE) -> DataFrame:
    """A row of kind `block` for each block of each document, and one of kind `table` whose payload has the frequencies as 32-bit numbers."""
    spark = docs.sparkSession
    tokens, kind = token_table(docs, vocabulary, vocabulary_size)
    freq = normalised(token_counts(tokens, kind, vocabulary_size))
    table = spark.createDataFrame([("table", None, None, None, None, bytearray(freq.astype("<u4").tobytes()), None, zlib.crc32(freq.astype("<u4").tobytes()))], BLOCKS)
    shared = spark.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        for batch in batches:
            ids, offsets = _ids(batch.column("ids"), kind)
            doc_ids = batch.column("doc_id").to_pylist()
            n = np.diff(offsets)
            blocks = np.maximum(-(-n // BLOCK_TOKENS), 1)
            doc = np.repeat(np.arange(len(n)), blocks)
            number = gather(np.zeros(len(n), np.int64), blocks)
            first = offsets[:-1][doc] + number * BLOCK_TOKENS
            size = np.minimum(n[doc] - number * BLOCK_TOKENS, BLOCK_TOKENS)
            group = np.cumsum(size) // GROUP_TOKENS
            for g in np.unique(group):
                w = np.flatnonzero(group == g)
                coded = encode_blocks(ids, first[w], size[w], freq)
                crc = [zlib.crc32(ids[a : a + k].astype("<u4").tobytes()) for a, k in zip(first[w].tolist(), size[w].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["block"] * len(w)), pa.array([doc_ids[d] for d in doc[w].tolist()], pa.int64()), pa.array(number[w].astype(np.int32)), pa.array(size[w].astype(np.int32)), *(pa.array([c[i] for c in coded], pa.binary()) for i in range(3)), pa.array(crc, pa.int64())],
                    schema=_BLOCKS,
                )

    return tokens.mapInArrow(release(run), BLOCKS).unionByName(table)


def decode(blocks: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """(doc_id, block, ids) of the rows of encode(); a damaged block fails the task."""
    spark = spark or blocks.sparkSession
    shared = spark.sparkContext.broadcast(np.frombuffer(bytes(blocks.filter("kind = 'table'").first().payload), "<u4").astype(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        symbol = symbols(freq)
        for batch in batches:
            each = batch.column("n_tokens").to_numpy()
            for a, b in slices(np.concatenate([[0], np.cumsum(each)]), GROUP_TOKENS):
                part = batch.slice(a, b - a)
                states, payloads, crc = (part.column(c).to_pylist() for c in ("states", "payload", "crc32"))
                ids, offsets, fits = decode_blocks(states, payloads, each[a:b], freq, symbol)
                raw = ids.astype("<u4")
                for k, (i, j) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    if not fits[k] or zlib.crc32(raw[i:j].tobytes()) != crc[k]:
                        raise ValueError(f"checksum of block {part.column('block')[k]} of document {part.column('doc_id')[k]}")
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("block"), lists], ["doc_id", "block", "ids"])

    return blocks.filter("kind = 'block'").mapInArrow(release(run), "doc_id long, block int, ids array<int>")


def texts_of(decoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of the rows of decode(); a doc_id must not repeat. Gathers no more than a document's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(vocabulary).encoding
        for batch in batches:
            pieces = [encoding.decode_bytes(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("block"), pa.array(pieces, pa.binary())], ["doc_id", "block", "bytes"])

    pieces = decoded.mapInArrow(run, "doc_id long, block int, bytes binary").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("block", "bytes"))).alias("b"))
    return pieces.select("doc_id", F.decode(F.aggregate("b.bytes", F.unhex(F.lit("")), lambda x, y: F.concat(x, y)), "UTF-8").alias("text"))


def op1_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def rans_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and those whose text isn't what their blocks decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    back = texts_of(decode(written(encode(docs), "blocks"))).withColumnRenamed("text", "again")
    same = F.coalesce("text", F.lit("")).eqNullSafe(F.col("again"))
    return docs.join(back, "doc_id", "full").agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(~same, 1)).alias("mismatches"))


QUERIES = {"op1_rans_tokens": op1_rans_tokens, "rans_round_trip": rans_round_trip}
SQL = {"rans_round_trip": "SELECT count(*) AS documents, 0::BIGINT AS mismatches FROM documents"}
