"""Training sequences by power-of-two decomposition.

A document of n tokens is cut, from its start, into n div MAX pieces of the longest length and one piece for each binary digit
of the rest, longest first. A sequence is one piece, so none crosses documents and no token is lost, repeated or padded. Pieces of
one length share a bucket (the power of two), from which batches of equal shape are drawn; nothing is shuffled to get there.

Defined results: a null or empty text gives no piece; repeated rows give repeated pieces; columns other than doc_id and text aren't
looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import portions, release
from .tokens import VOCABULARY, gather, tokenizer

MAX_LENGTH = 8192
PACKED = "doc_id long, piece int, start int, length int, bucket int, tokens array<int>"
_PACKED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int32()), ("length", pa.int32()), ("bucket", pa.int32()), ("tokens", pa.list_(pa.int32()))])
#: Tokens given to Spark at once.
ROWS_TOKENS = 1 << 20


def pieces(n: np.ndarray, max_length: int = MAX_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(pieces of each document, length of every piece in order) for token counts n; max_length is a power of two."""
    top = max_length.bit_length() - 1
    digits = (n[:, None] % max_length >> np.arange(top - 1, -1, -1)) & 1
    counts = np.concatenate([(n // max_length)[:, None], digits], axis=1)
    return counts.sum(axis=1), np.repeat(np.tile(1 << np.arange(top, -1, -1), len(n)), counts.ravel())


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, max_length: int = MAX_LENGTH) -> DataFrame:
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary)
        for batch in (part for b in batches for part in portions(b)):
            ids, offsets = t.encode(batch.column("text"))
            each, length = pieces(np.diff(offsets), max_length)
            doc_ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(each)), each)))
            ends = np.cumsum(length)
            start = ends - length - np.repeat(offsets[:-1], each)
            columns = [doc_ids, gather(np.zeros(len(each), np.int64), each).astype(np.int32), start.astype(np.int32), length.astype(np.int32), np.log2(length).astype(np.int32)]
            a = 0
            while a < len(length):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] - length[a] + ROWS_TOKENS, side="right")))
                at = np.append(ends[a:b] - length[a:b], ends[b - 1])
                lists = pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(ids[at[0] : at[-1]]))
                yield pa.RecordBatch.from_arrays([columns[0].slice(a, b - a), *(pa.array(c[a:b]) for c in columns[1:]), lists], schema=_PACKED)
                a = b

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(release(run), PACKED)


def write_buckets(packed: DataFrame, path: str) -> None:
    """A folder for each length, so that a reader draws batches of one shape."""
    packed.write.partitionBy("bucket").parquet(path)


def op3_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_power_of_two_packing": op3_power_of_two_packing}
SQL: dict[str, str] = {}
