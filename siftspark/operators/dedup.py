"""Duplicates by exact hash and by fingerprint distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import batch as B
from ..functions import text as T
from ..plans.tables import dropped, written

#: Shingles of lowest hash that a text is looked up by.
SKETCH = 16
#: Rows of a block of each side of within(), and its tasks at least on tables of some size.
LEFT_ROWS, RIGHT_ROWS, LEAST_BLOCKS = 1 << 20, 1 << 15, 32


def within(left: DataFrame, right: DataFrame, bits: int) -> DataFrame:
    """(a, b, distance) of every row a of left and b of right (doc_id, hi, lo) at most `bits` apart. Exact: every two rows are compared, a nanosecond or two each, as equal bands narrow
    enough for a dozen bits divide little and join far more slowly. Both sides are written once and counted; a task holds a block of left and streams a block of right past it."""
    value = F.call_function("shiftleft", F.col("hi"), F.lit(32)).bitwiseOR(F.col("lo")).alias("v")
    sides = [written(df.select("doc_id", value), "fingerprints") for df in (left, right)]
    m, n = (df.count() for df in sides)
    rows = 1 + m // LEFT_ROWS
    columns = max(-(-n // RIGHT_ROWS), min(LEAST_BLOCKS, -(-n // 2048)), 1)

    def placed(df: DataFrame, side: int) -> DataFrame:
        own, all_ = lambda k: F.pmod(F.xxhash64("doc_id"), F.lit(k)), lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>"))
        place = [own(rows).alias("i"), all_(columns).alias("j")] if side == 0 else [all_(rows).alias("i"), own(columns).alias("j")]
        return df.select("doc_id", "v", *place, F.lit(side).alias("side"))

    both = placed(sides[0], 0).unionByName(placed(sides[1], 1))
    kind = both.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, values = None, [], []
        for batch in batches:
            doc = batch.column(0)
            v, i, j, side = (batch.column(k).to_numpy() for k in (1, 2, 3, 4))
            v = v.view(np.uint64)
            edges = np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(v)]):
                if block != (i[a], j[a]):
                    block, ids, values = (i[a], j[a]), [], []
                if side[a] == 0:
                    ids.append(doc.slice(a, b - a))
                    values.append(v[a:b].copy())
                elif ids:
                    if len(ids) > 1:
                        ids, values = [pa.concat_arrays(ids)], [np.concatenate(values)]
                    for x, y, distance in near_values(values[0], v[a:b], bits):
                        yield pa.RecordBatch.from_arrays([ids[0].take(pa.array(x)), doc.take(pa.array(y + a)), pa.array(distance)], ["a", "b", "distance"])

    spread = both.repartition(rows * columns, "i", "j").sortWithinPartitions("i", "j", "side")
    return spread.mapInArrow(run, f"a {kind}, b {kind}, distance int").distinct()


def near_values(left: np.ndarray, right: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in left, place in right, distance) of values at most `bits` apart, some at a time."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0
    for b in range(0, len(right), 64):
        for a in range(0, len(left), 4096):
            distance = np.bitwise_count(right[b : b + 64, None] ^ left[None, a : a + 4096])
            hit = np.flatnonzero(distance.ravel() <= bits)
            if len(hit):
                y, x = np.divmod(hit, distance.shape[1])
                found.append((x + a, y + b, distance.ravel()[hit].astype(np.int32)))
                held += len(hit)
                if held >= 1 << 16:
                    yield tuple(map(np.concatenate, zip(*found)))
                    found, held = [], 0
    if found:
        yield tuple(map(np.concatenate, zip(*found)))


def near_pairs(fingerprints: DataFrame, bits: int = T.MAX_NEAR_BITS) -> DataFrame:
    """(a, b, distance) of fingerprints (doc_id, hi, lo) at most `bits` apart, a < b. Compares every two rows: exact, quadratic, for tables of some ten thousand rows; for larger ones, near_copies."""
    f = fingerprints.select("doc_id", "hi", "lo")
    a, b = f.alias("a"), f.alias("b")
    distance = T.hamming(F.col("a.hi"), F.col("a.lo"), F.col("b.hi"), F.col("b.lo"))
    return a.join(b, (F.col("a.doc_id") < F.col("b.doc_id")) & (distance <= bits)).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), distance.alias("distance"))


def sketched(docs: DataFrame, text: str = "content", key: str = "doc_id", k: int = SKETCH, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep..., hi, lo, sketch): fingerprints and the k lowest of the MD5s of a text's shingles (60 bits)."""
    return B.over_words(docs, F.col(text), [key, *keep], "hi bigint, lo bigint, sketch array<bigint>", B.sketch_arrays(k))


def near_copies(sketches: DataFrame, bits: int = T.MAX_NEAR_BITS) -> DataFrame:
    """(doc_id, duplicate_of, distance): of each row (doc_id, hi, lo, sketch) the earliest found to be at most `bits` apart, for those that have one.

    Candidates come from an equi-join on shingles: a document meets, for each shingle of its sketch, the first document that has it, and the first of that one's fingerprint. So
    there are at most `SKETCH` candidates a document, whatever the groups, and a shingle that a third of all documents have is one row a task until it is joined to its
    first document. Approximate: near copies that share no shingle of both sketches, or only ones whose first document is no near copy, aren't found (recall in the README)."""
    rows = sketches.select("doc_id", "hi", "lo", F.explode("sketch").alias("s"))
    first = rows.groupBy("s").agg(F.min(F.struct("doc_id", "hi", "lo")).alias("f"))
    distance = T.hamming(F.col("hi"), F.col("lo"), F.col("f.hi"), F.col("f.lo"))
    found = rows.join(first, "s").filter((F.col("f.doc_id") < F.col("doc_id")) & (distance <= bits))
    best = found.groupBy("doc_id").agg(F.min(F.struct(F.col("f.doc_id").alias("duplicate_of"), distance.alias("distance"))).alias("f"))
    return best.select("doc_id", "f.duplicate_of", "f.distance")


def find_duplicate(fingerprints: DataFrame, probes: DataFrame, bits: int = T.MAX_NEAR_BITS) -> DataFrame:
    """(doc_id, duplicate_of) of each probe: the first row of the same exact hash, else the first row found within `bits`; null without one.

    Both have doc_id, exact_hash, hi, lo and sketch; the second search is that of near_copies, over the rows of fingerprints."""
    same = fingerprints.select("exact_hash", "doc_id").join(probes.select("exact_hash").distinct(), "exact_hash", "left_semi")
    lowest = same.groupBy("exact_hash").agg(F.min("doc_id").alias("_first"))
    second = same.join(lowest, "exact_hash").filter("doc_id > _first").groupBy("exact_hash").agg(F.min("doc_id").alias("_second"))
    own = lowest.join(second, "exact_hash", "left")
    exact = probes.select("doc_id", "exact_hash").join(own, "exact_hash").select("doc_id", F.when(F.col("_first") != F.col("doc_id"), F.col("_first")).otherwise(F.col("_second")).alias("_exact")).filter("_exact IS NOT NULL")
    # Of the shingles that a probe has, the first document; its fingerprint is looked up once a pair.
    rest = probes.join(exact, "doc_id", "left_anti").select("doc_id", F.explode("sketch").alias("s"))
    rows = fingerprints.select("doc_id", F.explode("sketch").alias("s")).join(rest.select("s").distinct(), "s", "left_semi")
    first = rows.groupBy("s").agg(F.min("doc_id").alias("_near"))
    pairs = rest.join(first, "s").filter("_near <> doc_id").select("doc_id", "_near").distinct()
    them = fingerprints.select(F.col("doc_id").alias("_near"), F.col("hi").alias("_hi"), F.col("lo").alias("_lo"))
    found = pairs.join(them, "_near").join(probes.select("doc_id", "hi", "lo"), "doc_id")
    fuzzy = found.filter(T.hamming(F.col("hi"), F.col("lo"), F.col("_hi"), F.col("_lo")) <= bits).groupBy("doc_id").agg(F.min("_near").alias("_near"))
    return probes.select("doc_id").join(exact, "doc_id", "left").join(fuzzy, "doc_id", "left").select("doc_id", F.coalesce("_exact", "_near").alias("duplicate_of"))


def survivors(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Greedy survivors in doc_id order: a document stays unless an earlier one that stays is its near copy.

    Rounds until every document is decided: those with no undecided or kept earlier neighbour stay, neighbours of kept ones go."""
    edges = written(pairs.select("a", "b"), "edges")
    state = written(docs.select("doc_id").distinct().withColumn("s", F.lit(0)), "state")
    while True:
        kept = state.filter("s = 1").select(F.col("doc_id").alias("a"))
        gone = edges.join(kept, "a").select(F.col("b").alias("doc_id")).distinct().withColumn("_gone", F.lit(True))
        new = state.join(gone, "doc_id", "left").withColumn("s", F.when((F.col("s") == 0) & F.col("_gone"), 2).otherwise(F.col("s"))).drop("_gone")
        open_ = new.filter("s = 0").select(F.col("doc_id").alias("a"))
        waits = edges.join(open_, "a").select(F.col("b").alias("doc_id")).distinct().withColumn("_waits", F.lit(True))
        after = written(new.join(waits, "doc_id", "left").withColumn("s", F.when((F.col("s") == 0) & F.col("_waits").isNull(), 1).otherwise(F.col("s"))).drop("_waits"), "state")
        dropped(state)
        state = after
        if not state.filter("s = 0").head(1):
            # Rows kept in the last round may still have later neighbours marked as kept only if none was open; all are decided.
            return state.filter("s = 1").select("doc_id")


def dedup_rate(considered: int, kept: int) -> float:
    return max(0, considered - kept) / considered if considered else 0.0
