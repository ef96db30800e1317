"""Exact n-gram Jaccard join in the metric space of Jaccard distance.

A document is its set of word n-grams, d(x, y) = 1 - |x & y| / |x | y|, and two documents are linked when d <= eps = 1 - threshold. Copies (texts of
the same n-grams as often) are one class, joined once, by the class's lowest doc_id; a link of two classes links all their members.

Unrelated texts share next to no n-grams, so they are all at distance 1 from any document, and document pivots alone would divide
nothing. The first pivots are therefore the n-grams themselves: {g} is nearer than 1 to the documents that contain g and to no others,
and the members of its cell whose first |x| - ceil(threshold |x|) + 1 n-grams (rarest first, in one order for all) include g are
enough for every pair to meet in a cell. Each cell names its lowest class its pivot; a class then belongs to the region of each
pivot that it met. Inside a region, document pivots divide recursively: Voronoi cells, copies of a document in every cell j with
d(x, p_j) <= min_i d(x, p_i) + 2 eps and d(x, p_j) <= radius_j + eps (both by the triangle inequality), until cells are small.
A pair that meets in several regions counts in that of the lowest pivot that both met.

The order is by the corpus counts of an n-gram's words, and of the n-gram itself where it is frequent, in hash buckets over all documents. Any
order gives the same result; this one makes chance meetings rare. Sets are of 56-bit hashes, classes of 128-bit ones.

Chance meetings and shared passages, of which a growing corpus has ever more, are told from pairs before any text travels: two texts within the threshold meet in many cells,
the more so the nearer their sizes, so each stays in a region only if members of some colour (size class and hash) could be one partner with enough of its cells.

Cells travel as blocks: the cells of a task's texts for one bucket, sorted, as differences in as few bytes as they need. No task gathers an unbounded
group: a text's copies are met once a task, n-grams of more than `HOT` documents name their region themselves and never gather in one bucket, and a region of more than `TILE_BYTES` of text
is cut into blocks of members, each two of which are a task. Joins by pivot, by class and of links by document carry numbers only; of these, a key that holds a large share of the rows
is split by Spark's adaptive skew join, and large classes are broadcast.

Defined results: words are runs of characters other than ASCII white space; a text of fewer than n words but at least one is one n-gram; a
null or wordless text links to nothing; equal texts link at 1; a doc_id that repeats counts once in a class and isn't linked to itself, and one with several
texts is in the classes of all of them, which it thereby connects, and has the links of all; a null doc_id is skipped; an empty table gives no rows; a very long text is one
member like any other, with the set of all its n-grams; only doc_id and text are looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import buffers, mix, ngram_hashes, release, segments, slices, word_hashes
from .shared import dropped, unused, written

N = 3
THRESHOLD = 0.5
WORD_BUCKETS = 1 << 18
GRAM_BUCKETS = 1 << 19
HEAVY = 3
#: Share of a set's n-grams that two sets within the threshold share at least among their prefixes; longer prefixes for fewer chance regions.
SHARED = 0.1
#: Classes of regions, or (class, pivot) pairs, that are broadcast; beyond, Spark joins them by shuffle.
BROADCAST_ROWS = 500_000
#: Members of a class from which it is broadcast in place of shuffled; there are fewer such classes than rows / HOT_COPIES.
HOT_COPIES = 100_000
#: Documents whose prefixes may hold an n-gram for it to gather in a bucket.
HOT = 1 << 22
#: Regions that n-grams beyond it name.
HOT_REGIONS = 64
#: Cells of a bucket, about.
BUCKET_CELLS = 1 << 20
#: Colours of texts, in words of 64, and size classes among them, so many an octave.
COLOURS, CLASSES, STEPS = 128, 32, 8
#: Times that texts are told from chance meetings by colours; each time fewer are left to have them.
ROUNDS = 3
#: Documents of a block of cells, at most; their numbers take 2 bytes.
BLOCK_DOCS = 1 << 16
#: Text of a block of a region.
TILE_BYTES = 1 << 24
#: Members of a block of a region; fewer bytes of short texts are as many pairs.
TILE_MEMBERS = 1 << 13
LEAF = 512
PIVOTS = 12
#: Cells of the dense matrices of a leaf.
MATRIX = 1 << 23
#: A key that so large a share (1 / DENSE) of a leaf's pairs hold is a column of the dense matrices.
DENSE = 64
#: Different sets of lower pivots in a region of which every two are compared at once.
PATTERNS = 1 << 11
_HASH_BITS, _RANK = np.uint64(56), np.uint64(8)
_A, _B = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


class Order:
    """Where an n-gram stands among all: those of rare words first, those that are themselves frequent (`grams` above 0) last."""

    def __init__(self, words: np.ndarray, grams: np.ndarray, hot: int = HOT) -> None:
        self.words = np.minimum(np.log2(np.maximum(words, 1)) * 3, 127).astype(np.uint8)
        self.grams = np.where(grams > 0, 128 + np.minimum(np.log2(np.maximum(grams, 1)) * 3, 127), 0).astype(np.uint8)
        self.hot = grams > hot


def text_grams(column: pa.Array, n: int) -> Iterator[tuple]:
    """(first row, end row, n-gram hashes, row of each, words' hashes, first word of each n-gram, whether it is a text of fewer words) of slices of the rows."""
    data, offsets = buffers(column)
    for a, b in slices(offsets):
        h, doc, _, _ = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        grams, at = ngram_hashes(h, doc, n)
        owner = doc[at]
        words = segments(doc, b - a)
        each = np.diff(words)
        short = np.flatnonzero((each > 0) & (each < n))
        whole_text = np.zeros(len(grams), dtype=bool)
        if len(short):
            whole = h[words[short]]
            for k in range(1, n - 1):
                more = each[short] > k
                whole = np.where(more, mix(whole * np.uint64(31) + h[np.minimum(words[short] + k, len(h) - 1)]), whole)
            grams, owner, at = np.concatenate([grams, mix(whole + np.uint64(1))]), np.concatenate([owner, short]), np.concatenate([at, words[short]])
            by = np.argsort(owner, kind="stable")
            grams, owner, at, whole_text = grams[by], owner[by], at[by], by >= len(whole_text)
        yield a, b, grams, owner, h, at, whole_text


def prints(grams: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's n-grams with how often it has each; 0 for a text of none."""
    out = []
    size = np.diff(offsets)
    some = np.flatnonzero(size)
    for salt in (_A, _B):
        x = np.zeros(len(size), dtype=np.uint64)
        if len(some):
            x[some] = mix(np.add.reduceat(mix((grams ^ salt) * _A), offsets[:-1][some]) + size[some].astype(np.uint64) * salt)
        out.append(x)
    return out[0], out[1]


_PASS = "doc_id long, h1 long, h2 long, size int, bytes long, bucket int, n long"


def _first_pass(docs: DataFrame, n: int) -> DataFrame:
    """One reading of the texts: a row (doc_id, h1, h2, size, bytes) for each of them, and for each task rows (bucket, n) of its words and n-grams by hash.
    A task reports the n-gram buckets above `HEAVY` times its mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams = np.zeros(WORD_BUCKETS, dtype=np.int64), np.zeros(GRAM_BUCKETS, dtype=np.int64)

        def rows(columns: list, length: int) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(length, k) if c is None else c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "h1", "h2", "size", "bytes", "bucket", "n"])

        for batch in batches:
            at = buffers(batch.column("text"))[1]
            for a, b, g, owner, h, _, _ in text_grams(batch.column("text"), n):
                words += np.bincount((h & np.uint64(WORD_BUCKETS - 1)).astype(np.int64), minlength=WORD_BUCKETS)
                grams += np.bincount(_bucket(g >> _RANK), minlength=GRAM_BUCKETS)
                offsets = segments(owner, b - a)
                one, two = prints(g, offsets)
                yield rows([batch.column("doc_id").slice(a, b - a), one.view(np.int64), two.view(np.int64), np.diff(offsets).astype(np.int32), np.diff(at[a : b + 1]), None, None], b - a)
        w = np.flatnonzero(words)
        g = np.flatnonzero(grams > HEAVY * max(1.0, grams.sum() / len(grams)))
        bucket, total = np.concatenate([w, g + WORD_BUCKETS]), np.concatenate([words[w], grams[g]])
        yield rows([None] * 5 + [bucket.astype(np.int32), total], len(bucket))

    return docs.mapInArrow(release(run), _PASS)


def _order(counts: DataFrame, hot: int) -> Order:
    rows = counts.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # WORD_BUCKETS + GRAM_BUCKETS rows at most
    out = np.zeros(WORD_BUCKETS + GRAM_BUCKETS, dtype=np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return Order(out[:WORD_BUCKETS], out[WORD_BUCKETS:], hot)


def ngram_sets(column: pa.Array, order: Order, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, keys, offsets, prints) of slices of the rows: each row's distinct n-gram keys, in ascending order, rarest first."""
    word_mask = np.uint64(len(order.words) - 1)
    for a, b, grams, owner, h, at, whole_text in text_grams(column, n):
        rank = order.words[(h & word_mask).astype(np.int64)].astype(np.uint64)
        weight = rank[at]
        for k in range(1, n):
            weight = weight + np.where(whole_text, 0, rank[np.minimum(at + k, len(rank) - 1)]) if len(at) else weight
        heavy = order.grams[_bucket(grams >> _RANK)].astype(np.uint64)
        where = segments(owner, b - a)
        keys = (np.where(heavy > 0, heavy, np.minimum(weight // np.uint64(n), np.uint64(127))) << _HASH_BITS) | (grams >> _RANK)
        one, _ = prints(grams, where)
        for i, j in zip(where[:-1].tolist(), where[1:].tolist()):
            keys[i:j].sort()
        keep = np.ones(len(keys), dtype=bool)
        keep[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        yield a, keys[keep], segments(owner[keep], b - a), one


def _bucket(gram: np.ndarray) -> np.ndarray:
    """Bucket of the 56 bits of an n-gram that its key has."""
    return (gram & np.uint64(GRAM_BUCKETS - 1)).astype(np.int64)


def meetings_least(size: np.ndarray) -> np.ndarray:
    """Two sets within the threshold share so many n-grams, by the smaller of the two, among the prefixes of both."""
    return np.maximum(1, np.floor(SHARED * size + 1e-9).astype(np.int64))


def prefix_sizes(size: np.ndarray, threshold: float) -> np.ndarray:
    """Sets that overlap in ceil(threshold * size) share l of the size - ceil(threshold * size) + l first elements in any order of all."""
    return np.where(size > 0, np.minimum(size, size - np.ceil(threshold * size - 1e-9).astype(np.int64) + meetings_least(size)), 0)


def size_class(size) -> Column:
    return F.floor(F.log2(size.cast("double")) * STEPS).cast("int")


def colour_of(ids, size) -> Column:
    """A text's colour: its size class, of which those four octaves apart are alike, and a hash."""
    return (F.pmod(size_class(size), F.lit(CLASSES)) * (COLOURS // CLASSES) + F.pmod(F.xxhash64(ids), F.lit(COLOURS // CLASSES))).cast("int")


def shared_least(size: np.ndarray, threshold: float) -> np.ndarray:
    """How many cells, at least, a text of each size shares with any partner of each size class (columns); a class of no partners has more than all.

    An overlap of threshold / (1 + threshold) (|x| + |y|) is within both prefixes but for what lies in the longer of the two rests."""
    own = np.floor(np.log2(size) * STEPS).astype(np.int64)
    out = np.empty((len(size), CLASSES), dtype=np.int64)
    x, never = size.astype(np.float64), 1 << 50
    rest = lambda y: threshold * y + 1 - np.maximum(1, SHARED * y - 1)  # noqa: E731  at least the size of y less its prefix
    for c in range(CLASSES):
        k = own + (c - own + CLASSES // 2) % CLASSES - CLASSES // 2  # the class alike that is nearest
        low, high = np.maximum(2.0 ** (k / STEPS) * (1 - 1e-9), threshold * x - 1e-6), np.minimum(2.0 ** ((k + 1) / STEPS) * (1 + 1e-9), x / threshold + 1e-6)
        least = np.ceil(threshold / (1 + threshold) * (x + low) - np.maximum(rest(x), rest(high)) - 1e-6)
        out[:, c] = np.where(low > high, never, np.maximum(1, least)) if -math.log2(threshold) * STEPS < CLASSES // 2 - 1 else 1
    return out


def _needed(threshold: float, last: bool):
    """From rows (id, size, pivot, n, colour, k, masks) of a partition by id: the (id, size, pivot, n) that a pair may need.

    A region's masks have the colours of its k members. All cells that a text shares with a partner are in regions of the partner's colour, so a text stays in the regions of a colour
    for which its cells add up to what a partner of that size class shares. A pair keeps all regions where it shares cells, so this can be repeated with the colours of those that stayed.
    Of these, the last time, a text may then drop those of fewest cells, as far as two texts of a pair drop less together
    than they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        columns = [table.column(c).to_numpy() for c in ("id", "size", "pivot", "n", "colour", "k")]
        masks = [table.column(f"m{i}").to_numpy().view(np.uint64) for i in range(COLOURS // 64)]
        by = np.lexsort((columns[1], columns[0]))
        ids, size, pivot, n, colour, k = (x[by] for x in columns)
        masks = [m[by] for m in masks]
        one = sum(np.bitwise_count(m).astype(np.int64) for m in masks) == k  # all members of different colours, so none but the text itself has its own
        for i, m in enumerate(masks):
            masks[i] = np.where(one & (colour // 64 == i), m & ~(np.uint64(1) << (colour % 64).astype(np.uint64)), m)
        head = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (size[1:] != size[:-1])))
        each = np.diff(np.append(head, len(ids)))
        least = shared_least(size[head], threshold)
        keep, fewest = np.zeros(len(ids), dtype=bool), np.full(len(head), 1 << 50)
        for c in range(COLOURS):
            has = ((masks[c // 64] >> np.uint64(c % 64)) & np.uint64(1)).astype(bool)
            if has.any():
                enough = least[:, c // (COLOURS // CLASSES)]
                good = np.add.reduceat(np.where(has, n, 0), head) >= enough
                keep |= has & np.repeat(good, each)
                fewest = np.where(good, np.minimum(fewest, enough), fewest)
        fewest = np.repeat(fewest, each)[keep]
        ids, size, pivot, n = ids[keep], size[keep], pivot[keep], n[keep]
        if not last:
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(size), pa.array(pivot), pa.array(n)], ["id", "size", "pivot", "n"])
            return
        by = np.lexsort((pivot, n, size, ids))
        ids, size, pivot, n, fewest = ids[by], size[by], pivot[by], n[by], fewest[by]
        total = np.cumsum(n)
        head = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (size[1:] != size[:-1]))) if len(ids) else np.zeros(0, dtype=np.int64)
        before = np.repeat((total - n)[head], np.diff(np.append(head, len(ids))))
        keep = total - before > (fewest - 1) // 2
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(size[keep]), pa.array(pivot[keep]), pa.array(n[keep])], ["id", "size", "pivot", "n"])

    return run


class Plan:
    """Sizes that follow from the number of cells: those of a chunk and of a bucket, buckets, and bits of a cell's number."""

    def __init__(self, cells: int, least_buckets: int) -> None:
        self.chunk = min(max(math.isqrt(64 * max(1, cells)), BUCKET_CELLS), BUCKET_CELLS << 4)
        self.buckets = max(least_buckets, -(-cells // self.chunk))
        self.bits = min(48, max(16, cells.bit_length() + 13))  # two n-grams of a number only mean a chance meeting


def pack_block(cell: np.ndarray, ids: np.ndarray, size: np.ndarray, who: np.ndarray) -> bytes:
    """Cells in ascending order with the places of their texts in ids (below 2**48) and sizes, as planes of bytes."""
    used, who = np.unique(who, return_inverse=True)
    steps = np.diff(cell)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    head = np.array([len(cell), len(used), width, int(cell[0])], dtype="<u8").tobytes()
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    numbers = ids[used].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T
    return b"".join([head, planes.tobytes(), who.astype("<u2").tobytes(), numbers.tobytes(), size[used].astype("<u4").tobytes()])


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, ids, sizes)"""
    n, used, width, first = np.frombuffer(block, "<u8", 4).tolist()
    at = 32

    def planes(rows: int, k: int) -> np.ndarray:
        nonlocal at
        out = np.zeros((rows, 8), dtype=np.uint8)
        out[:, :k] = np.frombuffer(block, np.uint8, rows * k, at).reshape(k, rows).T
        at += rows * k
        return out.view("<u8").ravel()

    cell = np.cumsum(np.concatenate([np.array([first], dtype=np.uint64), planes(n - 1, width)]), dtype=np.uint64)
    who = np.frombuffer(block, "<u2", n, at).astype(np.int64)
    at += 2 * n
    ids = planes(used, 6).astype(np.int64)
    size = np.frombuffer(block, "<u4", used, at).astype(np.int64)
    return cell, ids[who], size[who]


def text_id(print_one: np.ndarray) -> np.ndarray:
    """48 bits of a text's print; texts that share them share each other's regions, which costs work only."""
    return (print_one >> np.uint64(16)).astype(np.int64)


def _blocks(docs: DataFrame, order, n: int, threshold: float, plan: Plan) -> DataFrame:
    """(bucket, hot, block): the n-gram pivots whose cells the texts enter, a text once a task. Cells of hot n-grams are numbers of regions and go where their text goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o, seen = order.value, set()
        held: list[tuple] = []
        count = docs_held = 0

        def cut(cell: np.ndarray, bucket: np.ndarray, ids: np.ndarray, size: np.ndarray, who: np.ndarray, hot: bool) -> Iterator[tuple[int, bool, bytes]]:
            by = np.lexsort((cell, bucket)) if hot else np.argsort(cell, kind="stable")
            cell, bucket, who = cell[by], bucket[by], who[by]
            bounds = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                yield int(bucket[i]), hot, pack_block(cell[i:j], ids, size, who[i:j])

        def flush() -> pa.RecordBatch:
            nonlocal count, docs_held
            keys, ids, size, p = (np.concatenate(x) for x in zip(*held))
            held.clear()
            who = np.repeat(np.arange(len(ids)), p)
            gram = keys & np.uint64((1 << 56) - 1)
            hot = o.hot[_bucket(gram)] if o.hot.any() else np.zeros(len(gram), dtype=bool)
            cell = gram >> np.uint64(56 - plan.bits)
            rows = []
            if not hot.all():
                c = cell[~hot]
                rows += cut(c, ((c * np.uint64(plan.buckets)) >> np.uint64(plan.bits)).astype(np.int64), ids, size, who[~hot], False)
            if hot.any():
                rows += cut(cell[hot] % np.uint64(HOT_REGIONS), ids[who[hot]] % plan.buckets, ids, size, who[hot], True)
            count = docs_held = 0
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "hot", "block"])

        for batch in batches:
            for _, keys, offsets, one in ngram_sets(batch.column("text"), o, n):
                ids, size = text_id(one), np.diff(offsets)
                p = prefix_sizes(size, threshold)
                for k in np.flatnonzero(size).tolist():
                    i = int(ids[k])
                    if i in seen:
                        p[k] = 0
                    seen.add(i)
                use = np.flatnonzero(p)
                if not len(use):
                    continue
                p = p[use]
                ends = np.cumsum(p)
                held.append((keys[np.arange(int(ends[-1])) + np.repeat(offsets[:-1][use] - (ends - p), p)], ids[use], size[use], p))
                count, docs_held = count + int(ends[-1]), docs_held + len(use)
                if count >= plan.chunk or docs_held >= BLOCK_DOCS // 2:
                    yield flush()
        if held:
            yield flush()

    return docs.select("text").mapInArrow(release(run), "bucket int, hot boolean, block binary")


def _meetings(threshold: float):
    """From the blocks of a bucket: (id, pivot, n, size): n cells in which a text meets that pivot, the lowest text of a cell.
    A cell is first divided where sizes are too far apart to pair."""

    def counted(ids: np.ndarray, pivot: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        by = np.lexsort((pivot, ids))
        ids, pivot, size = ids[by], pivot[by], size[by]
        head = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (pivot[1:] != pivot[:-1]))) if len(ids) else np.zeros(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[head]), pa.array(pivot[head]), pa.array(np.diff(np.append(head, len(ids)))), pa.array(size[head].astype(np.int32))], ["id", "pivot", "n", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        for batch in batches:
            for bucket, hot, block in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if hot:
                    region, ids, size = unpack_block(block)
                    yield counted(ids, -1 - region.astype(np.int64), size)
                else:
                    kept.setdefault(bucket, []).append(block)
        for bucket in sorted(kept):
            cell, ids, size = (np.concatenate(x) for x in zip(*map(unpack_block, kept.pop(bucket))))
            by = np.argsort(cell, kind="stable")
            same = cell[by][1:] == cell[by][:-1]
            by = by[np.append(False, same) | np.append(same, False)]  # a cell of one text brings nobody together
            cell, ids, size = cell[by], ids[by], size[by]
            by = np.lexsort((ids, size, cell))
            cell, ids, size = cell[by], ids[by], size[by]
            new = np.append(True, (cell[1:] != cell[:-1]) | (ids[1:] != ids[:-1])) if len(cell) else np.zeros(0, dtype=bool)
            cell, ids, size = cell[new], ids[new], size[new]
            if not len(cell):
                continue
            head = np.ones(len(cell), dtype=bool)
            head[1:] = (cell[1:] != cell[:-1]) | (size[:-1] < threshold * size[1:] - 1e-9)
            start = np.flatnonzero(head)
            each = np.diff(np.append(start, len(cell)))
            lowest = np.repeat(np.minimum.reduceat(ids, start), each)
            met = np.repeat(each > 1, each)
            yield counted(ids[met], lowest[met], size[met])

    return run


class Incidence:
    """Which sets hold which of the keys that two or more of them hold: keys are numbered once, so that blocks of pairs need no sorting of their own."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(x) for x in sets], dtype=np.int64)
        keys = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
        by = np.argsort(keys)
        keys = keys[by]
        new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
        del keys
        each = np.diff(np.append(np.flatnonzero(new), len(new)))
        place = np.where(each > 1, np.cumsum(each > 1) - 1, -1).astype(np.int32)
        numbers = np.empty(len(by), dtype=np.int32)
        numbers[by] = np.repeat(place, each)
        use = numbers >= 0
        self.width = int((each > 1).sum())
        self.offsets = np.concatenate([[0], np.cumsum(use)])[np.concatenate([[0], np.cumsum(self.size)])]
        self.numbers = numbers[use]

    def _of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in x, number) of each key of the sets x"""
        each = self.offsets[x + 1] - self.offsets[x]
        ends = np.cumsum(each)
        return np.repeat(np.arange(len(x)), each), self.numbers[np.arange(int(ends[-1])) + np.repeat(self.offsets[x] - (ends - each), each)]

    def overlaps(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """|x & y| for every two: keys of many of these sets as products of 0/1 matrices, the others pair by pair."""
        shape = len(x), len(y)
        if not len(x) or not len(y):
            return np.zeros(shape, dtype=np.float32)
        (i, k), (j, l) = self._of(x), self._of(y)
        in_x, in_y = np.bincount(k, minlength=self.width), np.bincount(l, minlength=self.width)
        pairs = in_x * in_y
        many = pairs * DENSE >= len(x) * len(y)
        out = np.zeros(shape, dtype=np.float32)
        place = np.cumsum(many) - 1
        own, other = many[k], many[l]
        p, q = (i[own], place[k[own]]), (j[other], place[l[other]])
        step = max(1, MATRIX // (2 * max(shape)))
        for a in range(0, int(many.sum()), step):
            sides = []
            for n, (who, at) in zip(shape, (p, q)):
                some = (at >= a) & (at < a + step)
                m = np.zeros((n, min(step, len(many), int(many.sum()) - a)), dtype=np.float32)
                m[who[some], at[some] - a] = 1
                sides.append(m)
            out += sides[0] @ sides[1].T
        few = (pairs > 0) & ~many
        if few.any():
            own, other = few[k], few[l]
            i, k, j, l = i[own], k[own], j[other], l[other]
            i = i[np.argsort(k, kind="stable")]
            first = np.cumsum(np.where(few, in_x, 0)) - np.where(few, in_x, 0)
            ends = np.cumsum(in_x[l])
            a = 0
            while a < len(l):
                done = int(ends[a - 1]) if a else 0
                b = max(a + 1, int(np.searchsorted(ends, done + MATRIX // 8, side="right")))
                each = in_x[l[a:b]]
                row = i[np.arange(int(ends[b - 1]) - done) + np.repeat(first[l[a:b]] - (ends[a:b] - each - done), each)]
                out += np.bincount(row * len(y) + np.repeat(j[a:b], each), minlength=len(x) * len(y)).reshape(shape)
                a = b
        return out

    def similarities(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        both = np.where(x[:, None] == y, self.size[y], self.overlaps(x, y).astype(np.float64))  # a set shares with itself what it shares with no other
        return both / (self.size[x][:, None] + self.size[y] - both)


Take = Callable[[np.ndarray, np.ndarray, np.ndarray], None]


def join_region(sets: list[np.ndarray], threshold: float, take: Take, left: int | None = None) -> None:
    """take(i, j, similarity) for every two of these sets that are within 1 - threshold, each pair once; with `left`, only for those of the first `left` sets with the others."""
    eps = 1 - threshold
    held = Incidence(sets)

    def compare(x_all: np.ndarray, y_all: np.ndarray, same: bool) -> None:
        for a in range(0, len(x_all), LEAF):
            for b in range(a if same else 0, len(y_all), LEAF):
                x, y = x_all[a : a + LEAF], y_all[b : b + LEAF]
                s = held.similarities(x, y)
                i, j = np.nonzero(s >= threshold - 1e-9)
                if same and a == b:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    take(x[i], y[j], s[i, j])

    def divide(home: np.ndarray, guests: np.ndarray, at_most: int) -> None:
        if len(home) + len(guests) <= LEAF or len(home) <= PIVOTS or len(home) + len(guests) > at_most:
            if left is None:
                compare(home, home, True)
            compare(home, guests, False)
            return
        pivots = home[np.linspace(0, len(home) - 1, PIVOTS).astype(int)]
        everyone = np.concatenate([home, guests])
        d = 1 - np.concatenate([held.similarities(everyone[a : a + LEAF], pivots) for a in range(0, len(everyone), LEAF)])
        nearest, own = d.min(axis=1), d.argmin(axis=1)
        own[len(home) :] = PIVOTS  # a guest has no home here
        for p in range(PIVOTS):
            inside = np.flatnonzero(own == p)
            if len(inside):
                near = (own > p if left is None else own == PIVOTS) & (d[:, p] <= nearest + 2 * eps + 1e-9) & (d[:, p] <= d[inside, p].max() + eps + 1e-9)
                divide(everyone[inside], everyone[near], (len(home) + len(guests)) * 9 // 10)

    every = np.arange(len(sets))
    divide(every if left is None else every[:left], every[:0] if left is None else every[left:], len(sets) + 1)


class Forest:
    """The lowest of each group that links connect, of numbers 0 to n - 1."""

    def __init__(self, n: int) -> None:
        self.root, self.held, self.count = np.arange(n), [], 0

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        self.held.append((i, j))
        self.count += len(i)
        if self.count > 1 << 18:
            self.settle()

    def settle(self) -> np.ndarray:
        if self.held:
            i, j = (np.concatenate(x) for x in zip(*self.held))
            self.held, self.count = [], 0
            while True:
                a, b = self.root[i], self.root[j]
                apart = a != b
                if not apart.any():
                    break
                i, j, a, b = i[apart], j[apart], a[apart], b[apart]
                np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
                while (deeper := self.root[self.root]).tobytes() != self.root.tobytes():
                    self.root = deeper
        return self.root


def disjoint(sets: list[np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that tells of sets i and sets j, by number, which two share nothing; none that is asked for is empty."""
    if len(sets) <= PATTERNS:
        apart: list[np.ndarray] = []

        def every(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            if len(i) and not apart:
                at, held = np.arange(len(sets)), Incidence(sets)
                apart.append(np.concatenate([(held.overlaps(at[a : a + LEAF], at) == 0) & (at[a : a + LEAF, None] != at) for a in range(0, len(at), LEAF)]))
            return apart[0][i, j] if len(i) else np.zeros(0, dtype=bool)

        return every
    as_sets = [frozenset(x.tolist()) for x in sets]

    def once(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        code, back = np.unique(i * len(sets) + j, return_inverse=True)
        a, b = np.divmod(code, len(sets))
        return np.array([as_sets[x].isdisjoint(as_sets[y]) for x, y in zip(a.tolist(), b.tolist())], dtype=bool)[back]

    return once


_LINKS, _PAIRS = "doc_id long, peer long, n_links long", "doc_a long, doc_b long, jaccard double"


def _regions(threshold: float, links: bool, order, n_gram: int):
    """From rows sorted by (pivot, x, y): with links (doc_id, peer, n_links), a row for each member that has links here, else (doc_a, doc_b, jaccard) of each pair, those that count in this region."""

    def solve(pivot: int, cross: bool, rows: list[tuple]) -> list[np.ndarray]:
        """rows: (doc_id, copies, other pivots, first block, set)"""
        rows = sorted(rows, key=lambda r: not r[3])
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        copies = np.array([r[1] for r in rows], dtype=np.int64)
        patterns: dict[tuple, int] = {}
        lower = np.array([patterns.setdefault(tuple(sorted({p for p in r[2] if p < pivot})), len(patterns)) for r in rows])
        shy = np.array([bool(x) for x in patterns])[lower]
        apart = disjoint([np.array(x, dtype=np.int64) for x in patterns])
        total, forest = np.zeros(len(rows), dtype=np.int64), Forest(len(rows))
        out: list[tuple] = []

        def take(i: np.ndarray, j: np.ndarray, s: np.ndarray) -> None:
            use = ids[i] != ids[j]
            both = np.flatnonzero(use & shy[i] & shy[j])
            use[both] = apart(lower[i[both]], lower[j[both]])
            i, j, s = i[use], j[use], s[use]
            if links:
                np.add.at(total, i, copies[j])
                np.add.at(total, j, copies[i])
                forest.link(i, j)
            else:
                out.append((np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), s))

        join_region([r[4] for r in rows], threshold, take, sum(r[3] for r in rows) if cross else None)
        if not links:
            return [np.concatenate(x) for x in zip(*out)] if out else []
        some = np.flatnonzero(total)
        return [ids[some], ids[forest.settle()[some]], total[some]] if len(some) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "peer", "n_links"] if links else ["doc_a", "doc_b", "jaccard"]
        region, rows, parts, n, seen = None, [], [], 0, set()

        def close() -> None:
            nonlocal n
            if len(rows) > 1:
                part = solve(region[0], region[1] != region[2], rows)
                if part:
                    parts.append(part)
                    n += len(part[0])

        def take() -> pa.RecordBatch:
            nonlocal n
            batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], names)
            parts.clear()
            n = 0
            return batch

        for batch in batches:
            keys_of = list(zip(*(batch.column(c).to_pylist() for c in ("pivot", "x", "y"))))
            docs, h1, copies, pivots, block = (batch.column(c).to_pylist() for c in ("doc_id", "h1", "copies", "pivots", "block"))
            for a, keys, offsets, one in ngram_sets(batch.column("text"), order.value, n_gram):
                one = one.view(np.int64).tolist()
                for i in range(a, a + len(offsets) - 1):
                    if keys_of[i] != region:
                        close()
                        region, rows, seen = keys_of[i], [], set()
                        if n > 100_000:
                            yield take()
                    if one[i - a] == h1[i] and (docs[i], h1[i]) not in seen:  # of a doc_id with several texts, this one, and once
                        seen.add((docs[i], h1[i]))
                        rows.append((docs[i], copies[i], pivots[i], block[i] == region[1], keys[offsets[i - a] : offsets[i - a + 1]].copy()))
        close()
        if parts:
            yield take()

    return run


def _classes(texts: DataFrame) -> DataFrame:
    """(h1, h2, rep, copies, size, bytes) of each class of copies."""
    return texts.filter("size > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies"), F.max("size").alias("size"), F.max("bytes").alias("bytes"))


def _few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it was counted to have no more rows than most."""
    return F.broadcast(df) if df.count() <= most else df


def _coloured(met: DataFrame, threshold: float, last: bool) -> DataFrame:
    """The rows (id, size, pivot, n) of met that a pair may need, by the colours of the members of each region."""
    met = met.withColumn("colour", colour_of(F.col("id"), F.col("size")))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("colour") % 64)
    names = [f"m{i}" for i in range(COLOURS // 64)]
    masks = [F.bit_or(F.when(F.floor(F.col("colour") / 64) == i, bit).otherwise(F.lit(0).cast("long"))).alias(m) for i, m in enumerate(names)]
    seen = met.groupBy("pivot").agg(F.count(F.lit(1)).alias("k"), *masks).filter("k > 1")
    coloured = met.join(seen, "pivot").repartition("id").select("id", "size", "pivot", "n", "colour", "k", *names)
    return coloured.mapInArrow(release(_needed(threshold, last)), "id long, size int, pivot long, n int")


def _joined(docs: DataFrame, threshold: float, n: int, links: bool, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first pass, classes, rows of all regions)"""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    first = written(_first_pass(docs, n), "first-pass")
    order = spark.sparkContext.broadcast(_order(first, hot))
    texts = first.filter("doc_id IS NOT NULL")
    classes = written(_classes(texts), "classes")
    docs = docs.filter("text IS NOT NULL")
    size = F.col("size").cast("double")
    cells = texts.agg(F.sum(size - F.ceil(threshold * size) + F.greatest(F.lit(1), F.floor(SHARED * size)))).first()[0]
    plan = Plan(int(cells or 0), int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = _blocks(docs, order, n, threshold, plan).repartitionById(plan.buckets, F.col("bucket"))
    met = blocks.mapInArrow(release(_meetings(threshold)), "id long, pivot long, n long, size int").groupBy("id", "size", "pivot").agg(F.sum("n").cast("int").alias("n"))
    met = written(met, "met")
    for _ in range(ROUNDS - 1):
        table, met = met, written(_coloured(met, threshold, False), "met")
        dropped(table)
    needed = _coloured(met, threshold, True).select("id", "pivot").distinct()
    # Members of regions: classes by the 48 bits of their print; a region of one brings nobody together.
    own = classes.select(F.col("rep").alias("doc_id"), "h1", "copies", "bytes", F.shiftrightunsigned("h1", 16).alias("id"))
    members = written(needed.join(own, "id").drop("id"), "members")
    dropped(met)
    regions = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("k"), F.sum("bytes").alias("b")).filter("k > 1").select("pivot", F.greatest(F.ceil(F.col("b") / TILE_BYTES), F.ceil(F.col("k") / TILE_MEMBERS)).cast("int").alias("blocks"))
    places = members.join(regions, "pivot").groupBy("doc_id", "h1", "copies").agg(F.collect_list(F.struct("pivot", "blocks")).alias("places"))
    places = written(places.withColumn("pivots", F.col("places.pivot")), "places")
    dropped(members)
    # A text is half as long as its set of hashes and compresses, so texts travel and regions hash them.
    at = docs.join(_few(places), "doc_id").select("doc_id", "text", "h1", "copies", "pivots", F.explode("places").alias("p")).select("*", "p.pivot", "p.blocks").drop("p")
    at = at.withColumn("block", F.pmod(F.xxhash64("doc_id", "h1"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = at.select("pivot", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "doc_id", "h1", "copies", "pivots", "block", "text")
    at = at.repartition("pivot", "x", "y").sortWithinPartitions("pivot", "x", "y")
    return texts, classes, at.mapInArrow(release(_regions(threshold, links, order, n)), _LINKS if links else _PAIRS)


def _copies(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, rep, copies, ...) of the documents of classes of more than one. Large classes are few and broadcast, so no key gathers more than HOT_COPIES rows."""
    rows = texts.filter("size > 0").select("doc_id", "h1", "h2").distinct()
    several = classes.filter("copies > 1")
    hot = F.broadcast(several.filter(F.col("copies") > HOT_COPIES))
    return rows.join(hot, ["h1", "h2"]).unionByName(rows.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(several.filter(F.col("copies") <= HOT_COPIES), ["h1", "h2"]))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, hot: int = HOT) -> DataFrame:
    """(doc_a, doc_b, jaccard) with doc_a < doc_b: every pair of classes with jaccard >= threshold, by their lowest doc_ids, and each class's lowest doc_id with its other members, at 1. 0 < threshold <= 1."""
    texts, classes, pairs = _joined(docs, threshold, n, False, hot)
    copies = _copies(texts, classes).filter("doc_id <> rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return pairs.unionByName(copies).groupBy("doc_a", "doc_b").agg(F.round(F.max("jaccard"), 6).alias("jaccard"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, hot: int = HOT) -> DataFrame:
    """(doc_id, class_id, n_links) of every document: the lowest doc_id that links lead to, and with how many documents (copies included) it is linked."""
    texts, classes, found = _joined(docs, threshold, n, True, hot)
    links = written(found.groupBy("doc_id", "peer").agg(F.sum("n_links").alias("n_links")), "links")
    several = texts.filter("size > 0").select("doc_id", "h1", "h2").distinct()
    torn = several.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("doc_id")
    torn = several.join(torn, "doc_id").join(classes.select("h1", "h2", "rep"), ["h1", "h2"])
    edges = links.select(F.col("doc_id").alias("doc_a"), F.col("peer").alias("doc_b")).unionByName(torn.select(F.col("doc_id").alias("doc_a"), F.col("rep").alias("doc_b")))
    lowest = groups(edges)
    each = links.groupBy("doc_id").agg(F.sum("n_links").alias("others"))
    whole = classes.join(lowest.select(F.col("doc_id").alias("rep"), "group_id"), "rep", "left").join(each.select(F.col("doc_id").alias("rep"), "others"), "rep", "left")
    # A class's links are those of its text, so the classes of a doc_id that is the lowest of several have the links of all of them.
    whole = whole.select("h1", "h2", "rep", "copies", F.coalesce("group_id", "rep").alias("class_id"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    whole = written(whole, "linked-classes")
    rows = whole.filter("copies = 1").select(F.col("rep").alias("doc_id"), "class_id", "n_links").unionByName(_copies(texts, whole).select("doc_id", "class_id", "n_links"))
    rows = rows.unionByName(texts.filter("size = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))
    return rows.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"))


def groups(pairs: DataFrame) -> DataFrame:
    """(doc_id, group_id) of every document of the pairs: group_id is the lowest doc_id that pairs lead to.

    Large-star and small-star turns until nothing changes; each turn's edges are written to the shared folder."""
    edges = written(pairs.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above u join the least of u's neighbourhood.
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: neighbours below u, and u, join the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        after = written(small, "edges")
        same = after.count() == edges.count() and not after.join(edges, ["u", "v"], "left_anti").head(1)
        dropped(edges)
        edges = after
        if same:
            break
    return edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("doc_id"), F.col("v").alias("group_id")).unionByName(edges.select(F.col("v").alias("doc_id"), F.col("v").alias("group_id")).distinct())


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """The rows of docs but for documents that a group's lowest doc_id stands for."""
    gone = written(near_duplicates(docs, threshold, n).filter("doc_id <> class_id").select(F.col("doc_id").alias("gone")), "gone")
    gone = _few(gone).withColumnRenamed("gone", unused("gone", docs.columns))
    return docs.join(gone, docs["doc_id"] == gone[gone.columns[0]], "left_anti")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_ngram_jaccard_join": op10_ngram_jaccard_join}
SQL = {
    "op10_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+') AS w FROM documents
), g AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= {N} THEN list_transform(range(1, len(w) - {N - 2}), lambda i: array_to_string(w[i:i + {N - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1
), o AS (
  SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), linked AS MATERIALIZED (
  SELECT doc_a, doc_b FROM o JOIN n x ON x.doc_id = doc_a JOIN n y ON y.doc_id = doc_b WHERE o / (x.n + y.n - o) >= {THRESHOLD} - 1e-9
), reached AS (
  SELECT DISTINCT doc_id, doc_id AS other FROM documents WHERE doc_id IS NOT NULL UNION SELECT reached.doc_id, doc_b FROM reached JOIN linked ON doc_a = other
)
SELECT doc_id, min(other) AS class_id, (SELECT count(*) FROM linked WHERE doc_a = doc_id) AS n_links FROM reached GROUP BY 1"""
}
