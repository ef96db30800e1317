"""Chat training windows within a token budget.

A turn is its role marker, the ids of its text and an end marker. Prefix sums of the turns' tokens choose the spans: a window holds the
conversation's first system turn, then whole earlier turns of at most `history` tokens as context, then as many new whole turns as the rest of
the budget takes. The next window's new turns begin where these end, so each turn is new in one window. Targets are the tokens after the marker of
new turns of the assistant; the system turn and repeated turns are context, so no target is trained on twice.

Defined results: turns are ordered by (turn, role, text), nulls last; rows of a conversation that are alike in all three count once; a null text is an
empty turn and a null or unknown role gets the marker of other roles; a new turn that doesn't fit with the system turn and history loses the history,
and if it is still too long has a window of its own, whole, with `over_budget` true; a conversation of a system turn alone has one window without
targets; rows without conv_id are skipped; only conv_id, turn, role and text are looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import VOCABULARY, VOCABULARY_SIZE, tokenizer

BUDGET = 1024
HISTORY = 256
ROLES = ("system", "user", "assistant", "tool")
WINDOWS = "conv_id long, window int, first_turn int, last_turn int, n_history int, n_tokens int, over_budget boolean, tokens array<int>, targets array<struct<start:int,end:int>>"
_TARGETS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_WINDOWS = pa.schema(
    [("conv_id", pa.int64()), *((c, pa.int32()) for c in ("window", "first_turn", "last_turn", "n_history", "n_tokens")), ("over_budget", pa.bool_()), ("tokens", pa.list_(pa.int32())), ("targets", _TARGETS)]
)
#: Windows given to Spark at once.
ROWS = 256


def spans(sizes: np.ndarray, system: int, budget: int, history: int) -> list[tuple[int, int, int]]:
    """(first turn of history, first new turn, end) of each window, for the token counts of the turns other than the system turn, which has `system` tokens."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    out, new, n = [], 0, len(sizes)
    while new < n:
        start = int(np.searchsorted(total, total[new] - history, side="left"))
        if system + total[new + 1] - total[start] > budget:
            start = new
        end = int(np.searchsorted(total, total[start] + budget - system, side="right")) - 1
        end = max(end, new + 1)
        out.append((start, new, end))
        new = end
    return out


def windows_of(turns: list[tuple[str | None, np.ndarray]], budget: int, history: int, markers: int) -> Iterator[tuple]:
    """(first new turn, last, turns of history, over, tokens, targets) of each window of a conversation of (role, ids) turns. Turn numbers count from 0 in order."""
    marked = [np.concatenate([[markers + (ROLES.index(r) if r in ROLES else len(ROLES))], ids, [markers + len(ROLES) + 1]]).astype(np.int32) for r, ids in turns]
    first = next((i for i, (r, _) in enumerate(turns) if r == "system"), None)
    head = [] if first is None else [marked[first]]
    rest = [i for i in range(len(turns)) if i != first]
    if not rest:
        yield first, first, 0, len(marked[first]) > budget, marked[first], []
        return
    held = sum(map(len, head))
    for start, new, end in spans(np.array([len(marked[i]) for i in rest]), held, budget, history):
        parts, at, targets = list(head), held, []
        for k in range(start, end):
            i = rest[k]
            if k >= new and turns[i][0] == "assistant":
                targets.append({"start": at + 1, "end": at + len(marked[i])})
            parts.append(marked[i])
            at += len(marked[i])
        yield rest[new], rest[end - 1], new - start, at > budget, np.concatenate(parts), targets


def chat_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, vocabulary: str = VOCABULARY, vocabulary_size: int = VOCABULARY_SIZE) -> DataFrame:
    """Markers have the ids from vocabulary_size on: one for each of ROLES, one for other roles, one for the end of a turn."""
    if not 0 <= history < budget:
        raise ValueError("history must be at least 0 and below the budget")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary)
        rows: list[tuple] = []
        conv, turns, last = None, [], None

        def close() -> None:
            if turns:
                for w, (a, b, n, over, tokens, targets) in enumerate(windows_of(turns, budget, history, vocabulary_size)):
                    rows.append((conv, w, a, b, n, len(tokens), over, tokens, targets))

        def take() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            offsets = np.cumsum([0, *map(len, columns[7])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(columns[7])))
            return pa.RecordBatch.from_arrays([*(pa.array(columns[i], _WINDOWS.field(i).type) for i in range(7)), lists, pa.array(columns[8], _TARGETS)], schema=_WINDOWS)

        for batch in batches:
            ids, offsets = t.encode(batch.column("text"))
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")]
            for k, key in enumerate(zip(*columns)):
                if key[0] != conv:
                    close()
                    conv, turns, last = key[0], [], None
                    if len(rows) >= ROWS:
                        yield take()
                if key != last:
                    turns.append((key[2], ids[offsets[k] : offsets[k + 1]]))
                    last = key
        close()
        if rows:
            yield take()

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").filter("conv_id IS NOT NULL")
    order = [F.col("conv_id"), *(F.col(c).asc_nulls_last() for c in ("turn", "role", "text"))]
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, WINDOWS)


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_windows(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op6_chat_windows": op6_chat_windows}
SQL: dict[str, str] = {}
