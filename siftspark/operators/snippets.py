"""Snippets of results; done after the page is cut, so few rows reach Python."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_word, words_of

CONTEXT = 60


def snippet(content: str, terms: set[str]) -> tuple[str, int]:
    """(text, matches): the neighbourhood, in bytes, of the first match that has most distinct terms around it."""
    text = normalize_word(content)
    hits = [w for w in words_of(text) if w[0] in terms]
    if not hits:
        return text[: 2 * CONTEXT], 0
    best, most, low, high = hits[0], 0, 0, 0
    inside: dict[str, int] = {}
    for h in hits:  # two pointers over hits in order
        while high < len(hits) and hits[high][2] <= h[2] + CONTEXT:
            inside[hits[high][0]] = inside.get(hits[high][0], 0) + 1
            high += 1
        while hits[low][1] < max(0, h[1] - CONTEXT):
            inside[hits[low][0]] -= 1
            if not inside[hits[low][0]]:
                del inside[hits[low][0]]
            low += 1
        if len(inside) > most:
            best, most = h, len(inside)
    raw = text.encode()
    start, end = max(0, best[1] - CONTEXT), min(len(raw), best[2] + CONTEXT)
    while start > 0 and raw[start] & 0xC0 == 0x80:
        start -= 1
    while end < len(raw) and raw[end] & 0xC0 == 0x80:
        end += 1
    out, at = [], start
    for _, a, b in hits:
        if a >= at and b <= end:
            out += [raw[at:a], b"**", raw[a:b], b"**"]
            at = b
    out.append(raw[at:end])
    return ("..." if start else "") + b"".join(out).decode() + "...", len(hits)


def with_snippets(page: DataFrame, terms: list[str], content: str = "content") -> DataFrame:
    wanted = set(terms)

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([snippet(t or "", wanted) for t in texts], columns=["text", "matches"])

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    found = page.withColumn("_s", F.pandas_udf(run, "text string, matches int")(F.col(content)))
    return found.withColumns({"snippet": F.col("_s.text"), "matches": F.col("_s.matches")}).drop("_s")
