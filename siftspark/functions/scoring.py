"""Ranking formulas as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LIFE_SECONDS = 30 * 86400.0


def idf(df: Column, n: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25(tf: Column, df: Column, n: Column, length: Column, average: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """One term's part; 0 where tf or df is."""
    norm = 1 - b + b * F.greatest(length, F.lit(1)) / F.greatest(average, F.lit(1.0))
    return F.when((tf <= 0) | (df <= 0), 0.0).otherwise(idf(df, n) * tf * (k1 + 1) / (tf + k1 * norm))


def tf_idf(count: Column, df: Column, n: Column) -> Column:
    return count * (F.log(n / (df + 1)) + 1)


def recency(modified: Column, now: Column, most: float) -> Column:
    return 1 + (most - 1) * F.pow(F.lit(0.5), F.greatest(now - modified, F.lit(0)) / HALF_LIFE_SECONDS)


def query_weight(df: Column, n: Column) -> Column:
    return F.greatest(F.lit(0.1), F.log(n / F.greatest(df, F.lit(1))) + 1)


def human_bytes(size: Column, decimals: int = 2) -> Column:
    """Binary steps, halves to the even digit; whole bytes without decimals."""
    s = size.cast("double")
    out = F.format_string("%d B", size.cast("bigint"))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(s >= 1024.0**i, F.format_string(f"%.{decimals}f {unit}", F.bround(s / 1024.0**i, decimals))).otherwise(out)
    return out


def source_kind(is_web: Column, extension: Column) -> Column:
    return F.when(is_web, "web_page").when(extension == "pdf", "pdf").when(extension.isin("eml", "mbox"), "email").when(extension == "zip", "archive").otherwise("local_file")


def visible(acl: Column, principal: str | None, groups: list[str]) -> Column:
    """Whether a caller may see a row; nobody may unless the row says so."""
    out = F.coalesce(acl["public"], F.lit(False))
    if principal is not None:
        out = out | F.coalesce(acl["owner"] == principal, F.lit(False)) | F.coalesce(F.array_contains(acl["allowed_principals"], principal), F.lit(False))
    if groups:
        out = out | F.coalesce(F.arrays_overlap(acl["allowed_groups"], F.array(*map(F.lit, groups))), F.lit(False))
    return out
