"""Instant answers, bangs, claim checks, grounded summaries and answering from sources."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_UNITS = {
    "length": {"m": 1.0, "mm": 0.001, "cm": 0.01, "km": 1000.0, "in inch inches": 0.0254, "ft feet foot": 0.3048, "yd yard": 0.9144, "mi mile miles": 1609.344},
    "mass": {"g": 1.0, "mg": 0.001, "kg": 1000.0, "oz ounce": 28.349523125, "lb lbs pound pounds": 453.59237},
    "volume": {"l liter liters": 1.0, "ml": 0.001, "gal gallon gallons": 3.785411784, "cup cups": 0.2365882365},
    "temperature": {"c celsius": 0.0, "f fahrenheit": 0.0, "k kelvin": 0.0},
}
UNITS = {name: (family, factor) for family, names in _UNITS.items() for all_, factor in names.items() for name in all_.split()}


class _Sum:
    """A recursive-descent reader of sums. A power binds more loosely than a sign, and to the right."""

    def __init__(self, text: str) -> None:
        self.items = re.findall(r"[0-9.]+|[-+*/^()]", text)
        self.at = 0

    def peek(self) -> str:
        return self.items[self.at] if self.at < len(self.items) else ""

    def take(self) -> str:
        self.at += 1
        return self.items[self.at - 1]

    def value(self) -> float:
        out = self.total()
        if self.peek():
            raise ValueError("left over")
        return out

    def total(self) -> float:
        out = self.product()
        while self.peek() in ("+", "-"):
            out = out + self.product() if self.take() == "+" else out - self.product()
        return out

    def product(self) -> float:
        out = self.power()
        while self.peek() in ("*", "/"):
            out = out * self.power() if self.take() == "*" else out / self.power()
        return out

    def power(self) -> float:
        out = self.signed()
        if self.peek() == "^":
            self.take()
            out = out ** self.power()
        return out

    def signed(self) -> float:
        if self.peek() == "-":
            self.take()
            return -self.signed()
        if self.peek() == "(":
            self.take()
            out = self.total()
            if self.peek() != ")":
                raise ValueError("unclosed")
            self.take()
            return out
        return float(self.take() if self.peek() else "")


def calculate(query: str) -> float | None:
    q = query.strip()
    if not re.fullmatch(r"[0-9+\-*/^(). ]+", q) or not re.search(r"[+\-*/^]", q) or not re.search(r"[0-9]", q):
        return None
    try:
        out = _Sum(q).value()
    except (ValueError, ZeroDivisionError, OverflowError, RecursionError):
        return None
    return None if isinstance(out, complex) else out


def _degrees(x: float, a: str, b: str) -> float:
    celsius = {"c": x, "f": (x - 32) * 5 / 9, "k": x - 273.15}[a[0]]
    return {"c": celsius, "f": celsius * 9 / 5 + 32, "k": celsius + 273.15}[b[0]]


def convert(query: str) -> tuple[float, str, str, float] | None:
    """(amount, from, to, result) of queries such as `10 km to miles`."""
    parts = query.lower().replace(" to ", " ").replace("convert ", "").split()
    if len(parts) != 3 or parts[1] not in UNITS or parts[2] not in UNITS:
        return None
    try:
        amount = float(parts[0])
    except ValueError:
        return None
    (fa, x), (fb, y) = UNITS[parts[1]], UNITS[parts[2]]
    if fa != fb:
        return None
    result = _degrees(amount, parts[1], parts[2]) if fa == "temperature" else amount * x / y
    return amount, parts[1], parts[2], round(result, 4)


def answer(query: str) -> str | None:
    c = convert(query)
    if c:
        return f"{c[0]:g} {c[1]} = {c[3]:g} {c[2]}"
    v = calculate(query)
    return None if v is None else f"{query.strip()} = {v:g}"


def conversions(amounts: DataFrame) -> DataFrame:
    """amounts (amount, from_unit, to_unit) with result, null between families: two joins with a table of units."""
    spark = amounts.sparkSession
    units = spark.createDataFrame([(n, f, float(x)) for n, (f, x) in UNITS.items()], "unit string, family string, factor double")  # as many rows as units
    a = F.broadcast(units.select(F.col("unit").alias("_a"), F.col("family").alias("_fa"), F.col("factor").alias("_xa")))
    b = F.broadcast(units.select(F.col("unit").alias("_b"), F.col("family").alias("_fb"), F.col("factor").alias("_xb")))
    x = F.col("amount")
    first, last = F.substring("from_unit", 1, 1), F.substring("to_unit", 1, 1)
    celsius = F.when(F.lower(first) == "f", (x - 32) * 5 / 9).when(F.lower(first) == "k", x - 273.15).otherwise(x)
    degrees = F.when(F.lower(last) == "f", celsius * 9 / 5 + 32).when(F.lower(last) == "k", celsius + 273.15).otherwise(celsius)
    out = amounts.join(a, F.lower("from_unit") == F.col("_a"), "left").join(b, F.lower("to_unit") == F.col("_b"), "left")
    result = F.when(F.col("_fa") != F.col("_fb"), None).when(F.col("_fa") == "temperature", degrees).otherwise(x * F.col("_xa") / F.col("_xb"))
    return out.select(*[F.col(c) for c in amounts.columns], F.round(result, 4).alias("result"))


BANGS = {
    "wa": "https://www.wolframalpha.com/input?i={}", "arxiv": "https://arxiv.org/abs/{}", "img": "https://www.google.com/search?tbm=isch&q={}", "maps": "https://www.google.com/maps/search/{}",
    "az": "https://www.amazon.com/s?k={}", "tw": "https://twitter.com/search?q={}", "mdn": "https://developer.mozilla.org/en-US/search?q={}", "docsrs": "https://docs.rs/releases/search?query={}",
    "crates": "https://crates.io/search?q={}", "npm": "https://www.npmjs.com/search?q={}", "r": "https://www.reddit.com/search/?q={}", "so": "https://stackoverflow.com/search?q={}",
    "gh": "https://github.com/search?q={}", "yt": "https://www.youtube.com/results?search_query={}", "w": "https://en.wikipedia.org/wiki/Special:Search?search={}",
    "b": "https://www.bing.com/search?q={}", "ddg": "https://duckduckgo.com/?q={}", "g": "https://www.google.com/search?q={}",
}


def bang(query: str, custom: dict[str, str] | None = None) -> str | None:
    """The address that the first known !word anywhere in the query leads to."""
    table = BANGS | {k.lower(): v for k, v in (custom or {}).items()}
    words = query.split()
    for i, w in enumerate(words):
        if w[0] == "!" and w[1:].lower() in table:
            return table[w[1:].lower()].replace("{}", quote(" ".join(words[:i] + words[i + 1 :]), safe=""))
    return None


NEGATIONS = tuple(sorted("not no never neither without isn't wasn't didn't doesn't".split()))
SUPPORTED, CONFLICT = 0.35, 0.5


def _significant(t: Column) -> Column:
    """Distinct words of a normalised text but for stop words and single bytes."""
    return F.array_distinct(F.filter(T.words_in(t), lambda w: ~T.is_stop_word(w) & (F.octet_length(w) > 1)))


def _numbers(t: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(t, r"[^0-9.]+"), lambda x: F.regexp_replace(x, r"^\.+|\.+$", "")), lambda x: x.rlike("[0-9]")))


def _negated(t: Column, others: Column) -> Column:
    """Whether a clause of a normalised text has a negation and a term of the others."""

    def words(clause: Column) -> Column:
        return F.transform(F.split(clause, r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}']+|[^\p{L}\p{N}']+$", ""))

    return F.exists(F.split(t, "[,.;:]"), lambda c: F.arrays_overlap(words(c), F.array(*map(F.lit, NEGATIONS))) & F.arrays_overlap(_significant(c), others))


def verify(pairs: DataFrame) -> DataFrame:
    """pairs (claim, span) with verdict (supported, unsupported, indeterminate) and overlap."""
    out = pairs.withColumns({"_tc": T.normalize(F.col("claim")), "_ts": T.normalize(F.col("span"))})
    out = out.withColumns({"_c": _significant(F.col("_tc")), "_s": _significant(F.col("_ts")), "_nc": _numbers(F.col("claim")), "_ns": _numbers(F.col("span"))})
    empty = (F.trim(F.coalesce("claim", F.lit(""))) == "") | (F.trim(F.coalesce("span", F.lit(""))) == "") | (F.size("_c") == 0)
    overlap = F.size(F.array_intersect("_c", "_s")) / F.size("_c")
    out = out.withColumn("overlap", F.when(empty, 0.0).otherwise(overlap))
    numeric = (F.size("_nc") > 0) & (F.size("_ns") > 0) & ~F.arrays_overlap("_nc", "_ns")
    negation = (_negated(F.col("_tc"), F.col("_s")) != _negated(F.col("_ts"), F.col("_c"))) & (F.col("overlap") > CONFLICT)
    verdict = F.when(empty, "indeterminate").when(numeric | negation | (F.col("overlap") < SUPPORTED), "unsupported").otherwise("supported")
    return out.withColumn("verdict", verdict).drop("_tc", "_ts", "_c", "_s", "_nc", "_ns")


def grounding_rate(verified: DataFrame) -> DataFrame:
    return verified.agg(F.coalesce(F.try_divide(F.count(F.when(F.col("verdict") == "supported", 1)), F.count(F.lit(1))), F.lit(1.0)).alias("grounding_rate"))


_END = re.compile(r"[.!?](?: *\[[0-9]+\])*")


def sentences(text: str) -> list[str]:
    """Sentences with the citations that follow their end."""
    out, at = [], 0
    for m in _END.finditer(text):
        out.append(text[at : m.end()].strip())
        at = m.end()
    return [s for s in [*out, text[at:].strip()] if s]


def grounded(text: str, valid: set[int]) -> tuple[str, list[int], int]:
    """(the sentences that cite a valid source, sources in order of first citation, sentences dropped)."""
    kept, cited, dropped = [], [], 0
    for s in sentences(text):
        ids = [int(x) for x in re.findall(r"\[([0-9]+)\]", s) if int(x) in valid]
        if ids:
            kept.append(s)
            cited += [i for i in dict.fromkeys(ids) if i not in cited]
        else:
            dropped += 1
    return " ".join(kept), cited, dropped


def permutation(reply: str, n: int) -> list[int] | None:
    """The order that a reply names, if it names 1..n once each."""
    found = [int(x) for x in re.findall(r"[0-9]+", reply)]
    return found if sorted(found) == list(range(1, n + 1)) else None


def rerank(rows: list, model: Callable[[str, str], str], query: str, text: Callable[[object], str]) -> list:
    """rows in the order the model names; as they are when its reply is no order of all."""
    listed = "\n".join(f"[{i}] {text(r)}" for i, r in enumerate(rows, 1))
    order = permutation(model("Order the passages by relevance. Reply with their numbers only.", f"{query}\n\n{listed}"), len(rows))
    return [rows[i - 1] for i in order] if order else rows


def ask(found: DataFrame, query: str, model: Callable[[str, str], str], top: int = 20, sources: int = 5) -> tuple[str, list[int], int]:
    """An answer from the best results (a page with content): reranked, summarised by the model from their whole texts and rid of sentences without a source. The model is a callable of two
    prompts and may shorten them to what it reads."""
    rows = rerank(found.select("doc_id", "file_name", F.col("content").alias("text")).limit(top).collect(), model, query, lambda r: f"{r.file_name}: {r.text}")[:sources]
    listed = "\n".join(f"[{i}] {r.text}" for i, r in enumerate(rows, 1))
    return grounded(model("Answer from the sources only and cite them as [n].", f"{query}\n\n{listed}"), set(range(1, len(rows) + 1)))
