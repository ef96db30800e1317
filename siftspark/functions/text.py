"""Text functions as Spark columns: analysis, hashing, fingerprints, lexical vectors, chunks."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A word by the default Unicode word boundaries, once the letters of scripts without spaces stand apart.
WORD = r"[\p{L}\p{N}\p{M}_]+(?:(?:(?<=\p{L}\p{M}{0,4})[.'’:·](?=\p{L})|(?<=\p{N})[.,;'’](?=\p{N}))[\p{L}\p{N}\p{M}_]+)*"
#: Scripts whose letters are words by themselves: the default boundaries know no dictionary. A run of Katakana is one word.
APART = ("Han", "Hiragana", "Thai", "Lao", "Khmer", "Myanmar")
_APART = rf"(?:(?=\p{{L}})[{''.join(rf'\p{{Is{x}}}' for x in APART)}]\p{{M}}*|[\p{{IsKatakana}}ー][\p{{IsKatakana}}ー\p{{M}}]*)"
#: Where the scripts of APART are; the other pattern is slow.
_MAYBE_APART = r"[\x{e00}-\x{1fff}\x{2e80}-\x{10ffff}]"
STOP_WORDS = tuple(
    sorted(
        """your you with will were was very up too to this these they then them their those their the than that such so she same
        our own or only on of nor not no my just its it is into in if i his her he having have has had from for else down doing
        does do did can by but being been be at as are and an a we""".split()
    )
)
MAX_NEAR_BITS = 18
BUCKETS = 256
CHUNK_WORDS, CHUNK_OVERLAP, CHUNK_ABOVE = 300, 50, 300


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no built-in for it."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def _composed() -> str:
    """Ranges of a pattern's class: characters beyond ASCII of common scripts that NFKC leaves alone wherever they stand (no marks, no second halves of compositions)."""
    blocks = ((0xA1, 0x24F), (0x370, 0x6FF), (0x1E00, 0x1FFF), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF), (0x3001, 0x3098), (0x309B, 0x30FF))
    second = {int(d.split()[-1], 16) for c in range(0x3400) if (d := unicodedata.decomposition(chr(c))) and d[0] != "<"}
    known = [c for a, b in blocks for c in range(a, b + 1) if c not in second and not unicodedata.combining(chr(c)) and unicodedata.category(chr(c)) != "Cn" and unicodedata.normalize("NFKC", chr(c)) == chr(c)]
    ranges = [[c, c] for c in known[:1]]
    for c in known[1:]:
        if c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    # Unified ideographs and Hangul syllables are so as a whole.
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in [*ranges, (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)])


#: Letters of European languages are told first, as a long class is slow in Java.
_CHANGED_BY_NFKC = rf"[\x{{80}}-\x{{10ffff}}&&[^\x{{c0}}-\x{{131}}\x{{2013}}-\x{{2014}}\x{{2018}}-\x{{201e}}]&&[^{_composed()}]]"


def is_composed(text: Column) -> Column:
    """Whether NFKC surely leaves a text as it is: told without Python. False says nothing."""
    return _is_ascii(text) | ~text.rlike(_CHANGED_BY_NFKC)


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def normalize(text: Column) -> Column:
    """NFKC and lower case. Only texts beyond ASCII leave the JVM for it."""
    return F.lower(F.when(_is_ascii(text), text).otherwise(nfkc(F.when(~_is_ascii(text), text))))


def normalize_word(word: str) -> str:
    return unicodedata.normalize("NFKC", word).lower()


def runs_in(t: Column) -> Column:
    """What words_in() gives, and runs of marks and low lines."""
    t = F.when(_is_ascii(t) | ~t.rlike(_MAYBE_APART), t).otherwise(F.regexp_replace(t, _APART, " $0 "))
    return F.regexp_extract_all(t, F.lit(WORD), F.lit(0))


def words_in(t: Column) -> Column:
    """All words of a normalised text in order; without Python, so it may stand in a lambda."""
    return F.filter(runs_in(t), lambda w: w.rlike(r"[\p{L}\p{N}]"))


def is_word(run: str) -> bool:
    """Whether a run has a letter or digit."""
    return run.isalnum() or any(c != "_" and unicodedata.category(c)[0] in "LN" for c in run)


def tokens(text: Column) -> Column:
    """All words in order, stop words included; null for null."""
    return words_in(normalize(text))


_PY_WORD = None


def words_of(text: str) -> list[tuple[str, int, int]]:
    """(word, first byte, end byte) of a normalised text, in plain Python: for phrases of a query and for snippets."""
    global _PY_WORD
    if _PY_WORD is None:
        import regex

        plain = WORD.replace(r"(?<=\p{L}\p{M}{0,4})", r"(?<=\p{L}\p{M}*)")
        _PY_WORD = (regex.compile(plain), regex.compile(r"[\p{L}\p{N}]"), regex.compile(_APART))
    word, good, apart = _PY_WORD
    out, at, byte = [], 0, 0
    spans, last = [], 0
    for m in [] if text.isascii() else apart.finditer(text):
        spans += [(last, m.start()), m.span()]
        last = m.end()
    for a, b in [*spans, (last, len(text))]:
        for m in word.finditer(text[a:b]):
            if good.search(m.group()):
                byte += len(text[at : a + m.start()].encode())
                at = a + m.start()
                out.append((m.group(), byte, byte + len(m.group().encode())))
    return out


def bound(x: Column, f) -> Column:
    """f(x) with x computed once: as a lambda variable it isn't copied into the places that use it, nor into loops over arrays."""
    return F.transform(F.array(x), lambda v: f(v))[0]


def is_stop_word(word: Column) -> Column:
    return word.isin(*STOP_WORDS)


def analyzed(docs: DataFrame, text: str = "content", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., term, position): kept words at their places among all words."""
    return docs.select(*keep, F.posexplode(tokens(F.col(text))).alias("position", "term")).filter(~is_stop_word(F.col("term")))


def kept_tokens(words: Column) -> Column:
    """How many of these words aren't stop words."""
    return F.size(F.filter(words, lambda w: ~is_stop_word(w)))


def wildcard_pattern(pattern: str) -> str:
    """An anchored regular expression for * (any run) and ? (one character)."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def exact_hash(text: Column) -> Column:
    return F.md5(F.lower(text))


def shingles(words: Column, size: int = 5) -> Column:
    """Windows of `size` words, joined by a character that no word has; shorter texts are one shingle, empty ones none."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, size), "\u0001"))
    return F.when(n <= 0, F.array().cast("array<string>")).when(n <= size, F.array(F.array_join(words, "\u0001"))).otherwise(many)


def hash32(text: Column, at: int = 1) -> Column:
    """32 bits of the MD5 of a text, from its hexadecimal digit `at` on: portable to any SQL engine."""
    return F.conv(F.substring(F.md5(text), at, 8), 16, 10).cast("bigint")


def simhash(docs: DataFrame, text: str = "content", key: str = "doc_id", size: int = 5) -> DataFrame:
    """(key, hi, lo): 32 bits each of the fingerprint of the shingles of all words, set where more shingles' MD5 have the bit than not; 0 for no words."""
    from . import batch

    return batch.over_words(docs, F.col(text), [key], "hi bigint, lo bigint", batch.fingerprint_arrays(size))


def hamming(hi_a: Column, lo_a: Column, hi_b: Column, lo_b: Column) -> Column:
    return F.bit_count(hi_a.bitwiseXOR(hi_b)) + F.bit_count(lo_a.bitwiseXOR(lo_b))


def similarity(distance: Column) -> Column:
    return 1 - distance / F.lit(64.0)


def bucket(term: Column) -> Column:
    return (hash32(term) % BUCKETS).cast("int")


def sign(term: Column) -> Column:
    return F.when(F.conv(F.substring(F.md5(term), 9, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)


def embed(rows: DataFrame, key: str, term: str = "term", weight: Column | None = None) -> DataFrame:
    """(key, bucket, w): sparse unit vectors by the signed hashing trick from rows (key, term), for weighted terms such as a query's. Vectors of norm up to 1e-8 have no rows."""
    summed = rows.groupBy(key, bucket(F.col(term)).alias("bucket")).agg(F.sum(sign(F.col(term)) * (F.lit(1.0) if weight is None else weight)).alias("w"))
    norms = summed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm")).filter("_norm > 1e-8")
    return summed.join(norms, key).filter("w <> 0").select(key, "bucket", (F.col("w") / F.col("_norm")).alias("w"))


def lexical_vectors(docs: DataFrame, text: str = "content", keys: tuple[str, ...] = ("doc_id",), nest: bool = False) -> DataFrame:
    """(keys, bucket, w): sparse unit vectors of all words of each text, made within its row; with nest, as a row (keys, buckets, weights)."""
    from . import batch

    rows = batch.over_words(docs, F.col(text), list(keys), "buckets array<int>, weights array<double>", batch.vector_arrays)
    return rows if nest else vector_rows(rows, keys)


def vector_rows(rows: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, bucket, w) of rows with arrays buckets and weights."""
    return rows.select(*keys, F.explode(F.arrays_zip("buckets", "weights")).alias("_v")).select(*keys, F.col("_v.buckets").alias("bucket"), F.col("_v.weights").alias("w"))


def chunk_rows(docs: DataFrame, text: str = "content", key: str = "doc_id", words: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(key, chunk_index, chunk): windows of whitespace words; the chunk that reaches the end is the last."""
    step = max(words - overlap, 1)
    parts = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    n = F.size("_w")
    last = F.greatest(F.ceil((n - words) / F.lit(float(step))), F.lit(0)).cast("int")
    return (
        docs.select(key, parts.alias("_w"))
        .filter(F.size("_w") > 0)
        .select(key, "_w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
        .select(key, "chunk_index", F.array_join(F.slice("_w", F.col("chunk_index") * step + 1, words), " ").alias("chunk"))
    )


def chunk_offsets(text: str, words: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> list[tuple[int, int, int]]:
    """(chunk, first byte, end byte) in plain Python."""
    spans = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    out, start, step = [], 0, max(words - overlap, 1)
    while start < len(spans):
        end = min(start + words, len(spans))
        a, b = spans[start][0], spans[end - 1][1]
        out.append((len(out), len(text[:a].encode()), len(text[:b].encode())))
        if end == len(spans):
            break
        start += step
    return out
