"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, address schemes, identifier cues and digits. A deterministic parser for the kind of
anchor expands to the left and right as far as its grammar allows and validates what it found; the first valid span at a place wins and later
anchors inside it are passed over. Kinds:

email    local@host, local part of RFC 5322 atoms, host of at least two labels, last one alphabetic or in its xn-- form; ASCII hosts first, else hosts of any letters
address  scheme://host..., or an IPv4 address of four numbers up to 255
phone    an international number: + and 8 to 15 digits with single separators or brackets
account  13 to 19 digits in one run; the longest of groups of 4-4-4-4-3, 4-4-4-4, 4-6-5 or 4-6-4 digits whose check digit holds; an IBAN by its check digits; ddd-dd-dddd; or a value of at least 6 letters and digits, one
         of them a digit, after a cue such as `account no.` or `account number is`
secret   a value of at least 16 letters and digits, one of each, after a cue such as `token =`

Defined results: a null text stays null, without spans; an empty one stays empty; a very long one is read whole, each anchor in time bounded by its grammar or its own span;
offsets count characters of the given text; of spans that overlap the first stays, or takes the later one in; repeated rows are
done each by itself; an empty table gives no rows; only doc_id and text are looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "mailto:")
ACCOUNT_CUES = ("account", "acct", "iban", "ssn", "passport", "customer no", "customer id", "member id", "konto", "compte", "cuenta")
SECRET_CUES = ("token", "api key", "api_key", "apikey", "secret", "password", "passwd", "bearer")
DIGITS = "0123456789"
_ATOM = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.!#$%&'*+/=?^_`{|}~-")
_EDGE = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_+-")
_HOST = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.-")
_CUE_WORDS = re.compile(r"(?:(?:number|no|id|is|was)\b\.?[ :=#\"']*){1,3}", re.I | re.A)
_VALUE = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-")
_SPACE_END = frozenset(" \t\n\r\f\v\"'<>`")
#: Most characters of a local part, a host and a cue's gap before its value, by the standards or the grammar here.
LOCAL, HOST_LENGTH, GAP = 64, 253, 12
#: Card numbers in groups, the longest first.
_GROUPS = tuple(re.compile(" ".join(f"[0-9]{{{n}}}" for n in sizes) + "(?![0-9])") for sizes in ((4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4)))
OUT = "doc_id long, text string, spans array<struct<kind:string,start:int,end:int>>, n_spans int"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def automaton():
    """Anchors of a text in ASCII lower case."""
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    for kind, words in (("scheme", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    for d in DIGITS:
        a.add_word(d, ("digit", 1))
    a.make_automaton()
    return a


def folded(text: str) -> str:
    """ASCII lower case, which leaves all offsets as they are: bytes.lower() knows no other letters."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _host(text: str, start: int) -> int:
    """End of a valid host name that begins at start, or start. Names of ASCII letters first; else those of any letters."""
    end = _host_of(text, start, False)
    return end if end > start else _host_of(text, start, True)


def _host_of(text: str, start: int, wide: bool) -> int:
    n, end = len(text), start
    while end < n and (text[end] in _HOST or (wide and text[end].isalnum())) and end - start <= HOST_LENGTH:
        end += 1
    while end > start and text[end - 1] in ".-":
        end -= 1
    labels = text[start:end].split(".")
    while len(labels) >= 2 and not (len(labels[-1]) >= 2 and (labels[-1].isalpha() and (wide or labels[-1].isascii()) or labels[-1][:4].lower() == "xn--" and len(labels[-1]) > 4)):
        labels.pop()  # the last label of a name is alphabetic, or its ASCII form
    if len(labels) < 2 or any(not x or len(x) > 63 or x[0] == "-" or x[-1] == "-" for x in labels):
        return start
    return start + len(".".join(labels))


def email(text: str, at: int) -> tuple[int, int] | None:
    end = _host(text, at + 1)
    if end == at + 1:
        return None
    start = at
    while start > 0 and at - start < LOCAL and text[start - 1] in _ATOM:
        start -= 1
    while start < at and text[start] not in _EDGE:
        start += 1
    local = text[start:at]
    if ".." in local:
        start += local.rindex("..") + 2
        local = text[start:at]
    return (start, end) if local and local[-1] != "." else None


def web_address(text: str, start: int, end: int) -> tuple[int, int] | None:
    n, host = len(text), end
    while end < n and text[end] not in _SPACE_END:
        end += 1
    while end > host and text[end - 1] in ".,;:!?)]}$%&*#|":
        end -= 1
    name = text[host:end].split("/", 1)[0].rsplit("@", 1)[-1].split(":", 1)[0]
    return (start, end) if len(name) >= 3 and ("." in name or name == "localhost") else None


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def number(text: str, at: int) -> tuple[str, int, int, int]:
    """(kind or "", start, end, where looking goes on) of the number whose first digit is at `at`."""
    n, end = len(text), at
    while end < n and (text[end] in DIGITS or (text[end] in ".-" and end + 1 < n and text[end + 1] in DIGITS)):
        end += 1
    raw = text[at:end]
    before = text[at - 1] if at else " "
    after = text[end] if end < n else " "
    if before == "+" or before == "(":
        start, k, digits, last = at - 1, at, 0, at
        if before == "(" and at >= 2:
            j = at - 2
            while j >= 0 and text[j] in " +" + DIGITS and at - j < 8:
                if text[j] == "+":
                    start = j
                    break
                j -= 1
        if text[start] == "+":
            most = 11 if text[start + 1 : start + 2] == "1" else 15
            k, whole = start + 1, (0, at)  # digits and end of the last whole group within the most
            while k < n and (text[k] in DIGITS or text[k] in " .-()"):
                if text[k] in DIGITS:
                    digits += 1
                    last = k + 1
                    if digits > most:
                        break
                    if not text[k + 1 : k + 2].isdigit():
                        whole = (digits, last)
                elif k + 1 < n and text[k] in " .-" and text[k + 1] in " .-":
                    break
                k += 1
            if whole[0] >= 8:
                return "phone", start, whole[1], whole[1]
    parts = raw.split(".")
    if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts) and not (before.isalnum() or before == "."):
        return "address", at, end, end
    if not (before.isalnum() or after.isalnum() or before == "."):
        if len(raw) == 11 and raw[3] == raw[6] == "-" and raw.replace("-", "").isdigit():
            return "account", at, end, end
        digits = raw.replace("-", "")
        last = end
        if raw.isdigit() and len(raw) == 4:
            for layout in _GROUPS:
                m = layout.match(text, at)
                if m and _luhn(m.group().replace(" ", "")):
                    digits, last = m.group().replace(" ", ""), m.end()
                    break
        if digits.isdigit() and digits.isascii() and 13 <= len(digits) <= 19:
            return "account", at, last, last
    if after.isalnum() or before.isalnum():
        start = at
        while start > 0 and at - start < 2 and text[start - 1].isalpha() and text[start - 1].isascii():
            start -= 1
        if at - start == 2 and not text[start - 1 : start].isalnum():
            stop, kept = at, 2
            while stop < n and kept <= 34 and (text[stop].isalnum() and text[stop].isascii() or (text[stop] == " " and text[stop + 1 : stop + 2].isalnum() and (kept % 4 == 0))):
                kept += text[stop] != " "
                stop += 1
            for size in range(stop, at + 12, -1):
                value = text[start:size].replace(" ", "").upper()
                if 15 <= len(value) <= 34 and value.isascii() and value.isalnum() and not text[size : size + 1].isalnum() and text[size - 1] != " " and value[2:4].isdigit():
                    if int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1:
                        return "account", start, size, size
    return "", at, end, end


def cued(text: str, end: int, kind: str) -> tuple[int, int] | None:
    """The value after a cue that ends at `end`."""
    n, start, marks = len(text), end, 0
    if start < n and text[start].isalnum():
        return None
    while start < n and start - end <= GAP and not text[start].isalnum():
        if text[start] == "\n":
            return None
        marks += text[start] in ":=#"
        start += 1
    words = _CUE_WORDS.match(text, start)
    if words:
        marks += 1
        start = words.end()
    stop = start
    while stop < n and text[stop] in _VALUE:
        stop += 1
    value = text[start:stop].rstrip("-_")
    digits = sum(c in DIGITS for c in value)
    if kind == "secret":
        good = len(value) >= 16 and 0 < digits < len(value) and (marks or len(value) >= 20)
    else:
        good = digits >= 1 and sum(c not in "_-" for c in value) >= 6
    return (start, start + len(value)) if good else None


def find(text: str, anchors) -> list[tuple[str, int, int]]:
    found: list[tuple[str, int, int]] = []
    done = 0
    for last, (kind, size) in anchors.iter(folded(text)):
        start = last + 1 - size
        if start < done:
            continue
        if kind == "digit":
            kind, a, b, done = number(text, start)
            span = (a, b) if kind else None
        elif kind == "@":
            span, kind = email(text, start), "email"
        elif kind == "scheme":
            if text[start : last + 1].lower() == "mailto:":
                continue
            span, kind = web_address(text, start, last + 1), "address"
        else:
            span = cued(text, last + 1, kind)
        if span:
            while found and found[-1][2] > span[0]:
                span = (min(span[0], found.pop()[1]), span[1])
            found.append((kind, *span))
            done = max(done, span[1])
    return found


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in spans:
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans, n_spans): every row with each span replaced by its kind in angle brackets; spans lie in the given text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column("text").to_pylist()
                spans = [find(t, anchors) if t else [] for t in texts]
                clean = [redacted(t, s) if s else t for t, s in zip(texts, spans)]
                rows = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(clean, pa.string()), pa.array(rows, _SPANS), pa.array([len(s) for s in spans], pa.int32())], ["doc_id", "text", "spans", "n_spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)


def op5_pii_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_pii_anchor_expansion": op5_pii_anchor_expansion}
SQL: dict[str, str] = {}
