"""The query language: words, "phrases", AND, OR, NOT, -x, stem*, gl?b*, term~k, key:value, size and modified."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

from ..functions.text import normalize_word, words_of


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Term:
    term: str


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Prefix:
    stem: str


@dataclass(frozen=True)
class Wildcard:
    pattern: str


@dataclass(frozen=True)
class Fuzzy:
    term: str
    distance: int


@dataclass(frozen=True)
class Filter:
    """kind: ext, path, name, site, lang, author, entity; date, size, modified with op."""

    kind: str
    value: str | int
    op: str = "="


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


Node = Term | Phrase | Prefix | Wildcard | Fuzzy | Filter | And | Or | Not
_WORD = re.compile(r'[^\s"]+')
_KINDS = {"ext": "ext", "filetype": "ext", "path": "path", "inurl": "path", "name": "name", "intitle": "name", "site": "site", "lang": "lang", "author": "author", "@person": "entity", "@org": "entity", "@entity": "entity"}
_SIZES = {"": 1, "B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30}
_TIMES = {"s": 1, "m": 60, "h": 3600, "": 86400, "d": 86400, "w": 604800}


def lex(text: str) -> list[tuple]:
    """(kind, values...) for each of: and, or, not, phrase, compare, filter, fuzzy, word."""
    out: list[tuple] = []
    i, n = 0, len(text)
    while i < n:
        if text[i].isspace():
            i += 1
        elif text[i] == '"':
            end = text.find('"', i + 1)
            end = n if end < 0 else end
            out.append(("phrase", text[i + 1 : end]))
            i = end + 1
        elif text[i] == "-" and i + 1 < n and not text[i + 1].isspace():
            out.append(("not",))
            i += 1
        else:
            m = _WORD.match(text, i)
            out.append(_classify(m.group()))
            i = m.end()
    return out


def _classify(raw: str) -> tuple:
    if raw.upper() in ("AND", "OR", "NOT"):
        return (raw.lower(),)
    m = re.match(r"([^<>]+)([<>])(.+)", raw, re.S)
    if m:
        return ("compare", *m.groups())
    key, colon, value = raw.partition(":")
    if colon and key and value:
        return ("filter", key, value)
    term, tilde, distance = raw.partition("~")
    if tilde and term:
        return ("fuzzy", term, int(distance) if re.fullmatch(r"\+?[0-9]+", distance) else None)
    return ("word", raw)


def parse(text: str) -> Node:
    tokens = lex(text)
    if not tokens:
        raise QueryError("empty query")
    node, at = _either(tokens, 0)
    if at < len(tokens):
        raise QueryError(f"unexpected {tokens[at][0]}")
    return node


def _either(tokens: list[tuple], at: int) -> tuple[Node, int]:
    node, at = _all(tokens, at)
    parts = [node]
    while at < len(tokens) and tokens[at][0] == "or":
        node, at = _all(tokens, at + 1)
        parts.append(node)
    return (parts[0] if len(parts) == 1 else Or(tuple(parts))), at


def _all(tokens: list[tuple], at: int) -> tuple[Node, int]:
    node, at = _one(tokens, at)
    parts = [node]
    while at < len(tokens) and tokens[at][0] != "or":
        node, at = _one(tokens, at + (tokens[at][0] == "and"))
        parts.append(node)
    return (parts[0] if len(parts) == 1 else And(tuple(parts))), at


def _one(tokens: list[tuple], at: int) -> tuple[Node, int]:
    if at >= len(tokens):
        raise QueryError("a term is missing")
    kind, *values = tokens[at]
    if kind == "not":
        node, at = _one(tokens, at + 1)
        return Not(node), at
    if kind == "word":
        return _word(values[0]), at + 1
    if kind == "phrase":
        return Phrase(tuple(w for w, _, _ in words_of(normalize_word(values[0])))), at + 1
    if kind == "fuzzy":
        return Fuzzy(normalize_word(values[0]), 2 if values[1] is None else values[1]), at + 1
    if kind == "filter":
        return build_filter(*values), at + 1
    if kind == "compare":
        return _compare(*values), at + 1
    raise QueryError(f"unexpected {kind}")


def _word(raw: str) -> Node:
    word = normalize_word(raw)
    if "*" not in word and "?" not in word:
        return Term(word)
    stem = word[:-1]
    return Prefix(stem) if word[-1] == "*" and "*" not in stem and "?" not in stem else Wildcard(word)


def build_filter(key: str, value: str) -> Filter:
    name = key.lower()
    if name in ("before", "after"):
        return Filter("date", parse_date(value), "<" if name == "before" else ">")
    kind = _KINDS.get(name)
    if kind is None:
        raise QueryError(f"unknown filter {key}")
    if kind == "ext":
        return Filter(kind, value.lstrip(".").lower())
    if kind == "site":
        site = value.lower()
        while site.startswith("www."):
            site = site[4:]
        return Filter(kind, site)
    return Filter(kind, value.lower() if kind in ("lang", "entity") else normalize_word(value))


def _compare(key: str, op: str, value: str) -> Filter:
    if key.lower() == "size":
        return Filter("size", parse_size(value), op)
    if key.lower() == "modified":
        return Filter("modified", parse_duration(value), op)
    raise QueryError(f"unknown filter {key}")


def _measure(value: str, units: dict[str, int], fold) -> int:
    m = re.fullmatch(r"([0-9.]*)(.*)", value.strip(), re.S)
    try:
        return int(float(m.group(1)) * units[fold(m.group(2))])
    except (ValueError, KeyError):
        raise QueryError(f"not a measure: {value}") from None


def parse_size(value: str) -> int:
    return _measure(value, _SIZES, str.upper)


def parse_duration(value: str) -> int:
    """Seconds; a bare number is days."""
    return _measure(value, _TIMES, str.lower)


def parse_date(value: str) -> int:
    """Midnight UTC of a day, month or year as Unix seconds."""
    for form in ("%Y-%m-%d", "%Y-%m", "%Y"):
        try:
            return int(datetime.strptime(value.strip(), form).replace(tzinfo=timezone.utc).timestamp())
        except ValueError:
            continue
    raise QueryError(f"not a date: {value}")


def terms_of(node: Node) -> list[str]:
    """Literal terms, in order: those of words, phrases, patterns and fuzzy words that aren't below NOT."""
    if isinstance(node, (And, Or)):
        return list(dict.fromkeys(t for p in node.parts for t in terms_of(p)))
    if isinstance(node, Phrase):
        return list(dict.fromkeys(node.terms))
    return [t for t in [getattr(node, "term", None) or getattr(node, "stem", None) or getattr(node, "pattern", None)] if t]


def has_text(node: Node) -> bool:
    """Whether anything but filters is asked for."""
    if isinstance(node, (And, Or)):
        return any(map(has_text, node.parts))
    return has_text(node.part) if isinstance(node, Not) else not isinstance(node, Filter)


def with_ui_filters(node: Node, filetype: str | None = None, site: str | None = None, age: str | None = None) -> Node:
    """The node and the page's filters: a file type, a site, an age of h, d, w, m or y."""
    extra = [build_filter(k, v) for k, v in (("ext", filetype), ("site", site)) if v]
    ages = {"h": 3600, "d": 86400, "w": 604800, "m": 30 * 86400, "y": 365 * 86400}
    if age in ages:
        extra.append(Filter("modified", ages[age], "<"))
    return And((node, *extra)) if extra else node


MODES = {"local": "local", "fs": "local", "pc": "local", "filesystem": "local", "web": "web", "both": "both", "hybrid": "both", "tor": "tor", "onion": "tor"}


def mode_of(name: str | None) -> str:
    return MODES.get((name or "").lower(), "web")
