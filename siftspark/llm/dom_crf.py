"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A block is the text between two block-level tags. Its features are its ancestor tags, hashed class and id names of its ancestors, and measures of the text
(words, share in links, final mark, place in the page). The field has two labels, boilerplate and content, weights for each feature and label, and for each
two neighbouring labels; it is trained by full-batch ascent on the L2-regularised log-likelihood and decoded by Viterbi.

Labelled pages are those whose markup has `article` or `main`: blocks inside (outside nested nav, aside, header, footer and form) are content. These
tags are not features, so that pages without them are read alike. At most `max_pages` labelled pages are learned from, those of the lowest hash of page_id
and of no more than `max_tags` tags; extraction covers every page and every block, in time linear in the page's length at any depth.

Defined results: a null html gives a null text and no blocks; an html without text gives an empty text; labels of equal scores give boilerplate; without labelled pages every block is content;
unclosed tags end with their parent, an unclosed head with the first thing that belongs to a body, an unclosed svg with the first block-level tag too,
an unclosed noscript, template or iframe hides nothing, and a tag cut off by the end of the page is dropped with what follows; repeated rows are extracted each by itself; only page_id and html are looked at; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_PAGES = 400
MAX_TAGS = 20_000
ROUNDS = 120
L2 = 1e-3
OUT = "page_id long, text string, n_blocks int, n_content int"

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S | re.I)
_UNENDED = re.compile(r"<[a-zA-Z/!?]")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big br button cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that end an open one of their group.
_GROUP = {t: g for g in (("p",), ("li",), ("dt", "dd"), ("td", "th"), ("tr",), ("option",)) for t in g}
_GOLD = frozenset(("article", "main"))
_OUTSIDE = frozenset(("nav", "aside", "header", "footer", "form"))
_TAGS = "address aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li menu nav ol p pre section select summary table tbody td th tr ul".split()
_TAG_NUMBER = {t: i for i, t in enumerate(_TAGS)}
#: What these hold is no text of the page.
_HIDING = frozenset(("head", "svg", "noscript", "template", "iframe"))
_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_BLOCKS = frozenset(_TAGS) | _GOLD | {"body"}
_N_TAGS, _N_NAMES = len(_TAGS) + 1, 64
_TEXT_AT = 2 * _N_TAGS + _N_NAMES
_WORDS = np.array([2, 4, 8, 16, 32, 64])
_LINKS = np.array([1e-9, 1 / 3, 2 / 3])
N_FEATURES = _TEXT_AT + len(_WORDS) + 1 + len(_LINKS) + 1 + 8


class Open:
    """The open tags of a page, with what a block below needs of all of them kept at each, so that no block or end tag walks the stack."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.places: dict[str, list[int]] = {}  # of each open tag
        self.below: list[tuple[int, int, int, bool]] = [(0, 0, _N_TAGS - 1, False)]  # masks of tags and names, number of the parent, whether content by its markup
        self.lists: dict[tuple[int, int, int], list[int]] = {}

    def push(self, tag: str, names: int) -> None:
        tags, names_before, parent, gold = self.below[-1]
        if tag in _GOLD:
            gold = True
        else:
            parent = _TAG_NUMBER.get(tag, _N_TAGS - 1)
            tags |= 1 << parent
            gold = gold and tag not in _OUTSIDE
        self.places.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)
        self.below.append((tags, names_before | names, parent, gold))

    def pop(self, tag: str) -> None:
        """Ends the innermost such tag and those in it."""
        at = self.places.get(tag)
        if at:
            k = at[-1]
            for t in self.tags[k:]:
                self.places[t].pop()
            del self.tags[k:], self.below[k + 1 :]

    def ancestors(self) -> tuple[list[int], bool]:
        tags, names, parent, gold = self.below[-1]
        found = self.lists.get((tags, names, parent))
        if found is None:
            found = [i for i in range(_N_TAGS) if tags >> i & 1] + [_N_TAGS + parent] + [2 * _N_TAGS + i for i in range(_N_NAMES) if names >> i & 1]
            self.lists[tags, names, parent] = found
        return found, gold


class Block:
    __slots__ = ("text", "gold", "features")

    def __init__(self, text: str, gold: bool, features: list[int]) -> None:
        self.text, self.gold, self.features = text, gold, features


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    stack = Open()
    parts: list[str] = []
    linked, in_link = 0, False
    hiding, inner = "", Open()  # the open tag that hides its content, and the open ones in it
    ends_at: dict[str, int] = {}  # the last end tag of a kind

    def closed_after(tag: str, place: int) -> bool:
        if tag not in ends_at:
            ends_at[tag] = max((m.start() for m in re.finditer(rf"</{tag}\s*>", page, re.I)), default=-1)
        return ends_at[tag] >= place

    def close() -> None:
        nonlocal linked, in_link
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            ancestors, gold = stack.ancestors()
            out.append(Block(text, gold, ancestors + text_features(text, linked / len(text))))
        linked, in_link = 0, False

    closed = page.rfind(">") + 1
    at = 0
    for m in _TOKEN.finditer(page, 0, closed):
        if m.start() > at:
            run = page[at : m.start()]
            if hiding == "head" and not inner.tags and run.strip():
                hiding = ""
            if not hiding:
                parts.append(run)
                if in_link:
                    linked += len(run.strip())
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag, ends = tag.lower(), m.group(2) == "/"
        if hiding:
            if ends:
                if tag == hiding:
                    hiding = ""
                    continue
                if inner.places.get(tag):
                    inner.pop(tag)
                    continue
                if not stack.places.get(tag):
                    continue
                hiding = ""  # its parent ends
            elif hiding == "head" and (tag == "body" or (tag not in _HEAD and tag != "head" and not inner.places.get("noscript") and not inner.places.get("template"))):
                hiding = ""
            elif hiding == "svg" and tag in _BLOCKS and not inner.places.get("foreignobject"):
                hiding = ""
            else:
                if tag not in _VOID and not m.group(4).endswith("/") and (tag not in _HIDING or closed_after(tag, at)):
                    inner.push(tag, 0)
                continue
        if tag in _HIDING:
            if not ends and not m.group(4).endswith("/") and (tag in ("head", "svg") or closed_after(tag, at)):
                hiding, inner = tag, Open()
            continue
        if tag in _INLINE:
            if tag == "a":
                in_link = not ends
            elif tag == "br":
                parts.append(" ")
            continue
        close()
        if ends:
            stack.pop(tag)
        elif tag not in _VOID and not m.group(4).endswith("/"):
            group = _GROUP.get(tag)
            if group and stack.tags and stack.tags[-1] in group:
                stack.pop(stack.tags[-1])
            rest, names = m.group(4), 0
            for x in _NAMES.findall(rest) if rest else ():
                for w in re.split(r"[\s_-]+", "".join(x)):
                    if w:
                        names |= 1 << zlib.crc32(w.lower().encode()) % _N_NAMES
            stack.push(tag, names)
    rest = _UNENDED.split(page[at:], maxsplit=1)[0]
    if not hiding or (hiding == "head" and not inner.tags):
        parts.append(rest)
    close()
    for i, b in enumerate(out):  # place in the page
        b.features.append(N_FEATURES - 3 + (0 if i < 2 else 2 if i >= len(out) - 2 else 1))
    return out


def text_features(text: str, links: float) -> list[int]:
    words = int(np.searchsorted(_WORDS, text.count(" ") + 1, side="right"))
    out = [_TEXT_AT + words, _TEXT_AT + len(_WORDS) + 1 + int(np.searchsorted(_LINKS, links, side="right"))]
    marks = _TEXT_AT + len(_WORDS) + len(_LINKS) + 2
    if text[-1] in ".!?\"'”»…":
        out.append(marks)
    if "," in text:
        out.append(marks + 1)
    if text[0].isupper():
        out.append(marks + 2)
    if "©" in text or "|" in text or "·" in text:
        out.append(marks + 3)
    if sum(map(str.isdigit, text)) * 5 > len(text):
        out.append(marks + 4)
    return out


class Chains:
    """Pages as flat arrays: features of each block, blocks of each page, in order of falling length so that step t is done for all pages at once."""

    def __init__(self, pages: list[list[Block]]) -> None:
        flat = [b for p in pages for b in p]
        self.features = np.array([f for b in flat for f in b.features], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum([len(b.features) for b in flat])]).astype(np.int64)
        self.sizes = np.array([len(p) for p in pages], dtype=np.int64)
        first = np.cumsum(self.sizes) - self.sizes
        order = np.argsort(-self.sizes, kind="stable")
        self.first = first[order]
        most = int(self.sizes.max()) if len(pages) else 0
        self.alive = np.searchsorted(-self.sizes[order], -np.arange(most), side="left")  # pages with more than t blocks
        self.last = first[self.sizes > 0] + self.sizes[self.sizes > 0] - 1

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        n = len(self.at) - 1
        return np.add.reduceat(weights[self.features], self.at[:-1], axis=0) if n else np.zeros((0, 2))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))


def log_likelihood(chains: Chains, labels: np.ndarray, weights: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the labels and its gradients by forward and backward sums."""
    e = chains.emissions(weights)
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    for t, k in enumerate(chains.alive):
        at = chains.first[:k] + t
        alpha[at] = e[at] + (_lse(alpha[at - 1][:, :, None] + moves, 1) if t else 0)
    for t in range(len(chains.alive) - 2, -1, -1):
        at = chains.first[: chains.alive[t + 1]] + t
        beta[at] = _lse(moves + (e[at + 1] + beta[at + 1])[:, None, :], 2)
    z = _lse(alpha[chains.last], 1)
    owner = np.repeat(np.arange(len(chains.last)), chains.sizes[chains.sizes > 0])
    marginal = np.exp(alpha + beta - z[owner][:, None])
    follows = np.ones(len(e), dtype=bool)
    follows[np.append(0, chains.last[:-1] + 1)] = False
    at = np.flatnonzero(follows)
    pair = np.exp(alpha[at - 1][:, :, None] + moves + (e[at] + beta[at])[:, None, :] - z[owner[at]][:, None, None])
    value = e[np.arange(len(e)), labels].sum() + moves[labels[at - 1], labels[at]].sum() - z.sum()
    wrong = -marginal
    wrong[np.arange(len(e)), labels] += 1
    g = np.stack([np.bincount(chains.features, weights=np.repeat(wrong[:, y], np.diff(chains.at)), minlength=N_FEATURES) for y in (0, 1)], axis=1)
    m = -pair.sum(axis=0)
    np.add.at(m, (labels[at - 1], labels[at]), 1)
    return float(value), g, m


def fit(pages: list[list[Block]], rounds: int = ROUNDS, l2: float = L2) -> tuple[np.ndarray, np.ndarray] | None:
    """(weights of feature and label, weights of neighbouring labels); None without blocks of both labels."""
    pages = [p for p in pages if p]
    labels = np.array([int(b.gold) for p in pages for b in p], dtype=np.int64)
    if not len(labels) or labels.all() or not labels.any():
        return None
    chains = Chains(pages)
    w, m = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    state = [np.zeros_like(x) for x in (w, w, m, m)]
    for r in range(1, rounds + 1):
        _, gw, gm = log_likelihood(chains, labels, w, m)
        for x, g, one, two in ((w, gw, state[0], state[1]), (m, gm, state[2], state[3])):
            g = g / len(labels) - l2 * x
            one += 0.1 * (g - one)
            two += 0.01 * (g * g - two)
            x += 0.3 * (one / (1 - 0.9**r)) / (np.sqrt(two / (1 - 0.99**r)) + 1e-8)
    return w, m


def viterbi(chains: Chains, weights: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The most likely label of every block."""
    e = chains.emissions(weights)
    best, back = np.zeros_like(e), np.zeros(e.shape, dtype=np.int8)
    for t, k in enumerate(chains.alive):
        at = chains.first[:k] + t
        if t:
            reach = best[at - 1][:, :, None] + moves
            back[at] = reach.argmax(axis=1)
            best[at] = e[at] + reach.max(axis=1)
        else:
            best[at] = e[at]
    out = np.zeros(len(e), dtype=np.int64)
    out[chains.last] = best[chains.last].argmax(axis=1)
    for t in range(len(chains.alive) - 2, -1, -1):
        at = chains.first[: chains.alive[t + 1]] + t
        out[at] = back[at + 1, out[at + 1]]
    return out


def train(pages: DataFrame, max_pages: int = MAX_PAGES, max_tags: int = MAX_TAGS) -> tuple[np.ndarray, np.ndarray] | None:
    """The field learned from at most max_pages labelled pages of at most max_tags tags."""
    labelled = pages.select(F.col("page_id").cast("long").alias("page_id"), "html").filter("page_id IS NOT NULL").filter(F.col("html").rlike(r"(?i)<(article|main)\b"))
    labelled = labelled.filter(F.length("html") - F.length(F.replace("html", F.lit("<"))) <= max_tags)
    ids = labelled.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages)
    chosen = labelled.join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min("html").alias("html"))  # bounded by max_pages
    return fit([blocks_of(r.html) for r in chosen.orderBy("page_id").toLocalIterator()])


def extract(pages: DataFrame, model: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """(page_id, text, n_blocks, n_content) of every row; content blocks are joined by line ends."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                raw = part.column("html").to_pylist()
                found = [blocks_of(h) if h else [] for h in raw]
                labels = viterbi(Chains(found), *shared.value).tolist() if shared.value and any(found) else [1] * sum(map(len, found))
                texts, counts, k = [], [], 0
                for h, blocks in zip(raw, found):
                    kept = [b.text for b, y in zip(blocks, labels[k : k + len(blocks)]) if y]
                    k += len(blocks)
                    texts.append(None if h is None else "\n".join(kept))
                    counts.append(len(kept))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(texts, pa.string()), pa.array([len(b) for b in found], pa.int32()), pa.array(counts, pa.int32())], ["page_id", "text", "n_blocks", "n_content"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, OUT)


def op8_dom_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, train(pages))


QUERIES = {"op8_dom_crf": op8_dom_crf}
SQL: dict[str, str] = {}
