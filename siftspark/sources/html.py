"""Content of web pages as columns, by one Arrow pass."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

_S, _A = StringType(), ArrayType(StringType())
LINKS = ArrayType(StructType([StructField("href", _S), StructField("anchor", _S), StructField("nofollow", BooleanType())]))
PAGE = StructType(
    [StructField(n, t) for n, t in (("title", _S), ("description", _S), ("author", _S), ("canonical", _S), ("lang", _S), ("feeds", _A), ("headings", _A), ("paragraphs", _A), ("alts", _A), ("links", LINKS))]
)
#: Pages of a batch that are read at a time.
PORTION = 256
NOISE_TAGS = frozenset("template iframe svg button form aside header footer nav noscript style script".split())
NOISE_HINTS = tuple("comment-section social-share breadcrumb site-nav newsletter-signup cookie-consent cookie-banner sponsor ad-slot ads- advertisement advert".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TEXT = frozenset("p li td blockquote article section div".split())
_HEADS = frozenset(f"h{i}" for i in range(1, 7))
_BLOCKS = _TEXT | _HEADS | frozenset("ul ol table header footer nav aside form main figure pre hr dl address".split())
_CLOSES = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
_FEEDS = ("application/rss+xml", "application/atom+xml")
_OUT_OF_BODY = frozenset(("script", "style", "noscript", "template"))


def squeeze(text: str) -> str:
    return " ".join(text.split())


class _Node:
    __slots__ = ("tag", "noise", "hint", "slot", "direct", "whole")

    def __init__(self, tag: str, noise: bool, hint: bool, slot: list | None) -> None:
        self.tag, self.noise, self.hint, self.slot = tag, noise, hint, slot
        self.direct: list[str] = []  # text of its own
        self.whole: list[str] | None = None  # text with that of its descendants, where that is asked for


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Node] = []
        self.page: dict = {"title": None, "description": None, "author": None, "canonical": None, "lang": None, "feeds": [], "headings": [], "alts": [], "links": []}
        self.paragraphs: list[list[str]] = []
        self.headings: list[list[str]] = []
        self.anchors: list[tuple[str, list[str], bool]] = []
        self.title: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag in _BLOCKS:
            self._end_open("p")
        for t in _CLOSES.get(tag, ()):
            if self.open and self.open[-1].tag == t:
                self.open.pop()
        hint = any(h in a.get(k, "").lower() for k in ("class", "id") for h in NOISE_HINTS)
        above = any(n.hint or n.tag in NOISE_TAGS for n in self.open[-1:]) or bool(self.open and self.open[-1].noise)
        noise = above or hint
        node = _Node(tag, above, hint, None)
        if tag == "html" and self.page["lang"] is None and "lang" in a:
            self.page["lang"] = a["lang"].lower()
        elif tag == "meta":
            name = a.get("name", "").lower()
            if name in ("description", "author") and self.page[name] is None and "content" in a:
                self.page[name] = squeeze(a["content"])
        elif tag == "link":
            rel = a.get("rel", "").lower()
            if rel == "canonical" and self.page["canonical"] is None and "href" in a:
                self.page["canonical"] = a["href"]
            if rel == "alternate" and a.get("type", "").lower() in _FEEDS and "href" in a:
                self.page["feeds"].append(a["href"])
        elif tag == "img" and squeeze(a.get("alt", "")):
            self.page["alts"].append(squeeze(a["alt"]))
        elif tag == "a" and a.get("href", "").strip():
            node.whole = []
            self.anchors.append((a["href"], node.whole, "nofollow" in a.get("rel", "").lower()))
        elif tag == "title" and self.title is None:
            node.whole = self.title = []
        if tag in _HEADS and not noise:
            node.whole = []
            self.headings.append(node.whole)
        if tag in _TEXT and not noise:
            self.paragraphs.append(node.direct)
        if tag not in _VOID:
            self.open.append(node)

    def _end_open(self, tag: str) -> None:
        """Ends an open paragraph (and what is open inside it), as a block does."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in _BLOCKS:
                return

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        if self.open:
            self.open[-1].direct.append(data)
            if self.open[-1].tag in _OUT_OF_BODY:
                return
        for n in self.open:
            if n.whole is not None:
                n.whole.append(data)

    def result(self) -> dict:
        p = self.page
        p["title"] = squeeze("".join(self.title or []))
        p["description"] = p["description"] or ""
        p["author"] = p["author"] or None
        p["headings"] = [t for t in (squeeze("".join(h)) for h in self.headings) if t]
        texts = [squeeze(" ".join(d)) for d in self.paragraphs]
        kept = [t for t in texts if len(t.split()) >= 3]
        p["paragraphs"] = [t for i, t in enumerate(kept) if not i or t != kept[i - 1]]
        p["links"] = [{"href": h, "anchor": squeeze("".join(t)), "nofollow": n} for h, t, n in self.anchors]
        return p


def extract(html: str) -> dict:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.result()


@F.pandas_udf(PAGE)
def extract_udf(pages: pd.Series) -> pd.DataFrame:
    """For SQL; tables are read by extracted()."""
    return pd.DataFrame([extract(h or "") for h in pages], columns=[f.name for f in PAGE.fields])


def _columns(pages: list[dict]) -> list[pa.Array]:
    return [pa.array([p[f.name] for p in pages], to_arrow_type(f.dataType)) for f in PAGE.fields]


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """The other columns of pages and those of PAGE. Pages are read PORTION at a time, which bounds a worker's memory."""
    rest = [c for c in pages.columns if c != html and c not in PAGE.names]
    chosen = pages.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{html}`").alias("_html"))
    schema = StructType.fromJson(chosen.drop("_html").schema.jsonValue())  # a copy that can be sent to workers
    for field in PAGE.fields:
        schema = schema.add(field)
    names = list(schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PORTION):
                part = batch.slice(a, PORTION)
                *own, html = part.columns
                yield pa.RecordBatch.from_arrays(own + _columns([extract(h or "") for h in html.to_pylist()]), names)
            batch = part = own = html = None  # before the next one is read
            pa.default_memory_pool().release_unused()

    return chosen.mapInArrow(run, schema)


def js_shell(html: Column, text: Column) -> Column:
    """Whether a page only makes sense with scripts: few words in much markup, or an empty mount point."""
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    mount = html.rlike(r"""(?i)<div[^>]*\bid\s*=\s*["']?(root|app|__next|main)["']?[^>]*>\s*</div>""")
    return ((n < 40) & (F.octet_length(html) > 2000)) | (mount & (n < 20))
