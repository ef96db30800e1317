"""Text of files by format, with the standard library. What can't be read gives an empty text, never an error."""

from __future__ import annotations

import email
import email.policy
import io
import json
import re
import sqlite3
import tempfile
import zipfile
import zlib
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .html import extract as extract_html

_FORMATS = {
    "html": "html htm", "markdown": "md markdown", "json": "json", "xml": "xml", "pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "eml": "eml", "mbox": "mbox", "zip": "zip",
    "sqlite": "db sqlite sqlite3", "image": "heic webp tif tiff png jpeg jpg",
}
BY_EXTENSION = {e: f for f, all_ in _FORMATS.items() for e in all_.split()}
EXTENSIONS = tuple(sorted({*BY_EXTENSION, *"txt rs c cpp hpp h py java kt js ts tsx jsx css yaml yml toml csv log sh go rb".split()} - {"markdown"}))
_OFFICE = "application/vnd.openxmlformats-officedocument."
BY_TYPE = {
    "application/xhtml+xml": "html", "text/html": "html", "text/x-markdown": "markdown", "text/markdown": "markdown", "text/json": "json", "application/json": "json",
    "application/atom+xml": "xml", "application/rss+xml": "xml", "text/xml": "xml", "application/xml": "xml", "application/pdf": "pdf", f"{_OFFICE}presentationml.presentation": "pptx",
    f"{_OFFICE}spreadsheetml.sheet": "xlsx", f"{_OFFICE}wordprocessingml.document": "docx", "application/mbox": "mbox", "message/rfc822": "eml",
    "application/x-zip-compressed": "zip", "application/zip": "zip", **{f"image/{t}": "image" for t in ("heic", "webp", "tiff", "png", "jpeg")},
}
#: Readers to use in place of pdf() and image() here, such as ones with a layout model or OCR.
PLUGGED: dict[str, Callable[[bytes], str] | None] = {"pdf": None, "image": None}


def format_of_extension(extension: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in BY_EXTENSION.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(extension)), F.lit("text"))


def format_of_type(content_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in BY_TYPE.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.trim(F.substring_index(content_type, ";", 1))), F.lit("text"))


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def is_supported(path: Column) -> Column:
    return extension_of(path).isin(*EXTENSIONS)


def markdown(source: str) -> str:
    """Text and code without the marks; items keep a dash."""
    out, fenced = [], False
    for line in source.splitlines():
        if re.match(r"\s*(```|~~~)", line):
            fenced = not fenced
            continue
        if not fenced:
            if re.fullmatch(r"\s*([-*_=]\s*){3,}", line):
                continue
            line = re.sub(r"^\s*(#{1,6}\s+|>\s?)+", "", line)
            line = re.sub(r"^\s*([-*+]|\d+[.)])\s+", "- ", line)
            line = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", line)
            line = re.sub(r"<[^>]+>", "", line)
            line = re.sub(r"(\*\*|__|~~|`)(.+?)\1", r"\2", line)
            line = re.sub(r"(?<!\w)([*_])(.+?)\1(?!\w)", r"\2", line)
        out.append(line)
    return "\n".join(out).strip()


def json_text(source: str) -> str:
    """Keys and strings, depth first; what isn't JSON as it is."""
    try:
        value = json.loads(source)
    except (ValueError, RecursionError):
        return source
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, str):
            out.append(v)
        elif isinstance(v, list):
            todo += reversed(v)
        elif isinstance(v, dict):
            todo += [x for k, y in reversed(list(v.items())) for x in (y, k)]
    return " ".join(out)


def xml_text(source: str) -> str:
    """Character data up to the first error."""
    out = []
    parser = ElementTree.XMLPullParser(("start", "end"))
    try:
        parser.feed(source)
        parser.close()
    except ElementTree.ParseError:
        pass
    try:
        for event, e in parser.read_events():
            t = e.text if event == "start" else e.tail
            if t and t.strip():
                out.append(t.strip())
    except ElementTree.ParseError:
        pass
    return " ".join(out)


def _parts(data: bytes, names: str) -> list[ElementTree.Element]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        found = [n for n in z.namelist() if re.fullmatch(names, n)]
        return [ElementTree.fromstring(z.read(n)) for n in sorted(found, key=lambda n: [int(x) for x in re.findall(r"\d+", n)] or [0])]


def _texts(root: ElementTree.Element, tag: str) -> list[str]:
    return [e.text for e in root.iter() if e.tag.rpartition("}")[2] == tag and e.text]


def docx(data: bytes) -> str:
    out = []
    for root in _parts(data, r"word/document\.xml"):
        for p in (e for e in root.iter() if e.tag.rpartition("}")[2] == "p"):
            out.append("".join(_texts(p, "t")))
    return "\n".join(t for t in out if t)


def pptx(data: bytes) -> str:
    return "\n".join(" ".join(_texts(r, "t")) for r in _parts(data, r"ppt/slides/slide\d+\.xml"))


def xlsx(data: bytes) -> str:
    shared = [t for r in _parts(data, r"xl/sharedStrings\.xml") for t in _texts(r, "t")]
    inline = [t for r in _parts(data, r"xl/worksheets/sheet\d+\.xml") for t in _texts(r, "t")]
    return "\n".join(shared + inline)


def eml(data: bytes) -> dict | None:
    """subject, sender, recipients, date, body and names of attachments; None for what has neither header nor body."""
    m = email.message_from_bytes(data, policy=email.policy.default)
    if not m.keys():
        return None
    part = m.get_body(("plain", "html"))
    try:
        body = part.get_content() if part else ""
    except (LookupError, ValueError):
        body = ""
    if part is not None and part.get_content_type() == "text/html":
        page = extract_html(body)
        body = "\n".join([page["title"], *page["headings"], *page["paragraphs"]]).strip()
    return {
        "subject": str(m["subject"] or ""), "sender": str(m["from"] or ""), "recipients": str(m["to"] or ""), "date": str(m["date"] or ""), "body": body.strip(),
        "attachments": [a.get_filename() or "" for a in m.iter_attachments()],
    }


def mbox(data: bytes) -> list[dict]:
    """Messages between lines that begin with `From `; what isn't one is passed over."""
    parts = re.split(rb"(?m)^From .*\r?\n", data)
    return [m for m in (eml(p) for p in parts if p.strip()) if m]


def mail_text(m: dict) -> str:
    return "\n".join(x for x in (m["subject"], f"From: {m['sender']}", f"To: {m['recipients']}", m["date"], m["body"], *m["attachments"]) if x)


def archive(data: bytes, most_files: int | None = None, most_bytes: int | None = None) -> str:
    """Names of all entries and the text of those of known formats: of all, or of the first most_files that have no more than most_bytes."""
    out, done = [], 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for entry in z.infolist():
            out.append(entry.filename)
            extension = entry.filename.rpartition(".")[2].lower()
            beyond = (most_files is not None and done >= most_files) or (most_bytes is not None and entry.file_size > most_bytes)
            if entry.is_dir() or beyond or extension not in EXTENSIONS or BY_EXTENSION.get(extension) in ("zip", "sqlite"):
                continue
            done += 1
            text = text_of(BY_EXTENSION.get(extension, "text"), z.read(entry))
            if text:
                out.append(text)
    return "\n".join(out)


_STREAM = re.compile(rb"<<((?:[^<>]|<<[^<>]*>>|<[0-9A-Fa-f\s]*>)*)>>\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
_PDF_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|[\[\]]|[-+]?[0-9]*\.?[0-9]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(raw: bytes, unicode_of: dict[int, str]) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if unicode_of and len(data) % 2 == 0:
            return "".join(unicode_of.get(int.from_bytes(data[i : i + 2]), "") for i in range(0, len(data), 2))
    else:
        data = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], b"" if m[1][-1:] == b"\n" else m[1]), raw[1:-1], flags=re.S)
    if data[:2] == b"\xfe\xff":
        return data[2:].decode("utf-16-be", "replace")
    return data.decode("cp1252", "replace")


def _unicode_map(stream: bytes) -> dict[int, str]:
    """Codes of a ToUnicode table."""
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", stream, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            out[int(a, 16)] = text(b)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", stream, re.S):
        for a, z, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]{4})>", part):
            for k in range(int(a, 16), min(int(z, 16), int(a, 16) + 0xFFFF) + 1):
                out[k] = chr(int(b, 16) + k - int(a, 16))
    return out


def pdf(data: bytes) -> str:
    """The text layer: strings that the pages' contents show, a line a move. Scanned pages have none; encrypted files give nothing."""
    streams = []
    for head, body in _STREAM.findall(data):
        if b"/FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        elif b"/Filter" in head:
            continue
        streams.append(body)
    unicode_of: dict[int, str] = {}
    for body in streams:
        if b"beginbf" in body:
            unicode_of |= _unicode_map(body)
    lines: list[str] = []
    for body in streams:
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", body, re.S):
            line, shown, numbers = [], [], []
            for m in _PDF_TOKEN.finditer(block):
                t = m.group()
                if t[:1] in b"(<":
                    shown.append(_pdf_string(t, unicode_of))
                elif t in (b"Tj", b"TJ", b"'", b'"'):
                    if t in (b"'", b'"') and line:
                        lines.append("".join(line))
                        line = []
                    line += shown
                    shown = []
                elif t in (b"Td", b"TD", b"T*", b"Tm"):
                    if line and (t in (b"T*", b"Tm") or (len(numbers) > 1 and numbers[-1] != 0)):
                        lines.append("".join(line))
                        line = []
                    elif line:
                        line.append(" ")
                    shown = []
                elif t[:1] in b"+-.0123456789":
                    number = float(t)
                    if shown and number < -200:  # a wide gap between the strings of an array
                        shown.append(" ")
                    numbers.append(number)
                    continue
                numbers = numbers if t in b"[]" else []
            if line or shown:
                lines.append("".join(line + shown))
    return "\n".join(x for x in lines if x.strip())


_EXIF = {0x010E: "description", 0x010F: "make", 0x0110: "model", 0x0132: "taken", 0x013B: "artist", 0x8298: "copyright", 0x9286: "comment", 0x9003: "taken"}


def _exif(tiff: bytes) -> list[str]:
    order = "little" if tiff[:2] == b"II" else "big"
    number = lambda at, n: int.from_bytes(tiff[at : at + n], order)
    out, todo, seen = [], [number(4, 4)], set()
    while todo:
        at = todo.pop(0)
        if at in seen or at + 2 > len(tiff):
            continue
        seen.add(at)
        for i in range(number(at, 2)):
            e = at + 2 + 12 * i
            tag, kind, n = number(e, 2), number(e + 2, 2), number(e + 4, 4)
            if tag == 0x8769:
                todo.append(number(e + 8, 4))
            elif tag in _EXIF and kind in (2, 7):
                start = e + 8 if n <= 4 else number(e + 8, 4)
                value = tiff[start : start + n]
                value = value[8:] if tag == 0x9286 else value
                text = value.rstrip(b"\0 ").decode("utf-8", "replace").strip()
                if text:
                    out.append(f"{_EXIF[tag]}: {text}")
    return list(dict.fromkeys(out))


def image(data: bytes) -> str:
    """What an image says of itself: EXIF texts of JPEG, TIFF and PNG, text chunks of PNG. What it shows isn't read (PLUGGED may)."""
    out: list[str] = []
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
            size = int.from_bytes(data[at + 2 : at + 4])
            body = data[at + 4 : at + 2 + size]
            if data[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
                out += _exif(body[6:])
            elif data[at + 1] == 0xFE:
                out.append(f"comment: {body.decode('utf-8', 'replace').strip()}")
            at += 2 + max(size, 2)
    elif data[:4] in (b"II*\0", b"MM\0*"):
        out += _exif(data)
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 12 <= len(data):
            size, kind = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8]
            body = data[at + 8 : at + 8 + size]
            if kind == b"tEXt":
                key, _, value = body.partition(b"\0")
                out.append(f"{key.decode('latin-1').lower()}: {value.decode('latin-1')}")
            elif kind == b"iTXt":
                key, _, rest = body.partition(b"\0")
                packed, rest = rest[:1] == b"\1", rest[2:].partition(b"\0")[2].partition(b"\0")[2]
                out.append(f"{key.decode('latin-1').lower()}: {(zlib.decompress(rest) if packed else rest).decode('utf-8', 'replace')}")
            elif kind == b"eXIf":
                out += _exif(body)
            at += 12 + size
    return "\n".join(out)


def text_columns(path: str) -> list[tuple[str, list[str]]]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        tables = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        out = []
        for t in tables:
            quoted = t.replace('"', '""')
            columns = [r[1] for r in db.execute(f'PRAGMA table_info("{quoted}")') if any(k in (r[2] or "").upper() for k in ("TEXT", "CHAR", "CLOB"))]
            if columns:
                out.append((t, columns))
        return out


def sqlite_text(data: bytes) -> str:
    with tempfile.NamedTemporaryFile(suffix=".db") as f:
        f.write(data)
        f.flush()
        out = []
        with sqlite3.connect(f"file:{f.name}?mode=ro", uri=True) as db:
            for table, columns in text_columns(f.name):
                names = ", ".join('"{}"'.format(c.replace('"', '""')) for c in columns)
                quoted = table.replace('"', '""')
                out += [" ".join(str(v) for v in row if v not in (None, "")) for row in db.execute(f'SELECT {names} FROM "{quoted}"')]
        return "\n".join(x for x in out if x)


def _html_text(data: bytes) -> str:
    page = extract_html(data.decode("utf-8", "replace"))
    return " \n ".join(x for x in [page["title"], page["description"], *page["headings"], *page["paragraphs"], *page["alts"]] if x)


_READERS: dict[str, Callable[[bytes], str]] = {
    "html": _html_text, "markdown": lambda d: markdown(d.decode("utf-8", "replace")), "json": lambda d: json_text(d.decode("utf-8", "replace")), "xml": lambda d: xml_text(d.decode("utf-8", "replace")),
    "docx": docx, "xlsx": xlsx, "pptx": pptx, "eml": lambda d: mail_text(eml(d)) if eml(d) else "", "mbox": lambda d: "\n\n".join(map(mail_text, mbox(d))), "zip": archive, "sqlite": sqlite_text,
    "pdf": pdf, "image": image,
}


def text_of(format_: str, data: bytes) -> str:
    reader = PLUGGED.get(format_) or _READERS.get(format_, lambda d: d.decode("utf-8", "replace"))
    try:
        return reader(data)
    except (ValueError, KeyError, IndexError, OSError, zlib.error, zipfile.BadZipFile, ElementTree.ParseError, sqlite3.Error, NotImplementedError):
        return ""


@F.pandas_udf(StringType())
def text_udf(formats: pd.Series, contents: pd.Series) -> pd.Series:
    return pd.Series([text_of(f or "text", bytes(c)) if c is not None else None for f, c in zip(formats, contents)], dtype=object)


def messages(files: DataFrame) -> DataFrame:
    """A row for each message of mbox files (path, content)."""
    schema = "array<struct<subject:string,sender:string,recipients:string,date:string,body:string,attachments:array<string>>>"

    def split(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: mbox(bytes(c)) if c is not None else [])

    split.__annotations__ = {"contents": pd.Series, "return": pd.Series}
    return files.select("path", F.posexplode(F.pandas_udf(split, schema)("content")).alias("message", "_m")).select("path", "message", "_m.*")
