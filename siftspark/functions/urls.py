"""URL functions: canonical form, resolution, domains and query strings."""

from __future__ import annotations

from urllib.parse import parse_qsl, quote, unquote_plus, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TRACKING = tuple(sorted("sid phpsessid sessionid session_id referrer ref msclkid fbclid gclid utm_content utm_term utm_campaign utm_medium utm_source".split()))
REFUSED = ("data:", "javascript:", "mailto:", "tel:")
_PORTS = {"http": 80, "https": 443}


def canonicalize(url: str) -> str | None:
    """Lower-case scheme and host, no fragment, default port, tracking parameters or slash at the end; parameters sorted. None for what isn't absolute."""
    try:
        u = urlsplit(url.strip())
        port = u.port
    except ValueError:
        return None
    if not u.scheme or not u.hostname:
        return None
    scheme = u.scheme.lower()
    host = u.hostname.lower()
    host = f"[{host}]" if ":" in host else host
    user = u.netloc.rpartition("@")[0]
    netloc = (f"{user}@" if user else "") + host + (f":{port}" if port and _PORTS.get(scheme) != port else "")
    pairs = sorted((k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if k.lower() not in TRACKING)
    query = "&".join(f"{quote(k, safe='')}={quote(v, safe='')}" for k, v in pairs)
    path = u.path or "/"
    if len(path) > 1:
        path = path.rstrip("/") or "/"
    return urlunsplit((scheme, netloc, path, query, ""))


def resolve(base: str, href: str) -> str | None:
    href = (href or "").strip()
    if not href or href[0] == "#" or href.lower().startswith(REFUSED):
        return None
    try:
        joined = urljoin(base, href)
    except ValueError:
        return None
    return canonicalize(joined) if joined.lower().startswith(("http://", "https://")) else None


@F.pandas_udf(StringType())
def canonical_udf(urls: pd.Series) -> pd.Series:
    return urls.map(lambda u: canonicalize(u) if u else None)


@F.pandas_udf(StringType())
def resolve_udf(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
    return pd.Series([resolve(b, h) if b and h else None for b, h in zip(bases, hrefs)], dtype=object)


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def domain_of(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(host_of(url), r"^www\.", ""), F.lit(""))


def canonical(url: Column) -> Column:
    """The canonical form inside the JVM, for URLs whose parameters need no other escapes than they have."""
    host, path, query = host_of(url), F.try_parse_url(url, F.lit("PATH")), F.try_parse_url(url, F.lit("QUERY"))
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    port = F.regexp_extract(F.try_parse_url(url, F.lit("AUTHORITY")), r":(\d+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    pairs = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(*TRACKING)))
    pairs = F.transform(pairs, lambda p: F.when(F.instr(p, "=") > 0, p).otherwise(F.concat(p, F.lit("="))))
    trimmed = F.regexp_replace(path, r"(?<=.)/+$", "")
    return F.concat(
        scheme, F.lit("://"), host, F.when((port == "") | default, "").otherwise(F.concat(F.lit(":"), port)),
        F.when(F.coalesce(path, F.lit("")) == "", "/").otherwise(trimmed),
        F.when(F.coalesce(F.size(pairs), F.lit(0)) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(""),
    )


def is_onion(host: Column) -> Column:
    """Whether the host, rid of scheme, path and port, ends in .onion."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(host)), r"^[a-z]+://", ""), r"[/:?#].*$", "")
    return bare.rlike(r"\.onion$")


def domain_allowed(domain: Column, allowed: list[str]) -> Column:
    """Equal to an allowed domain or below one; with none listed, all are allowed."""
    out = F.lit(not allowed)
    for d in allowed:
        out = out | (domain == d) | domain.endswith(f".{d}")
    return out


def parse_query_string(query: str) -> dict[str, str]:
    out = {}
    for pair in query.split("&"):
        key, eq, value = pair.partition("=")
        if eq:
            out[unquote_plus(key)] = unquote_plus(value)
    return out


def query_map(query: Column) -> Column:
    """A map of the decoded key=value pairs of a query string; the last of equal keys stays."""
    pairs = F.filter(F.split(query, "&"), lambda p: F.instr(p, "=") > 0)
    entries = F.transform(pairs, lambda p: F.struct(F.url_decode(F.substring_index(p, "=", 1)).alias("k"), F.url_decode(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(last)


def favicon(domain: Column) -> Column:
    return F.concat(F.lit("https://"), domain, F.lit("/favicon.ico"))


def view_url(path: Column) -> Column:
    return F.concat(F.lit("/view?path="), F.url_encode(path))
