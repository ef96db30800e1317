"""Settings, their profiles and their file."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import asdict, dataclass, field, replace


@dataclass(frozen=True)
class Ranking:
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    filename_boost: float = 2.0
    exact_match_boost: float = 1.5
    recency_boost: float = 1.1
    pagerank_weight: float = 0.5
    title_match_boost: float = 1.6
    url_match_boost: float = 1.2
    click_weight: float = 0.15
    trusted_domain_boost: float = 1.15
    spam_domain_penalty: float = 0.5
    trusted_domains: tuple[str, ...] = ("developer.mozilla.org", "docs.rs", "github.com", "wikipedia.org")
    spam_domains: tuple[str, ...] = ()
    local_boost: float = 1.2
    hybrid_dedup_min_similarity: float = 0.8
    vector_weight: float = 0.4
    spam_score_weight: float = 0.6
    safety_block_threshold: float = 0.6


@dataclass(frozen=True)
class Crawl:
    max_pages: int = 500
    max_depth: int = 5
    max_pages_per_domain: int = 100
    delay_millis: int = 1000
    allowed_domains: tuple[str, ...] = ()
    discover_feeds: bool = True
    respect_robots: bool = True


@dataclass(frozen=True)
class Files:
    folders: tuple[str, ...] = ()
    ignore_hidden: bool = True
    ignored_folders: tuple[str, ...] = (".git", "node_modules", "target")
    ignored_extensions: tuple[str, ...] = ()
    max_file_bytes: int = 25 * 1024 * 1024


@dataclass(frozen=True)
class Privacy:
    anonymize_queries: bool = False
    disable_telemetry: bool = True
    block_sponsored_results: bool = False
    no_filter_bubble: bool = False
    auto_delete_history_days: int | None = None


@dataclass(frozen=True)
class Answers:
    enabled: bool = False
    api_key: str | None = None
    rerank_top_n: int = 20
    summary_max_sources: int = 5


@dataclass(frozen=True)
class Config:
    ranking: Ranking = field(default_factory=Ranking)
    crawl: Crawl = field(default_factory=Crawl)
    files: Files = field(default_factory=Files)
    privacy: Privacy = field(default_factory=Privacy)
    answers: Answers = field(default_factory=Answers)
    require_auth: bool = False
    live_results: bool = True

    def with_folder(self, folder: str) -> Config:
        return self if folder in self.files.folders else replace(self, files=replace(self.files, folders=(*self.files.folders, folder)))

    def without_folder(self, folder: str) -> Config:
        return replace(self, files=replace(self.files, folders=tuple(f for f in self.files.folders if f != folder)))

    def with_answers(self, api_key: str) -> Config:
        """Generated answers need an explicit key."""
        if not api_key.strip():
            raise ValueError("an API key is needed")
        return replace(self, answers=replace(self.answers, enabled=True, api_key=api_key))


def _privacy_first(c: Config) -> Config:
    return replace(c, privacy=Privacy(True, True, True, True, 30), crawl=replace(c.crawl, max_pages=0, allowed_domains=()), answers=replace(c.answers, enabled=False), require_auth=True, live_results=False)


def _docs_search(c: Config) -> Config:
    ranking = replace(c.ranking, filename_boost=2.5, title_match_boost=2.0, exact_match_boost=1.8, pagerank_weight=0.0, recency_boost=1.3)
    return replace(c, ranking=ranking, crawl=replace(c.crawl, max_pages=0), answers=replace(c.answers, enabled=False), live_results=True)


def _research(c: Config) -> Config:
    ranking = replace(c.ranking, pagerank_weight=0.8, trusted_domain_boost=1.3, vector_weight=0.55)
    crawl = replace(c.crawl, max_pages=2000, max_depth=6, discover_feeds=True)
    return replace(c, ranking=ranking, crawl=crawl, answers=replace(c.answers, rerank_top_n=30, summary_max_sources=8), privacy=replace(c.privacy, anonymize_queries=False))


def _enterprise_local(c: Config) -> Config:
    privacy = replace(c.privacy, disable_telemetry=True, auto_delete_history_days=180)
    return replace(c, privacy=privacy, crawl=replace(c.crawl, max_pages=0, allowed_domains=()), answers=replace(c.answers, enabled=False), require_auth=True, live_results=False)


PROFILES = {"privacy-first": _privacy_first, "docs-search": _docs_search, "research": _research, "enterprise-local": _enterprise_local}


def apply_profile(config: Config, label: str) -> Config:
    try:
        return PROFILES[label.strip().lower().replace("_", "-")](config)
    except KeyError:
        raise ValueError(f"unknown profile {label!r}; there are {', '.join(PROFILES)}") from None


def _from(data: dict) -> Config:
    parts = {"ranking": Ranking, "crawl": Crawl, "files": Files, "privacy": Privacy, "answers": Answers}
    tupled = {k: tuple(v) if isinstance(v, list) else v for k, v in data.items()}
    return Config(**{k: parts[k](**{n: tuple(x) if isinstance(x, list) else x for n, x in v.items()}) if k in parts else v for k, v in tupled.items()})


def load(path: str) -> Config:
    """From TOML or JSON; a missing file gives the defaults."""
    if not os.path.exists(path):
        return Config()
    with open(path, "rb") as f:
        return _from(tomllib.load(f) if path.endswith(".toml") else json.load(f))


def save(config: Config, path: str) -> None:
    """As JSON, by a rename, so that no reader sees half a file."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.new", "w") as f:
        json.dump(asdict(config), f, indent=1)
    os.replace(f"{path}.new", path)
