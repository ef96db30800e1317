"""python -m siftspark COMMAND: an index of a folder, and what it answers."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time


def safe_path(path: str, roots: list[str]) -> str:
    """The real path of a file to show, if it lies below one of the roots; links don't lead out."""
    real = os.path.realpath(path)
    for root in roots:
        base = os.path.realpath(root)
        if real == base or real.startswith(base.rstrip("/") + "/"):
            return real
    raise PermissionError(f"{path} isn't below an indexed folder")


def opensearch(base: str, name: str = "siftspark") -> str:
    """The descriptor by which a browser adds the engine."""
    from xml.sax.saxutils import escape, quoteattr

    find, suggest = quoteattr(f"{base}/search?q={{searchTerms}}"), quoteattr(f"{base}/suggest?q={{searchTerms}}")
    return (
        '<?xml version="1.0" encoding="UTF-8"?>\n<OpenSearchDescription xmlns="http://a9.com/-/spec/opensearch/1.1/">'
        f"<ShortName>{escape(name)}</ShortName><Description>Search with {escape(name)}</Description><InputEncoding>UTF-8</InputEncoding>"
        f'<Url type="text/html" template={find}/><Url type="application/x-suggestions+json" template={suggest}/></OpenSearchDescription>'
    )


def benchmark(index, queries: list[str], iterations: int = 100) -> dict:
    """Milliseconds of searches in turn: parsing included, loading not."""
    from .operators import search

    took, found = [], 0
    for i in range(iterations):
        began = time.perf_counter()
        found += len(search.search(index, queries[i % len(queries)], now=int(time.time()), mode="both").collect())
        took.append((time.perf_counter() - began) * 1000)
    return {"iterations": iterations, "total_ms": sum(took), "avg_ms": sum(took) / iterations, "min_ms": min(took), "max_ms": max(took), "avg_results": found / iterations}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftspark")
    p.add_argument("--index", default="siftspark-index", help="folder of the index")
    p.add_argument("--profile", help="settings: privacy-first, docs-search, research, enterprise-local")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: tuple) -> None:
        c = sub.add_parser(name)
        for flags, more in arguments:
            c.add_argument(*flags, **more)

    limit = (("--limit",), {"type": int, "default": 10})
    add("index", (("folder",), {}))
    add("update", (("folder",), {}))
    add("remove", (("folder",), {}))
    add("search", (("query",), {"nargs": "+"}), limit, (("--offset",), {"type": int, "default": 0}), (("--mode",), {"default": "local"}), (("--explain",), {"action": "store_true"}))
    add("suggest", (("prefix",), {}), limit)
    add("spell", (("query",), {"nargs": "+"}))
    add("stats")
    add("related", (("name",), {}), limit)
    add("top", limit)
    add("mentions", (("name",), {}), (("--after",), {"type": int, "default": 0}), (("--before",), {"type": int, "default": 1 << 40}))
    add("view", (("path",), {}))
    add("answer", (("query",), {"nargs": "+"}))
    add("benchmark", (("--iterations",), {"type": int, "default": 100}), (("--queries",), {"help": "a file, one a line"}))
    add("opensearch", (("base",), {}))
    return p


def main(arguments: list[str] | None = None, spark=None) -> list[dict]:
    """Runs a command and prints its rows as JSON lines; returns them."""
    args = parser().parse_args(arguments)
    rows = list(run(args, spark))
    for row in rows:
        print(json.dumps(row, default=str, ensure_ascii=False))
    return rows


def run(args, spark=None):
    from .operators import answers

    if args.command == "opensearch":
        return [{"xml": opensearch(args.base)}]
    if args.command == "answer":
        return [{"answer": answers.answer(" ".join(args.query)), "bang": answers.bang(" ".join(args.query))}]
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("siftspark").getOrCreate()
    from . import config
    from .operators import entities, search, snippets, suggest
    from .operators.index import Index, documents, statistics
    from .plans import query as Q
    from .sources import files

    settings = config.apply_profile(config.Config(), args.profile) if args.profile else config.Config()
    if args.command == "index":
        Index(documents(files.documents(files.scan(spark, args.folder, settings.files)))).save(args.index)
        return [{"documents": Index.load(spark, args.index, check=False).docs.count()}]
    index = Index.load(spark, args.index, check=False)
    if args.command in ("update", "remove"):
        changed = index.remove_folder(os.path.abspath(args.folder)) if args.command == "remove" else index.upsert(files.documents(files.scan(spark, args.folder, settings.files)))
        changed.save(args.index, Index.version(spark, args.index) + 1)
        return [{"documents": Index.load(spark, args.index, check=False).docs.count()}]
    if args.command == "search":
        text = " ".join(args.query)
        found = search.search(index, text, settings.ranking, int(time.time()), Q.mode_of(args.mode), args.limit, args.offset)
        found = snippets.with_snippets(search.reasons(found), Q.terms_of(Q.parse(text)))
        columns = ["path", "score", "snippet"] + (["summary"] if args.explain else [])
        return [r.asDict() for r in found.select(*columns).collect()]
    table = {
        "suggest": lambda: suggest.complete(index.vocab, args.prefix, args.limit), "spell": lambda: suggest.did_you_mean(index.vocab, " ".join(args.query)), "stats": lambda: statistics(index.docs),
        "related": lambda: entities.related_to(entities.cooccurrence(index.mentions), args.name, args.limit), "top": lambda: entities.top_entities(index.mentions, args.limit),
        "mentions": lambda: entities.sources_mentioning(index.mentions, args.name, args.after, args.before),
    }
    if args.command in table:
        return [r.asDict() for r in table[args.command]().collect()]
    if args.command == "view":
        rows = index.by_path([os.path.realpath(args.path)]).select("path", "content").collect()
        if not rows:
            raise PermissionError(f"{args.path} isn't indexed")
        return [{"path": r.path, "text": r.content} for r in rows]
    queries = open(args.queries).read().split("\n") if args.queries else ["test", "rust", "search"]
    return [benchmark(index, [q for q in queries if q.strip()], args.iterations)]


if __name__ == "__main__":
    main(sys.argv[1:])
