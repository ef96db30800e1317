"""What round 2 added to the engine: one pass over texts, changes without reading all again, near copies, formats, stored tables, commands."""

import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from siftspark import __main__ as cli
from siftspark.config import Crawl, Ranking
from siftspark.functions import text as T
from siftspark.operators import crawl, dedup, entities, secure, suggest
from siftspark.operators import search as S
from siftspark.operators.index import Index, documents
from siftspark.sources import files, formats, store
from siftspark.streaming import live
from tests.test_search import PLAIN, docs, ids


def passes(df):
    """How many Python passes over words a plan has."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_folded_forms_are_found(spark):
    index = Index(documents(docs(spark, {1: "the \ufb01le \uff21\uff22\uff23 word", 2: "file abc", 3: "我喜欢 搜索引擎", 4: "plain"})))
    for query, found in (("file", [1, 2]), ("\ufb01le", [1, 2]), ("abc", [1, 2]), ("\uff21\uff22\uff23", [1, 2]), ('"搜索"', [3]), ("搜", [3]), ('"索搜"', [])):
        assert ids(S.results(index, query, PLAIN, 0, "local")) == found, query


def test_changes_read_changed_texts_alone(spark, tmp_path):
    texts = {i: f"word{i} common text" for i in range(20)}
    Index(documents(docs(spark, texts))).save(str(tmp_path / "ix"))
    index = Index.load(spark, str(tmp_path / "ix"))
    new = index.upsert(docs(spark, {3: "fresh words", 30: "more common"}))
    for table in ("docs", "postings", "vocab", "chunks"):
        assert passes(index.table(table)) == 0 and passes(new.table(table)) >= 1
    assert passes(new.docs) == 1
    texts |= {3: "fresh words", 30: "more common"}
    whole = Index(documents(docs(spark, texts)))
    rows = lambda df: sorted(map(str, df.collect()))
    for table, columns in (("postings", ("term", "doc_id", "tf", "positions")), ("vocab", ("term", "df", "cf")), ("fingerprints", ("doc_id", "exact_hash", "hi", "lo")), ("mentions", ("doc_id", "name"))):
        assert rows(getattr(new, table).select(*columns)) == rows(getattr(whole, table).select(*columns)), table
    assert rows(new.stats) == rows(whole.stats)
    new.save(str(tmp_path / "ix"), 2)
    again = Index.load(spark, str(tmp_path / "ix"))
    assert ids(S.results(again, "common", PLAIN, 0, "local")) == sorted(set(texts) - {3}) and ids(S.results(again, "fres*", PLAIN, 0, "local")) == [3]
    changes = docs(spark, {4: None, 31: "common late"}).withColumns({"kind": F.when(F.col("doc_id") == 4, "delete").otherwise("upsert"), "seq": F.col("doc_id")}).drop("acl")
    assert passes(live.apply_changes(again, changes).docs) == 1
    assert ids(S.results(live.apply_changes(again, changes), "common", PLAIN, 0, "local")) == sorted(set(texts) - {3, 4} | {31})


def test_damage_is_noticed(spark, tmp_path):
    Index(documents(docs(spark, {1: "some words", 2: "other words"}))).save(str(tmp_path / "ix"))
    Index.load(spark, str(tmp_path / "ix"))
    vocab = spark.read.parquet(str(tmp_path / "ix/v1/vocab")).withColumn("df", F.col("df") + (F.col("term") == "other").cast("long"))
    spark.createDataFrame(vocab.collect(), vocab.schema).write.mode("overwrite").parquet(str(tmp_path / "ix/v1/vocab"))
    with pytest.raises(ValueError, match="vocab"):
        Index.load(spark, str(tmp_path / "ix"))


def test_patterns_are_tried_on_the_vocabulary(spark, tmp_path):
    Index(documents(docs(spark, {i: f"word{i} other" for i in range(30)}))).save(str(tmp_path / "ix"))
    index = Index.load(spark, str(tmp_path / "ix"))
    assert ids(S.results(index, "word1*", PLAIN, 0, "local")) == [1, *range(10, 20)]
    assert ids(S.results(index, "word2 OR word3", PLAIN, 0, "local")) == [2, 3]
    plan = S.results(index, "word2", PLAIN, 0, "local")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "content#" not in plan


def test_cross_source_copies_go_at_any_number(spark):
    rng = random.Random(5)
    texts = {i: " ".join(f"w{rng.randrange(5000)}" for _ in range(60)) + " shared" for i in range(300)}
    local = documents(docs(spark, texts))
    web = documents(docs(spark, {1000 + i: t for i, t in texts.items() if i % 2} | {5000: "shared alone here"}, url=F.concat(F.lit("https://e.org/"), F.col("doc_id")), domain=F.lit("e.org")))
    assert ids(S.results(Index(local.unionByName(web)), "shared", Ranking(vector_weight=0.0), 0, "both")) == [*range(300), 5000]


def test_within_is_exact_for_any_distance(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = [x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(16))) for x in base for _ in range(6)]
    df = spark.createDataFrame([(i, p >> 32, p & 0xFFFFFFFF) for i, p in enumerate(prints)], "doc_id bigint, hi bigint, lo bigint")
    for bits in (0, 3, 12, 18):
        want = {(i, j) for i, x in enumerate(prints) for j, y in enumerate(prints) if i % 3 == 0 and bin(x ^ y).count("1") <= bits}
        assert {(r.a, r.b) for r in dedup.within(df.filter("doc_id % 3 = 0"), df, bits).collect()} == want
        assert {(r.a, r.b) for r in dedup.near_pairs(df, bits).collect()} == {(i, j) for i, x in enumerate(prints) for j, y in enumerate(prints) if i < j and bin(x ^ y).count("1") <= bits}


def edited(rng, words, share):
    return [f"n{rng.randrange(9999)}" if rng.random() < share else w for w in words]


def test_near_copies_and_duplicates(spark):
    rng = random.Random(7)
    base = [[f"w{rng.randrange(3000)}" for _ in range(200)] for _ in range(20)]
    texts = [(i, " ".join(w)) for i, w in enumerate(base)] + [(100 + i, " ".join(edited(rng, w, 0.02))) for i, w in enumerate(base)] + [(200, " ".join(base[0])), (201, ""), (202, None), (203, "short text")]
    rows = spark.createDataFrame(texts, "doc_id bigint, content string").withColumn("exact_hash", T.exact_hash(F.col("content")))
    prints = dedup.sketched(rows, keep=("exact_hash",))
    found = {r.doc_id: r.duplicate_of for r in dedup.near_copies(prints).collect()}
    near = {(r.a, r.b) for r in dedup.near_pairs(prints.filter("doc_id <= 200")).collect()}
    assert found[200] == 0 and all((a, d) in near for d, a in found.items())
    assert sum(100 + i in found for i in range(20)) >= 0.9 * sum((i, 100 + i) in near for i in range(20))
    first = {r.doc_id: r.duplicate_of for r in dedup.find_duplicate(prints, prints).collect()}
    assert first[200] == 0 and first[0] == 200 and first[203] is None and set(first) == {d for d, _ in texts}


def page(i, body, links=""):
    return (i, f"https://site{i % 3}.org/p{i}", f"<html><head><title>t{i}</title></head><body><h1>Head {i}</h1><p>{body}</p>{links}</body></html>")


def test_crawl_counts_every_fate(spark):
    rng = random.Random(8)
    body = lambda: " ".join(f"w{rng.randrange(4000)}" for _ in range(400))
    same = body()
    pages = spark.createDataFrame([page(i, same if i in (4, 8) else body()) for i in range(12)], "page_id bigint, url string, html string")
    row = crawl.report(pages, Crawl(max_pages_per_domain=3), copies=False).first()
    assert (row.fetched, row.budget, row.duplicate, row.indexed, row.domains) == (12, 3, 1, 8, 3)
    assert crawl.documents(pages, 5).count() == 12 and crawl.documents(pages, 5, copies=False).count() == 11
    allowed = crawl.report(pages, Crawl(allowed_domains=("site0.org",), max_pages_per_domain=0)).first()
    assert (allowed.domain, allowed.indexed) == (8, 4)
    rules = crawl.robots_rules(spark.createDataFrame([("site1.org", "User-agent: *\nDisallow: /p1\n")], "domain string, body string"))
    known = pages.withColumn("etag", F.lit("a")).filter("page_id < 3").select("url", "etag")
    row = crawl.report(pages.withColumn("etag", F.lit("a")), robots=rules, known=known).first()
    assert (row.robots, row.unchanged, row.indexed) == (2, 2, 8)


def test_discovery_and_frontier(spark, tmp_path):
    bodies = [("sitemap", "<urlset><url><loc>https://a.org/1?utm_source=x</loc></url></urlset>"), ("sitemap", "<sitemapindex><sitemap><loc>https://a.org/more.xml</loc></sitemap></sitemapindex>"), ("feed", "<rss><channel><item><title>t</title><link>https://b.org/2</link></item></channel></rss>"), ("feed", None)]
    found = crawl.found_in(spark.createDataFrame(bodies, "kind string, body string"))
    assert sorted((r.url, r.kind, r.domain) for r in found.collect()) == [("https://a.org/1", "sitemap", "a.org"), ("https://a.org/more.xml", "sitemap_index", "a.org"), ("https://b.org/2", "feed", "b.org")]
    assert {r.url: r.priority for r in crawl.discovered(spark, {"seed": found.select("url"), "link": found.select("url")}).collect()}["https://b.org/2"] == 100
    frontier = crawl.due(spark.createDataFrame([("https://a.org/1", "a.org", 10), ("https://a.org/1", "a.org", 50), ("https://b.org/2", "b.org", 10)], "url string, domain string, fetched_unix bigint"), 100, 60)
    assert [r.url for r in frontier.collect()] == ["https://b.org/2"]
    path = str(tmp_path / "frontier")
    assert crawl.load_frontier(spark, path) is None
    for k in range(4):
        crawl.save_frontier(frontier.withColumn("seq", F.lit(k)), frontier.select("url"), path)
    again, seen = crawl.load_frontier(spark, path)
    assert [r.seq for r in again.collect()] == [3] and seen.count() == 1


def test_logs_and_cache(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "query string, ts bigint"
    assert store.read_log(spark, path, schema).count() == 0
    for t in (1_700_000_000, 1_700_100_000):
        store.append(spark.createDataFrame([("q", t)], schema), path)
    assert store.read_log(spark, path, schema).count() == 2 and store.read_log(spark, path, schema, "2023-11-15").count() == 1
    assert suggest.history(store.read_log(spark, path, schema)).first().times == 2
    cache = store.ResultCache(spark, str(tmp_path / "cache"), entries=2)
    one, two = store.cache_key("a", "web", principal="ann"), store.cache_key("a", "web")
    assert one != two == store.cache_key(" a ", "web", groups=[]) and cache.get(one, 0) is None
    cache.put(one, spark.range(3), 100)
    assert cache.get(one, 129).count() == 3 and cache.get(one, 130) is None and cache.get(two, 101) is None
    for k in range(3):
        cache.put(store.cache_key(str(k), "web"), spark.range(k), 101 + k)
    assert cache.get(one, 104) is None and cache.get(store.cache_key("2", "web"), 104).count() == 2
    cache.clear()
    assert cache.get(store.cache_key("2", "web"), 104) is None


def test_sealed_lists_are_spread_and_kept(spark, tmp_path):
    postings = spark.createDataFrame([("common", i) for i in range(25)] + [("rare", 3)], "term string, doc_id bigint")
    key = secure.key_from("a passphrase of many bytes")
    sealed = secure.build(postings, key, list_docs=10)
    assert sealed.count() > 2
    secure.save(sealed, str(tmp_path / "sealed"))
    again = secure.load(spark, str(tmp_path / "sealed"))
    assert ids(secure.lookup(again, key, "Common")) == list(range(25)) and ids(secure.lookup_all(again, key, ["common", "rare"])) == [3]


def small_pdf():
    content = b"BT /F1 12 Tf 72 720 Td (Hello \\(PDF\\)) Tj 0 -14 Td [(wor) -20 (ld) -300 (apart)] TJ T* <0041> Tj ET"
    packed = zlib.compress(content)
    table = b"1 beginbfchar <0041> <00e9> endbfchar"
    return b"%PDF-1.4\n1 0 obj\n<< /Length 1 /Filter /FlateDecode >>\nstream\n" + packed + b"\nendstream\nendobj\n2 0 obj\n<< /Length 40 >>\nstream\n" + table + b"\nendstream\nendobj\n%%EOF"


def small_jpeg():
    text = b"A red barn\0"
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x010E, 2, len(text), 26) + struct.pack("<I", 0) + text
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xd9"


def test_pdf_and_image_texts():
    assert formats.text_of("pdf", small_pdf()) == "Hello (PDF)\nworld apart\n\u00e9"
    assert formats.text_of("image", small_jpeg()) == "description: A red barn"
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"tEXt", b"Title\0A map") + chunk(b"iTXt", b"Comment\0\1\0\0\0" + zlib.compress("vu d'été".encode())) + chunk(b"IEND", b"")
    assert formats.text_of("image", png) == "title: A map\ncomment: vu d'été"
    for junk in (b"", b"%PDF-1.4 nothing", b"\xff\xd8\xff\xe1\0", b"\x89PNG\r\n\x1a\n\0\0"):
        assert formats.text_of("pdf", junk) == "" and formats.text_of("image", junk) == ""


def test_commands(spark, tmp_path, capsys):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.txt").write_text("Rust programming notes by Ann Smith and Bob Jones today")
    (folder / "b.md").write_text("# Python\n\nAnn Smith writes rust and python")
    (folder / "c.pdf").write_bytes(small_pdf())
    base = ["--index", str(tmp_path / "ix")]
    assert cli.main([*base, "index", str(folder)], spark) == [{"documents": 3}]
    assert {r["path"].rsplit("/", 1)[1] for r in cli.main([*base, "search", "rust"], spark)} == {"a.txt", "b.md"}
    assert [r["path"].rsplit("/", 1)[1] for r in cli.main([*base, "search", "hello", "--explain"], spark)] == ["c.pdf"]
    (folder / "a.txt").write_text("nothing of it")
    cli.main([*base, "update", str(folder)], spark)
    assert {r["path"].rsplit("/", 1)[1] for r in cli.main([*base, "search", "rust"], spark)} == {"b.md"}
    assert cli.main([*base, "suggest", "pyt"], spark)[0]["term"] == "python" and cli.main([*base, "spell", "pythom"], spark)[0]["term"] == "python"
    assert sum(r["files"] for r in cli.main([*base, "stats"], spark)) == 3
    assert cli.main([*base, "view", str(folder / "b.md")], spark)[0]["text"].startswith("Python")
    with pytest.raises(PermissionError):
        cli.main([*base, "view", "/etc/passwd"], spark)
    assert cli.main(["answer", "2 + 3"])[0]["answer"].endswith("= 5") and "SearchDescription" in cli.main(["opensearch", "http://localhost"])[0]["xml"]
    assert cli.main([*base, "benchmark", "--iterations", "2"], spark)[0]["iterations"] == 2
    assert cli.main([*base, "remove", str(folder)], spark) == [{"documents": 0}]
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1]) == {"documents": 0}
    (tmp_path / "link").symlink_to("/etc/passwd")
    with pytest.raises(PermissionError):
        cli.safe_path(str(tmp_path / "link"), [str(tmp_path)])
    assert cli.safe_path(str(folder / "../files/b.md"), [str(folder)]) == str((folder / "b.md").resolve())


def test_entities_by_name_and_source(spark):
    rows = entities.mentions(spark.createDataFrame([(1, "we met Sarah Chen at Acme Corporation today", 5), (2, "so Sarah Chen left", 9), (3, "mail a.b@c.org and foo_bar MyType x::y", 7)], "doc_id bigint, content string, modified_unix bigint"))
    assert {(r.doc_id, r.name, r.kind) for r in rows.collect()} >= {(1, "Sarah Chen", "proper_noun"), (2, "Sarah Chen", "proper_noun"), (3, "a.b@c.org", "email"), (3, "foo_bar", "code"), (3, "MyType", "code"), (3, "x::y", "code")}
    assert entities.entity(rows, "Sarah Chen").first().n == 2 and entities.entity(entities.without_source(rows, spark.createDataFrame([(2,)], "doc_id bigint")), "Sarah Chen").first().n == 1
    kinds = spark.createDataFrame([(1, "note"), (2, "web_page")], "doc_id bigint, source_kind string")
    assert suggest.frequent_kind(spark.createDataFrame([(1, 5), (2, 3)], "doc_id bigint, n bigint"), kinds).first().source_kind == "note"


def test_file_permissions(tmp_path):
    (tmp_path / "x").write_text("a")
    for mode, public in ((0o644, True), (0o600, False)):
        (tmp_path / "x").chmod(mode)
        assert files.local_acl(str(tmp_path / "x"))["public"] is public


def test_texts_are_read_for_what_is_asked(spark, small):
    """A change gives documents without reading words; a search without fingerprints or vectors makes none, and both are there when asked for."""
    from siftspark.operators.index import analysed
    from siftspark.plans.corpus import local_docs, local_index
    from siftspark.plans.registry import QUERIES

    assert "MapInArrow" not in QUERIES["live_changes"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    index, whole = local_index(spark, small), Index(analysed(documents(local_docs(spark, small))))
    assert not {"hi", "lo", "buckets", "weights"} & set(index.docs.columns) and {"terms", "token_count"} <= set(index.docs.columns)
    for table in ("fingerprints", "vectors", "postings", "stats"):
        mine, other = getattr(index, table), getattr(whole, table)
        assert mine.columns == other.columns and mine.exceptAll(other).count() == 0 == other.exceptAll(mine).count()
    new = local_docs(spark, small).limit(3).withColumn("content", F.lit("fresh words"))
    after = index.upsert(new)
    assert after.docs.count() == index.docs.count() and after.fingerprints.count() == after.docs.count()
