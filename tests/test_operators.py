import io
import sqlite3
import zipfile

from pyspark.sql import functions as F

from siftspark import config
from siftspark.operators import answers, classify, crawl, dedup, entities, links, merge, metrics, personal, secure, snippets, suggest
from siftspark.sources import files, formats, html
from siftspark.streaming import live


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_pagerank(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "doc_id bigint")
    edges = spark.createDataFrame([(0, 1), (2, 1), (0, 1), (3, 3), (0, 99)], "src bigint, dst bigint")
    rank = {r.doc_id: r["rank"] for r in links.pagerank(nodes, edges).collect()}
    assert max(rank, key=rank.get) == 1 and abs(sum(rank.values()) - 1) < 1e-6
    assert links.pagerank(nodes.limit(0), edges).count() == 0


def test_survivors_match_a_loop(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (4, 5), (1, 6), (6, 7)]
    kept = []
    for d in range(1, 9):
        if not any((k, d) in pairs for k in kept):
            kept.append(d)
    got = dedup.survivors(spark.createDataFrame([(i,) for i in range(1, 9)], "doc_id bigint"), spark.createDataFrame(pairs, "a bigint, b bigint"))
    assert sorted(r.doc_id for r in got.collect()) == kept


def test_find_duplicate(spark):
    f = spark.createDataFrame([(1, "x", 0, 0, [5, 6]), (2, "y", 0, 7, [5, 9]), (3, "x", 255, 255, [7]), (4, "z", -1 & 0xFFFFFFFF, 0, [5])], "doc_id bigint, exact_hash string, hi bigint, lo bigint, sketch array<bigint>")
    assert rows(dedup.find_duplicate(f, f)) == [(1, 3), (2, 1), (3, 1), (4, None)]


def test_merge_and_peers(spark):
    none = F.array().cast("array<string>")
    acl = F.struct(F.lit(None).cast("string").alias("owner"), none.alias("allowed_principals"), none.alias("allowed_groups"), F.lit(True).alias("public"))
    data = [("l1", "local_file", 6.0), ("l2", "local_file", 6.1), ("l3", "local_file", 20.0), ("w1", "web_page", 1.0), ("w2", "web_page", 1.05), ("n", "note", 3.0)]
    out = merge.merge(spark.createDataFrame(data, "id string, source string, raw_score double").withColumn("acl", acl)).collect()
    assert out[0].id == "l3" and {r.id: r.normalized_score for r in out}["n"] == 0.0


def test_entities(spark):
    found = entities.extract("Yesterday Sarah Chen met sarah@x.org yesterday. Then my_func and camelCase ran os::path in Berlin.")
    assert {("Yesterday Sarah Chen", "proper_noun"), ("sarah@x.org", "email"), ("my_func", "code"), ("camelCase", "code"), ("os::path", "code"), ("Berlin", "proper_noun")} <= set(found)
    m = entities.mentions(spark.createDataFrame([(1, "we saw Ann Lee and Bo Ray", 5), (2, "and Ann Lee again", 9), (3, None, 1)], "doc_id bigint, content string, modified_unix bigint"))
    assert rows(entities.cooccurrence(m)) == [("Ann Lee", "Bo Ray", 1)]
    assert [r.doc_id for r in entities.sources_mentioning(m, "Ann Lee", 0, 9).collect()] == [2, 1]
    assert entities.top_entities(m).first().name == "Ann Lee"


def test_metrics(spark):
    imp = spark.createDataFrame([("s", "a", 0), ("s", "b", 100), ("t", "a", 0)], "session_id string, query string, ts bigint")
    clk = spark.createDataFrame([("s", "a", 5, 45.0), ("s", "a", 6, None)], "session_id string, query string, ts bigint, dwell_seconds double")
    r = metrics.click_through(imp, clk).first()
    assert abs(r.ctr - 1 / 3) < 1e-9 and abs(r.ctr + r.abandonment - 1) < 1e-9
    assert metrics.reformulation(imp).first()[0] == 1.0 and metrics.long_clicks(clk).first()[0] == 1.0
    assert metrics.click_through(imp.limit(0), clk).first().abandonment == 1.0
    judged = metrics.sample_judgements(spark)
    best = judged.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query ORDER BY grade DESC, doc_id)")).select("query", "doc_id", "rank")
    perfect = metrics.suite(metrics.relevance(best, judged))
    assert round(perfect.first().mean_ndcg, 9) == 1.0
    worse = metrics.suite(metrics.relevance(best.filter("rank > 1").withColumn("rank", F.col("rank") - 1), judged))
    assert metrics.regression(perfect, worse).first().passed is False
    again = metrics.run_suite(judged, lambda q: best.filter(F.col("query") == q))
    assert again.first() == perfect.first()


def test_classifiers(spark):
    page = {"url": "http://paypal-secure-login.example.net/", "title": "Sign in", "description": "", "headings": [], "paragraphs": ["enter your password, act now, claim your prize with a gift card"], "alts": [], "links": [{"href": "http://x/y.exe", "anchor": "", "nofollow": False}]}
    schema = "url string, title string, description string, headings array<string>, paragraphs array<string>, alts array<string>, links array<struct<href:string,anchor:string,nofollow:boolean>>"
    pages = spark.createDataFrame([page, page | {"url": "https://www.paypal.com/", "title": "", "paragraphs": []}, page | {"url": None, "title": None}], schema)
    out = classify.policy(classify.spam(pages), spark.createDataFrame([("example.net",)], "domain string")).collect()
    by = {r.url: r for r in out}
    bad, good = by[page["url"]], by["https://www.paypal.com/"]
    assert {f.category for f in bad.flags} == {"phishing", "scam"} and bad.filtered and bad.blocklisted
    assert not good.flags and good.thin_content == 0.85 and good.boilerplate == 0.6 and None in by


def test_suggestions(spark):
    vocab = spark.createDataFrame([("rust", 2), ("rusty", 1), ("rest", 0), ("dust", 1), ("elephant", 9)], "term string, df bigint")
    assert [r.term for r in suggest.complete(vocab, "RUS").collect()] == ["rust", "rusty"]
    assert [r.term for r in suggest.spelling(vocab, "rusk").collect()] == ["rust", "dust", "rest", "rusty"]
    assert suggest.spelling(vocab, "rust").count() == 0


def test_personal():
    w = personal.train([0.0] * 5, [(0, 0, 0.2, 0.9), (1, 0, 0.5, 0.1)], 1)
    assert w[1] > 0 and personal.train(w, [], None) == w


def test_answers(spark):
    assert (answers.answer("2+3*4"), answers.answer("-2^2"), answers.answer("1/0"), answers.answer("rust"), answers.answer("convert 10 km to m")) == ("2+3*4 = 14", "-2^2 = 4", None, None, "10 km = 10000 m")
    assert answers.bang("!W rust lang") == "https://en.wikipedia.org/wiki/Special:Search?search=rust%20lang" and answers.bang("!nope x") is None
    claims = [("The tower is 300 m tall", "The tower is 300 m tall and old"), ("The tower is 300 m tall", "The tower is 324 m tall"), ("The tower is not tall", "The tower is tall"), ("", "x"), ("Cats purr loudly", "Stocks fell")]
    verdicts = [r.verdict for r in answers.verify(spark.createDataFrame(claims, "claim string, span string").coalesce(1)).collect()]
    assert verdicts == ["supported", "unsupported", "unsupported", "indeterminate", "unsupported"]
    assert answers.permutation("2, 1, 3", 3) == [2, 1, 3] and answers.permutation("1 1 2", 3) is None
    assert answers.grounded("One fact. [1] No source. Two [2][9].", {1, 2}) == ("One fact. [1] Two [2][9].", [1, 2], 1)
    found = spark.createDataFrame([(1, "a.txt", "alpha"), (2, "b.txt", "beta")], "doc_id bigint, file_name string, content string")
    assert answers.ask(found, "q", lambda s, u: "2 1" if "Order" in s else "It is beta [1]. Nonsense.")[1:] == ([1], 1)


def test_sealed(spark):
    import hmac

    key = secure.key_from("sixteen bytes or more")
    p = spark.createDataFrame([("rust", 1), ("rust", 2), ("book", 2)], "term string, doc_id bigint")
    sealed = secure.build(p, key)
    assert sealed.filter(F.col("trapdoor") == hmac.new(key, b"rust", "sha256").hexdigest()).count() == 1
    assert [r.doc_id for r in secure.lookup(sealed, key, "Rust").collect()] == [1, 2] and [r.doc_id for r in secure.lookup_all(sealed, key, ["rust", "book"]).collect()] == [2]


def test_robots_sitemaps_feeds(spark):
    robots = spark.createDataFrame([("a", "User-agent: siftspark\nDisallow: /x\nAllow: /x/ok\nUser-agent: *\nDisallow: /"), ("b", "User-agent: *\nDisallow: /p # c\nCrawl-delay: 2")], "domain string, body string")
    urls = spark.createDataFrame([("a", "/x/1"), ("a", "/x/ok/1"), ("a", "/y"), ("b", "/p"), ("c", "/")], "domain string, path string")
    assert rows(crawl.robots_allowed(urls, crawl.robots_rules(robots))) == [("a", "/x/1", False), ("a", "/x/ok/1", True), ("a", "/y", True), ("b", "/p", False), ("c", "/", True)]
    assert crawl.parse_sitemap("http://a/1\nx\nhttps://b/2") == (["http://a/1", "https://b/2"], [])
    assert crawl.parse_feed('<feed><entry><title>T</title><link rel="self" href="n"/><link href="http://a"/></entry></feed>') == [("http://a", "T")]


def test_formats(tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="w"><w:p><w:t>Hello</w:t></w:p></w:d>')
        z.writestr("notes.txt", "inner text")
    assert formats.text_of("docx", buffer.getvalue()) == "Hello" and "inner text" in formats.text_of("zip", buffer.getvalue())
    assert formats.text_of("docx", b"broken") == "" and formats.text_of("pdf", b"%PDF") == ""
    mail = b"From x\nSubject: Quarterly numbers\nFrom: a@b.c\n\nbody\n"
    assert [m["subject"] for m in formats.mbox(mail + b"\n" + mail)] == ["Quarterly numbers"] * 2
    assert formats.json_text('{"a": {"b": "c"}, "d": [1, "e"]}') == "a b c d e" and formats.json_text("{") == "{"


def test_files_and_databases(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("# Title\ntext")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "b.txt").write_text("no")
    (tmp_path / "c.exe").write_text("no")
    found = files.documents(files.scan(spark, str(tmp_path))).collect()
    assert [(r.file_name, r.content) for r in found] == [("a.md", "Title\ntext")]
    with sqlite3.connect(tmp_path / "n.db") as db:
        db.execute("CREATE TABLE notes(id INTEGER, title TEXT, body TEXT)")
        db.execute("INSERT INTO notes VALUES (1, 'Grocery list', 'milk, eggs')")
    with sqlite3.connect(tmp_path / "h.db") as db:
        db.execute("CREATE TABLE urls(id INTEGER, url TEXT, title TEXT, visit_count INTEGER, last_visit_time INTEGER)")
        db.execute("INSERT INTO urls VALUES (1, 'http://a', 'A', 3, 13000000000000000)")
    files.register(spark)
    assert [r.text for r in spark.read.format("sqlite_text").load(str(tmp_path / "n.db")).collect()] == ["Grocery list milk, eggs"]
    assert spark.read.format("browser_history").load(str(tmp_path / "h.db")).first().visited_unix == 13000000000 - files.CHROMIUM_EPOCH


def test_html():
    page = html.extract('<html lang="EN"><head><title>A  b</title></head><body><nav><p>one two three</p></nav><h1>H <b>x</b></h1><p>para one two<p>second para here<a href="/x" rel="nofollow">l</a><img alt="pic"></body>')
    assert (page["title"], page["lang"], page["headings"], page["paragraphs"], page["alts"]) == ("A b", "en", ["H x"], ["para one two", "second para here"], ["pic"])
    assert page["links"] == [{"href": "/x", "anchor": "l", "nofollow": True}]


def test_snippets():
    text, n = snippets.snippet("x " * 100 + "Rust and COMPILER " + "y " * 100 + "rust", {"rust", "compiler"})
    assert n == 3 and "**rust** and **compiler**" in text and text.startswith("...") and text.endswith("...")
    assert snippets.snippet("nothing", {"rust"}) == ("nothing", 0)


def test_config(tmp_path):
    c = config.apply_profile(config.Config(), "Research").with_folder("/a").with_folder("/a")
    config.save(c, str(tmp_path / "c.json"))
    assert config.load(str(tmp_path / "c.json")) == c and config.load(str(tmp_path / "none")) == config.Config()


def test_titles_of_references_as_in_sql(spark, tmp_path):
    """&amp without its semicolon and &quot;: the queries give what their SQL gives, the extraction the text that HTML means."""
    import duckdb

    from siftspark.plans.registry import QUERIES, SQL
    from siftspark.sources.html import extract

    titles = ["a &amp;&amp; b&amp", "x = &quot;1&quot;", "plain\n  title", "&lt;b&gt; &amp;amp; &#233;"]
    rows = [(i, f"https://e.org/en/{i}", f'<html lang="en"><head><title>{t}</title></head><body><p>some words of a page</p><a href="/a">a</a></body></html>') for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("page_titles", "crawl_documents"):
        df = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, df.collect())) == sorted(db.sql(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall())
    assert [extract(r[2])["title"] for r in rows] == ["a && b&", 'x = "1"', "plain title", "<b> &amp; é"]


def test_within_by_blocks_is_every_pair(spark, monkeypatch):
    """Blocks of both sides, a family of equal fingerprints across batches, and bits of both halves."""
    import random

    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(40)]
    values = [b ^ sum(1 << x for x in rnd.sample(range(64), rnd.randrange(16))) for b in base for _ in range(6)] + [base[0]] * 30 + [0, (1 << 64) - 1]
    df = spark.createDataFrame([(i, v >> 32, v & 0xFFFFFFFF) for i, v in enumerate(values)], "doc_id bigint, hi bigint, lo bigint")
    want = sorted((a, b, (x ^ y).bit_count()) for a, x in enumerate(values) if a % 3 == 0 for b, y in enumerate(values) if (x ^ y).bit_count() <= 12)
    assert rows(dedup.within(df.filter("doc_id % 3 = 0"), df, 12)) == sorted(want, key=str)
    monkeypatch.setattr(dedup, "LEFT_ROWS", 20)
    monkeypatch.setattr(dedup, "RIGHT_ROWS", 50)
    assert rows(dedup.within(df.filter("doc_id % 3 = 0"), df, 12)) == sorted(want, key=str)
    plan = dedup.within(df, df, 12)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and rows(dedup.within(df.limit(0), df, 12)) == []


def test_texts_of_a_duplicate_search_are_read_once(spark, small):
    """Texts were read anew for each of the five uses of their fingerprints."""
    from siftspark.plans.registry import QUERIES

    for name in ("duplicates_found", "near_duplicates_documents"):
        assert "InArrow" not in QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    pages = spark.read.parquet(f"{small}/pages.parquet")
    assert "InArrow" not in crawl.documents(pages, 0, copies=False)._jdf.queryExecution().optimizedPlan().toString()
