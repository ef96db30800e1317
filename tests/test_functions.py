import random

import numpy as np

from pyspark.sql import functions as F

from siftspark.functions import batch as B
from siftspark.functions import scoring as S
from siftspark.functions import text as T
from siftspark.functions import urls as U


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_tokens(spark):
    words = one(spark, w=T.tokens(F.lit("Don't stop: v2.0, café_x 3,5 a.b -- ½")))[0]
    assert words[:6] == ["don't", "stop", "v2.0", "café_x", "3,5", "a.b"]
    assert [w for w, _, _ in T.words_of("don't stop: v2.0, café_x 3,5 a.b")] == words[:6]
    assert one(spark, w=T.tokens(F.lit(None).cast("string")))[0] is None
    assert one(spark, w=T.normalize(F.lit("ＡBC ﬁ")))[0] == "abc fi"


def test_words_of_wide_scripts(spark):
    """Each Han, Hiragana or Thai letter is a word, a run of Katakana is one, forms are folded; the same in Spark and in Python."""
    cases = {"我喜欢 搜索引擎": list("我喜欢搜索引擎"), "カタカナ語です": ["カタカナ", "語", "で", "す"], "abc漢字x ﬁle ＡＢＣ": ["abc", "漢", "字", "x", "file", "abc"], "ไทย": list("ไทย"), "한국어 말": ["한국어", "말"], "plain it's": ["plain", "it's"]}
    for text, want in cases.items():
        assert one(spark, w=T.tokens(F.lit(text)))[0] == want == [w for w, _, _ in T.words_of(T.normalize_word(text))]
    rows = [(i, t) for i, t in enumerate([*cases, None, ""])]
    got = {r.doc_id: (r.terms, r.tfs, r.token_count) for r in B.analysed(spark.createDataFrame(rows, "doc_id bigint, content string")).collect()}
    assert sorted(zip(*got[2][:2])) == [("abc", 2), ("file", 1), ("x", 1), ("字", 1), ("漢", 1)] and got[2][2] == 6 and got[6] == got[7] == ([], [], 0)


def test_postings_and_vectors_of_a_batch(spark):
    """Against plain Python, text by text, with texts larger than a portion."""
    import hashlib

    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "a", "cat", "Dog", "bird", "é", "x1"]) for _ in range(n)) for n in (0, 1, 4, 5, 6, 300, 2000)]
    B.PORTION_WORDS, before = 500, B.PORTION_WORDS
    try:
        rows = B.analysed(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, content string").coalesce(1)).collect()
    finally:
        B.PORTION_WORDS = before
    for r in rows:
        words = texts[r.doc_id].lower().split()
        want = {}
        for i, w in enumerate(words):
            if w not in T.STOP_WORDS:
                want.setdefault(w, []).append(i)
        assert dict(zip(r.terms, r.positions)) == want and dict(zip(r.terms, r.tfs)) == {k: len(v) for k, v in want.items()}
        v = {}
        for w in words:
            h = hashlib.md5(w.encode()).hexdigest()
            k = int(h[:8], 16) % 256
            v[k] = v.get(k, 0) + (1 if int(h[8], 16) % 2 == 0 else -1)
        norm = sum(x * x for x in v.values()) ** 0.5
        assert {k: round(x, 9) for k, x in zip(r.buckets, r.weights)} == {k: round(x / norm, 9) for k, x in v.items() if x}


def test_shingles_and_fingerprints(spark):
    rows = [(1, "a b c"), (2, ""), (3, None), (4, "a b c"), (5, " ".join(map(str, range(200)))), (6, " ".join(map(str, [*range(199), 999])))]
    found = {r.doc_id: (r.hi, r.lo) for r in T.simhash(spark.createDataFrame(rows, "doc_id bigint, content string")).collect()}
    assert found[1] == found[4] and found[2] == found[3] == (0, 0)
    distance = lambda a, b: bin(a[0] ^ b[0]).count("1") + bin(a[1] ^ b[1]).count("1")
    assert distance(found[5], found[6]) <= 18 < distance(found[1], found[5])


def test_chunks(spark):
    text = " ".join(f"w{i}" for i in range(760))
    rows = T.chunk_rows(spark.createDataFrame([(1, text), (2, "a b"), (3, ""), (4, None)], "doc_id bigint, content string")).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_index) for r in rows] == [(1, 0), (1, 1), (1, 2), (2, 0)]
    raw = text.encode()
    assert [raw[a:b].decode() for _, a, b in T.chunk_offsets(text)] == [r.chunk for r in rows[:3]]


def test_wildcards(spark):
    rng = random.Random(1)
    for _ in range(20):
        pattern = "".join(rng.choice("ab*?.") for _ in range(4))
        import fnmatch

        term = "".join(rng.choice("ab.") for _ in range(3))
        assert one(spark, x=F.lit(term).rlike(T.wildcard_pattern(pattern)))[0] == fnmatch.fnmatchcase(term, pattern)


def test_scores(spark):
    r = one(spark, rare=S.bm25(F.lit(1), F.lit(5), F.lit(1000), F.lit(100), F.lit(100.0)), common=S.bm25(F.lit(1), F.lit(900), F.lit(1000), F.lit(100), F.lit(100.0)), none=S.bm25(F.lit(0), F.lit(5), F.lit(1000), F.lit(100), F.lit(100.0)), new=S.recency(F.lit(50), F.lit(10), 1.1), old=S.recency(F.lit(0), F.lit(2592000), 1.1))
    assert r.rare > r.common > 0 == r.none and abs(r.new - 1.1) < 1e-9 and abs(r.old - 1.05) < 1e-9


def test_urls(spark):
    cases = {
        "HTTP://Example.COM:80/a/?b=2&a=1&utm_source=x#f": "http://example.com/a?a=1&b=2", "https://e.org:8443/": "https://e.org:8443/", "https://e.org": "https://e.org/", "nonsense": None,
    }
    assert {u: U.canonicalize(u) for u in cases} == cases
    assert U.resolve("http://a.org/b/c", "../d?ref=1") == "http://a.org/d" and U.resolve("http://a.org", "mailto:x@y.z") is None and U.resolve("http://a.org", "#x") is None
    r = one(spark, d=U.domain_of(F.lit("https://www.Example.com/x")), o=U.is_onion(F.lit("http://abc.onion:80/x")), n=U.is_onion(F.lit("http://x.org/a.onion")), m=U.query_map(F.lit("a=1&b=x%20y&a=2")))
    assert (r.d, r.o, r.n, r.m) == ("example.com", True, False, {"a": "2", "b": "x y"})
    assert U.parse_query_string("q=a+b&x") == {"q": "a b"}


def test_digests_are_md5():
    """Every length around the ends of blocks, and longer ranges."""
    from hashlib import md5

    raw = np.frombuffer(bytes(i * 7 % 251 for i in range(2000)), dtype=np.uint8)
    ranges = [(i % 90, i % 90 + n) for i, n in enumerate([*range(140), 191, 192, 1000])]
    got = B.digests_of(raw, *map(np.array, zip(*ranges)))
    assert [bytes(x) for x in got] == [md5(raw[a:b].tobytes()).digest()[:8] for a, b in ranges]


def test_words_of_a_pass_are_the_tokens(spark):
    """Whatever way a text takes (ASCII, composed letters, NFKC in Python, scripts without spaces), without runs of marks and low lines."""
    texts = ["Plain v2.0 words ___ a_b __", "Straße – “Écoles” 3,5 Łódź", "café ½ ﬁne ___ ́", "東京タワー に行く", "ไทย ำ", "", None, "___", "Ελλάδα и мир", "한국어 ㎏ x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string")
    got = {r.doc_id: (r.terms, r.token_count) for r in B.analysed(df).select("doc_id", "terms", "token_count").collect()}
    for r in df.select("doc_id", T.tokens(F.col("content")).alias("w")).collect():
        kept = [w for w in r.w or [] if w not in T.STOP_WORDS]
        assert (sorted(got[r.doc_id][0]), got[r.doc_id][1]) == (sorted(set(kept)), len(kept)), texts[r.doc_id]


def test_one_python_worker_and_small_portions(spark):
    """A text pass has no second Python step, and takes no more words at a time than it needs (at 0.1 GB it held 1 GB in four workers)."""
    df = spark.createDataFrame([(1, "é x")], "doc_id int, content string")
    plan = B.analysed(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan and B.PORTION_WORDS <= 1 << 17
