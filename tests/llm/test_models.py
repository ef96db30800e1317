"""Chat windows, language and main text: brute force, gradients and held-out accuracy."""

import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from siftspark.llm import chat, dom_crf, string_kernel
from siftspark.llm.tokens import tokenizer


def windows_by_hand(sizes, system, budget, history):
    out, new = [], 0
    while new < len(sizes):
        start = new
        while start > 0 and sum(sizes[start - 1 : new]) <= history:
            start -= 1
        if system + sum(sizes[start : new + 1]) > budget:
            start = new
        end = new + 1
        while end < len(sizes) and system + sum(sizes[start : end + 1]) <= budget:
            end += 1
        out.append((start, new, end))
        new = end
    return out


def test_spans_match_a_loop():
    rng = random.Random(1)
    for _ in range(400):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(0, 15))]
        args = rng.randint(0, 20), rng.randint(30, 80), rng.randint(0, 29)
        assert chat.spans(np.array(sizes, dtype=np.int64), *args) == windows_by_hand(sizes, *args)


def test_windows(spark):
    rng = random.Random(2)
    rows = []
    for c in range(12):
        if c % 2:
            rows.append((c, 0, "system", "be kind"))
        rows += [(c, t, ("user", "assistant")[t % 2], " ".join(rng.choice(["red", "green", "blue"]) for _ in range(rng.randint(0, 60)))) for t in range(1, rng.randint(2, 14))]
    rows += [(50, 0, "system", "alone"), (51, 1, None, None), (51, None, "assistant", "late"), (51, 2, "judge", "x"), (52, 1, "assistant", "w " * 500), (52, 2, "user", "hi"), (None, 1, "user", "lost"), (53, 1, "user", "twice"), (53, 1, "user", "twice")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"window": F.lit(1), "tokens": F.lit("clash")})
    budget, history, size = 120, 30, chat.VOCABULARY_SIZE
    got = sorted(chat.chat_windows(df, budget, history).collect(), key=lambda r: (r.conv_id, r.window))
    assert {r.conv_id for r in got} == {r[0] for r in rows} - {None}
    assert all(len(r.tokens) == r.n_tokens and (r.n_tokens <= budget or r.over_budget) for r in got)
    assert [(r.conv_id, r.n_history) for r in got if r.over_budget] == [(52, 0)]
    encode = tokenizer().encoding.encode_ordinary
    for c in {r.conv_id for r in got}:
        own = sorted({r for r in rows if r[0] == c}, key=lambda r: tuple((x is None, x) for x in r[1:]))
        targets = [t for r in got if r.conv_id == c for s in r.targets for t in r.tokens[s.start : s.end]]
        assert targets == [t for r in own if r[2] == "assistant" for t in [*encode(r[3] or ""), size + len(chat.ROLES) + 1]]
        system = next((r for r in own if r[2] == "system"), None)
        for r in got:
            if r.conv_id == c and system:
                assert r.tokens[: len(encode(system[3])) + 2] == [size, *encode(system[3]), size + len(chat.ROLES) + 1]
    assert chat.chat_windows(df.limit(0)).count() == 0


def test_language_on_unseen_rows(spark, small):
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    model = string_kernel.train(docs.filter("doc_id % 2 = 0"), 100, 64)
    test = docs.filter("doc_id % 2 = 1").withColumns({"language": F.lit("clash"), "score": F.lit(0)})
    out = string_kernel.identify(test, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.language == r.lang for r in out]) > 0.97


def test_language_scores_are_the_kernel_products():
    import pyarrow as pa

    rng = random.Random(4)
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(1, 200))) for a in ("abcd ", "cdef ") for _ in range(20)]
    spectrum = string_kernel.Spectrum()
    sets = [spectrum.of(np.frombuffer(t.encode(), np.uint8)) for t in texts]
    plain = [re.sub(" +", " ", t).lstrip() for t in texts]
    grams = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in plain]
    k = string_kernel.kernel(sets, sets)
    want = [[len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b))) for b in grams] for a in grams]
    assert np.abs(k - want).max() < 1e-5
    model = string_kernel.fit(sets, ["x"] * 20 + ["y"] * 20, 40)
    value, _ = string_kernel.scores(pa.array(texts), model, model.rows(), spectrum)
    assert [model.languages[i] for i in value.argmax(axis=1)] == ["x"] * 20 + ["y"] * 20
    known = [set(spectrum.of(np.frombuffer(t.encode(), np.uint8)).tolist()) for t in texts]
    weight = dict(zip(model.grams.tolist(), model.weights))
    one = np.array([sum((weight[g] for g in s if g in weight), np.zeros(2)) / np.sqrt(len(s)) for s in known]) + model.bias
    assert np.abs(one - value).max() < 1e-4
    many, _ = string_kernel.scores(pa.array(texts * 8), model, model.rows(), spectrum)
    assert np.abs(many - np.tile(value, (8, 1))).max() < 1e-6


def test_equal_scores_go_to_the_first_language():
    import pyarrow as pa

    model = string_kernel.Model(["a", "b"], np.array([97], dtype=np.int32), np.zeros((2, 2), dtype=np.float32), np.zeros(2))
    value, norm = string_kernel.scores(pa.array(["aaa", "", None]), model, model.rows(), string_kernel.Spectrum())
    assert value.argmax(axis=1).tolist() == [0, 0, 0] and norm.tolist() == [3, 0, 0]


def test_language_edges(spark):
    rows = [(1, "aaa bbb", "x"), (2, "ccc ddd", "y"), (3, None, "x"), (4, "", None), (5, "aaa", None), (5, "aaa", None), (None, "ddd", None), (6, "c" * 300_000, "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = sorted(((r.doc_id or 0, r.language) for r in string_kernel.identify(df, string_kernel.train(df)).collect()), key=str)
    assert got == sorted([(1, "x"), (2, "y"), (3, None), (4, None), (5, "x"), (5, "x"), (0, "y"), (6, "y")], key=str)
    assert {r.language for r in string_kernel.identify(df, string_kernel.train(df.filter("lang IS NULL"))).collect()} == {None}
    assert string_kernel.identify(df.limit(0), string_kernel.train(df)).count() == 0


def blocks(rng, n):
    return [dom_crf.Block("t", rng.random() < 0.5, sorted(rng.sample(range(8), 3))) for _ in range(n)]


def path_score(page, labels, w, m):
    return sum(w[f, y] for b, y in zip(page, labels) for f in b.features) + sum(m[a, b] for a, b in zip(labels, labels[1:]))


def test_field_matches_all_paths():
    rng, gen = random.Random(6), np.random.default_rng(6)
    pages = [blocks(rng, n) for n in (1, 4, 6, 2)]
    w, m = gen.normal(size=(dom_crf.N_FEATURES, 2)), gen.normal(size=(2, 2))
    chains = dom_crf.Chains(pages)
    labels = np.array([int(b.gold) for p in pages for b in p])
    value, gw, gm = dom_crf.log_likelihood(chains, labels, w, m)
    want, best, at = 0.0, [], 0
    for p in pages:
        paths = {y: path_score(p, y, w, m) for y in itertools.product((0, 1), repeat=len(p))}
        want += paths[tuple(labels[at : at + len(p)])] - np.log(sum(map(np.exp, paths.values())))
        best += max(paths, key=paths.get)
        at += len(p)
    assert abs(value - want) < 1e-9 and dom_crf.viterbi(chains, w, m).tolist() == best
    for x, g, i in ((w, gw, (3, 1)), (w, gw, (0, 0)), (m, gm, (0, 1))):
        y = x.copy()
        y[i] += 1e-5
        moved, _, _ = dom_crf.log_likelihood(chains, labels, *((y, m) if x is w else (w, y)))
        assert abs((moved - value) / 1e-5 - g[i]) < 1e-3


def test_main_text_of_unseen_pages(spark, small):
    pages = spark.read.parquet(f"{small.replace('0.001', '0.01')}/pages.parquet")
    model = dom_crf.train(pages.filter("page_id % 2 = 0"), 60)
    right = total = 0
    for r in pages.filter("page_id % 2 = 1").collect():
        found = dom_crf.blocks_of(r.html.replace("<article>", "<div>").replace("</article>", "</div>"))
        gold = [b.gold for b in dom_crf.blocks_of(r.html)]
        got = dom_crf.viterbi(dom_crf.Chains([found]), *model).tolist()
        right, total = right + sum(a == b for a, b in zip(got, gold)), total + len(gold)
    assert right / total > 0.95


def test_page_edges(spark):
    rows = [(1, None), (2, ""), (3, "no tags, just text"), (4, "<p>a<p>b<div>c</div><br"), (4, "<p>a"), (None, "<li>x"), (5, "<script>var a='<p>'</script>" + "<p>word</p>" * 20_000), (6, "<!-- open"), (7, "<a href='x'>" * 2000)]
    df = spark.createDataFrame(rows, "page_id bigint, html string").withColumns({"text": F.lit("clash"), "n_blocks": F.lit(0)})
    assert dom_crf.train(df) is None
    got = sorted(((r.page_id or 0, r.n_blocks) for r in dom_crf.extract(df, None).collect()))
    assert got == [(0, 1), (1, 0), (2, 0), (3, 1), (4, 1), (4, 3), (5, 20_000), (6, 0), (7, 0)]
    assert {r.page_id: r.text for r in dom_crf.extract(df.filter("page_id < 4"), None).collect()} == {1: None, 2: "", 3: "no tags, just text"}
    assert dom_crf.extract(df.limit(0), None).count() == 0


def test_unclosed_tags_lose_no_text():
    cases = {
        "<html><head><title>t</title><body><p>text": ["text"], "<head><meta x><title>t</title><p>text</p>": ["text"], "<head><title>t</title>text": ["text"], "<head><title>t<body>text": ["text"],
        "<head><noscript><img src=x><p>n</noscript><title>t</title></head><p>text": ["text"], "<div><svg><path d=x><text>5</div><p>text": ["text"], "<body><svg><path><p>text": ["text"],
        "<p>a <svg><g><a>x</a></g></svg> b": ["a b"], "<svg/><p>text": ["text"], "<noscript><p>text": ["text"], "<template><p>text": ["text"], "<iframe src=x><p>text": ["text"], "<div><iframe>x</div><p>text": ["x", "text"],
        "<p>a<noscript><p>n</noscript>b": ["ab"], "<p>a<iframe><p>n</p></iframe> b": ["a b"], "<svg><foreignObject><div>x</div></foreignObject></svg><p>b": ["b"], "<p>a<script>x<b>": ["a"], "<p>a<textarea><p>x<b>": ["a"],
    }
    for page, want in cases.items():
        assert [b.text for b in dom_crf.blocks_of(page)] == want, page


def test_deep_pages_take_linear_time():
    import time

    began = time.time()
    assert len(dom_crf.blocks_of("<div class='a b'>word" * 100_000)) == 100_000
    assert dom_crf.blocks_of("<svg>" + "<g>" * 100_000 + "</p>" * 100_000) == []
    assert time.time() - began < 30


def test_digits_count_over_the_whole_block():
    mark = dom_crf.text_features("12345", 0)[-1]
    assert mark in dom_crf.text_features("word " * 50 + "123456789 " * 50 + "x", 0)
    assert mark not in dom_crf.text_features("123456789 " * 20 + "word " * 400 + "x", 0)
