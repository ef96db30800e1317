"""The Jaccard join and the pipeline against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftspark.llm import decision_list, decontam, jaccard, linededup


def grams(text, n=3):
    w = (text or "").split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def by_hand(rows, threshold):
    out = {}
    sets = [(i, grams(t)) for i, t in rows if i is not None]
    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if i != j and x & y:
                s = len(x & y) / len(x | y)
                if s >= threshold - 1e-9:
                    k = (min(i, j), max(i, j))
                    out[k] = max(out.get(k, 0), round(s, 6))
    return out


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.6:
            w = rng.choice(texts[-40:]).split()
            for _ in range(rng.randint(0, max(1, len(w) // 8))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = " ".join(w)
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120)))
        texts.append(text)
        rows.append((i, text))
    rows += [(900, None), (901, ""), (902, "   "), (903, "one"), (904, "one"), (905, "one two"), (None, texts[0]), (906, texts[0]), (906, texts[0]), (906, "other text of the same id"), (907, " ".join(vocabulary * 800))]
    return rows


def components(nodes, pairs):
    root = {i: i for i in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in nodes}


def classes_by_hand(rows):
    """Documents of the same n-grams as often, by their lowest doc_id."""
    out = {}
    for i, t in rows:
        w = (t or "").split()
        if i is not None and w:
            key = tuple(sorted(tuple(w[k : k + 3]) for k in range(len(w) - 2))) or tuple(w)
            out.setdefault(key, set()).add(i)
    return out


def pairs_by_hand(rows, threshold):
    """Pairs of classes by their lowest members, and each class's lowest with its others."""
    classes = classes_by_hand(rows)
    lowest = {min(v) for v in classes.values()}
    text = {i: t for i, t in rows if i in lowest}
    out = {(min(v), i): 1.0 for v in classes.values() for i in v if i != min(v)}
    for k, v in by_hand(sorted(text.items()), threshold).items():
        out[k] = max(out.get(k, 0), v)
    return out


def links_by_hand(rows, threshold):
    """(class_id, n_links) of each doc_id; no doc_id may have two texts."""
    pairs = by_hand(rows, threshold)
    ids = {i for i, _ in rows if i is not None}
    root = components(ids, pairs)
    return {i: (root[i], sum(i in p for p in pairs)) for i in ids}


CLASHES = ("pivot", "pivots", "keys", "cell", "size", "group_id", "class_id", "places", "block", "rep", "gone", "a.b", "x y")


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in CLASHES})


@pytest.mark.parametrize("threshold", [0.3, 0.9, 1.0])
def test_join_is_exact(spark, threshold):
    rows = [r for r in corpus(3) if r[1] != "other text of the same id"]
    df = clashing(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.jaccard_join(df, threshold).collect()} == pairs_by_hand(rows, threshold)
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(df, threshold).collect()} == links_by_hand(rows, threshold)


@pytest.mark.parametrize("hot", [8, 1 << 40])
def test_large_groups_are_split_exactly(spark, monkeypatch, hot):
    """n-grams of many documents name their regions, regions are cut into tiles, large classes are broadcast: the same links."""
    rng = random.Random(9)
    base = [f"v{rng.randrange(400)}" for _ in range(80)]
    rows = [r for r in corpus(5, 120) if r[1] != "other text of the same id"]
    for i in range(1000, 1150):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(80)] = f"v{rng.randrange(400)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard, "TILE_BYTES", 6000)
    monkeypatch.setattr(jaccard, "HOT_COPIES", 3)
    monkeypatch.setattr(jaccard, "BUCKET_CELLS", 2000)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(df, 0.5, hot=hot).collect()} == links_by_hand(rows, 0.5)
    assert {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.jaccard_join(df, 0.5, hot=hot).collect()} == pairs_by_hand(rows, 0.5)


def test_many_copies_of_one_text(spark):
    text = " ".join(f"c{i}" for i in range(60))
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 3, F.concat(F.lit(text), F.lit(" end"), F.lit(" of it"))).otherwise(F.lit(text)).alias("text"))
    got = jaccard.near_duplicates(df).groupBy("class_id", "n_links").count().collect()
    assert [tuple(r) for r in got] == [(0, 19_999, 20_000)]


def test_a_document_of_several_texts_connects_them(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, one), (7, one), (7, two), (9, two), (9, two), (11, "alone here now"), (12, None), (12, ""), (None, one)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {5: (5, 1), 7: (5, 2), 9: (5, 1), 11: (11, 0), 12: (12, 0)}
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_blocks_hold_what_they_were_given():
    rng = np.random.default_rng(4)
    for n, top in ((1, 5), (300, 1 << 48), (300, 3), (5000, 1 << 30)):
        cell = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        ids, size = rng.integers(0, 1 << 48, 40), rng.integers(1, 1 << 20, 40)
        who = rng.integers(0, 40, n)
        c, i, s = jaccard.unpack_block(jaccard.pack_block(cell, ids, size, who))
        assert (c == cell).all() and (i == ids[who]).all() and (s == size[who]).all()


def test_regions_divide_exactly(monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 8)
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    rng = np.random.default_rng(2)
    centres = [rng.integers(0, 400, 40) for _ in range(12)]
    sets = []
    for _ in range(300):
        c = centres[rng.integers(12)]
        sets.append(np.unique(np.where(rng.random(40) < 0.15, rng.integers(0, 400, 40), c)).astype(np.uint64))
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.5}
    for left in (None, 120):
        found = []
        jaccard.join_region(sets, 0.5, lambda i, j, s: found.extend(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist())), left)
        expected = want if left is None else {(a, b) for a, b in want if a < left <= b}
        assert set(found) == expected and len(found) == len(expected)


@pytest.mark.parametrize("dense", [0, 8, 1 << 40])
def test_overlaps_of_blocks_by_hand(monkeypatch, dense):
    """Keys of many sets as matrices, the others pair by pair, in several steps of each."""
    monkeypatch.setattr(jaccard, "DENSE", dense)
    monkeypatch.setattr(jaccard, "MATRIX", 400)
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, rng.choice([30, 3000]), rng.integers(0, 40))).astype(np.uint64) for _ in range(60)]
    x, y = rng.permutation(60)[:25], rng.permutation(60)[:33]
    assert (jaccard.Incidence(sets).overlaps(x, y) == [[len(np.intersect1d(*(np.array([k for k in sets[e] if sum(k in s for s in sets) > 1]) for e in (i, j)))) for j in y] for i in x]).all()


@pytest.mark.parametrize("patterns", [0, 1 << 11])
def test_lower_pivots_by_hand(monkeypatch, patterns):
    monkeypatch.setattr(jaccard, "PATTERNS", patterns)
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(-3, 12, rng.integers(1, 4))) for _ in range(40)]
    i, j = rng.integers(0, 40, 500), rng.integers(0, 40, 500)
    assert jaccard.disjoint(sets)(i, j).tolist() == [not set(sets[a].tolist()) & set(sets[b].tolist()) for a, b in zip(i, j)]


def test_keys_of_a_large_family_are_sorted_once(monkeypatch):
    """A family's pairs grow with the square of its members; the keys of each block of pairs aren't sorted anew."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 56, 400)
    sets = [np.unique(np.where(rng.random(400) < 0.05, rng.integers(0, 1 << 56, 400), base)).astype(np.uint64) for _ in range(1500)]
    done, found = [], []
    for name in ("unique", "argsort", "sort"):
        monkeypatch.setattr(np, name, lambda x, *args, f=getattr(np, name), **more: (done.append(len(x)), f(x, *args, **more))[1])
    jaccard.join_region(sets, 0.5, lambda i, j, s: found.append(len(i)))
    assert sum(found) == 1500 * 1499 // 2 and sum(done) < 3 * sum(len(x) for x in sets)


def test_one_of_each_group_stays(spark):
    rows = corpus(8)
    df = clashing(spark.createDataFrame(rows, "doc_id bigint, text string"))
    root = components({i for i, _ in rows if i is not None}, by_hand(rows, jaccard.THRESHOLD))
    kept = jaccard.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i is None or root[i] == i)
    assert jaccard.drop_near_duplicates(df.limit(0)).count() == 0


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near duplicates", "decontamination", "packing"]
    kept = []
    for (name, stage), last in zip(corpus_pipeline.STAGES, [False] * 4 + [True]):
        after = stage(spark, docs, small).cache()
        if not last:
            assert after.columns == docs.columns, name
            assert after.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
            kept.append((docs.collect(), after.collect()))
        else:
            final = after.collect()
        docs = after
    (a0, a1), (b0, b1), (c0, c1), (d0, d1) = kept
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rules = decision_list.train(spark.createDataFrame(a0), labels)
    judged = {r.doc_id for r in decision_list.judge(spark.createDataFrame(a0), rules).filter("keep").collect()}
    assert {r.doc_id for r in a1} == judged and set(a1) <= set(a0)
    from tests.llm.test_filters import lines_by_hand

    want = lines_by_hand([(r.doc_id, r.source, r.text) for r in b0], linededup.RATIO, linededup.MIN_PAGES)
    assert sorted(((r.doc_id, r.source, r.text) for r in b1), key=str) == sorted((w[:3] for w in want), key=str) and all(r.n_chars == len(r.text) for r in b1)
    pairs = by_hand([(r.doc_id, r.text) for r in c0], jaccard.THRESHOLD)
    left = {r.doc_id for r in c1}
    assert not any(a in left and b in left for a, b in pairs) and {r.doc_id for r in c0} - left <= {b for _, b in pairs}
    hits = {r.doc_id for r in decontam.pairs(spark.createDataFrame(d0), spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in d1} == {r.doc_id for r in d0} - hits and hits
    from siftspark.llm.tokens import tokenizer

    encode = tokenizer().encoding.encode_ordinary
    by = {}
    for r in sorted(final, key=lambda r: r.piece):
        by.setdefault(r.doc_id, []).extend(r.tokens)
    assert by == {r.doc_id: encode(r.text) for r in d1 if r.text}


def odd_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(None, "no id at all here", "en", "s", 17), (7001, None, "en", "s", 0), (7002, "", "en", None, 0), (7003, "x", None, "s", 1), (7003, "x", None, "s", 1), (7004, " ".join(f"w{i % 5000}" for i in range(200_000)), "en", "s", 1)]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema)).withColumns({c: F.lit(1) for c in ("a.b", "x y", "gone", "rule", "lines", "pivot", "size", "item_id", "_row", "tokens")})


def test_pipeline_on_odd_tables(spark, small, tmp_path):
    """Nulls, empties, repeats, a text of a million signs and clashing names go through every stage; an empty table gives none."""
    for name in ("labels", "benchmark"):
        table = spark.read.parquet(f"{small}/{name}.parquet")
        table.withColumns({c: F.lit(2) for c in ("a.b", "q_n_words", "score", "source")}).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = odd_documents(spark, small)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns and after.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        docs = after
    packed = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert len(packed) > 50


def test_quality_and_decontamination_stages_by_hand(spark, small):
    """The rules that were learned and the alignment, applied row by row in plain Python."""
    import re

    from tests.llm.test_filters import align_by_hand, words

    docs = spark.read.parquet(f"{small}/documents.parquet")
    rules = decision_list.train(docs, spark.read.parquet(f"{small}/labels.parquet"))

    def statistics(t):
        w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", t) if x]
        n, chars = max(len(w), 1), max(len(t), 1)
        return {
            "n_words": len(w), "mean_word": len(t) / n, "variety": 1.0 if len(w) < 2 else np.log(len(set(w))) / np.log(len(w)), "short_words": sum(len(x) <= 3 for x in w) / n, "bare_marks": sum(not any(c.isalnum() for c in x) for x in w) / n,
            "marks": sum(not (c.isalnum() or c.isspace()) for c in t) / chars, "capitals": sum(c.isupper() for c in t) / chars, "digits": sum(c in "0123456789" for c in t) / chars, "mean_line": len(t) / (t.count("\n") + 1),
        }

    rows = docs.collect()
    kept = {r.doc_id for r in rows if not any(all((statistics(r.text)[c.name] >= c.bound) == c.at_least for c in rule) for rule in rules)}
    assert {r.doc_id for r in corpus_pipeline.quality(spark, docs, small).collect()} == kept != {r.doc_id for r in rows}
    items = [words(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    grams = [{tuple(i[k : k + 3]) for k in range(len(i) - 2)} for i in items]
    gone = set()
    for r in rows:
        w = words(r.text)
        own = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
        if any(len(own & g) >= 1 and align_by_hand(w, i) >= decontam.THRESHOLD * 2 * len(i) for i, g in zip(items, grams) if len(w) < 4000):
            gone.add(r.doc_id)
    left = {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, small).collect()}
    assert {r.doc_id for r in rows} - left >= gone and gone and all(len(words(r.text)) >= 4000 for r in rows if r.doc_id not in left | gone)
