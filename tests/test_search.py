"""Behaviour of search over small indexes."""

import pytest
from pyspark.sql import functions as F

from siftspark.config import Ranking
from siftspark.operators import search as S
from siftspark.operators.index import Index, documents, public_acl

PLAIN = Ranking(vector_weight=0.0)
TEXTS = {1: "the rust language is fast", 2: "rust the language book", 3: "rust language rust language", 4: "python snakes", 5: "", 6: None, 7: "language of rust_lang tools"}


def docs(spark, texts, **more):
    rows = [(i, f"/d/{i}.txt", f"{i}.txt", "txt", len(t or ""), 1000 * i, t) for i, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id bigint, path string, file_name string, extension string, size_bytes bigint, modified_unix bigint, content string")
    return df.withColumn("acl", public_acl()).withColumns(more)


@pytest.fixture(scope="module")
def index(spark):
    return Index(documents(docs(spark, TEXTS)))


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


@pytest.mark.parametrize(
    ("query", "found"),
    [
        ("rust", [1, 2, 3]), ("rust language", [1, 2, 3]), ("rust the", []), ('"rust language"', [1, 3]), ('"rust the language"', []), ('"rust"', [1, 2, 3]), ('""', []), ("rust -fast", [2, 3]), ("snak*", [4]),
        ("r?st*", [1, 2, 3, 7]), ("rusd~1", [1, 2, 3]), ("-rust", [4, 5, 6, 7]), ("python OR fast", [1, 4]), ("python OR -language", [4, 5, 6]), ("size<5", [5, 6]), ("name:4", [4]), ("missing OR missing2", []), ("rust_lang", [7]),
    ],
)
def test_matches(index, query, found):
    assert ids(S.results(index, query, PLAIN, 10_000, "local")) == found


def test_repeated_word_doubles_frequency(index):
    tf = {r.doc_id: r.terms[0].tf for r in S.results(index, "rust rust", PLAIN, 0, "local").collect()}
    assert tf == {1: 2, 2: 2, 3: 4}


def test_filter_only_scores_nothing(index):
    assert {r.score for r in S.results(index, "ext:txt", PLAIN, 0, "local").collect()} == {0.0}


def test_paging_is_stable(index):
    found = S.results(index, "rust OR python OR language", PLAIN, 0, "local")
    whole = [r.doc_id for r in S.page(found, 10).collect()]
    assert [r.doc_id for r in S.page(found, 2).collect()] + [r.doc_id for r in S.page(found, 8, 2).collect()] == whole


def test_modes_and_safety(spark):
    local = documents(docs(spark, {1: "rust tools"}))
    web = documents(docs(spark, {2: "rust web", 3: "rust onion", 4: "rust bad"}, url=F.when(F.col("doc_id") == 3, "http://x.onion/").otherwise("https://example.com/"), domain=F.lit("example.com"), policy_flag=F.when(F.col("doc_id") == 4, F.struct(F.lit("scam").alias("category"), F.lit(0.75).alias("confidence")))))
    index = Index(local.unionByName(web))
    assert {m: ids(S.results(index, "rust", PLAIN, 0, m)) for m in ("local", "web", "tor", "both")} == {"local": [1], "web": [2], "tor": [3], "both": [1, 2]}


def test_acl(spark):
    acl = F.struct(F.lit("ann").alias("owner"), F.array(F.lit("bob")).alias("allowed_principals"), F.array(F.lit("team")).alias("allowed_groups"), F.lit(False).alias("public"))
    index = Index(documents(docs(spark, {1: "rust"}, acl=acl)))
    see = lambda **who: ids(S.results(index, "rust", PLAIN, 0, "local", **who))
    assert see() == see(principal="ann") == see(principal="bob") == see(principal="eve", groups=["team"]) == [1]
    assert see(principal="eve") == see(groups=["other"]) == []


def test_cross_source_copies_leave_the_local_one(spark):
    text = " ".join(f"word{i}" for i in range(60))
    web = documents(docs(spark, {2: text}, url=F.lit("https://example.com/a"), domain=F.lit("example.com")))
    index = Index(documents(docs(spark, {1: text})).unionByName(web))
    assert ids(S.results(index, "word5", PLAIN, 0, "both")) == [1]


def test_vector_boost_prefers_the_nearer_text(spark):
    index = Index(documents(docs(spark, {1: "rust " + "filler " * 9 + "pad", 2: "rust alpha beta gamma delta"})))
    found = {r.doc_id: r for r in S.results(index, "rust OR alpha OR beta OR gamma OR delta", Ranking(vector_weight=2.0), 0, "local").collect()}
    assert found[2].b_vector > found[1].b_vector > 1


def test_saved_index_gives_the_same_results(index, spark, tmp_path):
    index.save(str(tmp_path / "ix"))
    again = Index.load(spark, str(tmp_path / "ix"))
    for q in ("rust language", '"rust language"', "r?st*", "-rust"):
        rows = [[(r.doc_id, round(r.score, 9)) for r in S.search(i, q, Ranking(), 5000, "local").collect()] for i in (index, again)]
        assert rows[0] == rows[1]


def test_plans_have_no_cartesian_product_and_prune(index):
    plan = S.results(index, "rust language", PLAIN, 0, "local")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_upsert_and_remove(index, spark):
    new = index.upsert(docs(spark, {4: "rust now"}))
    assert ids(S.results(new, "rust", PLAIN, 0, "local")) == [1, 2, 3, 4]
    less = index.remove(spark.createDataFrame([(3,), (1,)], "doc_id bigint"))
    assert ids(S.results(less, "rust", PLAIN, 0, "local")) == [2]
    assert less.vocab.filter("term = 'fast'").first().df == 0


def test_empty_index(spark):
    index = Index(documents(docs(spark, TEXTS).limit(0)))
    assert S.results(index, "rust OR -x", PLAIN, 0, "local").count() == 0 and index.stats.first().n_docs == 0
