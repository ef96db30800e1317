"""Quality rules, line dedup, decontamination and personal data against brute force and planted cases."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from siftspark.llm import decision_list, decontam, linededup, pii


def clashing(df):
    return df.withColumns({c: F.lit(c) for c in ("_kept", "_boilerplate", "_site", "rule", "keep", "q_n_words", "_row", "lines", "n_lines", "item_id", "score", "gone", "a.b", "x y", "_salt", "_salts")})


def labelled(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.4
        words = [rng.choice(["zz", "qq", "|"]) if bad and rng.random() < 0.7 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(30, 80))]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_rules_hold_on_unseen_rows(spark):
    rows, labels = labelled(1200, 1)
    more, truth = labelled(400, 2)
    schema = "doc_id bigint, text string"
    rules = decision_list.train(spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert rules
    judged = {r.doc_id: r.keep for r in decision_list.judge(clashing(spark.createDataFrame(more, schema)), rules).collect()}
    right = [judged[i] == bool(q) for i, q, _ in truth]
    assert np.mean(right) > 0.9
    assert np.mean([judged[i] for i, q, _ in truth if q]) > 0.97


def test_columns_follow_the_list_in_order(spark):
    rules = [(decision_list.Condition("n_words", False, 3.0),), (decision_list.Condition("n_words", False, 5.0), decision_list.Condition("digits", True, 0.2))]
    rows = [(1, "a b"), (2, "11 22 33 44"), (3, "a b c d"), (4, None), (5, ""), (5, ""), (None, "a b c d e f")]
    df = clashing(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = sorted(((r.doc_id or 0, r.rule) for r in decision_list.judge(df, rules).collect()), key=str)
    assert got == sorted([(1, 1), (2, 2), (3, None), (4, 1), (5, 1), (5, 1), (0, None)], key=str)
    kept = decision_list.drop_rejected(df, rules)
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3]


def test_rules_without_labels(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    for labels in ([], [(1, 1)], [(None, 0), (9, 0), (1, None)]):
        assert decision_list.train(df, spark.createDataFrame(labels, "doc_id bigint, quality int")) == []
    assert decision_list.drop_rejected(df, []).count() == 1 and decision_list.judge(df.limit(0), []).count() == 0


def test_no_rule_covers_a_good_row_it_grew_on():
    rng = np.random.default_rng(3)
    x = {"a": rng.random(500), "b": rng.random(500)}
    bad = (x["a"] > 0.7) & (x["b"] < 0.5)
    rule = decision_list.grow(x, bad)
    assert bad[decision_list.covers(rule, x)].mean() > 0.95


def test_growth_takes_the_best_condition():
    """Each step's condition has the highest gain of all conditions on the quantiles, the first in order of equal ones."""
    rng = np.random.default_rng(8)
    for seed in range(12):
        x = {"b": rng.integers(0, 6, 90).astype(float), "a": rng.random(90).round(1)}
        bad = (x["a"] > 0.5) ^ (rng.random(90) < 0.2)
        rule, inside = decision_list.grow(x, bad, 3), np.ones(90, dtype=bool)
        for step in rule:
            best, gain = None, 1e-9
            p = bad[inside].sum()
            for name in ("a", "b"):
                for bound in np.unique(np.quantile(x[name][inside], np.linspace(0, 1, decision_list.QUANTILES + 1))):
                    for at_least in (True, False):
                        c = decision_list.Condition(name, at_least, float(bound))
                        hit = inside & c.holds(x)
                        if bad[hit].sum():
                            g = bad[hit].sum() * (np.log2(bad[hit].sum() / hit.sum()) - np.log2(p / inside.sum()))
                            if g > gain:
                                best, gain = c, g
            assert step == best
            inside &= step.holds(x)
        full = {len(decision_list.prune(rule[:k], x, bad)) for k in range(1, len(rule) + 1)}
        worth = []
        for k in range(1, len(rule) + 1):
            c = decision_list.covers(rule[:k], x)
            p, n = bad[c].sum(), (~bad[c]).sum()
            worth.append((p - n) / (p + n) if p + n else -1)
        assert not rule or len(decision_list.prune(rule, x, bad)) == 1 + int(np.argmax(worth)) and full


def lines_by_hand(rows, ratio, least):
    pages, having = Counter(s for _, s, _ in rows if s is not None), Counter()
    for _, s, t in rows:
        if s is not None and t is not None:
            having.update({(s, x.strip(" ")) for x in t.split("\n") if x.strip(" ")})
    bad = {k for k, n in having.items() if n >= least and n / pages[k[0]] > ratio}
    out = []
    for i, s, t in rows:
        kept = None if t is None else [x for x in t.split("\n") if not x.strip(" ") or (s, x.strip(" ")) not in bad]
        out.append((i, s, None if t is None else "\n".join(kept), 0 if t is None else len(t.split("\n")), 0 if t is None else len(t.split("\n")) - len(kept)))
    return sorted(out, key=str)


def test_lines_match_a_loop(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", None]), "\n".join(rng.choice(["menu", " menu ", "", "  ", "terms", f"own {i}", "x" * 5000]) for _ in range(6))) for i in range(80)]
    rows += [(1, "a", None), (1, "a", ""), (None, "b", "menu"), (2, "c", "menu"), (2, "c", "menu")]
    df = clashing(spark.createDataFrame(rows, "doc_id bigint, source string, text string"))
    got = linededup.drop_boilerplate(df, 0.3, 3)
    assert set(got.columns) == {*df.columns, "n_dropped"}
    assert sorted((tuple(r) for r in got.select("doc_id", "source", "text", "n_lines", "n_dropped").collect()), key=str) == lines_by_hand(rows, 0.3, 3)
    assert linededup.drop_boilerplate(df.limit(0)).count() == 0
    monkeypatch.setattr(linededup, "BROADCAST_LINES", 0)
    monkeypatch.setattr(linededup, "SITE_PAGES", 4)
    spread = linededup.drop_boilerplate(df, 0.3, 3)
    assert sorted((tuple(r) for r in spread.select("doc_id", "source", "text", "n_lines", "n_dropped").collect()), key=str) == lines_by_hand(rows, 0.3, 3)


def align_by_hand(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, *new), new
    return best


def words(t):
    return "".join(c.lower() if c.isalnum() else " " for c in t).split()


def test_alignment_scores_match_a_loop(monkeypatch):
    rng = np.random.default_rng(7)
    texts = [rng.integers(0, 6, rng.integers(1, 60)).astype(np.uint64) for _ in range(60)]
    items = [rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint64) for _ in range(60)]
    assert decontam.align(texts, items).tolist() == [align_by_hand(t.tolist(), i.tolist()) for t, i in zip(texts, items)]
    long = [rng.integers(0, k, n).astype(np.uint64) for k in (2, 3, 9) for n in (300, 1500, 4000)]
    short = [rng.integers(0, k, m).astype(np.uint64) for k, m in zip((2, 3, 9) * 3, (3, 7, 12, 20, 4, 9, 33, 1, 15))]
    assert decontam.align(long, short).tolist() == [align_by_hand(t.tolist(), i.tolist()) for t, i in zip(long, short)]
    monkeypatch.setattr(decontam, "TEXT_CELLS", 200)
    assert decontam.align(long + texts, short + items).tolist() == [align_by_hand(t.tolist(), i.tolist()) for t, i in zip(long + texts, short + items)]


def test_a_passage_of_a_million_words():
    item = np.arange(20).astype(np.uint64)
    text = np.tile(np.append(item[:12], np.uint64(99)), 80_000)
    text[700_000:700_020] = item
    assert decontam.align([text, item[:5]], [item, item]).tolist() == [40, 10]


def test_short_items_match_whole(spark):
    items = [(1, "one"), (2, "two words"), (3, "three short words"), (4, "what is six times seven"), (5, "")]
    docs = {10: "one", 11: "One.", 12: "one more", 13: "Two, words!", 14: "two words more", 15: "now three short words stand", 16: "three long words", 17: "so what is six times seven then", 18: "what is six times eight", 19: "", 20: None}
    got = decontam.pairs(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted((r.doc_id, r.item_id, r.ratio) for r in got.collect()) == [(10, 1, 1.0), (11, 1, 1.0), (13, 2, 1.0), (15, 3, 1.0), (17, 4, 1.0)]


def test_benchmark_passages(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(800)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randint(10, 60))) for i in range(25)] + [(90, "too shortitem"), (91, None), (None, say(20)), (3, say(12))]
    rows = []
    for d in range(120):
        t = say(rng.randint(0, 200))
        if d % 3 == 0:
            w = items[rng.randrange(25)][1].split()
            for _ in range(len(w) // (6 if d % 2 else 10_000)):  # edited copies on odd ones
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            t = f"{t} {' '.join(w).upper()}, {say(30)}"
        rows.append((d, t))
    rows += [(500, None), (501, ""), (None, items[0][1]), (502, items[0][1]), (502, items[0][1]), (503, say(30_000) + " " + items[1][1])]
    want = {}
    for d, t in rows:
        for i, p in items:
            if d is not None and i is not None and t and p and len(words(p)) >= decontam.MIN_WORDS and d != 503:
                s = align_by_hand(words(t), words(p)) / (2 * len(words(p)))
                if s >= decontam.THRESHOLD:
                    want[d, i] = max(want.get((d, i), 0), round(s, 6))
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, text string"))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(7))
    got = {(r.doc_id, r.item_id): r.ratio for r in decontam.pairs(docs, benchmark, chunk_words=300).collect()}
    assert got.pop((503, 1)) == 1.0
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want) and all(want[k] == v for k, v in got.items())
    kept = decontam.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in got} - {503}
    assert decontam.pairs(docs, benchmark.limit(0)).count() == 0 and decontam.pairs(docs.limit(0), benchmark).count() == 0


def test_edited_copies_beside_exact_ones(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(5000)]
    for n in (8, 15, 25):
        items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i in range(100)]
        rows, want = [(1000 + i, t) for i, t in items], set()
        for i, t in items:
            w = [rng.choice(vocabulary) if rng.random() < 0.28 else x for x in t.split()]
            rows.append((i, " ".join(w)))
            if align_by_hand(w, t.split()) >= decontam.THRESHOLD * 2 * n:
                want.add((i, i))
        got = decontam.pairs(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
        got = {(r.doc_id, r.item_id) for r in got if r.doc_id < 1000}
        assert len(want) > 50 and got <= want and len(got) >= 0.98 * len(want), n


def test_personal_data(spark):
    cases = {
        "write to a.b+c@mail.example.com, please": [("email", "a.b+c@mail.example.com")], "no@host and @handle or a@b": [], "see https://x.org/a?b=1.": [("address", "https://x.org/a?b=1")],
        "from 10.0.0.255 and 999.1.1.1": [("address", "10.0.0.255")], "call +49 170 1234567 now": [("phone", "+49 170 1234567")], "card 4111 1111 1111 1111 ok": [("account", "4111 1111 1111 1111")],
        "ssn 123-45-6789.": [("account", "123-45-6789")], "IBAN DE89370400440532013000": [("account", "DE89370400440532013000")], "account no. 12345678 x": [("account", "12345678")],
        "token = abcdef1234567890abcd": [("secret", "abcdef1234567890abcd")], "in 2024 we had 3.14 and 1,000 things": [], "": [], "a" * 100_000 + "@" + "b" * 100_000: [],
    }
    rows = [*enumerate(cases), (97, None), (None, "x@y.org"), (98, "x@y.org"), (98, "x@y.org")]
    got = pii.redact(clashing(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id < len(cases):
            text, spans = list(cases.items())[r.doc_id]
            assert [(s.kind, text[s.start : s.end]) for s in r.spans] == spans and r.n_spans == len(spans)
            want = text
            for kind, value in spans:
                want = want.replace(value, f"<{kind}>", 1)
            assert r.text == want
    assert [(r.text, r.spans) for r in got if r.doc_id == 97] == [(None, [])]
    assert pii.redact(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_cues_in_any_case():
    anchors = pii.automaton()
    value = "abcdef1234567890abcd"
    for cue in ("API key: ", "API Key: ", "apiKey=", "ApiKey: ", "Api_Key = ", "PassWord: ", "API_key: "):
        text = f"İİ {cue}{value}."
        assert [(k, text[a:b]) for k, a, b in pii.find(text, anchors)] == [("secret", value)], cue
    for cue in ("Customer ID: ", "Member ID ", "CUSTOMER No. ", "Iban: "):
        text = f"İ {cue}AB123456, x"
        assert [(k, text[a:b]) for k, a, b in pii.find(text, anchors)] == [("account", "AB123456")], cue
    assert [k for k, *_ in pii.find("HtTpS://X.org/a", anchors)] == ["address"]


def personal_by_hand(text):
    """Every substring that is one of the forms that say() gives, by regular expressions over the whole text."""
    import re

    forms = (
        ("email", r"[a-z]+\.[a-z]+@[a-z]+\.(?:com|org|xn--p1ai)"), ("address", r"https?://[a-z]+\.org/[a-z]+"), ("address", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"),
        ("account", r"(?i:account|member id|customer no)\.?:? (?:(?:number|is) )*(\d{8})(?!\d)"), ("secret", r"(?i:api key|token): ([a-z]{10}\d{10})\b"), ("account", r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"),
    )
    found = [(k, *m.span(m.lastindex or 0)) for k, f in forms for m in re.finditer(f, text)]
    return sorted(found, key=lambda x: x[1])


def test_generated_documents_against_expressions():
    rng = random.Random(21)
    letters = lambda n: "".join(rng.choice("bcdfghjklm") for _ in range(n))
    digits = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    case = lambda x: rng.choice([x, x.upper(), x.title(), "".join(rng.choice([c, c.upper()]) for c in x)])
    forms = (
        lambda: f"{letters(4)}.{letters(3)}@{letters(5)}.{rng.choice(['com', 'org', 'xn--p1ai'])}", lambda: f"https://{letters(5)}.org/{letters(4)}", lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)),
        lambda: f"{case(rng.choice(['account', 'member id', 'customer no']))}{rng.choice([':', '.', '.:', ''])} {rng.choice(['', 'number ', 'number is ', 'is '])}{digits(8)}", lambda: f"{case(rng.choice(['api key', 'token']))}: {letters(10)}{digits(10)}",
        lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: digits(rng.randint(1, 5)), lambda: f"{letters(3)}@{letters(3)}", lambda: case("account"), lambda: "İß", lambda: case("token"),
    )
    anchors = pii.automaton()
    for _ in range(1500):
        text = ", ".join(rng.choice(forms)() if rng.random() < 0.5 else f"{letters(rng.randint(1, 8))} {letters(4)}" for _ in range(rng.randint(0, 9)))
        assert pii.find(text, anchors) == personal_by_hand(text), text


def test_values_after_cue_words_and_wide_hosts():
    anchors = pii.automaton()
    cases = {
        "account number is 12345678 ok": ["12345678"], "My Account No. is: 12345678": ["12345678"], "bob@example.xn--p1ai": ["bob@example.xn--p1ai"], "bob@bücher.example": ["bob@bücher.example"], "bob@x.com的": ["bob@x.com"],
        "account is island": [], "member id number was AB12345": ["AB12345"],
    }
    for text, want in cases.items():
        assert [text[a:b] for _, a, b in pii.find(text, anchors)] == want, text


def test_cards_in_groups_and_cued_values():
    anchors = pii.automaton()
    cases = {
        "4111 1111 1111 1111 2027": ["4111 1111 1111 1111"], "account 4111 1111 1111 1111 2027": ["4111 1111 1111 1111"], "2026 4111 1111 1111 1111 12": ["4111 1111 1111 1111"], "amex 3782 822463 10005.": ["3782 822463 10005"],
        "3056 930902 5904 x": ["3056 930902 5904"], "4111 1111 1111 1112 2027": [], "3782 822463 10006": [], "4111 1111 1111 11110": [], "member id: ABCDEFG7": ["ABCDEFG7"], "member id: AB-1-C": [], "customer no: ABCDEFGH": [],
    }
    for text, want in cases.items():
        assert [text[a:b] for _, a, b in pii.find(text, anchors)] == want, text


def test_rules_from_few_or_rare_bad_labels(spark):
    rows, labels = labelled(1200, 4)
    bad, good = [i for i, q, _ in labels if not q], [i for i, q, _ in labels if q]
    df, schema = spark.createDataFrame(rows, "doc_id bigint, text string").cache(), "doc_id bigint, quality int"
    for few, many, most in ((12, 80, 20_000), (40, 600, 120)):
        some = spark.createDataFrame([(i, 0) for i in bad[:few]] + [(i, 1) for i in good[:many]], schema)
        rules = decision_list.train(df, some, max_labelled=most)
        assert rules, few
        judged = {r.doc_id: r.keep for r in decision_list.judge(df, rules).collect()}
        assert np.mean([judged[i] for i in good]) > 0.95 and np.mean([not judged[i] for i in bad]) > 0.5
