import pytest

from siftspark.plans.query import And, Filter, Fuzzy, Not, Or, Phrase, Prefix, QueryError, Term, Wildcard, has_text, lex, mode_of, parse, parse_date, parse_duration, parse_size, terms_of, with_ui_filters


@pytest.mark.parametrize(
    ("text", "node"),
    [
        ("Rust", Term("rust")), ("a b", And((Term("a"), Term("b")))), ("a AND b", And((Term("a"), Term("b")))), ("a or b c", Or((Term("a"), And((Term("b"), Term("c")))))),
        ("-x", Not(Term("x"))), ("NOT x", Not(Term("x"))), ('"Hello, world"', Phrase(("hello", "world"))), ('""', Phrase(())), ('"open end', Phrase(("open", "end"))), ("pars*", Prefix("pars")),
        ("w?r*d", Wildcard("w?r*d")), ("*x*", Wildcard("*x*")), ("rustt~", Fuzzy("rustt", 2)), ("rustt~1", Fuzzy("rustt", 1)), ("ext:.RS", Filter("ext", "rs")), ("site:www.A.org", Filter("site", "a.org")),
        ("size>1.5KB", Filter("size", 1536, ">")), ("modified<2w", Filter("modified", 1209600, "<")), ("before:2024", Filter("date", 1704067200, "<")), ("@person:Sarah", Filter("entity", "sarah")),
    ],
)
def test_parse(text, node):
    assert parse(text) == node


@pytest.mark.parametrize("text", ["", "a OR", "NOT", "http://x", "size>=1MB", "size>x", "colour:red", "age>3", "before:soon", "OR a"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_lexing_of_marks():
    assert lex("- a") == [("word", "-"), ("word", "a")]
    assert lex("foo-bar") == [("word", "foo-bar")]
    assert lex("~x :y") == [("word", "~x"), ("word", ":y")]


def test_measures():
    assert (parse_size("2GB"), parse_duration("3"), parse_date("2024-02")) == (2 << 30, 259200, 1706745600)


def test_terms_and_helpers():
    node = parse('a "b c" d* -e size>3 (f')
    assert terms_of(node) == ["a", "b", "c", "d", "(f"]
    assert has_text(node) and not has_text(parse("size>3"))
    assert with_ui_filters(parse("a"), "pdf", None, "w") == And((Term("a"), Filter("ext", "pdf"), Filter("modified", 604800, "<")))
    assert (mode_of("fs"), mode_of(None), mode_of("onion")) == ("local", "web", "tor")
