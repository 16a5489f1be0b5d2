import pytest

from docsift.functions.query import Query, QueryType, clauses_for, expand_simple, from_model_output, to_fts5

CASES = [
    ("tokio", '"tokio"*'), ("should_notify", '"should notify"'), ("tokio-rt", '"tokio rt"'), ("std::sync::Mutex", '"std sync mutex"'), ("performance -sports", '"performance"* NOT "sports"*'),
    ("perf -should_notify", '"perf"* NOT "should notify"'), ('"should_notify regression"', '"should notify regression"'), ("---", None), ("", None), ("   ", None), ("don't worry", '"don\'t"* "worry"*'),
    ("-foo", None), ("- foo", '"foo"*'), ("--foo", None), ('a"b c"', '"a"* "b c"'), ('"open phrase', '"open phrase"'), ("a -", '"a"*'), ('-"x y" z', '"z"* NOT "x y"'),
]


@pytest.mark.parametrize(("query", "wanted"), CASES)
def test_syntax(query, wanted):
    assert to_fts5(query) == wanted


def test_analysed_clauses():
    assert [c.words for c in clauses_for("don't running")] == [("don", "t"), ("run",)]
    assert clauses_for("'") == [] and clauses_for("-x") == []


def test_expansion():
    kinds = [QueryType.LEX, QueryType.VEC, QueryType.HYDE]
    assert expand_simple("auth") == [Query(k, t) for k, t in zip(kinds, ["auth", "auth", "Information about auth"], strict=True)]
    assert from_model_output("lex: rust async\nvec: how rust works", "rust") == [Query(QueryType.LEX, "rust async"), Query(QueryType.VEC, "how rust works")]
    assert from_model_output("lex: unrelated", "rust") == expand_simple("rust")
    assert from_model_output("LEX: rust", "rust") == expand_simple("rust")
    assert from_model_output("vec: anything", "ab") == [Query(QueryType.VEC, "anything")]
