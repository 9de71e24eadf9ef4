"""Parsing, checking and rejecting programs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weirlog.inspection import inspect_program
from weirlog.plans.check import program_of
from weirlog.plans.parser import Aggregate, Clock, Comparison, Constant, SyntaxProblem, Variable, Wildcard, clause_text, double_text, number, parse
from weirlog.types import RuleError, Schema, cell

#: A cellar: shelves hold bottles, tastings rate them; what is ready, paired or kept back is derived.
CELLAR = {
    "shelf": {"input": True, "fields": ["int", "string"]},
    "tasted": {"input": True, "fields": ["string", "double", "bool"]},
    "guest": {"input": True, "fields": ["string"]},
    "ready": {"input": False, "fields": ["string"]},
    "paired": {"input": False, "fields": ["string", "string"]},
    "kept": {"input": False, "fields": ["int"]},
}


def test_the_parser_accepts_more_than_runs():
    clauses = parse('seed("a", -3). # a fact\nt : p(X, D) :- q(X, P), now(T), !r(X, _), D = P + 1 - 2, X \\= lower.\nc(count(V)) :- q(V, true), V =< 1.5e2.')
    assert clauses[0].is_fact and clauses[0].head.terms == (Constant("a"), Constant(-3))
    rule = clauses[1]
    assert rule.name == "t" and isinstance(rule.body[1], Clock) and rule.body[2].negated and rule.body[2].terms[1] == Wildcard()
    assert rule.body[3] == Comparison("=", Variable("D"), Variable("P"), (("+", Constant(1)), ("-", Constant(2))))
    assert rule.body[4].right == Constant("lower")
    assert clauses[2].head.terms == (Aggregate("count", "V"),) and clauses[2].body[1].right == Constant(150.0)


@pytest.mark.parametrize("text", ["p(X)", 'p("open).', "p(X) :- .", "n : p(1).", "p(X) :- q(X), X -1.", "p(X) :- q(X) X < 1.", "p(1e400).", "p(1e-400).", "p(1e).", "p(9223372036854775808).", "p(X) :- count(X).", "?"])
def test_malformed_texts(text):
    with pytest.raises(SyntaxProblem):
        parse(text)


def test_details_of_tokens():
    assert parse("p(X) :- q(X, 1).")[0].body[0].terms[1] == Constant(1)
    assert parse(r'p(X) :- q(X, "a\n").')[0].body[0].terms[1] == Constant("a\\n")
    assert parse("p(X) :- q(X, _x, Émile).")[0].body[0].terms[1:] == (Constant("_x"), Constant("Émile"))
    assert parse("p(X) :- q(X, true).")[0].body[0].terms[1] == Constant(True)
    assert parse("count(X) :- q(X), !max(X).")[0].head.predicate == "count"
    text = '# é\np(X) :- q(X). r(Y) :- q(Y).'
    spans = [c.span for c in parse(text)]
    assert [text.encode()[a:b].decode() for a, b in spans] == ["p(X) :- q(X).", "r(Y) :- q(Y)."]


@settings(max_examples=60, deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_doubles_read_back(value):
    assert number(double_text(value)) == value


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(-(1 << 63), (1 << 63) - 1), st.booleans(), st.text(st.characters(blacklist_characters='"', blacklist_categories=["Cs"])), st.floats(allow_nan=False, allow_infinity=False)), min_size=1, max_size=4))
def test_canonical_text_reads_back(values):
    rule = parse("p(X) :- q(X).")[0]
    body = rule.body[0].__class__("q", (Variable("X"), *(Constant(v + 0.0 if isinstance(v, float) else v) for v in values)))
    clause = rule.__class__(None, rule.head, (body,))
    again = parse(clause_text(clause))[0]
    assert again.body == clause.body and [type(t.value) for t in again.body[0].terms[1:]] == [type(v) for v in values]


REJECTED = [
    ("kept(S) :- barrel(S,_).", "Undeclared relation barrel"),
    ("sold(B) :- shelf(_,B).", "Undeclared head relation sold"),
    ("kept(S) :- shelf(S).", r"Arity mismatch for shelf: expected 2 fields \['int', 'string'\], got 1"),
    ("kept(S) :- shelf(S,_), guest().", "Arity mismatch for guest: expected 1 fields"),
    ("ready(S) :- guest(S), shelf(S,_).", "Conflicting types for S at shelf field 0: previously string, requires int"),
    ("ready(B) :- shelf(_,B), !tasted(B,R,_).", "Unbound negated variable R in tasted"),
    ("paired(B,G) :- shelf(_,B).", "Unbound head variable G in paired"),
    ("ready(B) :- shelf(top,B).", "Unsupported or mismatched term"),
    ("ready(B) :- tasted(B,4,_).", "Unsupported or mismatched term 4 at tasted field 1: requires double"),
    ("paired(_,B) :- shelf(_,B).", "Unsupported or mismatched term"),
    ("kept(min(S)) :- shelf(S,_).", "Unsupported or mismatched term"),
    ("shelf(1,B) :- ready(B).", "Rule head shelf must be an output relation"),
    ("kept(7).", "Facts must be submitted through apply_changes"),
    ("kept(S) :- shelf(S,_), R >= 3.5.", "Unbound comparison variable R"),
    ("ready(B) :- tasted(B,R,_), R > B.", "Comparison type mismatch: double and string"),
    ("ready(B) :- tasted(B,_,D), D >= false.", "Ordering requires numeric fields"),
    ("kept(S) :- shelf(S,_), S = S - 1.", "Aggregates, arithmetic and clock builtins are not supported"),
    ("kept(S) :- now(S), shelf(S,_).", "Aggregates, arithmetic and clock builtins are not supported"),
    ('ready("any") :- shelf(_,_), guest(_).', "Rule must bind at least one variable"),
    ("", "Expected at least one rule"),
    ("kept(S) :- shelf(S,B), !kept(S), ready(B). ready(B) :- shelf(_,B).", "Unstratified negation: kept negatively depends on kept"),
    ("ready(B) :- shelf(_,B), !paired(B,_). paired(B,G) :- guest(G), shelf(S,B), kept(S). kept(S) :- shelf(S,B), ready(B).", "Unstratified negation"),
    ('ready(B) :- shelf(_,B), B \\= "\x02".', "Unsupported control character"),
]


@pytest.mark.parametrize("rules,message", REJECTED)
def test_rejections(rules, message):
    with pytest.raises(RuleError, match=message):
        program_of(rules, CELLAR)


def test_schemas():
    for bad in ({"1x": Schema(True, ("int",))}, {"x": Schema(True, ())}, {"x": {"input": True, "fields": ["date"]}}, {"x": {"input": True, "fields": ["int"], "more": 1}}):
        with pytest.raises(RuleError):
            program_of("p(X) :- x(X).", bad)


def test_operator_in_a_cycle_and_roles():
    schemas = {"v": Schema(False, ("int",)), "e": Schema(True, ("int", "int")), "l": Schema(False, ("int", "int"))}
    star = {"type": "large_small_star", "vertices": "v", "edges": "e", "output": "l"}
    with pytest.raises(RuleError, match="Recursive dependency through native operator"):
        program_of("v(X) :- l(X,_).", schemas, [star])
    with pytest.raises(RuleError, match="LargeSmallStar role vertices"):
        program_of("v(X) :- e(X,_).", schemas, [star | {"vertices": "e"}])
    with pytest.raises(RuleError, match="Unknown operator type"):
        program_of("v(X) :- e(X,_).", schemas, [{"type": "other"}])


@pytest.mark.parametrize("value,kind", [(1 << 63, "int"), (1.5, "int"), (True, "int"), ("1", "int"), (1, "string"), ("\x01", "string"), (0, "bool"), ("true", "bool"), (1, "double"), (float("nan"), "double"), (float("inf"), "double")])
def test_cells_are_not_coerced(value, kind):
    with pytest.raises(RuleError):
        cell(value, kind)
    assert str(cell(-0.0, "double")) == "0.0" and cell("a\n\b", "string") == "a\n\b"


def test_inspection():
    view = inspect_program("one : paired(B,C) :- shelf(S,B), shelf(S,C), !ready(C). paired(B,D) :- paired(B,C), paired(C,D).", CELLAR)
    assert view["recursive_groups"] == [["paired"]] and not view["diagnostics"]
    assert {"rule": 0, "head": "paired", "body": "ready", "polarity": "negative"} in view["dependencies"]
    assert view["rules"][0]["variables"] == {"B": "string", "C": "string", "S": "int"} and view["rules"][0]["name"] == "one"
    assert inspect_program("paired(B,G) :- shelf(_,B).", CELLAR)["diagnostics"][0]["rule"] == 0
    assert inspect_program("oops", CELLAR)["diagnostics"]
