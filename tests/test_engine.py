"""Evaluation, transactions, deltas, reads: small programs with answers by hand or by plain Python sets."""

import random

import pytest

from weirlog.requests import Requests
from weirlog.session import Options, Session
from weirlog.types import RuleError


def change(op, predicate, *values):
    return {"op": op, "predicate": predicate, "values": list(values)}


def schemas(inputs, outputs):
    return {n: {"input": True, "fields": f.split()} for n, f in inputs.items()} | {n: {"input": False, "fields": f.split()} for n, f in outputs.items()}


def test_closure_negation_and_retraction(spark):
    """Rivers: what lies downstream, which springs stay clean, and what holds while no dam is there at all."""
    s = Session(spark)
    rules = """down(A,B) :- flows(A,B). further : down(A,C) :- down(A,B), flows(B,C).
    clean(A) :- spring(A), !down(A,A), !dammed(A,_). wild(A) :- spring(A), !dammed(_,_). calm(A) :- spring(A), !dammed("ems",2). ring(A) :- ring(A)."""
    s.install(rules, schemas({"flows": "string string", "dammed": "string int", "spring": "string"}, {"down": "string string", "clean": "string", "wild": "string", "calm": "string", "ring": "string"}))
    flows = [("aar", "bode"), ("bode", "cher"), ("cher", "aar"), ("cher", "doubs")]
    s.apply([change("insert", "flows", *e) for e in flows] + [change("insert", "spring", x) for x in ("aar", "doubs")])
    assert len(s.rows("down")) == 12 and s.rows("clean") == [("doubs",)] and s.rows("wild") == [("aar",), ("doubs",)] and s.rows("ring") == []
    done = s.apply([change("delete", "flows", "bode", "cher"), change("insert", "dammed", "ems", 2)])
    assert s.rows("down") == [("aar", "bode"), ("cher", "aar"), ("cher", "bode"), ("cher", "doubs")]
    assert sorted(map(tuple, done.deltas["clean"].collect())) == [("aar", 1)]
    assert sorted(map(tuple, done.deltas["wild"].collect())) == [("aar", -1), ("doubs", -1)] and s.rows("calm") == []
    assert "ring" not in done.deltas
    assert s.why(1).columns == ["A", "B", "C"] and [tuple(r) for r in s.why(1).collect()] == [("cher", "aar", "bode")]


def test_typed_values_and_bare_words(spark):
    """Constants of every type in heads and bodies, signed zeros as one value, and true as a word where texts are expected."""
    s = Session(spark)
    s.install("grade(4.5e-1,N,true) :- meter(N,false,_). warm(T) :- meter(_,_,T), T > -0.5.", schemas({"meter": "int bool double"}, {"grade": "double int bool", "warm": "double"}))
    s.apply([change("insert", "meter", 8, False, -0.0), change("insert", "meter", 8, False, 0.0), change("insert", "meter", 9, True, 3.0), change("insert", "meter", 9, True, -7.0)])
    assert s.rows("grade") == [(0.45, 8, True)] and [str(x) for (x,) in s.rows("warm")] == ["0.0", "3.0"]
    t = Session(spark)
    t.install("said(W,yes) :- heard(W,true). said(W,V) :- heard(W,V), V \\= true.", schemas({"heard": "int string"}, {"said": "int string"}))
    t.apply([change("insert", "heard", 1, "true"), change("insert", "heard", 2, "False"), change("insert", "heard", 3, "yes")])
    assert t.rows("said") == [(1, "yes"), (2, "False"), (3, "yes")]


def test_transactions_are_whole(spark):
    s = Session(spark)
    with pytest.raises(RuleError, match="Install a program first"):
        s.apply([])
    s.install("echo(N,S) :- source(N,S).", schemas({"source": "int string", "unused": "string"}, {"echo": "int string"}))
    low, high = -(1 << 63), (1 << 63) - 1
    s.apply([change("insert", "source", low, "a"), change("insert", "source", high, 'q"\\é\n')])
    for bad in (1 << 64, 1.5, True, "1"):
        with pytest.raises(RuleError):
            s.apply([change("delete", "source", low, "a"), change("insert", "source", bad, "x")])
    assert s.revision == 2 and len(s.rows("echo")) == 2
    for wrong, message in ((change("insert", "echo", 1, "a"), "Cannot mutate a derived"), (change("insert", "none", 1), "Unknown relation"), (change("put", "source", 1, "a"), "Expected insert or delete"), (change("insert", "source", 1), "Arity mismatch")):
        with pytest.raises(RuleError, match=message):
            s.apply([wrong])
    done = s.apply([change("insert", "source", 5, "b"), change("delete", "source", 5, "b"), change("insert", "source", low, "a"), change("delete", "source", 9, "z")])
    assert done.deltas == {} and s.revision == 3
    assert [r["count"] for r in s.relations()] == [2, 0, 2] and set(s.export_inputs()) == {"source", "unused"}
    with pytest.raises(RuleError, match="cannot change while facts are retained"):
        s.install("echo(N) :- source(N).", schemas({"source": "int"}, {"echo": "int"}))
    assert s.install("copy(S) :- source(_,S).", schemas({"source": "int string", "unused": "string", "more": "int"}, {"copy": "string"})) == 4 and s.program_version == 2
    assert s.count_rows("copy") == 2


def test_pages(spark):
    s = Session(spark)
    s.install("echo(N,S) :- source(N,S).", schemas({"source": "int string"}, {"echo": "int string"}))
    s.apply([change("insert", "source", i, "é" * i) for i in range(6)])
    page = s.query_bounded("echo", max_rows=4)
    assert page.rows == [[i, "é" * i] for i in range(4)] and page.truncated
    rest = s.query_bounded("echo", max_rows=9, cursor=page.cursor)
    assert rest.rows == [[4, "é" * 4], [5, "é" * 5]] and not rest.truncated and rest.cursor is None
    small = s.query_bounded("echo", max_bytes=2 + 6 + 1 + 8)
    assert small.bytes == 2 + 6 + 1 + 8 and len(small.rows) == 2
    with pytest.raises(RuleError, match="needs max_bytes of 8"):
        s.query_bounded("echo", max_bytes=3)
    assert s.query_bounded("echo", {1: "nothing"}).bytes == 2
    with pytest.raises(RuleError, match="cursor"):
        s.query_bounded("echo", {0: 1}, cursor=page.cursor)
    assert s.query_rows("source", max_rows=1).total == 6
    assert [p.total for p in s.read_batch([{"relation": "echo"}, {"relation": "source", "max_rows": 2}], s.revision)] == [6, 6]
    s.apply([change("insert", "source", 7, "x")])
    with pytest.raises(RuleError, match="another owner, revision"):
        s.query_bounded("echo", cursor=page.cursor)
    with pytest.raises(RuleError):
        s.read_batch([], s.revision)
    with pytest.raises(RuleError, match="is not exported"):
        t = Session(spark, Options(explain=False, exports=("echo",)))
        t.install("hid(N) :- source(N,_). echo(N,S) :- source(N,S), hid(N).", schemas({"source": "int string"}, {"hid": "int", "echo": "int string"}))
        t.query("hid")


def components(vertices, edges):
    label = {v: v for e in edges for v in e} | {v: v for v in vertices}
    while True:
        smaller = {v: min([label[v]] + [label[b] for a, b in edges if a == v] + [label[a] for a, b in edges if b == v]) for v in label}
        if smaller == label:
            return sorted(label.items())
        label = smaller


def test_connected_components_over_mutations(spark):
    s = Session(spark)
    s.install("", schemas({"vertices": "int", "edges": "int int"}, {"labels": "int int"}), [{"type": "large_small_star", "vertices": "vertices", "edges": "edges", "output": "labels"}])
    vertices = {-9, -4, 0, 3, 7, 10, 11, 42, 99}
    edges = {(-9, -4), (-4, -9), (-4, 0), (0, 0), (3, 7), (7, 3), (10, 11), (99, 99)}
    s.apply([change("insert", "vertices", v) for v in vertices] + [change("insert", "edges", *e) for e in edges])
    assert s.rows("labels") == [(-9, -9), (-4, -9), (0, -9), (3, 3), (7, 3), (10, 10), (11, 10), (42, 42), (99, 99)]
    draw = random.Random(5)
    for op, e in [("insert", (0, 3)), ("delete", (0, 3)), ("insert", (-20, 11))]:
        s.apply([change(op, "edges", *e)])
        edges = edges | {e} if op == "insert" else edges - {e}
        assert s.rows("labels") == components(vertices, edges)
    path = [17, -100, 48, 0, 13, -2, 55, 4, 60, -7, 72, 6, 99]
    some = [(a, b) if draw.random() < 0.5 else (b, a) for a, b in zip(path, path[1:])]
    s.apply([change("insert", "edges", *e) for e in some])
    assert s.rows("labels") == components(vertices, edges | set(some))


def test_random_programs_against_sets(spark):
    """Insertions continue a recursive stratum, deletions compute it again; both must agree with plain sets."""
    s = Session(spark)
    s.install("p(X,Y) :- e(X,Y). p(X,Z) :- p(X,Y), p(Y,Z). q(X) :- n(X), !p(X,_).", schemas({"e": "int int", "n": "int"}, {"p": "int int", "q": "int"}))
    draw, edges = random.Random(1), set()
    s.apply([change("insert", "n", i) for i in range(6)])
    for _ in range(4):
        batch = [(draw.choice(["insert", "insert", "delete"]), (draw.randrange(6), draw.randrange(6))) for _ in range(4)]
        s.apply([change(op, "e", *e) for op, e in batch])
        for op, e in batch:
            edges = edges | {e} if op == "insert" else edges - {e}
        closed = set(edges)
        while more := {(a, d) for a, b in closed for c, d in closed if b == c} - closed:
            closed |= more
        assert set(s.rows("p")) == closed and {x for (x,) in s.rows("q")} == set(range(6)) - {a for a, _ in closed}


def test_requests(spark):
    r = Requests(Session(spark), "ask")
    r.install("told(O,E) :- agent_result(E,R,O), R >= 1.", schemas({}, {"told": "string string"}))
    first = r.submit("e", 1, "p")
    assert r.submit("e", 1, "p") == first and r.status(first)["state"] == "pending"
    with pytest.raises(RuleError, match="another payload"):
        r.submit("e", 1, "q")
    with pytest.raises(RuleError, match="must be claimed"):
        r.complete(first, "o")
    r.claim(first)
    assert r.session.rows("agent_running") == [(first,)] and r.session.rows("agent_pending") == []
    with pytest.raises(RuleError, match="already claimed"):
        r.claim(first)
    second = r.submit("e", 2, "p")
    assert r.complete(first, "late") == {"request": first, "output": "late", "fresh": False} and r.session.rows("told") == []
    r.claim(second)
    r.complete(second, "done")
    assert r.complete(second, "done")["fresh"] and r.session.rows("told") == [("done", "e")]
    with pytest.raises(RuleError, match="another response"):
        r.complete(second, "other")
    with pytest.raises(RuleError, match="behind"):
        r.submit("e", 1, "p")
    with pytest.raises(RuleError, match="private"):
        Requests(Session(spark), "x").install("a(I) :- agent_claimed(I).", schemas({}, {"a": "string"}))
