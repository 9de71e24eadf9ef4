"""Operations by name, whole snapshots, fenced writes, and workers that answer requests."""

import pytest

from weirlog.client import WorldClient, answer
from weirlog.operations import Instance
from weirlog.registry import Registry
from weirlog.requests import Requests
from weirlog.session import Session
from weirlog.types import RuleError
from weirlog.worlds import Worlds

COPY = "echo(N,S) :- source(N,S)."
FIELDS = {"source": {"input": True, "fields": ["int", "string"]}, "echo": {"input": False, "fields": ["int", "string"]}}


def change(op, predicate, *values):
    return {"op": op, "predicate": predicate, "values": list(values)}


def test_operations_by_name(spark, tmp_path):
    one = Instance(Session(spark), Registry(tmp_path))
    with pytest.raises(RuleError, match="Unknown operation"):
        one.execute("drop_everything")
    with pytest.raises(RuleError, match="no registered operation"):
        one.execute("claim_request", {"request": "x"})
    made = one.execute("processor_create", {"name": "copy", "definition": {"rules": COPY, "schemas": FIELDS}})
    assert one.execute("processor_install", {"identity": made["processor_id"]})["program_version"] == 1
    done = one.execute("apply_changes", {"changes": [change("insert", "source", 1, "a"), change("insert", "source", 2, "b")]})
    assert done["revision"] == 2 and sorted(done["deltas"]["echo"]) == [[1, "a", 1], [2, "b", 1]]
    assert one.execute("query", {"relation": "echo"}) == [[1, "a"], [2, "b"]]
    more = one.execute("apply_changes", {"changes": [change("insert", "source", i, "c") for i in (9, 7, 8)], "max_rows": 2})
    assert more["deltas"]["echo"] == [[7, "c", 1], [8, "c", 1]] and more["more"] == {"echo": [8, "c", 1]}
    assert one.execute("delta_rows", {"relation": "echo", "after": more["more"]["echo"]}) == {"rows": [[9, "c", 1]], "after": None}
    assert one.execute("apply_changes", {"changes": [change("delete", "source", i, "c") for i in (9, 7, 8)]})["revision"] == 4
    with pytest.raises(RuleError, match="changed nothing"):
        one.execute("delta_rows", {"relation": "source"})
    page = one.execute("query_rows", {"relation": "source", "max_rows": 1})
    assert page["rows"] == [[1, "a"]] and page["total"] == 2 and page["truncated"]
    assert {r["name"]: r["count"] for r in one.execute("relations")} == {"source": 2, "echo": 2}
    assert sorted(r["N"] for r in one.execute("why", {"rule": 0})) == [1, 2] and one.execute("request_operations") == []
    assert one.execute("program_source")["sha256"] and one.execute("install_rules", {"rules": COPY, "schemas": FIELDS})["program_version"] == 2
    one.pinned = True
    with pytest.raises(RuleError, match="pinned"):
        one.execute("install_rules", {"rules": COPY, "schemas": FIELDS})
    one.session.health = "failed"
    with pytest.raises(RuleError, match="failed"):
        one.execute("relations")
    assert one.execute("instance_info")["health"] == "failed" and one.execute("processor_list")


def test_snapshots_and_fenced_writes(spark):
    world = Worlds(spark).create("w", lambda s: s.install(COPY, FIELDS))
    with pytest.raises(RuleError, match="created"):
        WorldClient(world).snapshot(["echo"])
    world.start()
    client = WorldClient(world)
    empty = client.snapshot(["source", "echo"])
    assert empty.relations == {"source": [], "echo": []}
    rows = [[i, "x"] for i in range(600)]
    done = client.compare_apply(empty, [change("insert", "source", *r) for r in rows], key="k")
    assert done["state"] == "applied" and client.snapshot(["source", "echo"]).relations == {"source": rows, "echo": rows}
    with pytest.raises(RuleError, match="not current"):
        client.compare_apply(empty, [change("delete", "source", 1, "x")])
    with pytest.raises(RuleError, match="bounds"):
        WorldClient(world, max_rows=599).rows("echo")
    with pytest.raises(RuleError, match="different relations"):
        client.snapshot(["echo", "echo"])
    seen = client.snapshot(["echo"])
    world.stop()
    world.start()
    for late in (lambda: client.rows("echo"), lambda: client.compare_apply(seen, [])):
        with pytest.raises(RuleError, match="Generation"):
            late()
    with pytest.raises(RuleError, match="another world"):
        WorldClient(world).compare_apply(seen, [])


def test_requests_are_answered_once(spark):
    requests = Requests(Session(spark), "ask")
    requests.install("answer(O,E) :- agent_result(E,1,O).", {"answer": {"input": False, "fields": ["string", "string"]}})
    ids = [requests.submit(e, 1, p) for e, p in (("a", "one"), ("b", "two"), ("c", "bad"))]
    asked = []

    def call(claim):
        asked.append(claim["request"])
        if claim["payload"] == "bad":
            raise ValueError("no answer")
        return claim["payload"].upper()

    done = {d["request"]: d for d in answer(requests, call, workers=2)}
    assert done[ids[0]]["output"] == "ONE" and done[ids[0]]["fresh"] and "no answer" in done[ids[2]]["problem"]
    assert requests.session.rows("answer") == [("ONE", "a"), ("TWO", "b")]
    assert requests.status(ids[2])["state"] == "claimed" and answer(requests, call) == [] and sorted(asked) == sorted(ids)
    with pytest.raises(RuleError, match="calls run"):
        answer(requests, call, workers=17)
