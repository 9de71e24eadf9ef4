"""Composition, registry, worlds, checkpoints, change feeds."""

import json

import pytest

from weirlog.compose import Ports, compose
from weirlog.plans.fixpoint import evaluate
from weirlog.registry import Registry, version_of
from weirlog.session import Options, Session, frame
from weirlog.sources import checkpoint
from weirlog.streaming.feed import Feed
from weirlog.types import RuleError, Schema
from weirlog.worlds import Worlds

I4, I3, I2 = ["int"] * 4, ["int"] * 3, ["int"] * 2


def program(rules, inputs, outputs, private=None):
    relations = {n: {"input": True, "fields": f} for n, f in inputs.items()} | {n: {"input": False, "fields": f} for n, f in (outputs | (private or {})).items()}
    return {"rules": rules, "schemas": relations, "interface": {"inputs": list(inputs), "outputs": list(outputs)}}


NODES = {
    "eligibility": program("scratch(P,R,F) :- finding(P,R,F,S), S =< 2. eligible(P,R,F) :- scratch(P,R,F).", {"finding": I4}, {"eligible": I3}, {"scratch": I3}),
    "current": program("scratch(P,R,F) :- eligible(P,R,F), current(P,R). selected(P,R,F) :- scratch(P,R,F).", {"eligible": I3, "current": I2}, {"selected": I3}, {"scratch": I3}),
    "supported": program("scratch(P,R,F) :- selected(P,R,F), support(P,R,F,W). actionable(P,F) :- scratch(P,R,F).", {"selected": I3, "support": I4}, {"actionable": I2}, {"scratch": I3}),
}


def end(node, relation):
    return {"node": node, "relation": relation}


MANIFEST = {
    "nodes": {n: {"of": n} for n in NODES},
    "inputs": {"findings": {"fields": I4, "targets": [end("eligibility", "finding")]}, "revisions": {"fields": I2, "targets": [end("current", "current")]}, "evidence": {"fields": I4, "targets": [end("supported", "support")]}},
    "bindings": [{"from": end("eligibility", "eligible"), "to": end("current", "eligible")}, {"from": end("current", "selected"), "to": end("supported", "selected")}],
    "outputs": {"actionable": end("supported", "actionable")},
}


def change(op, predicate, *values):
    return {"op": op, "predicate": predicate, "values": list(values)}


def test_composition_versions_agree(spark):
    data = {"findings": [(1, 1, 10, 2), (1, 1, 11, 3), (2, 1, 12, 1)], "revisions": [(1, 1), (2, 2)], "evidence": [(1, 1, 10, 5), (1, 1, 10, 6), (2, 1, 12, 7)]}
    for manifest in (MANIFEST, {"nodes": {"in": {"of": "whole"}}, "bindings": [], "inputs": {n: {"fields": x["fields"], "targets": [end("in", n)]} for n, x in MANIFEST["inputs"].items()}, "outputs": {"actionable": end("in", "actionable")}}):
        for version in (1, 2):
            made = compose(manifest, lambda r: {"composition": MANIFEST} if r["of"] == "whole" else NODES[r["of"]], version)
            inputs = {made.resolution.inputs[n]: frame(spark, rows, made.program.schemas[made.resolution.inputs[n]]) for n, rows in data.items()}
            out = made.resolution.outputs["actionable"]
            assert [tuple(r) for r in evaluate(spark, made.program, inputs, [out])[out].collect()] == [(1, 10)]
            assert len(made.program.clauses) == len(made.resolution.rules)
    one, two = (compose(MANIFEST, lambda r: NODES[r["of"]], v) for v in (1, 2))
    assert len(two.program.clauses) == len(one.program.clauses) - 5 and "Module0_eligible" in one.program.schemas
    assert two.resolution.relations["Module0_eligible"]["alias_of"] == "Module1_eligible"
    assert "lowering_version" not in one.resolution.to_json() and two.resolution.to_json()["lowering_version"] == 2


@pytest.mark.parametrize(
    "edit,message",
    [
        (lambda m: m["bindings"].pop(), "is not connected"),
        (lambda m: m["bindings"].append(m["bindings"][0]), "more than one source"),
        (lambda m: m["inputs"]["revisions"].update(fields=I3), "Incompatible binding"),
        (lambda m: m["outputs"].clear(), "at least one node and one output"),
        (lambda m: m["outputs"].update(findings=end("supported", "actionable")), "both inputs and outputs"),
        (lambda m: m["outputs"].update(actionable=end("supported", "scratch")), "does not exist"),
        (lambda m: m["nodes"].update(current={"of": "loop"}), "Cyclic"),
    ],
)
def test_wiring_errors(edit, message):
    manifest = json.loads(json.dumps(MANIFEST))
    edit(manifest)
    with pytest.raises(RuleError, match=message):
        compose(manifest, lambda r: {"composition": manifest} if r["of"] == "loop" else NODES[r["of"]])


def test_recursive_wiring_is_checked_as_a_whole(spark):
    step = program("out(X,Z) :- back(X,Y), edge(Y,Z). out(X,Y) :- edge(X,Y).", {"back": I2, "edge": I2}, {"out": I2})
    copy = program("out(X,Y) :- a(X,Y).", {"a": I2}, {"out": I2})
    manifest = {"nodes": {"step": {"of": "step"}, "copy": {"of": "copy"}}, "inputs": {"edge": {"fields": I2, "targets": [end("step", "edge")]}}, "bindings": [{"from": end("step", "out"), "to": end("copy", "a")}, {"from": end("copy", "out"), "to": end("step", "back")}], "outputs": {"out": end("step", "out")}}
    for version in (1, 2):
        made = compose(manifest, {"step": step, "copy": copy}.__getitem__ and (lambda r: {"step": step, "copy": copy}[r["of"]]), version)
        edges = frame(spark, [(1, 2), (2, 3)], Schema(True, ("int", "int")))
        out = made.resolution.outputs["out"]
        assert sorted(tuple(r) for r in evaluate(spark, made.program, {made.resolution.inputs["edge"]: edges}, [out])[out].collect()) == [(1, 2), (1, 3), (2, 3)]
    negative = program("out(X,Y) :- edge(X,Y), !back(X,Y).", {"back": I2, "edge": I2}, {"out": I2})
    with pytest.raises(RuleError, match="Unstratified negation"):
        compose(manifest, lambda r: {"step": negative, "copy": copy}[r["of"]])


def test_ports():
    made = compose(MANIFEST, lambda r: NODES[r["of"]], 2)
    ports = Ports.of(made.program.schemas, resolution=made.resolution)
    assert ports.change(change("insert", "revisions", 1, 1))["predicate"] == "Input_revisions" and ports.output("actionable") == "Output_actionable"
    with pytest.raises(RuleError):
        ports.change(change("insert", "Input_revisions", 1, 1))
    assert ports.deltas({"Output_actionable": 1, "Module0_scratch": 2}) == {"actionable": 1}


def test_registry(tmp_path):
    registry = Registry(tmp_path / "a")
    record = registry.create("Eligible Ones", NODES["eligibility"], "first")
    identity, version = record["processor_id"], record["current"]
    assert version == version_of(dict(reversed(NODES["eligibility"].items())))
    with pytest.raises(RuleError, match="is 'sha256"):
        registry.publish(identity, NODES["current"], "sha256:" + "0" * 64)
    second = registry.publish(identity, NODES["current"], version)
    assert registry.get(identity)["version"] == second["current"] != version and registry.get(identity, version)["definition"]["rules"] == NODES["eligibility"]["rules"]
    fork = registry.fork(identity, version, "copy")
    assert fork["lineage"] == {"processor_id": identity, "version": version} and fork["current"] == version
    refs = {n: {"processor_id": (r := registry.create(n, d))["processor_id"], "version": r["current"]} for n, d in NODES.items()}
    whole = registry.create("whole", {"composition": MANIFEST | {"nodes": refs}})
    assert registry.resolve({**MANIFEST, "nodes": refs}).resolution.nodes == refs
    assert [p["name"] for p in registry.search("ELIGIBLE")["processors"]] == ["Eligible Ones"]
    first = registry.list(limit=2)
    assert len(first["processors"]) == 2 and len(registry.list(after=first["after"])["processors"]) == 4
    archived = registry.archive(identity, second["generation"])
    assert identity not in [p["processor_id"] for p in registry.list()["processors"]]
    registry.restore(identity, archived["generation"])
    library, other = registry.closure(whole["processor_id"]), Registry(tmp_path / "b")
    assert len(other.import_library(library)) == 4 and other.import_library(library) == []
    assert other.get(whole["processor_id"])["definition"] == registry.get(whole["processor_id"])["definition"]
    library["versions"][version_of(NODES["current"])]["rules"] += " "
    with pytest.raises(RuleError, match="damaged"):
        Registry(tmp_path / "c").import_library(library)
    for wrong in ("processor_1", "../x"):
        with pytest.raises(RuleError, match="Invalid processor identity"):
            registry.get(wrong)


ECHO = ("echo(N,S) :- source(N,S).", {"source": {"input": True, "fields": ["int", "string"]}, "unused": {"input": True, "fields": ["double"]}, "echo": {"input": False, "fields": ["int", "string"]}})


def test_checkpoints(spark, tmp_path):
    s = Session(spark)
    s.install(*ECHO)
    s.apply([change("insert", "source", -7, 'a\n"b"\\é'), change("insert", "unused", 1.0)])
    checkpoint.save(s, tmp_path / "x.json", {"who": "test"})
    t = Session(spark)
    assert checkpoint.restore(t, tmp_path / "x.json") == {"who": "test"}
    assert t.rows("echo") == s.rows("echo") and t.info()["revision"] == 2 and set(t.inputs) == {"source", "unused"}
    with pytest.raises(RuleError, match="fresh session"):
        checkpoint.restore(t, tmp_path / "x.json")
    damaged = json.loads((tmp_path / "x.json").read_text())
    damaged["inputs"]["source"] = []
    with pytest.raises(RuleError, match="digest"):
        checkpoint.restore_value(Session(spark), damaged)
    for rows, message in (([[1, "a"], [1, "a"]], "Duplicate rows"), ([["1", "a"]], "signed 64-bit")):
        value = checkpoint.checkpoint_value(s)
        value.pop("sha256")
        value["inputs"]["source"] = rows
        with pytest.raises(RuleError, match=message):
            checkpoint.restore_value(Session(spark), value | {"sha256": checkpoint._digest(value)})
    saved = checkpoint.save_tables(s, f"file://{tmp_path}/tables")
    u = Session(spark, Options(explain=False))
    checkpoint.restore_tables(u, f"file://{tmp_path}/tables", saved["publication_id"])
    assert u.rows("echo") == s.rows("echo")


def test_worlds(spark, tmp_path):
    world = Worlds(spark).create("w", lambda s: s.install(*ECHO), folder=tmp_path)
    with pytest.raises(RuleError, match="is created"):
        world.stop()
    generation = world.start()
    changes = [change("insert", "source", 1, "a")]
    done = world.admit("k", generation, 1, changes, publish=lambda s: world.save(tmp_path / "w.json"))
    assert done["state"] == "durable" and world.admit("k", generation, 1, changes) == done and world.session.revision == 2
    with pytest.raises(RuleError, match="belongs to other changes"):
        world.admit("k", generation, 2, [])
    with pytest.raises(RuleError, match="is not current"):
        world.admit("l", generation, 1, [])
    assert world.admission_status("l")["state"] == "not_applied"
    failed = world.admit("m", generation, 2, [], publish=lambda s: 1 / 0)
    assert failed["state"] == "applied_but_unpublished"
    effect = world.reserve("e", generation, "me")
    with pytest.raises(RuleError, match="already reserved"):
        world.reserve("e", generation, "you")
    with pytest.raises(RuleError, match="not reserved that way"):
        world.settle("e", generation, "you", effect["reservation"], 1)
    assert world.settle("e", generation, "me", effect["reservation"], 1)["outcome"] == 1
    frozen = world.freeze(["echo"], generation, world.session.revision)
    assert frozen["outputs"]["echo"]["rows"] == 1
    with pytest.raises(RuleError, match="receipt"):
        world.admit("n", generation, world.session.revision, changes)
    with pytest.raises(RuleError, match="No such boundary"):
        world.confirm("x", None)
    world.confirm(frozen["boundary"], "ok")
    fork = world.fork("f", frozen["boundary"])
    fork.session.apply([change("delete", "source", 1, "a")])
    assert fork.session.rows("echo") == [] and world.session.rows("echo") == [(1, "a")]
    world.scenarios = [{"name": "one", "changes": changes, "expect": {"echo": [[1, "a"]]}}, {"name": "two", "changes": [], "expect": {"echo": []}}]
    report = world.test()
    assert [s["passed"] for s in report["scenarios"]] == [True, False] and report["scenarios"][1]["results"][0]["unexpected"] == [[1, "a"]]
    world.stop()
    assert world.start(tmp_path / "w.json") == generation + 1 and world.session.rows("echo") == [(1, "a")]


def test_change_feed(spark, tmp_path):
    s = Session(spark)
    s.install(*ECHO)
    schema = "op string, f0 long, f1 string, at long"
    heard = {}
    feed = Feed(s, "source", "at", lambda key, done: heard.update({key: sorted(map(tuple, done.deltas["echo"].collect()))}))
    for rows in ([("insert", 1, "a", 1), ("delete", 1, "a", 2), ("insert", 2, "b", 1)], [("delete", 2, "b", 3), ("insert", 3, "c", 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        feed.start(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/state").awaitTermination()
    assert s.rows("echo") == [(3, "c")] and heard == {0: [(2, "b", 1)], 1: [(2, "b", -1), (3, "c", 1)]}
    revision = s.revision
    feed.apply(spark.createDataFrame([("insert", 9, "z", 9)], schema), 1)
    assert s.revision == revision
