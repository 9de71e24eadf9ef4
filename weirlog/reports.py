"""Registered queries of the instance and control surface: each runs one part of it over the driver's tables and tells what came out, with SQL for the same rows."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from weirlog import telemetry
from weirlog.compose import Ports, check_interface, compose
from weirlog.inspection import inspect_program
from weirlog.operations import Instance
from weirlog.plans.check import program_of
from weirlog.plans.fixpoint import evaluate
from weirlog.registry import Registry, version_of
from weirlog.requests import Requests
from weirlog.session import Session
from weirlog.sources import checkpoint
from weirlog.types import RuleError, schemas_of
from weirlog.worlds import World, Worlds

REPORTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
REPORT_SQL: dict[str, str] = {}


def report(sql: str):
    """Registers a query under its name with SQL for its rows."""

    def register(query):
        REPORTS[query.__name__], REPORT_SQL[query.__name__] = query, sql
        return query

    return register


def values(columns: str, rows: Iterable[tuple]) -> str:
    """SQL for rows that do not depend on any table."""
    text = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"CAST({v} AS BIGINT)" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({columns})"


def refused(attempt: Callable[[], object]) -> str:
    """What an attempt is refused with; empty if it is not."""
    try:
        attempt()
    except RuleError as problem:
        return str(problem)
    return ""


def change(op: str, predicate: str, *fact) -> dict:
    return {"op": op, "predicate": predicate, "values": list(fact)}


def relations(**fields: str) -> dict:
    """Schemas: a name that ends with an underscore is an input."""
    return {n.rstrip("_"): {"input": n.endswith("_"), "fields": f.split()} for n, f in fields.items()}


OPEN = ("open(N,R) :- nation(N,R), !closed(R).", relations(nation_="int int", closed_="int", open="int int"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("CAST(n_nationkey AS BIGINT) f0", "CAST(n_regionkey AS BIGINT) f1")


def opened(spark: SparkSession, sf_dir: str) -> Session:
    """A session that tells which nations lie in regions that are not closed."""
    session = Session(spark)
    session.install(*OPEN)
    session.load({"nation": nations(spark, sf_dir)})
    return session


def by_name(spark: SparkSession, sf_dir: str, query: str) -> Session:
    from weirlog import queries

    return queries.session_with(spark, sf_dir, query)[0]


OPEN_SQL = "SELECT CAST(n_nationkey AS BIGINT) AS nationkey, CAST(n_regionkey AS BIGINT) AS regionkey FROM nation"


@report(f"{OPEN_SQL} WHERE n_regionkey <> 0")
def silent_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions that only acknowledge; within one the last change of a fact wins."""
    session = opened(spark, sf_dir)
    session.apply_without_deltas([change("insert", "closed", 0), change("insert", "closed", 1), change("delete", "closed", 1)])
    session.apply_without_deltas([change("insert", "closed", 0), change("delete", "closed", 3)])
    return session.query("open").toDF("nationkey", "regionkey")


@report(f"{OPEN_SQL} WHERE n_regionkey <> 2")
def typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed rows, in order."""
    session = opened(spark, sf_dir)
    session.apply([change("insert", "closed", 2)])
    return spark.createDataFrame(session.rows("open"), "nationkey long, regionkey long")


@report("SELECT CAST(n_nationkey AS BIGINT) AS nationkey, (SELECT count(*) FROM nation) AS total FROM nation WHERE n_regionkey = 1")
def public_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of an input relation for one value of a field, each with the relation's exact size."""
    session, rows, cursor = opened(spark, sf_dir), [], None
    while not rows or cursor:
        page = session.query_rows("nation", {1: 1}, max_rows=2, cursor=cursor)
        rows, cursor = rows + [(r[0], page.total) for r in page.rows], page.cursor
    return spark.createDataFrame(rows, "nationkey long, total long")


@report("SELECT 'placed' AS relation, count(*) AS n FROM (SELECT DISTINCT o_orderkey, c_custkey, c_mktsegment, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey)")
def counted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of rows of a derived relation."""
    return spark.createDataFrame([("placed", by_name(spark, sf_dir, "join_equi").count_rows("placed"))], "relation string, n long")


@report("SELECT 'idle' AS name, FALSE AS is_input, count(*) AS n FROM (SELECT DISTINCT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) UNION ALL SELECT 'orders', TRUE, count(*) FROM (SELECT DISTINCT o_orderkey, o_custkey, o_orderpriority FROM orders) UNION ALL SELECT 'item', TRUE, count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem)")
def listed_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public relations with their sizes."""
    return spark.createDataFrame([(r["name"], r["input"], r["count"]) for r in by_name(spark, sf_dir, "anti_join").relations()], "name string, is_input boolean, n long")


@report(f"{OPEN_SQL.replace('SELECT ', 'SELECT DISTINCT ', 1)}")
def exported_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of an input, as exported; the other input is exported empty."""
    found = opened(spark, sf_dir).export_inputs()
    assert sorted(found) == ["closed", "nation"] and found["closed"].isEmpty()
    return found["nation"].toDF("nationkey", "regionkey")


@report("SELECT 'nation' AS relation, CAST(n_nationkey AS BIGINT) AS a, CAST(n_regionkey AS BIGINT) AS b FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'open', n_nationkey, n_regionkey FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'stale', 0, 0")
def batched_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several pages of one generation and revision; an older revision is refused."""
    world = World(spark, "reads", lambda s: s.install(*OPEN))
    generation = world.start()
    world.session.load({"nation": nations(spark, sf_dir)})
    pages = world.read_batch(generation, world.session.revision, [{"relation": "nation", "filters": {1: 0}}, {"relation": "open", "filters": {0: 7}}])
    rows = [(name, *r) for name, page in zip(("nation", "open"), pages, strict=True) for r in page.rows]
    stale = refused(lambda: world.read_batch(generation, 1, [{"relation": "open"}]))
    return spark.createDataFrame(rows + [("stale", 0, 0)] * bool(stale), "relation string, a long, b long")


@report(f"{OPEN_SQL} WHERE n_regionkey <> 4")
def json_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived relation after its session went through a checkpoint's JSON text."""
    session, other = opened(spark, sf_dir), Session(spark)
    session.apply([change("insert", "closed", 4)])
    assert checkpoint.restore_value(other, json.loads(json.dumps(checkpoint.checkpoint_value(session, {"by": "report"})))) == {"by": "report"}
    return other.query("open").toDF("nationkey", "regionkey")


@report(f"{OPEN_SQL} WHERE n_regionkey <> 1")
def frozen_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a frozen output as its file tells them; admissions wait for the boundary's receipt."""
    with tempfile.TemporaryDirectory() as folder:  # the files of an export belong to the driver
        world = World(spark, "export", lambda s: s.install(*OPEN), folder=Path(folder))
        generation = world.start()
        world.session.load({"nation": nations(spark, sf_dir)})
        world.admit("close", generation, 2, [change("insert", "closed", 1)])
        frozen = world.freeze(["open"], generation, 3)
        assert refused(lambda: world.admit("late", generation, 3, [change("insert", "closed", 2)]))
        world.confirm(frozen["boundary"], "kept")
        rows = json.loads((Path(folder) / "blobs" / f"{frozen['outputs']['open']['sha256']}.json").read_text())
    return spark.createDataFrame([tuple(r) for r in rows], "nationkey long, regionkey long")


#: A program of its own for each refusal; `part` is an int input, `size` a double one, `tag` a text one, `out` and `two` are derived.
REFUSED = [
    ("inline fact", "out(1).", "Facts must be submitted through apply_changes"),
    ("arithmetic", "out(X) :- part(X), X = X + 1.", "Aggregates, arithmetic and clock builtins are not supported"),
    ("clock", "out(X) :- part(X), now(X).", "Aggregates, arithmetic and clock builtins are not supported"),
    ("aggregate", "out(max(X)) :- part(X).", "Unsupported or mismatched term max(X) at out field 0: requires int"),
    ("assignment", "out(X) :- part(X), Y = 3.", "Unbound comparison variable Y"),
    ("undeclared relation", "out(X) :- piece(X).", "Undeclared relation piece"),
    ("undeclared head", "piece(X) :- part(X).", "Undeclared head relation piece"),
    ("arity", "out(X) :- part(X,X).", "Arity mismatch for part: expected 1 fields ['int'], got 2"),
    ("types", "out(X) :- part(X), tag(X).", "Conflicting types for X at tag field 0: previously int, requires string"),
    ("negated variable", "out(X) :- part(X), !size(Z).", "Unbound negated variable Z in size"),
    ("head variable", "out(Z) :- part(X).", "Unbound head variable Z in out"),
    ("constant", 'out(X) :- part(X), size("wide").', 'Unsupported or mismatched term "wide" at size field 0: requires double'),
    ("wildcard in head", "out(_) :- part(_).", "Unsupported or mismatched term _ at out field 0: requires int"),
    ("input as head", "part(X) :- out(X).", "Rule head part must be an output relation"),
    ("mixed comparison", 'out(X) :- part(X), X = "x".', "Comparison type mismatch: int and string"),
    ("order of texts", 'out(1) :- tag(T), T < "m".', "Ordering requires numeric fields"),
    ("no variable", "out(1) :- part(2).", "Rule must bind at least one variable"),
    ("nothing", "", "Expected at least one rule"),
    ("negative cycle", "out(X) :- part(X), !two(X). two(X) :- out(X).", "Unstratified negation: out negatively depends on two in a dependency cycle"),
]


@report(values("what, message", [(a, c) for a, _, c in REFUSED]))
def refused_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What programs that parse are refused with."""
    schemas = relations(part_="int", size_="double", tag_="string", out="int", two="int")
    return spark.createDataFrame([(what, refused(lambda rules=rules: program_of(rules, schemas))) for what, rules, _ in REFUSED], "what string, message string")


@report(values("what, message", [("operator in a cycle", "Recursive dependency through native operator: label depends on link"), ("unknown relation", "Unknown relation nowhere"), ("derived relation", "Cannot mutate a derived relation open"), ("operation", "Expected insert or delete, got 'upsert'"), ("not installed", "Install a program first"), ("boolean for int", "Expected signed 64-bit integer, got True"), ("failed", "The instance has failed; only its status can be read"), ("pinned", "The instance's program is pinned")]))
def refused_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes and operations are refused with; none of them moves the revision."""
    session = Session(spark)
    session.install(*OPEN)
    cycle = relations(node_="int", link="int int", label="int int")
    operator = {"type": "large_small_star", "vertices": "node", "edges": "link", "output": "label"}
    failed, pinned = Instance(Session(spark)), Instance(session, pinned=True)
    failed.session.health = "failed"
    found = [
        ("operator in a cycle", refused(lambda: program_of("link(X,Y) :- label(X,Y).", cycle, [operator]))),
        ("unknown relation", refused(lambda: session.apply([change("insert", "nowhere", 1)]))),
        ("derived relation", refused(lambda: session.apply([change("insert", "open", 1, 1)]))),
        ("operation", refused(lambda: session.apply([change("upsert", "closed", 1)]))),
        ("not installed", refused(lambda: Session(spark).apply([change("insert", "closed", 1)]))),
        ("boolean for int", refused(lambda: session.apply([change("insert", "closed", 1), change("insert", "closed", True)]))),
        ("failed", refused(lambda: failed.execute("relations"))),
        ("pinned", refused(lambda: pinned.execute("install_rules", {"rules": OPEN[0], "schemas": OPEN[1]}))),
    ]
    assert session.revision == 1 and failed.execute("instance_info")["health"] == "failed"
    return spark.createDataFrame(found, "what string, message string")


def processor(rules: str, inputs: list[str], outputs: list[str], **fields: str) -> dict:
    return {"rules": rules, "schemas": relations(**fields), "interface": {"inputs": inputs, "outputs": outputs}}


END = lambda node, relation: {"node": node, "relation": relation}
STEP = processor("reach(X,Y) :- edge(X,Y). reach(X,Z) :- back(X,Y), edge(Y,Z).", ["edge", "back"], ["reach"], edge_="int int", back_="int int", reach="int int")
ECHO = processor("same(X,Y) :- heard(X,Y).", ["heard"], ["same"], heard_="int int", same="int int")
LOOP = {
    "nodes": {"echo": {"of": "echo"}, "step": {"of": "step"}},
    "inputs": {"edge": {"fields": ["int", "int"], "targets": [END("step", "edge")]}},
    "bindings": [{"from": END("step", "reach"), "to": END("echo", "heard")}, {"from": END("echo", "same"), "to": END("step", "back")}],
    "outputs": {"reach": END("step", "reach")},
}
PARTS = {"echo": ECHO, "step": STEP}


def looped(version: int):
    return compose(LOOP, lambda reference: PARTS[reference["of"]], version)


def cyclic_wiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure of the conversations' edges by two nodes that feed each other."""
    from weirlog import queries

    made = looped(2)
    closure = queries.PROGRAMS["closure"]
    found = evaluate(spark, program_of(closure.rules, closure.schemas(), ()), closure.relations(spark, sf_dir), ["edge"])["edge"]
    out = made.resolution.outputs["reach"]
    return evaluate(spark, made.program, {made.resolution.inputs["edge"]: found}, [out])[out].toDF("source", "target")


REPORTS["cyclic_wiring"] = cyclic_wiring  # its SQL is that of closure


WIRING = [("unconnected", "Input port echo.heard is not connected"), ("two sources", "Input port step.edge has more than one source; write a union in a processor"), ("no output", "A composition needs at least one node and one output"), ("unknown port", "Output port step.back does not exist"), ("both", "Names ['edge'] are both inputs and outputs"), ("itself", "Cyclic processor reference at echo.echo")]


@report(values("what, message", WIRING))
def refused_wiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What wrong compositions are refused with."""
    edits = {
        "unconnected": lambda m: m["bindings"].pop(0),
        "two sources": lambda m: m["inputs"]["edge"]["targets"].append(END("step", "edge")),
        "no output": lambda m: m["outputs"].clear(),
        "unknown port": lambda m: m["outputs"].update(reach=END("step", "back")),
        "both": lambda m: m["outputs"].update(edge=END("step", "reach")),
        "itself": lambda m: m["nodes"].update(echo={"of": "whole"}),
    }
    found = []
    for what, edit in edits.items():
        manifest = json.loads(json.dumps(LOOP))
        edit(manifest)
        found.append((what, refused(lambda m=manifest: compose(m, lambda r, m=m: {"composition": m} if r["of"] == "whole" else PARTS[r["of"]]))))
    return spark.createDataFrame(found, "what string, message string")


@report(values("what, message", [("missing input", "Input relation back is missing from the interface"), ("twice", "Duplicate interface output reach"), ("derived as input", "Interface input reach must name a declared input relation"), ("accepted", "")]))
def checked_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which interfaces fit a program."""
    schemas = schemas_of(STEP["schemas"])
    found = {"missing input": (["edge"], ["reach"]), "twice": (["edge", "back"], ["reach", "reach"]), "derived as input": (["edge", "reach"], ["reach"]), "accepted": (["back", "edge"], ["reach"])}
    return spark.createDataFrame([(what, refused(lambda i=i, o=o: check_interface(schemas, {"inputs": i, "outputs": o}))) for what, (i, o) in found.items()], "what string, message string")


@report(values("public, private, is_input", [("edge", "Input_edge", True), ("reach", "Output_reach", False), ("back", None, False)]))
def public_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public names of a composed instance and what stands behind them; a private relation has no public name."""
    made = looped(2)
    ports = Ports.of(made.program.schemas, resolution=made.resolution)
    assert refused(lambda: ports.change(change("insert", "Module1_reach", 1, 1))) and ports.deltas({"Output_reach": 1, "Module1_reach": 2}) == {"reach": 1}
    rows = [("edge", ports.change(change("insert", "edge", 1, 2))["predicate"], True), ("reach", ports.output("reach"), False)]
    return spark.createDataFrame(rows + [("back", None, False)] * bool(refused(lambda: ports.output("back"))), "public string, private string, is_input boolean")


@report(values("lowering, kind, n", [(1, "binding", 2), (1, "external_output", 1), (1, "input_binding", 1), (1, "processor_rule", 3), (2, "external_output", 1), (2, "processor_rule", 3)]))
def resolution_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the rules of a composition came from, by lowering version."""
    kinds = [(v, r["kind"]) for v in (1, 2) for r in looped(v).resolution.rules]
    return spark.createDataFrame(kinds, "lowering long, kind string").groupBy("lowering", "kind").count().withColumnRenamed("count", "n")


@report(values("what, outcome", [("same definition, same version", True), ("two versions", True), ("old version stays", True), ("fork knows its origin", True), ("stale publish is refused", True), ("archived is not listed", True), ("import adds what is missing", True), ("import again adds nothing", True), ("damaged library is refused", True)]))
def registry_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed versions: publishing, forking, archiving, importing."""
    with tempfile.TemporaryDirectory() as folder:
        one, other = Registry(f"{folder}/one"), Registry(f"{folder}/other")
        first = one.create("step", STEP)
        identity, version = first["processor_id"], first["current"]
        second = one.publish(identity, ECHO, version)
        fork = one.fork(identity, version, "again")
        stale = refused(lambda: one.publish(identity, STEP, version))
        archived = one.archive(identity, second["generation"])
        library = one.closure(fork["processor_id"])
        found = [
            ("same definition, same version", version == version_of(dict(reversed(STEP.items())))),
            ("two versions", len(second["versions"]) == 2),
            ("old version stays", one.get(identity, version)["definition"]["rules"] == STEP["rules"]),
            ("fork knows its origin", fork["lineage"] == {"processor_id": identity, "version": version}),
            ("stale publish is refused", bool(stale)),
            ("archived is not listed", identity not in [p["processor_id"] for p in one.list()["processors"]] and archived["archived"]),
            ("import adds what is missing", other.import_library(library) == [version]),
            ("import again adds nothing", other.import_library(library) == []),
        ]
        library["versions"][version]["rules"] += " "
        found.append(("damaged library is refused", bool(refused(lambda: other.import_library(library)))))
    return spark.createDataFrame(found, "what string, outcome boolean")


@report(values("rule, variable, kind", [(0, "X", "int"), (0, "Y", "int"), (1, "X", "int"), (1, "Y", "int"), (1, "Z", "int"), (None, "back, edge", "positive"), (None, "reach", "not recursive")]))
def inspected_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program's rules, variables and dependencies without running it."""
    found = inspect_program(STEP["rules"], STEP["schemas"])
    rows = [(r["index"], v, kind) for r in found["rules"] for v, kind in r["variables"].items()]
    rows.append((None, ", ".join(sorted({d["body"] for d in found["dependencies"]})), ", ".join({d["polarity"] for d in found["dependencies"]})))
    rows.append((None, "reach", "recursive" if found["recursive_groups"] or found["diagnostics"] else "not recursive"))
    return spark.createDataFrame(rows, "rule long, variable string, kind string")


@report(values("what, value", [("health", "healthy"), ("revision", "3"), ("program_version", "2"), ("lowering_version", "1"), ("source", "open(N, R) :- nation(N, R), !closed(R)."), ("hash", "64")]))
def program_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and canonical text of an instance that was installed twice."""
    session = opened(spark, sf_dir)
    session.install(*OPEN)
    source = session.program_source()
    return spark.createDataFrame([(k, str(v)) for k, v in session.info().items()] + [("source", source["source"]), ("hash", str(len(source["sha256"])))], "what string, value string")


@report("SELECT 'source' AS world, CAST(n_nationkey AS BIGINT) AS nationkey FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT 'fork', n_nationkey FROM nation WHERE n_regionkey <> 3 UNION ALL SELECT 'name is taken', 1 UNION ALL SELECT 'lineage source', 3")
def forked_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fork goes its own way; its name and where it came from outlive the manager."""
    with tempfile.TemporaryDirectory() as folder:
        manager = Worlds(spark, folder)
        world = manager.create("source", lambda s: s.install(*OPEN))
        generation = world.start()
        world.session.load({"nation": nations(spark, sf_dir)})
        world.admit("a", generation, 2, [change("insert", "closed", 0)])
        fork = manager.fork("source", "fork")
        fork.admit("b", 1, 3, [change("insert", "closed", 3), change("delete", "closed", 0)])
        rows = [(w.name, r[0]) for w in (world, fork) for r in w.session.rows("open")]
        later = Worlds(spark, folder)
        rows += [("name is taken", 1)] * bool(refused(lambda: later.create("fork", lambda s: None)))
        rows.append((f"lineage {later.lineage('fork')['world']}", later.lineage("fork")["revision"]))
    return spark.createDataFrame(rows, "world string, nationkey long")


@report(values("request, state, fresh, output", [("n1 1", "finished", False, "one"), ("n1 2", "pending", True, None), ("n2 1", "claimed", True, None), ("stale", "Revision 1 of n1 is behind 2", False, None), ("unclaimed", "A request must be claimed before it is completed", False, None), ("private", "agent_intent is private; rules may only read agent_result", False, None)]))
def request_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a registered operation from submission to completion."""
    requests = Requests(Session(spark), "translate")
    told = relations(known="string string")
    requests.install("known(O,E) :- agent_result(E,R,O), R >= 1.", told)
    first, other = requests.submit("n1", 1, "uno"), requests.submit("n2", 1, "dos")
    requests.claim(first)
    requests.claim(other)
    second = requests.submit("n1", 2, "eins")
    requests.complete(first, "one")
    found = [(name, s["state"], s["fresh"], s["output"]) for name, s in (("n1 1", requests.status(first)), ("n1 2", requests.status(second)), ("n2 1", requests.status(other)))]
    attempts = {"stale": lambda: requests.submit("n1", 1, "uno"), "unclaimed": lambda: requests.complete(second, "x"), "private": lambda: requests.install("known(O,E) :- agent_intent(E,O,_,_).", told)}
    return spark.createDataFrame(found + [(k, refused(x), False, None) for k, x in attempts.items()], "request string, state string, fresh boolean, output string")


@report(f"{OPEN_SQL} WHERE n_regionkey <> 1 UNION ALL SELECT -1, 1 UNION ALL SELECT -2, 3")
def admission_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write that is repeated after its world was restored is a lookup: row -1 tells that it was, row -2 the revision."""
    with tempfile.TemporaryDirectory() as folder:
        world = World(spark, "w", lambda s: s.install(*OPEN))
        generation = world.start()
        world.session.load({"nation": nations(spark, sf_dir)})
        once = [change("insert", "closed", 1)]
        world.admit("k", generation, 2, once, publish=lambda s: world.save(f"{folder}/w.json"))
        again = World(spark, "w", lambda s: s.install(*OPEN))
        again.start(f"{folder}/w.json")
        done = again.admit("k", generation, 2, once)
        other = World(spark, "w", lambda s: s.install(OPEN[0].replace("!closed(R)", "closed(R)"), OPEN[1]))
        assert refused(lambda: other.start(f"{folder}/w.json")) and other.state == "failed"
        rows = [*again.session.rows("open"), (-1, int(done["state"] == "durable")), (-2, again.session.revision)]
    return spark.createDataFrame(rows, "nationkey long, regionkey long")


@report(values("what, outcome", [("reserved before", "Effect mail is already reserved"), ("settled by another", "Effect mail is not reserved that way"), ("settled", "sent"), ("settled otherwise", "Effect mail is settled otherwise"), ("receipts", "kept")]))
def effect_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects and receipts after a restore: a reserved effect is not reserved anew, and only its worker settles it, once."""
    with tempfile.TemporaryDirectory() as folder:
        world = World(spark, "w", lambda s: s.install(*OPEN), folder=Path(folder))
        generation = world.start()
        world.confirm(world.freeze(["open"], generation, 1)["boundary"], "kept")
        effect = world.reserve("mail", generation, "me")
        world.save(f"{folder}/w.json")
        again = World(spark, "w", lambda s: s.install(*OPEN))
        now = again.start(f"{folder}/w.json")
        found = [
            ("reserved before", refused(lambda: again.reserve("mail", now, "me"))),
            ("settled by another", refused(lambda: again.settle("mail", generation, "you", effect["reservation"], "sent"))),
            ("settled", again.settle("mail", generation, "me", effect["reservation"], "sent")["outcome"]),
            ("settled otherwise", refused(lambda: again.settle("mail", generation, "me", effect["reservation"], "lost"))),
            ("receipts", again.receipts[0]["receipt"]),
        ]
    return spark.createDataFrame(found, "what string, outcome string")


@report("SELECT 'closed' AS relation, CAST(1 AS BIGINT) AS inserted, CAST(1 AS BIGINT) AS deleted, CAST(2 AS BIGINT) AS transactions UNION ALL SELECT 'nation', count(*), 0, 1 FROM nation UNION ALL SELECT 'open', count(*) + count(*) FILTER (n_regionkey = 2), count(*) FILTER (n_regionkey = 2), 3 FROM nation UNION ALL SELECT 'all', 2 * count(*) + 1 + count(*) FILTER (n_regionkey = 2), 1 + count(*) FILTER (n_regionkey = 2), 6 FROM nation")
def activity_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came and went in each relation over three transactions, and in all of them as one group."""
    session = opened(spark, sf_dir)
    session.apply([change("insert", "closed", 2)])
    session.apply([change("delete", "closed", 2), change("delete", "closed", 9)])
    whole = telemetry.graph(session)
    assert sorted(telemetry.near(whole, ["closed"])["nodes"]) == ["closed", "open"]
    groups = telemetry.grouped(whole, "^[a-z]")["nodes"].values()  # by first letter
    group = {k: sum(x[k] for x in groups) for k in telemetry.COUNTERS}
    return spark.createDataFrame([(n, *(x[k] for k in telemetry.COUNTERS)) for n, x in (whole["nodes"] | {"all": group}).items()], "relation string, inserted long, deleted long, transactions long")
