"""The registered queries of the rule engine: programs over the driver's tables, and SQL for the same rows.

Relations are positional; a query names its output columns. Whole tables are read, only the columns that a
program declares.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlog.compose import compose
from weirlog.plans.check import program_of
from weirlog.plans.fixpoint import evaluate
from weirlog.reports import REPORT_SQL, REPORTS
from weirlog.requests import with_requests
from weirlog.session import Session
from weirlog.sources import checkpoint
from weirlog.sources.shared import shared_folder
from weirlog.sources.tables import relation_of
from weirlog.streaming.feed import Feed
from weirlog.types import Schema
from weirlog.worlds import run_scenarios



def node(turn: str) -> str:
    """SQL for a node of the conversation graph: a turn of a conversation as one number.

    It is conv_id * 1000 + turn below 1000 turns. The thousands of a turn stand above the conversation (of less
    than 10^12 by magnitude), so no turn runs into another conversation.
    """
    return f"conv_id * 1000 + pmod({turn}, 1000) + ({turn} - pmod({turn}, 1000)) * 1000000000000"


TURN = node("turn")


@dataclass(frozen=True)
class Input:
    """Columns (SQL expressions) of a table as an input relation, of the rows that hold a condition."""

    table: str
    columns: Sequence[str]
    fields: str
    where: str | None = None


@dataclass(frozen=True)
class Query:
    """A program, what its inputs are read from, and one derived relation as the result."""

    rules: str
    inputs: dict[str, Input]
    outputs: dict[str, str]
    result: str
    columns: str
    operators: Sequence[dict] = field(default_factory=tuple)

    def schemas(self) -> dict[str, Schema]:
        found = {n: Schema(True, tuple(i.fields.split())) for n, i in self.inputs.items()}
        return found | {n: Schema(False, tuple(f.split())) for n, f in self.outputs.items()}

    def relations(self, spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
        found = {}
        for name, i in self.inputs.items():
            table = spark.read.parquet(f"{sf_dir}/{i.table}.parquet")
            table = table.where(i.where) if i.where is not None else table
            found[name] = relation_of(table, [F.expr(c) for c in i.columns], Schema(True, tuple(i.fields.split())))
        return found

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        program = program_of(self.rules, self.schemas(), self.operators)
        return evaluate(spark, program, self.relations(spark, sf_dir), [self.result])[self.result].toDF(*self.columns.split())


ORDERS = {"orders": Input("orders", ["o_orderkey", "o_custkey", "o_orderpriority"], "int int string")}
CUSTOMERS = {"customer": Input("customer", ["c_custkey", "c_mktsegment"], "int string")}
NATIONS = {"nation": Input("nation", ["n_nationkey", "n_regionkey"], "int int")}
REGIONS = {"region": Input("region", ["r_regionkey"], "int")}
ITEMS = {"item": Input("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity"], "int int int double")}
DEBT = {"buyer": Input("customer", ["c_nationkey", "c_acctbal"], "int double"), "seller": Input("supplier", ["s_nationkey", "s_acctbal"], "int double")}
TURNS = {"turn": Input("conversations", ["conv_id", "turn", "role", TURN], "int int string int")}
NEXT = {"next": Input("conversations", [TURN, node("(turn + 1)")], "int int")}
CLOSURE = "edge(X,Y) :- next(X,Y), turn(_,_,_,X), turn(_,_,_,Y). "
CLOSED = {"edge": "int int", "path": "int int"}
LINEAR = "path(X,Y) :- edge(X,Y). path(X,Z) :- path(X,Y), edge(Y,Z). "
TRADE = {"trade": Input("lineitem", ["l_orderkey", "l_suppkey"], "int int"), "orders": Input("orders", ["o_orderkey", "o_custkey"], "int int"), "double": Input("supplier", ["s_suppkey", "s_suppkey + 1000000000"], "int int")}

PROGRAMS: dict[str, Query] = {
    "projection_set": Query("ps(P,S) :- item(_,P,S,_).", ITEMS, {"ps": "int int"}, "ps", "partkey suppkey"),
    "filter_numeric": Query("few(O,P,S,Q) :- item(O,P,S,Q), Q =< 2.0.", ITEMS, {"few": "int int int double"}, "few", "orderkey partkey suppkey quantity"),
    "filter_var_var": Query("low(O,L,D,T) :- tax(O,L,D,T), D < T.", {"tax": Input("lineitem", ["l_orderkey", "l_linenumber", "l_discount", "l_tax"], "int int double double")}, {"low": "int int double double"}, "low", "orderkey linenumber discount tax"),
    "const_in_atom": Query('done(O,C) :- status(O,C,"F").', {"status": Input("orders", ["o_orderkey", "o_custkey", "o_orderstatus"], "int int string")}, {"done": "int int"}, "done", "orderkey custkey"),
    "constant_head": Query('tagged(R,"region",1,2.5,true) :- region(R).', REGIONS, {"tagged": "int string int double bool"}, "tagged", "regionkey kind one real yes"),
    "repeated_var": Query("same(N) :- nation(N,N).", NATIONS, {"same": "int"}, "same", "nationkey"),
    "join_equi": Query("placed(O,C,S,P) :- orders(O,C,P), customer(C,S).", ORDERS | CUSTOMERS, {"placed": "int int string string"}, "placed", "orderkey custkey segment priority"),
    "join_chain": Query("sells(R,N,G) :- region(R), nation(N,R), lives(C,N,G), orders(_,C,_).", REGIONS | NATIONS | ORDERS | {"lives": Input("customer", ["c_custkey", "c_nationkey", "c_mktsegment"], "int int string")}, {"sells": "int int string"}, "sells", "regionkey nationkey segment"),
    "self_join_lt": Query("pair(A,B) :- supplier(A,N), supplier(B,N), A < B.", {"supplier": Input("supplier", ["s_suppkey", "s_nationkey"], "int int")}, {"pair": "int int"}, "pair", "a b"),
    "theta_join": Query("over(N,R) :- nation(N,_), region(R), N > R.", NATIONS | REGIONS, {"over": "int int"}, "over", "nationkey regionkey"),
    "cross_product": Query("both(A,B) :- region(A), region(B).", REGIONS, {"both": "int int"}, "both", "a b"),
    "semi_wildcard": Query('urgent(C,S) :- customer(C,S), orders(_,C,"1-URGENT").', ORDERS | CUSTOMERS, {"urgent": "int string"}, "urgent", "custkey segment"),
    "anti_join": Query("idle(O) :- orders(O,_,_), !item(O,_,_,_).", ORDERS | ITEMS, {"idle": "int"}, "idle", "orderkey"),
    "anti_const": Query('calm(C) :- !orders(_,C,"1-URGENT"), customer(C,_).', {"orders": Input("orders", ["o_orderkey", "o_custkey", "o_orderpriority"], "int int string")} | CUSTOMERS, {"calm": "int"}, "calm", "custkey"),
    "union_rules": Query("debt(N) :- buyer(N,B), B < 0.0. debt(N) :- seller(N,B), B < 0.0.", DEBT, {"debt": "int"}, "debt", "nationkey"),
    "intersect": Query("debt(N) :- buyer(N,B), B < 0.0, seller(N,C), C < 0.0.", DEBT, {"debt": "int"}, "debt", "nationkey"),
    "difference": Query("sold(N) :- seller(N,C), C < 0.0. debt(N) :- buyer(N,B), B < 0.0, !sold(N).", DEBT, {"sold": "int", "debt": "int"}, "debt", "nationkey"),
    "negation_strata": Query('urgent(C) :- orders(_,C,"1-URGENT"). calm(C) :- customer(C,_), !urgent(C). other(C,S) :- customer(C,S), !calm(C), !build(C). build(C) :- customer(C,S), S \\= "BUILDING".', ORDERS | CUSTOMERS, {"urgent": "int", "calm": "int", "build": "int", "other": "int string"}, "other", "custkey segment"),
    "global_absence": Query('free(R) :- region(R), !named(_,"NOPE"). none(R) :- region(R), !named(_,_).', REGIONS | {"named": Input("nation", ["n_nationkey", "n_name"], "int string")}, {"free": "int", "none": "int"}, "free", "regionkey"),
    "global_absence_empty": Query("none(R) :- region(R), !named(_,_).", REGIONS | {"named": Input("nation", ["n_nationkey", "n_name"], "int string")}, {"none": "int"}, "none", "regionkey"),
    "bool_filter": Query("good(D) :- label(D,true,false).", {"label": Input("labels", ["doc_id", "quality", "toxic"], "int bool bool")}, {"good": "int"}, "good", "doc_id"),
    "constant_comparison": Query('kept(R) :- region(R), 1 < 2, "a" = "a". kept(R) :- region(R), 2 < 1.', REGIONS, {"kept": "int"}, "kept", "regionkey"),
    "closure": Query(CLOSURE + LINEAR, TURNS | NEXT, CLOSED, "path", "source target"),
    "nonlinear_closure": Query(CLOSURE + "path(X,Y) :- edge(X,Y). path(X,Z) :- path(X,Y), path(Y,Z).", TURNS | NEXT, CLOSED, "path", "source target"),
    "mutual_recursion": Query(CLOSURE + "even(X) :- turn(_,0,_,X). odd(Y) :- even(X), edge(X,Y). even(Y) :- odd(X), edge(X,Y). side(X,true) :- even(X). side(X,false) :- odd(X).", TURNS | NEXT, {"edge": "int int", "even": "int", "odd": "int", "side": "int bool"}, "side", "node is_even"),
    "unseeded_recursion": Query("loop(R) :- loop(R), region(R).", REGIONS, {"loop": "int"}, "loop", "regionkey"),
    "unreachable": Query(CLOSURE + LINEAR + 'seen(X) :- turn(_,_,"system",X). seen(Y) :- turn(_,_,"system",X), path(X,Y). unseen(X) :- turn(_,_,_,X), !seen(X).', TURNS | NEXT, CLOSED | {"seen": "int", "unseen": "int"}, "unseen", "node"),
    "components": Query("link(C,S) :- trade(O,P), orders(O,C), double(P,S). ends(C) :- link(C,_). ends(S) :- link(_,S).", TRADE, {"link": "int int", "ends": "int", "labels": "int int"}, "labels", "node label", ({"type": "large_small_star", "vertices": "ends", "edges": "link", "output": "labels"},)),
    "event_negation": Query('bought(U) :- event(U,"purchase",_). failed(U) :- event(U,"error",V), V > 200.0. smooth(U) :- bought(U), !failed(U).', {"event": Input("events", ["user_id", "event_type", "value"], "int string double")}, {"bought": "int", "failed": "int", "smooth": "int"}, "smooth", "user_id"),
}

SQL_NODE = "(conv_id * 1000 + turn % 1000 + (turn - turn % 1000) * 1000000000000)"
EDGES = f"place AS (SELECT DISTINCT conv_id, turn, {SQL_NODE} AS n FROM conversations), edge AS (SELECT a.n AS x, b.n AS y FROM place a JOIN place b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn)"
PATHS = f"WITH RECURSIVE {EDGES}, path(x, y) AS (SELECT x, y FROM edge UNION SELECT path.x, edge.y FROM path JOIN edge ON path.y = edge.x)"

SQL: dict[str, str] = {
    "projection_set": "SELECT DISTINCT l_partkey AS partkey, l_suppkey AS suppkey FROM lineitem",
    "filter_numeric": "SELECT DISTINCT l_orderkey AS orderkey, l_partkey AS partkey, l_suppkey AS suppkey, l_quantity AS quantity FROM lineitem WHERE l_quantity <= 2",
    "filter_var_var": "SELECT DISTINCT l_orderkey AS orderkey, CAST(l_linenumber AS BIGINT) AS linenumber, l_discount AS discount, l_tax AS tax FROM lineitem WHERE l_discount < l_tax",
    "const_in_atom": "SELECT DISTINCT o_orderkey AS orderkey, o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F'",
    "constant_head": "SELECT DISTINCT CAST(r_regionkey AS BIGINT) AS regionkey, 'region' AS kind, CAST(1 AS BIGINT) AS one, CAST(2.5 AS DOUBLE) AS real, TRUE AS yes FROM region",
    "repeated_var": "SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS nationkey FROM nation WHERE n_nationkey = n_regionkey",
    "join_equi": "SELECT DISTINCT o_orderkey AS orderkey, c_custkey AS custkey, c_mktsegment AS segment, o_orderpriority AS priority FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_chain": "SELECT DISTINCT CAST(r_regionkey AS BIGINT) AS regionkey, CAST(n_nationkey AS BIGINT) AS nationkey, c_mktsegment AS segment FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey",
    "self_join_lt": "SELECT DISTINCT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "theta_join": "SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS nationkey, CAST(r_regionkey AS BIGINT) AS regionkey FROM nation JOIN region ON n_nationkey > r_regionkey",
    "cross_product": "SELECT DISTINCT CAST(x.r_regionkey AS BIGINT) AS a, CAST(y.r_regionkey AS BIGINT) AS b FROM region x CROSS JOIN region y",
    "semi_wildcard": "SELECT DISTINCT c_custkey AS custkey, c_mktsegment AS segment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "anti_join": "SELECT DISTINCT o_orderkey AS orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "anti_const": "SELECT DISTINCT c_custkey AS custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "union_rules": "SELECT CAST(c_nationkey AS BIGINT) AS nationkey FROM customer WHERE c_acctbal < 0 UNION SELECT CAST(s_nationkey AS BIGINT) FROM supplier WHERE s_acctbal < 0",
    "intersect": "SELECT CAST(c_nationkey AS BIGINT) AS nationkey FROM customer WHERE c_acctbal < 0 INTERSECT SELECT CAST(s_nationkey AS BIGINT) FROM supplier WHERE s_acctbal < 0",
    "difference": "SELECT CAST(c_nationkey AS BIGINT) AS nationkey FROM customer WHERE c_acctbal < 0 EXCEPT SELECT CAST(s_nationkey AS BIGINT) FROM supplier WHERE s_acctbal < 0",
    "negation_strata": "SELECT DISTINCT c_custkey AS custkey, c_mktsegment AS segment FROM customer WHERE c_mktsegment = 'BUILDING' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "global_absence": "SELECT DISTINCT CAST(r_regionkey AS BIGINT) AS regionkey FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_name = 'NOPE')",
    "global_absence_empty": "SELECT DISTINCT CAST(r_regionkey AS BIGINT) AS regionkey FROM region WHERE NOT EXISTS (SELECT 1 FROM nation)",
    "bool_filter": "SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0",
    "constant_comparison": "SELECT DISTINCT CAST(r_regionkey AS BIGINT) AS regionkey FROM region",
    "closure": f"{PATHS} SELECT DISTINCT x AS source, y AS target FROM path",
    "nonlinear_closure": f"{PATHS} SELECT DISTINCT x AS source, y AS target FROM path",
    "mutual_recursion": f"WITH RECURSIVE {EDGES}, walk(x, e) AS (SELECT {SQL_NODE}, TRUE FROM conversations WHERE turn = 0 UNION SELECT edge.y, NOT walk.e FROM walk JOIN edge ON walk.x = edge.x) SELECT DISTINCT x AS node, e AS is_even FROM walk",
    "unseeded_recursion": "SELECT CAST(r_regionkey AS BIGINT) AS regionkey FROM region WHERE FALSE",
    "unreachable": f"{PATHS}, root AS (SELECT DISTINCT {SQL_NODE} AS x FROM conversations WHERE role = 'system'), seen AS (SELECT x FROM root UNION SELECT y FROM path JOIN root USING (x)) SELECT n AS node FROM place WHERE n NOT IN (SELECT x FROM seen)",
    "components": "WITH RECURSIVE link AS (SELECT DISTINCT o_custkey AS a, s_suppkey + 1000000000 AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey), ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link), reach(node, label) USING KEY (node) AS (SELECT a, a FROM ways UNION SELECT ways.b, min(reach.label) FROM reach JOIN ways ON reach.node = ways.a JOIN recurring.reach AS had ON had.node = ways.b GROUP BY ways.b, had.label HAVING min(reach.label) < had.label) SELECT node, label FROM reach",
    "event_negation": "SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 200)",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(PROGRAMS)


# Queries that run a whole session


def session_with(spark: SparkSession, sf_dir: str, query: str) -> tuple[Session, Query]:
    """A session that has a query's program installed and its tables loaded."""
    one = PROGRAMS[query]
    session = Session(spark)
    session.install(one.rules, one.schemas(), one.operators)
    session.load(one.relations(spark, sf_dir))
    return session, one


def apply_then_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure after a bridge was inserted and a stretch of the graph deleted."""
    session, one = session_with(spark, sf_dir, "closure")
    change = lambda op, *values: {"op": op, "predicate": "next", "values": list(values)}
    session.apply([change("insert", 0, 1000), change("insert", 7, 7)])
    session.apply([change("delete", 0, 1), change("delete", 7, 7)])
    return session.query("path").toDF(*one.columns.split())


def delta_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one transaction changes in the closure."""
    session, one = session_with(spark, sf_dir, "closure")
    change = lambda op, *values: {"op": op, "predicate": "next", "values": list(values)}
    done = session.apply([change("delete", 0, 1), change("insert", 0, 1000)])
    return done.deltas["path"].select(F.col("f0").alias("source"), F.col("f1").alias("target"), F.col("weight").cast("long").alias("weight"))


def why_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The witnesses of the rule that pairs suppliers of a nation."""
    return session_with(spark, sf_dir, "self_join_lt")[0].why(0).select(F.col("A").alias("a"), F.col("B").alias("b"), F.col("N").alias("n"))


def bounded_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages of a derived relation, one after the other."""
    session, one = session_with(spark, sf_dir, "semi_wildcard")
    rows, cursor = [], None
    for _ in range(3):
        page = session.query_bounded("urgent", {1: "BUILDING"}, max_rows=40, cursor=cursor)
        rows, cursor = rows + page.rows, page.cursor
        if cursor is None:
            break
    return spark.createDataFrame(rows, session.schemas["urgent"].struct).toDF(*one.columns.split())


def checkpoint_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived relation after its session was saved as tables and restored."""
    session, one = session_with(spark, sf_dir, "anti_join")
    folder = f"{shared_folder(spark)}/checkpoints"
    saved = checkpoint.save_tables(session, folder)
    other = Session(spark)
    checkpoint.restore_tables(other, folder, saved["publication_id"])
    return other.query(one.result).toDF(*one.columns.split())


PIPELINE_NODES = {
    "urgent": {"rules": 'urgent(O,C) :- placed(O,C,"1-URGENT").', "schemas": {"placed": {"input": True, "fields": ["int", "int", "string"]}, "urgent": {"input": False, "fields": ["int", "int"]}}, "interface": {"inputs": ["placed"], "outputs": ["urgent"]}},
    "building": {"rules": 'scratch(O,C) :- urgent(O,C), customer(C,"BUILDING"). chosen(O,C) :- scratch(O,C).', "schemas": {"urgent": {"input": True, "fields": ["int", "int"]}, "customer": {"input": True, "fields": ["int", "string"]}, "scratch": {"input": False, "fields": ["int", "int"]}, "chosen": {"input": False, "fields": ["int", "int"]}}, "interface": {"inputs": ["urgent", "customer"], "outputs": ["chosen"]}},
    "large": {"rules": "large(O,C) :- chosen(O,C), item(O,_,_,Q), Q >= 45.0.", "schemas": {"chosen": {"input": True, "fields": ["int", "int"]}, "item": {"input": True, "fields": ["int", "int", "int", "double"]}, "large": {"input": False, "fields": ["int", "int"]}}, "interface": {"inputs": ["chosen", "item"], "outputs": ["large"]}},
}
END = lambda node, relation: {"node": node, "relation": relation}
PIPELINE = {
    "nodes": {n: {"name": n} for n in PIPELINE_NODES},
    "inputs": {
        "placed": {"fields": ["int", "int", "string"], "targets": [END("urgent", "placed")]},
        "customer": {"fields": ["int", "string"], "targets": [END("building", "customer")]},
        "item": {"fields": ["int", "int", "int", "double"], "targets": [END("large", "item")]},
    },
    "bindings": [{"from": END("urgent", "urgent"), "to": END("building", "urgent")}, {"from": END("building", "chosen"), "to": END("large", "chosen")}],
    "outputs": {"large": END("large", "large")},
}
NESTED = {
    "nodes": {"inner": {"name": "pipeline"}},
    "inputs": {n: {"fields": x["fields"], "targets": [END("inner", n)]} for n, x in PIPELINE["inputs"].items()},
    "bindings": [],
    "outputs": {"large": END("inner", "large")},
}


def composed(spark: SparkSession, sf_dir: str, manifest: dict, version: int) -> DataFrame:
    made = compose(manifest, lambda reference: {"composition": PIPELINE} if reference["name"] == "pipeline" else PIPELINE_NODES[reference["name"]], version)
    tables = {"placed": ORDERS["orders"], "customer": CUSTOMERS["customer"], "item": ITEMS["item"]}
    inputs = {made.resolution.inputs[n]: relation_of(spark.read.parquet(f"{sf_dir}/{i.table}.parquet"), i.columns, Schema(True, tuple(i.fields.split()))) for n, i in tables.items()}
    result = made.resolution.outputs["large"]
    return evaluate(spark, made.program, inputs, [result])[result].toDF("orderkey", "custkey")


def composition_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nodes in a row, bindings used in place."""
    return composed(spark, sf_dir, PIPELINE, 2)


def composition_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same inside another composition, bindings copied."""
    return composed(spark, sf_dir, NESTED, 1)


def request_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a request, the finished ones answered."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    session = Session(spark)
    session.install(*with_requests("shipped(O,E,R) :- agent_result(E,R,O).", {"shipped": {"input": False, "fields": ["string", "string", "int"]}}))
    named = lambda df, *columns: relation_of(df, columns, Schema(True, tuple("int" if c is key else "string" for c in columns)))
    done = orders.where("o_orderstatus = 'F'")
    session.load({"agent_intent": named(orders, text, text, key, text), "agent_current": named(orders, text, text), "agent_claimed": named(done, text), "agent_response": named(done, text, F.concat(F.lit("ok "), text))})
    return session.query("shipped").toDF("output", "entity", "revision")


def scenario_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report over three scenarios about all regions, of which the last expects what is not so."""
    regions = sorted(r.r_regionkey for r in spark.read.parquet(f"{sf_dir}/region.parquet").collect())
    change = lambda op, predicate, v: {"op": op, "predicate": predicate, "values": [v]}

    def fresh() -> Session:
        session = Session(spark)
        session.install("open(X) :- source(X), !closed(X).", {"source": {"input": True, "fields": ["int"]}, "closed": {"input": True, "fields": ["int"]}, "open": {"input": False, "fields": ["int"]}})
        return session

    scenarios = [
        {"name": "all", "changes": [change("insert", "source", r) for r in regions], "expect": {"open": [[r] for r in regions]}},
        {"name": "closed", "changes": [change("insert", "closed", r) for r in regions[1:]], "expect": {"open": [[regions[0]]]}},
        {"name": "wrong", "changes": [change("delete", "closed", regions[1])], "expect": {"open": [[regions[0]], [-1]]}},
    ]
    report = run_scenarios(fresh, scenarios)
    found = [(s["name"], s["passed"], sum(len(r["missing"]) for r in s["results"]), sum(len(r["unexpected"]) for r in s["results"])) for s in report["scenarios"]]
    return spark.createDataFrame(found, "name string, passed boolean, missing long, unexpected long")


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with purchases but no errors, kept by a stream of the events as changes."""
    one = PROGRAMS["event_negation"]
    session = Session(spark)
    session.install(one.rules, one.schemas())
    folder = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    changes = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").format("parquet").load(f"{sf_dir}/events.parque[t]")
    stream = changes.select(F.lit("insert").alias("op"), F.col("user_id").alias("f0"), F.col("event_type").alias("f1"), F.col("value").alias("f2"))
    query = Feed(session, "event").start(stream, folder)
    query.awaitTermination()
    return session.query("smooth").toDF("user_id")


BRIDGED = "edge2 AS (SELECT x, y FROM edge WHERE NOT (x = 0 AND y = 1) UNION SELECT 0, 1000 FROM conversations a, conversations b WHERE a.conv_id = 0 AND a.turn = 0 AND b.conv_id = 1 AND b.turn = 0), path2(x, y) AS (SELECT x, y FROM edge2 UNION SELECT path2.x, edge2.y FROM path2 JOIN edge2 ON path2.y = edge2.x)"
PIPELINE_SQL = "SELECT DISTINCT o_orderkey AS orderkey, o_custkey AS custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' AND c_mktsegment = 'BUILDING' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 45)"
SQL |= {
    "apply_then_retract": f"{PATHS}, {BRIDGED} SELECT DISTINCT x AS source, y AS target FROM path2",
    "delta_weights": f"{PATHS}, {BRIDGED} SELECT x AS source, y AS target, CAST(-1 AS BIGINT) AS weight FROM (SELECT x, y FROM path EXCEPT SELECT x, y FROM path2) UNION ALL SELECT x, y, CAST(1 AS BIGINT) FROM (SELECT x, y FROM path2 EXCEPT SELECT x, y FROM path)",
    "why_bindings": "SELECT DISTINCT a.s_suppkey AS a, b.s_suppkey AS b, CAST(a.s_nationkey AS BIGINT) AS n FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "bounded_page": f"SELECT custkey, segment FROM ({SQL['semi_wildcard']}) WHERE segment = 'BUILDING' ORDER BY custkey LIMIT 120",
    "checkpoint_roundtrip": SQL["anti_join"],
    "composition_pipeline": PIPELINE_SQL,
    "composition_nested": PIPELINE_SQL,
    "request_results": "SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS entity, o_orderkey AS revision, 'ok ' || CAST(o_orderkey AS VARCHAR) AS output FROM orders WHERE o_orderstatus = 'F'",
    "scenario_report": "SELECT * FROM (VALUES ('all', TRUE, CAST(0 AS BIGINT), CAST(0 AS BIGINT)), ('closed', TRUE, 0, 0), ('wrong', FALSE, 1, 1)) t(name, passed, missing, unexpected)",
    "change_feed": SQL["event_negation"],
}
QUERIES |= {f.__name__: f for f in (apply_then_retract, delta_weights, why_bindings, bounded_page, checkpoint_roundtrip, composition_pipeline, composition_nested, request_results, scenario_report, change_feed)}
SQL |= REPORT_SQL | {"cyclic_wiring": SQL["closure"]}
QUERIES |= REPORTS
