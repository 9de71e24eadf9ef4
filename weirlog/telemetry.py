"""What an instance did and how its relations hang together: activity counters, the graph of relations, groups, neighbourhoods."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from weirlog.plans.parser import Atom
from weirlog.session import Session
from weirlog.types import RuleError

COUNTERS = ("inserted", "deleted", "transactions")


def graph(session: Session) -> dict:
    """The program as a graph: a node a relation with its counters, an edge for each pair that a rule or an operator connects."""
    program = session._installed()
    nodes, edges = {}, {}
    for name, schema in sorted(program.schemas.items()):
        kind = "input" if schema.input else "operator" if any(o.output == name for o in program.operators) else "derived"
        nodes[name] = {"kind": kind, "rules": len(program.rules_of(name)), **{k: session.activity.get(name, {}).get(k, 0) for k in COUNTERS}}
    for clause in program.clauses:
        for a in clause.body:
            if isinstance(a, Atom):
                edges.setdefault((a.predicate, clause.head.predicate), set()).add("negative" if a.negated else "positive")
    for o in program.operators:
        for name in o.reads:
            edges.setdefault((name, o.output), set()).add("operator")
    return {"revision": session.revision, "nodes": nodes, "edges": [{"from": a, "to": b, "kinds": sorted(kinds)} for (a, b), kinds in sorted(edges.items())]}


def grouped(whole: Mapping, pattern: str) -> dict:
    """The graph with relations of one group as one node: the group is the pattern's first group, or its whole match; others stay alone."""
    try:
        found = re.compile(pattern)
    except re.error as problem:
        raise RuleError(f"Invalid pattern: {problem}") from None

    def group(name: str) -> str:
        m = found.search(name)
        return (m[1] if found.groups else m[0]) or name if m else name

    nodes: dict[str, dict] = {}
    for name, node in whole["nodes"].items():
        one = nodes.setdefault(group(name), {"relations": [], "kinds": set(), "rules": 0, **dict.fromkeys(COUNTERS, 0)})
        one["relations"].append(name)
        one["kinds"].add(node["kind"])
        for key in ("rules", *COUNTERS):
            one[key] += node[key]
    edges: dict[tuple[str, str], set[str]] = {}
    for e in whole["edges"]:
        if (ends := (group(e["from"]), group(e["to"])))[0] != ends[1]:
            edges.setdefault(ends, set()).update(e["kinds"])
    return {"revision": whole["revision"], "nodes": {n: x | {"kinds": sorted(x["kinds"])} for n, x in nodes.items()}, "edges": [{"from": a, "to": b, "kinds": sorted(k)} for (a, b), k in sorted(edges.items())]}


def near(whole: Mapping, names: Iterable[str], hops: int = 1) -> dict:
    """The part of a graph within so many edges of the given nodes, in either direction."""
    kept = set(names)
    if unknown := kept - set(whole["nodes"]):
        raise RuleError(f"Unknown nodes {sorted(unknown)}")
    for _ in range(hops):
        kept |= {x for e in whole["edges"] for x in (e["from"], e["to"]) if kept & {e["from"], e["to"]}}
    return {**whole, "nodes": {n: x for n, x in whole["nodes"].items() if n in kept}, "edges": [e for e in whole["edges"] if {e["from"], e["to"]} <= kept]}
