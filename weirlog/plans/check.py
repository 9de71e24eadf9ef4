"""From clauses to a checked program: literal types, safety, strata."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from weirlog.operators.registry import Operator, operators_of
from weirlog.plans.parser import Atom, Clause, Comparison, Constant, Term, Variable, Wildcard, parse, term_text
from weirlog.types import RuleError, Schema, schemas_of, text_cell


@dataclass(frozen=True)
class Program:
    """A program that compiles: typed clauses, operators, schemas and the order of its strata."""

    clauses: tuple[Clause, ...]
    schemas: dict[str, Schema]
    operators: tuple[Operator, ...] = ()
    #: Groups of derived relations that depend on each other, in an order in which they can be computed.
    strata: tuple[tuple[str, ...], ...] = ()
    text: str = ""
    depends: dict[str, frozenset[str]] = field(default_factory=dict)

    @property
    def inputs(self) -> list[str]:
        return [n for n, s in self.schemas.items() if s.input]

    @property
    def derived(self) -> list[str]:
        return [n for n, s in self.schemas.items() if not s.input]

    def rules_of(self, relation: str) -> list[Clause]:
        return [c for c in self.clauses if c.head.predicate == relation]

    def recursive(self, stratum: tuple[str, ...]) -> bool:
        return len(stratum) > 1 or stratum[0] in self.depends.get(stratum[0], ())

    def affected(self, changed: Iterable[str]) -> set[str]:
        """The derived relations that depend on any of the given ones."""
        found, more = set(), set(changed)
        while more:
            more = {r for r, on in self.depends.items() if r not in found and not on.isdisjoint(more | found)}
            found |= more
        return found

    def needed(self, wanted: Iterable[str]) -> set[str]:
        """All relations that the given ones are computed from, themselves included."""
        found, more = set(), set(wanted)
        while more:
            found |= more
            more = {b for r in more for b in self.depends.get(r, ())} - found
        return found


def resolved(clause: Clause, schemas: Mapping[str, Schema]) -> Clause:
    """Bare true and false are texts where a text is expected; this checks nothing."""

    def as_text(term: Term) -> Term:
        return Constant(term_text(term)) if isinstance(term, Constant) and isinstance(term.value, bool) else term

    def atom(a: Atom) -> Atom:
        kinds = schemas[a.predicate].fields if a.predicate in schemas else ()
        kinds = (*kinds, *[None] * len(a.terms))
        return replace(a, terms=tuple(as_text(t) if k == "string" else t for t, k in zip(a.terms, kinds, strict=False)))

    kinds = {}
    for a in clause.body:
        if isinstance(a, Atom) and not a.negated and a.predicate in schemas:
            kinds |= {t.name: k for t, k in zip(a.terms, schemas[a.predicate].fields, strict=False) if isinstance(t, Variable)}
    without_bools = all(k in ("int", "string") for s in schemas.values() for k in s.fields)

    def is_text(t: Term) -> bool:
        return isinstance(t, Constant) and isinstance(t.value, str) or isinstance(t, Variable) and kinds.get(t.name) == "string"

    def comparison(c: Comparison) -> Comparison:
        if c.rest:
            return c
        left = as_text(c.left) if without_bools or is_text(c.right) else c.left
        right = as_text(c.right) if without_bools or is_text(c.left) else c.right
        return replace(c, left=left, right=right)

    body = tuple(atom(x) if isinstance(x, Atom) else comparison(x) if isinstance(x, Comparison) else x for x in clause.body)
    return replace(clause, head=atom(clause.head), body=body)


def _check_atom(a: Atom, schemas: Mapping[str, Schema], kinds: dict[str, str], place: str) -> None:
    schema = schemas.get(a.predicate)
    if schema is None:
        raise RuleError(f"Undeclared {'head ' if place == 'head' else ''}relation {a.predicate}")
    if len(a.terms) != len(schema.fields):
        raise RuleError(f"Arity mismatch for {a.predicate}: expected {len(schema.fields)} fields {list(schema.fields)}, got {len(a.terms)}")
    for i, (term, kind) in enumerate(zip(a.terms, schema.fields, strict=True)):
        if isinstance(term, Variable):
            if term.name not in kinds and place != "body":
                raise RuleError(f"Unbound {place} variable {term.name} in {a.predicate}")
            if kinds.setdefault(term.name, kind) != kind:
                raise RuleError(f"Conflicting types for {term.name} at {a.predicate} field {i}: previously {kinds[term.name]}, requires {kind}")
        elif not (isinstance(term, Constant) and term.kind == kind or isinstance(term, Wildcard) and place != "head"):
            raise RuleError(f"Unsupported or mismatched term {term_text(term)} at {a.predicate} field {i}: requires {kind}")
        elif isinstance(term, Constant) and kind == "string":
            text_cell(term.value)


def check_clause(clause: Clause, schemas: Mapping[str, Schema]) -> dict[str, str]:
    """The types of the clause's variables."""
    if clause.is_fact:
        raise RuleError("Facts must be submitted through apply_changes")
    if clause.head.predicate in schemas and schemas[clause.head.predicate].input:
        raise RuleError(f"Rule head {clause.head.predicate} must be an output relation")
    kinds: dict[str, str] = {}
    for a in clause.body:
        if isinstance(a, Atom) and not a.negated:
            _check_atom(a, schemas, kinds, "body")
    _check_atom(clause.head, schemas, kinds, "head")
    for x in clause.body:
        if isinstance(x, Atom):
            if x.negated:
                _check_atom(x, schemas, kinds, "negated")
        elif isinstance(x, Comparison) and not x.rest:
            sides = []
            for t in (x.left, x.right):
                if isinstance(t, Variable) and t.name not in kinds:
                    raise RuleError(f"Unbound comparison variable {t.name}")
                if not isinstance(t, Variable | Constant):
                    raise RuleError(f"Unsupported comparison term {term_text(t)}")
                sides.append(kinds[t.name] if isinstance(t, Variable) else t.kind)
                if isinstance(t, Constant) and isinstance(t.value, str):
                    text_cell(t.value)
            if sides[0] != sides[1]:
                raise RuleError(f"Comparison type mismatch: {sides[0]} and {sides[1]}")
            if x.operator not in ("=", "\\=") and sides[0] not in ("int", "double"):
                raise RuleError("Ordering requires numeric fields")
        else:
            raise RuleError("Aggregates, arithmetic and clock builtins are not supported")
    if not kinds:
        raise RuleError("Rule must bind at least one variable")
    return kinds


def components(graph: Mapping[str, Iterable[str]]) -> list[tuple[str, ...]]:
    """Strongly connected components, dependencies first (an iterative depth-first search)."""
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    path: list[str] = []
    found: list[tuple[str, ...]] = []
    for root in sorted(graph):
        work = [(root, iter(sorted(graph[root])))] if root not in number else []
        while work:
            node, more = work[-1]
            if node not in number:
                number[node] = low[node] = len(number)
                path.append(node)
            child = next((c for c in more if c in graph and (c not in number or c in path)), None)
            if child is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    group = path[path.index(node) :]
                    del path[path.index(node) :]
                    found.append(tuple(sorted(group)))
            elif child in number:
                low[node] = min(low[node], number[child])
            else:
                work.append((child, iter(sorted(graph[child]))))
    return found


def program_of(rules: str | Iterable[Clause], schemas: Mapping, operators: Iterable = ()) -> Program:
    """A checked program; operators are Operator values or their JSON forms."""
    schemas, chosen = schemas_of(schemas), operators_of(operators)
    authored = tuple(parse(rules)) if isinstance(rules, str) else tuple(rules)
    if not authored and not chosen:
        raise RuleError("Expected at least one rule")
    clauses = tuple(resolved(c, schemas) for c in authored)
    edges: dict[str, dict[str, str]] = {n: {} for n, s in schemas.items() if not s.input}
    for c in clauses:
        check_clause(c, schemas)
        for a in c.body:
            if isinstance(a, Atom) and edges[c.head.predicate].get(a.predicate) != "negative":
                edges[c.head.predicate][a.predicate] = "negative" if a.negated else "positive"
    for o in chosen:
        o.check(schemas)
        for name in o.reads:
            edges[o.output][name] = "operator"
    strata = components(edges)
    for group in strata:
        for head in group:
            for on, kind in edges[head].items():
                if on in group and kind == "negative":
                    raise RuleError(f"Unstratified negation: {head} negatively depends on {on} in a dependency cycle")
                if on in group and kind == "operator":
                    raise RuleError(f"Recursive dependency through native operator: {head} depends on {on}")
    text = rules if isinstance(rules, str) else "\n".join(c.text for c in authored)
    return Program(clauses, schemas, chosen, tuple(strata), text, {h: frozenset(on) for h, on in edges.items()})
