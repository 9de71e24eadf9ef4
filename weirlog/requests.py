"""Registered operations: requests to the outside that live beside a program's relations.

An external operation maps a text to a text, asynchronously and never inside evaluation. Four inputs hold
its life (intents, which is current, claims, responses) and four derived relations tell its state; the
user's rules may read the results alone.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from weirlog.plans.check import program_of
from weirlog.plans.parser import Atom, parse
from weirlog.session import Session
from weirlog.types import RuleError, Schema, schemas_of

#: The protocol's relations and rules.
INPUTS = {
    "agent_intent": ("string", "string", "int", "string"),
    "agent_current": ("string", "string"),
    "agent_response": ("string", "string"),
    "agent_claimed": ("string",),
}
OUTPUTS = {
    "agent_running": ("string",),
    "agent_finished": ("string",),
    "agent_pending": ("string", "string", "int", "string"),
    "agent_result": ("string", "int", "string"),
}
RULES = """
agent_finished(Id) :- agent_response(Id, _).
agent_running(Id) :- agent_claimed(Id), agent_intent(Id, E, _, _), agent_current(E, Id), !agent_finished(Id).
agent_pending(Id, E, R, P) :- agent_intent(Id, E, R, P), agent_current(E, Id), !agent_finished(Id), !agent_claimed(Id).
agent_result(E, R, Out) :- agent_intent(Id, E, R, _), agent_current(E, Id), agent_response(Id, Out).
"""
SCHEMAS = {n: Schema(True, f) for n, f in INPUTS.items()} | {n: Schema(False, f) for n, f in OUTPUTS.items()}


def with_requests(rules: str, schemas: Mapping) -> tuple[str, dict[str, Schema]]:
    """The user's program with the protocol's relations; it may read agent_result and define none of them."""
    own = schemas_of(schemas)
    if private := [n for n in own if n.startswith("agent_")]:
        raise RuleError(f"Relations {private} are reserved for registered operations")
    for clause in parse(rules):
        used = [clause.head.predicate] + [a.predicate for a in clause.body if isinstance(a, Atom)]
        for i, name in enumerate(used):
            if name.startswith("agent_") and (not i or name != "agent_result"):
                raise RuleError(f"{name} is private; rules may only read agent_result")
    return rules + RULES, own | SCHEMAS


@dataclass
class Requests:
    """The state machine of one registered operation over a session."""

    session: Session
    operation: str
    version: str = "1"
    known: dict[str, tuple[str, int, str]] = field(default_factory=dict)
    current: dict[str, str] = field(default_factory=dict)
    claimed: set[str] = field(default_factory=set)
    responses: dict[str, str] = field(default_factory=dict)

    def install(self, rules: str, schemas: Mapping) -> int:
        return self.session.install_program(program_of(*with_requests(rules, schemas)))

    def identity(self, entity: str, revision: int, payload: str) -> str:
        return json.dumps([self.operation, self.version, entity, revision, payload], separators=(",", ":"), ensure_ascii=False)

    def _change(self, op: str, predicate: str, *values) -> dict:
        return {"op": op, "predicate": predicate, "values": list(values)}

    def submit(self, entity: str, revision: int, payload: str) -> str:
        """Makes a request current for its entity; its id. Revisions of an entity never go back."""
        request = self.identity(entity, revision, payload)
        old = self.current.get(entity)
        if old == request:
            return request
        if old and self.known[old][1] > revision:
            raise RuleError(f"Revision {revision} of {entity} is behind {self.known[old][1]}")
        if old and self.known[old][1] == revision:
            raise RuleError(f"Revision {revision} of {entity} already has another payload")
        changes = [self._change("insert", "agent_intent", request, entity, revision, payload), self._change("insert", "agent_current", entity, request)]
        if old:
            changes.insert(0, self._change("delete", "agent_current", entity, old))
        self.session.apply_without_deltas(changes)
        self.known[request], self.current[entity] = (entity, revision, payload), request
        return request

    def fresh(self, request: str) -> bool:
        return self.current.get(self._known(request)[0]) == request

    def _known(self, request: str) -> tuple[str, int, str]:
        if request not in self.known:
            raise RuleError(f"Unknown request {request}")
        return self.known[request]

    def claim(self, request: str) -> dict:
        """Takes a current request, once."""
        entity, revision, payload = self._known(request)
        if not self.fresh(request):
            raise RuleError("Only a current request can be claimed")
        if request in self.claimed or request in self.responses:
            raise RuleError("The request is already claimed")
        self.session.apply_without_deltas([self._change("insert", "agent_claimed", request)])
        self.claimed.add(request)
        return {"request": request, "entity": entity, "revision": revision, "payload": payload}

    def complete(self, request: str, output: str) -> dict:
        """Records a response; repeating it is a lookup, another one a conflict, a stale one is kept but not fresh."""
        self._known(request)
        if request not in self.claimed:
            raise RuleError("A request must be claimed before it is completed")
        if request in self.responses and self.responses[request] != output:
            raise RuleError("The request already has another response")
        if request not in self.responses:
            self.session.apply_without_deltas([self._change("insert", "agent_response", request, output)])
            self.responses[request] = output
        return {"request": request, "output": output, "fresh": self.fresh(request)}

    def status(self, request: str) -> dict:
        self._known(request)
        state = "finished" if request in self.responses else "claimed" if request in self.claimed else "pending"
        return {"request": request, "state": state, "fresh": self.fresh(request), "output": self.responses.get(request)}
