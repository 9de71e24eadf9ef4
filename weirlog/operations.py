"""Every operation of an instance by name: what an outside caller may ask for, with plain arguments and results."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from weirlog.registry import Registry
from weirlog.requests import Requests
from weirlog.session import MOST_ROWS, Session, beyond
from weirlog.types import RuleError, row

REGISTRY = {f"processor_{n}": n for n in "create publish fork get list search archive restore".split()}
REQUESTS = {"submit_input": "submit", "claim_request": "claim", "complete_request": "complete", "request_status": "status"}


@dataclass
class Instance:
    """A session, with a registry and a registered operation if there are. A pinned instance keeps its program."""

    session: Session
    registry: Registry | None = None
    requests: Requests | None = None
    pinned: bool = False
    deltas: dict[str, Any] = field(default_factory=dict)

    def execute(self, operation: str, arguments: Mapping[str, Any] | None = None) -> Any:
        """Registry operations go first; then a failed session tells only its status and a pinned one refuses installs."""
        args = dict(arguments or {})
        if operation in REGISTRY:
            if self.registry is None:
                raise RuleError("This instance has no registry")
            return getattr(self.registry, REGISTRY[operation])(**args)
        if self.session.health == "failed" and operation != "instance_info":
            raise RuleError("The instance has failed; only its status can be read")
        if self.pinned and operation in ("install_rules", "processor_install", "install_request_program"):
            raise RuleError("The instance's program is pinned")
        if operation in REQUESTS or operation == "install_request_program":
            if self.requests is None:
                raise RuleError("This instance has no registered operation")
            return getattr(self.requests, REQUESTS.get(operation, "install"))(**args)
        own = getattr(self, f"_{operation}", None) if operation in OPERATIONS else None
        if own is None:
            raise RuleError(f"Unknown operation {operation}")
        return own(**args)

    def _instance_info(self) -> dict:
        return self.session.info()

    def _install_rules(self, rules: str, schemas: Mapping, operators: Any = ()) -> dict:
        self.session.install(rules, schemas, operators)
        return self.session.info()

    def _processor_install(self, identity: str, version: str | None = None) -> dict:
        if self.registry is None:
            raise RuleError("This instance has no registry")
        found = self.registry.get(identity, version)["definition"]
        if "composition" in found:
            self.session.install_program(self.registry.resolve(found["composition"]).program)
        else:
            self.session.install(found["rules"], found["schemas"], found.get("operators", ()))
        return self.session.info()

    def _apply_changes(self, changes: Any, max_rows: int = MOST_ROWS) -> dict:
        """Deltas come with at most max_rows rows a relation; `more` tells which have more, for delta_rows."""
        done = self.session.apply(changes)
        self.deltas = done.deltas
        pages = {n: self._delta_rows(n, max_rows) for n in done.deltas}
        told = {"revision": done.revision, "deltas": {n: p["rows"] for n, p in pages.items() if p["rows"]}}
        return told | ({"more": more} if (more := {n: p["after"] for n, p in pages.items() if p["after"]}) else {})

    def _delta_rows(self, relation: str, max_rows: int = MOST_ROWS, after: Any = None) -> dict:
        """A page of what the last transaction changed in a relation, in the order of all fields; after: the last row of the page before."""
        if relation not in self.deltas:
            raise RuleError(f"The last transaction changed nothing in {relation}")
        if not 1 <= max_rows <= MOST_ROWS:
            raise RuleError(f"A page has 1 to {MOST_ROWS} rows")
        df, schema = self.deltas[relation], self.session.schemas[relation]
        if after is not None:
            df = df.where(beyond(schema, row(list(after)[: len(schema.fields)], schema, relation)))
        rows = [list(r) for r in df.orderBy(*schema.columns).limit(max_rows + 1).collect()]
        return {"rows": rows[:max_rows], "after": rows[max_rows - 1] if len(rows) > max_rows else None}

    def _relations(self) -> list[dict]:
        return self.session.relations()

    def _query_rows(self, **page: Any) -> dict:
        return dict(self.session.query_rows(**page).__dict__)

    def _program_source(self) -> dict:
        return self.session.program_source()

    def _query(self, relation: str) -> list[list]:
        return [list(r) for r in self.session.rows(relation)]

    def _why(self, rule: int) -> list[dict]:
        return [r.asDict() for r in self.session.why(rule).collect()]

    def _request_operations(self) -> list[dict]:
        return [{"operation": self.requests.operation, "version": self.requests.version}] if self.requests else []


OPERATIONS = tuple(n.removeprefix("_") for n in vars(Instance) if n.startswith("_") and not n.startswith("__"))
