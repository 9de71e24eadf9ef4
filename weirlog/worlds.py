"""Worlds: supervised sessions with scenarios, fenced admission, effects, freezing and forks."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from weirlog.compose import Ports
from weirlog.registry import write_json
from weirlog.session import Page, Session, compact
from weirlog.sources import checkpoint
from weirlog.types import RuleError, row

#: Limits of a world's admissions.
MOST_CHANGES, MOST_CHANGE_BYTES, MOST_RECORDS, MOST_EFFECTS = 1000, 256 << 10, 4096, 1024
MOST_FROZEN_BYTES, MOST_FROZEN_ROWS = 64 << 20, 1_000_000
NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]{0,127}")
STATES = ("created", "starting", "running", "stopping", "stopped", "failed", "interrupted")


def digest(value: Any) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def run_scenarios(start: Callable[[], Session], scenarios: Sequence[Mapping]) -> dict:
    """Applies each scenario's changes on top of the ones before and compares relations with what is expected, as sets."""
    session, report = start(), []
    for one in scenarios:
        if not {"name", "changes", "expect"} <= set(one) or set(one) - {"name", "description", "changes", "expect"}:
            raise RuleError("A scenario has a name, changes and expectations")
        session.apply_without_deltas(one["changes"])
        results = []
        for relation, rows in one["expect"].items():
            schema = session.schemas[relation]
            want = {tuple((type(v), v) for v in row(r, schema, relation)) for r in rows}
            have = {tuple((type(v), v) for v in r) for r in session.rows(relation)}
            plain = lambda some: sorted([v for _, v in r] for r in some)
            results.append({"relation": relation, "missing": plain(want - have), "unexpected": plain(have - want)})
        passed = not any(r["missing"] or r["unexpected"] for r in results)
        report.append({"name": one["name"], "passed": passed, "results": results})
    return {"passed": all(r["passed"] for r in report), "scenarios": report}


@dataclass
class World:
    """A session under supervision. A restart is a new generation; nothing resumes by itself."""

    spark: Any
    name: str
    install: Callable[[Session], Any]
    ports: Ports | None = None
    folder: Path | None = None
    state: str = "created"
    generation: int = 0
    session: Session | None = None
    admissions: dict[str, dict] = field(default_factory=dict)
    effects: dict[str, dict] = field(default_factory=dict)
    scenarios: list[dict] = field(default_factory=list)
    frozen: dict | None = None
    receipts: list[dict] = field(default_factory=list)

    def start(self, restore_from: str | Path | None = None) -> int:
        """A new generation, empty or from a checkpoint of this world, whose records of admissions, effects and receipts it takes over."""
        if self.state in ("starting", "running", "stopping"):
            raise RuleError(f"World {self.name} is {self.state}")
        self.state, session = "starting", Session(self.spark)
        try:
            told = self._restored(session, restore_from) if restore_from else self.install(session) and {}
        except Exception:
            self.state = "failed"
            raise
        for key, value in (told or {}).items():
            setattr(self, key, value)
        self.session, self.generation, self.state = session, self.generation + 1, "running"
        return self.generation

    def _restored(self, session: Session, path: str | Path) -> dict:
        """What the checkpoint tells of this world, once its program, lowering and ports are those that the world installs."""
        told = checkpoint.restore(session, path) or {}
        if told.get("world", self.name) != self.name:
            raise RuleError(f"The checkpoint is of world {told['world']}")
        if "pin" in told:
            fresh = Session(self.spark)
            self.install(fresh)
            if told["pin"] != checkpoint.pin(fresh):
                raise RuleError("The checkpoint's program is not the one that this world installs")
            if told["ports"] != self._ports():
                raise RuleError("The checkpoint's ports are not this world's")
        found = {k: told[k] for k in ("admissions", "effects", "receipts", "frozen") if k in told}
        for record in found.get("admissions", {}).values():
            if record["state"] == "applied":  # and saved, since it is here
                record["state"] = "durable"
        return found | {"generation": max(self.generation, told.get("generation", 0))}

    def _ports(self) -> dict | None:
        return {"inputs": self.ports.inputs, "outputs": self.ports.outputs} if self.ports else None

    def stop(self) -> None:
        self._running()
        self.state, self.session = "stopped", None

    def _running(self) -> Session:
        if self.state != "running" or self.session is None:
            raise RuleError(f"World {self.name} is {self.state}")
        return self.session

    def status(self) -> dict:
        info = self.session.info() if self.session else {}
        return {"name": self.name, "state": self.state, "generation": self.generation, **info}

    def _fence(self, generation: int, revision: int | None = None) -> Session:
        session = self._running()
        if generation != self.generation:
            raise RuleError(f"Generation {generation} is not current; it is {self.generation}")
        if revision is not None and revision != session.revision:
            raise RuleError(f"Revision {revision} is not current; it is {session.revision}")
        return session

    # Admission

    def admit(self, key: str, generation: int, revision: int, changes: Sequence[Mapping], publish: Callable[[Session], Any] | None = None) -> dict:
        """Applies changes once for a key. Repeating key and changes is a lookup; other changes under it are refused.

        States: not_applied, pending, applied, durable (publish saved it), applied_but_unpublished (publish
        failed), uncertain (applying broke off).
        """
        own = digest([generation, revision, list(changes)])
        if key in self.admissions:
            if self.admissions[key]["digest"] != own:
                raise RuleError(f"Admission key {key} belongs to other changes")
            return dict(self.admissions[key])
        session = self._fence(generation, revision)
        if self.frozen:
            raise RuleError("Admissions wait for the frozen boundary's receipt")
        if len(changes) > MOST_CHANGES or len(compact(list(changes)).encode()) > MOST_CHANGE_BYTES:
            raise RuleError("An admission has at most 1000 changes and 256 KiB")
        if len(self.admissions) >= MOST_RECORDS:
            raise RuleError("The world holds its most admissions")
        mapped = [self.ports.change(c) for c in changes] if self.ports else list(changes)
        session.staged(mapped)
        record = self.admissions[key] = {"key": key, "digest": own, "state": "pending", "generation": generation, "revision": revision}
        try:
            done = session.apply_without_deltas(mapped)
        except RuleError:
            record["state"] = "not_applied"
            raise
        except Exception:
            record["state"], self.state = "uncertain", "failed"
            session.health = "failed"  # nobody knows what was applied: this session serves no more
            raise
        record |= {"state": "applied", "applied_revision": done["revision"]}
        if publish:
            try:
                record |= {"state": "durable", "publication": publish(session)}
            except Exception as problem:
                record |= {"state": "applied_but_unpublished", "problem": str(problem)}
        return dict(record)

    def admission_status(self, key: str) -> dict:
        return dict(self.admissions.get(key, {"key": key, "state": "not_applied"}))

    def read_batch(self, generation: int, revision: int, reads: Sequence[Mapping]) -> list[Page]:
        session = self._fence(generation, revision)
        if self.ports:
            names = self.ports.inputs | self.ports.outputs
            reads = [{**r, "relation": names.get(r["relation"], r["relation"])} for r in reads]
        return session.read_batch(reads, revision)

    # Effects

    def reserve(self, key: str, generation: int, worker: str) -> dict:
        """Reserves an outside effect, once for a key."""
        self._fence(generation)
        if key in self.effects:
            raise RuleError(f"Effect {key} is already reserved")
        if len(self.effects) >= MOST_EFFECTS:
            raise RuleError("The world holds its most effects")
        self.effects[key] = {"key": key, "world": self.name, "generation": generation, "worker": worker, "reservation": uuid.uuid4().hex, "outcome": None}
        return dict(self.effects[key])

    def settle(self, key: str, generation: int, worker: str, reservation: str, outcome: Any) -> dict:
        """Settles a reserved effect; only whoever reserved it can, and only with one outcome."""
        effect = self.effects.get(key)
        if effect is None or (effect["generation"], effect["worker"], effect["reservation"]) != (generation, worker, reservation):
            raise RuleError(f"Effect {key} is not reserved that way")
        if effect["outcome"] is not None and effect["outcome"] != outcome:
            raise RuleError(f"Effect {key} is settled otherwise")
        effect["outcome"] = outcome
        return dict(effect)

    # Scenarios, checkpoints, boundaries, forks

    def test(self) -> dict:
        def fresh() -> Session:
            session = Session(self.spark)
            self.install(session)
            return session

        return run_scenarios(fresh, self.scenarios)

    def save(self, path: str | Path) -> str:
        session = self._running()
        told = {"world": self.name, "generation": self.generation, "pin": checkpoint.pin(session), "ports": self._ports()}
        return checkpoint.save(session, path, told | {"admissions": self.admissions, "effects": self.effects, "receipts": self.receipts, "frozen": self.frozen})

    def freeze(self, outputs: Sequence[str], generation: int, revision: int) -> dict:
        """Writes complete outputs and a checkpoint under the names of their content; admissions wait for confirm()."""
        session, folder = self._fence(generation, revision), Path(self.folder or ".")
        if self.frozen:
            raise RuleError("A boundary is already frozen")
        names = {n: self.ports.output(n) if self.ports else n for n in outputs}
        manifest, size = {"world": self.name, "generation": generation, "revision": revision, "outputs": {}, "parent": self.receipts[-1]["boundary"] if self.receipts else None}, 0
        for name, relation in sorted(names.items()):
            df = session.query(relation)
            if df.count() > MOST_FROZEN_ROWS:
                raise RuleError(f"{name} has more than {MOST_FROZEN_ROWS} rows; use write_relation")
            rows = [list(r) for r in df.orderBy(*df.columns).toLocalIterator()]
            size += len(compact(rows).encode())
            if size > MOST_FROZEN_BYTES:
                raise RuleError("Frozen outputs hold at most 64 MiB")
            own = digest(rows)
            write_json(folder / "blobs" / f"{own}.json", rows)
            manifest["outputs"][name] = {"sha256": own, "rows": len(rows), "schema": session.schemas[relation].to_json()}
        saved = checkpoint.checkpoint_value(session)
        write_json(folder / "blobs" / f"{saved['sha256']}.json", saved)
        manifest["checkpoint"] = saved["sha256"]
        self.frozen = manifest | {"boundary": digest(manifest)}
        write_json(folder / "boundaries" / f"{self.frozen['boundary']}.json", manifest)
        return dict(self.frozen)

    def confirm(self, boundary: str, receipt: Any) -> None:
        """Ends the wait with the receipt of exactly this boundary."""
        if not self.frozen or self.frozen["boundary"] != boundary:
            raise RuleError("No such boundary is frozen")
        self.receipts.append({"boundary": boundary, "receipt": receipt})
        self.frozen = None

    def fork(self, name: str, boundary: str | None = None) -> World:
        """A new running world from a frozen boundary, or from now."""
        session = Session(self.spark)
        if boundary:
            folder = Path(self.folder or ".")
            manifest = json.loads((folder / "boundaries" / f"{boundary}.json").read_text())
            value = json.loads((folder / "blobs" / f"{manifest['checkpoint']}.json").read_text())
        else:
            value = checkpoint.checkpoint_value(self._running())
        checkpoint.restore_value(session, value)
        return World(self.spark, name, self.install, self.ports, self.folder, "running", 1, session, scenarios=list(self.scenarios))


class Worlds:
    """The worlds of one manager, by name. With a folder names are reserved there, with what a world was forked from, and stay so after a restart."""

    def __init__(self, spark: Any, folder: str | Path | None = None) -> None:
        self.spark, self.worlds, self.folder = spark, {}, Path(folder) if folder else None

    def _reserve(self, name: str, lineage: Mapping | None) -> None:
        if name in self.worlds:
            raise RuleError(f"World {name} exists")
        if self.folder:
            if not NAME.fullmatch(name):
                raise RuleError(f"Invalid world name {name!r}")
            self.folder.mkdir(parents=True, exist_ok=True)
            try:
                with open(self.folder / f"{name}.json", "x") as out:
                    json.dump({"name": name, "lineage": dict(lineage) if lineage else None}, out)
                    out.flush()
                    os.fsync(out.fileno())
            except FileExistsError:
                raise RuleError(f"World {name} exists") from None

    def create(self, name: str, install: Callable[[Session], Any], **more) -> World:
        self._reserve(name, None)
        self.worlds[name] = World(self.spark, name, install, **more)
        return self.worlds[name]

    def open(self, name: str, install: Callable[[Session], Any], **more) -> World:
        """A world whose name an earlier manager reserved in the folder; start it from its checkpoint."""
        self.lineage(name)
        return self.worlds.setdefault(name, World(self.spark, name, install, **more))

    def lineage(self, name: str) -> dict | None:
        path = self.folder / f"{name}.json" if self.folder and NAME.fullmatch(name) else None
        if path is None or not path.exists():
            raise RuleError(f"Unknown world {name}")
        return json.loads(path.read_text())["lineage"]

    def fork(self, source: str, name: str, boundary: str | None = None) -> World:
        """A world of a new name from another one's frozen boundary, or from its present."""
        world = self.get(source)
        lineage = {"world": source, "generation": world.generation, "revision": world.session.revision if world.session else None, "boundary": boundary}
        self._reserve(name, lineage)
        self.worlds[name] = world.fork(name, boundary)
        return self.worlds[name]

    def get(self, name: str) -> World:
        if name not in self.worlds:
            raise RuleError(f"Unknown world {name}")
        return self.worlds[name]

    def inventory(self) -> list[dict]:
        return [w.status() for _, w in sorted(self.worlds.items())]
