"""A registry of definitions in a folder: immutable versions named by content, pointers moved by compare-and-set."""

from __future__ import annotations

import hashlib
import json
import os
import re
import secrets
import tempfile
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from weirlog.compose import Composed, check_interface, compose
from weirlog.plans.check import program_of
from weirlog.types import RuleError, schemas_of

IDENTITY, VERSION = re.compile(r"processor_[0-9a-f]{32}"), re.compile(r"sha256:[0-9a-f]{64}")
#: Fields that are left out of a stored definition when they are empty, and the one that is always there.
OPTIONAL, ALWAYS = ("inspection", "interface", "operators"), {"operation": None}


def canonical(definition: Mapping) -> dict:
    found = {k: v for k, v in definition.items() if k not in OPTIONAL or v}
    return found if "composition" in found else ALWAYS | found


def version_of(definition: Mapping) -> str:
    """sha256: and the hash of the definition's JSON with sorted keys."""
    text = json.dumps(canonical(definition), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def write_json(path: Path, value: Any) -> None:
    """Atomically: a temporary file in the same folder, flushed, then renamed."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=path.parent, suffix=".new")
    with os.fdopen(handle, "w") as out:
        json.dump(value, out, sort_keys=True, ensure_ascii=False)
        out.flush()
        os.fsync(out.fileno())
    os.replace(temporary, path)
    folder = os.open(path.parent, os.O_RDONLY)
    os.fsync(folder)
    os.close(folder)


class Registry:
    """create, publish, fork, get, list, search, archive, restore; versions are never changed."""

    def __init__(self, folder: str | os.PathLike) -> None:
        self.folder = Path(folder)

    def _processor(self, identity: str) -> Path:
        if not IDENTITY.fullmatch(identity):
            raise RuleError(f"Invalid processor identity {identity!r}")
        return self.folder / "processors" / f"{identity}.json"

    def _definition(self, version: str) -> Path:
        if not VERSION.fullmatch(version):
            raise RuleError(f"Invalid processor version {version!r}")
        return self.folder / "versions" / f"{version[7:]}.json"

    def _record(self, identity: str) -> dict:
        path = self._processor(identity)
        if not path.exists():
            raise RuleError(f"Unknown processor {identity}")
        return json.loads(path.read_text())

    def check(self, definition: Mapping) -> None:
        """A definition that could be installed; a composition is resolved wholly."""
        if definition.get("operation") and definition.get("operators"):
            raise RuleError("Typed operators cannot be combined with a registered operation")
        if "composition" in definition:
            self.resolve(definition["composition"])
        else:
            schemas = schemas_of(definition["schemas"])
            if definition.get("interface"):
                check_interface(schemas, definition["interface"])
            program_of(definition["rules"], schemas, definition.get("operators", ()))

    def _store(self, definition: Mapping) -> str:
        self.check(definition)
        version = version_of(definition)
        if not self._definition(version).exists():
            write_json(self._definition(version), canonical(definition))
        return version

    def create(self, name: str, definition: Mapping, description: str = "", lineage: Mapping | None = None) -> dict:
        version = self._store(definition)
        record = {"processor_id": f"processor_{secrets.token_hex(16)}", "name": name, "description": description, "current": version, "versions": [version], "archived": False, "generation": 1, "lineage": dict(lineage) if lineage else None}
        write_json(self._processor(record["processor_id"]), record)
        return record

    def _change(self, identity: str, expected: Any, key: str, **changes) -> dict:
        record = self._record(identity)
        if record[key] != expected:
            raise RuleError(f"{key} of {identity} is {record[key]!r}, not {expected!r}")
        record |= changes | {"generation": record["generation"] + 1}
        write_json(self._processor(identity), record)
        return record

    def publish(self, identity: str, definition: Mapping, expected: str) -> dict:
        """A new current version, if the current one is the expected."""
        record = self._record(identity)
        if record["archived"]:
            raise RuleError(f"{identity} is archived")
        if record["current"] != expected:
            raise RuleError(f"current of {identity} is {record['current']!r}, not {expected!r}")
        version = self._store(definition)
        return self._change(identity, expected, "current", current=version, versions=[*dict.fromkeys([*record["versions"], version])])

    def fork(self, identity: str, version: str, name: str, description: str = "") -> dict:
        return self.create(name, self.get(identity, version)["definition"], description, {"processor_id": identity, "version": version})

    def get(self, identity: str, version: str | None = None) -> dict:
        record = self._record(identity)
        version = version or record["current"]
        if version not in record["versions"]:
            raise RuleError(f"{identity} has no version {version}")
        definition = json.loads(self._definition(version).read_text())
        if version_of(definition) != version:
            raise RuleError(f"Version {version} is damaged")
        return {**record, "version": version, "definition": definition}

    def list(self, limit: int = 100, after: str | None = None, archived: bool = False, text: str = "") -> dict:
        """A page in order of identity; text is looked for in names and descriptions as it is, in any case."""
        if not 1 <= limit <= 100:
            raise RuleError("A page has 1 to 100 processors")
        found, folder = [], self.folder / "processors"
        for path in sorted(folder.glob("*.json")) if folder.exists() else []:
            record = json.loads(path.read_text())
            if (after is None or record["processor_id"] > after) and record["archived"] == archived and text.casefold() in f"{record['name']}\n{record['description']}".casefold():
                found.append(record)
        page = found[:limit]
        return {"processors": page, "after": page[-1]["processor_id"] if len(found) > limit else None}

    def search(self, text: str, limit: int = 100, after: str | None = None) -> dict:
        return self.list(limit, after, text=text)

    def archive(self, identity: str, generation: int) -> dict:
        return self._change(identity, generation, "generation", archived=True)

    def restore(self, identity: str, generation: int) -> dict:
        return self._change(identity, generation, "generation", archived=False)

    def definition(self, reference: Mapping) -> dict:
        """The definition of an exact {processor_id, version}."""
        if set(reference) != {"processor_id", "version"}:
            raise RuleError("A reference has a processor_id and a version")
        return self.get(reference["processor_id"], reference["version"])["definition"]

    def resolve(self, manifest: Mapping, version: int = 1) -> Composed:
        return compose(manifest, self.definition, version)

    def closure(self, identity: str, version: str | None = None) -> dict:
        """A library: the records and definitions that a version needs, itself first."""
        records, versions, waiting = {}, {}, [{"processor_id": identity, "version": self.get(identity, version)["version"]}]
        while waiting:
            reference = waiting.pop(0)
            if reference["version"] in versions and reference["processor_id"] in records:
                continue
            found = self.get(**{"identity": reference["processor_id"], "version": reference["version"]})
            versions[reference["version"]] = found["definition"]
            records.setdefault(reference["processor_id"], {k: found[k] for k in ("processor_id", "name", "description", "lineage")} | {"versions": []})["versions"].append(reference["version"])
            waiting += found["definition"].get("composition", {}).get("nodes", {}).values()
        return {"root": {"processor_id": identity, "version": next(iter(versions))}, "records": records, "versions": versions}

    def import_library(self, library: Mapping) -> list[str]:
        """Adds what is missing after checking all of it; repeating it changes nothing and pointers stay."""
        for version, definition in library["versions"].items():
            if version_of(definition) != version:
                raise RuleError(f"Version {version} is damaged")
        with tempfile.TemporaryDirectory() as scratch:
            trial = Registry(scratch)
            trial._add(library)
            for definition in library["versions"].values():
                trial.check(definition)
        return self._add(library)

    def _add(self, library: Mapping) -> list[str]:
        added = []
        for version, definition in library["versions"].items():
            if not self._definition(version).exists():
                write_json(self._definition(version), definition)
                added.append(version)
        for identity, record in library["records"].items():
            path = self._processor(identity)
            if path.exists():
                old = json.loads(path.read_text())
                more = [v for v in record["versions"] if v not in old["versions"]]
                if more:
                    write_json(path, old | {"versions": [*old["versions"], *more]})
            else:
                write_json(path, {**record, "current": record["versions"][0], "archived": False, "generation": 1})
        return added
