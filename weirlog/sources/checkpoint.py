"""Checkpoints of a session: a JSON file of program and inputs, or Parquet tables with a pointer file.

Only the program, its inputs (empty ones too) and counters are kept; derived relations are computed again
on restore, which needs a fresh session and takes over only if everything fits.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weirlog.plans.check import program_of
from weirlog.plans.parser import parse
from weirlog.registry import write_json
from weirlog.session import Session, compact, frame
from weirlog.types import RuleError, row, schemas_of

FORMAT, MOST_BYTES = "weirlog-checkpoint-1", 64 << 20


def _head(session: Session, metadata: Any, strict: bool) -> dict:
    if session.health != "healthy":
        raise RuleError(f"A session that is {session.health} cannot be saved")
    program = session.program
    if private := [n for n in program.schemas if n.startswith("agent_")]:
        raise RuleError(f"Programs with registered operations cannot be saved: {private}")
    if strict and program.operators:
        raise RuleError("Programs with native operators cannot be saved in strict mode")
    head = {
        "format": FORMAT,
        "rules": "\n".join(c.text for c in program.clauses),
        "schemas": {n: s.to_json() for n, s in program.schemas.items()},
        "operators": [o.to_json() for o in program.operators],
        "revision": session.revision,
        "program_version": session.program_version,
        "metadata": metadata,
    }
    return head | ({"lowering_version": 2} if session.options.version == 2 else {}) | ({"feeds": dict(session.feeds)} if session.feeds else {})


def _digest(value: Mapping) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def checkpoint_value(session: Session, metadata: Any = None, strict: bool = False) -> dict:
    """The whole checkpoint as a JSON value, with its digest; refused beyond 64 MiB (use save_tables)."""
    value = _head(session, metadata, strict)
    value["inputs"], size = {}, 0
    for name, df in session.export_inputs().items():
        rows = []
        for r in df.orderBy(*df.columns).toLocalIterator():
            rows.append(list(r))
            size += len(compact(rows[-1]).encode()) + 1
            if size > MOST_BYTES:
                raise RuleError("A JSON checkpoint holds at most 64 MiB")
        value["inputs"][name] = rows
    if len(compact(value).encode()) > MOST_BYTES:
        raise RuleError("A JSON checkpoint holds at most 64 MiB")
    return value | {"sha256": _digest(value)}


def save(session: Session, path: str | Path, metadata: Any = None, strict: bool = False) -> str:
    """Writes the JSON file atomically; its digest."""
    value = checkpoint_value(session, metadata, strict)
    write_json(Path(path), value)
    return value["sha256"]


def _validated(value: Mapping) -> dict:
    """The head of a checkpoint, or RuleError."""
    value = dict(value)
    digest = value.pop("sha256", None)
    if value.get("format") != FORMAT:
        raise RuleError("Unknown checkpoint format")
    if digest != _digest(value):
        raise RuleError("The checkpoint's digest does not match")
    if not value["revision"] >= value["program_version"] >= 1:
        raise RuleError("A checkpoint needs revision >= program_version >= 1")
    schemas = schemas_of(value["schemas"])
    if set(value["inputs"]) != {n for n, s in schemas.items() if s.input}:
        raise RuleError("The checkpoint's inputs are not those of its schemas")
    if any(n.startswith("agent_") for n in schemas):
        raise RuleError("Programs with registered operations cannot be restored")
    parse(value["rules"])
    return value


def _fresh(session: Session) -> None:
    if session.program is not None:
        raise RuleError("Restore needs a fresh session")


def restore_value(session: Session, value: Mapping) -> Any:
    """Fills a fresh session; the checkpoint's metadata."""
    _fresh(session)
    value = _validated(value)
    schemas, inputs = schemas_of(value["schemas"]), {}
    for name, rows in value["inputs"].items():
        checked = [row(r, schemas[name], name) for r in rows]
        if len(set(map(repr, checked))) != len(checked):
            raise RuleError(f"Duplicate rows in {name}")
        if any(type(v) is float and repr(v) == "-0.0" for r in rows for v in r):
            raise RuleError(f"Negative zero in {name}")
        inputs[name] = frame(session.spark, checked, schemas[name])
    return _take(session, value, inputs)


def _take(session: Session, value: Mapping, inputs: Mapping) -> Any:
    trial = Session(session.spark, session.options)
    trial.inputs = dict(inputs)
    trial.install_program(program_of(value["rules"], value["schemas"], value["operators"]))
    session.program, session.inputs, session.results, session.health = trial.program, trial.inputs, trial.results, "healthy"
    session.revision, session.program_version, session.feeds = value["revision"], value["program_version"], dict(value.get("feeds", {}))
    return value["metadata"]


def pin(session: Session) -> str:
    """A digest of what a restored program must be: canonical rules, schemas, operators and lowering."""
    program = session._installed()
    return _digest({"rules": [c.text for c in program.clauses], "schemas": {n: s.to_json() for n, s in program.schemas.items()}, "operators": [o.to_json() for o in program.operators], "lowering": session.options.version})


def restore(session: Session, path: str | Path) -> Any:
    return restore_value(session, json.loads(Path(path).read_text()))


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file by Spark's file system, so that the folder can be anywhere Spark writes; renamed into place."""
    jvm = spark._jvm
    target, temporary = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(temporary, True)
    out.write(text.encode())
    out.close()
    fs.delete(target, False)
    if not fs.rename(temporary, target):
        raise RuleError(f"{path} cannot be published")


def save_tables(session: Session, folder: str, publication: str | None = None, metadata: Any = None) -> dict:
    """Stages the inputs as Parquet in a fresh folder, then publishes it by a pointer file; repeating a publication is a lookup."""
    spark, publication = session.spark, publication or uuid.uuid4().hex
    head = _head(session, metadata, False)
    head["inputs"] = {}
    for name, df in session.export_inputs().items():
        head["inputs"][name] = f"{folder}/{publication}-{uuid.uuid4().hex}/{name}"
        df.write.parquet(head["inputs"][name])
    sealed = head | {"sha256": _digest(head), "publication_id": publication}
    _write_text(spark, f"{folder}/{publication}.json", json.dumps(sealed))
    _write_text(spark, f"{folder}/current.json", json.dumps(sealed))
    return {"publication_id": publication, "checkpoint_sha256": sealed["sha256"]}


def restore_tables(session: Session, folder: str, publication: str | None = None) -> Any:
    """Fills a fresh session from a publication, or the current one."""
    _fresh(session)
    name = publication or "current"
    value = json.loads("\n".join(r.value for r in session.spark.read.text(f"{folder}/{name}.json", wholetext=True).collect()))
    value.pop("publication_id")
    value = _validated(value)
    schemas = schemas_of(value["schemas"])
    inputs = {n: session.spark.read.schema(schemas[n].struct).parquet(path).select(*(F.col(c) for c in schemas[n].columns)) for n, path in value["inputs"].items()}
    return _take(session, value, inputs)
