"""A program instance: retained inputs, transactions with deltas, revisions, bounded reads, witnesses.

Inputs and results are DataFrames of the current revision, each a table and the few rows that differ from it. A
transaction is staged on the driver, becomes two small DataFrames (insertions, deletions), and changes only the
relations that depend on what changed, by the rows that change (plans.change); everything else keeps its DataFrame.
What a transaction makes is written to the shared folder before the session takes it over, so a failure leaves the
session as it was; tables of old revisions are deleted.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlog.plans.change import Change, Strata
from weirlog.plans.check import Program, program_of
from weirlog.plans.compile import empty, evidence
from weirlog.plans.fixpoint import evaluate
from weirlog.sources.layers import Layers
from weirlog.sources.shared import drop, recorded, written
from weirlog.types import SPARK_TYPES, RuleError, Schema, cell, row

MOST_ROWS, MOST_BYTES = 10_000, 4 << 20
#: So many revisions back, DataFrames and deltas can still be read; older tables are deleted.
KEPT = 8


@dataclass(frozen=True)
class Options:
    """explain keeps bindings for why(); exports limits what is computed and can be read (None: all derived)."""

    explain: bool = True
    exports: tuple[str, ...] | None = None

    @property
    def version(self) -> int:
        return 1 if self.explain else 2


@dataclass(frozen=True)
class Applied:
    """What a transaction did; deltas by relation: DataFrames of the row and its weight, +1 or -1."""

    revision: int
    program_version: int
    deltas: dict[str, DataFrame]


@dataclass(frozen=True)
class Page:
    rows: list[list]
    bytes: int
    truncated: bool
    cursor: str | None
    revision: int
    total: int | None = None


def compact(value: Any) -> str:
    """JSON without white space, texts as they are."""
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def frame(spark: SparkSession, rows: Iterable[Sequence], schema: Schema) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema.struct)


class Session:
    """One installed program and its data."""

    def __init__(self, spark: SparkSession, options: Options = Options()) -> None:
        self.spark, self.options, self.owner = spark, options, uuid.uuid4().hex
        self.program: Program | None = None
        self.inputs: dict[str, DataFrame] = {}
        self.results: dict[str, DataFrame] = {}
        self.layers: dict[str, Layers] = {}
        self.views: dict[str, DataFrame] = {}
        self.tables: list[list[str]] = []
        self.activity: dict[str, dict[str, int]] = {}
        self.feeds: dict[str, int] = {}
        self.revision = self.program_version = 0
        self.health = "empty"

    # Programs

    def install(self, rules: str | Sequence, schemas: Mapping, operators: Iterable = ()) -> int:
        """Compiles a program, computes it over the retained inputs and takes it over; the old one stays if that fails."""
        return self.install_program(program_of(rules, schemas, operators))

    def install_program(self, program: Program) -> int:
        held = any(not df.isEmpty() for df in self.inputs.values())
        if self.program and held:
            for r, old in self.program.schemas.items():
                if old.input and program.schemas.get(r) != old:
                    raise RuleError(f"Input schema of {r} cannot change while facts are retained")
        inputs = {r: self.inputs[r] if r in self.inputs else empty(self.spark, program.schemas[r]) for r in program.inputs}
        with recorded() as passing:
            found = evaluate(self.spark, program, inputs, self._exports(program), stored=inputs) if held else {}
        with recorded() as kept:
            tables = {r: written(df, "result") for r, df in found.items()}
        if not held:  # every rule needs a fact
            tables = {r: (empty(self.spark, program.schemas[r]), None) for r in program.needed(self._exports(program)) if r not in inputs}
        drop(self.spark, passing)
        self.layers = {r: x for r, x in self.layers.items() if r in inputs} | {r: Layers.of(*x) for r, x in tables.items()}
        self.program, self.inputs, self.results = program, inputs, {r: df for r, (df, _) in tables.items()}
        self.views = {r: df for r, df in self.views.items() if r in inputs} | self.results
        self.revision, self.program_version, self.health = self.revision + 1, self.program_version + 1, "healthy"
        self._sweep(kept)
        return self.revision

    def _exports(self, program: Program) -> list[str]:
        wanted = program.derived if self.options.exports is None else list(self.options.exports)
        for r in wanted:
            if r not in program.schemas or program.schemas[r].input:
                raise RuleError(f"Export {r} must name a declared derived relation")
        return wanted

    def _installed(self) -> Program:
        if self.program is None:
            raise RuleError("Install a program first")
        return self.program

    @property
    def schemas(self) -> dict[str, Schema]:
        return dict(self._installed().schemas)

    def program_source(self) -> dict:
        """Canonical rule text with its hash, and Spark's plans of the exported relations."""
        program = self._installed()
        text = "\n".join(c.text for c in program.clauses)
        return {"source": text, "sha256": hashlib.sha256(text.encode()).hexdigest(), "authored": program.text}

    def plan(self, relation: str) -> str:
        """Spark's formatted plan of a derived relation over the current inputs."""
        program = self._installed()
        found = evaluate(self.spark, program, self.inputs, [relation])[relation]
        return found._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def info(self) -> dict:
        return {"health": self.health, "revision": self.revision, "program_version": self.program_version, "lowering_version": self.options.version}

    # Transactions

    def staged(self, changes: Iterable[Mapping]) -> dict[str, dict[tuple, bool]]:
        """For each input the facts that change and whether each is there in the end; all are checked first."""
        program, found = self._installed(), {}
        for change in changes:
            name = change.get("predicate")
            if name not in program.schemas:
                raise RuleError(f"Unknown relation {name}")
            schema = program.schemas[name]
            if not schema.input:
                raise RuleError(f"Cannot mutate a derived relation {name}")
            if change.get("op") not in ("insert", "delete"):
                raise RuleError(f"Expected insert or delete, got {change.get('op')!r}")
            facts = found.setdefault(name, {})
            fact = tuple(map(_exact, row(change.get("values", ()), schema, name)))
            facts.pop(fact, None)
            facts[fact] = change["op"] == "insert"
        return {r: {tuple(v for _, v in fact): there for fact, there in facts.items()} for r, facts in found.items()}

    def apply(self, changes: Iterable[Mapping], deltas: bool = True) -> Applied:
        """Inserts and deletes facts; the last change of a fact wins and only what differs counts."""
        staged = self.staged(changes)
        made: dict[str, tuple[DataFrame, DataFrame, DataFrame]] = {}
        for r, facts in staged.items():
            schema, old = self.program.schemas[r], self.inputs[r]
            insert, delete = (frame(self.spark, [f for f, there in facts.items() if there is want], schema) for want in (True, False))
            new = insert.join(old, schema.columns, "left_anti").select(*schema.columns)
            gone = delete.join(old, schema.columns, "left_semi").select(*schema.columns)
            made[r] = (old, new, gone)
        return self._advance(made, deltas)

    def apply_without_deltas(self, changes: Iterable[Mapping]) -> dict:
        done = self.apply(changes, deltas=False)
        return {"revision": done.revision, "program_version": done.program_version}

    def load(self, tables: Mapping[str, DataFrame], deltas: bool = False) -> Applied:
        """Inserts whole typed relations (see sources.tables) in one transaction, without passing the driver."""
        made = {}
        for r, rows in tables.items():
            if r not in self._installed().schemas or not self.program.schemas[r].input:
                raise RuleError(f"Unknown input relation {r}")
            columns = self.program.schemas[r].columns
            new = rows.toDF(*columns).distinct().join(self.inputs[r], columns, "left_anti").select(*columns)
            made[r] = (self.inputs[r], new, empty(self.spark, self.program.schemas[r]))
        return self._advance(made, deltas)

    def _advance(self, made: Mapping[str, tuple[DataFrame, DataFrame, DataFrame]], deltas: bool) -> Applied:
        """Takes over new inputs: made holds by relation its old rows, what comes and what goes. Only what differs is written."""
        program, layers = self._installed(), dict(self._layers())
        first = not any(x.n_base or x.n_other for x in layers.values())
        old = {r: x.rows for r, x in layers.items()}
        new, changes = dict(old), {}
        with recorded() as passing:
            try:
                for r, (_, come, gone) in made.items():
                    self._take(r, Change.of(come, gone), layers, new, changes)
                strata = Strata(self.spark, program, old, new, changes)
                stale = program.affected(changes) & set(self.results)
                if first and stale:  # nothing was there: all that follows has come
                    found = evaluate(self.spark, program, {r: new[r] for r in program.inputs}, stale, stored=program.inputs)
                    for r in stale:
                        self._take(r, Change.of(found[r], found[r].limit(0)), layers, new, changes)
                    stale = set()
                for stratum in program.strata:
                    if not stale.isdisjoint(stratum):
                        for r, change in strata.of(stratum).items():
                            self._take(r, change, layers, new, changes)
            except RuleError:
                raise
            except Exception:
                self._check_health()
                raise
        self.layers = layers
        self.inputs, self.results = ({r: layers[r].rows if r in changes else df for r, df in some.items()} for some in (self.inputs, self.results))
        self.views = self.inputs | self.results
        self.revision += 1
        exported = set(self._exports(program))
        told = {r: self._weighted(change) for r, change in changes.items() if r in exported}
        for r, change in changes.items():
            n = self.activity.setdefault(r, {"inserted": 0, "deleted": 0, "transactions": 0})
            for key, df in (("inserted", change.come), ("deleted", change.gone)):
                n[key] += df.count() if df is not None else 0
            n["transactions"] += 1
        self._sweep(passing)
        return Applied(self.revision, self.program_version, told if deltas else {})

    def _take(self, relation: str, change: Change, layers: dict[str, Layers], new: dict[str, DataFrame], changes: dict[str, Change]) -> None:
        if change:
            layers[relation] = layers[relation].changed(change.come, change.gone, change.paths, "rows")
            new[relation], changes[relation] = layers[relation].rows, change

    def _weighted(self, change: Change) -> DataFrame:
        parts = [df.withColumn("weight", F.lit(w)) for df, w in ((change.gone, -1), (change.come, 1)) if df is not None]
        return parts[0].union(parts[1]) if len(parts) > 1 else parts[0]

    def _layers(self) -> dict[str, Layers]:
        """The layers of every relation; one whose rows were set from outside begins anew."""
        for r, df in (self.inputs | self.results).items():
            if r not in self.layers or self.views.get(r) is not df:
                self.layers[r] = Layers.of(df)
        return {r: self.layers[r] for r in (*self.inputs, *self.results)}

    def _sweep(self, paths: Iterable[str]) -> None:
        """Tables of revisions that are KEPT revisions old go, unless the current one reads them."""
        self.tables.append(list(paths))
        live = {p for x in self.layers.values() for p in x.paths}
        while len(self.tables) > KEPT:
            oldest = self.tables.pop(0)
            self.tables[0] += [p for p in oldest if p in live]
            drop(self.spark, [p for p in oldest if p not in live])

    def _check_health(self) -> None:
        """After a failure: what was there still holds, unless Spark itself is gone; then nothing can be told any more."""
        try:
            if self.spark._jsc.sc().isStopped():
                self.health = "failed"
        except Exception:
            self.health = "failed"

    # Reads

    def query(self, relation: str) -> DataFrame:
        """The rows of a derived relation."""
        program = self._installed()
        if relation not in program.schemas:
            raise RuleError(f"Unknown relation {relation}")
        if program.schemas[relation].input:
            raise RuleError(f"{relation} is an input; query derived relations")
        if relation not in self._exports(program):
            raise RuleError(f"{relation} is not exported")
        return self.results[relation]

    def rows(self, relation: str) -> list[tuple]:
        """The typed rows of a derived relation, in order."""
        df = self.query(relation)
        return [tuple(r) for r in df.orderBy(*df.columns).collect()]

    def count_rows(self, relation: str) -> int:
        return self.query(relation).count()

    def _public(self, relation: str) -> tuple[DataFrame, Schema]:
        schema = self._installed().schemas.get(relation)
        if schema is None:
            raise RuleError(f"Unknown relation {relation}")
        return (self.inputs[relation] if schema.input else self.query(relation)), schema

    def relations(self) -> list[dict]:
        """Public relations with their counts at this revision: inputs first, each kind by name."""
        program = self._installed()
        names = [*program.inputs, *sorted(self._exports(program))]
        return [{"name": r, **program.schemas[r].to_json(), "count": self._public(r)[0].count(), "revision": self.revision} for r in names]

    def export_inputs(self) -> dict[str, DataFrame]:
        """All inputs, empty ones too."""
        if self.health != "healthy":
            raise RuleError(f"Inputs cannot be exported while {self.health}")
        return dict(self.inputs)

    def why(self, rule: int) -> DataFrame:
        """The bindings that satisfy a rule (by its place in the program) at this revision."""
        program = self._installed()
        if not self.options.explain:
            raise RuleError("Evidence is not kept by this lowering")
        if not 0 <= rule < len(program.clauses):
            raise RuleError(f"Unknown rule {rule}")
        return evidence(self.spark, program.clauses[rule], lambda _, a: (self.inputs | self.results)[a.predicate])

    def query_bounded(self, relation: str, filters: Mapping[int, Any] | Sequence[tuple[int, Any]] = (), max_rows: int = 100, max_bytes: int = 64 << 10, cursor: str | None = None) -> Page:
        """A page of a derived relation; rows come in the order of all columns."""
        df = self.query(relation)
        return self._page(df, self.program.schemas[relation], relation, filters, max_rows, max_bytes, cursor)

    def query_rows(self, relation: str, filters: Mapping[int, Any] | Sequence[tuple[int, Any]] = (), max_rows: int = 500, max_bytes: int = MOST_BYTES, cursor: str | None = None) -> Page:
        """A page of any public relation with the exact number of all its rows."""
        df, schema = self._public(relation)
        page = self._page(df, schema, relation, filters, max_rows, max_bytes, cursor)
        return Page(**(page.__dict__ | {"total": df.count()}))

    def _page(self, df: DataFrame, schema: Schema, relation: str, filters, max_rows: int, max_bytes: int, cursor: str | None) -> Page:
        if not 1 <= max_rows <= MOST_ROWS or not 2 <= max_bytes <= MOST_BYTES:
            raise RuleError(f"A page has 1 to {MOST_ROWS} rows and 2 to {MOST_BYTES} bytes")
        wanted = sorted(filters.items() if isinstance(filters, Mapping) else [tuple(f) for f in filters])
        for i, value in wanted:
            if type(i) is not int or not 0 <= i < len(schema.fields):
                raise RuleError(f"{relation} has no field {i}")
            df = df.where(F.col(f"f{i}") == _literal(cell(value, schema.fields[i]), schema.fields[i]))
        bound = [self.owner, self.revision, relation, [[i, cell(v, schema.fields[i])] for i, v in wanted]]
        if cursor is not None:
            try:
                *told, last = json.loads(base64.urlsafe_b64decode(cursor))
            except ValueError:
                raise RuleError("Invalid cursor") from None
            if told != json.loads(compact(bound)):
                raise RuleError("The cursor belongs to another owner, revision, relation or filter")
            df = df.where(beyond(schema, last))
        found, size, truncated = [], 2, False
        for r in df.orderBy(*schema.columns).limit(max_rows + 1).collect():
            text = compact(list(r))
            more = len(text.encode()) + bool(found)
            if len(found) == max_rows or size + more > max_bytes:
                if not found:
                    raise RuleError(f"The first row needs max_bytes of {size + more}")
                truncated = True
                break
            found.append(list(r))
            size += more
        after = base64.urlsafe_b64encode(compact([*bound, found[-1]]).encode()).decode() if truncated else None
        return Page(found, size, truncated, after, self.revision)

    def read_batch(self, reads: Sequence[Mapping], revision: int | None = None) -> list[Page]:
        """1 to 16 pages of one revision, 1,000 rows and 4 MiB together."""
        if not 1 <= len(reads) <= 16:
            raise RuleError("A read batch has 1 to 16 queries")
        if revision is not None and revision != self.revision:
            raise RuleError(f"Revision {revision} is not current; it is {self.revision}")
        if sum(r.get("max_rows", 100) for r in reads) > 1000:
            raise RuleError("A read batch has at most 1000 rows")
        pages = [self.query_rows(**({"max_rows": 100} | dict(r))) for r in reads]
        if sum(p.bytes for p in pages) > MOST_BYTES:
            raise RuleError("A read batch has at most 4 MiB")
        return pages


def _exact(value: Any) -> tuple[type, Any]:
    """Tells 1, 1.0 and true apart as dictionary keys."""
    return type(value), value


def _literal(value: Any, kind: str) -> Column:
    return F.lit(value).cast(SPARK_TYPES[kind])


def beyond(schema: Schema, last: Sequence) -> Column:
    """Rows after the given one in the order of all columns."""
    after = F.lit(False)
    for c, value, kind in reversed(list(zip(schema.columns, last, schema.fields, strict=True))):
        at = _literal(value, kind)
        after = (F.col(c) > at) | ((F.col(c) == at) & after)
    return after
