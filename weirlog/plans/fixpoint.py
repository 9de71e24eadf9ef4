"""Evaluation by strata: plain plans where nothing recurs, semi-naive rounds where something does."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from weirlog.plans.check import Program
from weirlog.plans.compile import derived, empty
from weirlog.plans.parser import Atom
from weirlog.sources.shared import materialise

#: Rounds after which the parts of a growing relation are written together.
COMPACT = 8


def union(parts: list[DataFrame]) -> DataFrame:
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    return found


def _plain(spark: SparkSession, program: Program, relation: str, relations: Mapping[str, DataFrame]) -> DataFrame:
    schema = program.schemas[relation]
    parts = [derived(spark, c, schema, lambda _, a: relations[a.predicate]) for c in program.rules_of(relation)]
    parts += [o.run(relations) for o in program.operators if o.output == relation]
    return union(parts).distinct() if parts else empty(spark, schema)


def _recursive(spark: SparkSession, program: Program, stratum: tuple[str, ...], relations: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """A stratum from nothing: the rules that do not read it, then rounds."""
    first: dict[str, list[DataFrame]] = {r: [] for r in stratum}
    for r in stratum:
        for c in program.rules_of(r):
            if not any(isinstance(a, Atom) and a.predicate in stratum for a in c.body):
                first[r].append(derived(spark, c, program.schemas[r], lambda _, a: relations[a.predicate]))
    added = rounds(spark, program, stratum, relations, {}, first)
    return {r: union(added[r]) if added[r] else empty(spark, program.schemas[r]) for r in stratum}


def rounds(spark: SparkSession, program: Program, stratum: tuple[str, ...], relations: Mapping[str, DataFrame], seed: Mapping[str, DataFrame], first: Mapping[str, list[DataFrame]]) -> dict[str, list[DataFrame]]:
    """Semi-naive rounds over all relations of a stratum: the rows that come to the seed (which may be empty), as tables.

    first holds the rows that start the rounds. Each round evaluates every recursive rule once for each place that
    reads the stratum: that place reads the last round's new rows, earlier places all rows, later places the
    rows before. New rows are written to the shared folder, which cuts their lineage; the seed is never written again.
    """
    rules = [(c, program.schemas[c.head.predicate]) for r in stratum for c in program.rules_of(r)]
    inside = {id(c): [i for i, a in enumerate(c.body) if isinstance(a, Atom) and a.predicate in stratum] for c, _ in rules}
    added: dict[str, list[DataFrame]] = {r: [] for r in stratum}

    def rows_of(r: str) -> DataFrame:
        parts = [*([seed[r]] if r in seed else []), *added[r]]
        return union(parts) if parts else empty(spark, program.schemas[r])

    before, candidates = {r: rows_of(r) for r in stratum}, first
    while True:
        delta = {}
        for r in stratum:
            if candidates[r]:
                rows = union(candidates[r]).distinct()
                if r in seed or added[r]:
                    columns = program.schemas[r].columns
                    rows = rows.join(before[r].toDF(*columns), columns, "left_anti")
                rows = materialise(rows, "delta")
                if not rows.isEmpty():
                    delta[r] = rows
        if not delta:
            return added
        for r, rows in delta.items():
            added[r].append(rows)
            if len(added[r]) > COMPACT:
                added[r] = [materialise(union(added[r]), "full")]
        after = {r: rows_of(r) for r in stratum}
        candidates = {r: [] for r in stratum}
        for c, schema in rules:
            for at in inside[id(c)]:
                if c.body[at].predicate in delta:

                    def read(i: int, a: Atom, at: int = at) -> DataFrame:
                        if a.predicate not in stratum:
                            return relations[a.predicate]
                        return delta[a.predicate] if i == at else (after if i < at else before)[a.predicate]

                    candidates[c.head.predicate].append(derived(spark, c, schema, read, at))
        before = after


def readers(program: Program, needed: Iterable[str]) -> Counter[str]:
    """How often each relation is read by the rules and operators of the needed relations."""
    found: Counter[str] = Counter()
    for r in needed:
        found.update(a.predicate for c in program.rules_of(r) for a in c.body if isinstance(a, Atom))
    for o in program.operators:
        found.update(o.reads if o.output in needed else ())
    return found


def evaluate(spark: SparkSession, program: Program, inputs: Mapping[str, DataFrame], wanted: Iterable[str] | None = None, known: Mapping[str, DataFrame] | None = None, stored: Iterable[str] = ()) -> dict[str, DataFrame]:
    """The derived relations that are wanted (all, if not told) and what they need.

    inputs: rows of the input relations as sets; known: derived relations that need not be computed again;
    stored: relations of either that are tables already. A derived relation that several atoms read, and
    whatever rounds of recursion or an operator read again and again, is written once and not computed anew.
    """
    relations = {r: inputs[r] if r in inputs else empty(spark, program.schemas[r]) for r in program.inputs} | dict(known or {})
    wanted = set(wanted if wanted is not None else program.derived)
    needed, stored = program.needed(wanted), set(stored)
    reads = readers(program, needed) + Counter(wanted)

    def store(names: Iterable[str]) -> None:
        for r in sorted(set(names) - stored):
            relations[r] = materialise(relations[r], "relation")
            stored.add(r)

    for stratum in program.strata:
        if needed.isdisjoint(stratum) or all(r in relations for r in stratum):
            continue
        again = {a.predicate for r in stratum for c in program.rules_of(r) for a in c.body if isinstance(a, Atom)} - set(stratum)
        again = again if program.recursive(stratum) else {n for o in program.operators if o.output in stratum for n in o.reads}
        store(again)
        if program.recursive(stratum):
            relations |= _recursive(spark, program, stratum, relations)
        else:
            relations[stratum[0]] = _plain(spark, program, stratum[0], relations)
            if reads[stratum[0]] > 1:
                store(stratum)
    return {r: df for r, df in relations.items() if r not in program.inputs and r in needed}
